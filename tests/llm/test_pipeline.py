"""The pipeline against its operators' plain versions, on a small corpus."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    draw = random.Random(9)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(n))
    item, base = words(40), words(80)
    texts = [words(60) for _ in range(20)] + ["too short", None, "a b c d e " * 20, base, base, base + " more", words(30) + " " + item + " " + words(30), "write to jane.12@mail.example.com at once or later, " + words(20)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0], pa.int64()), "text": [item]}), tmp_path / "benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(20), 23, 27}
    for i in (*range(20), 23):
        assert got[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() and got[i].n_tokens == len(got[i].ids)
    assert got[27].decoded_sha256 != hashlib.sha256(texts[27].encode()).hexdigest()


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes


def test_stages_on_rows_without_ids(spark, tmp_path):
    draw = random.Random(5)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 8))) for _ in range(n))
    item, clean, near, lone = words(40), words(60), words(80), words(70)
    leak = words(20) + " " + item + " " + words(20)
    pq.write_table(pa.table({"item_id": pa.array([0], pa.int64()), "text": [item]}), tmp_path / "benchmark.parquet")
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda stage, rows: sorted(((r.doc_id or 0, r.text or "", r.source) for r in stage(spark, frame(rows), str(tmp_path)).collect()))
    bad = [(100 + k, "too short", "bad") for k in range(300)]
    good = [(500 + k, words(30), "good") for k in range(300)]
    got = told(corpus_pipeline.quality, [(None, clean, "good"), (None, clean, "bad"), (None, "too short", "good"), (None, None, "good"), *bad, *good])
    assert got == sorted([(0, clean, "good"), *good])
    rows = [(1, near, "s"), (None, near + " more", "s"), (None, lone, "s"), (None, lone, "s"), (None, lone.upper(), "s"), (None, clean, "s"), (None, None, "s"), (None, " ", "s"), (None, " ", "s")]
    got = told(corpus_pipeline.near_dedup, rows)
    assert sorted((i, t.lower()) for i, t, _ in got) == sorted([(1, near), (0, lone), (0, clean), (0, ""), (0, " "), (0, " ")])
    assert told(corpus_pipeline.decontaminate, [(None, clean, "s"), (None, leak, "s"), (1, leak, "s"), (2, clean, "s")]) == sorted([(0, clean, "s"), (2, clean, "s")])


def test_stages_on_odd_tables(spark, tmp_path):
    """Columns named like the stages' own, ids of several texts, a very long text, and an empty table."""
    draw = random.Random(2)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 8))) for _ in range(n))
    names = ["row", "_row", "host", "_host", "again", "_own", "_clash", "own", "clash", "salt", "_salt", "found", "_names", "chosen", "kept"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    base = words(80)
    texts = [(1, words(60)), (1, words(60)), (2, base), (3, base), (3, base), (4, words(60_000)), (None, words(70)), (5, base + " more")]
    pq.write_table(pa.table({"item_id": pa.array([0], pa.int64()), "text": [words(40)]}), tmp_path / "benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *(f"{n} of {k}" for n in names)) for k, (i, t) in enumerate(texts)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        assert got.columns == docs.columns and len(rows) == (5 if name == "MinHash near-dedup" else len(texts))
        assert {tuple(r[n].split(" of ") for n in names)[0][1] for r in rows} <= {str(k) for k in range(len(texts))} and all(r[n].startswith(f"{n} of ") for r in rows for n in names)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == len(texts) and max(r.n_tokens for r in last) > 60_000
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64())}), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
