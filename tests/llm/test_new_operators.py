"""Toxicity, whitening and Merkle manifests against plain versions and held-out accuracy, with the odd cases."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from sightline.llm import merkle, recurrent, toxicity, whitening

# Merkle manifests.

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, node string, root string"


def told(*values) -> str:
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def hashed(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def climb(nodes: list[str], k: int, width: int) -> tuple[str, list[tuple[list[str], list[str]]]]:
    """Root of a list of nodes, and the k-th one's siblings by level."""
    path = []
    while len(nodes) > 1:
        low = k // width * width
        path.append((nodes[low:k], nodes[k + 1 : low + width]))
        nodes, k = [hashed(nodes[i : i + width]) for i in range(0, len(nodes), width)], k // width
    return nodes[0], path


@pytest.mark.parametrize("width, every", [(8, 3), (2, 1), (3, 2), (2, 3)])
def test_manifest(spark, width, every):
    draw = random.Random(width)
    texts = [None, "", "Ä - 1:x", "x" * 50_000, *("Text " + str(k) for k in range(150))]
    rows = [(k if k % 11 else None, draw.choice(["s", None]), ["en"] * 9 + ["de", "", None, "fr", "\U0001d54a"], len(t or "") or None, t) for k, t in enumerate(texts)]
    rows = [(i, s, draw.choice(langs), n, t) for i, s, langs, n, t in rows]
    rows += [rows[20], rows[20], rows[30]] + [(7, "z", "only", 1, "One")]
    frame = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], FIELDS).repartition(5)
    altered = whitening.F.when(whitening.F.col("doc_id") % 3 == 0, whitening.F.lower("text")).otherwise(whitening.F.col("text"))
    got = Counter(tuple(r) for r in merkle.merkle_manifest(frame, altered, width=width, every=every).collect())
    new = lambda r: r[4].lower() if r[0] is not None and r[0] % 3 == 0 and r[4] is not None else r[4]
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, told(*(r[k] for k in (0, 1, 2, 3, 4)))))
    leaves = {x: [told(*r) for r in trees[x]] for x in langs}
    subroots = [climb(leaves[x], 0, width)[0] for x in langs]
    want = Counter()
    for n, lang in enumerate(langs):
        root, upper = climb(subroots, n, width)
        for k, r in enumerate(trees[lang]):
            path = climb(leaves[lang], k, width)[1] + upper
            node = told(*r[:4], new(r))
            for before, after in path:
                node = hashed([*before, node, *after])
            want[r[0], leaves[lang][k], subroots[n], root, hashed([x for a, b in path for x in a + b]), node, node == root] += 1
    assert got == want and 0 < sum(n for k, n in got.items() if not k[-1]) < len(rows)


def test_manifest_of_no_and_one_row(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], FIELDS)).count() == 0
    row = merkle.merkle_manifest(spark.createDataFrame([(5, None, None, None, None, "a", 1, "b", "c")], FIELDS)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == told(5, None, None, None, None) and row.proof_sha256 == sha256(b"").hexdigest() and row.verified


# Whitening.


def plain_whitening(vectors: list[list[float]], components: int):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    y = x - np.array(sums) / len(x)
    values, axes = np.linalg.eigh(y.T @ y / len(x))
    order = np.argsort(-values)[:components]
    deviation = [sum((len(x) * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return deviation, y @ axes[:, order], values[order], values.sum()


def test_whitening(spark):
    draw = np.random.default_rng(4)
    vectors = (draw.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 2500  # a vector with most of the rows
    bad = [None, [], [1.0] * 11, [None, *[1.0] * 11], [float("nan"), *[1.0] * 11], [float("inf"), *[1.0] * 11], [3e38, *[1.0] * 11]]
    rows = [(None if k == 3 else k % 2700, v, "k", 1, 2.0) for k, v in enumerate(vectors)] + [(90_000 + k, v, "k", 1, 2.0) for k, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, x int, z double").repartition(4)
    got = whitening.whiten(frame).collect()
    deviation, projected, values, trace = plain_whitening(vectors, 8)
    assert len(got) == 8 * len(vectors) and {r.n for r in got} == {len(vectors)} and {r.identity_error for r in got if r.identity_error > 1e-9} == set()
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((r[0], d) for r, d in zip(rows, deviation, strict=False))
    one = {r.vec_id: {} for r in got}
    for r in got:
        one[r.vec_id].setdefault(r.component, []).append(r.whitened)
    for k in range(8):
        assert all(abs(r.explained - values[k] / trace) < 1e-9 for r in got if r.component == k + 1)
        want = projected[:, k] / np.sqrt(values[k])
        mine = np.array([one[r[0]][k + 1][0] for r in rows[120:300]])
        sign = np.sign(mine @ want[120:300])
        assert np.abs(mine * sign - want[120:300]).max() < 1e-9


def test_whitening_weights_and_flat_directions(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(k, [float(k % 3), 1.0, float(k % 3) * 2]) for k in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, schema), weigh="one").collect()
    assert {r.n for r in got} == {3} and {r.component for r in got} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in got)
    assert all(abs(abs(r.whitened) - (0 if r.vec_id % 3 == 1 else 1.5**0.5)) < 1e-9 for r in got if r.component == 1) and {r.identity_error < 1e-9 for r in got} == {True}
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(flat) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in flat)
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0 and whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(k, [k * 1e11]) for k in range(4)], schema)).collect()
    assert {r.deviation for r in huge} == {None} and all(r.whitened is not None for r in huge)


# Toxicity.


def test_network_gradients():
    net = recurrent.Network({"a": 1})
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    draw = np.random.default_rng(0)
    x, at, error = draw.standard_normal((5, recurrent.INPUT)), np.array([[0, 1, 2, -1], [3, 3, -1, -1], [4, 0, 1, 2]]), np.array([0.3, -0.2, 0.5])
    kept: list = []
    net.forward(x, at, kept)
    found, d_x = net.backward(x, at, kept, error)

    def slope(array, place):
        own, ends = array[place], []
        for step in (1e-4, -1e-4):
            array[place] = own + step
            ends.append(float(net.forward(x, at) @ error))
        array[place] = own
        return (ends[0] - ends[1]) / 2e-4

    for name, gradient in found.items():
        for _ in range(3):
            place = tuple(draw.integers(0, s) for s in net.p[name].shape)
            assert abs(gradient[place] - slope(net.p[name], place)) < 1e-4 * max(1, abs(gradient[place]))
    assert all(abs(d_x[p] - slope(x, p)) < 1e-6 for p in ((0, 0), (3, 5), (4, 15)))


def test_windows_cover_whole_texts(monkeypatch):
    """Windows of a text in pieces are those of the text at once, and padding changes nothing."""
    net, draw = recurrent.Network({"w3": 1}), random.Random(1)
    text = " ".join(f"w{draw.randint(0, 50)}" for _ in range(1000))
    texts = [text, None, "", "?!", "one", " ".join(["w3"] * 32), " ".join(["w3"] * 65)]
    whole = recurrent.window_logits(net, texts)
    assert [len(x) for x in whole] == [len(recurrent.window_starts(n)) for n in (1000, 0, 0, 0, 1, 32, 65)] == [31, 0, 0, 0, 1, 1, 2]
    monkeypatch.setattr(recurrent, "PIECE", 96)
    monkeypatch.setattr(recurrent, "WORDS_AT_ONCE", 100)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, recurrent.window_logits(net, texts), strict=True))
    words = recurrent.words_of(text)
    for k, low in enumerate(recurrent.window_starts(1000)):
        assert abs(recurrent.window_logits(net, [" ".join(words[low : low + recurrent.WINDOW])])[0][0] - whole[0][k]) < 1e-5


def test_character_grams():
    words = ["a", "toxic", "é" * 4]
    got = recurrent.grams(words)
    assert got.counts.tolist() == [sum(max(0, len(f"<{w}>".encode()) - n + 1) for n in recurrent.GRAMS) for w in words] and got.starts.tolist() == [0, 1, 1 + got.counts[1]]
    again = recurrent.grams(["toxic"])
    assert again.buckets.tolist() == got.buckets[got.starts[1] : got.starts[1] + got.counts[1]].tolist()


@pytest.fixture(scope="module")
def labelled():
    """Texts of made-up words; toxic ones hold one word in twenty of a few words, or of a few beginnings."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice(["ka", "lo", "mi", "ne", "ru", "so", "ti"]) for _ in range(draw.randint(1, 4)))
    rows = []
    for k in range(700):
        toxic = int(k % 4 == 0)
        words = [draw.choice(["grusk", "plonf", "vexib"]) + draw.choice(["", "", "en"]) if toxic and draw.random() < 0.05 else word() for _ in range(draw.randint(60, 300))]
        rows.append((k, " ".join(words).capitalize() + "!", toxic))
    return rows


def test_held_out_accuracy(spark, labelled):
    """Labels of a third aren't learned from, and are told by the texts alone."""
    docs = spark.createDataFrame([(i, t, "score", 1) for i, t, _ in labelled] + [(None, labelled[0][1], "s", 1), (1000, None, "s", 1), (1001, "", "s", 1), (1002, " ?! ", "s", 1), (0, labelled[0][1], "s", 1)], "doc_id long, text string, score string, held_out int")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(9999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert len(got) == len(labelled) + 5 and all(r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert [scores[i] for i in (1000, 1001, 1002)] == [0, 0, 0] and len({r.score for r in got if r.doc_id in (None, 0)}) == 1
    toxic, clean = ([scores[i] for i, _, y in labelled if held(i) and y == kind] for kind in (1, 0))
    assert sum(s >= 0.7 for s in toxic) >= 0.85 * len(toxic) and sum(s >= 0.7 for s in clean) <= 0.03 * len(clean) and len(toxic) > 40
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7), labels.withColumn("toxic", whitening.F.when(toxicity.held_out(whitening.F.col("doc_id")), 1).otherwise(whitening.F.col("toxic")))).collect()}
    assert all(abs(again[i] - scores[i]) < 1e-4 for i in scores)  # labels of the third change nothing


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    labels = "doc_id long, toxic int"
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.createDataFrame([], labels)).collect()} == {(1, 0.0), (2, 0.0)}
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], labels)).collect()} == {(1, 1.0), (2, 0.0)}
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], labels)).count() == 0
    assert toxicity.fit_rows(docs, spark.createDataFrame([(1, 1)], labels), 5, 5, 4) == ([], [])
