"""DuckDB SQL with the same rows as those queries that SQL can express on whole small tables."""

_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\v\f\r]+'), lambda w: w <> '')"

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(w) AS n_words, length(text) - length(regexp_replace(text, '[^ \t\n\v\f\r]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\v\f\r]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\v\f\r]')))) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repetitive FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (short) AS k, count(*) FILTER (repetitive) AS j FROM f GROUP BY host),
p AS (SELECT mean, CASE WHEN share > 0 THEN least(1000.0, greatest(2.0, 1 / share - 1)) ELSE 1000.0 END AS weight FROM (SELECT mean, CASE WHEN chance < 1 THEN (spread / (mean * (1 - mean)) - chance) / (1 - chance) ELSE 0 END AS share
  FROM (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) AS mean, count(*)::DOUBLE / sum(n) AS chance, sum(k::DOUBLE * k / n) / sum(n) - (sum(k)::DOUBLE / sum(n)) * (sum(k)::DOUBLE / sum(n)) AS spread FROM h))),
q AS (SELECT mean, CASE WHEN share > 0 THEN least(1000.0, greatest(2.0, 1 / share - 1)) ELSE 1000.0 END AS weight FROM (SELECT mean, CASE WHEN chance < 1 THEN (spread / (mean * (1 - mean)) - chance) / (1 - chance) ELSE 0 END AS share
  FROM (SELECT (sum(j) + 0.5::DOUBLE) / (sum(n) + 1) AS mean, count(*)::DOUBLE / sum(n) AS chance, sum(j::DOUBLE * j / n) / sum(n) - (sum(j)::DOUBLE / sum(n)) * (sum(j)::DOUBLE / sum(n)) AS spread FROM h)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT short AND NOT repetitive AND (k + p.mean * p.weight) / (n + p.weight) <= 0.5 AND (j + q.mean * q.weight) / (n + q.weight) <= 0.5 AS kept FROM f JOIN h USING (host), p, q
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, range(35) r(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each e ANTI JOIN gone USING (doc_id, i) GROUP BY e.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM s),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
pair AS MATERIALIZED (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL) JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, p.b FROM reach r JOIN pair p ON r.other = p.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""

def _crc32(n: int) -> int:
    """What a byte adds to a CRC-32, by its definition."""
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


_CRC = str([_crc32(n) for n in range(256)])
#: The search tries a capacity by filling shards one by one: a step of the recursion places one cut, or settles the capacity and halves the range.
OP4 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS leader FROM documents),
o AS MATERIALIZED (SELECT doc_id, t, size, leader, (sum(size) OVER (ORDER BY leader, doc_id) - size)::BIGINT AS before, row_number() OVER (ORDER BY leader, doc_id) - 1 AS row FROM d),
total AS MATERIALIZED (SELECT sum(size)::BIGINT AS total FROM d),
bound AS MATERIALIZED (SELECT before FROM o WHERE doc_id = leader UNION ALL SELECT total FROM total),
search(low, high, cuts) AS (
  SELECT greatest(ceil(total / 16)::BIGINT, (SELECT max(s) FROM (SELECT sum(size)::BIGINT AS s FROM d GROUP BY leader))), total, [0::BIGINT] FROM total
  UNION ALL
  SELECT CASE WHEN after < total AND len(cuts) = 16 THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN after = total THEN (low + high) // 2 ELSE high END, CASE WHEN after = total OR len(cuts) = 16 THEN [0::BIGINT] ELSE list_append(cuts, after) END
  FROM (SELECT low, high, cuts, max(before) AS after FROM search, bound WHERE low < high AND before <= cuts[-1] + (low + high) // 2 GROUP BY ALL), total),
best AS MATERIALIZED (SELECT min(high) AS capacity FROM search WHERE low = high),
fill(cuts, k) AS (SELECT [0::BIGINT], 1 UNION ALL SELECT list_append(cuts, after), k + 1 FROM (SELECT cuts, k, max(before) AS after FROM fill, bound, best WHERE before <= cuts[-1] + capacity GROUP BY ALL), total WHERE after < total),
final AS (SELECT cuts FROM fill ORDER BY k DESC LIMIT 1),
sums AS (SELECT t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a // 256, {_CRC}[xor(a % 256, b) + 1])), 4294967295) AS text_crc32 FROM (SELECT DISTINCT t FROM o))
SELECT doc_id, size, text_crc32, 'bytes' AS law, (len(list_filter(cuts, lambda c: c <= before)) - 1)::INTEGER AS shard, row_number() OVER (PARTITION BY len(list_filter(cuts, lambda c: c <= before)) ORDER BY row) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM o JOIN sums USING (t), final
"""


def _doubled() -> str:
    """Numbers of strings of 2, 4, .. 128 bytes that are equal just where the strings are, each from two of half its length."""
    out = ""
    for k in range(7):
        out += f"\n, b{k + 1} AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (ORDER BY x, y) AS x FROM (SELECT doc_id, i, x, lead(x, {2**k}) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM b{k}) WHERE y IS NOT NULL)"
    return out


OP6 = rf"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
b0 AS MATERIALIZED (SELECT doc_id, i, c AS x FROM (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS c, generate_subscripts(regexp_extract_all(h, '..'), 1) AS i FROM d)){_doubled()},
w AS MATERIALIZED (SELECT b.doc_id, b.i, b.x AS a, m.x AS m, e.x AS e FROM b7 b JOIN b6 m ON m.doc_id = b.doc_id AND m.i = b.i + 128 JOIN b3 e ON e.doc_id = b.doc_id AND e.i = b.i + 192),
twice AS MATERIALIZED (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY a, m, e) > 1),
gone AS (SELECT b.doc_id, b.i FROM b0 b ASOF JOIN twice t ON t.doc_id = b.doc_id AND t.i <= b.i WHERE b.i < t.i + 200),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (first) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM i - 1 AS first FROM gone) GROUP BY 1),
kept AS (SELECT b.doc_id, string_agg(b.x, '' ORDER BY b.i) AS h FROM b0 b ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256 FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _tree(name: str) -> str:
    """Levels of the trees whose leaves are in a table name0 (tree, pos, node), and where each ends."""
    return f"""{name}(tree, lvl, pos, node) AS (SELECT tree, 0, pos, node FROM {name}0
  UNION ALL SELECT tree, lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}) WHERE c > 1 GROUP BY tree, lvl, pos // 8),
{name}_top AS MATERIALIZED (SELECT tree, max(lvl) AS top, arg_max(node, lvl) AS node FROM {name} GROUP BY tree)"""


def _climb(name: str, start: str, tree: str) -> str:
    """From a table start (tree, place, pos, h, p) up the trees: h with the siblings as they were, p the siblings."""
    return f"""{name}(tree, place, lvl, pos, h, p) AS (SELECT tree, place, 0, pos, h, p FROM {start}
  UNION ALL SELECT f.tree, f.place, f.lvl + 1, f.pos // 8, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.node END, '' ORDER BY t.pos)), f.p || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '')
  FROM {name} f JOIN {tree} t ON t.tree = f.tree AND t.lvl = f.lvl AND t.pos // 8 = f.pos // 8 JOIN {tree}_top o ON o.tree = f.tree AND f.lvl < o.top GROUP BY f.tree, f.place, f.lvl, f.pos, f.h, f.p)"""


_FIELDS = "concat({})".format(", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")))
OP13 = f"""
WITH RECURSIVE ids AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(doc_id::VARCHAR), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a // 256, {_CRC}[xor(a % 256, b) + 1])), 4294967295) % 3 = 0 AS hit FROM (SELECT DISTINCT doc_id FROM documents)),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_FIELDS}) AS node, sha256({_FIELDS.replace("text", "new")}) AS altered
  FROM (SELECT d.*, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS new FROM documents d LEFT JOIN ids USING (doc_id))),
t0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node, altered) - 1 AS pos FROM d),
{_tree("t")},
u0 AS MATERIALIZED (SELECT '' AS tree, tree AS own, row_number() OVER (ORDER BY tree) - 1 AS pos, node FROM t_top),
{_tree("u")},
low AS (SELECT tree, pos AS place, pos, altered AS h, '' AS p FROM t0),
{_climb("f", "low", "t")},
high AS (SELECT '' AS tree, struct_pack(tree := f.tree, place := f.place) AS place, u0.pos, h, p FROM f JOIN t_top ON t_top.tree = f.tree AND f.lvl = t_top.top JOIN u0 ON u0.own = f.tree),
{_climb("g", "high", "u")}
SELECT doc_id, t0.node AS leaf, t_top.node AS subroot, u_top.node AS root, sha256(p) AS proof_sha256, h AS folded_root, h = u_top.node AS verified
FROM g JOIN u_top ON g.lvl = u_top.top JOIN t0 ON t0.tree = g.place.tree AND t0.pos = g.place.place JOIN t_top ON t_top.tree = t0.tree
"""
