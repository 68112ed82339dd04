"""DuckDB SQL of the registered queries, where SQL can express them.

Fitted models, the tokenizers and the field have no SQL; the tests hold those queries against plain versions. The SQL states
its own constants.
"""

from __future__ import annotations

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), n AS (SELECT item, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS win
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM n)
), sizes AS (SELECT DISTINCT size FROM wins),
d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)
), m AS (SELECT a.doc_id, a.k, a.size, x.item FROM places a JOIN wins x ON a.win = x.win AND a.size = x.size),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT doc_id, k, size FROM m)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP5 = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), m AS (
  SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS same,
    regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS safe,
    regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS line
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN same THEN 11 ELSE 12 + length(line) + 1 + 11 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

_OP9 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, length(text) AS chars,
    md5(coalesce(text, '')) AS tie
  FROM documents
), k AS (
  SELECT doc_id, source, size, tie,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / coalesce(1.0::DOUBLE / (1.0::DOUBLE + abs(CAST(chars AS DOUBLE) / greatest(size, 1) - 6.0::DOUBLE)), 1.0::DOUBLE) AS key
  FROM d
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s
), w2 AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS most FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY most / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w2
), t AS (SELECT source, source_size, least(most, max(level) OVER () * w) AS target FROM l),
e AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT k.*, e.source_size, e.target, e.epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""

_OP4 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS same FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
  CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.same) END AS class_id, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = d.doc_id
"""

_OP12_START = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c FROM (
    SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 40)
)"""

_OP12_ROUND = """, a{n} AS MATERIALIZED (
  SELECT r, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT r, vec_id, v, cluster,
      CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v, c{n})
  GROUP BY r, vec_id, v
)"""

_OP12_MOVE = """, s{n} AS (
  SELECT cluster, k, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS k FROM a{n}) GROUP BY ALL
), c{m} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS m FROM s{n} GROUP BY cluster) USING (cluster)
)"""

_OP12 = (
    _OP12_START
    + "".join(_OP12_ROUND.format(n=n) + (_OP12_MOVE.format(n=n, m=n + 1) if n < 5 else "") for n in range(6))
    + """
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (cluster)
"""
)

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _levels(first: str, name: str, levels: int) -> str:
    """CTEs of the nodes of each level over ``first`` (grp, p, node), and of the siblings on each leaf's path."""
    out = [f", {name}0 AS MATERIALIZED (SELECT grp, p, node, count(*) OVER (PARTITION BY grp) AS n FROM {first})"]
    for k in range(levels):
        out.append(
            f", {name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM ("
            f"SELECT grp, p // 8 AS p, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY p)) END AS node"
            f" FROM {name}{k} GROUP BY grp, p // 8))"
            f", {name}side{k} AS MATERIALIZED (SELECT grp, p, n = 1 AS alone,"
            f" coalesce(string_agg(node, '' ) OVER (PARTITION BY grp, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(node, '') OVER (PARTITION BY grp, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
            f" FROM {name}{k})"
        )
    return "".join(out)


def _folded(source: str, name: str, levels: int, out: str) -> str:
    """CTEs that carry grp, p, node and proof of ``source`` up the levels."""
    parts, before = [], source
    for k in range(levels):
        parts.append(
            f", {out}{k} AS (SELECT s.* EXCLUDE (p, node, proof), s.p // 8 AS p,"
            f" CASE WHEN alone THEN s.node ELSE sha256(l || s.node || r) END AS node, s.proof || l || r AS proof"
            f" FROM {before} s JOIN {name}side{k} x ON x.grp = s.grp AND x.p = s.p)"
        )
        before = f"{out}{k}"
    return "".join(parts)


#: Levels of the trees of the languages and of that over them: 8 ** 8 documents of a language, 8 ** 3 languages.
_LEAF_LEVELS, _ROOT_LEVELS = 8, 3

_OP13 = f"""
WITH d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf(f"translate(text, {_UPPER})")} AS lower_leaf,
    list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(list_filter(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: c <> ''),
      lambda c: [256 + CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 256 THEN xor(crc, x - 256) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) AS crc
  FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, lang, coalesce('=' || lang, '-') AS grp, leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN lower_leaf ELSE leaf END AS start,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p
  FROM d
), base AS (SELECT grp, p, leaf AS node FROM leaves)
{_levels("base", "t", _LEAF_LEVELS)}
, langs AS (SELECT '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS p, grp AS lang, node FROM t{_LEAF_LEVELS})
, base2 AS (SELECT grp, p, node FROM langs)
{_levels("base2", "u", _ROOT_LEVELS)}
, go AS (SELECT doc_id, leaf, grp, p, start AS node, '' AS proof FROM leaves)
{_folded("go", "t", _LEAF_LEVELS, "up")}
, over AS (
  SELECT x.doc_id, x.leaf, s.node AS subroot, '' AS grp, g.p, x.node, x.proof FROM up{_LEAF_LEVELS - 1} x
  JOIN t{_LEAF_LEVELS} s ON s.grp = x.grp JOIN langs g ON g.lang = x.grp)
{_folded("over", "u", _ROOT_LEVELS, "top")}
SELECT x.doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, x.node AS folded_root, x.node = r.node AS verified
FROM top{_ROOT_LEVELS - 1} x, u{_ROOT_LEVELS} r
"""

ORACLE_SQL: dict[str, str] = {
    "op2_mtree_top_k": _OP2,
    "op3_decontaminate": _OP3,
    "op4_ngram_jaccard": _OP4,
    "op5_chat_format": _OP5,
    "op9_mixing": _OP9,
    "op12_clusters": _OP12,
    "op13_merkle": _OP13,
}
