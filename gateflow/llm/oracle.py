"""DuckDB texts of the queries that SQL can express."""

OP4 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN b >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
size AS (SELECT DISTINCT least(10, len(w)) AS m FROM i WHERE len(w) > 0),
phrase AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)
),
place AS (
  SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, size WHERE len(w) >= m)
),
hit AS (SELECT doc_id, m, p, item FROM place JOIN phrase USING (k)),
word AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items,
       sha256(coalesce(own.items, '')) AS items_sha256, word.n IS NOT NULL AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
),
link AS (
  SELECT x, y FROM shared JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
  WHERE 100 * m >= 75 * (nx.n + ny.n - m)
),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(node, root) AS (
  SELECT x, x FROM edge
  UNION SELECT e.y, r.root FROM reach AS r JOIN edge AS e ON e.x = r.node
),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.root, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.node = d.doc_id
"""

#: Levels that the text below has: as many as 16**6 leaves a source and 16**3 sources need.
_LEAF_LEVELS, _SOURCE_LEVELS = 6, 3


def _tree(name: str, key: str, levels: int) -> str:
    """CTEs {name}1.. of nodes above {name}0 (key, i, n, h), and {name}0s.. with the
    siblings of each node in its run of 16."""
    out = []
    for k in range(levels):
        side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY {key}, i // 16 ORDER BY i ROWS BETWEEN {frame}), '')"
        out.append(
            f"""{name}{k}s AS (
  SELECT {key}, i, n, h, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k}
),
{name}{k + 1} AS (
  SELECT {key}, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
  FROM {name}{k} GROUP BY {key}, i // 16, n
)"""
        )
    return ",\n".join(out)


def _fold(name: str, key: str, place: str, levels: int, before: str, after: str) -> str:
    """CTEs that carry proof, digest and number of copies of each leaf up the levels."""
    out, last = [], before
    for k in range(levels):
        out.append(
            f"""{after}{k} AS (
  SELECT f.* REPLACE (
    CASE WHEN t.n > 1 THEN f.proof || t.l || t.r ELSE f.proof END AS proof,
    CASE WHEN t.n > 1 THEN sha256(t.l || f.d || t.r) ELSE f.d END AS d,
    f.c + CAST(t.n > 1 AS INT) AS c)
  FROM {last} AS f JOIN {name}{k}s AS t ON t.{key} IS NOT DISTINCT FROM f.{key} AND t.i = f.{place} // {16**k}
)"""
        )
        last = f"{after}{k}"
    return ",\n".join(out)


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


OP12 = f"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
),
d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295), 4294967295) % 5 = 0
    THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents, crc
),
leaves AS (
  SELECT doc_id, source, leaf, '' AS proof, coalesce(other, leaf) AS d, 0 AS c,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM d
),
a0 AS (SELECT source, place AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM leaves),
{_tree('a', 'source', _LEAF_LEVELS)},
b0 AS (SELECT '' AS whole, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM a{_LEAF_LEVELS}),
{_tree('b', 'whole', _SOURCE_LEVELS)},
{_fold('a', 'source', 'place', _LEAF_LEVELS, 'leaves', 'up')},
tops AS (
  SELECT f.doc_id, f.leaf, f.proof, f.d, f.c, '' AS whole, s.i AS own, s.h AS subroot
  FROM up{_LEAF_LEVELS - 1} AS f JOIN b0 AS s ON s.source IS NOT DISTINCT FROM f.source
),
{_fold('b', 'whole', 'own', _SOURCE_LEVELS, 'tops', 'top')}
SELECT doc_id, leaf, subroot, (SELECT h FROM b{_SOURCE_LEVELS}) AS root, sha256(proof) AS proof_sha256, d AS folded_root,
  d = (SELECT h FROM b{_SOURCE_LEVELS}) AS verified, greatest(c, 1) AS copies
FROM top{_SOURCE_LEVELS - 1}
"""

OP13 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a, r AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""

ORACLE = {"op4_exact_dedup": OP4, "op5_warc": OP5, "op8_decontaminate": OP8, "op10_ngram_join": OP10, "op12_merkle": OP12, "op13_hard_negatives": OP13}
