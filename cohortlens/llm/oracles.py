"""SQL that DuckDB runs on the same tables, for the operators that SQL can express."""

_HASH = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"
_BLANK = r"[^\x20\x09-\x0D]+"

# The whole order of each source by hash, where the operator refines histogram buckets.
MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_BLANK}')), 0) AS BIGINT) AS size,
         {_HASH.format("'mix:' || coalesce('v' || doc_id, 'n') || ':' || mark || ':' || copy")} AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, mark) - 1 AS copy FROM (SELECT *, md5(coalesce(text, '')) AS mark FROM documents))
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * total AS full_size FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY full_size / weight, place) AS k, CAST(sum(total) OVER () AS BIGINT) AS budget FROM w
), l AS (
  SELECT *, (CAST(budget AS DOUBLE) - CAST(coalesce((SELECT sum(p.full_size) FROM o AS p WHERE p.k < o.k), 0) AS DOUBLE))
            / CAST((SELECT sum(p.weight) FROM o AS p WHERE p.k >= o.k) AS DOUBLE) AS level
  FROM o
), t AS (
  SELECT source, total, CASE WHEN full_size / weight <= level THEN CAST(full_size AS DOUBLE)
    ELSE weight * (SELECT arg_min(m.level, m.k) FROM l AS m WHERE m.full_size / m.weight > m.level) END AS target
  FROM l
), g AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source, h
), r AS (
  SELECT source, h, n, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g
)
SELECT d.doc_id, d.size, t.total AS source_size, t.target,
       CAST(d.size * (CASE WHEN t.total > 0 THEN floor(t.target / t.total) + CASE
         WHEN (t.target - floor(t.target / t.total) * t.total) - r.before >= r.n / 2 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
"""

_SCORE = "-ln((" + _HASH.format("coalesce('v' || doc_id, 'n') || '#' || i") + " + 0.5) / 1152921504606846976.0)"

# The checksum goes through the text byte by byte, with the table that the polynomial EDB88320 (hex) gives.
SHARD = f"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b)
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), scored AS (
  SELECT doc_id, i, {_SCORE} AS score FROM (SELECT DISTINCT doc_id FROM d) AS k, range(41) AS r(i)
), best AS (
  SELECT doc_id, arg_min(i, score) FILTER (i < 40) AS shard, arg_min(i, score) AS grown_shard FROM scored GROUP BY doc_id
), j AS (
  SELECT d.doc_id, d.size, b.shard, b.grown_shard,
         xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT) FOR i IN range(strlen(bytes) // 2)]),
           lambda x, y: xor(x >> 8, t[xor(x, y) % 256 + 1])), 4294967295) AS crc, {_HASH.format("'slot:' || coalesce('v' || d.doc_id, 'n')")} AS h
  FROM d JOIN best AS b ON d.doc_id IS NOT DISTINCT FROM b.doc_id, tab
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
       CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, crc, size) - 1 AS slot
FROM j
"""

# Dialogues short enough for one part each, as in the test tables; longer ones are covered by the tests of the operator.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') AS body,
         replace(replace(replace(coalesce(role, ''), '\', '\\'), '<|', '<\|'), chr(10), '\n') AS name, coalesce(text, '') AS raw,
         turn // 256 AS block
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), x AS (
  SELECT t.*, p.perspective, t.role = p.perspective AS mine,
         '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = p.perspective THEN 'assistant'
           ELSE 'user name=' || name END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), y AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS whole,
         length(body) + 10 AS masked FROM x
), z AS (
  SELECT *, CAST(coalesce(sum(length(whole)) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, role, raw
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS begins FROM y
), g AS (
  SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(whole, '' ORDER BY turn NULLS FIRST, role, raw) AS rendered,
         CAST(sum(length(whole)) AS BIGINT) AS n_chars,
         coalesce(string_agg(begins || '-' || (begins + masked), ',' ORDER BY begins) FILTER (mine), '') AS mask,
         CAST(coalesce(sum(masked) FILTER (mine), 0) AS BIGINT) AS n_masked
  FROM z GROUP BY conv_id, perspective, block
)
SELECT conv_id, perspective, row_number() OVER w - 1 AS part, n_turns,
       CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY block NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       rendered, n_chars, mask, n_masked
FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY block NULLS FIRST)
"""

# Every prefix as a list, subtrees by the paths of their nodes' smallest members; the checksum as in SHARD. No turn number repeats in the test tables.
TRIE = """
WITH tab AS (
  SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b)
), own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS said
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT c, said, xor(list_reduce(list_prepend(4294967295, [CAST(unicode(substr(CAST(c AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS BIGINT)
           FOR i IN range(strlen(CAST(c AS VARCHAR)))]), lambda x, y: xor(x >> 8, t[xor(x, y) % 256 + 1])), 4294967295) % 6 AS h
  FROM own, tab
), whole AS (
  SELECT a.c, list_concat(coalesce(list_slice(b.said, 1, a.h), []), list_slice(a.said, a.h + 1, len(a.said))) AS seq
  FROM crc AS a LEFT JOIN own AS b ON b.c = a.c - a.c % 100
), m AS MATERIALIZED (
  SELECT c, d, len(seq) = d AS ends, md5(to_json(list_slice(seq, 1, d))) AS k, md5(to_json(list_slice(seq, 1, d - 1))) AS pk,
         CASE WHEN d > 0 THEN length(seq[d].text) ELSE 0 END AS n
  FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM whole)
), v AS MATERIALIZED (
  SELECT d, k, min(pk) AS pk, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * min(n) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends
  FROM m GROUP BY d, k
), kids AS (
  SELECT d - 1 AS d, pk AS k, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT m.d, m.k, sum(w.saved) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM v AS w JOIN m ON m.c = w.c AND m.d <= w.d LEFT JOIN kids ON kids.d = w.d AND kids.k = w.k GROUP BY m.d, m.k
)
SELECT v.c AS conv_id, v.d AS depth, p.c AS parent_conv_id, v.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN below ON below.d = v.d AND below.k = v.k LEFT JOIN kids ON kids.d = v.d AND kids.k = v.k
LEFT JOIN v AS p ON p.d = v.d - 1 AND p.k = v.pk AND v.d > 0
"""


def _codes(rounds: int = 4) -> str:
    """Each round as two steps: the nearest entry of every part, then the floor of the mean of every entry's parts."""
    square = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := {square}, e := e)) AS best FROM parts JOIN b{n} USING (p) GROUP BY vec_id, p
)""")
        if n < rounds:
            steps.append(f"""b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b{n} AS b LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS c FROM (
      SELECT p, best.e AS e, i, floor(sum(x[i + 1]) / count(*)) AS m FROM a{n}, range(1000000) AS r(i) WHERE i < len(x) GROUP BY ALL
    ) GROUP BY p, e
  ) AS u ON u.p = b.p AND u.e = b.e
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM kept, range(4) AS r(p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256
), {", ".join(steps)}, code AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM code JOIN kept USING (vec_id), digest
"""


CODES = _codes()

ORACLES = {
    "op5_hash_threshold_mix": MIX, "op8_rendezvous_shards": SHARD, "op6_perspective_rotation": CHAT, "op12_euler_trie": TRIE, "op13_anchor_codes": CODES,
}
