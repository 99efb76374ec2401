"""DuckDB SQL with the rows of those queries that SQL can express on whole tables."""

#: SHA-1 in base 32: each of its 40 hex digits as four bits, then 32 groups of five bits.
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), "
    "lambda j: (substr(bits, (5 * k + j + 1)::INT, 1))::INT * (16 >> j::INT)))::INT, 1)), '')"
)

ORACLES = {
    "op1_warc_capture_index": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
  array_to_string(list_transform(string_split(sha1(html), ''), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', x) - 1) + 1, 4)), '') AS bits FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM h""",
    "op2_chat_formatting": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b') AS shown,
  replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'), chr(10), '\n') AS name FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(len(shown) + len(name) + 24)::BIGINT AS formatted_chars, 'turns' AS layout FROM e GROUP BY conv_id""",
    "op4_setsketch_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[k:k + 4] END, ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM reach JOIN both_ways ON a = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r USING (doc_id)""",
    "op5_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  (('0x' || substr(md5(concat_ws(chr(31), '17', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, source_size, source_size * 2.0 AS cap, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::INT]::DOUBLE AS w FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1)),
o AS (SELECT *, cap / w AS ratio, sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS below, sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w) AS open FROM s),
v AS (SELECT (( SELECT sum(source_size) FROM s) * 1.5 - below) / open AS level, ratio FROM o),
c AS (SELECT coalesce(arg_min(level, ratio) FILTER (ratio > level), max(ratio)) AS level FROM v),
t AS (SELECT source, source_size, least(cap, w * level) AS target FROM s, c),
x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN e > floor(e) AND 2 * sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (1 + least(size, 1000) / 1000::DOUBLE)) - size < 2 * (e - floor(e)) * source_size THEN 1 ELSE 0 END AS extra FROM x)
SELECT doc_id, size, source_size, target, (size * (floor(e) + extra))::BIGINT AS taken, source, (floor(e) + extra)::INT AS copies FROM y""",
}
