"""SQL for the queries whose rows it can express, on the whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES["op6_substring_dedup"] = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
     places AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, words FROM docs),
     starts AS (SELECT r, i, words[i] AS word, CASE WHEN i + 34 <= len(words) THEN md5(array_to_string(words[i:i + 34], ' ')) END AS w FROM places),
     again AS (SELECT *, CAST(w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS INTEGER) AS hit FROM starts),
     judged AS (SELECT *, sum(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM again),
     kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest FROM judged GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

ORACLES["op7_suffix_array_dedup"] = """
WITH docs AS MATERIALIZED (
       SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
     places AS (SELECT r, k, unnest(range(1, len(h) // 2 + 1)) AS i, unnest(regexp_extract_all(h, '..')) AS byte FROM docs),
     starts AS (
       SELECT r, k, i, byte, CASE WHEN count(*) OVER ahead = 50 THEN string_agg(byte, '') OVER ahead END AS w
       FROM places WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
     first AS (SELECT w, min(k) AS least FROM starts WHERE w IS NOT NULL GROUP BY w),
     hits AS (SELECT r, i, byte, CAST(coalesce(least < k, FALSE) AS INTEGER) AS hit FROM starts LEFT JOIN first USING (w)),
     judged AS (SELECT *, sum(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM hits),
     edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), FALSE) AS begins FROM judged),
     kept AS (
       SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS rest
       FROM edges GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def _clusters(k: int, rounds: int, size: int, scale: int, seed: int) -> str:
    """k-means with a common table per round; centroids are rows (number, vector)."""
    near = """
     SELECT r, min_by(c, (d, c)) AS c, min(d) AS d
     FROM (SELECT v.r, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM vectors v CROSS JOIN {0} m)
     GROUP BY r"""
    parts = [f"""
WITH raw AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {size}),
vectors AS (
  SELECT r, vec_id, list_transform(e, lambda x: CAST(floor({scale} * x) AS BIGINT)) AS x FROM raw
  WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
  FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM vectors ORDER BY 1, 2 LIMIT {k}))"""]
    for n in range(rounds):
        parts.append(f""",
a{n} AS MATERIALIZED ({near.format(f'c{n}')}),
s{n} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT a.c, v.x, unnest(range(1, {size + 1})) AS i FROM a{n} a JOIN vectors v USING (r)) GROUP BY c, i),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN m{n} m USING (c))""")
    parts.append(f""",
last AS MATERIALIZED ({near.format(f'c{rounds}')})
SELECT v.vec_id, CAST(l.c AS INTEGER) AS cluster, l.d AS distance, CAST(sum(l.d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(l.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM last l JOIN vectors v USING (r) JOIN c{rounds} m USING (c)
""")
    return "".join(parts)


ORACLES["op11_centroid_clustering"] = _clusters(8, 10, 64, 1024, 3)

ORACLES["op12_fill_in_middle"] = r"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM given),
cut AS (
  SELECT doc_id, n, t, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM cut
"""

ORACLES["op13_benchmark_decontamination"] = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
sized AS (SELECT item, words, CAST(least(len(words), 10) AS INTEGER) AS k FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS w FROM (SELECT item, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM sized)),
places AS (
  SELECT r, i, k, array_to_string(words[i:i + k - 1], ' ') AS w
  FROM (SELECT d.r, d.words, s.k, unnest(range(1, len(d.words) - s.k + 2)) AS i FROM docs d CROSS JOIN (SELECT DISTINCT k FROM windows) s WHERE len(d.words) >= s.k)),
hits AS (SELECT r, i, p.k, item FROM places p JOIN windows USING (w)),
found AS (
  SELECT r, len(list_distinct(flatten(list(range(i, i + k))))) AS n_hit, count(DISTINCT item) AS n_items,
         array_to_string(list_sort(list_distinct(list(item))), ',') AS named
  FROM hits GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN found USING (r)
"""
