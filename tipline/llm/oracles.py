"""DuckDB SQL for the queries that SQL can express."""

SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: Sources in code-point order weigh 3, 1, 2 in turn; {documents} is the table to mix.
MIX = rf"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS k, CAST({SIZE} AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
  FROM {{documents}}),
src AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY k),
weighted AS (
  SELECT k, source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2.0 AS DOUBLE) AS most,
         sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS all_words
  FROM src),
levels AS (
  SELECT *, (all_words - coalesce(sum(most) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM weighted),
target AS (
  SELECT k, source_size, CASE WHEN most / w <= level THEN most ELSE w * (max(CASE WHEN most / w > level THEN level END) OVER ()) END AS target FROM levels),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM target),
summed AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.epochs, greatest(0.0, t.target - t.epochs * t.source_size) AS budget,
         sum(b.size) OVER (PARTITION BY b.k ORDER BY b.place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, b.size AS own
  FROM base b JOIN budget t USING (k))
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (epochs + CASE WHEN upto <= budget OR (upto - own <= budget AND 2 * (budget - (upto - own)) >= own AND own > 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""

EXACT = r"""
WITH norm AS (
  SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS rn,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM norm)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM ranked
"""

#: Common table expressions that end in cleaned(doc_id, text, n_lines, n_dropped); ids of {documents} are distinct.
LINES = r"""
split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {documents}),
numbered AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM split),
worded AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(regexp_replace(lower(line), '([\p{{Han}}\p{{Hiragana}}\x{{30FC}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}\p{{Tibetan}}])', ' \1 ', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM numbered),
occ AS (SELECT doc_id, line_no, words, array_to_string(words, ' ') AS norm, len(words) AS n FROM worded WHERE len(words) >= 1),
firsts AS (SELECT norm, any_value(words) AS words, any_value(n) AS n, min({{'d': doc_id, 'l': line_no}}) AS first FROM occ GROUP BY norm),
spots AS (SELECT norm, words, n, first, unnest(range(1, n + 2)) AS i FROM firsts WHERE n >= 10),
variants AS (
  SELECT norm, first, i, array_to_string(words[1:i-1], ' ') AS before, array_to_string(words[i+1:n], ' ') AS after FROM spots WHERE i <= n
  UNION ALL
  SELECT norm, first, i, array_to_string(words[1:i-1], ' ') AS before, array_to_string(words[i:n], ' ') AS after FROM spots),
heads AS (SELECT norm, first, min(first) OVER (PARTITION BY i, before, after) AS head FROM variants),
near AS (SELECT DISTINCT norm FROM heads WHERE first > head),
gone AS (
  SELECT o.doc_id, list(o.line_no) AS lines FROM occ o JOIN firsts f USING (norm) LEFT JOIN near x USING (norm)
  WHERE x.norm IS NOT NULL OR {{'d': o.doc_id, 'l': o.line_no}} > f.first GROUP BY o.doc_id),
cleaned AS (
  SELECT s.doc_id, CASE WHEN g.lines IS NULL THEN array_to_string(s.parts, chr(10))
         ELSE coalesce(array_to_string([s.parts[k + 1] for k in range(len(s.parts)) if NOT list_contains(g.lines, k)], chr(10)), '') END AS text,
         CAST(coalesce(len(s.parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.lines), 0) AS BIGINT) AS n_dropped
  FROM split s LEFT JOIN gone g USING (doc_id))
"""

#: Shingle sets as lists, links by counting shared shingles, components by recursion. {documents} as before.
JACCARD = r"""
toks AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM toks),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
inverted AS (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM inverted a JOIN inverted b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sized UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
"""

def _hashed(k: int) -> str:
    return f"CAST('0x' || substr(d, {1 + 8 * (k - 1)}, 8) AS BIGINT) AS h{k}"


#: Units as a list; the three parts are runs of it.
MIDDLE = rf"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents),
hashed AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {", ".join(map(_hashed, (1, 2, 3, 4)))} FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a+1:b], ''), '') AS m, coalesce(array_to_string(u[b+1:n], ''), '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""

def _codes(rounds: int = 4, entries: int = 256) -> str:
    """Every round as two tables: the nearest entry of every part, and the codebooks after it."""
    near = """
near{r} AS MATERIALIZED (
  SELECT t.vec_id, t.label, t.p, t.part, min({{'d': CAST(list_sum(list_transform(list_zip(t.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': b.e}}) AS best
  FROM parts t JOIN book{r} b USING (p) GROUP BY ALL)"""
    book = """
book{n} AS MATERIALIZED (
  WITH cells AS (SELECT p, best.e AS e, unnest(part) AS x, unnest(range(len(part))) AS i FROM near{r}),
  means AS (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM cells GROUP BY p, e, i),
  moved AS (SELECT p, e, list(m ORDER BY i) AS part FROM means GROUP BY p, e)
  SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM book{r} b LEFT JOIN moved m USING (p, e))"""
    steps = [x for r in range(rounds) for x in (near.format(r=r), book.format(r=r, n=r + 1))]
    return f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS part FROM kept, (SELECT unnest(range(4)) AS p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part FROM parts QUALIFY e < {entries}),
{",".join(steps)},
{near.format(r=rounds)},
errors AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM errors
"""


ORACLES = {
    "op3_mix_sources": MIX.format(documents="documents"),
    "op5_ngram_jaccard_join": f"WITH RECURSIVE {JACCARD.format(documents='documents')} SELECT s.doc_id, s.n AS n_shingles, (SELECT min(y) FROM reach WHERE x = s.doc_id) AS component_id FROM sized s",
    "op7_exact_dedup": EXACT,
    "op9_line_dedup": f"WITH {LINES.format(documents='documents')} SELECT doc_id, text, n_lines, n_dropped FROM cleaned",
    "op11_vector_codes": _codes(),
    "op12_fill_in_middle": MIDDLE,
}
