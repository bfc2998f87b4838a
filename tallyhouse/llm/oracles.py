"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# Words as the operators cut them, and A-Z folded without touching other letters.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

STATEMENTS = {
    "op1_near_dedup": f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, coalesce({WORDS.format(FOLDED)}, []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2
    THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g
  FROM cut),
members AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x
    AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS root FROM sets
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(root) AS component_id,
  s.doc_id = min(root) AS kept
FROM sets s JOIN reach USING (doc_id) GROUP BY s.doc_id, s.g""",
    "op6_substring_dedup": f"""
WITH cut AS (
  SELECT doc_id, coalesce({WORDS.format("text")}, []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM cut),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS x FROM starts),
firsts AS (SELECT x, min(doc_id) AS first_doc FROM windows GROUP BY x),
hit AS (
  SELECT doc_id, list(i) AS begins FROM windows JOIN firsts USING (x)
  WHERE first_doc < doc_id GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, s + o AS i
  FROM (SELECT doc_id, unnest(begins) AS s FROM hit), (SELECT unnest(range(13)) AS o)),
words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM cut),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)""",
    # Every alignment of an item in a document that shares enough words, without any seed.
    "op10_decontamination": r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
b AS (
  SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS j
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)
  WHERE len(w) >= 5),
same AS (
  SELECT doc_id, item_id, n, i - j AS shift, list(j) AS js, count(*) AS matched
  FROM d JOIN b USING (x) GROUP BY doc_id, item_id, n, i - j
  HAVING count(*) >= least(n, 11)),
held AS (
  SELECT * FROM same WHERE len(list_filter(range(n - least(n, 13) + 1), lambda s:
    len(list_filter(js, lambda j: j >= s AND j < s + least(n, 13)))
      >= CASE WHEN n < 13 THEN n ELSE 11 END)) > 0)
SELECT doc_id, item_id, CAST(arg_max(shift, matched * 1000000000 - shift) AS BIGINT) AS start,
  CAST(max(matched) AS BIGINT) AS n_matched, CAST(max(n) AS BIGINT) AS n_item_words
FROM held GROUP BY doc_id, item_id""",
    # The same programme over all pairs of lengths, layer by layer; every bucket is one shard
    # below 100,000 texts.
    "op5_packing": f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(len({WORDS.format("text")}), 0) AS t FROM documents),
h AS (SELECT t AS size, count(*) AS c FROM sized WHERE t > 0 GROUP BY t),
p AS (
  SELECT row_number() OVER (ORDER BY size) AS m, size,
    CAST(sum(c) OVER (ORDER BY size) AS BIGINT) AS num,
    CAST(sum(c * size) OVER (ORDER BY size) AS BIGINT) AS tok FROM h),
dp AS (
  SELECT 1 AS layer, m, size * num - tok AS cost, CAST(0 AS BIGINT) AS split FROM p
  UNION ALL
  SELECT layer, m, best.c, best.m FROM (
    SELECT dp.layer + 1 AS layer, q.m, min(struct_pack(
      c := dp.cost + q.size * (q.num - i.num) - (q.tok - i.tok), m := dp.m)) AS best
    FROM dp JOIN p i ON i.m = dp.m JOIN p q ON q.m > dp.m WHERE dp.layer < 16
    GROUP BY dp.layer, q.m)),
used AS (
  SELECT layer, m FROM dp WHERE m = (SELECT max(m) FROM p) ORDER BY cost, layer LIMIT 1),
back AS (
  SELECT dp.layer, dp.m, dp.split FROM dp JOIN used USING (layer, m)
  UNION ALL
  SELECT dp.layer, dp.m, dp.split FROM back JOIN dp
    ON dp.layer = back.layer - 1 AND dp.m = back.split),
bounds AS (
  SELECT CAST(row_number() OVER (ORDER BY size) - 1 AS INTEGER) AS bucket,
    CAST(size AS BIGINT) AS padded_to FROM back JOIN p USING (m)),
placed AS (
  SELECT doc_id, t, (SELECT min(bucket) FROM bounds WHERE padded_to >= t) AS bucket FROM sized),
numbered AS (
  SELECT doc_id, t, bucket, padded_to, (row_number() OVER (
    PARTITION BY bucket ORDER BY t, doc_id) - 1) // greatest(1, 32768 // padded_to) AS number
  FROM placed JOIN bounds USING (bucket) WHERE t > 0)
SELECT doc_id, CAST(t AS BIGINT) AS n_tokens, bucket, padded_to,
  bucket || '-0-' || number AS batch,
  count(*) OVER (PARTITION BY bucket, number) AS n_in_batch, padded_to - t AS n_padding
FROM numbered
UNION ALL
SELECT doc_id, 0, NULL, NULL, NULL, NULL, 0 FROM sized WHERE t = 0""",
    "op8_web_archive": """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest,
    CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM p JOIN f USING (digest)""",
}

FILTER_AUDIT = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    {WORDS.format("coalesce(text, '')")} AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_doc FROM texts GROUP BY t),
known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT doc_id, part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
    WHEN 'A' THEN len(w) < 100
    WHEN 'B' THEN 100 * len(list_distinct(w)) < 80 * len(w)
    WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)
    WHEN 'D' THEN regexp_matches(t, '[#$%&*|]')
    ELSE doc_id > first_doc END) AS fails
  FROM texts JOIN firsts USING (t)),
groups AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, fails),
parts AS (SELECT DISTINCT part FROM groups),
orders AS (
  SELECT '' AS o
  UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
steps AS (
  SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS f,
    string_split(CASE WHEN s = 1 THEN '-' ELSE substr(o, 1, s - 1) END, '') AS before
  FROM (SELECT o FROM orders WHERE length(o) = 5), range(1, 6) r(s)),
rows AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, f)), 0) AS kept,
    coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, f)), 0) AS removed,
    coalesce(sum(n) FILTER (list_has_any(fails, before) AND list_contains(fails, f)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = [f]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, f)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, f)), 0) AS toxic_lost
  FROM groups, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows"""
STATEMENTS["op11_filter_audit"] = FILTER_AUDIT


def _vector_codes(rounds: int = 4) -> str:
    """Four chained rounds of assignment and means, then the last assignment."""
    nearest = """near{r} AS MATERIALIZED (
  SELECT vec_id, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, p.x, b.entry,
      list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM cut p JOIN book{r} b USING (part)) GROUP BY vec_id, part, x)"""
    moved = """book{s} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY i) AS c FROM (
      SELECT part, entry, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*)
        AS BIGINT) AS v
      FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{r})
      GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))"""
    steps = [s for r in range(rounds) for s in (nearest.format(r=r), moved.format(r=r, s=r + 1))]
    steps.append(nearest.format(r=rounds))
    return """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(1024 * v) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, part, q[part * len(q) // 4 + 1 : (part + 1) * len(q) // 4] AS x
  FROM kept, range(4) t(part)),
book0 AS MATERIALIZED (
  SELECT part, entry, x AS c FROM cut JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id)
  WHERE entry < 256),
""" + ",\n".join(steps) + """,
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM book{r}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
    CAST(sum(d) AS BIGINT) AS error FROM near{r} GROUP BY vec_id)
SELECT vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest""".format(r=rounds)


STATEMENTS["op12_vector_codes"] = _vector_codes()
