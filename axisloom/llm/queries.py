"""The operators over the test tables, with production parameters, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_quality_trees")
def op1(spark, sf):
    from .quality import quality_scores

    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_rule_forest")
def op3(spark, sf):
    from .rules import rule_verdicts

    return rule_verdicts(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_license_scan")
def op6(spark, sf):
    from .licenses import license_scan

    return license_scan(table(spark, sf, "documents"))


@query("op7_token_records")
def op7(spark, sf):
    from .records import token_records

    return token_records(spark, table(spark, sf, "documents"), tokenizer_path()).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


OP10_SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM benchmark),
starts AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
found AS (
  SELECT s.doc_id, s.i, s.n, item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM spots) s
  JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op10_benchmark_suffixes", OP10_SQL)
def op10(spark, sf):
    from .decontaminate import benchmark_hits

    found = benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS digest,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM by_source),
filled AS (
  SELECT *, 3 * source_size AS cap,
         row_number() OVER o AS place,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM weighed WINDOW o AS (ORDER BY 3.0 * source_size / weight, rank)),
fill AS (SELECT words AS w0, weights AS k0 FROM filled WHERE weight * words <= cap * weights ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN weight * words > cap * weights THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * w0 AS DOUBLE) / CAST(k0 AS DOUBLE) END AS target FROM filled, fill),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS wanted,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY digest, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS p FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(p * size + greatest(0, least(size, wanted - p * source_size - before)) AS BIGINT) AS taken
FROM passes"""


@query("op2_mix_sources", OP2_SQL)
def op2(spark, sf):
    from .mixing import mix_report

    return mix_report(table(spark, sf, "documents"))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before
  FROM words, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
ones AS (SELECT word, count(*) AS c FROM tokens GROUP BY word),
twos AS (SELECT before, word, count(*) AS c FROM tokens WHERE before IS NOT NULL GROUP BY before, word),
everything AS (SELECT count(*) AS n FROM tokens),
scored AS (
  SELECT t.doc_id, t.before IS NOT NULL AND two.c < 2 AS backed,
         CASE WHEN two.c >= 2 THEN ln(two.c) - ln(b.c)
              ELSE ln(o.c) - ln(n) + CASE WHEN t.before IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM tokens t JOIN ones o ON o.word = t.word CROSS JOIN everything
  LEFT JOIN twos two ON two.before = t.before AND two.word = t.word
  LEFT JOIN ones b ON b.word = t.before)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words,
       CAST(coalesce(sum(CAST(s.backed AS INTEGER)), 0) AS BIGINT) AS n_backed_off,
       round(coalesce(sum(s.s), 0), 5) + 0.0 AS log_score, round(avg(s.s), 6) + 0.0 AS score
FROM words d LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op5_backoff_scores", OP5_SQL)
def op5(spark, sf):
    from .lm import backoff_scores

    scored = backoff_scores(table(spark, sf, "documents"))
    rounded = lambda c, digits: (F.round(c, digits) + F.lit(0.0)).alias(c)
    return scored.select("doc_id", "n_words", "n_backed_off", rounded("log_score", 5), rounded("score", 6))


OP9_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON b.s = a.s AND b.doc_id <> a.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM docs UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(v) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN reach r ON r.u = d.doc_id GROUP BY d.doc_id"""


@query("op9_shingle_join", OP9_SQL)
def op9(spark, sf):
    from .ngram_join import near_copy_groups

    # the SQL states the groups
    return near_copy_groups(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM spots),
firsts AS (SELECT g, min(doc_id) AS owner FROM windows GROUP BY g HAVING count(DISTINCT doc_id) > 1),
late AS (SELECT doc_id, i FROM windows JOIN firsts USING (g) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM late),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)"""


@query("op4_repeat_trees", OP4_SQL)
def op4(spark, sf):
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH pages_ AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'),
           '<script\b[^>]*>.*?</script\s*>', '', 'gsi'), '<style\b[^>]*>.*?</style\s*>', '', 'gsi'),
           '</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|body|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'gi'),
           '<[^>]*>', '', 'g') AS visible FROM pages),
lined AS (
  SELECT page_id, url, host, list_filter(list_transform(string_split(visible, chr(10)),
         lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM pages_),
totals AS (SELECT host, count(*) AS n FROM lined GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS c FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY host, line HAVING count(*) >= 3),
bad AS (SELECT c.host, list(line) AS drop_ FROM counts c JOIN totals t ON t.host = c.host WHERE c.c >= t.n * 0.1 GROUP BY c.host),
kept AS (
  SELECT page_id, url, l.host, CAST(len(lines) AS BIGINT) AS n_lines,
         list_filter(lines, lambda x: NOT list_contains(coalesce(drop_, []), x)) AS k
  FROM lined l LEFT JOIN bad b ON b.host = l.host)
SELECT page_id, url, host, n_lines, CAST(n_lines - len(k) AS BIGINT) AS n_dropped, array_to_string(k, chr(10)) AS text FROM kept"""


@query("op8_site_lines", OP8_SQL)
def op8(spark, sf):
    from .lines import drop_boilerplate

    return drop_boilerplate(table(spark, sf, "pages"))


OP11_SQL = r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS (
  SELECT vec_id, label, p, x[1 + p * len(x) // 16 : (p + 1) * len(x) // 16] AS x
  FROM (SELECT *, unnest(range(16)) AS p FROM kept)),
book0 AS (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e FROM parts) WHERE e < 64),
{rounds}
final AS (
  SELECT vec_id, label, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT a.vec_id, a.label, a.p, b.e, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts a JOIN book2 b ON b.p = a.p) GROUP BY vec_id, label, p),
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM final GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS s FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded, books""".replace(
    "{rounds}",
    "".join(
        f"""
near{r} AS (
  SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := d, e := e)).e AS e FROM (
    SELECT a.vec_id, a.p, a.x, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts a JOIN book{r - 1} b ON b.p = a.p) GROUP BY vec_id, p),
means{r} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{r}) GROUP BY p, e, i)
  GROUP BY p, e),
book{r} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r - 1} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e),"""
        for r in (1, 2)
    ),
)


@query("op11_vector_pivots", OP11_SQL)
def op11(spark, sf):
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(range(0, 256)) AS b)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY 1, 2),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
         lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END)) AS b FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(b, lambda s, x: xor(t[1 + xor(s % 256, x)], s // 256), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM bytes, crc_table),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
spots AS (SELECT word, n, unnest(range(0, len(word))) AS i FROM words),
holes AS (SELECT word, n, word[1:i] AS a, word[i + 2:] AS z FROM spots),
pairs AS (
  SELECT x.word AS u, y.word AS v, y.n AS m FROM holes x JOIN holes y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.a || h.z
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.a || h.z),
near AS (SELECT u, count(*) AS n_near, min(struct_pack(m := -m, v := v)) AS best FROM pairs GROUP BY u),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.v END AS form,
         CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM words LEFT JOIN near ON u = word),
follow AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT f.word, w.form FROM follow f JOIN formed w ON w.word = f.at WHERE w.form IS NOT NULL),
roots AS (SELECT f.word, f.at AS root FROM follow f JOIN formed w ON w.word = f.at WHERE w.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark, sf):
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
  (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+'),
  (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) AS k(k, kind, pattern)),
cut AS (SELECT r, text, k, kind, regexp_extract_all(text, pattern) AS m, regexp_split_to_array(text, pattern) AS g FROM docs, kinds),
placed AS (
  SELECT r, text, k, kind, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut WHERE len(m) > 0)),
digits AS (SELECT *, s + len(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM placed),
base AS (
  SELECT r, text, k, kind, s, e, kind || ':' || CASE k WHEN 1 THEN lower(v) WHEN 2 THEN v ELSE d END AS entity FROM digits
  WHERE k = 1
     OR k = 2 AND len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3 OR CAST(CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE left(ltrim(x, '0'), 4) END AS INTEGER) > 255)) = 0
     OR k = 3 AND len(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, len(d)), lambda i:
          CASE WHEN i % 2 = 0 THEN CAST(d[len(d) - i] AS INTEGER) WHEN CAST(d[len(d) - i] AS INTEGER) > 4 THEN CAST(d[len(d) - i] AS INTEGER) * 2 - 9 ELSE CAST(d[len(d) - i] AS INTEGER) * 2 END)) % 10 = 0
     OR k = 4 AND len(d) BETWEEN 8 AND 15),
sides AS (
  SELECT *, greatest(0, lag(e, 1, 0) OVER o, lag(e, 2, 0) OVER o, lag(e, 3, 0) OVER o) AS b, lead(s, 1, len(text)) OVER o AS f, row_number() OVER (ORDER BY r, s, e, entity) AS mention
  FROM base WINDOW o AS (PARTITION BY r ORDER BY s, e, entity)),
gaps AS (
  SELECT r, entity, mention, false AS after, b AS base, text[b + 1:s] AS gap FROM sides WHERE s > b
  UNION ALL SELECT r, entity, mention, true, e, text[e + 1:f] FROM sides WHERE f > e),
worded AS (
  SELECT *, regexp_extract_all(gap, '[\p{L}\p{N}]+') AS w, regexp_split_to_array(gap, '[\p{L}\p{N}]+') AS g FROM gaps),
near AS (
  SELECT r, entity, mention, after, i, lower(w[i]) AS term, CAST(base + list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s, len(w[i]) AS n, w[i] AS word
  FROM (SELECT *, unnest(CASE WHEN after THEN range(1, least(8, len(w)) + 1) ELSE range(greatest(1, len(w) - 7), len(w) + 1) END) AS i FROM worded WHERE len(w) > 0)),
terms AS (SELECT * FROM near WHERE n >= 3 AND regexp_matches(word, '\p{L}')),
context AS (SELECT mention, string_agg(term, ' ' ORDER BY s) AS c FROM terms GROUP BY mention),
pairs AS (
  SELECT entity, term, count(DISTINCT r) AS c_te FROM terms JOIN context USING (mention) GROUP BY entity, term HAVING count(DISTINCT c) >= 3),
words AS (SELECT r, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM docs),
c_t AS (SELECT term, count(*) AS c_t FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY term),
c_e AS (SELECT entity, count(DISTINCT r) AS c_e FROM base GROUP BY entity),
told AS (
  SELECT entity, term FROM pairs JOIN c_t USING (term) JOIN c_e USING (entity), (SELECT count(*) AS n FROM docs)
  WHERE c_e < n AND 1 - ln(c_t / c_te) / ln(n / c_e) >= 0.7),
spans AS (
  SELECT r, k, s, kind || ':' || s || ':' || e AS span FROM base
  UNION SELECT r, 5, s, 'term:' || s || ':' || (s + n) FROM terms JOIN told USING (entity, term)),
report AS (
  SELECT r, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
         string_agg(span, ',' ORDER BY k, s) FILTER (k < 5) AS base, string_agg(span, ',' ORDER BY k, s) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN report USING (r)"""


@query("op12_private_terms", OP12_SQL)
def op12(spark, sf):
    from .privacy import span_report

    return span_report(table(spark, sf, "documents"))
