"""The registered queries of this subpackage over the given tables, and SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(configure(spark), sf_dir.rstrip("/"))

        QUERIES[query.__name__] = run
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: The sizes and targets of the mix and each document's place, in DuckDB's SQL.
MIX_SQL = r"""
WITH units AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15) AS h FROM {documents}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM units GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sizes),
level AS (
  SELECT *, source_size / w AS stop,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::BIGINT AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS open
  FROM weighed WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT rest, open FROM level WHERE rest * w <= 3 * source_size * open ORDER BY stop, source NULLS LAST LIMIT 1),
aims AS (
  SELECT l.source, l.source_size, l.w,
    CASE WHEN f.open IS NULL THEN 3.0::DOUBLE * l.source_size ELSE least(3.0::DOUBLE * l.source_size, (l.w * f.rest)::DOUBLE / f.open) END AS target
  FROM level l LEFT JOIN first f ON true),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM aims),
hashes AS (SELECT source, h, sum(size)::BIGINT AS size FROM units GROUP BY source, h),
running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
more AS (
  SELECT r.source, r.h, p.target - p.copies * p.source_size AS budget,
    r.upto <= p.target - p.copies * p.source_size AS fits,
    r.upto - r.size <= p.target - p.copies * p.source_size
      AND p.target - p.copies * p.source_size - (r.upto - r.size) >= r.size / 2 AS near
  FROM running r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
mixed AS (
  SELECT u.doc_id, u.source, u.size, u.h, p.source_size, p.target,
    (u.size * (p.copies + CASE WHEN m.budget > 0 AND (m.fits OR m.near) THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM units u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source
  JOIN more m ON u.source IS NOT DISTINCT FROM m.source AND u.h = m.h)
"""


@register(MIX_SQL.format(documents="documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed")
def op5_mix_sources(spark, sf_dir):
    from .mixing import mix

    return mix(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@register()
def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers as tokenizers

    from .bpe_replay import digests

    rows = digests(documents(spark, sf_dir), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return rows.withColumnRenamed("id", "doc_id")


@register()
def op6_secret_scan(spark, sf_dir):
    from .secrets import BASE_KINDS, secrets, written

    found = secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *map(count, BASE_KINDS),
                        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


#: Windows of any number of lines of a table (doc_id, text) and the lines that later copies cover, in DuckDB's SQL.
LINES_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM {documents}),
windows AS (
  SELECT 1::BIGINT AS n, doc_id, pos, md5(line) AS k, length(line)::BIGINT AS chars FROM lines
  UNION ALL
  SELECT a.n + 1, a.doc_id, a.pos, md5(a.k || md5(b.line)), a.chars + length(b.line)
  FROM windows a JOIN lines b ON a.doc_id = b.doc_id AND b.pos = a.pos + a.n),
copies AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, pos) AS nth FROM windows)
  WHERE nth > 1 AND chars >= 50),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN copies c
  ON l.doc_id = c.doc_id AND l.pos >= c.pos AND l.pos < c.pos + c.n),
deduped AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
"""


@register(LINES_SQL.format(documents="documents") + "SELECT doc_id, n_lines, n_deleted, text FROM deduped")
def op4_line_dedup(spark, sf_dir):
    from .line_runs import without_later_copies

    return without_later_copies(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_deleted", "text")


@register()
def op8_minhash_near_dedup(spark, sf_dir):
    from .minhash_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@register(r"""
WITH hosts AS (
  SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS section FROM pages),
changes AS (
  SELECT CASE e.event_type WHEN 'signup' THEN h.host || '/' || h.section
      WHEN 'click' THEN array_to_string(list_slice(string_split(h.host, '.'), -2, -1), '.') ELSE h.host END AS rule,
    CASE WHEN e.event_id % 3 = 0 THEN 'adult' ELSE 'spam' END AS category, epoch_us(e.ts) AS at_us, e.event_id AS seq,
    e.event_type <> 'error' AS listed
  FROM events e JOIN hosts h ON e.user_id = h.page_id WHERE h.host IS NOT NULL),
latest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY rule, category, at_us ORDER BY seq DESC, listed DESC) = 1),
intervals AS (SELECT rule, category, listed, at_us AS since, lead(at_us) OVER (PARTITION BY rule, category ORDER BY at_us) AS until FROM latest),
captures AS (
  SELECT page_id, host, section, 1704067200000000 + (page_id * 7919) % 2592000 * 1000000 AS at_us FROM hosts),
asked AS (SELECT DISTINCT page_id, at_us, unnest([host, host || '/' || section,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.'), array_to_string(list_slice(string_split(host, '.'), -3, -1), '.'),
    array_to_string(list_slice(string_split(host, '.'), -4, -1), '.')]) AS rule FROM captures),
met AS (
  SELECT a.page_id, count(*) AS n, string_agg(DISTINCT i.category, ',' ORDER BY i.category) AS categories
  FROM asked a JOIN intervals i ON a.rule = i.rule AND i.listed AND i.since <= a.at_us AND (i.until IS NULL OR a.at_us < i.until)
  GROUP BY a.page_id)
SELECT c.page_id, h.url, c.at_us AS fetched_us, m.n IS NOT NULL AS blocked, coalesce(m.n, 0) AS n_entries,
  coalesce(m.categories, '') AS categories
FROM captures c JOIN hosts h USING (page_id) LEFT JOIN met m USING (page_id)
""")
def op2_url_filters(spark, sf_dir):
    """Every page as a capture, against a list whose changes are the events on the pages' hosts."""
    from .url_filters import host, section, url_decisions

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    name = host(F.col("url"))
    parts = F.split(name, r"\.")
    parent = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    rule = (F.when(F.col("event_type") == "signup", F.concat_ws("/", name, section(F.col("url"))))
            .when(F.col("event_type") == "click", parent).otherwise(name))
    changes = (
        table(spark, sf_dir, "events").join(pages.filter(name.isNotNull()), F.col("user_id") == F.col("page_id"))
        .select(rule.alias("rule"), F.when(F.col("event_id") % 3 == 0, "adult").otherwise("spam").alias("category"),
                F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"),
                (F.col("event_type") != "error").alias("listed"))
    )
    fetched = F.lit(1_704_067_200_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(2_592_000)) * 1_000_000
    captures = pages.select(F.col("page_id").alias("id"), "url", fetched.alias("at"))
    return url_decisions(captures, changes).withColumnsRenamed({"id": "page_id", "at": "fetched_us"})


@register(r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""")
def op3_voronoi_top_k(spark, sf_dir):
    from .voronoi_knn import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@register()
def op10_toxicity(spark, sf_dir):
    from .toxicity import held_out, scores, train

    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    found = scores(docs, train(docs, labels))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register()
def op7_quality_rules(spark, sf_dir):
    from .quality_trees import verdicts

    return verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@register()
def op1_substring_dedup(spark, sf_dir):
    from .substring_dedup import repeated_passages

    found = repeated_passages(documents(spark, sf_dir))
    return found.withColumnsRenamed({"id": "doc_id", "kept_id": "kept_doc_id"})


@register()
def op11_passage_quality(spark, sf_dir):
    from .passage_quality import held_out, scores, train

    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    found = scores(docs, train(docs, labels))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register(r"""
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, d.id, a.label = d.label AS same, list_inner_product(a.v, d.v)::BIGINT AS score
  FROM whole a JOIN whole d ON a.id <> d.id WHERE a.id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
""")
def op12_hard_negatives(spark, sf_dir):
    from .hard_negatives import hard_negatives

    def moved(vec_id, label):
        return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)

    return hard_negatives(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, label=moved)


@register(r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (
  SELECT *, len(l) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM lines),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
      THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
sections AS (
  SELECT *, array_to_string(list_slice(l, 1, low), '') AS prefix, array_to_string(list_slice(l, low + 1, high), '') AS middle,
    array_to_string(list_slice(l, high + 1, n), '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM sections
""")
def op13_fill_in_middle(spark, sf_dir):
    from .fill_middle import digests

    return digests(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
