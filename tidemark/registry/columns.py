"""Names, texts and partition transforms as column jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, spans, text, transforms
from ..session import table
from . import register

# Versions made from events and spoiled in six ways.
_VERSIONS_SQL = """
raw AS (SELECT event_id, strftime(ts, '%y%m%d_%H%M%S') AS stamp, event_type FROM events),
made AS (SELECT event_id, CASE event_id % 7
    WHEN 0 THEN stamp || '_' || event_type
    WHEN 1 THEN stamp || event_type
    WHEN 2 THEN stamp || '_' || upper(event_type)
    WHEN 3 THEN '24' || '0230' || substr(stamp, 7) || '_' || event_type
    WHEN 4 THEN stamp || '_' || event_type || '-x1'
    WHEN 5 THEN ''
    ELSE '99' || substr(stamp, 3) || '_' || event_type END AS version FROM raw)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp, kind = F.date_format("ts", "yyMMdd_HHmmss"), F.col("event_type")
    bad = F.col("event_id") % 7
    version = (
        F.when(bad == 0, F.concat_ws("_", stamp, kind))
        .when(bad == 1, F.concat(stamp, kind))
        .when(bad == 2, F.concat_ws("_", stamp, F.upper(kind)))
        .when(bad == 3, F.concat(F.lit("240230"), F.substring(stamp, 7, 7), F.lit("_"), kind))
        .when(bad == 4, F.concat(stamp, F.lit("_"), kind, F.lit("-x1")))
        .when(bad == 5, F.lit(""))
        .otherwise(F.concat(F.lit("99"), F.substring(stamp, 3, 11), F.lit("_"), kind))
    )
    return table(spark, sf_dir, "events").select("event_id", version.alias("version"))


@register(f"""WITH {_VERSIONS_SQL},
parsed AS (SELECT event_id, version,
    regexp_matches(version, '^[0-9]{{6}}_[0-9]{{6}}_[a-z][a-z0-9_-]+$') AS matched,
    try_strptime('20' || substr(version, 1, 13), '%Y%m%d_%H%M%S') AS ts FROM made),
judged AS (SELECT *, CASE WHEN version = '' THEN 'empty' WHEN NOT matched THEN 'pattern'
    WHEN ts IS NULL THEN 'calendar'
    WHEN ts > TIMESTAMP '2024-01-20 08:00:00' THEN 'future' END AS reason FROM parsed)
SELECT event_id, version, reason IS NULL AS valid, reason,
       CASE WHEN reason IS NULL THEN ts END AS ts,
       CASE WHEN reason IS NULL THEN substr(version, 15) END AS name FROM judged""")
def parse_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    parsed = names.parse_version("version", now)
    return _versions(spark, sf_dir).select("event_id", "version", F.inline(F.array(parsed)))


@register(f"""WITH {_VERSIONS_SQL},
named AS (SELECT event_id, version || CASE event_id % 4 WHEN 0 THEN '.up.sql' WHEN 1 THEN '.safe.down.sql'
    WHEN 2 THEN '.up.safe.sql' ELSE '.safe.up.sql' END AS file FROM made),
parsed AS (SELECT event_id, file,
    regexp_matches(file, '^[0-9]{{6}}_[0-9]{{6}}_[a-z][a-z0-9_-]+([.]safe)?[.](up|down)[.]sql$') AS matched,
    try_strptime('20' || substr(file, 1, 13), '%Y%m%d_%H%M%S') AS ts FROM named),
judged AS (SELECT *, CASE WHEN NOT matched THEN 'pattern' WHEN ts IS NULL THEN 'calendar'
    WHEN ts > TIMESTAMP '2024-01-20 08:00:00' THEN 'future' END AS reason FROM parsed)
SELECT event_id, file, reason,
       CASE WHEN reason IS NULL THEN split_part(file, '.', 1) END AS version,
       CASE WHEN reason IS NULL THEN file LIKE '%.safe.%' END AS safe,
       CASE WHEN reason IS NULL THEN CASE WHEN file LIKE '%.up.sql' THEN 'up' ELSE 'down' END END AS direction
FROM judged""")
def parse_script_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.col("event_id") % 4
    ending = (
        F.when(which == 0, ".up.sql").when(which == 1, ".safe.down.sql")
        .when(which == 2, ".up.safe.sql").otherwise(".safe.up.sql")
    )
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    files = _versions(spark, sf_dir).select("event_id", F.concat("version", ending).alias("file"))
    return files.select("event_id", "file", F.inline(F.array(names.parse_script("file", now)))).select(
        "event_id", "file", "reason", "version", "safe", "direction"
    )


@register(f"WITH {_VERSIONS_SQL} SELECT event_id, substr(version, 1, 13) AS key FROM made")
def version_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("event_id", names.version_key("version").alias("key"))


@register("""WITH raw AS (SELECT event_id, CASE event_id % 6
    WHEN 0 THEN strftime(ts, '%y%m%d_%H%M%S')
    WHEN 1 THEN strftime(ts, '%y%m%d_%H%M%S') || '_' || event_type
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 3 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR)
    WHEN 4 THEN CAST(event_id AS VARCHAR)
    ELSE 'v' || event_id END AS target, ts FROM events)
SELECT event_id, target, CASE WHEN event_id % 6 < 4 THEN strftime(ts, '%y%m%d_%H%M%S')
    WHEN event_id % 6 = 4 AND length(target) BETWEEN 9 AND 10
      THEN strftime(make_timestamp(CAST(target AS BIGINT) * 1000000), '%y%m%d_%H%M%S') END AS stamp
FROM raw""")
def normalize_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    form, stamp = F.col("event_id") % 6, F.date_format("ts", "yyMMdd_HHmmss")
    target = (
        F.when(form == 0, stamp)
        .when(form == 1, F.concat_ws("_", stamp, "event_type"))
        .when(form == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(form == 3, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
        .when(form == 4, F.col("event_id").cast("string"))
        .otherwise(F.concat(F.lit("v"), F.col("event_id")))
    )
    return table(spark, sf_dir, "events").select("event_id", target.alias("target")).withColumn(
        "stamp", names.normalize_target("target")
    )


@register("""SELECT kind, name, regexp_full_match(name, '[A-Za-z0-9_]*') AND strlen(name) <= 256 AS valid FROM (
  SELECT 'part' AS kind, p_name AS name FROM part UNION ALL SELECT 'customer', c_name FROM customer
  UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'long', repeat(p_type, 50) FROM part)""")
def valid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def some(kind: str, source: str, name: Column) -> DataFrame:
        return table(spark, sf_dir, source).select(F.lit(kind).alias("kind"), name.alias("name"))

    everything = (
        some("part", "part", F.col("p_name"))
        .unionAll(some("customer", "customer", F.col("c_name")))
        .unionAll(some("nation", "nation", F.col("n_name")))
        .unionAll(some("long", "part", F.repeat("p_type", 50)))
    )
    return everything.withColumn("valid", names.is_identifier("name"))


_HOST_SQL = """hosts AS (SELECT page_id, CASE page_id % 5
    WHEN 0 THEN 'WWW.' || h WHEN 1 THEN '.' || h WHEN 2 THEN split_part(h, '.', 1)
    WHEN 3 THEN 'www. ' || h ELSE h END AS name
  FROM (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS h FROM pages)),
parts AS (SELECT page_id, name,
    list_filter(list_transform(string_split(name, '.'), lambda p: trim(p)), lambda p: p <> '') AS every FROM hosts),
kept AS (SELECT *, CASE WHEN lower(every[1]) = 'www' THEN every[2:] ELSE every END AS p FROM parts)"""


@register(f"""WITH {_HOST_SQL}, judged AS (SELECT *, CASE
    WHEN NOT regexp_matches(name, '^[A-Za-z_]') THEN 'invalid' WHEN len(every) = 0 THEN 'empty'
    WHEN len(p) < 2 THEN 'namespace required' END AS reason FROM kept)
SELECT page_id, name, CASE WHEN reason IS NULL THEN array_to_string(p[1:len(p) - 1], '/') END AS namespace,
       CASE WHEN reason IS NULL THEN p[-1] END AS table_name, reason,
       CASE WHEN len(p) > 0 THEN array_to_string(p, '/') END AS whole FROM judged""")
def qualify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("page_id") % 5
    host = F.split(F.split("url", "//")[1], "/")[0]
    name = (
        F.when(form == 0, F.concat(F.lit("WWW."), host)).when(form == 1, F.concat(F.lit("."), host))
        .when(form == 2, F.split(host, r"\.")[0]).when(form == 3, F.concat(F.lit("www. "), host)).otherwise(host)
    )
    found = names.qualify_name("name", "www")
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("q", found).select(
        "page_id", "name",
        F.array_join("q.namespace", "/").alias("namespace"),
        F.col("q.table").alias("table_name"), F.col("q.reason").alias("reason"),
        F.array_join(names.qualify_namespace("name", "www"), "/").alias("whole"),
    )


_SPACE = r"[\s\x{0b}\x{85}\x{a0}\p{Z}]"


# White space goes before a statement; before its semicolon it stays.
@register(rf"""WITH cut AS (SELECT doc_id, string_split(replace(replace(text, '$', ''), '.', ';'), ';') AS p FROM documents),
parts AS (SELECT doc_id, list_filter(list_append(
    list_transform(p[1:len(p) - 1], lambda s: regexp_replace(s, '^{_SPACE}+', '')),
    regexp_replace(p[-1], '^{_SPACE}+|{_SPACE}+\z', '', 'g')), lambda s: s <> '') AS p FROM cut)
SELECT doc_id, unnest(range(len(p))) AS pos, md5(unnest(p)) AS statement_md5 FROM parts""")
def split_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.replace(F.replace("text", F.lit("$"), F.lit("")), F.lit("."), F.lit(";"))
    statements = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(text.split_statements(script)).alias("pos", "statement")
    )
    return statements.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("statement").alias("statement_md5"))


@register(rf"""WITH made AS (SELECT doc_id, string_split(replace(replace(text, '$', ''), '.', ';'), ';') AS p FROM documents),
parts AS (SELECT doc_id, len(p) AS k, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM made),
placed AS (SELECT *, coalesce(sum(length(s) + 1) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts),
cut AS (SELECT *, length(s) - length(regexp_replace(s, '^{_SPACE}+', '')) AS lead,
    length(CASE WHEN i = k THEN regexp_replace(s, '{_SPACE}+$', '') ELSE s END) AS size FROM placed)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS number,
  CAST(before + lead + 1 AS BIGINT) AS first, CAST(before + size AS BIGINT) AS last FROM cut WHERE size > lead""")
def statement_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.replace(F.replace("text", F.lit("$"), F.lit("")), F.lit("."), F.lit(";"))
    return spans.statement_spans(table(spark, sf_dir, "documents").select("doc_id", script.alias("script")), "script").drop("script")


# Every third sentence is a $$ body, whose semicolons must not split.
@register(rf"""WITH made AS (SELECT conv_id, turn, list_transform(
      string_split(replace(text, '$', ''), '.'),
      lambda p, i: CASE WHEN i % 3 = 0 THEN 'DO $$ begin;' || p || '; end $$ call' ELSE p END) AS p FROM conversations),
parts AS (SELECT conv_id, turn, list_filter(list_transform(p,
    lambda s: regexp_replace(s, '^{_SPACE}+', '')),
    lambda s: s <> '') AS p FROM (
      SELECT conv_id, turn, flatten(list_transform(p, lambda s: CASE WHEN s LIKE 'DO $$%' THEN [s]
        ELSE string_split(s, ';') END)) AS p FROM made))
SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n, md5(array_to_string(p, '|')) AS joined_md5 FROM parts""")
def split_dollar_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = F.split(F.replace("text", F.lit("$"), F.lit("")), r"\.")
    bodies = F.transform(sentences, lambda p, i: F.when(
        (i + 1) % 3 == 0, F.concat(F.lit("DO $$ begin;"), p, F.lit("; end $$ call"))).otherwise(p))
    statements = text.split_statements(F.concat(F.array_join(bodies, ";"), F.lit(";")))
    return table(spark, sf_dir, "conversations").withColumn("p", statements).select(
        "conv_id", "turn", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "|")).alias("joined_md5")
    )


_DECORATED_SQL = """made AS (SELECT conv_id, turn, 'SELECT ''it''''s -- kept'', `a/*b*/` -- gone ''x' || chr(10)
  || '/* gone -- ' || chr(10) || ' too */' || text || '-- end ' || turn AS script FROM conversations)"""


@register(rf"""WITH {_DECORATED_SQL}
SELECT conv_id, turn, md5(s) AS stripped_md5, length(s) AS n_chars FROM (
  SELECT conv_id, turn, regexp_replace(script,
    '(''[^'']*(?:''''[^'']*)*(?:''|\z)|`[^`]*(?:`|\z))|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)', '\1', 'g') AS s FROM made)""")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.concat(
        F.lit("SELECT 'it''s -- kept', `a/*b*/` -- gone 'x\n/* gone -- \n too */"), "text", F.lit("-- end "), "turn"
    )
    return table(spark, sf_dir, "conversations").withColumn("s", text.strip_comments(script)).select(
        "conv_id", "turn", F.md5("s").alias("stripped_md5"), F.length("s").cast("bigint").alias("n_chars")
    )


@register("""SELECT conv_id, turn, md5(replace(replace(replace(
    'ON {cluster}: ' || c.text || ' BY {username} {other} {placeholder_custom}',
    '{cluster}', 'c' || c.conv_id), '{placeholder_custom}', 'for {username}'), '{username}', n.n_name)) AS filled_md5
FROM conversations c JOIN nation n ON n.n_nationkey = c.conv_id % 25""")
def fill_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").withColumn("n_nationkey", (F.col("conv_id") % 25).cast("int"))
    rows = conversations.join(table(spark, sf_dir, "nation"), "n_nationkey")
    template = F.concat(F.lit("ON {cluster}: "), "text", F.lit(" BY {username} {other} {placeholder_custom}"))
    filled = text.fill_template(template, {
        "cluster": F.concat(F.lit("c"), "conv_id"), "username": F.col("n_name"), "placeholder_custom": "for {username}",
    })
    return rows.select("conv_id", "turn", F.md5(filled).alias("filled_md5"))


@register("""SELECT doc_id, md5(replace(replace(text, source, '****'), lang, '****')) AS masked_md5,
       length(replace(replace(text, source, '****'), lang, '****')) AS n_chars FROM documents""")
def mask_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.mask_literals("text", [F.col("source"), F.lit(""), F.col("lang")])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(masked).alias("masked_md5"), F.length(masked).cast("bigint").alias("n_chars")
    )


@register("""SELECT event_id, 'by ' || CASE WHEN user_id % 3 = 0 AND user_id < 3000 THEN '****' ELSE 'u' || user_id || 'z' END
  || ' key ' || CASE WHEN event_id % 7 = 0 AND event_id < 63000 THEN '****' ELSE 'e' || event_id || 'k' END || '!' AS masked
FROM events""")
def mask_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand secrets in the lines of a log."""
    secrets = [f"e{7 * i}k" for i in range(9000)] + [f"u{3 * i}z" for i in range(1000)]
    line = F.concat(F.lit("by u"), "user_id", F.lit("z key e"), "event_id", F.lit("k!"))
    return table(spark, sf_dir, "events").select("event_id", text.mask_many(line, secrets).alias("masked"))


_SECRET_URL_SQL = """made AS (SELECT page_id,
  CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '://user' || page_id || ':p:w' || page_id || '@')
       WHEN page_id % 3 = 1 THEN replace(url, '://', '://user' || page_id || ':@') ELSE url END
  || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'mytoken=t' || page_id || '&s3.session-token=ab c&credential='
  || CASE WHEN page_id % 2 = 0 THEN '#x' ELSE 'y&z=1' END AS url FROM pages)"""


def _secret_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id"), F.col("url")
    user = F.concat(F.lit("://user"), page, F.lit(":"))
    with_user = (
        F.when(page % 3 == 0, F.replace(url, F.lit("://"), F.concat(user, F.lit("p:w"), page, F.lit("@"))))
        .when(page % 3 == 1, F.replace(url, F.lit("://"), F.concat(user, F.lit("@")))).otherwise(url)
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat(
        with_user, F.when(url.contains("?"), "&").otherwise("?"), F.lit("mytoken=t"), page,
        F.lit("&s3.session-token=ab c&credential="), F.when(page % 2 == 0, "#x").otherwise("y&z=1"),
    ).alias("url"))


@register(f"""WITH {_SECRET_URL_SQL}, user_masked AS (SELECT page_id,
    CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^([a-z]+://[^@:]*:)[^@]+@', '\\1****@') ELSE url END AS url FROM made)
SELECT page_id, regexp_replace(regexp_replace(url, '(token=)[^&# ]*', '\\1****', 'g'),
    '(credential=)[^&# ]*', '\\1****', 'g') AS masked FROM user_masked""")
def mask_url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secret_urls(spark, sf_dir).select("page_id", text.mask_url("url").alias("masked"))


@register("""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS shown
FROM documents""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.shorten("text", 200).alias("shown"))


@register("""WITH made AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN split_part(url, '://', 2)
    ELSE replace(url, '://', CASE page_id % 3 WHEN 0 THEN '://us:pw@' WHEN 1 THEN '://us@h1:90, h2:91,,' ELSE '://' END) END AS url
  FROM pages),
a AS (SELECT page_id, url, strpos(url, '://') AS s FROM made),
b AS (SELECT *, substr(url, 1, s - 1) AS driver, substr(url, s + 3) AS rest FROM a WHERE s > 0),
c AS (SELECT *, CASE WHEN contains(rest, '@') THEN split_part(rest, '@', 1) ELSE '' END AS who,
    CASE WHEN contains(rest, '@') THEN substr(rest, strpos(rest, '@') + 1) ELSE rest END AS place FROM b),
d AS (SELECT *, split_part(place, '?', 1) AS spot,
    CASE WHEN contains(place, '?') THEN substr(place, strpos(place, '?') + 1) ELSE '' END AS query FROM c),
e AS (SELECT *, list_filter(list_transform(string_split(split_part(spot, '/', 1), ','), lambda h: trim(h)),
    lambda h: h <> '') AS hosts, list_filter(string_split(query, '&'), lambda q: q <> '') AS pairs FROM d)
SELECT m.page_id, e.url IS NOT NULL AS valid, driver, split_part(who, ':', 1) AS username,
    CASE WHEN contains(who, ':') THEN substr(who, strpos(who, ':') + 1) WHEN e.url IS NOT NULL THEN '' END AS password,
    array_to_string(hosts, '|') AS hosts, split_part(hosts[1], ':', 1) AS host,
    CASE WHEN contains(hosts[1], ':') THEN split_part(hosts[1], ':', 2) WHEN e.url IS NOT NULL THEN '' END AS port,
    CASE WHEN contains(spot, '/') THEN substr(spot, strpos(spot, '/') + 1) WHEN e.url IS NOT NULL THEN '' END AS database,
    CAST(len(pairs) AS INTEGER) AS n_options,
    split_part(list_filter(pairs, lambda q: q LIKE 'page=%')[1], '=', 2) AS page,
    len(hosts) > 1 AS is_cluster
FROM made m LEFT JOIN e ON e.page_id = m.page_id""")
def decompose_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id"), F.col("url")
    lead = F.when(page % 3 == 0, "://us:pw@").when(page % 3 == 1, "://us@h1:90, h2:91,,").otherwise("://")
    made = F.when(page % 11 == 0, F.split(url, "://")[1]).otherwise(F.replace(url, F.lit("://"), lead))
    return table(spark, sf_dir, "pages").select("page_id", text.parse_connection(made).alias("c")).select(
        "page_id", F.col("c").isNotNull().alias("valid"), "c.driver", "c.username", "c.password",
        F.array_join("c.hosts.address", "|").alias("hosts"),
        F.col("c.hosts")[0]["host"].alias("host"), F.col("c.hosts")[0]["port"].alias("port"),
        "c.database", F.size("c.options").alias("n_options"),
        F.col("c.options")["page"][0].alias("page"), text.is_cluster("c").alias("is_cluster"),
    ).withColumn("n_options", F.when(F.col("valid"), F.col("n_options")))


@register(r"""WITH normal AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(
    regexp_replace(text, '^[\s\x{0b}\x{85}\p{Z}]+|[\s\x{0b}\x{85}\p{Z}]+\z', '', 'g'), '\s+', ' ', 'g'), '\s*,\s+', ',', 'g'),
    ' )', ')'), '( ', '(') AS form FROM documents)
SELECT min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM normal GROUP BY form HAVING count(*) > 1""")
def normalized_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest stands for the text, so the shuffle does not carry whole texts.
    digest = F.sha2(text.normal_form("text"), 256)
    return (
        table(spark, sf_dir, "documents").groupBy(digest.alias("form"))
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("form")
    )


# Statement texts by event number; the flag says IF [NOT] EXISTS, %s is a table name.
_STATEMENTS = (
    ("create_namespace", True, "CREATE NAMESPACE IF NOT EXISTS ns_%s"),
    ("drop_namespace", False, "drop namespace ns_%s"),
    ("create_table", True, "-- make it\nCreate Table if not exists a.%s (id long)"),
    ("drop_table", True, "DROP TABLE IF EXISTS a.%s;"),
    ("rename_table", False, "RENAME TABLE a.%s TO a.b"),
    ("add_column", False, "ALTER TABLE a.%s /* new */ ADD COLUMN c string"),
    ("drop_column", False, "ALTER TABLE a.%s DROP COLUMN c"),
    ("rename_column", False, "ALTER TABLE `a`.`%s` RENAME COLUMN c TO d"),
    ("alter_column_type", False, "ALTER  TABLE a.%s\nALTER COLUMN c TYPE long"),
    ("add_partition_field", False, "ALTER TABLE a.%s ADD PARTITION FIELD days(ts)"),
    ("drop_partition_field", False, "ALTER TABLE a.%s DROP PARTITION FIELD days(ts)"),
    ("set_sort_order", False, "ALTER TABLE a.%s WRITE ORDERED BY ts DESC"),
    ("unsupported", False, "TRUNCATE TABLE a.%s"),
    ("unsupported", False, "ALTER VIEW a.%s ADD COLUMN c string"),
)


@register(f"""SELECT event_type, kind, conditional, count(*) AS n FROM events JOIN (VALUES
  {", ".join(f"({i}, '{kind}', {flag})" for i, (kind, flag, _) in enumerate(_STATEMENTS))}
) s(i, kind, conditional) ON i = event_id % {len(_STATEMENTS)} GROUP BY ALL""")
def classify_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(form) for _, _, form in _STATEMENTS])
    pick = (F.col("event_id") % len(_STATEMENTS)).cast("int")
    statement = F.replace(F.get(forms, pick), F.lit("%s"), F.concat(F.lit("t"), "user_id"))
    kinds = table(spark, sf_dir, "events").select(
        "event_type", F.inline(F.array(text.classify_statement(statement)))
    )
    return kinds.groupBy("event_type", "kind", "conditional").agg(F.count(F.lit(1)).alias("n"))


def _value(spark: SparkSession, sf_dir: str, source: str, key: str, field: transforms.PartitionField) -> DataFrame:
    rows = table(spark, sf_dir, source)
    return rows.select(key, field.value(rows.schema).alias("v"))


def _field(transform: str, source: str, param: int | None = None) -> transforms.PartitionField:
    return transforms.PartitionField(transform, source, param)


@register("SELECT event_id, event_type AS v FROM events")
def xf_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, "events", "event_id", _field("identity", "event_type"))


@register("SELECT o_orderkey, CAST(year(o_orderdate) - 1970 AS INTEGER) AS v FROM orders")
def xf_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, "orders", "o_orderkey", _field("years", "o_orderdate"))


@register("SELECT o_orderkey, CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INTEGER) AS v FROM orders")
def xf_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, "orders", "o_orderkey", _field("months", "o_orderdate"))


@register("SELECT event_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS v FROM events")
def xf_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, "events", "event_id", _field("days", "ts"))


# Half of the times are moved before 1970, where the hour has to round down.
@register("""SELECT event_id, CAST(floor(epoch_us(t) / 3600000000.0) AS INTEGER) AS v FROM (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 20000 DAY ELSE ts END AS t FROM events)""")
def xf_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn(
        "ts", F.when(F.col("event_id") % 2 == 0, F.expr("ts - interval 20000 days")).otherwise(F.col("ts"))
    )
    return rows.select("event_id", _field("hours", "ts").value(rows.schema).alias("v"))


def _rounds(n: int, word: str, h: str) -> str:
    """SQL of one hash round as two CTE columns: the scrambled word, then the state."""
    return f"""
k{n}a AS (SELECT id, {h} AS h, CAST({word} AS HUGEINT) * 3432918353 % 4294967296 AS k, rest FROM r{n - 1}),
k{n}b AS (SELECT id, h, (k * 32768 % 4294967296 + k // 131072) * 461845907 % 4294967296 AS k, rest FROM k{n}a),
k{n}c AS (SELECT id, xor(CAST(h AS BIGINT), CAST(k AS BIGINT)) AS h, rest FROM k{n}b),
r{n} AS (SELECT id, ((CAST(h AS HUGEINT) * 8192 % 4294967296 + h // 524288) * 5 + 3864292196) % 4294967296 AS h, rest FROM k{n}c)"""


def _finish(last: str, length: str) -> str:
    return f"""
f1 AS (SELECT id, xor(CAST(h AS BIGINT), CAST({length} AS BIGINT)) AS h FROM {last}),
f2 AS (SELECT id, CAST(xor(h, h // 65536) AS HUGEINT) * 2246822507 % 4294967296 AS h FROM f1),
f3 AS (SELECT id, CAST(xor(CAST(h AS BIGINT), CAST(h // 8192 AS BIGINT)) AS HUGEINT) * 3266489909 % 4294967296 AS h FROM f2),
f4 AS (SELECT id, xor(CAST(h AS BIGINT), CAST(h // 65536 AS BIGINT)) AS h FROM f3)"""


def bucket_ctes(source: str, key: str, value: str) -> str:
    """CTEs that end in ``f4(id, h)``, the hash of a long value by key."""
    unsigned = f"(CAST({value} AS HUGEINT) + CASE WHEN {value} < 0 THEN 18446744073709551616 ELSE 0 END)"
    return f"""
r0 AS (SELECT {key} AS id, CAST(0 AS HUGEINT) AS h, {unsigned} AS rest FROM {source}),
{_rounds(1, "(rest % 4294967296)", "h")},
{_rounds(2, "(rest // 4294967296)", "h")},
{_finish("r2", "8")}"""


def _bucket_long_sql(source: str, key: str, value: str, n: int) -> str:
    return f"WITH {bucket_ctes(source, key, value)} SELECT id AS {key}, CAST((h & 2147483647) % {n} AS INTEGER) AS v FROM f4"


@register(_bucket_long_sql("orders", "o_orderkey", "(o_custkey - 700)", 16))
def xf_bucket_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey") - 700)
    return rows.select("o_orderkey", _field("bucket", "o_custkey", 16).value(rows.schema).alias("v"))


@register(_bucket_long_sql("events", "event_id", "epoch_us(ts)", 32))
def xf_bucket_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, "events", "event_id", _field("bucket", "ts", 32))


# The words of a text are folded one after the other; the 0 to 3 bytes left over are mixed in at the end.
@register(f"""WITH
b AS (SELECT page_id AS id, hex(encode(url)) AS x, strlen(url) AS n FROM pages),
w AS (SELECT id, n, list_transform(range(n // 4), lambda i: CAST('0x' || substr(x, 8 * i + 7, 2) || substr(x, 8 * i + 5, 2)
       || substr(x, 8 * i + 3, 2) || substr(x, 8 * i + 1, 2) AS BIGINT)) AS words,
     list_transform(range(n % 4), lambda i: CAST('0x' || substr(x, 8 * (n // 4) + 2 * i + 1, 2) AS BIGINT)
       * [1, 256, 65536][i + 1]) AS tail FROM b),
s AS (SELECT id, n, list_transform(words, lambda k: CAST(k AS HUGEINT) * 3432918353 % 4294967296) AS words,
     CAST(coalesce(list_sum(tail), 0) AS HUGEINT) * 3432918353 % 4294967296 AS tail FROM w),
t AS (SELECT id, n, list_transform(words, lambda k: (k * 32768 % 4294967296 + k // 131072) * 461845907 % 4294967296) AS words,
     (tail * 32768 % 4294967296 + tail // 131072) * 461845907 % 4294967296 AS tail FROM s),
folded AS (SELECT id, n, tail, list_reduce(words, lambda h, k: CAST(list_extract(list_transform(
       [CAST(xor(CAST(h AS BIGINT), CAST(k AS BIGINT)) AS HUGEINT)],
       lambda y: ((y * 8192 % 4294967296 + y // 524288) * 5 + 3864292196) % 4294967296), 1) AS HUGEINT), CAST(0 AS HUGEINT)) AS h FROM t),
r2 AS (SELECT id, n, xor(CAST(h AS BIGINT), CAST(tail AS BIGINT)) AS h FROM folded),
{_finish("r2", "n")}
SELECT id AS page_id, CAST((h & 2147483647) % 16 AS INTEGER) AS v FROM f4""")
def xf_bucket_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, "pages", "page_id", _field("bucket", "url", 16))


@register("SELECT p_partkey, CAST(v - ((v % 10) + 10) % 10 AS INTEGER) AS v FROM (SELECT p_partkey, p_size - 25 AS v FROM part)")
def xf_truncate_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size") - 25)
    return rows.select("p_partkey", _field("truncate", "p_size", 10).value(rows.schema).alias("v"))


@register("SELECT doc_id, substr(text, 1, 3) AS v FROM documents")
def xf_truncate_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, "documents", "doc_id", _field("truncate", "text", 3))


@register("""SELECT o_orderkey, u - ((u % 50) + 50) % 50 AS v_unscaled FROM (
  SELECT o_orderkey, CAST(round((o_totalprice - 200000) * 100) AS BIGINT) AS u FROM orders)""")
def xf_truncate_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round((F.col("o_totalprice") - 200000) * 100).cast("bigint").cast("decimal(18,0)")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (price / 100).cast(T.DecimalType(12, 2)).alias("price"))
    value = _field("truncate", "price", 50).value(rows.schema)
    return rows.select("o_orderkey", (value * 100).cast("bigint").alias("v_unscaled"))
