"""Ledger state, storage and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import render_apply_time, version_key
from ..operators import ledger_state as state
from ..operators.layout import shard
from ..plans import steps
from ..session import table, workspace
from ..sources import scripts
from ..sources.ledger import from_properties, to_properties
from . import register
from .inputs import (
    BATCH_LEDGER_SQL, LEDGER_SQL, SINGLE_LEDGER_SQL, batch_log, ledger_log, single_log, stored_ledger,
)


@register(f"WITH {LEDGER_SQL} SELECT scope, version, apply_time, seq, is_deleted FROM state")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(ledger_log(spark, sf_dir)).drop("batch_id")


@register(f"WITH {LEDGER_SQL} SELECT scope, count(*) AS n_applied FROM applied GROUP BY scope")
def ledger_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.count_applied(state.applied(ledger_log(spark, sf_dir)))


@register(f"WITH {LEDGER_SQL} SELECT scope, version, apply_time, seq, is_deleted FROM state")
def ledger_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored_ledger(spark, sf_dir)
    ledger.compact()
    return state.without_base(ledger.log()).select("scope", "version", "apply_time", "seq", "is_deleted")


@register(f"""WITH {LEDGER_SQL}
SELECT strftime(make_timestamp(apply_time * 1000000), '%Y%m') AS yyyymm, count(*) AS n,
       min(CAST(make_timestamp(apply_time * 1000000) AS DATE)) AS first_date
FROM (SELECT apply_time FROM ledger UNION ALL SELECT 0) GROUP BY 1""")
def ledger_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored_ledger(spark, sf_dir)
    if ledger.initialize():
        raise RuntimeError("a second initialisation must do nothing")
    return ledger.log().groupBy("yyyymm").agg(
        F.count(F.lit(1)).alias("n"), F.min("apply_date").alias("first_date")
    )


@register(f"""WITH {LEDGER_SQL} SELECT scope, version, apply_time, seq, is_deleted FROM ledger""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_log(spark, sf_dir)
    ledger = stored_ledger(spark, sf_dir, rows.filter("is_deleted = 0"))
    ledger.append(rows.filter("is_deleted = 1"))
    return state.without_base(ledger.log()).select("scope", "version", "apply_time", "seq", "is_deleted")


@register(f"""WITH {LEDGER_SQL}
SELECT scope, version, apply_time FROM applied a
WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.scope = a.scope AND l.version = a.version AND l.version < '240110')""")
def ledger_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored_ledger(spark, sf_dir)
    ledger.remove(ledger.applied().filter("version > '01' and version < '240110'"), apply_time=4000000000)
    return state.without_base(ledger.applied()).select("scope", "version", "apply_time")


@register(f"""WITH {LEDGER_SQL}
SELECT scope, version, apply_time, seq, is_deleted FROM ledger l
WHERE NOT EXISTS (SELECT 1 FROM applied a WHERE l.scope = a.scope AND l.version = a.version AND a.version >= '240110')""")
def ledger_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored_ledger(spark, sf_dir)
    ledger.purge(ledger.applied().filter("version >= '240110'"))
    return state.without_base(ledger.log()).select("scope", "version", "apply_time", "seq", "is_deleted")


@register(f"""WITH {LEDGER_SQL} SELECT scope, version, apply_time FROM ledger""")
def ledger_from_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = to_properties(ledger_log(spark, sf_dir)).withColumn(
        "properties", F.map_concat("properties", F.create_map(F.lit("owner"), "scope", F.lit("migrated"), F.lit("x")))
    )
    return from_properties(bags)


@register("""SELECT doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return state.pending(documents, table(spark, sf_dir, "labels"), ["doc_id"])


@register(f"""WITH {LEDGER_SQL},
asked AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS scope,
                 '2401' || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') || '_000000_job' AS version
          FROM orders)
SELECT scope, version, count(*) AS n_asked,
       EXISTS (SELECT 1 FROM applied a WHERE a.scope = asked.scope AND a.version = asked.version) AS is_applied
FROM asked GROUP BY scope, version""")
def ledger_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 200).cast("string").alias("scope"),
        F.concat(F.lit("2401"), F.lpad((F.col("o_orderkey") % 31 + 1).cast("string"), 2, "0"),
                 F.lit("_000000_job")).alias("version"),
    )
    return state.exists(asked, state.applied(ledger_log(spark, sf_dir)))


@register("""SELECT DISTINCT o_orderkey AS orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def missing_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    ways_down = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return state.missing_counterparts(batch, ways_down, ["orderkey"])


@register(f"""WITH {BATCH_LEDGER_SQL}
SELECT scope, version, apply_time FROM applied WHERE apply_time = (SELECT max(apply_time) FROM applied)""")
def latest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = state.applied(batch_log(spark, sf_dir))
    return state.latest_batch(done).select("scope", "version", "apply_time")


@register(f"""WITH {BATCH_LEDGER_SQL}
SELECT scope, version, apply_time FROM applied
QUALIFY apply_time = max(apply_time) OVER (PARTITION BY scope)""")
def latest_batch_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = state.applied(batch_log(spark, sf_dir))
    return state.latest_batch_per_scope(done).select("scope", "version", "apply_time")


@register(f"""WITH {LEDGER_SQL}
SELECT scope, version, apply_time FROM applied ORDER BY apply_time DESC, version DESC, scope LIMIT 10""")
def history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(state.applied(ledger_log(spark, sf_dir))).select("scope", "version", "apply_time")


@register(f"""WITH {LEDGER_SQL}
SELECT scope, version, apply_time FROM applied ORDER BY version DESC, scope LIMIT 25""")
def history_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = state.applied(ledger_log(spark, sf_dir))
    return state.history_by_version(done, 25).select("scope", "version", "apply_time")


@register(f"""WITH {LEDGER_SQL}
SELECT scope, version, apply_time,
       row_number() OVER (PARTITION BY scope ORDER BY apply_time DESC, version DESC) AS ordinal
FROM applied QUALIFY ordinal <= 3""")
def history_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = state.applied(ledger_log(spark, sf_dir))
    return state.history_per_scope(done, 3).select("scope", "version", "apply_time", "ordinal")


@register(f"""WITH {LEDGER_SQL}
SELECT scope, version, strftime(make_timestamp(apply_time * 1000000), '%Y-%m-%d %H:%M:%S') AS applied_at FROM applied""")
def history_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = state.history(state.applied(ledger_log(spark, sf_dir)), None)
    return done.select("scope", "version", render_apply_time("apply_time").alias("applied_at"))


@register("""SELECT lang, doc_id, row_number() OVER w AS step, count(*) OVER (PARTITION BY lang) AS total
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
WINDOW w AS (PARTITION BY lang ORDER BY doc_id) QUALIFY step <= 7""")
def pending_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    todo = state.unapplied(documents, table(spark, sf_dir, "labels"), ["doc_id"])
    return steps.pending_prefix(todo, 7, ["lang"], ["doc_id"])


@register("""SELECT lang, doc_id, row_number() OVER w AS step, count(*) OVER (PARTITION BY lang) AS total
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
WINDOW w AS (PARTITION BY lang ORDER BY doc_id)""")
def pending_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    todo = state.unapplied(documents, table(spark, sf_dir, "labels"), ["doc_id"])
    return steps.pending_prefix(todo, None, ["lang"], ["doc_id"])


_REDO = """WITH {ledger},
newest AS (SELECT scope, version, row_number() OVER (PARTITION BY scope ORDER BY apply_time DESC, version DESC) AS back
           FROM applied QUALIFY {limit}),
sized AS (SELECT *, count(*) OVER (PARTITION BY scope) AS size FROM newest)
SELECT scope, version, 'revert' AS direction, back AS step FROM sized
UNION ALL SELECT scope, version, 'apply', 2 * size - back + 1 FROM sized"""


@register(_REDO.format(ledger=LEDGER_SQL, limit="back <= 2"))
def redo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.redo_plan(state.applied(ledger_log(spark, sf_dir)), 2)


@register(_REDO.format(ledger=LEDGER_SQL, limit="true"))
def redo_plan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.redo_plan(state.applied(ledger_log(spark, sf_dir)), None)


_PLAN_TO = """WITH {ledger}, target AS (SELECT {target} AS t),
down AS (SELECT EXISTS (SELECT 1 FROM applied, target WHERE substr(version, 1, 13) = t) AS d),
picked AS (
  SELECT scope, version, 'revert' AS direction, apply_time FROM applied, target, down
  WHERE d AND substr(version, 1, 13) > t
  UNION ALL
  SELECT scope, version, 'apply', NULL FROM ledger, target, down
  WHERE NOT d AND is_deleted = 1 AND substr(version, 1, 13) <= t)
SELECT scope, version, direction, row_number() OVER (
  ORDER BY apply_time DESC NULLS LAST, CASE WHEN direction = 'revert' THEN version END DESC, version) AS step
FROM picked"""


@register(_PLAN_TO.format(ledger=SINGLE_LEDGER_SQL, target="'240116_000000'"))
def plan_to_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = single_log(spark, sf_dir)
    return steps.plan_to(log, state.applied(log), "240116_000000")


_BACK = "(SELECT min(substr(version, 1, 13)) FROM applied WHERE version > '240120')"


@register(_PLAN_TO.format(ledger=SINGLE_LEDGER_SQL, target=_BACK))
def plan_back_to_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = single_log(spark, sf_dir)
    done = state.applied(log)
    target = done.filter("version > '240120'").agg(F.min(version_key("version"))).first()[0]
    return steps.plan_to(log, done, target)


@register(f"""WITH {LEDGER_SQL},
down AS (SELECT DISTINCT scope FROM applied WHERE substr(version, 1, 13) = '240115_000000')
SELECT scope, version, 'revert' AS direction FROM applied
WHERE substr(version, 1, 13) > '240115_000000' AND scope IN (SELECT scope FROM down)
UNION ALL
SELECT DISTINCT scope, version, 'apply' FROM state
WHERE is_deleted = 1 AND substr(version, 1, 13) <= '240115_000000' AND scope NOT IN (SELECT scope FROM down)""")
def plan_to_version_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = state.latest(ledger_log(spark, sf_dir))
    return steps.plan_to_per_scope(states, states.filter("is_deleted = 0"), "240115_000000")


@register(f"""WITH {LEDGER_SQL}
SELECT p.scope, count(a.version) AS n_applied, count(*) - count(a.version) AS n_cancelled, count(*) AS n_planned
FROM state p LEFT JOIN applied a ON a.scope = p.scope AND a.version = p.version GROUP BY p.scope""")
def apply_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = state.latest(ledger_log(spark, sf_dir))
    return steps.apply_report(states, states.filter("is_deleted = 0"))


@register(f"""WITH {LEDGER_SQL}
SELECT scope, count(*) AS n_planned, min(version) AS first_version, max(version) AS last_version,
       CAST(0 AS BIGINT) AS n_changed
FROM state WHERE is_deleted = 1 GROUP BY scope""")
def dry_run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored_ledger(spark, sf_dir)
    before = ledger.log()
    plan = steps.dry_run(state.latest(before), ledger.applied())
    changed = before.exceptAll(ledger.log()).agg(F.count(F.lit(1)).alias("n_changed"))
    return plan.crossJoin(F.broadcast(changed))


@register(f"""WITH {LEDGER_SQL}
SELECT version, count(*) AS n, CAST(1 AS BIGINT) AS n_shards FROM state GROUP BY version""")
def shard_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard(state.latest(ledger_log(spark, sf_dir)), 16)
    return sharded.groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("n_shards")
    )


_CHUNK = 2000


@register(f"""WITH lines AS (
  SELECT strftime(ts, '%y%m%d') || '_000000_load-' || event_id // {_CHUNK} AS version, event_id,
         CASE WHEN day(ts) % 2 = 1 THEN '.safe' ELSE '' END AS safe,
         'INSERT INTO log VALUES (' || event_id || ');' AS line
  FROM events)
SELECT version || safe || '.up.sql' AS file, version, substr(version, 15) AS name, safe <> '' AS safe,
       CAST(sum(length(line) + 1) AS BIGINT) AS n_chars, md5(string_agg(line || chr(10), '' ORDER BY event_id)) AS body_md5
FROM lines GROUP BY version, safe""")
def scan_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    version = F.concat(
        F.date_format("ts", "yyMMdd"), F.lit("_000000_load-"), F.floor(F.col("event_id") / _CHUNK),
    )
    safe = F.when(F.dayofmonth("ts") % 2 == 1, ".safe").otherwise("")
    lines = events.select(
        F.explode(F.array(F.lit("up"), F.lit("down"))).alias("direction"),
        version.alias("version"), safe.alias("safe"), F.col("event_id").alias("at"),
        F.concat(F.lit("INSERT INTO log VALUES ("), F.col("event_id"), F.lit(");")).alias("line"),
    ).withColumn("file", F.concat("version", "safe", F.lit("."), "direction", F.lit(".sql")))
    path = workspace(spark, "scripts")
    scripts.write_scripts(lines, path)
    found = scripts.scan_scripts(spark, path)
    return found.select(
        "file", "version", "name", "safe", F.length("body").cast("bigint").alias("n_chars"),
        F.md5("body").alias("body_md5"),
    )
