"""Registered queries that replay the tables as a change feed: written as a log in two parts, each followed by a run of the stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans import catalogue
from palisade.plans.catalogue import table
from palisade.sources import catalog, change_log
from palisade.sources.shared import new_folder, stored
from palisade.streaming import feed, state

DAY_MS = 86_400_000


def replayed(lines: DataFrame, run: Callable[[str, str], None]) -> None:
    """Writes lines (seq, value) as a log up to the mean seq, runs the stream, writes the rest and runs it again from its checkpoint."""
    spark = lines.sparkSession
    log, checkpoint = new_folder(spark, "log"), new_folder(spark, "offsets")
    lines = stored(lines, "lines")  # they are read seven times: for the mean, and counted, sampled and written in each part
    middle = lines.agg(F.avg("seq")).first()[0]
    for part in (F.col("seq") <= F.lit(middle), F.col("seq") > F.lit(middle)):
        change_log.write_segments(lines.where(part), log, 20_000)
        run(log, checkpoint)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of their users' packages: errors are tombstones, a purchase ends an analysis."""
    row = F.struct(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("id"), (F.col("event_type") == "error").alias("deleted"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ))").alias("at"), (F.col("event_type") == "purchase").alias("ended"),
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.to_json(row).alias("value"))


def started(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs the stream on what there is, into the folder out."""
    stream.writeStream.foreachBatch(feed.into(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def source_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change once, though the stream stopped and went on."""
    out = new_folder(spark, "changes")
    replayed(event_lines(spark, sf_dir), lambda log, at: started(change_log.read_stream(spark, log), out, at))
    return spark.read.parquet(out).select("seq", "id", "deleted")


SOURCE_SQL = "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id, event_type = 'error' AS deleted FROM events"


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which live changes start an analysis, which takes a day at most or until the user's next purchase."""
    out = new_folder(spark, "started")

    def run(log: str, at: str) -> None:
        rows = change_log.read_stream(spark, log).where("NOT deleted").withColumn("v", F.from_json("value", "at LONG, ended BOOLEAN"))
        rows = rows.select(F.lit("npm").alias("ecosystem"), F.col("id").alias("name"), "seq", F.timestamp_millis("v.at").alias("at"), F.col("v.ended").alias("ended"))
        started(state.in_flight(rows, DAY_MS), out, at)

    replayed(event_lines(spark, sf_dir), run)
    return spark.read.parquet(out).select("name", "seq", "at_ms", "waited")


#: One event of each user after another; each user has a row more where the watermark stands for the second run.
IN_FLIGHT_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS ended FROM events WHERE event_type <> 'error'),
 x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id NULLS LAST) AS k FROM (SELECT * FROM e UNION ALL SELECT DISTINCT user_id, NULL, (SELECT max(ms) FROM e WHERE event_id <= (SELECT avg(event_id) FROM events)), NULL FROM e)),
 s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS w, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(seq BIGINT, at_ms BIGINT, waited BIGINT)[]) AS out FROM x
  UNION ALL SELECT user_id, k, CASE WHEN free THEN CASE WHEN ended = false THEN ms + {DAY_MS} END WHEN ended THEN CASE WHEN n > 0 THEN ms + {DAY_MS} END ELSE until END,
    CASE WHEN ended = false AND NOT free THEN event_id ELSE w END, CASE WHEN free OR ended THEN 0 WHEN ended = false THEN n + 1 ELSE n END,
    CASE WHEN free AND ended = false THEN list_append(out, {{'seq': event_id, 'at_ms': ms, 'waited': CAST(0 AS BIGINT)}}) WHEN NOT free AND ended AND n > 0 THEN list_append(out, {{'seq': w, 'at_ms': ms, 'waited': n}}) ELSE out END
   FROM (SELECT user_id, k, event_id, ms, ended, w, out, n, until, until IS NULL OR until <= ms AS free FROM (
     SELECT s.user_id, x.k, x.event_id, x.ms, x.ended, s.w, CASE WHEN s.until <= x.ms AND s.n > 0 THEN s.until + {DAY_MS} ELSE s.until END AS until, CASE WHEN s.until <= x.ms THEN 0 ELSE s.n END AS n,
       CASE WHEN s.until <= x.ms AND s.n > 0 THEN list_append(s.out, {{'seq': s.w, 'at_ms': s.until, 'waited': s.n}}) ELSE s.out END AS out
     FROM s JOIN x ON x.user_id = s.user_id AND x.k = s.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS name, o.seq AS seq, o.at_ms AS at_ms, o.waited AS waited FROM (SELECT user_id, unnest(arg_max(out, k)) AS o FROM s GROUP BY user_id)"""


def verdict(status: Column) -> list[Column]:
    """What a verdict of the planted catalog holds besides its package."""
    return [F.lit("2024-03-01").cast("timestamp").alias("analyzed_at"), F.lit("sha512-x").alias("integrity"), status.alias("status")]


VERDICTS = "ecosystem string, name string, version string, analyzed_at timestamp, integrity string, status string"


def to_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after the feed's job: customers' documents are the registry, which knows a newer version in the second run; suppliers' verdicts were there before."""
    path, runs = new_folder(spark, "catalog"), []
    own = lambda df, key, version: df.select(F.lit("npm").alias("ecosystem"), F.col(key).cast("string").alias("name"), F.lit(version).alias("version"))
    known = own(table(spark, sf_dir, "supplier"), "s_suppkey", "1.1")
    catalog.upsert(spark, known.select("*", *verdict(F.lit("block"))), path)

    def registry(spark: SparkSession) -> DataFrame:
        k = F.col("c_custkey")
        tags = F.when(k % 7 > 0, F.lit(f'{{"dist-tags":{{"latest":"1.{len(runs)}"}}}}')).otherwise("{}")
        return table(spark, sf_dir, "customer").select(F.lit("npm").alias("ecosystem"), k.cast("string").alias("name"), tags.alias("value"))

    def run(log: str, at: str) -> None:
        runs.append(log)
        status = F.when(F.length("name") % 2 == 0, "clean").otherwise("warn")
        feed.to_catalog(spark, log, at, registry, path, VERDICTS, lambda todo: todo.select("ecosystem", "name", "version", *verdict(status))).awaitTermination()

    replayed(event_lines(spark, sf_dir), run)
    return catalog.read(spark, path, VERDICTS).select("name", "version", "status")


TO_CATALOG_SQL = """WITH e AS (SELECT DISTINCT user_id AS k, CASE WHEN event_id <= (SELECT avg(event_id) FROM events) THEN '1.1' ELSE '1.2' END AS version FROM events WHERE event_type <> 'error')
SELECT CAST(k AS VARCHAR) AS name, version, CASE WHEN length(CAST(k AS VARCHAR)) % 2 = 0 THEN 'clean' ELSE 'warn' END AS status FROM e
 WHERE k IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 > 0) AND NOT (version = '1.1' AND k IN (SELECT s_suppkey FROM supplier))
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), '1.1', 'block' FROM supplier"""


def capability_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions that come in order of their keys, not of their dates: each against the newest five that have come."""
    out = new_folder(spark, "differences")
    rows = catalogue.order_versions(spark, sf_dir)
    fields = [F.col(c).cast("string").alias(c) for c in ("name", "version")] + [F.unix_millis(F.col("published_at").cast("timestamp")).alias("published"), "capabilities", "status", "complete"]
    value = F.to_json(F.struct(F.col("version").alias("seq"), F.col("name").cast("string").alias("id"), F.struct(*fields).alias("v")))

    def run(log: str, at: str) -> None:
        kind = "v STRUCT<name: STRING, version: STRING, published: LONG, capabilities: ARRAY<STRING>, status: STRING, complete: BOOLEAN>"
        verdicts = change_log.read_stream(spark, log).select("seq", F.from_json("value", kind).alias("x")).select("seq", "x.v.*")
        verdicts = verdicts.select(F.lit("npm").alias("ecosystem"), "name", "version", "seq", F.timestamp_millis("published").alias("published_at"), "capabilities", "status", "complete")
        started(state.capability_changes(verdicts), out, at)

    replayed(rows.select(F.col("version").alias("seq"), value.alias("value")), run)
    return spark.read.parquet(out).select("name", "version", "outcome", F.array_join(F.sort_array("introduced"), ",").alias("introduced"))


CAPABILITY_SQL = catalogue.PARITY_SQL.replace("ORDER BY o.ts DESC, o.version DESC", "ORDER BY o.ts DESC, CAST(o.version AS VARCHAR) DESC").replace("AND o.version <> a.version", "AND o.version < a.version")
CAPABILITY_SQL = f"SELECT CAST(name AS VARCHAR) AS name, CAST(version AS VARCHAR) AS version, outcome, introduced FROM ({CAPABILITY_SQL})"

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "feed_source_resumed": (source_resumed, SOURCE_SQL),
    "feed_in_flight": (in_flight, IN_FLIGHT_SQL),
    "feed_to_catalog": (to_catalog, TO_CATALOG_SQL),
    "capability_state": (capability_state, CAPABILITY_SQL),
}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items()}
