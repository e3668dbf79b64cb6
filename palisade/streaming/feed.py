"""The registry's change feed as a stream, the job that keeps the catalog current from it, and the exact token budget as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.operators import stage2
from palisade.sources import catalog, change_log

CHANGE = "seq LONG, id STRING, deleted BOOLEAN"


def changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(seq, id, deleted) of line-delimited JSON; heartbeats and lines that don't parse are dropped."""
    row = F.from_json(F.col(column), CHANGE)
    return lines.select(row.alias("r")).where("r.seq IS NOT NULL AND r.id IS NOT NULL").select("r.seq", "r.id", F.coalesce("r.deleted", F.lit(False)).alias("deleted"))


def pending(batch: DataFrame, since: int = -1) -> DataFrame:
    """Packages to look at: of each the last change after `since`; tombstones only move the cursor."""
    live = batch.where((F.col("seq") > since) & ~F.col("deleted"))
    return live.groupBy("id").agg(F.max("seq").alias("seq"))


def follow(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 16) -> StreamingQuery:
    """Runs handle(pending packages, batch id) on each batch of feed files that have come.

    The offset is committed only after handle has returned, so a failed batch comes again; handle must be idempotent,
    as the catalog's upsert is.
    """
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    run = lambda batch, n: handle(pending(batch), n)
    return changes(stream).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: each batch has a folder of its own, which a batch that comes again replaces."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")


def to_catalog(
    spark: SparkSession, log: str, checkpoint: str, registry: Callable[[SparkSession], DataFrame], path: str, schema, analyze: Callable[[DataFrame], DataFrame], since: int = -1, ecosystem: str = "npm"
) -> StreamingQuery:
    """Keeps the catalog at path current from the change log: one job, on what has come since its checkpoint.

    In each batch the changes of a package are one; tombstones only move the offset. registry gives the registry's documents
    (ecosystem, name, value), read anew for each batch, which say what each package's latest version is (of packages that they don't have,
    or that have none, nothing is scanned); so of a burst of versions only the newest is. They are read once in a batch, and only those of
    changed packages are parsed. What the catalog has already is left out, and analyze
    gives verdicts for the rest, which are put. The offset is committed after that: a batch that comes again finds its
    verdicts there and changes nothing. A version for which analyze gives no verdict is tried again with its package's next change.
    """

    def handle(batch: DataFrame, n: int) -> None:
        names = pending(batch).select(F.lit(ecosystem).alias("ecosystem"), F.col("id").alias("name"))
        documents = registry(batch.sparkSession).join(names, ["ecosystem", "name"], "left_semi")
        newest = catalog.documented_latest(documents).select("ecosystem", "name", F.col("latest").alias("version")).distinct().persist()
        try:
            wanted = newest.where("version IS NOT NULL")  # after what is stored: below the join it would parse all documents
            todo = catalog.missing(wanted, catalog.read_for(batch.sparkSession, wanted, path, schema))
            catalog.upsert(batch.sparkSession, analyze(todo), path)
        finally:
            newest.unpersist()

    changes = change_log.read_stream(spark, log, since, CHANGE)
    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def budget(calls: DataFrame, caps: stage2.Caps = stage2.Caps()) -> DataFrame:
    """stage2.greedy_budget of streaming calls, by state for each pool; batches must come in time order."""

    def of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = stage2.Pool(caps, state.get if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["at", "call_id"])  # of one batch
        yield pd.DataFrame({"pool": key[0], "call_id": rows["call_id"], "admitted": pool.admit(rows)})
        state.update(pool.state())

    return stage2.timed(calls).groupBy("pool").applyInPandasWithState(of, stage2.ADMITTED, stage2.Pool.STATE, "append", GroupStateTimeout.NoTimeout)
