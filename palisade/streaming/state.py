"""State of the change feed over batches: packages under analysis, and the newest verdicts of each package.

Both are stateful processors by (ecosystem, name). They need the RocksDB state store, which `prepared` sets. A key's rows
of one batch are put in order; across batches they must come in that order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.operators import history

KEY = ["ecosystem", "name"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    """The state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InFlight(StatefulProcessor):
    """Which changes start an analysis.

    A change starts one unless its package is under analysis already; then it waits. When the analysis ends (a row with
    ended), or after `timeout` milliseconds, the last waiting change starts the next one, so none is lost; with none waiting
    the package is free. Timers do this for packages of which no further row comes.
    """

    OUT = "ecosystem string, name string, seq long, at_ms long, waited long"

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "until long, seq long, n long")  # the analysis' end; the last change that waits, and how many

    def _ended(self, key: tuple, at: int, seq: int | None, n: int) -> tuple[list[Row], tuple | None]:
        """The analysis is over: the last change that waits starts the next one. Gives that start and what is held then."""
        return ([self._start(key, seq, at, n)], (at + self.timeout, None, 0)) if n else ([], None)

    def _start(self, key: tuple, seq: int, at: int, waited: int) -> Row:
        return Row(ecosystem=key[0], name=key[1], seq=seq, at_ms=at, waited=waited)

    def _hold(self, before: tuple | None, held: tuple | None) -> None:
        """Each call of the state is a message to the JVM: so there is one of each kind for a key and batch, and none for what hasn't changed."""
        if held == before:
            return
        was, until = before and before[0], held and held[0]
        if was != until:
            if was is not None:
                self.handle.deleteTimer(was)
            if until is not None:
                self.handle.registerTimer(until)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = held = self._get()
        for at, seq, ended in sorted((r["at_ms"], r["seq"], bool(r["ended"])) for r in rows):
            while held is not None and held[0] <= at:  # timed out before this row came
                started, held = self._ended(key, *held)
                yield from started
            if ended:
                if held is not None:
                    started, held = self._ended(key, at, *held[1:])
                    yield from started
            elif held is None:
                held = (at + self.timeout, None, 0)
                yield self._start(key, seq, at, 0)
            else:
                held = (held[0], seq, held[2] + 1)
        self._hold(before, held)

    def _get(self) -> tuple | None:
        found = self.held.get()
        return found and tuple(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._get()
        if before is not None and before[0] == expiredTimerInfo.getExpiryTimeInMs():
            started, held = self._ended(key, *before)
            yield from started
            self._hold(before, held)


def in_flight(changes: DataFrame, timeout: int, lateness: str = "0 seconds") -> DataFrame:
    """(ecosystem, name, seq, at_ms, waited) of the analyses that start; changes: a stream (ecosystem, name, seq, at, ended).

    waited is the number of changes that waited for the start, itself included (0: it was free at once). A timer fires in the first batch after
    the watermark of `at` has passed it.
    """
    prepared(changes.sparkSession)
    rows = changes.withWatermark("at", lateness).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy(*KEY).transformWithState(InFlight(timeout), InFlight.OUT, "Append", "EventTime")


class Newest(StatefulProcessor):
    """The newest verdicts of each package as they come, and each one's capability difference against those before it.

    The baseline of a verdict are the newest `window` of the other versions that have come so far, by publication, later
    published ones included. As later verdicts only push older ones out, the newest window + 1 are all that is ever needed:
    the state of a package is of fixed size, however long its history.
    """

    OUT = "ecosystem string, name string, version string, outcome string, introduced array<string>"

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value, as each call of the state is a message to the JVM; and as JSON, as it and rows with many columns take far longer to convert.
        self.newest = handle.getValueState("newest", "versions string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.newest.get()
        known = {version: tuple(value) for version, *value in json.loads(found[0])} if found else {}
        before = dict(known)
        for row in sorted((json.loads(r["verdict"]) for r in rows), key=lambda r: r["seq"]):
            version, own = row.get("version"), (row["published_ms"], row.get("capabilities") or [], row.get("status"), row["complete"])
            others = sorted(((v[0], k, *v[1:]) for k, v in known.items() if k != version), key=lambda x: x[:2], reverse=True)[: self.window]
            outcome, introduced = self._compared(own[1], others)
            yield Row(ecosystem=key[0], name=key[1], version=version, outcome=outcome, introduced=introduced)
            known[version] = own
            known = dict(sorted(known.items(), key=lambda x: (x[1][0], x[0]), reverse=True)[: self.window + 1])
        if known != before:
            self.newest.update((json.dumps([(version, *value) for version, value in known.items()]),))

    def _compared(self, capabilities: list[str], others: list[tuple]) -> tuple[str, list[str]]:
        """The checks of history.outcome, in their order."""
        if others and others[0][3] == "malicious":
            return "abstained_poisoned_baseline", []
        if not others:
            return "not_attempted", []
        if len(others) < self.window or not all(o[4] for o in others):
            return "abstained_baseline_incomplete", []
        seen = {c for o in others for c in o[2] or []}
        return "produced", [c for c in dict.fromkeys(capabilities) if c not in seen]


def capability_changes(verdicts: DataFrame, window: int = history.WINDOW) -> DataFrame:
    """(ecosystem, name, version, outcome, introduced) of each verdict of a stream (.., version, seq, published_at, capabilities, status, complete).

    seq is the order in which a package's verdicts have come. No package's history is read.
    """
    prepared(verdicts.sparkSession)
    published = F.coalesce(F.unix_millis(F.col("published_at").cast("timestamp")), F.lit(-(1 << 62)))
    own = F.struct(F.col("version").cast("string").alias("version"), "seq", published.alias("published_ms"), "capabilities", "status", F.coalesce("complete", F.lit(False)).alias("complete"))
    rows = verdicts.select(*KEY, F.to_json(own).alias("verdict"))
    return rows.groupBy(*KEY).transformWithState(Newest(window), Newest.OUT, "Append", "None")

