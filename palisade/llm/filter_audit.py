"""Operator 12: filter interaction audit. What each filter removes in every order that the filters may be applied in.

Each document gets a mask of the filters that it fails. Four filters look at the text alone. The fifth, duplicates, is found
by sorting: rows are range-partitioned by (text fingerprint, doc_id), so that many copies of one text spread over
several partitions, and sorted inside by (fingerprint, full text, doc_id); a row equal to its predecessor in text and greater in
doc_id than the first of its run is a duplicate. Only runs at a partition's first fingerprint may have begun before it: those
wait until the runs at the partitions' edges (a few rows a partition) have been compared, by full text again.

The masks are then additive counters: at most 32 for each part, summed before they move, from which all orders and steps
follow by arithmetic; labels are counted by an inner join and added.

Null texts are empty. Rows without doc_id are equal to no smaller one, make no other row a duplicate and have no label. Rows of equal
doc_id aren't each other's duplicates. A document has a label if any of its rows in `labels` says so. Null sources are
the part ''. Other columns play no part, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SPACES, written

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
SYMBOLS = "#$%&*|"
SUBSETS = 1 << len(FILTERS)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that the text (not null) fails."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    # One array of words for both conditions on them.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))[0]
    few = F.transform(F.array(counts), lambda c: F.when(c["n"] < 200, 1).otherwise(0) + F.when(100 * c["d"] < 50 * c["n"], 2).otherwise(0))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    shouting = 100 * capitals.cast("long") > 2 * F.length(text).cast("long")
    return few + F.when(shouting, 4).otherwise(0) + F.when(text.rlike(f"[{SYMBOLS}]"), 8).otherwise(0)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, text, doc_id, source, mask) with what the partition alone can say of duplicates.

    run numbers the runs at the partition's first fingerprint, whose first rows wait (-1: decided). One row more for each run at the
    first or last fingerprint, which may go on in other partitions, has its text and least doc_id, and no mask.
    """
    part = TaskContext.get().partitionId()
    first_fp, opened, at_first, at_last = None, None, [], []  # a run: fp, text, least doc_id, number
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp, text, key, source = (batch.column(c) for c in ("fp", "text", "doc_id", "source"))
        fps, keys, mask = fp.to_pylist(), key.to_pylist(), batch.column("mask").to_pylist()
        first_fp = fps[0] if first_fp is None else first_fp
        same = [opened is not None and opened[0] == fps[0] and opened[1] == text[0].as_py()]
        if n > 1:
            same += pc.and_(pc.equal(fp[1:], fp[:-1]), pc.equal(text[1:], text[:-1])).to_pylist()
        run = []
        for at in range(n):
            if not same[at]:
                opened = (fps[at], text[at].as_py(), keys[at], len(at_first) if fps[at] == first_fp else -1)
                if opened[3] >= 0:
                    at_first.append(opened)
                else:
                    at_last = [x for x in at_last if x[0] == fps[at]] + [opened]
            if keys[at] == opened[2]:
                run.append(opened[3])
            else:  # its run has a smaller id here
                run.append(-1)
                mask[at] |= DUPLICATE
        columns = {"doc_id": key, "source": source, "mask": pa.array(mask, pa.int32()), "run": pa.array(run, pa.int32()), "text": pa.nulls(n, pa.string())}
        yield pa.RecordBatch.from_pydict({**columns, "part": pa.array([part] * n, pa.int32())})
    if edges := at_first + at_last:
        n, (_, texts, least, runs) = len(edges), zip(*edges, strict=True)
        columns = {"doc_id": pa.array(least, key.type), "source": pa.nulls(n, pa.string()), "mask": pa.nulls(n, pa.int32()), "run": pa.array(runs, pa.int32()), "text": pa.array(texts, pa.string())}
        yield pa.RecordBatch.from_pydict({**columns, "part": pa.array([part] * n, pa.int32())})


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, mask) of every row of docs."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The last key deals out rows that are equal in text and id.
    ranged = own.where("doc_id IS NOT NULL").withColumn("fp", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange("fp", "doc_id", "salt").sortWithinPartitions("fp", "text", "doc_id")
    rows = ranged.select("fp", "text", "doc_id", "source", text_mask(F.col("text")).cast("int").alias("mask"))
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = written(rows.mapInArrow(_runs, f"doc_id {kind}, source string, mask int, run int, text string, part int"), "runs")
    # Runs at edges: a waiting row is a duplicate where an earlier one of its text has a smaller id.
    edges = rows.where("mask IS NULL").select("text", "doc_id", "part", "run")
    least = edges.groupBy("text").agg(F.min("doc_id").alias("least"))
    late = edges.where("run >= 0").join(least, "text").where("doc_id > least").select("part", "run", F.lit(True).alias("late"))
    decided = rows.where("run < 0 AND mask IS NOT NULL").select("doc_id", "source", "mask")
    waiting = rows.where("run >= 0 AND mask IS NOT NULL").join(late, ["part", "run"], "left")
    waiting = waiting.select("doc_id", "source", F.when(F.col("late"), F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    alone = own.where("doc_id IS NULL").select("doc_id", "source", text_mask(F.col("text")).cast("int").alias("mask"))
    return decided.unionByName(waiting).unionByName(alone)


def counters(masked_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and of those the ones with labels."""
    counted = written(masked_docs.groupBy("doc_id", F.col("source").alias("part"), "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    labelled = counted.join(said, "doc_id").groupBy("part", "mask").agg(F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    zero = F.lit(0).cast("long")
    both = counted.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(labelled.select("part", "mask", zero.alias("n"), "good", "toxic"))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    counted = counters(masks(docs), labels)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # 32 at most
    total = lambda what, holds: F.aggregate(F.filter("c", holds), F.lit(0).cast("long"), lambda a, x: a + x[what])
    fails = lambda x, bits: x["mask"].bitwiseAND(bits) != 0
    outside = lambda bits: lambda x: ~fails(x, F.lit(bits))
    left = lambda what: F.array(*[total(what, outside(s)) for s in range(SUBSETS)])  # noqa: E731  after the filters of each subset
    # Of the 120 orders a document that fails k filters is removed by each of them in 120 / k.
    split = lambda x: (F.lit(math.factorial(len(FILTERS))) / F.bit_count(x["mask"])).cast("long")
    each = lambda f: F.struct(
        total("n", lambda x: fails(x, F.lit(1 << f))).alias("failing"),
        total("n", lambda x: x["mask"] == (1 << f)).alias("only"),
        F.aggregate(F.filter("c", lambda x: fails(x, F.lit(1 << f))), F.lit(0).cast("long"), lambda a, x: a + x["n"] * split(x)).alias("shapley"),
    )
    parts = parts.select("part", *[left(w).alias(w) for w in ("n", "good", "toxic")], F.array(*[each(f) for f in range(len(FILTERS))]).alias("filters"))
    out = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])))
    out = out.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda upto: F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i <= {upto}), 0, (a, i) -> a + shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1))")
    out = out.withColumns({"before": bits("step - 1"), "after": bits("step"), "filter": F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1")})
    gone = lambda what: F.get(F.col(what), F.col("before")) - F.get(F.col(what), F.col("after"))
    of = F.get(F.col("filters"), F.col("filter"))
    return out.select(
        "part", "filter_order", "step",
        F.get(F.col("n"), F.col("after")).alias("kept"),
        gone("n").alias("removed"),
        (of["failing"] - gone("n")).alias("redundant"),
        of["only"].alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        of["shapley"].alias("shapley"),
    )
