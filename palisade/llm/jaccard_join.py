"""Operator 10: n-gram Jaccard join, size-aware, heavy and light.

Documents with equal sets are one class. Two classes link when their sets' Jaccard similarity reaches num / den.
Small sets (up to a boundary) and their partners enumerate the subsets of exactly the size that a link must share;
classes with a common subset meet. Large sets are put into inverted lists under the rarest elements of their sets,
as many as a linked partner must share one of; lists are scanned for members of compatible sizes. The boundary is
where enumerating gets dearer than scanning, by the sizes and the list lengths that the corpus has.

Short lists give their pairs, sifted by sketches that bound how much two sets differ, and a pair joins the pivot of its
cluster; each longer list names a pivot. Lists that may be very long (by a bound known before they are made) are never
sorted whole: their histograms by size give the same pivots. All members of a pivot's lists or pairs meet in one group
or, beyond BLOCK members, in blocks that share some leaders. There sets are compared exactly; pairs that are connected
already, or that a bitmap rules out, are not compared at all. Where members are still in different components afterwards, those
outside a pivot's largest component meet all others, but by their sketches: 64 bytes each, in blocks of up to WIDE members, of which
only pairs that the sketches don't rule out move their texts. So templates, documents alike but not alike enough, cost what their sketches cost.
Sets too large for their sketches to say much, and members with more than FEW possible partners, meet by their texts, block
by block. Components come from those links.

Ids must be integers (text ids that are no numbers fail). A row without doc_id keeps its size and has no component.
Null or empty texts have empty sets, linked with nothing. Repeated rows are copies; of equal ids with different texts
all links count. An empty table gives an empty result. Only the id and text columns are read. Words and shingles are
compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import made, masked, remove, unmasked, written
from palisade.llm.shingles import mixed, shingle_sets, signature
from palisade.llm.token_counts import slices

#: Buckets of the table that tells rare elements from frequent ones (fixed, so it may be broadcast).
BUCKETS, CHUNK = 1 << 20, 1 << 15
#: Partitions whose tables are summed in one group, before the sums are summed.
GATHERED = 128
#: Lists up to this length give their pairs, which a sketch of each class then sifts; longer ones a pivot.
PAIRED, SKETCH = 8, 8  # 64-bit words of a sketch
#: Classes compared in one group; leaders that the blocks of a larger group share (as expected).
BLOCK, LEADERS = 64, 8
#: Members of a block whose sketches are compared, partners up to which a member's texts are compared with it alone, and how
#: many elements two linked sets may differ in for sketches to be worth comparing (a fifth of the sketch's bits).
WIDE, FEW, TELLING = 16_384, 32, 96
#: Rows that a list may have, by the counts of its elements, for it to be sorted in one task.
LISTED = 100_000
#: Bits of the table that tells whose texts are needed (8 MB, fixed), and salts that spread the rows of one key.
MARKS, SALTS = 1 << 26, 32
#: Largest set for which subsets may be enumerated, whatever the costs.
MOST_SMALL = 24


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    return -(-num * (a + b) // (num + den))


def partner_sizes(n: int, num: int, den: int) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def subset_sizes(n: int, boundary: int, num: int, den: int) -> set[int]:
    """Sizes of the subsets that a set of size n enumerates: for partners such that the smaller set is small."""
    return {least_overlap(n, m, num, den) for m in partner_sizes(n, num, den) if min(n, m) <= boundary and m > 0}


def list_length(counts: np.ndarray, num: int, den: int) -> float:
    """How long the lists are on average that rare elements, the share 1 - num / den of all, are found in."""
    held = np.sort(counts[counts > 0]).astype(np.float64)
    upto = np.searchsorted(np.cumsum(held), held.sum() * (1 - num / den)) + 1
    return float((held[:upto] ** 2).sum() / held[:upto].sum()) if len(held) else 1.0


def best_boundary(sizes: dict[int, int], num: int, den: int, length: float) -> int:
    """The boundary with the least rows enumerated and scanned; sizes: documents by the sizes that come into question; length: of a list."""

    def cost(x: int) -> float:
        small = sum(k * sum(math.comb(n, c) for c in subset_sizes(n, x, num, den)) for n, k in sizes.items())
        return small + sum(k * prefix_length(n, num, den) * length for n, k in sizes.items() if n > x)

    return min(range(MOST_SMALL + 1), key=lambda x: (cost(x), -x))


def _bucket_counts(size: int):
    """How often elements of each bucket occur in a partition's sets, and last how many sets have each (small) size."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(BUCKETS, dtype=np.int64), np.zeros(CHUNK, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                sets = shingle_sets(part, size)
                elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                counts += np.bincount((elements % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                sizes += np.bincount([min(len(s), CHUNK - 1) for s in sets], minlength=CHUNK)
        if sizes.any():
            parts = [*counts.reshape(-1, CHUNK), sizes]
            own = TaskContext.get().partitionId() // GATHERED
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(parts)), pa.int32()), "part": pa.array([own] * len(parts), pa.int32()), "counts": [zlib.compress(p.tobytes(), 1) for p in parts]})

    return of


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum((np.frombuffer(zlib.decompress(b), dtype=np.int64) for b in frame["counts"]), np.zeros(CHUNK, np.int64))
    return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "part": frame["part"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def frequencies(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables over all documents; BUCKETS and CHUNK entries, whatever the corpus."""
    schema = "chunk int, part int, counts binary"
    parts = docs.select(text).mapInArrow(_bucket_counts(size), schema).groupBy("chunk", "part").applyInPandas(_summed, schema)
    out = np.zeros((BUCKETS // CHUNK + 1, CHUNK), dtype=np.int64)
    for row in parts.groupBy("chunk").applyInPandas(_summed, schema).collect():
        out[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return out[:-1].reshape(-1), out[-1]


def _keys(s: np.ndarray, table: np.ndarray, boundary: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set's class is listed (hashes of subsets, and its rarest elements), and bounds of those lists' lengths."""
    n, out, most = len(s), [], []
    held = table[(s % np.uint64(BUCKETS)).astype(np.int64)]
    for c in subset_sizes(n, boundary, num, den):
        spread = mixed(s)
        at = np.array(list(combinations(range(n), c)), dtype=np.int64).reshape(-1, c)
        out.append(mixed(spread[at].sum(axis=1, dtype=np.uint64) + np.uint64(2 * c + 1) * np.uint64(0x9E3779B97F4A7C15)))
        most.append(held[at].min(axis=1))
    if n > boundary:
        order = np.lexsort((s, held))[: prefix_length(n, num, den)]
        out.append(s[order])
        most.append(held[order])
    keys, first = np.unique(np.concatenate(out), return_index=True)
    return keys.view(np.int64), np.concatenate(most)[first]


def _sketch(s: np.ndarray) -> np.ndarray:
    """For each of the sketch's bits whether an odd number of elements falls there: where two sketches differ, so do the sets."""
    odd = np.bincount(((s >> np.uint64(33)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


INDEX = "id long, n long, class long, more long, part int, keys array<long>, hot array<long>, sketch array<long>"


def _index(table, boundary: int, num: int, den: int, size: int):
    """A row for each document; keys and sketch at the first of a set in its partition only."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = table.value, set()
        part = TaskContext.get().partitionId()
        for batch in batches:
            n_, class_, more_, keys, hot, sketches, at = [], [], [], [], [], [], 0
            for texts in slices(batch.column("text")):
                for s in shingle_sets(texts, size):
                    c = signature(s)
                    new = len(s) > 0 and c not in seen and batch.column("id")[at].is_valid
                    if len(seen) > 1_000_000:
                        seen.clear()
                    at += 1
                    n_.append(len(s))
                    class_.append(c[0])
                    more_.append(c[1])
                    if not new:  # copies in this partition: once
                        keys.append(None), hot.append(None), sketches.append(None)
                        continue
                    seen.add(c)
                    own, most = _keys(s, counts, boundary, num, den)
                    keys.append(own[most <= LISTED])
                    hot.append(own[most > LISTED])
                    sketches.append(_sketch(s))
            longs, lists = pa.int64(), pa.list_(pa.int64())
            columns = [batch.column("id"), pa.array(n_, longs), pa.array(class_, longs), pa.array(more_, longs), pa.array([part] * at, pa.int32()), pa.array(keys, lists), pa.array(hot, lists), pa.array(sketches, lists)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "class", "more", "part", "keys", "hot", "sketch"])

    return of


def _links(num: int, den: int, size: int):
    """Spanning links among the sets of one group (text, class, more, rep, side, comp) that are similar enough.

    Sets of one component need no link; where there are two sides, pairs within one meet elsewhere.
    """

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["rep", "text", "class", "more", "side"])
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(t).decode() for t in frame["text"]]
        rows = {}  # an id may have other texts than its class's
        for s, c, more, r, side, comp in zip(shingle_sets(texts, size), *(frame[x] for x in ("class", "more", "rep", "side", "comp")), strict=True):
            if len(s) and signature(s) == (c, more):
                rows[c, more] = (s, r, side, comp)
        rows = sorted(rows.values(), key=lambda x: (len(x[0]), x[1]))
        n = np.array([len(x[0]) for x in rows], dtype=np.int64)
        side = np.array([x[2] for x in rows])
        across = len(set(side.tolist())) > 1
        # One bitmap width for all, so that they compare: bits in which two differ are elements in which they differ.
        width = 1 << max(9, min(16, int(n.max() * 4).bit_length() if len(n) else 9))
        maps = np.zeros((len(rows), width // 8), dtype=np.uint8)
        for i, (s, *_) in enumerate(rows):
            bits = np.zeros(width, dtype=np.uint8)
            bits[(s >> np.uint64(20)) % np.uint64(width)] = 1
            maps[i] = np.packbits(bits)
        maps = maps.view(np.uint64)
        root = np.unique(np.array([x[3] for x in rows], dtype=np.int64), return_inverse=True)[1]  # label of each one's component
        out = []
        for i in range(len(rows) - 1):
            end = int(np.searchsorted(n, den * n[i] // num, side="right"))
            todo = np.arange(i + 1, end)
            todo = todo[root[todo] != root[i]]
            if across:
                todo = todo[side[todo] != side[i]]
            if not len(todo):
                continue
            differ = np.bitwise_count(maps[todo] ^ maps[i]).sum(axis=1).astype(np.int64)
            sums = n[todo] + n[i]
            overlap = (num * sums + num + den - 1) // (num + den)
            todo = todo[differ <= sums - 2 * overlap]
            for j in todo.tolist():
                if root[j] == root[i]:
                    continue
                shared = len(np.intersect1d(rows[i][0], rows[j][0], assume_unique=True))
                if shared * den >= num * (n[i] + n[j] - shared):
                    out.append((rows[i][1], rows[j][1]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return of


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable; edges (a, b). Large and small stars in turn, until nothing changes."""
    spark, before = edges.sparkSession, len(made())
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "small")
        check = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        done = check(after) == check(edges)
        remove(spark, made()[before:-1])
        if done:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = after


def _cold_lists(indexed: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, long): pivot and class of long lists, pairs of classes of short ones. A list here has LISTED rows at most."""
    listed = indexed.where("size(keys) > 0").select(F.explode("keys").alias("key"), "class", "n")
    # Along a list in order of size, a step that no similarity can bridge ends a run; who has nobody within reach, and second rows of a class, go at once.
    order = Window.partitionBy("key").orderBy("n", "class")
    bridged = lambda a, b: F.coalesce(F.col(a) * den >= F.col(b) * num, F.lit(False))
    runs = listed.withColumns({"was": F.lag("class").over(order), "below": F.lag("n").over(order), "above": F.lead("n").over(order)})
    runs = runs.where((bridged("below", "n") | bridged("n", "above")) & ~F.coalesce(F.col("was") == F.col("class"), F.lit(False)))
    runs = runs.withColumn("run", F.sum((~bridged("below", "n")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy("key", "run")
    after = F.collect_list("class").over(run.orderBy("class").rowsBetween(1, PAIRED - 1))
    runs = runs.withColumns({"pivot": F.min(F.xxhash64("class")).over(run), "m": F.count(F.lit(1)).over(run), "after": after}).where("m > 1")
    # One pass over the lists gives both: (pivot, class) of long ones and the pairs (x < y) of short ones.
    row = lambda x, y, long_: F.struct(x.alias("x"), y.alias("y"), F.lit(long_).alias("long"))
    given = F.when(F.col("m") > PAIRED, F.array(row(F.col("pivot"), F.col("class"), True))).otherwise(F.transform("after", lambda y: row(F.col("class"), y, False)))
    return runs.select(F.explode(given).alias("r")).select("r.*")


def _hot_lists(indexed: DataFrame, num: int, den: int) -> DataFrame:
    """The same of lists that may be longer: only their histograms (a row for each size, summed before they move) are put in order."""
    listed = indexed.where("size(hot) > 0").select(F.explode("hot").alias("key"), "class", "n")
    sums = listed.groupBy("key", "n").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.xxhash64("class")).alias("pivot"))
    order = Window.partitionBy("key").orderBy("n")
    bridged = lambda a, b: F.coalesce(F.col(a) * den >= F.col(b) * num, F.lit(False))
    sums = sums.withColumns({"below": F.lag("n").over(order), "above": F.lead("n").over(order)})
    sums = sums.withColumn("run", F.sum((~bridged("below", "n")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = sums.where(bridged("below", "n") | bridged("n", "above") | (F.col("low") != F.col("high")))
    run = Window.partitionBy("key", "run")
    sums = sums.withColumns({"pivot": F.min("pivot").over(run), "several": F.min("low").over(run) != F.max("high").over(run)}).where("several")
    sums = sums.select("key", "n", "pivot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = listed.withColumn("salt", F.pmod(F.xxhash64("class", F.lit(3)), F.lit(SALTS)).cast("int"))
    return salted.join(sums, ["key", "n", "salt"]).select(F.col("pivot").alias("x"), F.col("class").alias("y"), F.lit(True).alias("long"))


def _drawn(indexed: DataFrame) -> DataFrame:
    """(class, n, s0, s1, ..): each class's size and sketch. Two sets that share a class's number, if ever, have no sketch."""
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    firsts = indexed.where("sketch IS NOT NULL")
    return firsts.groupBy("class").agg(same(F.col("n")).alias("n"), *[same(F.col("sketch")[i]).alias(f"s{i}") for i in range(SKETCH)])


def _sifted(pairs: DataFrame, drawn: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that their sketches don't rule out."""
    words_ = [f"s{i}" for i in range(SKETCH)]
    side = lambda name: drawn.toDF(name, *[f"{c}_{name}" for c in drawn.columns[1:]])
    pairs = pairs.join(side("x"), "x").join(side("y"), "y")
    differ = sum((F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in words_[1:]), F.bit_count(F.col("s0_x").bitwiseXOR(F.col("s0_y"))))
    total = F.col("n_x") + F.col("n_y")
    return pairs.where(F.coalesce(differ <= total - 2 * F.ceil(total * num / (num + den)), F.lit(True))).select("x", "y")


def _possible(num: int, den: int):
    """Pairs (x, y) of classes of one group (class, more, n, s0.., side, comp, outside) that their sketches don't rule out, from the view of those outside.

    One with more than FEW partners comes once, with no y: it is compared by texts. A class is two numbers, (x, x2) and (y, y2).
    """

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["class", "more", "side"]).sort_values(["n", "class", "more"])
        n, side, comp, class_, more = (frame[c].to_numpy(np.int64) for c in ("n", "side", "comp", "class", "more"))
        sketch = np.ascontiguousarray(frame[[f"s{i}" for i in range(SKETCH)]].to_numpy(np.int64).view(np.uint64))
        across = len(set(side.tolist())) > 1
        out = []
        for i in np.flatnonzero(frame["outside"].to_numpy(bool)).tolist():
            a, b = np.searchsorted(n, -(-num * n[i] // den)), np.searchsorted(n, den * n[i] // num, side="right")
            near = comp[a:b] != comp[i]
            if across:
                near &= side[a:b] != side[i]
            at = np.flatnonzero(near) + a
            total = n[at] + n[i]
            differ = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            at = at[differ <= total - 2 * ((num * total + num + den - 1) // (num + den))]
            own = int(class_[i]), int(more[i])
            out += [(*own, None, None)] if len(at) > FEW else [(*own, int(class_[j]), int(more[j])) for j in at.tolist()]
        # As objects first: a column that holds None as well would become floats, which round the numbers, and pairs would be lost.
        return pd.DataFrame(out, columns=["x", "x2", "y", "y2"], dtype=object).astype("Int64")

    return of


def _needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts (rep, text) whose rep is among the ids, and a few more, with their texts packed.

    A table of MARKS bits spares most others the way: MARKS / 64 rows at most, so it may be broadcast at any size.
    """
    at = F.pmod(F.xxhash64("rep", F.lit(6)), F.lit(MARKS))
    word, bit = F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, int(pmod(xxhash64(rep, 6), 64)))")
    marks = ids.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            yield pa.array([press((x.as_py() or "").encode()) for x in batch], pa.binary())

    found = texts.select("rep", "text", word).join(F.broadcast(marks), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return found.select("rep", packed("text").alias("text"))


GROUP = ["pivot", "i", "j"]


def _compared(met: DataFrame, texts: DataFrame, links) -> DataFrame:
    """Links (a, b) within the groups of met (GROUP, class, more, rep, side, comp)."""
    met = written(met, "met")
    moved = met.join(_needed(texts, met.select("rep")).hint("merge"), "rep")  # the same way at every size
    return written(moved.groupBy(*GROUP).applyInPandas(links, "a long, b long"), "links")


def _salted(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """df joined with sizes, a row for each pivot at most, so that no pivot's rows meet in one task."""
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(4)), F.lit(SALTS)).cast("int")).join(spread, ["pivot", "salt"], "left").drop("salt")


def _dealt(rows: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(rows, F.lit(1)), blocks).cast("int")


def _each(blocks: Column) -> Column:
    return F.sequence(F.lit(0), blocks - 1)


def _meeting(members: DataFrame, block: int) -> DataFrame:
    """members (pivot, rep, outside, ..) in the groups (i, j) in which those outside meet each other and all others of their pivot; side tells who meets whom.

    Pivots without members outside have no groups.
    """
    counts = members.groupBy("pivot").agg(F.count_if("outside").alias("k"), F.count(F.lit(1)).alias("m")).where("k > 0")
    blocks = counts.select("pivot", F.ceil(F.col("k") / block).cast("int").alias("outer"), F.ceil((F.col("m") - F.col("k")) / block).cast("int").alias("inner"))
    rows = _salted(members, blocks).where("outer IS NOT NULL")
    rows = rows.withColumn("at", F.when(F.col("outside"), _dealt(F.col("rep"), F.col("outer"))).otherwise(_dealt(F.col("rep"), F.greatest(F.col("inner"), F.lit(1)))))
    group = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    me = F.col("at")
    others = F.transform(_each(F.col("outer")), lambda b: group(F.least(me, b), F.greatest(me, b), F.when(me <= b, 0).otherwise(1)))
    inners = F.when(F.col("inner") > 0, F.transform(_each(F.greatest(F.col("inner"), F.lit(1))), lambda b: group(me, -b - 1, F.lit(0)))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    outers = F.transform(_each(F.col("outer")), lambda b: group(b, -me - 1, F.lit(1)))
    rows = rows.withColumn("g", F.explode(F.when(F.col("outside"), F.concat(others, inners)).otherwise(outers)))
    return rows.select("*", "g.i", "g.j", "g.side")


def _few(pairs: DataFrame) -> DataFrame:
    """pairs of _possible in groups (GROUP, class, more, side): a class (side 0) with about FEW of its partners (side 1)."""
    counts = pairs.groupBy("x", "x2").agg(F.ceil(F.count(F.lit(1)) / FEW).cast("int").alias("blocks"))
    key = [F.xxhash64("x", "x2").alias("pivot"), "i", F.lit(0).alias("j")]
    owners = counts.withColumn("i", F.explode(_each(F.col("blocks")))).select(*key, F.col("x").alias("class"), F.col("x2").alias("more"), F.lit(0).alias("side"))
    partners = pairs.join(counts, ["x", "x2"]).withColumn("i", F.pmod(F.xxhash64("y", "y2", F.lit(1)), F.col("blocks")).cast("int"))
    return owners.unionByName(partners.select(*key, F.col("y").alias("class"), F.col("y2").alias("more"), F.lit(1).alias("side")))


def join_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 9, den: int = 10, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents (id, n, rep), components (node, component) of the classes' representatives that have links)."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts, sizes = frequencies(own, "text", size)
    table = spark.sparkContext.broadcast(counts)
    boundary = best_boundary({n: int(k) for n, k in enumerate(sizes[: 2 * MOST_SMALL]) if n and k}, num, den, list_length(counts, num, den))
    indexed = written(own.mapInArrow(_index(table, boundary, num, den, size), INDEX), "index")
    reps = written(indexed.where("id IS NOT NULL AND n > 0").groupBy("class", "more").agg(F.min("id").alias("rep")), "reps")
    drawn = written(_drawn(indexed), "drawn")
    given = written(_cold_lists(indexed, num, den).unionByName(_hot_lists(indexed, num, den)).distinct(), "listed")
    long_ = given.where("long").select(F.col("x").alias("pivot"), F.col("y").alias("class"))
    near = written(_sifted(given.where("NOT long").select("x", "y"), drawn, num, den), "near")
    # A pair meets under the least pivot that either knows of, so the pairs of one cluster meet together and each text moves about once.
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    known = both.groupBy("x").agg(F.min(F.xxhash64("y")).alias("p")).select("x", F.least("p", F.xxhash64("x")).alias("p"))
    near = near.join(known.toDF("x", "p_x"), "x").join(known.toDF("y", "p_y"), "y")
    near = near.select(F.least("p_x", "p_y").alias("pivot"), F.explode(F.array("x", "y")).alias("class"))
    members = written(long_.unionByName(near).distinct().join(reps, "class"), "members")
    texts = own.where("id IS NOT NULL").withColumnRenamed("id", "rep")
    links = _links(num, den, size)
    # First every block by itself, with the leaders of its pivot.
    big = written(members.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK), "big")
    first = _salted(members, big).withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK).cast("int"), F.lit(1)))
    leads = F.coalesce(F.pmod(F.xxhash64("rep", F.lit(2)), F.col("m")) < LEADERS, F.lit(False))
    first = first.withColumn("i", F.explode(F.when(leads, _each(F.col("blocks"))).otherwise(F.array(_dealt(F.col("rep"), F.col("blocks"))))))
    first = first.select("pivot", "i", F.lit(0).alias("j"), "class", "more", "rep", F.lit(0).alias("side"), F.col("rep").alias("comp"))
    found = _compared(first, texts, links)
    labels = components(found)
    if not big.isEmpty():
        # Then, of pivots with several blocks, those outside the largest component (side 0) with each other and with all others (side 1).
        apart = members.join(F.broadcast(big.select("pivot")) if big.count() <= LISTED else big.select("pivot"), "pivot", "left_semi")
        apart = apart.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        apart = written(apart, "apart")
        most = apart.groupBy("pivot", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("pivot").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("in_main"), F.sum("k").alias("m"))
        most = most.where("in_main < m").select("pivot", "main")
        own = indexed.where("sketch IS NOT NULL").groupBy("class", "more").agg(F.first("n").alias("n"), *[F.first(F.col("sketch")[i]).alias(f"s{i}") for i in range(SKETCH)])
        apart = _salted(apart, most).where("main IS NOT NULL").withColumn("apart", F.col("comp") != F.col("main")).drop("main").join(own, ["class", "more"])
        apart = written(apart, "sketched")
        # By sketches, where they can tell; sets near that size go both ways, so that each pair goes one of them whole.
        largest = TELLING * (num + den) // (2 * (den - num))
        seen = apart.where(F.col("n") * num <= largest * den).withColumn("outside", F.col("apart"))
        viewing = ((F.col("j") >= 0) | (F.col("side") == 0)).alias("outside")
        groups = _meeting(seen, WIDE).select(*GROUP, "class", "more", "n", *[f"s{i}" for i in range(SKETCH)], "side", "comp", viewing)
        possible = written(groups.groupBy(*GROUP).applyInPandas(_possible(num, den), "x long, x2 long, y long, y2 long").distinct(), "possible")
        pairs = _few(possible.where("y IS NOT NULL")).join(reps, ["class", "more"])
        pairs = pairs.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        more = _compared(pairs.select(*GROUP, "class", "more", "rep", "side", "comp"), texts, links)
        # By texts: large sets, and those with many possible partners, each with all others of its pivot.
        many = possible.where("y IS NULL").select(F.col("x").alias("class"), F.col("x2").alias("more")).distinct().withColumn("many", F.lit(True))
        whole = apart.join(many, ["class", "more"], "left").withColumn("outside", F.col("apart") & ((F.col("n") * den > largest * num) | F.coalesce("many", F.lit(False))))
        more = more.unionByName(_compared(_meeting(whole, BLOCK).select(*GROUP, "class", "more", "rep", "side", "comp"), texts, links))
        labels = components(found.unionByName(more))
    # A class's rows meet its representative by partition of the index, so that many copies don't meet in one task.
    firsts = indexed.where("sketch IS NOT NULL").select("class", "more", "part").distinct().join(reps, ["class", "more"])
    rows = indexed.where("id IS NOT NULL AND n > 0").select("id", "n", "class", "more", "part").join(firsts, ["class", "more", "part"]).select("id", "n", "rep")
    rest = indexed.where("id IS NULL OR n = 0").select("id", "n", F.lit(None).cast("long").alias("rep"))
    return rows.unionByName(rest), labels


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 9, den: int = 10, size: int = 3) -> DataFrame:
    """(id, n, component) of every row of docs."""
    members, labels = join_links(docs, doc_id, text, num, den, size)
    out = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("id", "n", F.coalesce("component", "rep", "id").alias("component"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 9, den: int = 10, size: int = 3) -> DataFrame:
    """The rows of docs whose id is their component's, and all rows without an id; of a repeated id the row with the least hash of its text, then of the others."""
    inner, of = masked(docs)
    key, own = of[doc_id], of[text]
    kept = near_components(inner, key, own, num, den, size).where("id = component").select("id").distinct()
    out = inner.join(kept, F.col(key) == F.col("id"), "left_semi")
    order = F.struct(F.xxhash64(own), F.col(own), F.xxhash64(*[c for c in inner.columns if c not in (key, own)], F.lit(0)))
    out = out.groupBy(key).agg(F.min_by(F.struct(*[c for c in inner.columns if c != key]), order).alias("x")).select(key, "x.*")
    return unmasked(out.unionByName(inner.where(F.col(key).isNull())), of)
