"""Operator 6: exact top-k search by inner product, with cover trees over queries and data.

Rows are dealt to cells around a bounded sample of pivots, and cells to blocks of bounded size; each block gets a
cover tree of its own, and so does each group of queries. A query group is searched against one block of its cell
first, which gives every query a kth score to beat; all other pairs of groups and blocks are then ruled out by their
roots where even the covering radii leave no better score, or searched: a data node is pruned by the bound
centre * centre + |q| r + |p| s + r s against the worst kth score of the query node. A block's tree moves once for up to
GROUPS query groups, which stream past it. Every row is indexed and scores are exact integers, so the results are
exact. How much is pruned depends on the data: where all vectors are about equally far apart, nothing can be.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without id. Scores that
no long holds become the nearest long. A query meets candidates of its own length only. Candidates with the query's
id are its own rows; a repeated query id is asked once, with its least vector. Ties go to the smaller id. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import written

#: Sample that the layout is made from (results don't depend on it), and rows of a block of data and of a group of queries.
PIVOTS, BLOCK, QUERY_BLOCK = 1024, 16_384, 1024
#: Query groups that one copy of a block's tree serves, and leaves that a query leaf is scored against before it looks again.
GROUPS, LEAVES = 32, 8
#: Rows of a leaf of data and of queries, and how scales shrink.
LEAF, QUERY_LEAF, BASE = 64, 8, 1.5
SALTS = 32
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def takes_part(vector: Column) -> Column:
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fits, F.lit(False))


def scaled(vectors: np.ndarray, factor: float = 1024.0) -> np.ndarray:
    """floor(factor * x), as the narrowest integers that hold all (Python's own for components beyond 2^53)."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * factor)
    most = np.abs(out).max(initial=0.0)
    if most >= 2.0**53:
        return np.array([[math.floor(x * factor) if abs(x) < 2.0**900 else int(x) * int(factor) for x in row] for row in vectors.tolist()], dtype=object)
    return out.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


class Tree:
    """A cover tree laid out in arrays; node i covers rows start[i]:end[i], within radius[i] of the row centre[i], its own.

    Level by level, with scales that shrink by BASE: the centres of a level are those of the level above and rows more
    than the scale away from all of them, until every row is within the scale of one; a new centre's parent is the
    centre nearest to it on the level above. Nodes of up to `leaf` rows stay leaves.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        with np.errstate(all="ignore"):
            # Integers beyond any float only ever widen: their norms are infinite, and what has no finite radius is never pruned.
            self._grow(ids, rows, np.clip(rows, -(10**308), 10**308).astype(np.float64) if rows.dtype == object else rows.astype(np.float64))

    def _grow(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray) -> None:
        first = int(np.nan_to_num(np.linalg.norm(points - points.mean(axis=0), axis=1), nan=np.inf).argmin())
        near = np.linalg.norm(points - points[first], axis=1)
        owner = np.zeros(len(points), dtype=np.int64)  # each row's nearest centre, as a place in at
        at, below, sizes = [first], [[]], [len(points)]  # below: (level, centre) of the centres whose parent this one is
        self.scales = [float(near.max())]
        open_ = np.full(len(points), len(points) > self.leaf and np.isfinite(self.scales[0]))
        while (open_ & (near > 0)).any():
            self.scales.append(self.scales[-1] / BASE)
            before = owner.copy()
            while True:
                far = np.where(open_, near, -1.0)
                new = int(far.argmax())
                if far[new] <= self.scales[-1]:
                    break
                d = np.linalg.norm(points - points[new], axis=1)
                closer = np.flatnonzero((d < near) & open_)  # the rows of a leaf stay
                for o, m in zip(*np.unique(owner[closer], return_counts=True), strict=True):
                    sizes[o] -= m
                below[before[new]].append((len(self.scales) - 1, len(at)))
                owner[closer], near[closer] = len(at), d[closer]
                at.append(new)
                below.append([])
                sizes.append(len(closer))
                open_ = (np.array(sizes) > self.leaf)[owner]
        self.at, self.below = np.array(at), below
        members = np.split(np.argsort(owner, kind="stable"), np.cumsum(sizes)[:-1])
        # A centre is a node on every level where centres were put below it, and a leaf of its own rows at last.
        nodes, child, many, at_ = [(0, 0)], [], [], 0
        while at_ < len(nodes):
            c, level = nodes[at_]
            levels = [lv for lv, _ in below[c] if lv > level]
            child.append(len(nodes))
            if levels:
                nodes.append((c, min(levels)))
                nodes.extend((k, lv) for lv, k in below[c] if lv == min(levels))
            many.append(len(nodes) - child[-1])
            at_ += 1
        self.nodes, self.child, self.children = nodes, np.array(child), np.array(many)
        self.start, self.end = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        stack, order, placed = [(0, False)], [], 0
        while stack:
            i, done = stack.pop()
            if not many[i]:
                own = members[nodes[i][0]]
                self.start[i], self.end[i] = placed, placed + len(own)
                placed += len(own)
                order.append(own)
            elif done:
                self.start[i], self.end[i] = self.start[child[i]], self.end[child[i] + many[i] - 1]
            else:
                stack.append((i, True))
                stack.extend((k, False) for k in range(child[i] + many[i] - 1, child[i] - 1, -1))
        order = np.concatenate(order)
        self.ids, self.rows = ids[order], rows[order]
        self.centre, laid = points[self.at[[c for c, _ in nodes]]], points[order]
        self.radius = np.array([np.linalg.norm(laid[a:b] - c, axis=1).max() for a, b, c in zip(self.start, self.end, self.centre, strict=True)])
        self.norm = np.linalg.norm(self.centre, axis=1)
        self.most = max(abs(int(rows.min())), abs(int(rows.max())))

    def dump(self) -> bytes:
        return pickle.dumps(self, protocol=5)

    def opened(self, nodes: np.ndarray) -> np.ndarray:
        """The children of the nodes."""
        many = self.children[nodes]
        return np.repeat(self.child[nodes], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def bound(q: Tree, i: int, d: Tree, nodes: np.ndarray) -> np.ndarray:
    """What no score between node i of q and the nodes of d exceeds (a little more, for rounding)."""
    with np.errstate(all="ignore"):
        slack = (q.norm[i] + q.radius[i]) * (d.norm[nodes] + d.radius[nodes])
        return d.centre[nodes] @ q.centre[i] + q.norm[i] * d.radius[nodes] + d.norm[nodes] * q.radius[i] + q.radius[i] * d.radius[nodes] + 1e-9 * slack + 1e-3


def _scorer(q: np.ndarray, d: np.ndarray, most: int):
    """Exact inner products of rows a:b of q and some of d; most: what no partial sum exceeds."""
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    q, d = q.astype(kind), d.astype(kind)
    if kind is object:
        return lambda a, b, places: np.clip(q[a:b] @ d[places].T, LOWEST + 1, HIGHEST).astype(np.int64)
    return lambda a, b, places: (q[a:b] @ d[places].T).astype(np.int64)


def search(q: Tree, d: Tree, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(kth scores, best scores, best ids, pairs scored) of the queries; least: kth scores known already, per row of q."""
    n, scored = len(q.ids), 0
    kth = np.full(n, LOWEST) if least is None else least.copy()
    scores, ids = np.full((n, k), LOWEST), np.zeros((n, k), dtype=np.int64)
    score = _scorer(q.rows, d.rows, q.most * d.most * q.rows.shape[1])
    stack = [(0, np.array([0]))]
    while stack:
        i, front = stack.pop()
        a, b = q.start[i], q.end[i]
        while True:  # data nodes are opened until none is wider than the query node
            front = front[~(bound(q, i, d, front) < kth[a:b].min())]
            wide = (d.children[front] > 0) & ((d.radius[front] >= q.radius[i]) | (q.children[i] == 0))
            if not wide.any():
                break
            front = np.r_[front[~wide], d.opened(front[wide])]
        if not len(front):
            continue
        if q.children[i]:
            stack.extend((int(c), front) for c in q.opened(np.array([i])))
            continue
        most = bound(q, i, d, front)
        front = front[np.argsort(-most)]
        take = LEAVES
        while len(front):
            now, front = front[:take], front[take:]
            places = np.concatenate([np.arange(d.start[x], d.end[x]) for x in now])
            s = score(a, b, places)
            scored += s.size
            ok = (s >= kth[a:b, None]) & (d.ids[places][None] != q.ids[a:b, None])
            for x in np.flatnonzero(ok.any(axis=1)):
                hit, row = np.flatnonzero(ok[x]), a + x
                held = scores[row] > LOWEST
                all_s, all_i = np.r_[scores[row][held], s[x, hit]], np.r_[ids[row][held], d.ids[places[hit]]]
                best = np.lexsort((all_i, -all_s))[:k]
                scores[row, : len(best)], ids[row, : len(best)] = all_s[best], all_i[best]
                if len(best) == k:
                    kth[row] = max(kth[row], scores[row, k - 1])
            take *= 2
            if len(front):
                front = front[~(bound(q, i, d, front) < kth[a:b].min())]
    return kth, scores, ids, scored


def _cells(pivots: dict[int, np.ndarray]):
    """The nearest pivot of the vector's length, or -1."""

    @F.arrow_udf("int")
    def cell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.full(len(batch), -1, dtype=np.int32)
            lengths = np.asarray(batch.value_lengths())
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begins = np.cumsum(lengths) - lengths
            for dim, near in pivots.items():
                rows = np.flatnonzero(lengths == dim)
                for at in np.array_split(rows, max(1, len(rows) // 1024)):
                    if len(at):
                        v = flat[begins[at][:, None] + np.arange(dim)]
                        with np.errstate(over="ignore", invalid="ignore"):
                            out[at] = np.nan_to_num((near**2).sum(axis=1)[None] - 2 * v @ near.T, nan=np.inf).argmin(axis=1)
            yield pa.array(out)

    return cell


def _planted(factor: float, leaf: int):
    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """One block's tree, with what its root tells."""
        tree = Tree(frame["id"].to_numpy(), scaled(np.array(frame["v"].tolist(), dtype=np.float64), factor), leaf)
        row = [*key, tree.dump(), tree.centre[0].tolist(), float(tree.radius[0]), float(tree.norm[0])]
        return pd.DataFrame([row], columns=["dim", "cell", "chunk", "tree", "centre", "radius", "norm"])

    return of


PLANTED = "dim int, cell int, chunk int, tree binary, centre array<double>, radius double, norm double"
FOUND = "q string, kth binary, least long, scored long, hits array<struct<query_id:long,vec_id:long,score:long>>"


def _searching(k: int):
    """Rows (tree, q, kth) in runs: a block's tree (q null), then the query groups that it is searched for."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = None
        for batch in batches:
            out = {"q": [], "kth": [], "least": [], "scored": [], "hits": []}
            for g, tree, kth in zip(*(batch.column(c) for c in ("q", "tree", "kth")), strict=True):
                if not g.is_valid:
                    d = pickle.loads(tree.as_py())
                    continue
                q = pickle.loads(tree.as_py())
                known = np.frombuffer(kth.as_py(), dtype=np.int64) if kth.is_valid else None
                worst, scores, ids, scored = search(q, d, k, known)
                at, place = np.nonzero(scores > LOWEST)
                hits = [{"query_id": int(i), "vec_id": int(v), "score": int(s)} for i, v, s in zip(q.ids[at], ids[at, place], scores[at, place], strict=True)]
                for name, value in zip(out, (g.as_py(), worst.tobytes(), int(worst.min()), scored, hits), strict=True):
                    out[name].append(value)
            kinds = pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
            types = (pa.string(), pa.binary(), pa.int64(), pa.int64(), kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return of


CELL = ["dim", "cell", "chunk"]


def _searched(pairs: DataFrame, groups: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """pairs (CELL, q, kth) searched: a block's tree goes to as many tasks as its query groups need, GROUPS to each, and each group to one."""
    share = pairs.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / GROUPS).cast("int").alias("shares"))
    pairs = pairs.join(share, CELL).withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int"))
    asked = pairs.join(groups.select("q", "tree"), "q").select(*CELL, "share", "q", "tree", "kth")
    blocks = trees.select(*CELL, "tree").join(share, CELL).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    blocks = blocks.select(*CELL, "share", F.lit(None).cast("string").alias("q"), "tree", F.lit(None).cast("binary").alias("kth"))
    rows = blocks.unionByName(asked).repartition(*CELL, "share").sortWithinPartitions(*CELL, "share", F.col("q").asc_nulls_first())
    return rows.select("q", "tree", "kth").mapInArrow(_searching(k), FOUND)


def found_pairs(data: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", factor: float = 1024.0) -> DataFrame:
    """FOUND rows: for each query group and block that was searched, the hits and the number of pairs scored."""
    rows = data.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & takes_part(F.col("v"))).withColumn("dim", F.size("v"))
    n = rows.count()
    many = max(1, min(PIVOTS, math.ceil(n / BLOCK)))
    chosen: dict[int, list] = {}
    for r in rows.select("dim", "v", "id").orderBy(F.xxhash64("id"), "id", "v").limit(many).collect():
        chosen.setdefault(r["dim"], []).append(r["v"])
    pivots = {dim: np.array(v, dtype=np.float64) for dim, v in chosen.items()}
    rows = written(rows.withColumn("cell", _cells(pivots)(F.col("v"))), "cells")
    asked = rows.where("asked").groupBy("id").agg(F.min(F.struct("dim", "v", "cell")).alias("x")).select("id", "x.*")

    def blocks(df: DataFrame, size: int, leaf: int) -> DataFrame:
        counts = df.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks"))
        df = df.join(counts, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id", "v", F.lit(5)), F.col("chunks")).cast("int"))
        return df.select(*CELL, "id", "v").groupBy(*CELL).applyInPandas(_planted(factor, leaf), PLANTED)

    trees = written(blocks(rows, BLOCK, LEAF), "trees")
    name = F.concat_ws("/", *CELL)
    groups = written(blocks(asked, QUERY_BLOCK, QUERY_LEAF).select(name.alias("q"), "dim", "cell", "tree", *[F.col(c).alias(f"q_{c}") for c in ("centre", "radius", "norm")]), "groups")
    # First round: a block of the queries' own cell.
    own = trees.groupBy("dim", "cell").agg(F.min("chunk").alias("chunk"))
    first = groups.select("q", "dim", "cell").join(own, ["dim", "cell"]).withColumn("kth", F.lit(None).cast("binary"))
    first = written(_searched(first, groups, trees, k), "first")
    # Second round: heads only, in salted pairs of groups and blocks, ruled out by what their roots allow.
    heads = trees.select(*CELL, "centre", "radius", "norm").withColumn("salt", F.pmod(F.xxhash64(*CELL), F.lit(SALTS)).cast("int"))
    asking = groups.select("q", "dim", F.col("cell").alias("q_cell"), "q_centre", "q_radius", "q_norm").join(first.select("q", "kth", "least"), "q")
    asking = asking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    product = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    most = product + F.expr("q_norm * radius + norm * q_radius + q_radius * radius + 1e-9 * (q_norm + q_radius) * (norm + radius) + 1e-3")
    pairs = asking.join(heads, ["dim", "salt"]).where(most >= F.col("least").cast("double"))  # a bound that is no number is above all
    pairs = pairs.join(own.withColumnRenamed("cell", "q_cell").withColumnRenamed("chunk", "own"), ["dim", "q_cell"])
    pairs = pairs.where("NOT (cell = q_cell AND chunk = own)").select(*CELL, "q", "kth")
    return first.unionByName(_searched(written(pairs, "pairs"), groups, trees, k))


def top_k(data: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", factor: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query."""
    hits = found_pairs(data, is_query, k, vec_id, vector, factor).select(F.explode("hits").alias("h")).select("h.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
