"""Operator 7: mixing sources to target weights by pivotal dependent rounding. Native: DataFrame and SQL only.

Every source gets a target of words; each of its documents should be taken target / size-of-source times (at most
twice). The whole part is certain; the fractional parts are rounded dependently: two documents at a time, words
are moved at random from one's probability to the other's until one of them is 0 or 1, which leaves every
expectation and the source's expected words as they were. Buckets of bounded size are folded in parallel, each
leaving one residual document; residuals of neighbouring buckets are folded again, level by level, until one is
left per source, which is rounded to the nearer side. So a source misses its target by half a document at most.

Randomness is a hash of the documents' keys and the seed, so reruns agree. Rows equal in id, source and size are counted together, but
taken as rows: of r such rows with the fraction p, floor(r p) take one copy more for certain, and only one row is left
to be rounded. So repeated rows, and any number of rows without id, don't add to a source's miss. Null text has size 0 and empty documents are taken
0 times; a null source is a source of its own, the last. A table without words has targets 0. Extra columns play no part in
mix; mixed_rows keeps them, and takes rows that differ in any column as rows of their own. Ids must be integers (text ids that are no numbers fail).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import SPACES, fresh, masked, unmasked, written

WEIGHTS = (3, 1, 2)
#: Items folded into one residual at each level of the tree, and sources up to which their table is broadcast.
FAN_IN, FEW_SOURCES = 128, 50_000
#: What makes rows equal; twin: a hash of whatever else shall tell them apart.
ITEM = ["doc_id", "source", "size", "twin"]


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with target: weights in the order of sources, capped at cap times the size.

    Resharing the excess until no target is above its cap ends at min(cap, level * weight) with one level for all;
    the level is found in order of cap / weight. Works on one row per source, not on documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    out = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    out = out.withColumn("level", level)
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("k"), "level"))).over(everything)
    return out.select("source", "source_size", F.least("most", F.coalesce(settled["level"] * F.col("weight"), F.col("most"))).alias("target"))


def _fold(items: Column, seed: int) -> Column:
    """Pairs the rows (h, ITEM, copies, p) of a sorted array one after another.

    Gives struct(carry, done): the item still undecided (null if none), and the decided ones with their copies.
    """
    kind = "struct<h:bigint,doc_id:bigint,source:string,size:bigint,twin:bigint,copies:bigint,p:double>"

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("h", *ITEM, "copies")], p.alias("p")).cast(kind)

    def step(state: Column, x: Column) -> Column:
        a, words_a = state["carry"], state["carry"]["size"].cast("double")
        words_x = x["size"].cast("double")
        gain = F.least(words_a * (1 - a["p"]), words_x * x["p"])  # words that can move to a
        loss = F.least(words_a * a["p"], words_x * (1 - x["p"]))  # ... from a
        u = F.pmod(F.xxhash64(a["h"], x["h"], F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        moved = F.when(u * (gain + loss) < loss, gain).otherwise(-loss)
        pa, px = a["p"] + moved / words_a, x["p"] - moved / words_x
        # The one that reached its bound is set to it exactly; the rest is carried on.
        full = F.when(moved >= 0, gain == words_a * (1 - a["p"])).otherwise(loss == words_a * a["p"])  # a is decided
        first, rest = with_p(a, F.when(moved >= 0, F.lit(1.0)).otherwise(F.lit(0.0))), with_p(x, px)
        second, kept = with_p(x, F.when(moved >= 0, F.lit(0.0)).otherwise(F.lit(1.0))), with_p(a, pa)
        open_ = lambda y: F.when((y["p"] > 1e-12) & (y["p"] < 1 - 1e-12), y)  # noqa: E731  both may be decided at once
        left = F.when(full, rest).otherwise(kept)
        done = F.concat(state["done"], F.array(F.when(full, first).otherwise(second)), F.when(open_(left).isNull(), F.array(with_p(left, F.round(left["p"])))).otherwise(F.array().cast(f"array<{kind}>")))
        return F.when(a.isNull(), F.struct(with_p(x, x["p"]).alias("carry"), state["done"].alias("done"))).otherwise(F.struct(open_(left).alias("carry"), done.alias("done")))

    return F.aggregate(items, F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(f"array<{kind}>").alias("done")), step)


def mix_items(items: DataFrame, sources: DataFrame, n_sources: int, most_items: int, seed: int = 7) -> DataFrame:
    """items (ITEM, repeats) in parts (ITEM, repeats, copies, source_size, target): so many of the item's rows are taken so often."""
    small = F.broadcast if n_sources <= FEW_SOURCES else (lambda df: df)  # else Spark splits the skewed side itself
    right = sources.withColumnRenamed("source", "_source")
    items = items.join(small(right), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))
    items = items.withColumn("rate", rate).withColumn("rate", F.when(F.col("size") > 0, near).otherwise(0.0))
    items = items.withColumns({"copies": F.floor("rate"), "p": F.col("rate") - F.floor("rate"), "h": F.xxhash64("doc_id", "source", "size", F.lit(seed))}).drop("rate")
    extra = ["source_size", "target"]
    # Of an item's rows so many take one copy more for certain, one may be open, and the others don't.
    items = items.withColumn("sure", F.floor(F.col("repeats") * F.col("p") + 1e-9)).withColumn("open", F.greatest(F.col("repeats") * F.col("p") - F.col("sure"), F.lit(0.0)))
    items = items.withColumn("open", F.when(F.col("open") < 1e-9, 0.0).otherwise(F.col("open")))
    part = lambda n, copies, p: F.struct(n.cast("long").alias("repeats"), copies.cast("long").alias("copies"), p.cast("double").alias("p"))
    alone = (F.col("open") > 0).cast("long")
    parts = F.array(part(F.col("sure"), F.col("copies") + 1, F.lit(0)), part(F.col("repeats") - F.col("sure") - alone, F.col("copies"), F.lit(0)), part(alone, F.col("copies"), F.col("open")))
    items = items.select("h", *ITEM, *extra, F.explode(F.filter(parts, lambda x: x["repeats"] > 0)).alias("x")).select("h", *ITEM, *extra, "x.*")
    whole = items.where("p = 0").select(*ITEM, "repeats", "copies", *extra)
    # Level 0 deals open rows to buckets by hash; each later level folds FAN_IN neighbouring buckets' residuals.
    n_buckets = max(1, math.ceil(most_items / FAN_IN))
    waiting = items.where("p > 0").withColumn("bucket", F.pmod("h", F.lit(n_buckets)))
    one = F.lit(1).cast("long").alias("repeats")
    settled = []
    while True:
        fields = ["h", *ITEM, "copies", "p"]
        # Large documents first: their fractions are then settled against many smaller ones.
        folded = waiting.groupBy("source", "bucket", *extra).agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("least"), *fields))).alias("items"))
        folded = written(folded.select("bucket", *extra, _fold(F.col("items"), seed).alias("x")), "mix")
        done = folded.select(F.explode("x.done").alias("d"), *extra)
        settled.append(done.select(*[f"d.{c}" for c in ITEM], one, (F.col("d.copies") + F.col("d.p").cast("long")).alias("copies"), *extra))
        rest = folded.where("x.carry IS NOT NULL").select("x.carry.*", "bucket", *extra)
        if n_buckets == 1:
            break
        n_buckets = math.ceil(n_buckets / FAN_IN)
        waiting = rest.withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))
    last = F.round("p").cast("long")  # the nearer way, so a source misses its target by half a document at most
    settled.append(rest.select(*ITEM, one, (F.col("copies") + last).alias("copies"), *extra))
    for part in settled:
        whole = whole.unionByName(part)
    return whole


def _taken(docs: DataFrame, text: str, doc_id: str, source: str, twin: Column, seed: int) -> DataFrame:
    """mix_items of the rows of docs."""
    items = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), twin.cast("long").alias("twin"))
    items = written(items.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("repeats")), "items")
    sizes = written(items.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"), F.count(F.lit(1)).alias("n_items")), "sources")
    n_sources, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n_items"), F.lit(0))).first()
    return mix_items(items, targets(sizes.select("source", "source_size")), n_sources, most, seed)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, copies) for each row of docs."""
    out = _taken(docs, text, doc_id, source, F.lit(0), seed)
    out = out.withColumn("repeats", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return out.select("doc_id", "source", "size", "copies", "source_size", "target")


def mixed_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, in docs' columns."""
    inner, of = masked(docs)
    plain = [f.name for f in inner.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    odd = [c for c in inner.columns if c not in plain]  # what can't be hashed is, as JSON
    twin = F.xxhash64(*plain, *([F.to_json(F.struct(*odd))] if odd else []))
    taken = _taken(inner, of[text], of[doc_id], of[source], twin, seed).groupBy(*ITEM).agg(F.sum("repeats").alias("rows"), F.sum(F.col("repeats") * F.col("copies")).alias("total"))
    taken = written(taken.where("total > 0"), "taken")
    inner = inner.withColumns({"size": n_words(F.col(of[text])), "twin": twin})
    same = F.col(of[doc_id]).cast("long").eqNullSafe(F.col("doc_id")) & F.col(of[source]).cast("string").eqNullSafe(F.col("source")) & (inner["size"] == taken["size"]) & (inner["twin"] == taken["twin"])
    out = inner.join(taken.where("rows = 1"), same).select(*of.values(), "total")
    several = taken.where("rows > 1")
    if not several.isEmpty():  # rows that are equal in all columns: one stands for all of them, with the copies of all
        key = ["doc_id", "source", taken["size"], taken["twin"], "total"]
        more = inner.join(several, same).select(*of.values(), *key)
        (whole,) = fresh(more, "_row")
        more = more.groupBy("doc_id", "source", "size", "twin", "total").agg(F.first(F.struct(*of.values())).alias(whole))
        out = out.unionByName(more.select(f"{whole}.*", "total"))
    return unmasked(out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total")))), of)
