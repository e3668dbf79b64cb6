"""Operator 5: URL filters with a blocked Bloom filter in front of an exact hash join.

Rules on hosts and paths come first (longest wins). For all other urls: listed canonical URLs set eight bits in one
512-bit block of a Bloom filter; a url whose eight bits are all set is a possible hit, and only possible hits are
joined with the list, which removes the false ones.

Null urls, and urls without `://`, have empty host and path, fit no rule and are allowed. Repeated rows get equal
verdicts; empty lists block nothing; other columns are kept, but for those named like the result's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fresh, masked, unmasked, written

#: Bits for each listed URL (about 2 false hits in 1000), and bytes of filter, or of list, up to which it is broadcast.
BITS_PER_URL, BROADCAST_BYTES = 16, 8 << 20
LANES = 8  # 64-bit words in a block, one bit is set in each
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    (at,) = fresh(df, "_rest")
    df = df.withColumn(at, F.coalesce(rest, F.lit("")))
    host = F.regexp_extract(at, r"\A([^/?#]*)", 1)
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": F.regexp_extract(at, r"\A[^/?#]*([^?#]*)", 1)}).drop(at)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or port, and path without a trailing slash, .html or index page; scheme and query don't count."""
    host = F.regexp_replace(F.regexp_replace(host, r":\d*\z", ""), r"\A(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?\z", ""), r"/+\z", "")
    return F.concat(host, path)


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    longest = sorted(rules, key=lambda r: -len(r.name))
    out = None
    for r in longest:
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _bit(lane: int) -> Column:
    """The lane's one bit for the hash _h2."""
    return F.expr(f"shiftleft(1L, int(pmod(shiftright(_h2, {6 * lane}), 64)))")


def _hashed(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    h2 = F.xxhash64(key, F.lit("bits"))
    return df.withColumns({"_block": F.pmod(F.xxhash64(key), F.lit(blocks)), "_h2": h2})


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(_block, lane0 ... lane7) of the urls (column canon), aggregated before the shuffle."""
    hashed = _hashed(listed, F.col("canon"), blocks)
    return hashed.groupBy("_block").agg(*[F.bit_or(_bit(i)).alias(f"_lane{i}") for i in range(LANES)])


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and possible (whether the Bloom filter passed the url on).

    listed: a table of listed canonical URLs, in the column canon.
    """
    listed = written(listed.where("canon IS NOT NULL").select("canon").distinct(), "listed")
    n, chars = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("canon")), F.lit(0))).first()
    blocks = max(1, math.ceil(n * BITS_PER_URL / (64 * LANES)))
    small = blocks * 8 * (LANES + 1) <= BROADCAST_BYTES
    filter_ = bloom(listed, blocks)
    df, of = masked(pages)
    url = of[url]
    df = with_parts(df, url)
    df = df.withColumns({"_fit": fitting(F.col("host"), F.col("path"), RULES if rules is None else rules), "canon": canonical(F.col("host"), F.col("path"))})
    # A rule decides alone; the method is for the rest.
    open_, ruled = df.where("_fit IS NULL AND host <> ''"), df.where("_fit IS NOT NULL OR host = ''")
    hashed = _hashed(open_, F.col("canon"), blocks)
    if small:
        probed = hashed.join(F.broadcast(filter_), "_block", "left")
    else:  # rows of a hot url are dealt over salts, and the filter's blocks repeated for each
        salts = 16
        hashed = hashed.withColumn("_salt", F.pmod(F.xxhash64(url, F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
        probed = hashed.join(filter_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_block", "_salt"], "left").drop("_salt")
    passes = F.lit(True)
    for i in range(LANES):
        passes = passes & (F.col(f"_lane{i}").bitwiseAND(_bit(i)) != 0)
    probed = probed.withColumn("possible", F.coalesce(passes, F.lit(False))).drop("_block", "_h2", *[f"_lane{i}" for i in range(LANES)])
    hits = listed.select(F.col("canon"), F.lit(True).alias("_hit"))
    hits = F.broadcast(hits) if chars + 16 * n <= BROADCAST_BYTES else hits  # else Spark splits what is skewed
    sure = probed.where("possible").join(hits, "canon", "left")
    out = sure.unionByName(probed.where("NOT possible").withColumn("_hit", F.lit(None).cast("boolean")))
    out = out.unionByName(ruled.withColumns({"possible": F.lit(False), "_hit": F.lit(None).cast("boolean")}))
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("_hit"), "block").otherwise("allow"))
    out = out.withColumns({"rule": F.col("_fit.rule"), "verdict": verdict})
    return unmasked(out, of, "host", "path", "rule", "verdict", "possible")
