"""Findings to scores, verdicts and capability sets; merges with the second stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.spans import given
from palisade.operators.rules import PACKAGE, strings

MIN_CONFIDENCE = 0.5


def case(value: Column, table: dict[str, object], default=None) -> Column:
    out = F.lit(default)
    for key, v in reversed(table.items()):
        out = F.when(value == key, F.lit(v)).otherwise(out)
    return out


def weight(severity: Column) -> Column:
    return case(severity, fixed.SEVERITY_WEIGHTS).cast("long")


def rank(severity: Column) -> Column:
    return case(severity, {s: i for i, s in enumerate(fixed.SEVERITY_WEIGHTS)}).cast("int")


def in_order(capabilities: Column) -> Column:
    """A set of capabilities in the order in which they are listed; unknown ones last, by name."""
    listed = strings(fixed.CAPABILITIES)
    rest = lambda own: F.array_sort(F.array_except(F.array_distinct(own), listed))
    return given(capabilities, lambda own: F.concat(F.filter(listed, lambda c: F.array_contains(own, c)), rest(own)))


def mask(capabilities: Column) -> Column:
    """The set as bits, in the order of the list; the capabilities of rules are all listed."""
    bits = [F.when(F.array_contains(capabilities, c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fixed.CAPABILITIES)]
    return sum(bits[1:], bits[0]).cast("long")


def unmasked(bits: Column) -> Column:
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(fixed.CAPABILITIES)]))


def stage1_verdict(score: Column, decisive_critical: Column, decisive_any: Column) -> Column:
    return F.when(decisive_critical, "malicious").when(score == 0, "clean").when((score >= 7) & decisive_any, "malicious").otherwise("suspicious")


def stage1(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, score, verdict, capabilities, deferring): one row for each package, with or without findings.

    Findings are read once and summed before they meet the packages; sets of capabilities are bits meanwhile.
    """
    w, decides = weight(F.col("severity")), ~F.col("defers")
    sums = findings.groupBy(*PACKAGE).agg(
        F.sum(w).alias("score"),
        F.bool_or(decides & (F.col("severity") == "critical")).alias("critical"),
        F.bool_or(decides & (w > 0)).alias("decisive"),
        F.bool_or("defers").alias("deferring"),
        F.bit_or(mask(F.col("capabilities"))).alias("bits"),
    )
    out = packages.select(*PACKAGE).distinct().join(sums, PACKAGE, "left")
    score, false = F.coalesce("score", F.lit(0).cast("long")), F.lit(False)
    return out.select(
        *PACKAGE,
        score.alias("score"),
        stage1_verdict(score, F.coalesce("critical", false), F.coalesce("decisive", false)).alias("verdict"),
        unmasked(F.coalesce("bits", F.lit(0).cast("long"))).alias("capabilities"),
        F.coalesce("deferring", false).alias("deferring"),
    )


def wants_second_stage(verdict: Column, deferring: Column) -> Column:
    return (verdict == "suspicious") | deferring


def merged(verdict: Column, second: Column, confidence: Column, action: Column) -> Column:
    """struct(status, confidence, source) from the first stage's verdict and the second's (null without one).

    A second opinion below MIN_CONFIDENCE counts as none. An allow softens a block to a warning; else the stricter of both.
    """
    own = case(verdict, {"clean": 0, "suspicious": 1, "malicious": 2}).cast("int")
    own_confidence = case(verdict, {"clean": 0.9, "suspicious": 0.5, "malicious": 0.85}).cast("float")
    other = case(action, {"allow": 0, "warn": 1, "block": 2}).cast("int")
    usable = second.isNotNull() & (confidence >= MIN_CONFIDENCE)
    stricter = F.when((own == 2) & (other == 0), 1).otherwise(F.greatest(own, other))
    level = F.when(usable, stricter).otherwise(own)
    source = F.when(usable, F.when((own == 0) & (second == "clean"), "stage1").otherwise("stage_merged")).otherwise("stage1")
    status = F.element_at(strings(["clean", "warn", "block"]), level + 1)
    return F.struct(status.alias("status"), F.when(usable, confidence).otherwise(own_confidence).cast("float").alias("confidence"), source.alias("source"))
