"""What changed since earlier versions: capability baselines, newly introduced capabilities, and differences of two verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.operators.rules import PACKAGE, finding
from palisade.operators.scoring import in_order, rank

WINDOW = 5


def strict_baselines(versions: DataFrame, n: int = WINDOW) -> DataFrame:
    """versions (package, published_at, capabilities, status, complete) with the union over the n versions before each.

    One shuffle on (ecosystem, name); the frame moves with the row.
    """
    frame = Window.partitionBy("ecosystem", "name").orderBy("published_at", "version").rowsBetween(-n, -1)
    last = Window.partitionBy("ecosystem", "name").orderBy("published_at", "version")
    return versions.withColumns(
        {
            "baseline": in_order(F.array_distinct(F.flatten(F.collect_list("capabilities").over(frame)))),
            "n_baseline": F.count("*").over(frame),
            "baseline_complete": (F.count("*").over(frame) == n) & F.coalesce(F.every("complete").over(frame), F.lit(False)),
            "prev_status": F.lag("status").over(last),
        }
    )


def parity_baselines(versions: DataFrame, n: int = WINDOW) -> DataFrame:
    """The same over the newest n of all other versions, later ones included.

    The newest n + 1 of a package hold the newest n others of every version, so each version meets n + 1 rows, not all.
    """
    order = Window.partitionBy("ecosystem", "name").orderBy(F.desc("published_at"), F.desc("version"))
    newest = versions.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n + 1)
    newest = newest.groupBy("ecosystem", "name").agg(F.sort_array(F.collect_list(F.struct("place", "version", "capabilities", "status", "complete"))).alias("newest"))
    others = F.slice(F.filter("newest", lambda x: x["version"] != F.col("version")), 1, n)
    out = versions.join(newest, ["ecosystem", "name"]).withColumn("others", others)
    return out.withColumns(
        {
            "baseline": in_order(F.array_distinct(F.flatten(F.transform("others", lambda x: x["capabilities"])))),
            "n_baseline": F.size("others").cast("long"),
            "baseline_complete": (F.size("others") == n) & F.forall("others", lambda x: x["complete"]),
            "prev_status": F.get("others", F.lit(0))["status"],
        }
    ).drop("others", "newest")


def outcome(df: DataFrame) -> DataFrame:
    """df (of a baseline function) with outcome and introduced, in the order of the checks."""
    kind = (
        F.when(F.col("prev_status") == "malicious", "abstained_poisoned_baseline")
        .when(F.col("n_baseline") == 0, "not_attempted")
        .when(~F.col("baseline_complete"), "abstained_baseline_incomplete")
        .otherwise("produced")
    )
    df = df.withColumn("outcome", kind)
    return df.withColumn("introduced", F.when(F.col("outcome") == "produced", F.array_except("capabilities", "baseline")).otherwise(F.array().cast("array<string>")))


def introduced_findings(diffed: DataFrame) -> DataFrame:
    """NPM030: a finding for each introduced capability, critical and final for the decisive ones."""
    rows = diffed.select(*PACKAGE, F.explode("introduced").alias("c")).withColumn("decisive", F.col("c").isin(*fixed.DECISIVE))
    severity = F.when(F.col("decisive"), "critical").otherwise("high")
    f = finding("NPM030", severity, "diff", F.lit("history"), F.col("c"), "capability new since earlier versions", True)
    f = f.withField("defers", ~F.col("decisive")).withField("capabilities", F.array("c"))
    return rows.select(*PACKAGE, f.alias("f")).select(*PACKAGE, "f.*")


def applied(stage1: DataFrame, diffed: DataFrame) -> DataFrame:
    """stage1 (package, score, verdict, deferring) after the difference: outcome and introduced of diffed (of outcome), and what NPM030 adds.

    Each introduced capability adds its finding's weight. A decisive one makes the package malicious, others make a clean one suspicious.
    """
    rows = stage1.join(diffed.select(*PACKAGE, "outcome", "introduced"), PACKAGE, "left")
    rows = rows.withColumns({"outcome": F.coalesce("outcome", F.lit("not_attempted")), "introduced": F.coalesce("introduced", F.array().cast("array<string>"))})
    decisive = F.size(F.filter("introduced", lambda c: c.isin(*fixed.DECISIVE)))
    other = F.size("introduced") - decisive
    weights = fixed.SEVERITY_WEIGHTS
    verdict = F.when(decisive > 0, "malicious").when((other > 0) & (F.col("verdict") == "clean"), "suspicious").otherwise(F.col("verdict"))
    return rows.withColumns(
        {"score": (F.col("score") + decisive * weights["critical"] + other * weights["high"]).cast("long"), "verdict": verdict, "deferring": F.col("deferring") | (other > 0)}
    )


def side_by_side(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Findings (key, rule_id, severity) of two sides by rule: added, removed, changed or same; the worst severity of a rule counts."""
    worst = lambda df, name: df.groupBy(*key, "rule_id").agg(F.max_by("severity", rank(F.col("severity"))).alias(name))
    out = worst(left, "before").join(worst(right, "after"), [*key, "rule_id"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "severity_changed").otherwise("same")
    return out.withColumn("change", change)


def verdict_changes(a: Column, b: Column) -> dict[str, Column]:
    """Differences of two verdict structs (capabilities, score, verdict, status)."""
    return {
        "introduced": F.array_except(b["capabilities"], a["capabilities"]),
        "removed": F.array_except(a["capabilities"], b["capabilities"]),
        "shared": F.array_intersect(a["capabilities"], b["capabilities"]),
        "stage1_changed": a["verdict"] != b["verdict"],
        "status_changed": a["status"] != b["status"],
        "score_delta": b["score"] - a["score"],
    }
