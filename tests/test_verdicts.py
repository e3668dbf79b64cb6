"""The queries of verdicts, gate, budget and messages on small tables."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.operators import rules
from palisade.functions import fixed
from palisade.plans import catalogue, planted

N = len(planted.PLANTS)


def slot(text: str) -> int:
    return next(i for i, p in enumerate(planted.PLANTS) if p.text == text)


def bare(n: int, manifest=lambda k: k not in (3, 4, 5), setuid: bool = False) -> int:
    """The n-th document without a plant and with such a manifest (by its id modulo 17)."""
    return [i for i in range(2000) if i % planted.MODULUS > N and manifest(i % 17) and (i % 50 == 7) == setuid][n]


#: Rules that SQL can't say or that aren't text rules: a document that only they make more than clean, or malicious.
ALONE = {
    "NPM005": (N - 2, ""),
    "NPM018": (slot("fs.unlinkSync(__filename)"), ""),
    "NPM022": (bare(0), "x = '\u202e'"),
    "NPM039": (slot("fs.rmSync(os.homedir(), { recursive: true })"), ""),
    "NPM046": (bare(0, setuid=True), ""),
    "NPM012": (bare(0, lambda k: k == 3), ""),
    "NPM028": (bare(1), "d = '2031-01-01'"),
}
PLAIN = bare(2)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = [*ALONE.values(), (PLAIN, "plain")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 0, "x"), (5, 5, "y")], "conv_id long, turn long, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(8, 30), (36, 120), (1, 119), (1, 121)], "o_custkey long, o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    found = catalogue.evaluated(spark, folder).cache()  # once for all tests
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalogue, "evaluated", lambda *_: found)
        yield folder
    found.unpersist()


def test_verdicts_by_all_rules(spark, tables):
    verdicts = {r["name"]: r for r in catalogue.stage1_verdicts(spark, tables).collect()}
    found = defaultdict(list)
    for r in catalogue.all_findings(spark, tables).collect():
        found[r["name"]].append(r)
    for rule, (i, _) in ALONE.items():
        assert rule in {r["rule_id"] for r in found[f"pkg-{i}"]}
        critical = any(r["severity"] == "critical" for r in found[f"pkg-{i}"])
        assert verdicts[f"pkg-{i}"]["verdict"] == ("malicious" if critical else "suspicious") and critical == (rule not in ("NPM012", "NPM028"))
    assert set(found) <= set(verdicts) and verdicts[f"pkg-{PLAIN}"]["verdict"] == "clean"
    assert {r["rule_id"] for rows in found.values() for r in rows} >= {*ALONE, "NPM001", "NPM014", "NPM016"}
    for name, r in verdicts.items():
        rows = found[name]
        score, caps = sum(fixed.SEVERITY_WEIGHTS[x["severity"]] for x in rows), {c for x in rows for c in x["capabilities"].split(",") if c}
        decisive = [x["severity"] for x in rows if not x["defers"]]
        bad = "critical" in decisive or score >= 7 and any(fixed.SEVERITY_WEIGHTS[s] for s in decisive)
        assert (r["score"], r["verdict"]) == (score, "malicious" if bad else "suspicious" if score else "clean")
        assert r["capabilities"] == ",".join(c for c in fixed.CAPABILITIES if c in caps) and r["deferring"] == any(x["defers"] for x in rows)


def test_gate_and_messages_by_all_rules(spark, tables):
    name = f"pkg-{ALONE['NPM012'][0]}"
    assert [r["verdict"] for r in catalogue.gated(spark, tables).where(F.col("name") == name).collect()] == ["suspicious"]
    assert "(NPM012, " in catalogue.messages(spark, tables).where(F.col("name") == name).first()["message"]


def test_texts_do_not_meet_the_macro_crates(spark):
    """Findings are joined, not the texts, which the join would shuffle: the join stands above what makes findings of texts."""
    folder = "/root/testdata/sf0.001"
    crates = rules.macro_crates(catalogue.manifests(spark, folder))
    plan = rules.unit_findings(catalogue.scanned(spark, folder), crates, catalogue.as_of())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Generate explode")


def test_macro_rules_hold_in_macro_crates_only(spark):
    unit = "ecosystem string, name string, version string, unit string, kind string, location string, text string, ordinal long"
    scanned = spark.createDataFrame([("cargo", n, "1", "entry", "rust_source", "src/lib.rs", "std::fs::write(p, b)", 0) for n in ("macro", "plain")], unit)
    crates = spark.createDataFrame([("cargo", "macro", "1")] * 2, "ecosystem string, name string, version string")
    assert [(r["name"], r["rule_id"]) for r in rules.text_findings(scanned, crates).collect()] == [("macro", "CARGO006")]
    assert rules.text_findings(scanned).count() == 0
