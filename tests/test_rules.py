"""Rules on rows that mirror their hits and near misses."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import rules, scoring
from palisade.plans import planted

ENTRY = "ecosystem string, name string, version string, ordinal long, path string, kind string, text string, mode int"
HOOK = "ecosystem string, name string, version string, hook string, kind string, body string, path string"


@pytest.fixture(scope="module")
def hits(spark):
    """(plant number, rule) of all plants, each the only file or hook of its package."""
    entries = [(p.ecosystem, str(i), "1", 0, p.path.replace("{id}", "x"), p.kind, p.text, 0o644) for i, p in enumerate(planted.PLANTS) if p.where == "e"]
    hooks = [(p.ecosystem, str(i), "1", p.path, p.kind, p.text, None) for i, p in enumerate(planted.PLANTS) if p.where == "h"]
    e, h = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(hooks, HOOK)
    scanned = rules.units(e, h)
    crates = e.where("ecosystem = 'cargo'").select(*rules.PACKAGE)
    found = rules.text_findings(scanned, crates).unionByName(rules.blob_near_execution(scanned))
    return {(int(r["name"]), r["rule_id"]) for r in found.select("name", "rule_id").collect()}


PAIRS = [
    "NPM002", "NPM004", "NPM006", "NPM007", "NPM008", "NPM010", "NPM011", "NPM011", "NPM013", "NPM015", "NPM017", "NPM018", "NPM019", "NPM020", "NPM023", "NPM024", "NPM024",
    "NPM025", "NPM026", "NPM026", "NPM027", "NPM033", "NPM034", "NPM035", "NPM036", "NPM037", "NPM038", "NPM039", "NPM041", "NPM041", "NPM044", "CARGO002", "CARGO004",
]


@pytest.mark.parametrize("n,rule", list(enumerate(PAIRS)))
def test_hit(hits, n, rule):
    assert (2 * n, rule) in hits


#: In these pairs the second snippet is a hit of the same rule elsewhere in the scope.
ALSO = {10}


@pytest.mark.parametrize("n,rule", [x for x in enumerate(PAIRS) if x[0] not in ALSO])
def test_near_miss(hits, n, rule):
    assert (2 * n + 1, rule) not in hits


def test_blob_needs_execution(hits):
    last = len(planted.PLANTS)
    assert (last - 2, "NPM005") in hits and (last - 1, "NPM005") not in hits


def test_partitioning_does_not_change_findings(spark):
    rows = [("npm", str(i), "1", 0, f"a{i}.js", "js_source", "eval(atob(x))" if i % 3 else "x", 0) for i in range(40)]
    e, h = spark.createDataFrame(rows, ENTRY), spark.createDataFrame([], HOOK)
    find = lambda n: sorted(map(str, rules.text_findings(rules.units(e.repartition(n), h)).collect()))
    assert find(1) == find(7) and len(find(1)) == 26


def test_stage1_boundaries(spark):
    rows = [(s, c, d) for s in (0, 6, 7) for c in (True, False) for d in (True, False)]
    df = spark.createDataFrame(rows, "s long, c boolean, d boolean").withColumn("v", scoring.stage1_verdict(F.col("s"), F.col("c"), F.col("d")))
    got = {(r["s"], r["c"], r["d"]): r["v"] for r in df.collect()}
    assert got[6, False, True] == "suspicious" and got[7, False, True] == "malicious" and got[7, False, False] == "suspicious"
    assert got[0, False, False] == "clean" and got[0, True, False] == "malicious"


def test_setuid_and_ages(spark):
    rows = [("npm", str(m), "1", 0, "x", "text", "", m) for m in (0o4755, 0o2755, 0o1755, 0o755)]
    found = rules.setuid_files(spark.createDataFrame(rows, ENTRY)).collect()
    assert {r["excerpt"] for r in found} == {"0o4755", "0o2755"}
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    reg = spark.sql("""SELECT 'npm' ecosystem, cast(a AS string) name, '1' version, timestamp'2024-02-01' - make_dt_interval(a) package_created_at,
        timestamp'2024-02-01' - make_dt_interval(b) published_at, cast(n AS int) total_versions
        FROM VALUES (29, 100, 3), (30, 100, 3), (29, 100, 4), (500, 6, 20), (501, 7, 20), (502, 6, 19) t(a, b, n)""")
    assert {(r["name"], r["severity"]) for r in rules.recency(reg, as_of).collect()} == {("29", "medium"), ("500", "high")}


def test_lookalikes(spark):
    reg = spark.createDataFrame([("npm", n, "1", None) for n in ("loadash", "lodash", "reakt", "zzzzzzzz")], "ecosystem string, name string, version string, package_created_at timestamp")
    found = rules.lookalikes(reg, F.lit("2024-02-01").cast("timestamp")).collect()
    assert {(r["name"], r["excerpt"]) for r in found} == {("loadash", "loadash ~= lodash (distance 1)"), ("reakt", "reakt ~= react (distance 1)")}


def test_files_list(spark):
    e = spark.createDataFrame([("npm", "p", "1", i, f, "text", "", 0) for i, f in enumerate(["package.json", "README.md", "lib/a.js", "lib/deep/b.js", "dist/x/y.js", "extra.js"])], ENTRY)
    m = spark.sql("SELECT 'npm' ecosystem, 'p' name, '1' version, map('x', './bin/x') bin, '{\"files\": [\"dist\", \"lib/*.js\"]}' raw")
    assert [r["excerpt"] for r in rules.unlisted_files(e, m).collect()] == ["extra.js"]  # a star crosses folders


def test_merge(spark):
    rows = [("malicious", "clean", 0.9, "allow"), ("suspicious", "clean", 0.2, "allow"), ("clean", "clean", 0.5, "allow"), ("suspicious", "malicious", 0.9, "block"), ("malicious", "suspicious", 0.9, "warn"), ("suspicious", None, None, None)]
    df = spark.createDataFrame(rows, "v string, s string, c float, a string")
    got = [tuple(r["m"])[::2] for r in df.select(scoring.merged(*map(F.col, "vsca")).alias("m")).collect()]
    assert got == [("warn", "stage_merged"), ("warn", "stage1"), ("clean", "stage1"), ("block", "stage_merged"), ("block", "stage_merged"), ("warn", "stage1")]


def edits(a, b):
    """Levenshtein distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_lookalikes_equal_brute_force(spark):
    rng = random.Random(4)
    listed = list(dict.fromkeys("".join(rng.choices("abc", k=rng.randrange(0, 7))) for _ in range(60))) + ["Mixed-Case", "é日本"]
    names = [(f"{n}", f"{i}") for i, n in enumerate(["".join(rng.choices("abcd", k=rng.randrange(0, 8))) for _ in range(150)] + ["mixedcase", "e日本", "a" * 300, "Abc"])] * 2
    packages = spark.createDataFrame([("npm", n, v, None) for n, v in names], "ecosystem string, name string, version string, package_created_at timestamp")
    got = sorted({(r["name"], r["version"], r["excerpt"]) for r in rules.lookalikes(packages, F.lit("2024-02-01").cast("timestamp"), listed).collect()})
    want = set()
    for n, v in names:
        near = [(edits(n.lower(), t.lower()), i, t) for i, t in enumerate(listed)]
        near = [x for x in near if x[0] in (1, 2)]
        if n.lower() not in [t.lower() for t in listed] and near:
            d, _, t = min(near)
            want.add((n, v, f"{n.lower()} ~= {t} (distance {d})"))
    assert got == sorted(want) and len(got) > 50


def test_lookalikes_of_a_long_list(spark):
    """100,000 listed names: a hash join of shortened forms, nothing compared with everything."""
    top = spark.range(100_000).select(F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("pkg"), F.substring(F.md5(F.col("id").cast("string")), 1, 6)).alias("top"))
    known = top.where("ordinal = 77").first()["top"]
    packages = spark.createDataFrame([("npm", known + "x", "1", None), ("npm", known, "1", None), ("npm", "quite-another-name", "1", None)], "ecosystem string, name string, version string, package_created_at timestamp")
    found = rules.lookalikes(packages, F.lit("2024-02-01").cast("timestamp"), top)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [r["excerpt"] for r in found.where(F.col("name") == known + "x").collect()][0].startswith(f"{known}x ~= ") and found.where("name = 'quite-another-name'").count() == 0
