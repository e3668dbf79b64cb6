"""Archives, history, catalog, feed and second stage."""

import io
import json
import tarfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.operators import history, stage2
from palisade.plans import catalogue, planted
from palisade.sources import catalog, packages
from palisade.streaming import feed


def tgz(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), 0o4755 if name.endswith(".sh") else 0o644
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def nupkg(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_unpack_parse_and_hooks(spark):
    npm = {"package/package.json": json.dumps({"name": "p", "version": "1.0.0", "bin": "x.js", "scripts": {"postinstall": "node a.js", "test": "t"}, "dependencies": {"a": "1", "b": 2}}).encode(), "package/a.js": b"1", "package/bad.bin": b"\xff\xfe", "package/lib.so": b"\x7fELF"}
    crate = {"c-1/Cargo.toml": b'[package]\nname = "c"\nversion = "1.0.0"\n[lib]\nproc-macro = true\n[dependencies]\nd = "1"\n', "c-1/build.rs": b"fn main() {}"}
    sdist = {"s-1/PKG-INFO": b"Name: s\nVersion: 2\n\nx", "s-1/setup.py": b"import os"}
    nuget = {"n.nuspec": b'<package xmlns="u"><metadata><id>n</id><version>3</version></metadata></package>', "tools/Install.ps1": b"IEX", "_rels/x": b"", "[Content_Types].xml": b""}
    rows = [("npm", "1", tgz(npm)), ("cargo", "2", tgz(crate)), ("pypi", "3", tgz(sdist)), ("nuget", "4", nupkg(nuget)), ("npm", "5", b"no archive"), ("npm", "6", tgz({"package/../x": b""}))]
    raw = spark.createDataFrame(rows, "ecosystem string, source string, content binary")
    unpacked = packages.unpack(raw).cache()
    assert {r["source"] for r in unpacked.where("scan_error IS NOT NULL").collect()} == {"5", "6"}
    files = packages.entries(unpacked).cache()
    kinds = {(r["source"], r["path"]): r["kind"] for r in files.collect()}
    assert kinds["1", "a.js"] == "js_source" and kinds["1", "bad.bin"] == "binary" and kinds["1", "lib.so"] == "native_binary" and kinds["2", "build.rs"] == "rust_source"
    assert ("4", "_rels/x") not in kinds
    parsed = packages.manifests(files).cache()
    names = {r["source"]: (r["name"], r["version"]) for r in parsed.collect()}
    assert names == {"1": ("p", "1.0.0"), "2": ("c", "1.0.0"), "3": ("s", "2"), "4": ("n", "3")}
    assert parsed.where("source = '1'").first()["dependencies"] == {"a": "1"}
    hooks = {(r["source"], r["hook"], r["kind"]) for r in packages.lifecycle(files, parsed).collect()}
    assert hooks == {("1", "postinstall", "install_time"), ("2", "build", "install_time"), ("3", "setup.py", "install_time"), ("4", "tools/install.ps1", "install_time")}


def test_archives_without_files_or_manifest(spark):
    rows = [("npm", "1", tgz({"package/a.js": b"1"})), ("cargo", "2", tgz({"c/build.rs": b"fn main() {}"})), ("pypi", "3", tgz({"s/setup.py": b"1"})), ("nuget", "4", nupkg({"lib/a.dll": b"MZxx"})), ("npm", "5", tgz({})), ("npm", "6", None)]
    unpacked = packages.unpack(spark.createDataFrame(rows, "ecosystem string, source string, content binary")).cache()
    assert {(r["source"], r["scan_error"].split(":")[0]) for r in unpacked.where("scan_error IS NOT NULL").collect()} == {("5", "no files"), ("6", "EOFError")} or unpacked.where("scan_error IS NOT NULL").count() == 2
    files = packages.entries(unpacked)
    parsed = packages.manifests(files)
    assert {(r["source"], r["name"], r["scan_error"]) for r in parsed.collect()} == {("1", None, "no manifest"), ("2", None, "no manifest"), ("3", None, None), ("4", None, "no manifest")}
    assert {(r["source"], r["hook"]) for r in packages.lifecycle(files, parsed).collect()} == {("3", "setup.py")}


def test_unpack_holds_a_batch_at_most(monkeypatch):
    """Rows come in batches of bounded bytes, and damage at an archive's end leaves no half package."""
    monkeypatch.setattr(packages, "BATCH_BYTES", 1000)
    whole = tgz({f"package/{i}.txt": bytes([i]) * 300 for i in range(40)})
    batches = list(packages.entry_batches(packages.entry_rows("npm", "x", whole)))
    assert max(b.num_rows for b in batches) == 3 and sum(b.num_rows for b in batches) == 40
    (cut,) = packages.entry_rows("npm", "x", whole[:-30])
    assert cut[2] is None and cut[7]


def test_hooks_unpack_the_archives_once(spark):
    """What manifests and hooks read is stored: the query's own plan neither packs nor unpacks, and nothing is lost."""
    folder = "/root/testdata/sf0.001"
    found = catalogue.package_hooks(spark, folder)
    assert "InArrow" not in found._jdf.queryExecution().toString() and "InPandas" not in found._jdf.queryExecution().toString()
    files = catalogue.archive_files(spark, folder).cache()
    plain = packages.lifecycle(files, packages.manifests(files)).select("ecosystem", "source", "hook", "kind", F.sha2("body", 256), F.coalesce("path", F.lit("")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    rows = [("cargo", "1", tgz({"c/x/own.rs": b"1", "c/Cargo.toml": b'[package]\nname = "c"\nversion = "1"\nbuild = "x/own.rs"\n'})), ("npm", "2", tgz({"package/a.js": b"1", "package/b.js": b"2"})), ("npm", "3", b"none")]
    kept = packages.hook_files(packages.unpack(spark.createDataFrame(rows, "ecosystem string, source string, content binary"))).cache()
    assert {(r["source"], r["path"], r["bytes"] is None) for r in kept.collect()} == {("1", "x/own.rs", False), ("1", "Cargo.toml", False), ("2", "a.js", True)}
    files = packages.entries(kept)
    parsed = packages.manifests(files).cache()
    assert {(r["source"], r["scan_error"]) for r in parsed.collect()} == {("1", None), ("2", "no manifest")}
    assert [(r["source"], r["path"], r["body"]) for r in packages.lifecycle(files, parsed).collect()] == [("1", "x/own.rs", "1")]


def test_small_archives_are_read_once(monkeypatch):
    reads, own = [], packages.files_of
    monkeypatch.setattr(packages, "files_of", lambda *a: reads.append(1) or own(*a))
    content = tgz({f"package/{i}.txt": bytes([i]) * 300 for i in range(10)})
    once = list(packages.entry_rows("npm", "x", content))
    assert len(reads) == 1
    monkeypatch.setattr(packages, "BATCH_BYTES", 1000)
    assert list(packages.entry_rows("npm", "x", content)) == once and len(reads) == 3


def test_batches_to_python_are_bounded_by_bytes(spark):
    """Rows of 1 MB in one partition: by their number alone all would be one batch."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    packages.unpack(spark.createDataFrame([], "ecosystem string, source string, content binary"))
    big = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), packages.MIB).alias("t")).mapInArrow(sizes, "n long")
    assert max(r["n"] for r in big.collect()) <= 2 * packages.BATCH_BYTES


def test_archives_are_made_in_bounded_batches(spark, monkeypatch):
    """Neither a frame of many texts nor one of their archives is held."""
    made = planted.archives(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    docs = {str(r["doc_id"]): r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id IS NOT NULL").collect()}
    got = {r["source"]: list(packages.files_of(r["ecosystem"], r["content"]))[-1] for r in made.where("ecosystem <> 'cargo'").collect()}
    assert len(docs) > 100 and got and all(data.decode() == docs[i] for i, (*_, data) in got.items())


def test_unpack_as_a_table_function(spark):
    rows = [("npm", "1", tgz({"package/a.js": b"1", "package/b.js": b"22"})), ("nuget", "2", nupkg({"n.nuspec": b"x"})), ("npm", "3", b"none")]
    raw = spark.createDataFrame(rows, "ecosystem string, source string, content binary")
    packages.register(spark)
    raw.createOrReplaceTempView("raw_archives")
    by_sql = spark.sql("SELECT f.* FROM raw_archives a, LATERAL unpack(a.ecosystem, a.source, a.content) f")
    assert sorted(map(str, by_sql.collect())) == sorted(map(str, packages.unpack(raw).collect())) and by_sql.count() == 4


def test_npm_registry_by_variant(spark):
    doc = {
        "name": "p", "time": {"created": "2020-01-01T00:00:00Z", "modified": "x", "1.0": "2020-02-01T00:00:00.5Z", "2.0": "some day", "9.9": "2020-03-01T00:00:00Z"},
        "versions": {"1.0": {"_npmUser": {"name": "ann", "email": "a"}}, "2.0": {"_npmUser": "no object"}, "3.0": {}}, "maintainers": [{"name": "ann"}, {"email": "no name"}, "odd"],
    }
    rows = [(json.dumps(doc),), ("no json",), (None,), (json.dumps({"name": "none", "versions": {}}),), (json.dumps({"name": "odd", "versions": [1], "time": 3, "maintainers": {}}),)]
    got = catalog.npm_registry(spark.createDataFrame(rows, "value string")).collect()
    show = lambda t: t and t.strftime("%Y-%m-%d")
    assert sorted((r["name"], r["version"], show(r["published_at"]), r["published_by"], show(r["package_created_at"]), r["total_versions"]) for r in got) == [
        ("p", "1.0", "2020-02-01", "ann", "2020-01-01", 3), ("p", "2.0", None, None, "2020-01-01", 3), ("p", "3.0", None, None, "2020-01-01", 3),
    ]
    assert {tuple(r["maintainers"]) for r in got} == {("ann",)}


def test_integrity_path(spark):
    i = packages.integrity(F.lit("npm"), F.lit(b""))
    row = spark.range(1).select(i.alias("i"), catalog.integrity_path(i["algo"], i["digest_b64"]).alias("p")).first()
    assert row["i"]["algo"] == "sha512" and row["p"].startswith("verdicts/by-integrity/sha512/cf/83e1357eef") and len(row["i"]["digest_b64"]) == 88


def test_baselines(spark):
    rows = [("npm", "p", f"{i}", i, ["net_http"] if i < 6 else ["net_http", "crypto_miner", "net_dns"], "clean", True) for i in range(1, 7)]
    v = spark.createDataFrame(rows, "ecosystem string, name string, version string, published_at long, capabilities array<string>, status string, complete boolean")
    for baselines in (history.strict_baselines, history.parity_baselines):
        diff = history.outcome(baselines(v)).cache()
        last = diff.where("version = '6'").first()
        assert last["outcome"] == "produced" and sorted(last["introduced"]) == ["crypto_miner", "net_dns"]
        severities = {r["excerpt"]: (r["severity"], r["defers"]) for r in history.introduced_findings(diff.where("version = '6'")).collect()}
        assert severities == {"crypto_miner": ("critical", False), "net_dns": ("high", True)}
    assert history.outcome(history.strict_baselines(v)).where("version = '5'").first()["outcome"] == "abstained_baseline_incomplete"
    assert history.outcome(history.strict_baselines(v)).where("version = '1'").first()["outcome"] == "not_attempted"


def test_upsert_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    new = spark.sql("SELECT 'npm' ecosystem, 'p' name, '1' version, timestamp'2024-01-01' analyzed_at, 'a' integrity, 'clean' status")
    newer = spark.sql("SELECT 'npm' ecosystem, 'p' name, '1' version, timestamp'2024-01-02' analyzed_at, 'a' integrity, 'block' status")
    other = spark.sql("SELECT 'npm' ecosystem, concat('q', id) name, '1' version, timestamp'2024-01-01' analyzed_at, 'a' integrity, 'clean' status FROM range(200)")
    for df in (new, newer, other, new, new.limit(0)):
        catalog.upsert(spark, df, path)
    got = {r["name"]: r["status"] for r in catalog.read(spark, path, new.schema).collect()}
    assert got == {"p": "block"} | {f"q{i}": "clean" for i in range(200)}


def test_upsert_leaves_the_old_catalog_when_it_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/catalog"
    row = lambda status, day: spark.sql(f"SELECT 'npm' ecosystem, 'p' name, '1' version, timestamp'2024-01-0{day}' analyzed_at, 'a' integrity, '{status}' status")
    catalog.upsert(spark, row("clean", 1), path)

    def lost(*_):
        raise RuntimeError("lost before the swap")

    with monkeypatch.context() as patch:
        patch.setattr(catalog, "_swap", lost)
        with pytest.raises(RuntimeError):
            catalog.upsert(spark, row("block", 2), path)
    assert [r["status"] for r in catalog.read(spark, path, row("x", 1).schema).collect()] == ["clean"]
    catalog.upsert(spark, row("block", 2), path)
    assert [r["status"] for r in catalog.read(spark, path, row("x", 1).schema).collect()] == ["block"]


def test_catalog_documents_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    rows = spark.range(20).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("@s/p"), (F.col("id") % 10).cast("string")).alias("name"), F.concat(F.lit("1."), F.col("id").cast("string")).alias("version"), packages.integrity(F.lit("npm"), F.col("id").cast("string").cast("binary")).alias("integrity"), F.lit("warn").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("analyzed_at"))
    for _ in range(2):
        index = catalog.write_documents(rows, folder)
    assert index.count() == 20 and index.first()["verdict_path"].startswith("verdicts/by-integrity/sha512/")
    back = catalog.read_documents(spark, folder, "status string, analyzed_at string")
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    pointer = json.loads((tmp_path / "files/verdicts/npm/%40s%2Fp3/1.3.json").read_text())
    assert pointer["artifact"]["name"] == "@s/p3" and (tmp_path / "files" / pointer["verdict_path"]).exists() and not list((tmp_path / "files").rglob("*.tmp"))


def test_backfill(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    verdicts = spark.sql("SELECT 'npm' ecosystem, 'known' name, '1' version, timestamp'2024-01-01' analyzed_at, 'a' integrity, 'clean' status")
    catalog.upsert(spark, verdicts, path)
    items = spark.createDataFrame([("npm", n, v, i) for i, (n, v) in enumerate([("known", "1"), ("known", None), ("new", None), ("new", "2"), ("gone", None), ("no-archive", "1"), ("bad", "1")])], "ecosystem string, name string, version string, ordinal int")
    latest = spark.createDataFrame([("npm", "known", "1"), ("npm", "new", "2")], "ecosystem string, name string, latest string")
    archives = spark.createDataFrame([("npm", "new", "2"), ("npm", "bad", "1")], "ecosystem string, name string, version string")
    analyze = lambda df: df.where("name <> 'bad'").withColumns({"analyzed_at": F.lit("2024-01-02").cast("timestamp"), "integrity": F.lit("b"), "status": F.lit("warn")})
    outcomes = catalog.run_backfill(spark, items, latest, archives, path, verdicts.schema, analyze)
    assert {r["ordinal"]: r["outcome"] for r in outcomes.collect()} == {0: "already_present", 1: "already_present", 2: "analyzed", 3: "already_present", 4: "missing", 5: "failed", 6: "failed"}
    assert tuple(catalog.backfill_counts(outcomes).first()) == (1, 3, 1, 2)
    assert {(r["name"], r["status"]) for r in catalog.read(spark, path, verdicts.schema).collect()} == {("known", "clean"), ("new", "warn")}


def test_unsafe_paths_and_damaged_manifests(spark):
    rows = [("npm", "1", tgz({"package/a..b": b"x"})), ("nuget", "2", nupkg({"a/..b": b"x"})), ("npm", "3", tgz({"package/package.json": b"{"})), ("cargo", "4", tgz({"c/Cargo.toml": b"= x"}))]
    unpacked = packages.unpack(spark.createDataFrame(rows, "ecosystem string, source string, content binary")).cache()
    assert {r["source"] for r in unpacked.where("scan_error IS NOT NULL").collect()} == {"1", "2"}
    assert {r["source"]: r["name"] for r in packages.manifests(packages.entries(unpacked)).where("scan_error IS NOT NULL").collect()} == {"3": None, "4": None}


def test_applied_differences(spark):
    rows = [("clean", [], 0), ("clean", ["net_dns"], 0), ("clean", ["net_dns", "crypto_miner"], 0), ("suspicious", ["net_dns"], 3), ("malicious", ["net_dns"], 12)]
    key = [("npm", str(i), "1") for i in range(len(rows) + 1)]
    own = spark.createDataFrame([(*k, s, v, False) for k, (v, _, s) in zip(key, [*rows, ("clean", None, 1)], strict=True)], "ecosystem string, name string, version string, score long, verdict string, deferring boolean")
    diffed = spark.createDataFrame([(*k, "produced", c) for k, (_, c, _) in zip(key, rows, strict=False)], "ecosystem string, name string, version string, outcome string, introduced array<string>")
    got = {int(r["name"]): (r["score"], r["verdict"], r["deferring"], r["outcome"]) for r in history.applied(own, diffed).collect()}
    assert got == {0: (0, "clean", False, "produced"), 1: (5, "suspicious", True, "produced"), 2: (15, "malicious", True, "produced"), 3: (8, "suspicious", True, "produced"), 4: (17, "malicious", True, "produced"), 5: (1, "clean", False, "not_attempted")}


def test_truncation_counts_bytes(spark):
    texts = ["abc", "abcdef", "ééé", "a😀b", "日本語", "aé日"]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(stage2.truncated(F.col("t"), 5).alias("t")).collect()]

    def cut(t):
        data, end = t.encode(), 5
        if len(data) <= 5:
            return t
        while data[end] & 0xC0 == 0x80:
            end -= 1
        return f"{data[:end].decode()}…[truncated {len(data) - end} bytes]"

    assert got == [cut(t) for t in texts]


def test_message_has_all_sections(spark):
    key = "ecosystem string, name string, version string"
    s1 = spark.createDataFrame([("npm", "p", "1", 5, "suspicious", True)], f"{key}, score long, verdict string, deferring boolean")
    findings = spark.createDataFrame([("npm", "p", "1", n, "NPM002", "high", "other", f"f{n}", "x" * 3000, "m", True, ["net_http"]) for n in range(90)], f"{key}, ordinal int, rule_id string, severity string, category string, location string, excerpt string, message string, defers boolean, capabilities array<string>")
    hooks = spark.createDataFrame([("npm", "p", "1", "postinstall", "install_time", "node x.js", None)], f"{key}, hook string, kind string, body string, path string")
    manifests = spark.sql("SELECT 'npm' ecosystem, 'p' name, '1' version, 'https://r' repository, cast(null AS string) homepage, map('b', './b', 'a', './a') bin, map('d', '1') dependencies")
    registry = spark.sql("SELECT 'npm' ecosystem, 'p' name, '1' version, timestamp'2024-01-30' published_at, cast(null AS timestamp) package_created_at, 'me' published_by, transform(sequence(1, 9), i -> concat('o', i)) maintainers, 4 total_versions")
    about = stage2.manifest_summary(manifests), stage2.registry_summary(registry, F.lit("2024-02-01").cast("timestamp"))
    row = stage2.user_message(stage2.contexts(s1, findings, hooks, *about)).first()
    m = row["message"]
    titles = ["=== First stage ===", "=== Manifest ===", "=== Registry ===", "=== Install hooks ===", "=== Findings ==="]
    assert [m.index(t) for t in titles] == sorted(m.index(t) for t in titles) and m.startswith(stage2.TASK) and m.endswith(stage2.ADVICE)
    assert "stage1_findings: 90\n" in m and "repository: https://r\nbin:\n  - a: ./a\n  - b: ./b\ndependency_count: 1\n" in m and "homepage" not in m
    assert "(2 days ago)" in m and "maintainers (9): o1, o2, o3, o4, o5, o6, o7, o8, …\ntotal_versions: 4\n" in m and "…[truncated 1976 bytes]" in m
    own = 1024 + len("…[truncated 1976 bytes]".encode()) + len("NPM002") + 1 + len("f0") + 64
    assert 60_000 < row["approx_chars"] <= 60_000 + own + 1 and len(row["excerpts"]) < 60
    plain = stage2.user_message(stage2.contexts(s1, findings, hooks)).first()["message"]
    assert "Manifest" not in plain and "Registry" not in plain


def test_streaming_budget(spark, tmp_path):
    """The stream's state gives what the batch form gives."""
    rows = [("a" if i % 3 else "b", 1_700_000_000 + 60 * i, i, 50 + i % 40, 45 + i % 50, i % 30) for i in range(300)]
    calls = spark.createDataFrame(rows, "pool string, ts long, call_id long, est_in long, used_in long, used_out long").selectExpr("pool", "timestamp_seconds(ts) ts", "call_id", "est_in", "used_in", "used_out")
    for k in range(3):
        calls.where(f"call_id div 100 = {k}").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    caps = stage2.Caps(600, 400, 3_000, 2_000, 40)
    stream = spark.readStream.schema(calls.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = feed.budget(stream, caps).writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("admitted").collect())) == sorted(map(tuple, stage2.greedy_budget(calls, caps).collect()))


def test_specs(spark):
    lines = spark.createDataFrame([(x,) for x in ("@s/a@1.0", " b ", "# c", "", "d@2")], "value string")
    assert {(r["name"], r["version"]) for r in catalog.specs(lines).collect()} == {("@s/a", "1.0"), ("b", None), ("d", "2")}


def test_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text('{"seq": 1, "id": "a"}\n\nno json\n{"seq": 2, "id": "a"}\n{"seq": 3, "id": "b", "deleted": true}\n{"seq": 4, "id": "c"}\n')
    seen = []
    query = feed.follow(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, n: seen.extend((r["id"], r["seq"]) for r in df.collect()))
    query.awaitTermination(60)
    assert sorted(seen) == [("a", 2), ("c", 4)]


def test_second_stage(spark):
    assert stage2.inline_json('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}' and stage2.inline_json("{ no") is None
    answer = 'so {"verdict": "malicious", "recommended_action": "block", "confidence": 7}'
    assert stage2.parsed_answer(answer)["confidence"] == 1.0
    df = spark.createDataFrame([("bad",), ("raise",)], "message string")

    def ask(message):
        if message == "raise":
            raise RuntimeError
        return {"model": "m", "verdict": "clean", "confidence": 0.9, "reasoning": "", "indicators": [], "recommended_action": "allow", "tokens_in": 1, "tokens_out": 1}

    got = {r["message"]: r["stage2"] for r in stage2.adjudicate(df, ask).collect()}
    assert got["bad"]["verdict"] == "clean" and got["raise"] is None
    assert stage2.adjudicate(df).where("stage2 IS NOT NULL").count() == 0
