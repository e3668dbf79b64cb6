"""The change log as a source, state over batches, the job that keeps the catalog, several writers, and the catalog as a data source."""

import json
import random
import threading

import pytest
from pyarrow import fs as pafs
from pyspark.sql import Row
from pyspark.sql import functions as F

from palisade.operators import history
from palisade.sources import catalog, catalog_source, change_log
from palisade.streaming import feed, state


def change(seq, name="a", **more):
    return json.dumps({"seq": seq, "id": name, **more})


def segment(folder, lines, first=None, end="\n"):
    folder.mkdir(exist_ok=True)
    first = json.loads(next(x for x in lines if x.startswith('{"seq"')))["seq"] if first is None else first
    (folder / f"{first:020d}.jsonl").write_text("\n".join(lines) + end)


def test_newest_seq_is_found_from_the_end(tmp_path, monkeypatch):
    monkeypatch.setattr(change_log, "TAIL", 7)
    log = tmp_path / "log"
    uri = f"file://{log}"
    assert change_log.newest_seq(uri) is None
    segment(log, [change(1), change(2, "ü" * 50)])
    assert change_log.newest_seq(uri) == 2
    segment(log, [change(3), "", "", '{"last_seq": 9}', change(4)], end="")  # the last line isn't complete
    assert change_log.newest_seq(uri) == 3
    (log / f"{5:020d}.jsonl").write_text("")
    (log / "notes.txt").write_text(change(99) + "\n")
    assert change_log.newest_seq(uri) == 3


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_splits_give_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(change_log, "BLOCK", 11)
    rng = random.Random(size)
    lines = [rng.choice(["", "no json", change(i, "n" * rng.randrange(30))]) for i in range(60)] + [change(60)]
    segment(tmp_path / "log", lines, 0)
    reader = change_log.ChangeReader({"path": f"file://{tmp_path}/log", "splitbytes": str(size)})
    splits = reader.partitions({"seq": 9}, {"seq": 55})
    got = [tuple(r.values())[0] for s in splits for b in reader.read(s) for r in b.to_pylist()]
    assert got == [json.loads(x)["seq"] for x in lines if x.startswith("{") and 9 < json.loads(x)["seq"] <= 55]


def test_only_segments_of_the_range_are_read(tmp_path):
    for k in range(5):
        segment(tmp_path / "log", [change(i) for i in range(10 * k, 10 * k + 10)])
    reader = change_log.ChangeReader({"path": f"file://{tmp_path}/log"})
    names = lambda a, b: [int(s.path[-26:-6]) for s in reader.partitions({"seq": a}, {"seq": b})]
    assert names(-1, 49) == [0, 10, 20, 30, 40] and names(19, 25) == [20] and names(18, 30) == [10, 20, 30] and names(49, 49) == [40]


def run(stream, handle, checkpoint):
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def test_stream_starts_at_since_stops_and_goes_on(spark, tmp_path):
    log, seen = tmp_path / "log", []
    uri = f"file://{log}"
    keep = lambda batch, n: seen.extend(tuple(r) for r in batch.select("seq", "id", "deleted").collect())
    segment(log, [change(1), change(2, "b"), "", change(3, "c", deleted=True), "{broken", change("4"), change(5, None)])
    run(change_log.read_stream(spark, uri, 1), keep, tmp_path / "ck")
    assert seen == [(2, "b", False), (3, "c", True)]
    run(change_log.read_stream(spark, uri, 1), keep, tmp_path / "ck")
    assert len(seen) == 2
    with open(log / f"{1:020d}.jsonl", "a") as f:  # the segment grows, and another one comes
        f.write(change(6, "d") + "\n")
    segment(log, [change(7, "e"), change(8, "f")])
    run(change_log.read_stream(spark, uri, 0), keep, tmp_path / "ck")  # the checkpoint's offset counts, not since
    assert sorted(seen[2:]) == [(6, "d", False), (7, "e", False), (8, "f", False)]

    def fails(batch, n):
        raise RuntimeError("lost")

    segment(log, [change(9, "g")])
    with pytest.raises(Exception, match="lost"):
        run(change_log.read_stream(spark, uri), fails, tmp_path / "ck")
    run(change_log.read_stream(spark, uri), keep, tmp_path / "ck")
    assert seen[-1] == (9, "g", False) and len(seen) == 6


def test_segments_are_written_in_order(spark, tmp_path):
    uri = f"file://{tmp_path}/log"
    rows = spark.range(1000).select(F.col("id").alias("seq"), F.to_json(F.struct(F.col("id").alias("seq"), F.lit("x").alias("id"))).alias("value"))
    assert change_log.write_segments(rows.repartition(5), uri, 300) >= 2 and change_log.newest_seq(uri) == 999
    reader = change_log.ChangeReader({"path": uri})
    got = [r["seq"] for s in reader.partitions({"seq": -1}, {"seq": 999}) for b in reader.read(s) for r in b.to_pylist()]
    assert got == list(range(1000))
    assert change_log.write_segments(rows.limit(0), uri) == 0


def flights_by_hand(rows, timeout, upto):
    """The rules of InFlight on rows (name, seq, at, ended), by a plain loop."""
    out = []
    for name in {r[0] for r in rows}:
        until, waiting = None, []

        def end(at, name=name):
            nonlocal until, waiting
            until = None
            if waiting:
                out.append((name, waiting[-1], at, len(waiting)))
                until, waiting = at + timeout, []

        for _, seq, at, ended in sorted((r for r in rows if r[0] == name), key=lambda r: (r[2], r[1])):
            while until is not None and until <= at:
                end(until)
            if ended and until is not None:
                end(at)
            elif not ended and until is None:
                out.append((name, seq, at, 0))
                until = at + timeout
            elif not ended:
                waiting.append(seq)
        while until is not None and until < upto:
            end(until)
    return sorted(out)


def test_in_flight_over_batches(spark, tmp_path):
    rng, rows, at = random.Random(5), [], 1_700_000_000_000
    for seq in range(400):
        at += rng.randrange(1, 4_000)
        rows.append((f"p{rng.randrange(6) ** 2 % 7}", seq, at, rng.random() < 0.2))
    rows.append(("quiet", 400, at + 1, False))
    rows.append(("other", 401, at + 60_000, False))  # moves the watermark past the last time-outs
    rows.append(("last", 402, at + 90_000, False))  # and the batch after that fires their timers
    out = f"file://{tmp_path}/out"
    for k in range(4):
        part = rows[k * 134 : (k + 1) * 134]
        segment(tmp_path / "log", [json.dumps({"seq": s, "id": n, "at": t, "ended": e}) for n, s, t, e in part])
        v = F.from_json("value", "at LONG, ended BOOLEAN")
        stream = change_log.read_stream(spark, f"file://{tmp_path}/log").withColumn("v", v)
        stream = stream.select(F.lit("npm").alias("ecosystem"), F.col("id").alias("name"), "seq", F.timestamp_millis("v.at").alias("at"), F.col("v.ended").alias("ended"))
        run(state.in_flight(stream, 9_000), feed.into(out), tmp_path / "ck")
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("name", "seq", "at_ms", "waited").collect())
    assert got == flights_by_hand(rows, 9_000, at + 60_000)
    assert any(w > 1 for *_, w in got)


def test_capabilities_from_state(spark, tmp_path):
    """In time order they are those of the strict baselines; a late version meets the newest five that have come; a version put again isn't its own baseline."""
    rng = random.Random(3)
    names = ["net_http", "net_dns", "crypto_miner", "self_delete"]
    rows = [("npm", f"p{i % 3}", f"{i:03d}", i, i * 1000, rng.sample(names, rng.randrange(3)), "malicious" if i % 17 == 0 else "clean", i % 19 > 0) for i in range(90)]
    late = [("npm", "p0", "000b", 90, 500, ["net_dns"], "clean", True), ("npm", "p1", "088", 91, 88_000, ["crypto_miner", "self_delete"], "clean", True)]
    kind = "ecosystem string, name string, version string, seq long, ms long, capabilities array<string>, status string, complete boolean"
    out = f"file://{tmp_path}/out"
    for k, part in enumerate((rows[:40], rows[40:], late)):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withColumn("published_at", F.timestamp_millis("ms"))
        run(state.capability_changes(stream), feed.into(out), tmp_path / "ck")
    got = [tuple(r) for r in spark.read.parquet(out).select("name", "version", "outcome", F.array_sort("introduced")).collect()]
    strict = history.outcome(history.strict_baselines(spark.createDataFrame(rows, kind).withColumn("published_at", F.timestamp_millis("ms"))))
    want = [tuple(r) for r in strict.select("name", "version", "outcome", F.array_sort("introduced")).collect()]
    of = lambda x: sorted(map(str, x))
    assert len(got) == 92 and set(of(want)) <= set(of(got))
    known = {r[2]: r for r in rows}
    for v, name in (("000b", "p0"), ("088", "p1")):
        others = sorted((r for r in rows if r[1] == name and r[2] != v), key=lambda r: (r[4], r[2]), reverse=True)[:5]
        own = [x for x in late if x[2] == v][0]
        if others[0][6] == "malicious":
            expected = ("abstained_poisoned_baseline", [])
        elif not all(o[7] for o in others):
            expected = ("abstained_baseline_incomplete", [])
        else:
            expected = ("produced", sorted(set(own[5]) - {c for o in others for c in o[5]}))
        assert (name, v, *expected) in [(a, b, c, d) for a, b, c, d in got] and (v in known) == (v == "088")


VERDICTS = "ecosystem string, name string, version string, analyzed_at timestamp, integrity string, status string"


def verdicts(df, status="clean", day=1):
    return df.select("ecosystem", "name", "version", F.lit(f"2024-01-0{day}").cast("timestamp").alias("analyzed_at"), F.lit("i").alias("integrity"), F.lit(status).alias("status"))


def test_feed_keeps_the_catalog(spark, tmp_path):
    path, log, asked = f"file://{tmp_path}/catalog", tmp_path / "log", []
    latest = {"a": "3", "b": "1", "none": None}
    package = lambda *rows: spark.createDataFrame(list(rows), "ecosystem string, name string, version string")
    catalog.upsert(spark, verdicts(package(("npm", "b", "1")), "block"), path)

    def registry(spark):
        docs = [("npm", n, json.dumps({"dist-tags": {"latest": v}} if v else {})) for n, v in latest.items()]
        return spark.createDataFrame(docs, "ecosystem string, name string, value string")

    def analyze(todo, lost=False):
        asked.append(sorted((r["name"], r["version"]) for r in todo.collect()))
        return verdicts(todo, "warn", 2)

    go = lambda f=analyze: feed.to_catalog(spark, f"file://{log}", str(tmp_path / "ck"), registry, path, VERDICTS, f).awaitTermination()
    segment(log, [change(i, "a") for i in range(1, 6)] + [change(6, "b"), change(7, "none"), change(8, "unknown"), change(9, "gone", deleted=True)])
    go()
    held = lambda: {(r["name"], r["version"]): r["status"] for r in catalog.read(spark, path, VERDICTS).collect()}
    assert asked == [[("a", "3")]] and held() == {("b", "1"): "block", ("a", "3"): "warn"}
    segment(log, [change(10, "a"), change(11, "b")])
    latest["b"] = "2"  # the registry is read anew
    real = catalog.upsert

    def put_then_lost(*args):
        real(*args)
        raise RuntimeError("lost after the put")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalog, "upsert", put_then_lost)
        with pytest.raises(Exception, match="lost after the put"):
            go()
    before = held()
    go()  # the batch comes again and finds its verdicts
    assert asked[1:] == [[("b", "2")], []] and held() == before == {("b", "1"): "block", ("a", "3"): "warn", ("b", "2"): "warn"}


def test_several_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    part = lambda k: verdicts(spark.range(40).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit(f"w{k}-"), F.col("id").cast("string")).alias("name"), F.lit("1").alias("version")))
    numbers, errors = [], []

    def put(k):
        try:
            numbers.append(catalog.upsert(spark, part(k), path))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=put, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(numbers) == [1, 2, 3, 4]
    assert catalog.read(spark, path, VERDICTS).count() == 160
    assert catalog.read(spark, path, VERDICTS, number=1).count() == 40


def test_a_writer_goes_on_from_what_others_made(spark, tmp_path, monkeypatch):
    """Between another's reading and its snapshot a newer verdict of the same key comes: the newest stays, and untouched buckets aren't written again."""
    path = f"file://{tmp_path}/catalog"
    one = lambda status, day: verdicts(spark.sql("SELECT 'npm' ecosystem, 'p' name, '1' version"), status, day)
    many = verdicts(spark.range(200).select(F.lit("npm").alias("ecosystem"), F.col("id").cast("string").alias("name"), F.lit("1").alias("version")), "warn", 1)
    real, first = catalog._swap, []

    def late(*args):
        if not first:
            first.append(1)
            catalog.upsert(spark, one("block", 3), path)
        return real(*args)

    monkeypatch.setattr(catalog, "_swap", late)
    assert catalog.upsert(spark, one("clean", 2).unionByName(many), path) == 2
    got = {r["name"]: r["status"] for r in catalog.read(spark, path, VERDICTS).collect()}
    assert got["p"] == "block" and len(got) == 201
    runs = {f.rpartition("/")[0] for f in catalog._snapshot(spark, path)[1].values()}
    assert len(runs) == 2  # the large run, and one for the bucket that both touched
    assert catalog.vacuum(spark, path, keep=1) == 0 and catalog.vacuum(spark, path, keep=1, grace_s=-10) >= 1
    assert {r["name"]: r["status"] for r in catalog.read(spark, path, VERDICTS).collect()} == got
    assert not catalog._swap(spark, path, 2, {})


def documents(spark, n):
    digest = F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), r"[\r\n]", "")
    rows = spark.range(n).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("@s/p"), F.col("id").cast("string")).alias("name"), F.lit("1").alias("version"), F.lit("sha256").alias("algo"), digest.alias("digest_b64"))
    return rows.withColumn("body", F.to_json(F.struct(F.lit("clean").alias("status"), F.col("digest_b64").alias("n"))))


def test_catalog_source_round_trip_and_lookup(spark, tmp_path, monkeypatch):
    catalog_source.register(spark)
    folder = f"file://{tmp_path}/files"
    rows = documents(spark, 30)
    for _ in range(2):
        rows.write.format("verdict_catalog").mode("append").save(folder)
    held = spark.read.format("verdict_catalog").load(folder)
    assert sorted(map(tuple, held.select("name", F.get_json_object("body", "$.n")).collect())) == sorted(map(tuple, rows.select("name", "digest_b64").collect()))
    assert not list((tmp_path / "files").glob("_staged*"))
    # The same files as those of the catalog's own writer.
    other = f"file://{tmp_path}/other"
    catalog.write_documents(rows.select("ecosystem", "name", "version", F.struct("algo", "digest_b64").alias("integrity"), F.lit("clean").alias("status"), F.lit("x").alias("analyzed_at")), other)
    names = lambda x: sorted(str(p.relative_to(tmp_path / x)) for p in (tmp_path / x).rglob("*.json"))
    assert names("files") == names("other")
    by_name = held.where("ecosystem = 'npm' AND name = '@s/p7' AND version = '1' AND body LIKE '%clean%'")
    want = rows.where("name = '@s/p7'").first()
    assert [r["digest_b64"] for r in by_name.collect()] == [want["digest_b64"]]
    plan = by_name._jdf.queryExecution().executedPlan().toString()
    condition = plan[plan.index("Filter") :].split("\n")[0] if "Filter" in plan else ""
    assert "@s/p7" not in condition  # the key went to the source, the rest is left to Spark
    assert "body" in condition
    by_content = held.where(F.col("algo") == "sha256").where(F.col("digest_b64") == want["digest_b64"])
    assert [r["name"] for r in by_content.collect()] == ["@s/p7"] and by_content.rdd.getNumPartitions() == 1
    assert held.where("algo = 'sha256' AND digest_b64 = 'no digest'").collect() == held.where("ecosystem = 'npm' AND name = 'x' AND version = '1'").collect() == []
    assert spark.read.format("verdict_catalog").load(f"file://{tmp_path}/nothing").collect() == []


def test_a_lookup_opens_two_files_and_lists_nothing(tmp_path):
    opened = []

    class Counting(pafs.LocalFileSystem):
        pass

    reader = catalog_source.Reader(f"file://{tmp_path}/files")
    writer = catalog_source.Writer(f"file://{tmp_path}/files")
    row = ("npm", "a", "1", "sha256", "q6s=", '{"status": "clean"}')
    writer.commit([writer.write(iter([catalog_source._batch([row])]))])
    own = catalog_source._text
    catalog_source._text = lambda fs, path: (opened.append(path), own(fs, path))[1]
    try:
        taken = [catalog_source.EqualTo(("ecosystem",), "npm"), catalog_source.EqualTo(("name",), "a"), catalog_source.EqualTo(("version",), "1")]
        assert list(reader.pushFilters(taken)) == []
        (part,) = reader.partitions()
        assert [b.num_rows for b in reader.read(part)] == [1] and len(opened) == 2
    finally:
        catalog_source._text = own


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    catalog_source.register(spark)
    folder = f"file://{tmp_path}/files"
    bad = documents(spark, 10).withColumn("digest_b64", F.when(F.col("name") == "@s/p9", "?").otherwise(F.col("digest_b64")))
    with pytest.raises(Exception, match="."):
        bad.repartition(3).write.format("verdict_catalog").mode("append").save(folder)
    assert not [p for p in (tmp_path / "files").rglob("*.json")]
    assert spark.read.format("verdict_catalog").load(folder).count() == 0


class Calls:
    """A state of one value, and its timers, that counts the calls of it."""

    def __init__(self):
        self.value, self.timers, self.n = None, set(), 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.value, self.n = value, self.n + 1

    def clear(self):
        self.update(None)

    def registerTimer(self, at):
        self.timers.add(at)
        self.n += 1

    def deleteTimer(self, at):
        self.timers.discard(at)
        self.n += 1


def test_state_is_called_once_for_many_rows_in_flight():
    held, job = Calls(), state.InFlight(10)
    job.init(held)
    rows = [Row(at_ms=t, seq=t, ended=t % 7 == 6) for t in range(0, 400, 2)]
    assert len(list(job.handleInputRows(("npm", "a"), iter(rows), None))) > 20
    assert held.n <= 3 and held.timers == {held.value[0]}
    held.n = 0
    list(job.handleInputRows(("npm", "a"), iter(rows[:3]), None))
    assert held.n <= 4 and held.timers == {held.value[0]}


def test_state_is_called_once_for_many_verdicts():
    held, job = Calls(), state.Newest(5)
    job.init(held)
    rows = [Row(verdict=json.dumps({"seq": i, "version": str(i), "published_ms": i, "capabilities": ["a", f"c{i % 9}"], "status": "clean", "complete": True})) for i in range(100)]
    first = list(job.handleInputRows(("npm", "a"), iter(rows[:50]), None))
    assert held.n == 2 and len(json.loads(held.value[0])) == 6
    both = first + list(job.handleInputRows(("npm", "a"), iter(rows[50:]), None))
    assert held.n == 4 and [r["outcome"] for r in both[:6]] == ["not_attempted"] + ["abstained_baseline_incomplete"] * 4 + ["produced"]
    assert all(r["introduced"] == [f"c{i % 9}"] for i, r in enumerate(both) if i >= 5)


def test_the_registry_is_read_once_in_a_batch_and_parsed_where_changes_are(spark, tmp_path, monkeypatch):
    """Read twice, its versions could differ between the look for buckets and the list of what is missing."""
    path, log, read, parsed = f"file://{tmp_path}/catalog", tmp_path / "log", spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    real = catalog.documented_latest

    def document(name):
        read.add(1)
        return json.dumps({"dist-tags": {"latest": "1"}} if name != "3" else {})

    def seen(value):
        parsed.add(1)
        return value

    monkeypatch.setattr(catalog, "documented_latest", lambda docs: real(docs.withColumn("value", F.udf(seen)("value"))))
    registry = lambda spark: spark.range(30).select(F.lit("npm").alias("ecosystem"), F.col("id").cast("string").alias("name"), F.udf(document)(F.col("id").cast("string")).alias("value"))
    segment(log, [change(1, "2"), change(2, "3"), change(3, "5"), change(4, "2"), change(5, "unknown")])
    feed.to_catalog(spark, f"file://{log}", str(tmp_path / "ck"), registry, path, VERDICTS, verdicts).awaitTermination()
    assert sorted(r["name"] for r in catalog.read(spark, path, VERDICTS).collect()) == ["2", "5"]
    assert read.value <= 30 and parsed.value == 3


def test_an_upsert_writes_one_file_for_each_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    some = lambda a, b, status, day: verdicts(spark.range(a, b, 1, 4).select(F.lit("npm").alias("ecosystem"), F.col("id").cast("string").alias("name"), F.lit("1").alias("version")), status, day)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with much data
    try:
        catalog.upsert(spark, some(0, 2000, "warn", 1), path)
        first = catalog._snapshot(spark, path)[1]
        catalog.upsert(spark, some(1000, 3000, "clean", 2).unionAll(some(2500, 3500, "clean", 2)), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for folders in (first, catalog._snapshot(spark, path)[1]):
        assert len(folders) == catalog.BUCKETS
        assert {len(list((tmp_path / f.removeprefix(f"file://{tmp_path}/")).glob("*.parquet"))) for f in folders.values()} == {1}
    got = {int(r["name"]): r["status"] for r in catalog.read(spark, path, VERDICTS).collect()}
    assert got == {i: "warn" if i < 1000 else "clean" for i in range(3500)} and catalog.read(spark, path, VERDICTS).count() == 3500


def test_lines_parsed_together_are_those_parsed_one_by_one():
    good = [change(1), change(2, "ü\\u2028"), change(3, deleted=True), ' {"seq": 4, "id": "x"}\r', change(5, "[1,2]")]
    odd = [
        [], [""], ["", change(1), ""], ["   "], ["﻿" + change(1)], ["﻿" + change(1), change(2)], ["no json", change(1)], ["null", "[]", "1", '"a"', change(1)],
        ['{"seq": 1, "id": "a"},{"seq": 2, "id": "b"}', '{"z": [{"w": 1}', '{"v": 1}]}'], ['{"seq": 1, "id": "a"}]', '[{"seq": 2, "id": "b"}'], ['{"seq": 1, "id":', '"a"}'],
        ['{"seq": 1, "id": "a"', '"deleted": true}'], [change(True), change(1.0), change(-1), change(1 << 63), change("1"), change(1, None), change(1, deleted=None)], ['{"seq": 1, "seq": 2, "id": "a"}'],
        ['{"seq": ' + "9" * 5000 + ', "id": "a"}', change(7)], [change_log.MARK, change(1)], [f'{change(1)},{change_log.MARK},{change(2)}', change(3)],
    ]
    for lines in [good, *odd, *[[*good, *x] for x in odd]]:
        raw = [x.encode() for x in lines] + ([b'{"seq": 6, "id": "\xff"}'] if len(lines) % 2 else [])
        assert change_log.parsed_all(raw) == [r for x in raw if (r := change_log.parsed(x))]
    assert [r[0] for r in change_log.parsed_all([x.encode() for x in good])] == [1, 2, 3, 4, 5]


def test_a_stream_of_fewer_columns(spark, tmp_path):
    seen = []
    segment(tmp_path / "log", [change(1), change(2, "b", deleted=True)])
    stream = change_log.read_stream(spark, f"file://{tmp_path}/log", schema=feed.CHANGE)
    run(stream, lambda batch, n: seen.extend(tuple(r) for r in batch.collect()), tmp_path / "ck")
    assert stream.columns == ["seq", "id", "deleted"] and sorted(seen) == [(1, "a", False), (2, "b", True)]


def test_small_segments_share_a_task(spark, tmp_path, monkeypatch):
    lines = [[change(i, "n" * (i % 30)) for i in range(10 * k, 10 * k + 10)] for k in range(40)]
    for part in lines:
        segment(tmp_path / "log", part)
    options = {"path": f"file://{tmp_path}/log"}
    seqs = lambda parts, reader: [r["seq"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    for shared, split in ((1, 10**6), (900, 10**6), (10**6, 10**6), (10**6, 700), (1, 64)):
        monkeypatch.setattr(change_log, "SHARED", shared)
        reader = change_log.ChangeReader(options | {"cores": "4", "splitbytes": str(split)})
        parts = reader.partitions({"seq": 14}, {"seq": 385})
        assert seqs(parts, reader) == list(range(15, 386))
        assert all(len(p.splits) == 1 or sum(s.end - s.start for s in p.splits) <= min(split, max(shared, 2000)) for p in parts)
        assert (len(parts) == 1) == (shared == split) and (len(parts) <= 40 or split == 64)
    monkeypatch.undo()
    tasks = []
    stream = change_log.read_stream(spark, f"file://{tmp_path}/log")
    run(stream, lambda batch, n: tasks.append((batch.rdd.getNumPartitions(), batch.count())), tmp_path / "ck")
    assert tasks == [(1, 400)]
