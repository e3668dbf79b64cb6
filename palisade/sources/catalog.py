"""The verdict catalog: content-addressed paths, idempotent upserts, lookups, and lists of work."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators.rules import PACKAGE


def integrity_path(algo: Column, digest_b64: Column) -> Column:
    """verdicts/by-integrity/<algo>/<two hex digits>/<rest>.json"""
    digits = F.lower(F.hex(F.unbase64(digest_b64)))
    return F.concat(F.lit("verdicts/by-integrity/"), algo, F.lit("/"), F.substring(digits, 1, 2), F.lit("/"), F.substring(digits, F.lit(3), F.length(digits)), F.lit(".json"))


def pointer_path(ecosystem: Column, name: Column, version: Column) -> Column:
    """verdicts/<ecosystem>/<name>/<version>.json, with @ and / of the name escaped."""
    safe = F.replace(F.replace(name, F.lit("@"), F.lit("%40")), F.lit("/"), F.lit("%2F"))
    return F.concat(F.lit("verdicts/"), ecosystem, F.lit("/"), safe, F.lit("/"), version, F.lit(".json"))


def latest(verdicts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The newest verdict of each key (by analyzed_at, then integrity)."""
    key = key or PACKAGE
    order = Window.partitionBy(*key).orderBy(F.desc("analyzed_at"), F.desc("integrity"))
    return verdicts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: Buckets that a catalog's keys are dealt to; an upsert reads and writes those that it touches. The folder of its snapshots.
BUCKETS, SNAPSHOTS = 64, "snapshots"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the catalog's snapshots, in order."""
    hadoop, at, fs = _files(spark, path)
    folder = hadoop.Path(at, SNAPSHOTS)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _snapshot(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """(number, bucket to folder) of a snapshot, by default the last one; (0, none) of a catalog without any."""
    if number is None:
        number = max(_numbers(spark, path), default=0)
    if not number:
        return 0, {}
    lines = spark.read.text(f"{path}/{SNAPSHOTS}/{number:020d}.json").collect()
    return number, json.loads("".join(r["value"] for r in lines))


def _bucket(number: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*PACKAGE), F.lit(number)).cast("string")


def read(spark: SparkSession, path: str, schema, buckets: list[str] | None = None, number: int | None = None) -> DataFrame:
    """The verdicts of the catalog (or some buckets of it), of which each key has one; number: of an older snapshot."""
    return _of(spark, _snapshot(spark, path, number)[1], schema, buckets)


def read_for(spark: SparkSession, packages: DataFrame, path: str, schema) -> DataFrame:
    """The buckets of the catalog that hold verdicts of these packages, if any do."""
    return read(spark, path, schema, [r["b"] for r in packages.select(_bucket().alias("b")).distinct().collect()])


def _of(spark: SparkSession, snapshot: dict[str, str], schema, buckets: list[str] | None) -> DataFrame:
    folders = [f for b, f in snapshot.items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, new: DataFrame, path: str, tries: int = 20) -> int:
    """Adds verdicts to the catalog at path; the newest of a key stays, and putting one twice changes nothing. Gives the snapshot's number.

    Touched buckets are written to new folders, each by one task as one file. Then a snapshot, a file that names the folder of every bucket, is created under
    the next number, which only one writer can do: readers see all of an upsert or nothing, and a crash leaves the old catalog. A
    writer that was not the first to that number goes on from what the others have made: only buckets that they have touched,
    too, are written again.
    """
    number, base = _snapshot(spark, path)
    new = new.withColumn("_bucket", _bucket()).persist()
    try:
        touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]
        if not touched:
            return number
        written: dict[str, str] = {}
        for _ in range(tries):
            todo = [b for b in touched if b not in written]
            if todo:
                run = f"{path}/data/{uuid.uuid4().hex}"
                schema = new.drop("_bucket").schema
                both = _of(spark, base, schema, todo).unionByName(new.where(F.col("_bucket").isin(todo)).drop("_bucket"))
                dealt = both.withColumn("_bucket", _bucket()).repartition(len(todo), "_bucket")
                latest(dealt, ["_bucket", *PACKAGE]).write.partitionBy("_bucket").parquet(run)
                written |= {b: f"{run}/_bucket={b}" for b in todo}
            if _swap(spark, path, number + 1, base | written):
                return number + 1
            number, other = _snapshot(spark, path)
            written = {b: f for b, f in written.items() if other.get(b) == base.get(b)}
            base = other
        raise RuntimeError(f"{path}: other writers were first {tries} times")
    finally:
        new.unpersist()


def _swap(spark: SparkSession, path: str, number: int, snapshot: dict[str, str]) -> bool:
    """Makes the snapshot the one of this number, if there is none yet."""
    hadoop, at, fs = _files(spark, path)
    target = hadoop.Path(at, f"{SNAPSHOTS}/{number:020d}.json")
    fs.mkdirs(target.getParent())
    draft = hadoop.Path(at, f"{SNAPSHOTS}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(snapshot).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # a local rename would replace the file; a link is made by one writer only
            local = lambda p: spark._jvm.java.nio.file.Paths.get(p.toUri())
            plain = lambda p: hadoop.Path(fs.makeQualified(p).toUri())
            spark._jvm.java.nio.file.Files.createLink(local(plain(target)), local(plain(draft)))
        else:
            none = spark._sc._gateway.new_array(hadoop.Options.Rename, 0)
            hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2, grace_s: float = 86_400) -> int:
    """Removes all snapshots but the last `keep`, and buckets' folders that none of those names; gives how many folders went.

    Folders younger than grace_s stay: a writer that has not ended yet may be about to name them.
    """
    hadoop, at, fs = _files(spark, path)
    numbers = _numbers(spark, path)
    for number in numbers[:-keep]:
        fs.delete(hadoop.Path(at, f"{SNAPSHOTS}/{number:020d}.json"), False)
    named = {f for n in numbers[-keep:] for f in _snapshot(spark, path, n)[1].values()}
    named = {f.rpartition("/data/")[2] for f in named}
    limit, gone, data = (time.time() - grace_s) * 1000, 0, hadoop.Path(at, "data")
    for run in fs.listStatus(data) if fs.exists(data) else []:
        left = 0
        for bucket in fs.listStatus(run.getPath()):
            name = bucket.getPath().getName()
            if not bucket.isDirectory() or f"{run.getPath().getName()}/{name}" in named or bucket.getModificationTime() > limit:
                left += bucket.isDirectory()
                continue
            fs.delete(bucket.getPath(), True)
            gone += 1
        if not left and run.getModificationTime() <= limit:
            fs.delete(run.getPath(), True)
    return gone


def documents(verdicts: DataFrame) -> DataFrame:
    """(path, content) of the catalog's files for verdicts with struct columns integrity (algo, digest_b64) and any others.

    Each verdict is a JSON document under its content's path, and a pointer to that under its name.
    """
    own = verdicts.withColumn("verdict_path", integrity_path(F.col("integrity.algo"), F.col("integrity.digest_b64")))
    artifact = F.struct(*PACKAGE, "integrity").alias("artifact")
    body = F.to_json(F.struct(artifact, *[c for c in verdicts.columns if c not in (*PACKAGE, "integrity")]))
    pointer = F.to_json(F.struct(artifact, "verdict_path"))
    files = F.array(F.struct(F.col("verdict_path").alias("path"), body.alias("content")), F.struct(pointer_path(*map(F.col, PACKAGE)).alias("path"), pointer.alias("content")))
    return own.select(F.explode(files).alias("f")).select("f.*")


def write_documents(verdicts: DataFrame, folder: str) -> DataFrame:
    """Writes the files below the folder (a URI that all executors reach), each by a rename, and gives the index's rows.

    A task that runs twice writes the same files again.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                target = f"{root}/{path}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(draft) as out:
                    out.write(content.encode())
                fs.move(draft, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    documents(verdicts).mapInArrow(put, "n long").agg(F.sum("n")).collect()
    path = integrity_path(F.col("integrity.algo"), F.col("integrity.digest_b64"))
    return verdicts.select(F.struct(*PACKAGE, "integrity").alias("artifact"), path.alias("verdict_path"), "status", "analyzed_at")


def read_documents(spark: SparkSession, folder: str, fields: str) -> DataFrame:
    """Verdicts of the JSON documents below the folder; fields: DDL of what they hold besides the artifact. Damaged files are left out."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(f"{folder}/verdicts/by-integrity")
    kind = f"artifact struct<ecosystem:string,name:string,version:string,integrity:struct<algo:string,digest_b64:string>>, {fields}"
    return text.select(F.from_json("value", kind).alias("v")).where("v.artifact IS NOT NULL").select("v.artifact.*", "v.*").drop("artifact")


def lookup(verdicts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted packages with their verdicts, null where there is none."""
    return wanted.join(verdicts, PACKAGE, "left")


def missing(wanted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Packages without a verdict: what is left to analyze."""
    return wanted.join(verdicts.select(*PACKAGE), PACKAGE, "left_anti")


def specs(lines: DataFrame, ecosystem: str = "npm", column: str = "value") -> DataFrame:
    """(ecosystem, name, version) of lines like name@version; blank lines and comments are skipped, the version may be absent."""
    t = F.trim(column)
    rows = lines.where((t != "") & ~F.startswith(t, F.lit("#"))).select(t.alias("t"))
    parts = r"\A(.+?)(?:==|@)([^@=]*)\z" if ecosystem == "pypi" else r"\A(.+)@([^@]*)\z"
    name, version = F.regexp_extract("t", parts, 1), F.regexp_extract("t", parts, 2)
    return rows.select(F.lit(ecosystem).alias("ecosystem"), F.when(name != "", name).otherwise(F.col("t")).alias("name"), F.when(name != "", version).alias("version"))


def latest_version(versions: DataFrame) -> DataFrame:
    """NuGet's rule: of versions (ecosystem, name, version, ordinal) the last without a dash, else the last."""
    return versions.groupBy("ecosystem", "name").agg(F.max_by("version", F.struct(~F.col("version").contains("-"), "ordinal")).alias("latest"))


def documented_latest(documents: DataFrame, column: str = "value") -> DataFrame:
    """documents (ecosystem, name, JSON text) of npm, cargo and pypi with the version that each calls its latest, null without one."""
    at = lambda path: F.get_json_object(column, path)
    latest_ = F.when(F.col("ecosystem") == "npm", at("$['dist-tags'].latest")).when(F.col("ecosystem") == "cargo", F.coalesce(at("$.crate.max_stable_version"), at("$.crate.max_version")))
    return documents.select("ecosystem", "name", latest_.when(F.col("ecosystem") == "pypi", at("$.info.version")).alias("latest"))


def backfill(items: DataFrame, latest_: DataFrame, verdicts: DataFrame, available: DataFrame) -> DataFrame:
    """items (ecosystem, name, version, ordinal) with the version meant and what becomes of each.

    An absent version is the latest one; an item without any is missing; one with a verdict, or named before, is already
    present; of the others those with an archive are analyzed and those without have failed.
    """
    rows = items.join(latest_.select("ecosystem", "name", "latest"), ["ecosystem", "name"], "left").withColumn("version", F.coalesce("version", "latest")).drop("latest")
    rows = rows.join(verdicts.select(*PACKAGE).distinct().withColumn("known", F.lit(True)), PACKAGE, "left")
    rows = rows.join(available.select(*PACKAGE).distinct().withColumn("there", F.lit(True)), PACKAGE, "left")
    first = F.row_number().over(Window.partitionBy(*PACKAGE).orderBy("ordinal")) == 1
    done = F.when(F.col("version").isNull(), "missing").when(F.col("known"), "already_present").when(F.col("there"), F.when(first, "analyzed").otherwise("already_present")).otherwise("failed")
    return rows.withColumn("outcome", done).drop("known", "there")


OUTCOMES = ["analyzed", "already_present", "missing", "failed"]


def backfill_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def run_backfill(spark: SparkSession, items: DataFrame, latest_: DataFrame, archives: DataFrame, path: str, schema, analyze: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Analyzes what the catalog at path lacks and adds it; gives the items' outcomes.

    analyze gives verdicts for packages (PACKAGE); one that it gives none for has failed.
    """
    outcomes = backfill(items, latest_, read(spark, path, schema), archives)
    todo = outcomes.where("outcome = 'analyzed'").select(*PACKAGE)
    new = analyze(todo)
    done = new.select(*PACKAGE).distinct().withColumn("done", F.lit(True))
    outcomes = outcomes.join(done, PACKAGE, "left").withColumn("outcome", F.when((F.col("outcome") == "analyzed") & F.col("done").isNull(), "failed").otherwise(F.col("outcome"))).drop("done")
    upsert(spark, new, path)
    return outcomes


def npm_registry(packuments: DataFrame, column: str = "value") -> DataFrame:
    """Registry rows of npm documents (JSON text): one for each version, with who published it and the package's figures.

    A time that can't be read is null; `versions` says which versions there are. Documents that are no JSON objects give no rows.
    """
    spark = packuments.sparkSession
    doc = F.try_parse_json(column)
    text = lambda path, of="doc": F.try_variant_get(of, path, "string")
    time_ = lambda c: F.try_to_timestamp(c)
    names = F.transform(F.try_variant_get("doc", "$.maintainers", "array<variant>"), lambda m: F.try_variant_get(m, "$.name", "string"))
    rows = packuments.select(doc.alias("doc")).where("doc IS NOT NULL")
    rows = rows.select(
        text("$.name").alias("name"), time_(text("$.time.created")).alias("package_created_at"), F.filter(names, lambda m: m.isNotNull()).alias("maintainers"),
        F.try_variant_get("doc", "$.versions", "variant").alias("versions"), F.try_variant_get("doc", "$.time", "map<string,variant>").alias("times"),
    )
    rows = rows.lateralJoin(spark.tvf.variant_explode(F.col("versions").outer())).where("key IS NOT NULL")
    rows = rows.select("*", F.col("key").alias("version"), time_(F.try_variant_get(F.col("times")[F.col("key")], "$", "string")).alias("published_at"))
    own = rows.select(
        F.lit("npm").alias("ecosystem"), "name", "version", "published_at", F.try_variant_get("value", "$._npmUser.name", "string").alias("published_by"), "package_created_at", "maintainers",
        F.size(F.map_keys(F.try_variant_get("versions", "$", "map<string,variant>"))).alias("total_versions"),
    )
    return own


def cargo_registry(documents: DataFrame, column: str = "value") -> DataFrame:
    """Registry rows of crates' documents (JSON text): one for each version with a time, with the crate's figures; owners are not in them."""
    kind = "array<struct<num:string,created_at:string,published_by:struct<login:string>>>"
    at = lambda path: F.get_json_object(column, path)
    rows = documents.select(F.coalesce(at("$.crate.name"), at("$.crate.id")).alias("name"), F.try_to_timestamp(at("$.crate.created_at")).alias("package_created_at"), F.from_json(at("$.versions"), kind).alias("versions"))
    rows = rows.withColumn("total_versions", F.size("versions")).withColumn("v", F.explode("versions")).where("v.num IS NOT NULL")
    out = rows.select(F.lit("cargo").alias("ecosystem"), "name", F.col("v.num").alias("version"), F.try_to_timestamp("v.created_at").alias("published_at"), F.col("v.published_by.login").alias("published_by"), "package_created_at", F.array().cast("array<string>").alias("maintainers"), "total_versions")
    return out.where("published_at IS NOT NULL")
