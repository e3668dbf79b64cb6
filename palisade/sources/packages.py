"""Package archives as tables: one row for each file, with limits; manifests and hooks of the four ecosystems."""

from __future__ import annotations

import io
import json
import re
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import fixed

MIB = 1 << 20
#: Largest file, largest package and most files, by ecosystem; a package beyond them is an error row.
LIMITS = {"npm": (50 * MIB, 100 * MIB, 50_000), "cargo": (50 * MIB, 100 * MIB, 50_000), "pypi": (50 * MIB, 100 * MIB, 50_000), "nuget": (100 * MIB, 200 * MIB, 50_000)}
NUGET_META = ("_rels/", "package/services/")
ENTRY_SCHEMA = "ecosystem string, source string, ordinal int, path string, size long, bytes binary, mode int, scan_error string"


def archives(spark: SparkSession, path: str, ecosystem: Column | str) -> DataFrame:
    """Archive files under a path: (ecosystem, source, content)."""
    eco = F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem
    return spark.read.format("binaryFile").load(path).select(eco.alias("ecosystem"), F.col("path").alias("source"), "content")


def _tar_files(content: bytes, prefix: str | None) -> Iterator[tuple[str, bytes, int]]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
        for m in tar:
            if not m.isfile():
                continue
            if ".." in m.name or m.name.startswith("/"):
                raise ValueError(f"unsafe path {m.name}")
            first, _, rest = m.name.partition("/")
            if prefix is None:
                prefix = first
            if prefix == "package" and first != prefix:
                rest = m.name
            elif first != prefix:
                raise ValueError(f"{m.name} is outside {prefix}")
            yield rest, m.size, m.mode, tar.extractfile(m)


def files_of(ecosystem: str, content: bytes) -> Iterator[tuple[str, int, int | None, bytes]]:
    """(path, size, mode, bytes) of the archive's regular files, within the limits."""
    largest, most, count = LIMITS[ecosystem]
    total = n = 0
    if ecosystem == "nuget":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = [(i.filename, i.file_size, None, z.open(i)) for i in z.infolist() if not i.is_dir()]
            members = [m for m in members if not m[0].startswith(NUGET_META) and m[0] != "[Content_Types].xml" and not m[0].startswith(".signature.")]
            for path, size, mode, handle in members:
                if ".." in path or path.startswith("/"):
                    raise ValueError(f"unsafe path {path}")
                total, n = total + size, n + 1
                if size > largest or total > most or n > count:
                    raise ValueError("oversized")
                yield path, size, mode, handle.read(largest + 1)
        return
    for path, size, mode, handle in _tar_files(content, "package" if ecosystem == "npm" else None):
        total, n = total + size, n + 1
        if size > largest or total > most or n > count:
            raise ValueError("oversized")
        yield path, size, mode, handle.read()


#: Bytes of files after which a batch of rows is handed on, so that no package is held whole besides its archive.
BATCH_BYTES = 8 * MIB
_ENTRY = pa.schema([("ecosystem", pa.string()), ("source", pa.string()), ("ordinal", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("bytes", pa.binary()), ("mode", pa.int32()), ("scan_error", pa.string())])


def entry_rows(ecosystem: str, source: str, content: bytes) -> Iterator[tuple]:
    """Rows of ENTRY_SCHEMA, member by member; an archive that can't be read, or is empty, gives one row with scan_error.

    The archive is read through before the first row comes, so that damage at its end leaves no half package. What fits into
    BATCH_BYTES is held meanwhile; a larger one is read once more, which costs time, but no more memory than that and its largest member.
    """
    held, size, n = [], 0, 0
    try:
        for n, (path, own, mode, data) in enumerate(files_of(ecosystem, content), 1):
            if size < BATCH_BYTES:
                size += len(data) + 100
                held.append((ecosystem, source, n - 1, path, own, data, mode, None))
            if size >= BATCH_BYTES:
                held.clear()
        error = None if n else "no files"
    except Exception as damage:  # any damage of one archive is that archive's result
        error = f"{type(damage).__name__}: {damage}"[:500]
    if error:
        yield ecosystem, source, None, None, None, None, None, error
    elif size < BATCH_BYTES:
        yield from held
    else:
        for ordinal, (path, own, mode, data) in enumerate(files_of(ecosystem, content)):
            yield ecosystem, source, ordinal, path, own, data, mode, None


def entry_batches(rows: Iterator[tuple], schema: pa.Schema = _ENTRY, data: int = 5) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES; data: the place of the column whose bytes count."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[data] or b"") + 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def prepared(spark: SparkSession) -> None:
    """Batches of bounded bytes to Python: rows hold whole archives and texts, so a bound on their number alone doesn't bound memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unpack(packages: DataFrame) -> DataFrame:
    """archives (ecosystem, source, content) exploded to files; a damaged archive has a row with scan_error, never fails the job."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                eco, source, content = (batch.column(c)[i].as_py() for c in ("ecosystem", "source", "content"))
                yield from entry_rows(eco, source, content or b"")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return entry_batches(rows(batches))

    prepared(packages.sparkSession)
    return packages.select("ecosystem", "source", "content").mapInArrow(of, ENTRY_SCHEMA)


@F.udtf(returnType=ENTRY_SCHEMA, useArrow=False)
class Unpack:
    """unpack(ecosystem, source, content) as a table function, for LATERAL joins in SQL (which takes no Arrow ones); rows come one by one."""

    def eval(self, ecosystem: str, source: str, content: bytes) -> Iterator[tuple]:
        yield from entry_rows(ecosystem, source, bytes(content or b""))


def register(spark: SparkSession, name: str = "unpack") -> None:
    """Makes unpack known to the session's SQL: SELECT f.* FROM archives a, LATERAL unpack(a.ecosystem, a.source, a.content) f"""
    spark.udtf.register(name, Unpack)


def native_magic(data: Column) -> Column:
    """ELF, Mach-O (three kinds) and Windows executables by their first bytes."""
    head = F.hex(F.substring(data, 1, 4))
    return head.isin("7F454C46", "CFFAEDFE", "CEFAEDFE", "CAFEBABE") | ((F.length(data) >= 4) & F.startswith(head, F.lit("4D5A")))


def classify(ecosystem: Column, path: Column, data: Column) -> Column:
    """The kind of a file, by extension, magic bytes and whether it is UTF-8."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    text = F.when(F.try_validate_utf8(data.cast("string")).isNotNull(), "text").otherwise("binary")
    native = native_magic(data)
    npm = F.when(ext.isin("js", "mjs", "cjs", "ts", "tsx", "jsx"), "js_source").when(ext == "json", "json").when(ext.isin("node", "wasm") | native, "native_binary")
    cargo = F.when(ext == "rs", "rust_source").when(ext == "toml", "toml").when(ext == "json", "json").when((ext == "wasm") | native, "native_binary")
    pypi = F.when(ext == "py", "py_source").when(ext == "toml", "toml").when(ext == "json", "json").when(ext.isin("so", "pyd", "dll", "wasm") | native, "native_binary")
    nuget = F.when(ext == "json", "json").when(ext.isin("dll", "exe") | native, "native_binary")
    by = F.when(ecosystem == "npm", npm.otherwise(text)).when(ecosystem == "cargo", cargo.otherwise(text)).when(ecosystem == "pypi", pypi.otherwise(text))
    return by.otherwise(nuget.otherwise(text))


def entries(unpacked: DataFrame) -> DataFrame:
    """Files with kind and strict UTF-8 text (null if it isn't)."""
    out = unpacked.where("scan_error IS NULL")
    return out.withColumns({"kind": classify(F.col("ecosystem"), F.col("path"), F.col("bytes")), "text": F.try_validate_utf8(F.col("bytes").cast("string"))})


def integrity(ecosystem: Column, content: Column) -> Column:
    """struct(algo, digest_b64): SHA-512 for npm and nuget, SHA-256 for the others."""
    wide = ecosystem.isin("npm", "nuget")
    b64 = lambda bits: F.regexp_replace(F.base64(F.unhex(F.sha2(content, bits))), r"[\r\n]", "")
    return F.struct(F.when(wide, "sha512").otherwise("sha256").alias("algo"), F.when(wide, b64(512)).otherwise(b64(256)).alias("digest_b64"))


def _toml_manifest(path: str, text: str) -> dict:
    raw = tomllib.loads(text)
    if path == "Cargo.toml":
        package = raw.get("package", {})
        deps = {k: v if isinstance(v, str) else v.get("version", "*") for t in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in raw.get(t, {}).items()}
        bins = {b.get("name", ""): b.get("path", "") for b in raw.get("bin", [])}
        scripts = {"build": package["build"]} if isinstance(package.get("build"), str) else {}
        return {"name": package.get("name"), "version": package.get("version"), "repository": package.get("repository"), "homepage": package.get("homepage"), "bin": bins, "scripts": scripts, "dependencies": deps, "raw": raw}
    project = raw.get("project", {})
    urls = {k.lower(): v for k, v in project.get("urls", {}).items()}
    find = lambda *keys: next((v for k, v in urls.items() if any(x in k for x in keys)), None)
    deps = {m[0]: d[len(m[0]) :].strip() or "*" for d in project.get("dependencies", []) if (m := re.match(r"[A-Za-z0-9._-]+", d))}
    return {"name": project.get("name"), "version": project.get("version"), "repository": find("repository", "source"), "homepage": find("homepage", "home"), "bin": {}, "scripts": {}, "dependencies": deps, "raw": raw}


def _nuspec(text: str) -> dict:
    root = ElementTree.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    meta = root.find("metadata")
    get = lambda tag: (meta.findtext(tag) if meta is not None else None)
    if not get("id"):
        raise ValueError("no id")
    repository = meta.find("repository")
    deps = {d.get("id"): d.get("version", "*") for d in meta.iter("dependency")}
    return {"name": get("id"), "version": get("version"), "repository": repository.get("url") if repository is not None else None, "homepage": get("projectUrl"), "bin": {}, "scripts": {}, "dependencies": deps, "raw": {}}


def _package_json(text: str) -> dict:
    raw = json.loads(text)
    only = lambda x: {k: v for k, v in (x or {}).items() if isinstance(v, str)} if isinstance(x, dict) else {}
    repository, name = raw.get("repository"), raw.get("name") if isinstance(raw.get("name"), str) else ""
    repository = repository.get("url") if isinstance(repository, dict) else repository
    bins = {name: raw["bin"]} if isinstance(raw.get("bin"), str) else only(raw.get("bin"))
    deps = only(raw.get("dependencies")) | only(raw.get("optionalDependencies")) | only(raw.get("peerDependencies"))
    return {"name": name, "version": raw.get("version", ""), "repository": repository, "homepage": raw.get("homepage"), "bin": bins, "scripts": only(raw.get("scripts")), "dependencies": deps, "raw": raw}


MANIFEST = "name string, version string, repository string, homepage string, bin map<string,string>, scripts map<string,string>, dependencies map<string,string>, raw string, scan_error string"


def _manifest(path: str, text: str) -> dict:
    try:
        if path == "package.json":
            m = _package_json(text)
        elif path.endswith(".nuspec"):
            m = _nuspec(text)
        elif path == "PKG-INFO":
            head = dict(line.split(": ", 1) for line in text.split("\n\n")[0].splitlines() if ": " in line)
            m = {"name": head.get("Name"), "version": head.get("Version"), "repository": None, "homepage": head.get("Home-page"), "bin": {}, "scripts": {}, "dependencies": {}, "raw": {}}
        else:
            m = _toml_manifest(path, text)
        text_of = lambda v: v if v is None or isinstance(v, str) else str(v)
        pairs = lambda d: [(k, text_of(v)) for k, v in d.items()]
        found = {k: text_of(m[k]) for k in ("name", "version", "repository", "homepage")} | {k: pairs(m[k]) for k in ("bin", "scripts", "dependencies")}
        return found | {"raw": json.dumps(m["raw"], default=str), "scan_error": None}
    except Exception as error:  # a damaged manifest is that package's result
        return {"scan_error": f"{type(error).__name__}: {error}"[:500]}


_MAPS = ("bin", "scripts", "dependencies")
_MANIFEST = pa.struct([(c.split()[0], pa.map_(pa.string(), pa.string()) if c.split()[0] in _MAPS else pa.string()) for c in MANIFEST.split(", ")])


#: Ecosystems of which an archive without a manifest is an error.
NEEDS_MANIFEST = ("npm", "cargo", "nuget")


def _manifest_rank() -> Column:
    """Null for files that are no manifest; of an archive's manifests the first counts."""
    eco, path = F.col("ecosystem"), F.col("path")
    rank = F.when((eco == "npm") & (path == "package.json"), 1).when((eco == "cargo") & (path == "Cargo.toml"), 1).when((eco == "nuget") & path.rlike(r"\A[^/]+\.nuspec\z"), 1)
    return rank.when((eco == "pypi") & (path == "pyproject.toml"), 1).when((eco == "pypi") & (path == "PKG-INFO"), 2)


def manifests(files: DataFrame) -> DataFrame:
    """(ecosystem, source, manifest columns) of every archive: one small file of it is parsed; of PyPI's two the TOML one if it names the package.

    An archive without that file has scan_error (PyPI's: empty columns only, as a source archive needs none).
    """

    @F.arrow_udf(MANIFEST)
    def parsed(ecosystems: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for eco, own in zip(ecosystems.to_pylist(), found.to_pylist(), strict=True):
            read = [_manifest(x["path"], x["text"]) for x in own]
            named = [m for m in read if m.get("name") is not None]
            missing = {"scan_error": "no manifest"} if eco in NEEDS_MANIFEST else {}
            out.append((named or read or [missing])[0])
        return pa.array(out, _MANIFEST)

    rank = _manifest_rank()
    prepared(files.sparkSession)
    one = F.when(rank.isNotNull() & F.col("text").isNotNull(), F.struct(rank.alias("rank"), "path", "text"))
    found = files.groupBy("ecosystem", "source").agg(F.array_sort(F.collect_list(one)).alias("found"))  # a few small files of each archive
    return found.select("ecosystem", "source", parsed("ecosystem", "found").alias("m")).select("ecosystem", "source", "m.*")


INSTALLERS = ("tools/install.ps1", "tools/init.ps1", "tools/uninstall.ps1")


def hook_files(unpacked: DataFrame) -> DataFrame:
    """The rows of unpack that manifests and hooks come from (any file of a crate, whose manifest names its build script), and each archive's first one, else without its bytes.

    To be stored: manifests and lifecycle read their files several times, and so the archives are unpacked but once.
    """
    eco, path = F.col("ecosystem"), F.col("path")
    wanted = _manifest_rank().isNotNull() | (eco == "cargo") | ((eco == "pypi") & (path == "setup.py")) | ((eco == "nuget") & F.lower(path).isin(*INSTALLERS))
    return unpacked.where("scan_error IS NULL").where(wanted | (F.col("ordinal") == 0)).withColumn("bytes", F.when(wanted, F.col("bytes")))


def lifecycle(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Hooks (ecosystem, source, hook, kind, body, path)."""
    columns = ["ecosystem", "source", "hook", "kind", "body", "path"]
    none = F.lit(None).cast("string")
    parsed = parsed.where("scan_error IS NULL")
    kind = F.when(F.col("hook").isin(*fixed.INSTALL_HOOKS), "install_time").when(F.col("hook").isin(*fixed.PUBLISH_HOOKS), "publish_time")
    npm = parsed.where("ecosystem = 'npm'").select("ecosystem", "source", F.explode("scripts").alias("hook", "body"))
    npm = npm.withColumns({"kind": kind, "path": none}).where("kind IS NOT NULL")
    named = parsed.where("ecosystem = 'cargo'").select("ecosystem", "source", F.coalesce(F.col("scripts")["build"], F.lit("build.rs")).alias("path"))
    cargo = files.join(named, ["ecosystem", "source", "path"]).select("ecosystem", "source", F.lit("build").alias("hook"), F.lit("install_time").alias("kind"), F.col("bytes").cast("string").alias("body"), "path")
    setup = files.where("ecosystem = 'pypi' AND path = 'setup.py'").select("ecosystem", "source", F.lit("setup.py").alias("hook"), F.lit("install_time").alias("kind"), F.col("text").alias("body"), "path")
    backend = F.trim(F.get_json_object("raw", "$['build-system']['build-backend']"))
    foreign = parsed.where("ecosystem = 'pypi'").withColumn("backend", backend).where(~F.col("backend").isin(*fixed.TRUSTED_BACKENDS))
    foreign = foreign.select("ecosystem", "source", F.lit("build-backend").alias("hook"), F.lit("install_time").alias("kind"), F.concat(F.lit("build-backend = "), "backend").alias("body"), F.lit("pyproject.toml").alias("path"))
    low = F.lower("path")
    nuget = files.where((F.col("ecosystem") == "nuget") & low.isin(*INSTALLERS))
    nuget = nuget.select("ecosystem", "source", low.alias("hook"), F.lit("install_time").alias("kind"), F.col("text").alias("body"), "path")
    out = npm.select(columns)
    for part in (cargo, setup, foreign, nuget):
        out = out.unionByName(part.select(columns))
    return out
