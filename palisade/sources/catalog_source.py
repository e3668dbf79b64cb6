"""The catalog's JSON documents as a data source: spark.read.format("verdict_catalog").load(folder's URI).

Rows are (ecosystem, name, version, algo, digest_b64, body); body is the verdict's document. A filter on the whole key is
pushed to the reader: algo and digest_b64 give the path of one document, ecosystem, name and version that of a pointer, which names
the document. So a lookup opens one or two files and lists nothing. Other reads are split by the folders of the documents' first two digits.

Writing takes two phases: tasks put their files into a folder of the job, the commit renames them to their places, and an
abort removes the folder, so a failed job leaves nothing to see. Paths follow from content and name, so writing a row again changes
nothing. The commit renames file by file from the driver: for many millions of verdicts catalog.upsert is the way.
"""

from __future__ import annotations

import base64
import binascii
import json
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "ecosystem string, name string, version string, algo string, digest_b64 string, body string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
BY_NAME, BY_CONTENT = COLUMNS[:3], COLUMNS[3:5]
DOCUMENTS = "verdicts/by-integrity"
#: Files renamed at once by a commit, and rows handed to Spark at a time.
THREADS, ROWS = 16, 1_000


def document_path(algo: str, digest_b64: str) -> str:
    digits = base64.b64decode(digest_b64, validate=True).hex()
    return f"{DOCUMENTS}/{algo}/{digits[:2]}/{digits[2:]}.json"


def pointer_path(ecosystem: str, name: str, version: str) -> str:
    return f"verdicts/{ecosystem}/{name.replace('@', '%40').replace('/', '%2F')}/{version}.json"


def _text(fs: pafs.FileSystem, path: str) -> str | None:
    """A file's text, None if there is no such file or it isn't UTF-8."""
    try:
        with fs.open_input_stream(path) as f:
            return f.read().decode()
    except (FileNotFoundError, UnicodeDecodeError):
        return None


def _row(text: str | None) -> tuple | None:
    """A document as a row; None for damaged ones."""
    try:
        artifact = json.loads(text)["artifact"]
        integrity = artifact["integrity"]
        return (artifact["ecosystem"], artifact["name"], artifact["version"], integrity["algo"], integrity["digest_b64"], text)
    except (TypeError, ValueError, KeyError):
        return None


class Lookup(InputPartition):
    """What one task reads: the document of a key, or a folder of documents."""

    def __init__(self, kind: str, value: tuple[str, ...]):
        super().__init__(value)
        self.kind, self.value = kind, value


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.key: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the equalities of one whole key, by content if both are there; Spark keeps the other filters."""
        equal = {f.attribute[0]: f for f in filters if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, str)}
        for columns in (BY_CONTENT, BY_NAME):
            if all(c in equal for c in columns):
                self.key = {c: equal[c].value for c in columns}
                taken = [equal[c] for c in columns]
                return [f for f in filters if not any(f is t for t in taken)]
        return filters

    def partitions(self) -> list[Lookup]:
        if self.key:
            return [Lookup("name" if "name" in self.key else "content", tuple(self.key.values()))]
        fs, root = pafs.FileSystem.from_uri(self.folder)
        folders = []
        for algo in fs.get_file_info(pafs.FileSelector(f"{root}/{DOCUMENTS}", allow_not_found=True)):
            folders += [x.path for x in fs.get_file_info(pafs.FileSelector(algo.path)) if x.type == pafs.FileType.Directory]
        return [Lookup("folder", (x,)) for x in sorted(folders)] or [Lookup("folder", ("",))]

    def read(self, partition: Lookup) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        if partition.kind == "folder":
            infos = fs.get_file_info(pafs.FileSelector(partition.value[0])) if partition.value[0] else []
            paths = [x.path for x in infos if x.base_name.endswith(".json")]
        else:
            paths = [p for p in [self._of_key(fs, root, partition)] if p]
        rows = []
        for path in paths:
            if row := _row(_text(fs, path)):
                rows.append(row)
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _of_key(self, fs: pafs.FileSystem, root: str, partition: Lookup) -> str | None:
        if partition.kind == "content":
            try:
                return f"{root}/{document_path(*partition.value)}"
            except (binascii.Error, ValueError):  # no digest at all: no document has it
                return None
        try:
            return f"{root}/{json.loads(_text(fs, f'{root}/{pointer_path(*partition.value)}'))['verdict_path']}"
        except (TypeError, ValueError, KeyError):
            return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(COLUMNS))], COLUMNS)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has put into the job's folder: its own folder, below which files have their final paths."""

    folder: str
    files: int


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        own, files = f"{root}/{self.job}/{uuid.uuid4().hex}", 0
        for batch in iterator:
            for ecosystem, name, version, algo, digest, body in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                artifact = {"ecosystem": ecosystem, "name": name, "version": version, "integrity": {"algo": algo, "digest_b64": digest}}
                path = document_path(algo, digest)
                for at, content in ((path, json.loads(body or "{}") | {"artifact": artifact}), (pointer_path(ecosystem, name, version), {"artifact": artifact, "verdict_path": path})):
                    target = f"{own}/{at}"
                    fs.create_dir(target.rpartition("/")[0], recursive=True)
                    with fs.open_output_stream(target) as out:
                        out.write(json.dumps(content).encode())
                    files += 1
        return Staged(own, files)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)

        def place(path: str, own: str) -> None:
            target = f"{root}/{path.removeprefix(own).lstrip('/')}"
            fs.create_dir(target.rpartition("/")[0], recursive=True)
            fs.move(path, target)

        with ThreadPoolExecutor(THREADS) as pool:
            for message in messages:
                if message and message.files:
                    infos = fs.get_file_info(pafs.FileSelector(message.folder, recursive=True))
                    # Documents before the pointers that name them.
                    paths = sorted((x.path for x in infos if x.type == pafs.FileType.File), key=lambda p: f"/{DOCUMENTS}/" not in p)
                    n = sum(f"/{DOCUMENTS}/" in p for p in paths)
                    for part in (paths[:n], paths[n:]):
                        list(pool.map(lambda p, own=message.folder: place(p, own), part))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class VerdictCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "verdict_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VerdictCatalog)
