"""The registry's change feed as a streaming source whose offset is the feed's own sequence number.

The log is a folder of segments `<first seq, 20 digits>.jsonl`, line-delimited JSON in order of seq; a segment may still be
growing at its end. `since` starts a stream after a seq (default: at the beginning); a restarted stream goes on after the
offset of its checkpoint, whatever `since` says, so no change comes twice and none is left out. Empty lines are
heartbeats, and lines that don't parse as a change are dropped, as is what comes after the last complete line.

A batch is split by the bytes of its segments, and each split is read in blocks, so neither a long outage nor a large segment has to
fit in memory; small segments share a task, so a batch of many has not a task for each. Listing a folder finds the segments of a range by their names; only the last one is looked into to find the newest seq.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Columns of a change; value is the line itself, for what else it holds.
CHANGE = "seq LONG, id STRING, deleted BOOLEAN, value STRING"
#: Bytes of a segment that one task reads, of a block, and of a look at the log's end.
SPLIT, BLOCK, TAIL = 64 << 20, 1 << 20, 1 << 16
#: Small segments share a task of so many bytes at least, or of as many as give each core so many tasks.
SHARED, TASKS = 4 << 20, 3
#: Changes handed to Spark at a time.
ROWS = 10_000
#: Stands between lines that are parsed together; no line can know it.
MARK = f'"{uuid.uuid4().hex}"'
SUFFIX = ".jsonl"


def _change(row, text: str) -> tuple[int, str, bool, str] | None:
    try:
        seq, name, deleted = row["seq"], row["id"], row.get("deleted", False)
    except (KeyError, TypeError, AttributeError):
        return None
    whole = isinstance(seq, int) and not isinstance(seq, bool) and 0 <= seq < 1 << 63
    return (seq, name, deleted, text) if whole and isinstance(name, str) and isinstance(deleted, bool) else None


def parsed(line: bytes) -> tuple[int, str, bool, str] | None:
    """A line as a change; None for heartbeats and lines that aren't changes."""
    try:
        text = line.decode()
        row = json.loads(text)
    except ValueError:
        return None
    return _change(row, text)


def parsed_all(lines: list[bytes]) -> list[tuple[int, str, bool, str]]:
    """The changes among the lines, parsed by one call; one by one if that doesn't find each line to be one value."""
    lines = [line for line in lines if line]
    try:
        texts = b"\n".join(lines).decode().split("\n")
        found = json.loads(f"[{f',{MARK},'.join(texts)}]")
    except (ValueError, RecursionError):
        found = []
    if len(found) == 2 * len(lines) - 1 and all(f == MARK[1:-1] for f in found[1::2]):
        rows = map(_change, found[::2], texts)
    else:
        rows = map(parsed, lines)
    return [row for row in rows if row]


def segments(folder: str) -> list[tuple[int, str, int]]:
    """(first seq, path, bytes) of the log's segments, in order."""
    fs, root = pafs.FileSystem.from_uri(folder)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        stem = info.base_name.removesuffix(SUFFIX)
        if info.type == pafs.FileType.File and info.base_name.endswith(SUFFIX) and stem.isdigit():
            found.append((int(stem), info.path, info.size))
    return sorted(found)


def newest_seq(folder: str) -> int | None:
    """The seq of the last complete change of the log, found from its end."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    for _, path, size in reversed(segments(folder)):
        with fs.open_input_file(path) as f:
            at, rest = size, b""
            whole = False  # whether a line end has been seen: what follows the last one isn't complete
            while at > 0:
                start = max(0, at - TAIL)
                f.seek(start)
                data = f.read(at - start) + rest
                lines = data.split(b"\n")
                if not whole:
                    if len(lines) == 1:
                        at, rest = start, data
                        continue
                    lines, whole = lines[:-1], True
                rest, lines = (lines[0], lines[1:]) if start else (b"", lines)
                for line in reversed(lines):
                    if row := parsed(line):
                        return row[0]
                at = start
    return None


class Split(InputPartition):
    """Bytes from start up to end of a segment, of which changes after `after` up to `upto` are wanted."""

    def __init__(self, path: str, start: int, end: int, after: int, upto: int):
        super().__init__(path)
        self.path, self.start, self.end, self.after, self.upto = path, start, end, after, upto


class Splits(InputPartition):
    """Splits that follow one another and are read by one task."""

    def __init__(self, splits: list[Split]):
        super().__init__(splits[0].path)
        self.splits = splits


def together(splits: list[Split], size: int) -> list[Splits]:
    """The splits in order, in groups of at most size bytes or of one split."""
    groups: list[list[Split]] = []
    held = 0
    for s in splits:
        held += s.end - s.start
        if not groups or held > size:
            groups.append([])
            held = s.end - s.start
        groups[-1].append(s)
    return [Splits(g) for g in groups]


def lines_of(fs: pafs.FileSystem, split: Split) -> Iterator[bytes]:
    """Complete lines that start in the split."""
    with fs.open_input_file(split.path) as f:
        at = max(0, split.start - 1)  # the byte before tells whether a line starts here
        f.seek(at)
        rest, skip = [], split.start > 0
        while at < split.end and (data := f.read(BLOCK)):
            *lines, last = data.split(b"\n")
            for line in lines:
                whole, rest = b"".join([*rest, line]), []
                begin, at = at, at + len(whole) + 1
                if skip:
                    skip = False
                elif begin >= split.end:
                    return
                else:
                    yield whole
            rest.append(last)


def chunks_of(lines: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The lines in lists of at most ROWS, and of little more than BLOCK bytes unless a line is longer."""
    chunk, held = [], 0
    for line in lines:
        chunk.append(line)
        held += len(line)
        if len(chunk) >= ROWS or held >= BLOCK:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str] | None = None):
        self.columns = columns
        self.folder, self.since = options["path"], int(options.get("since", "-1"))
        self.split, self.cores = int(options.get("splitbytes", str(SPLIT))), int(options.get("cores", "0"))

    def initialOffset(self) -> dict:
        return {"seq": self.since}

    def latestOffset(self) -> dict:
        newest = newest_seq(self.folder)
        return {"seq": self.since if newest is None else max(newest, self.since)}

    def partitions(self, start: dict, end: dict) -> list[Split] | list[Splits]:
        after, upto = start["seq"], end["seq"]
        found, out = segments(self.folder), []
        for (first, path, size), following in zip(found, [*(s[0] for s in found[1:]), None], strict=True):
            if first > upto or (following is not None and following <= after + 1):
                continue
            out += [Split(path, a, min(a + self.split, size), after, upto) for a in range(0, size, self.split)]
        if not self.cores:
            return out
        each = sum(s.end - s.start for s in out) // (self.cores * TASKS)
        return together(out, min(self.split, max(SHARED, each)))

    def read(self, partition: Split | Splits) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        splits = partition.splits if isinstance(partition, Splits) else [partition]
        after, upto = splits[0].after, splits[0].upto
        for chunk in chunks_of(line for s in splits for line in lines_of(fs, s)):
            rows = [row for row in parsed_all(chunk) if after < row[0] <= upto]
            if rows:
                batch = _batch(rows)
                yield batch if self.columns is None else batch.select(self.columns)


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["seq", "id", "deleted", "value"])


class ChangeLog(DataSource):
    """spark.readStream.format("change_log").option("since", seq).load(folder's URI)"""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options, schema.fieldNames())


def read_stream(spark: SparkSession, folder: str, since: int = -1, schema: str = CHANGE, **options: str) -> DataFrame:
    """The changes after `since` as a stream; schema: fewer of their columns, so that others don't come from Python."""
    spark.dataSource.register(ChangeLog)
    stream = spark.readStream.format("change_log").schema(schema).option("since", str(since)).option("cores", str(spark.sparkContext.defaultParallelism))
    return stream.options(**options).load(folder)


def write_segments(lines: DataFrame, folder: str, rows: int = 100_000) -> int:
    """Adds (seq, value) rows to the log as segments of about so many rows; gives how many segments.

    Rows are range-partitioned by seq. Each segment is written under another name and then renamed, so readers see whole ones;
    a task that runs twice gives the same names.
    """
    n = max(1, -(-lines.count() // rows))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, first = None, None
        draft = f"{root}/{uuid.uuid4().hex}.draft"
        for batch in batches:
            if out is None and batch.num_rows:
                first, out = batch["seq"][0].as_py(), fs.open_output_stream(draft)
            if batch.num_rows:
                out.write("\n".join([*batch["value"].to_pylist(), ""]).encode())
        if out is not None:
            out.close()
            fs.move(draft, f"{root}/{first:020d}{SUFFIX}")
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["n"])

    ordered = lines.select("seq", "value").repartitionByRange(n, "seq").sortWithinPartitions("seq")
    return ordered.mapInArrow(put, "n int").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
