"""Operator 9: secret scans with an incremental blob ledger. Native: DataFrame and SQL functions only.

Texts are content-addressed by SHA-256. The ledger holds, for each blob and version of the rules, the spans that
were found; only pairs it lacks are scanned, each once however many paths hold the blob, and findings are joined
back to all paths.

Null text is the empty blob (no spans). Paths may repeat; each row gets its blob's spans. Offsets count code
points and ends are exclusive. Rule kinds are reported by start, then in the order listed. An empty table gives
an empty result; other columns are kept unless they are named blob or spans, which the result replaces. Spans are
found inside the row in n log n steps, whatever the number of hits, by patterns that need no stack.

The ledger is a table in a folder of the caller's (ledger_dir), which each scan reads and appends to: one file set per
scan, never rewritten, so a task that runs twice or a lost executor leaves no half entry, and a pair written twice
counts once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.spans import given, running, spans
from palisade.llm.common import masked, text_or_empty, unmasked, written

SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """Matches of the pattern, leftmost and non-overlapping, whose group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so the least length may stand in the pattern.
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
    # From the first line to the last one where there is one, so that the key's body is covered; a header holds a few words.
    Rule("pem", "-----BEGIN (?:[A-Z0-9]{1,20} ){0,8}PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=:,. \\t\\r\\n]++|-(?!-))*+-----END (?:[A-Z0-9]{1,20} ){0,8}PRIVATE KEY-----)?", 0, 0),
]


def version_of(rules: list[Rule]) -> str:
    """A change of any rule gives another version, so that old ledger entries no longer count."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


RULES_VERSION = version_of(RULES)
#: Characters of the pieces that a text with secrets is cut from when they are replaced.
PIECE = 1024
LEDGER = f"blob string, rules_version string, spans {SPANS}"


def found(text: Column, rule: Rule, ordinal: int) -> Column:
    """The rule's spans."""
    hits = F.filter(spans(text, rule.pattern, rule.group), lambda x: x["size"] >= rule.least)
    hits = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(ordinal).alias("ord"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    return F.when(text.rlike(rule.pattern), hits).otherwise(F.array().cast(SPANS)).cast(SPANS)


def blob_id(text: str | Column) -> Column:
    return F.sha2(text_or_empty(text), 256)


def scan_blobs(docs: DataFrame, text: str, ledger: DataFrame | None, rules: list[Rule], version: str) -> DataFrame:
    """New ledger rows (blob, rules_version, spans) for the texts of docs that the ledger lacks."""
    blobs = docs.select(blob_id(text).alias("blob"), text_or_empty(text).alias("content"))
    if ledger is not None:  # before the texts move; the ledger may be large, so no broadcast is asked for
        blobs = blobs.join(ledger.where(F.col("rules_version") == version).select("blob"), "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("content").alias("content"))
    spans = F.sort_array(F.concat(*[found(F.col("content"), r, i) for i, r in enumerate(rules)]))
    return blobs.select("blob", F.lit(version).alias("rules_version"), spans.alias("spans"))


def scan(docs: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: list[Rule] | None = None, version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(docs with blob and spans, ledger rows to append)."""
    if ledger is not None:
        ledger = ledger.where(F.col("rules_version") == version).dropDuplicates(["blob"])
    docs, of = masked(docs)
    new = written(scan_blobs(docs, of[text], ledger, rules or RULES, version), "ledger")
    known = new if ledger is None else new.unionByName(ledger)
    hits = known.where(F.size("spans") > 0).select("blob", "spans")
    out = docs.withColumn("blob", blob_id(of[text])).join(hits, "blob", "left")
    return unmasked(out.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))), of, "blob", "spans"), new


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of the ledger in the folder; none where nothing has been written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_with(docs: DataFrame, folder: str, text: str = "text", rules: list[Rule] | None = None, version: str = RULES_VERSION) -> DataFrame:
    """docs with blob and spans; the ledger in the folder is read before the scan and appended to after it."""
    out, new = scan(docs, text, read_ledger(docs.sparkSession, folder), rules, version)
    new.write.mode("append").parquet(folder)
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [kind]; of overlapping spans the first counts, with the furthest end."""

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """Characters start to end, from pieces of PIECE characters, so that no cut counts from the text's beginning."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        one = F.substring(F.get(pieces, first), start - first * PIECE + 1, end - start)
        head = F.substring(F.get(pieces, first), start - first * PIECE + 1, F.lit(PIECE))
        tail = F.substring(F.coalesce(F.get(pieces, last), F.lit("")), F.lit(1), end - last * PIECE)
        between = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(start >= end, F.lit("")).when(first == last, one).otherwise(F.concat(head, between, tail))

    def joined_parts(x: Column) -> Column:
        """Spans that touch what came before belong to its cluster; each cluster is named after its first span."""
        firsts = F.filter(x["s"], lambda s, i: (i == 0) | (s["start"] >= F.get(x["ends"], i - 1)))
        closes = F.filter(x["ends"], lambda e, i: F.coalesce(F.get(x["s"], i + 1)["start"] >= e, F.lit(True)))
        part = lambda y: lambda s, i: F.concat(cut(x["pieces"], F.when(i == 0, F.lit(0)).otherwise(F.get(y["closes"], i - 1)), s["start"]), F.lit("["), s["kind"], F.lit("]"))
        parts = given(F.struct(firsts.alias("firsts"), closes.alias("closes")), lambda y: F.transform(y["firsts"], part(y)))
        return F.concat(F.array_join(parts, ""), cut(x["pieces"], F.element_at(x["ends"], -1), x["n"]))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = F.struct(spans.alias("s"), ends.alias("ends"), pieces.alias("pieces"), F.length(text).alias("n"))
    return F.when(F.size(spans) == 0, text).otherwise(given(whole, joined_parts))


def redact(docs: DataFrame, text: str = "text", length: str | None = None, folder: str | None = None) -> DataFrame:
    """docs with the secrets of its texts replaced, in docs' columns; length: a column that holds the text's length; folder: of a ledger."""
    inner, of = masked(docs)
    own = of[text]
    out = scan_with(inner, folder, own) if folder else scan(inner, own)[0]
    out = out.withColumn(own, redacted(F.col(own), F.col("spans")))
    if length:
        changed = F.length(own).cast(docs.schema[length].dataType)
        out = out.withColumn(of[length], F.when(F.size("spans") == 0, F.col(of[length])).otherwise(changed))
    return unmasked(out, of)
