"""Operator 11: source divergence audit. How far the word use of each source is from the other sources of its language.

Terms are found on bytes: a lookup table over the concatenated UTF-8 buffer of a batch says which bytes belong to a
term, differences of it where terms begin and end. The slices are grouped by xxhash, and each is compared with the bytes
of its group's first (a slice that only shares the hash becomes a group of its own). A task sums counts before
anything moves. Kept terms then make blocks of a matrix (source x term), compressed by rows, whose divergences are
sums by reduceat; where neither source has a term, one product stands for all such terms.

A block has about ENTRIES entries: a language's terms are dealt to blocks by hash, its sources to tiles, and each
pair of tiles meets in each block, so no language, source or term is gathered in one task. All arithmetic is on
integers: shares in parts of a thousand million, by long division that holds up to 9e15 counted words.

Null texts, languages and sources are empty strings. A row is a document, so repeated rows count again. A group
without kept terms still is a group; a language without kept terms has divergences 0, one with a single source no pairs.
Ties are ordered by UTF-8. An empty table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import written

#: Documents of its language that a kept term occurs in, and rows reported of each group's own terms.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Bytes cut into terms at a time, and (group, term) counts or terms that a task holds before it hands them on.
PIECE, HELD = 1 << 22, 1 << 20
#: Entries of one block, and sources of one tile.
ENTRIES, TILE = 100_000, 64
SCALE = 1_000_000_000
#: Bytes of terms: ASCII letters, and all bytes of other characters. Only A-Z are lower-cased.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def boundaries(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and end (exclusive) in the bytes; no term runs over one of the positions `firsts`."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = IN_TERM[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[firsts] = True
    before = np.r_[False, inside[:-1]]
    return np.flatnonzero(inside & (cut | ~before)), np.flatnonzero(before & (cut | ~inside))


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct terms, and for each slice the number of its term."""
    view = data.tobytes()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    like = first[group]  # the slice that each one must equal
    wrong = lengths != lengths[like]
    begins = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    # A slice of another length is compared with itself here; it is wrong already.
    other = np.repeat(np.where(wrong, starts, starts[like]), lengths)
    differ = data[np.repeat(starts, lengths) + at] != data[other + at]
    if len(starts):
        wrong |= np.add.reduceat(differ, begins, dtype=np.int64) > 0
    terms = [view[starts[i] : ends[i]] for i in first.tolist()]
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(wrong).tolist():
        term = view[starts[i] : ends[i]]
        if term not in own:
            own[term] = len(terms)
            terms.append(term)
        group[i] = own[term]
    return terms, group


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


class Counter:
    """Counts of a task: by group (language, source) and term, occurrences and documents."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        return np.array([self.terms.setdefault(t, len(self.terms)) for t in terms], dtype=np.int64)

    def add(self, groups: np.ndarray, docs: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Occurrences of terms in documents; (document, term) may repeat, a document doesn't come again later."""
        base = len(self.terms)
        pairs, n = summed(docs * base + terms, counts)
        self.parts.append(summed((groups[pairs // base] << 32) + pairs % base, n, np.ones(len(pairs), dtype=np.int64)))
        self.size += len(self.parts[-1][0])
        if self.size > 4 * HELD and len(self.parts) > 1:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return max(self.size, len(self.terms), len(self.groups)) > HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What has been counted, and a row without a term for each group; then starts afresh."""
        keys, n, docs = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else [np.empty(0, np.int64)] * 3
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        words = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        for a in range(0, len(keys), 1 << 16):
            part = keys[a : a + (1 << 16)]
            group, term = pa.array(part >> 32), pa.array(part & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), words.take(term), pa.array(n[a : a + len(part)]), pa.array(docs[a : a + len(part)])], COUNTED)
        zero = pa.array([0] * len(langs), pa.int64())
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(langs), pa.string()), zero, zero], COUNTED)
        self.__init__()


COUNTED = ["lang", "source", "term", "n", "docs"]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end outside terms."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and IN_TERM[data[end]]:
            out = np.flatnonzero(~IN_TERM[data[end : end + PIECE]])
            end = end + int(out[0]) if len(out) else min(end + PIECE, len(data))
        yield data[at:end]
        at = end


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, source, text = (pc.fill_null(batch.column(i), "") for i in range(3))
        text = text.cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        content = text.buffers()[2]
        data = LOWER[np.frombuffer(content, dtype=np.uint8)[offsets[0] : offsets[-1]]] if content else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        groups = [counter.groups.setdefault(g, len(counter.groups)) for g in zip(lang.to_pylist(), source.to_pylist(), strict=True)]
        groups = np.array(groups, dtype=np.int64)
        row = 0
        while row < len(text):
            # As many whole texts as fit, or one long one in pieces.
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
            own = data[offsets[row] : offsets[end]]
            if end == row + 1:
                found = [(counter.numbers(t), np.bincount(g, minlength=len(t))) for t, g in (grouped(p, *boundaries(p, np.empty(0, np.int64))) for p in _pieces(own))]
                terms = np.concatenate([np.empty(0, np.int64), *(t for t, _ in found)])
                docs, counts = np.zeros(len(terms), dtype=np.int64), np.concatenate([np.empty(0, np.int64), *(c for _, c in found)])
            else:
                first = offsets[row:end] - offsets[row]
                starts, ends = boundaries(own, first)
                names, group = grouped(own, starts, ends)
                terms, docs = counter.numbers(names)[group] if names else np.empty(0, np.int64), np.searchsorted(first, starts, side="right") - 1
                counts = np.ones(len(terms), dtype=np.int64)
            if len(terms):
                counter.add(groups[row:end], docs, terms, counts)
            row = end
            if counter.full():
                ids = [g for g in counter.groups]
                yield from counter.rows()
                counter.groups = {g: i for i, g in enumerate(ids)} if row < len(text) else {}
    yield from counter.rows()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term. A group also has a row without a term."""
    own = docs.select(*[F.col(c).cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = own.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), by long division in steps of a thousand."""
    rest, out = count + 2, np.zeros(len(count), dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


PARTS = "lang string, source string, part string, item string, value long"


def _block(table: pa.Table) -> pa.Table:
    """Sums of divergences of each pair of sources (tile i with tile j) over the terms of one block, and, where i = j, each source's own terms.

    Rows with a tile describe a source; the others are entries of the matrix.
    """
    lang, i, j, block = (table.column(c)[0].as_py() for c in ("lang", "i", "j", "block"))
    heads = table.filter(pc.is_valid(table.column("tile"))).sort_by("source")
    entries = table.filter(pc.is_null(table.column("tile")))
    names = heads.column("source").combine_chunks()
    tile, whole = (heads.column(c).to_numpy() for c in ("tile", "whole"))
    n_terms, lang_whole = heads.column("terms")[0].as_py(), heads.column("lang_whole")[0].as_py()
    out = {c: [] for c in ("source", "part", "item", "value")}

    def report(part: str, sources: list[str], items: list[str], values: np.ndarray) -> None:
        out["source"] += sources
        out["part"] += [part] * len(sources)
        out["item"] += items
        out["value"] += values.tolist()

    terms = entries.column("term").combine_chunks().dictionary_encode()
    words, col = terms.dictionary.to_pylist(), terms.indices.to_numpy()
    row = pc.index_in(entries.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    data = share(entries.column("n").to_numpy()[order], whole[row]) if len(row) else np.empty(0, np.int64)
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    absent = share(np.zeros(len(names), dtype=np.int64), whole) if n_terms else np.zeros(len(names), dtype=np.int64)
    filled = np.flatnonzero(np.diff(indptr))  # rows with entries: reduceat can't sum empty ones

    def by_row(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(names), dtype=np.int64)
        if len(filled):
            sums[filled] = np.add.reduceat(values, indptr[filled])
        return sums

    for s in np.flatnonzero(tile == i).tolist() if n_terms else []:
        other = np.flatnonzero(tile == j)
        other = other[other > s] if i == j else other
        if not len(other):
            continue
        mine = slice(indptr[s], indptr[s + 1])
        p, has = np.full(len(words), absent[s], dtype=np.int64), np.zeros(len(words), dtype=bool)
        p[col[mine]], has[col[mine]] = data[mine], True
        both = has[col]
        theirs = by_row(divergence(data, p[col]) - both * divergence(p[col], absent[row]))
        alone = np.array([divergence(data[mine], absent[t]).sum() for t in other], dtype=np.int64)
        union = np.diff(indptr)[other] + (mine.stop - mine.start) - by_row(both.astype(np.int64))[other]
        neither = divergence(absent[s : s + 1], absent[other])
        value = theirs[other] + alone + ((n_terms if block == 0 else 0) - union) * neither
        mates = [names[t].as_py() for t in other.tolist()]
        report("pair", [names[s].as_py()] * len(other), mates, value)
        report("pair", mates, [names[s].as_py()] * len(other), value)
    if not n_terms and block == 0:
        for s in np.flatnonzero(tile == i).tolist():
            other = [names[t].as_py() for t in np.flatnonzero(tile == j).tolist() if t > s or i != j]
            report("pair", [names[s].as_py()] * len(other), other, np.zeros(len(other), dtype=np.int64))
            report("pair", other, [names[s].as_py()] * len(other), np.zeros(len(other), dtype=np.int64))
    if i == j and len(row):
        q = share(entries.column("total").to_numpy()[order], np.int64(lang_whole))
        place = np.empty(len(words), dtype=np.int64)
        place[sorted(range(len(words)), key=lambda k: words[k].encode())] = np.arange(len(words))
        above = np.flatnonzero(data > q)
        value = divergence(data[above], q[above])
        best = np.lexsort((place[col[above]], -value, row[above]))
        rank = np.arange(len(best)) - np.searchsorted(row[above][best], row[above][best])
        best = best[rank < TOP_TERMS]
        at = above[best]
        report("term", names.take(pa.array(row[at])).to_pylist(), [words[k] for k in col[at].tolist()], value[best])
    return pa.table({"lang": pa.array([lang] * len(out["source"]), pa.string()), **{c: pa.array(out[c], pa.int64() if c == "value" else pa.string()) for c in out}})


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source)."""
    counted = written(term_counts(docs, lang, source, text), "terms")
    per_term = Window.partitionBy("lang", "term")
    kept = counted.where("term IS NOT NULL").withColumns({"in_docs": F.sum("docs").over(per_term), "total": F.sum("n").over(per_term)})
    kept = written(kept.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "total"), "kept")
    # One row per language and per group: counts of what is kept, also where nothing is.
    groups = counted.where("term IS NULL").select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("entries"))
    terms = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["words", "entries"])
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("words").alias("lang_words"), F.sum("entries").alias("entries"))
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    langs = langs.join(terms, "lang", "left").na.fill(0, ["terms"]).withColumn("tiles", tiles)
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("entries") * F.when(F.col("tiles") > 1, 2).otherwise(1) / F.col("tiles") / ENTRIES).cast("int")))
    groups = groups.select("lang", "source", "words").join(langs.select("lang", "lang_words", "terms", "tiles", "blocks"), "lang")
    tile = F.pmod(F.xxhash64("source", F.lit(5)), F.col("tiles")).cast("int")
    heads = written(groups.select("lang", "source", tile.alias("tile"), "tiles", "blocks", "terms", (F.col("words") + 2 * F.col("terms")).alias("whole"), (F.col("lang_words") + 2 * F.col("terms")).alias("lang_whole")), "groups")

    def meetings(df: DataFrame) -> DataFrame:
        """A row for each tile that the row's tile meets."""
        mates = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda m: F.struct(F.least("tile", m).alias("i"), F.greatest("tile", m).alias("j")))
        return df.withColumn("m", F.explode(mates)).withColumns({"i": F.col("m.i"), "j": F.col("m.j")})

    keys = ["lang", "i", "j", "block"]
    entries = kept.join(heads.select("lang", "source", "tile", "tiles", "blocks"), ["lang", "source"])
    entries = meetings(entries).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    entries = entries.select(*keys, "source", "term", "n", "total", *none("int", "tile"), *none("long", "terms", "whole", "lang_whole"))
    described = meetings(heads).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    described = described.select(*keys, "source", *none("string", "term"), *none("long", "n", "total"), "tile", "terms", "whole", "lang_whole")
    parts = entries.unionByName(described).groupBy(*keys).applyInArrow(_block, PARTS)
    # A pair's blocks are summed; a term is in one block only.
    parts = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = parts.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
