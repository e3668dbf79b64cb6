"""Operator 1: toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Texts are lower-cased, look-alike letters of other alphabets and digits or signs inside words become the letters
that they stand for, and words are set apart by single spaces. The lexicon (whole words, and stems that begin
words) and its weights are learnt from labelled texts, as are exception phrases: a lexicon word together with a
neighbour that turned up in clean texts only. A text's score is a logistic function of its summed weights, less
what exceptions cover, normalised by the logarithm of its length.

Null and empty texts match nothing and get the lowest score. Labels that are null are not learnt from. Without
labelled toxic texts the lexicon is empty and all scores are equal, below 0.3. Repeated rows get equal scores;
other columns are kept, but for those named like the result's.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import masked, unmasked, written

#: Labelled texts that the lexicon is fitted on at most (the first by a hash of their id), and entries kept.
FIT_ROWS, LEXICON = 12_000, 4_000
STEMS = range(4, 9)  # lengths of the word beginnings that may become entries
LEAST_DOCS = 3
#: Look-alikes of Latin letters among Cyrillic and Greek ones; full-width and styled letters fall to NFKC.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝтвмнкɑοανιρτυκ", "aeopcyxijshdqwtbmhkaoaviptuk", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_GLYPHS = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(LEET)
_TOKEN = re.compile(r"[^\W_]+(?:[@$!|]+[^\W_]+)*")


def _plain(m: re.Match) -> str:
    token = m[0]
    return token if token.isalpha() or token.isdecimal() else token.translate(_LEET)


def fold(text: str) -> str:
    """The folded words of the text, joined by single spaces."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_GLYPHS)
    return " ".join(map(_plain, _TOKEN.finditer(text)))


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 4.0
    bias: float = -3.0

    def matcher(self) -> ahocorasick.Automaton | None:
        """Entries with a space before them, and for whole words one after; exceptions take weight away."""
        found: dict[str, tuple[int, float]] = {}
        for stem, w in self.stems.items():
            found[f" {stem}"] = (1, w)
        for word, w in self.words.items():
            found[f" {word} "] = (2, w)
        for phrase in self.exceptions:
            found[f" {phrase} "] = (3, 0.0)
        if not found:
            return None
        a = ahocorasick.Automaton()
        for key, (kind, w) in found.items():
            a.add_word(key, (kind, len(key), w))
        a.make_automaton()
        return a

    def raw(self, text: str, a: ahocorasick.Automaton | None) -> float:
        """Summed weights of the matched words, each counted once, over 1 + ln(1 + words / 200)."""
        folded = f" {fold(text)} "
        if a is None or len(folded) < 3:
            return 0.0
        best: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        for end, (kind, size, w) in a.iter(folded):
            start = end - size + 1
            if kind == 3:
                covered.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if covered:
            best = {s: w for s, w in best.items() if not any(b <= s < e for b, e in covered)}
        return sum(best.values()) / (1 + math.log1p(folded.count(" ") / 200))

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * raw))))


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learnt from; a row without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, entry, toxic documents, clean documents) of one partition's labelled texts."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = fold(text or "").split(" ")
            kept = {w for w in words if 2 < len(w) <= 40}
            seen = {("w", w) for w in kept} | {("s", w[:n]) for w in kept for n in STEMS if len(w) >= n}
            counts[0 if label else 1].update(seen)
    yield from _counted(counts)


def _pairs(words: set[str]):
    """The same of the neighbour pairs with one of the words."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = fold(text or "").split(" ")
                counts[0 if label else 1].update({("p", f"{a} {b}") for a, b in zip(found, found[1:], strict=False) if a in words or b in words})
        yield from _counted(counts)

    return of


def _counted(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    keys = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.RecordBatch.from_pydict(
            {"kind": [k for k, _ in part], "entry": [e for _, e in part], "n_toxic": [counts[0][k] for k in part], "n_clean": [counts[1][k] for k in part]}
        )


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the labelled rows of docs outside the held-out quarter, FIT_ROWS of them at most.

    labels has doc_id and the label. What reaches the driver is bounded by FIT_ROWS and LEXICON.
    """
    usable = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    usable = usable.where(in_training(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")
    rows = written(rows, "labelled")
    schema = "kind string, entry string, n_toxic long, n_clean long"
    total = lambda df: df.groupBy("kind", "entry").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    n = {bool(r["label"]): r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic:
        return Model()
    least = LEAST_DOCS if n_toxic >= 100 else 2
    odds = F.ln((F.col("n_toxic") + 0.1) / (n_toxic + 0.2)) - F.ln((F.col("n_clean") + 0.1) / (n_clean + 0.2))
    entries = total(rows.mapInArrow(_features, schema)).where(F.col("n_toxic") >= least).withColumn("odds", odds).where("odds > 2.5")
    entries = entries.orderBy(F.desc("n_toxic"), F.desc("odds"), "kind", "entry").limit(LEXICON).collect()
    stems = {e["entry"]: e for e in entries if e["kind"] == "s"}
    words = {e["entry"]: e for e in entries if e["kind"] == "w"}
    # Of nested stems the shortest that is as telling as what it begins; a stem with but one word is that word.
    short = {s: e for s, e in stems.items() if not any(s[:k] in stems and stems[s[:k]]["odds"] > e["odds"] - 0.5 for k in range(STEMS[0], len(s)))}
    many = {s for s, e in short.items() if sum(w.startswith(s) for w in words) != 1}
    weight = lambda e: min(e["odds"], 8.0) / 8.0
    model = Model({w: weight(e) for w, e in words.items()}, {s: weight(short[s]) for s in many})
    # Neighbours that make a lexicon word harmless: pairs seen in clean texts, never in toxic ones.
    pairs = total(rows.mapInArrow(_pairs(set(model.words)), schema)).where("n_toxic = 0 AND n_clean >= 3")
    learnt = [r["entry"] for r in pairs.orderBy(F.desc("n_clean"), "entry").limit(LEXICON).collect()]
    model.exceptions += tuple(learnt)
    return _calibrated(model, [(r["label"], r["raw"]) for r in rows.select("label", _scorer(model, True)(F.col("text")).alias("raw")).collect()])


def _calibrated(model: Model, rows: list[tuple[int, float]]) -> Model:
    """Slope and bias by logistic regression with a small ridge, by Newton's method."""
    a, b = model.slope, model.bias
    for _ in range(30):
        ga, gb, haa, hab, hbb = -0.02 * (a - 4), -0.02 * (b + 3), 0.02, 0.0, 0.02
        for y, x in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            e, w = (1.0 if y else 0.0) - p, p * (1 - p)
            ga, gb = ga + e * x, gb + e
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + scale * da, b + scale * db
        if abs(da) + abs(db) < 1e-9:
            break
    model.slope, model.bias = max(a, 0.1), min(b, math.log(0.25 / 0.75))  # a text without a match is never toxic
    return model


def _scorer(model: Model, raw: bool = False):
    shared = model  # bounded: LEXICON entries and exceptions

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = shared.matcher()
        for batch in batches:
            values = [shared.raw(x.as_py() or "", a) for x in batch]
            yield pa.array(values if raw else [shared.score(v) for v in values], pa.float64())

    return scored


def add_scores(df: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from `least` on)."""
    inner, of = masked(df)
    out = inner.withColumn("score", _scorer(model)(F.col(of[text])))
    return unmasked(out.withColumn("predicted", (F.col("score") >= least).cast("int")), of, "score", "predicted")
