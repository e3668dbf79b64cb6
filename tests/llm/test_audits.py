"""Source divergence, filter interactions and license scans against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import divergence, filter_audit, license_scan, queries, secrets_ledger

SCHEMA = "doc_id long, text string, lang string, source string"


def some_docs():
    """Common terms, terms of one source, nulls in every column, empty and long texts, ties, repeated rows."""
    rows = []
    for i in range(60):
        words = ["alpha", "Beta", "gamma" if i % 3 else "ΔELTA", f"only{'abc'[i % 3]}", "ñandú" * (i % 2), "x" * (i % 4)]
        rows.append((i, " ".join(words) + ("; beta-BETA 12" if i % 5 else ""), ["en", "de", None][i % 3 == 0 and i % 2 or 0], f"s{i % 4}" if i % 7 else None))
    rows += [(100, None, "en", "s0"), (101, "", "fr", "s1"), (102, "rare words here", "fr", "s2"), (103, "alpha " * 5_000 + "z" * 40_000, "en", "s1"), (None, "alpha beta", "en", "s9"), (7, "alpha beta", "en", "s9"), (7, "alpha beta", "en", "s9"), (104, "lonely", "it", "s1"), (105, None, None, None)]
    return rows


def divergence_by_hand(rows, least=10):
    found, groups, in_docs = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang or "", source or ""))
        found[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        of = {s: found[lang, s] for x, s in groups if x == lang}
        whole = sum(of.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        shares, q = {s: p(c) for s, c in of.items()}, p(whole)
        for s in of:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(f(shares[s][t], q[t]), t) for t in kept if of[s][t] and shares[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(items) if part == "pair" or r < 10}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and tiles
        monkeypatch.setattr(divergence, "ENTRIES", 3)
        monkeypatch.setattr(divergence, "TILE", 2)
        monkeypatch.setattr(divergence, "PIECE", 50)
        monkeypatch.setattr(divergence, "HELD", 20)
    rows = some_docs()
    got = [tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_by_hand(rows)


def test_divergence_of_other_tables(spark):
    empty = divergence.divergences(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    own = spark.createDataFrame([("a b", "en", "s", 1), ("a", "en", "t", 2)], "text string, lang string, source string, value int").withColumns({"rank": F.lit("x"), "n": F.lit(1), "term": F.lit("y")})
    assert {tuple(r) for r in divergence.divergences(own).collect()} == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}


def test_slices_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    data = np.frombuffer(b"aa bb a aa ccc b bb a", dtype=np.uint8)
    terms, group = divergence.grouped(data, *divergence.boundaries(data, np.empty(0, np.int64)))
    assert [terms[g] for g in group] == b"aa bb a aa ccc b bb a".split() and len(set(terms)) == len(terms)


def test_terms_do_not_run_over_texts(spark):
    docs = spark.createDataFrame([(1, "ab", "en", "s"), (2, "cd", "en", "s"), (3, "", "en", "s"), (4, "ab", "en", "s")], SCHEMA).coalesce(1)
    assert {(r["term"], r["n"], r["docs"]) for r in divergence.term_counts(docs).collect()} == {("ab", 2, 2), ("cd", 1, 1), (None, 0, 0)}


def test_shares_of_large_counts_are_exact():
    counts, whole = [0, 5, 10**14, 8 * 10**15], 9 * 10**15
    assert divergence.share(np.array(counts), np.array([whole] * 4)).tolist() == [1 + 10**9 * (c + 2) // whole for c in counts]


def failing_by_hand(rows):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        yield i, source or "", "".join(x for x, f in zip("ABCDE", fails, strict=True) if f)


def audit_by_hand(rows, labels):
    failing = list(failing_by_hand(rows))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    out = set()
    for part in {p for _, p, _ in failing}:
        own = [(i, f) for i, p, f in failing if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order):
                before = set(order[:step])
                removed = [i for i, f in own if x in f and not before & set(f)]
                shapley = sum(120 // len(f) for _, f in own if x in f)
                out.add((part, order, step + 1, sum(not (before | {x}) & set(f) for _, f in own), len(removed), sum(x in f and bool(before & set(f)) for _, f in own), sum(f == x for _, f in own), sum(i in good for i in removed), sum(i in toxic for i in removed), shapley))
    return out


def audit_rows():
    long_ = " ".join(f"word{i}" for i in range(250))
    texts = [long_, long_ + " #", "Few Words", None, "", "same same " * 150, long_.upper(), "a|b", "very long " + "w" * 60_000]
    rows = [(i, texts[i % len(texts)], ["s0", "s1", None][i % 3]) for i in range(90)]
    rows += [(None, long_, "s0"), (None, None, None), (3, long_, "s1"), (3, long_, "s1"), (200, "one more", ""), (-5, long_, "s2")]
    return rows + [(1_000 + i, "hot text", "s0") for i in range(300)] + [(5_000, "repeated", "s1")] * 200 + [(4_999, "repeated", "s3")]


AUDITED, LABELLED = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_audit_equals_brute_force(spark, partitions):
    rows, labels = audit_rows(), [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 4)] + [(1_010, 1, 1), (5_000, None, 1), (3, 1, 0), (3, 0, None), (None, 1, 1), (9_999, 1, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, AUDITED).repartition(5).withColumns({"mask": F.lit("x"), "fp": F.lit(1), "part": F.lit(None).cast("string")})
        got = [tuple(r) for r in filter_audit.audit(docs, spark.createDataFrame(labels, LABELLED).withColumn("n", F.lit(9))).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows, labels)


def test_audit_of_empty_tables(spark):
    out = filter_audit.audit(spark.createDataFrame([], AUDITED), spark.createDataFrame([], LABELLED))
    assert out.collect() == [] and out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


LICENSED = [
    "", None, "MIT License", "the Mit  LICENSE, and cc-by or CC BY 4.0", "GNU General Public License; gnu general public licensee", "gnu general  public\nlicense " * 3, "apache licensé apache", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "mit K license", "ccby cc by", "cc by cc by cc", "unrelated words only",
    "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and the associated documentation files", "permission is hereby granted to nobody", "word " * 6_000 + "apache license " + "x " * 2_000,
]


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, t.label) for t in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(t.text.split())] == t.text.split()]
    return words, sorted(places)


def spans_by_hand(words):
    """Labels and the largest share, straight from the definition of votes, diagonals and shares."""
    labels, best = set(), 0.0
    for t in license_scan.TEMPLATES:
        k, own = (2, t.text.split()) if t.phrase else (4, t.text.split())
        hits = [(i - j, j, i) for i in range(len(words) - k + 1) for j in range(len(own) - k + 1) if words[i : i + k] == own[j : j + k]]
        runs, last = [], None
        for d, j, i in sorted(hits):
            if last is None or d - last > (0 if t.phrase else license_scan.SHIFT):
                runs.append([])
            runs[-1].append((j, i))
            last = d
        for run in runs:
            at = [i for _, i in run]
            share = len({j for j, _ in run}) / max(len(own) - k + 1, max(at) - min(at) + 1)
            best = max(best, share)
            if share >= (1 if t.phrase else t.least):
                labels.add(t.label)
    return labels, best


def test_license_scan_equals_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(LICENSED)] + [(2, "MIT License"), (None, "CC BY")] + [(100 + i, "Released under the MIT License.") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(queries.op13_license_scan(spark, str(tmp_path)).collect(), key=str)
    want = []
    for i, text in rows:
        words, places = base_by_hand(text)
        labels, best = spans_by_hand(words)
        ends = (places[0][0], places[-1][0]) if places else (None, None)
        want.append((i, len(words), len(places), *ends, ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), best))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[15]["labels"] == "mit" and by_id[15]["n_base"] == 0 and by_id[16]["labels"] == "" and by_id[8]["labels"] == "gpl,gpl-3.0"


def test_license_scan_keeps_other_columns_and_own_templates(spark):
    own = spark.createDataFrame([(1, "one two three four five", "x")], "id int, body string, Score string").withColumns({"blob": F.lit(1), "j": F.lit(2), "hash": F.lit(3)})
    out = license_scan.scan(own, "body", [license_scan.Template("t", "one two three four")])
    assert out.columns == ["id", "body", "blob", "j", "hash", "n_words", "places", "score"] and out.first()["score"] == 1.0 and out.first()["places"][0]["end"] == 4
    assert license_scan.scan(own.where("id > 1"), "body").collect() == []
    with pytest.raises(ValueError):
        license_scan.scan(own, "body", [license_scan.Template("t", "too short")])


def test_license_scan_is_native(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rescan_looks_at_new_texts_only(spark, tmp_path):
    """Equals a scan without a ledger; a text is scanned if no document of the first version has it."""
    rows = [(1, "password = abcdefghijkl"), (2, "password = abcdefghijkl!"), (3, None), (4, "x"), (5, "token = 0123456789abcdef"), (6, ""), (7, "x\ntoken = abcdefghijkl0123"), (None, "x"), (8, "\ntoken = abcdefghijkl0123")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_secret_rescan(spark, str(tmp_path)).collect()
    after = [(i, (t or "") + "\ntoken = abcdefghijkl0123" if len(t or "") % 2 == 0 else t) for i, t in rows]
    whole = secrets_ledger.scan(spark.createDataFrame(after, "doc_id long, text string"))[0]
    want = {r["doc_id"]: r["s"] for r in whole.select("doc_id", secrets_ledger.joined(F.col("spans")).alias("s")).collect()}
    seen = {t or "" for _, t in rows}
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, scanned={(t or '') not in seen}, spans={want[i]!r})" for i, t in after)
    assert {r["scanned"] for r in got} == {True, False}
