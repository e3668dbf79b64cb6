"""The scanner of JavaScript on hand-made sources."""

import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import scanner


def parts(text):
    spans, incomplete = scanner.scan(text)
    return [text[a:b] for a, b in spans], incomplete


CASES = [
    ("", []),
    ("let a = 'x' + \"y\"; // z", ["'x'", '"y"', "// z"]),
    ("/* a 'b' */ c", ["/* a 'b' */"]),
    ("a = 'it\\'s' ; b = \"a\\\\\" ; c", ["'it\\'s'", '"a\\\\"']),
    ("a = b / c / d; e = 'f'", ["'f'"]),
    ("a = /'[/'\"]\\/'/g.test(b) ? 'c' : d", ["'c'"]),
    ("return /'/.test(x)", []),
    ("if (a) /'/.exec(b); 'c'", ["'c'"]),
    ("f(a) / 2; 'b' / 2", ["'b'"]),
    ("x = {a: 1} / 2 + 'y' / 3", ["'y'"]),
    ("{ a() } /'/.test(b)", []),
    ("i++ / 2 + 'x'; a[1] / 2 + 'y'", ["'x'", "'y'"]),
    ("() => { } /x'/; 'a'", ["'a'"]),
    ("`a ${b + `c ${d + `e ${f + `g ${'h' + `i`} j`} k`} l`} m` + 'n'", ["`a ${b + `c ${d + `e ${f + `g ${'h' + `i`} j`} k`} l`} m`", "'n'"]),
    ("`${ {a: {b: '}'}} }` + `}`", ["`${ {a: {b: '}'}} }`", "`}`"]),
    ("`$ {x} \\` \\${ $` ; 'a'", ["`$ {x} \\` \\${ $`", "'a'"]),
    ("`${ /* ` */ x // `\n }`", ["`${ /* ` */ x // `\n }`"]),
    ("'é😀' + a; \"ß\"", ["'é😀'", '"ß"']),
    ("a = 'x\\\ny'", ["'x\\\ny'"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_spans(text, want):
    assert parts(text) == (want, False)


@pytest.mark.parametrize("text", ["'open", '"open\n"', "`open ${a", "`open", "/* open", "f(", "f)", "{ ] }", "`${ ( }`", "a[`${b]}`"])
def test_unbalanced_sources_are_incomplete(text):
    assert parts(text)[1]


def test_brackets_in_strings_and_comments_do_not_count():
    assert parts("// (\n'{' + `[` /* ( */ ; /[(]/") == (["// (", "'{'", "`[`", "/* ( */"], False)


def test_long_sources_take_linear_time():
    for text in ("`${" * 20_000 + "1" + "}`" * 20_000, "a = '" + "x" * 2_000_000 + "'", "/* " + "* " * 1_000_000 + "*/", "((" * 50_000, "x / y / " * 100_000, "'\\n" * 100_000):
        start = time.time()
        scanner.scan(text)
        assert time.time() - start < 5


def test_as_a_column(spark):
    rows = [("x = 'a'", 5), ("x = 'a'", 0), ("x = 'a' + `", 5), (None, 1), ("😀 = 'a'", 5)]
    df = spark.createDataFrame(rows, "t string, at int").withColumn("js", scanner.scanned(F.col("t")))
    got = df.select(scanner.inside(F.col("js"), F.col("at")).alias("x"), F.col("js.incomplete").alias("i")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True), (False, None), (True, False)]
