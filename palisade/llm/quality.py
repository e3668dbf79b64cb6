"""Operator 8: quality rules as weak supervision. Native: DataFrame and SQL functions only.

Each rule votes for a text (1), against it (-1) or abstains (0). Texts with equal votes are counted together, so
the corpus shrinks to at most 3^rules rows, whatever its size; expectation-maximisation over them (one SQL fold)
estimates for every rule how often it votes which way on good and on bad texts, and the share of good texts (with a weak
prior, so that the two classes keep their meaning). A text is kept if its posterior probability of being good is at least 0.5.

Null and empty texts have no words; every rule abstains. Repeated rows and ties get equal verdicts; an empty
table gives an empty result. keep_good keeps all columns of its input; add_votes replaces those named like its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SPACES, fresh, masked, text_or_empty, unmasked, words, written

#: Words of the windows whose repetition is counted.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
ROUNDS = 25
#: How often a rule is thought to vote against, abstain and vote for good texts, and for bad ones; counts as this share of the corpus.
PRIOR, STRENGTH = ((0.01, 0.24, 0.75), (0.35, 0.3, 0.35)), 0.1
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """votes for a text where good holds, against it where bad holds (bad wins), else abstains."""

    name: str
    good: Column
    bad: Column


def rules() -> list[Rule]:
    """The production rules, over the columns that add_measures adds."""
    c, words_ = F.col, F.greatest(F.col("n_words"), F.lit(1))
    share = lambda name: c(name) / words_
    long_enough = c("n_words") >= 20
    return [
        Rule("symbols", long_enough & (share("n_symbols") < 0.01), share("n_symbols") > 0.1),
        Rule("repetition", long_enough & (share("n_repeat_words") < 0.05), share("n_repeat_words") > 0.3),
        Rule("lines", long_enough & (c("n_dup_lines") <= 1), c("n_dup_lines") * 2 > c("n_lines")),
        Rule("letters", long_enough & (c("n_letters") * 100 > 90 * c("word_chars")), c("n_letters") * 100 < 85 * c("word_chars")),
        Rule("bare symbols", long_enough & (c("n_bare") == 0), share("n_bare") > 0.1),
        Rule("capitals", long_enough & (c("n_upper") * 10 < c("word_chars")), c("n_upper") * 2 > c("word_chars")),
        Rule("exclamations", long_enough & (share("n_shouts") < 0.02), share("n_shouts") > 0.2),
        Rule("word length", long_enough & c("word_chars").between(3 * words_, 9 * words_), ~c("word_chars").between(2 * words_, 14 * words_)),
        Rule("punctuation", long_enough & (share("n_stops") > 0.02), long_enough & (share("n_stops") < 0.002)),
    ]


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def add_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts that the rules look at. Windows are compared by 64-bit hashes, inside the row.

    No window leaves its row: nothing is exploded or shuffled, and a long text costs n log n.
    """
    w, h, s, at = fresh(df, "_w", "_h", "_s", "_at")
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    df = df.withColumns(
        {
            w: words(F.col(text)),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
            "n_symbols": _count(t, SYMBOLS),
            "n_shouts": _count(t, "!"),
            "n_stops": _count(t, ".?"),
            "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
        }
    )
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(w), i, WINDOW)))
    df = df.withColumns({"n_words": F.size(w).cast("long"), "n_bare": F.size(F.filter(w, lambda x: x.isin(*SYMBOLS))).cast("long"), h: F.when(F.size(w) > WINDOW, windows)}).drop(w)
    placed = F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), placed)).drop(h)
    near = lambda j: F.get(F.col(s), j)["h"]
    twice = F.filter(F.col(s), lambda e, j: F.coalesce(near(j - 1) == e["h"], F.lit(False)) | F.coalesce(near(j + 1) == e["h"], F.lit(False)))
    df = df.withColumn(at, F.sort_array(F.transform(twice, lambda e: e["i"]))).drop(s)
    covered = F.transform(F.col(at), lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(at), j + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop(at)


def add_votes(df: DataFrame, text: str = "text", battery: list[Rule] | None = None) -> DataFrame:
    battery = battery or rules()
    df = add_measures(df, text)
    vote = lambda r: F.when(r.bad, F.lit(-1)).when(r.good, F.lit(1)).otherwise(F.lit(0))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumns({"votes": F.array(*[F.when(F.col("n_words") == 0, F.lit(0)).otherwise(vote(r)) for r in battery]), "base_failed": base_failed})


def posteriors(voted: DataFrame) -> DataFrame:
    """(votes, posterior): the probability of being good for each combination of votes that occurs.

    theta holds, for rule j, class c (0: good) and vote v, at 6j + 3c + v + 1, how often the rule votes so on such
    texts; `shares` the two classes' weights. The first guess: the more votes against a text, the likelier it is bad.
    An abstention says nothing about the text.
    """
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    model = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    guess = "transform(patterns, x -> struct(x.votes AS votes, x.n AS n, array(0.99D, 0.3D, 0.02D)[least(2, size(filter(x.votes, v -> v < 0)))] AS p))"
    totals = "array(aggregate({p}, 1D, (a, x) -> a + x.n * x.p), aggregate({p}, 1D, (a, x) -> a + x.n * (1 - x.p)))"
    prior = f"{STRENGTH}D * aggregate({{p}}, 0D, (a, x) -> a + x.n)"
    theta = (
        "transform(sequence(0, 6 * size({p}[0].votes) - 1), k -> aggregate({p}, "
        f"if(k % 6 < 3, array{PRIOR[0]}[k % 3], array{PRIOR[1]}[k % 3]) * {prior}, (a, x) -> a + "
        f"if(x.votes[k div 6] = k % 3 - 1, x.n * if(k % 6 < 3, x.p, 1 - x.p), 0D)) / ({{t}}[int(k % 6 >= 3)] + {prior}))"
    )
    side = lambda c: f"s.theta[6 * j + {c} + x.votes[j] + 1] / (s.theta[6 * j + {c}] + s.theta[6 * j + {c} + 2])"
    odds = f"aggregate(sequence(0, size(x.votes) - 1), ln(s.shares[0] / s.shares[1]), (a, j) -> a + if(x.votes[j] = 0, 0D, ln({side(0)}) - ln({side(3)})))"
    fit = lambda p: f"struct({totals.format(p=p)} AS shares, {theta.format(p=p, t=totals.format(p=p))} AS theta)"
    expect = f"transform(patterns, x -> struct(x.votes AS votes, x.n AS n, 1 / (1 + exp(-({odds}))) AS p))"
    # One struct in the fold: the parameters; each round expects, then maximises.
    step = f"transform(array({expect}), q -> {fit('q')})[0]"
    model = model.where("size(patterns) > 0").withColumn("guess", F.expr(guess)).withColumn("start", F.expr(fit("guess")))
    model = model.withColumn("s", F.expr(f"aggregate(sequence(1, {ROUNDS}), start, (s, _i) -> {step})"))
    return model.select(F.explode(F.expr(expect)).alias("x")).select("x.votes", F.col("x.p").alias("posterior"))


def judged(voted: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """voted (of add_votes) with the posterior and the verdict; model: of posteriors, by default fitted on voted.

    The model has at most 3^rules rows, so it is broadcast.
    """
    model = model if model is not None else posteriors(voted)
    out = voted.join(F.broadcast(model), "votes", "left")
    # One comparison, of both sides of the join: a conjunct on the measures alone would be pushed below them, and
    # every array that they are made of would then be computed again for each of its elements.
    return out.withColumn("kept", F.coalesce("posterior", F.lit(0.0)) >= F.when(F.col("base_failed"), 2.0).otherwise(0.5))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that are kept, with df's columns. Rows are written once with their votes, so that measures are taken once."""
    inner, of = masked(df)
    voted = add_votes(inner, of[text]).select(*inner.columns, "votes", "base_failed")
    return unmasked(judged(written(voted, "voted")).where("kept"), of)
