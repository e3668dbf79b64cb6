"""Rules over tables of packages: all that look at one text in one projection over one scan, the others as joins and predicates.

Inputs are entries (ecosystem, name, version, ordinal, path, kind, text, mode), lifecycle (.., hook, kind, body, path),
manifests (.., raw as JSON text, bin as map) and registry (.., published_at, package_created_at, total_versions).
Every function gives rows of FINDING columns; a package is (ecosystem, name, version).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed, scanner
from palisade.functions.rulespec import BINARY_KINDS, PRESENCE_RULES, TEXT_RULES, Scope, TextRule, alternatives
from palisade.functions.spans import given, spans

PACKAGE = ["ecosystem", "name", "version"]
FINDING = [*PACKAGE, "rule_id", "severity", "category", "location", "excerpt", "message", "defers", "capabilities"]


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def finding(rule: str, severity: str | Column, category: str, location: Column, excerpt: Column, message: str, defers: bool, capabilities=()) -> Column:
    caps = sorted(capabilities, key=fixed.CAPABILITIES.index)
    return F.struct(
        F.lit(rule).alias("rule_id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(category).alias("category"),
        location.alias("location"), excerpt.alias("excerpt"), F.lit(message).alias("message"), F.lit(defers).alias("defers"), strings(caps).alias("capabilities"),
    )


def units(entries: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Texts to scan: (package, unit, kind, location, text, ordinal); unit is entry or hook."""
    e = entries.where(F.col("text").isNotNull() & ~F.col("kind").isin(*BINARY_KINDS))
    e = e.select(*PACKAGE, F.lit("entry").alias("unit"), "kind", F.col("path").alias("location"), "text", F.col("ordinal").cast("long").alias("ordinal"))
    return e.unionByName(_hooks(lifecycle))


def _hooks(lifecycle: DataFrame) -> DataFrame:
    place = F.coalesce("path", F.concat(F.lit("package.json#scripts."), F.col("hook")))
    return lifecycle.select(*PACKAGE, F.lit("hook").alias("unit"), "kind", place.alias("location"), F.col("body").alias("text"), F.lit(0).cast("long").alias("ordinal"))


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values) -> str:
    return ", ".join(map(quoted, values))


_SCOPES = {
    "S": "unit = 'entry'",
    "J": "unit = 'entry' AND kind IN ('js_source', 'text')",
    "R": "unit = 'entry' AND kind = 'rust_source'",  # and of a macro crate, which the hits are asked for
    "D": f"unit = 'entry' AND lower(location) IN ({_listed(fixed.ROOT_DOCUMENTS)})",
    "L": "unit = 'hook'",
    "LI": "unit = 'hook' AND kind = 'install_time'",
    "LP": "unit = 'hook' AND kind = 'publish_time'",
}


def _where(rule: TextRule, scope: Scope) -> str:
    return f"ecosystem IN ({_listed(rule.ecosystems)}) AND (" + " OR ".join(f"({_SCOPES[u]})" for u in scope.units) + ")"


def first_match(pattern: str, group: int = 0) -> str:
    """SQL of the first match (or its group), null without one; `.` stops at line feeds only."""
    p = quoted(f"(?d){pattern}")
    return f"CASE WHEN text RLIKE {p} THEN regexp_extract(text, {p}, {group}) END"


def hinted(rule: TextRule) -> str:
    """SQL of whether a literal that every match holds is there: looked for first, as that is much cheaper than the pattern."""
    text = "low" if rule.pattern.startswith("(?i)") else "text"
    return " OR ".join(f"contains({text}, {quoted(h)})" for h in rule.hints) or "true"


def _excerpt(rule: TextRule) -> str:
    hit = first_match(rule.pattern, rule.group)
    if rule.also:
        hit = f"CASE WHEN text RLIKE {quoted(f'(?d){rule.also}')} THEN concat({hit}, ' … ', {first_match(rule.also)}) END"
    hit = f"CASE WHEN {hinted(rule)} THEN {hit} END"
    return f"coalesce({hit}, CASE WHEN unit = 'entry' THEN {first_match(rule.instead)} END)" if rule.instead else hit


def _in_code(rule: TextRule, hit: Column) -> Column:
    """The hit, null if it lies in a comment, string or template where such hits don't count."""
    gated = (F.col("unit") == "entry") & (F.lit(True) if rule.suppress == "all" else F.col("kind") == "js_source")
    at = F.length(F.get(F.split("text", f"(?d){rule.pattern}", 2), F.lit(0)))
    return given(hit, lambda h: F.when(h.isNotNull(), F.when(~gated, h).when(~scanner.inside(F.col("js"), at), h)))


def _code_matters(rules: list[TextRule], blobs: bool) -> Column | None:
    """Of which files it matters what is code: those that have a hit of a rule that doesn't count hits elsewhere."""
    maybe = [f"(({hinted(r)}) AND text RLIKE {quoted(f'(?d){r.pattern}')})" for r in rules if r.suppress]
    need = F.expr(" OR ".join(maybe)) if maybe else None
    if blobs:
        need = _blob_likely() if need is None else need | _blob_likely()
    return None if need is None else need & (F.col("unit") == "entry")


def _present(found: list[Column]) -> Column:
    """Those findings that have an excerpt."""
    return F.filter(F.array(*found), lambda f: f["excerpt"].isNotNull())


def _text_findings(rules: list[TextRule]) -> Column:
    """As SQL text, since there are many."""
    found = []
    for rule in rules:
        for scope in rule.scopes:
            excerpt = f"CASE WHEN {_where(rule, scope)} THEN {_excerpt(rule)} END"
            if rule.suppress:
                found.append(finding(rule.id, scope.severity, rule.category, F.col("location"), _in_code(rule, F.expr(excerpt)), rule.message, rule.defers, scope.capabilities))
                continue
            caps = _listed(sorted(scope.capabilities, key=fixed.CAPABILITIES.index))
            found.append(F.expr(
                f"named_struct('rule_id', {quoted(rule.id)}, 'severity', {quoted(scope.severity)}, 'category', {quoted(rule.category)}, 'location', location, 'excerpt', {excerpt}, "
                f"'message', {quoted(rule.message)}, 'defers', {str(rule.defers).lower()}, 'capabilities', CAST(array({caps}) AS array<string>))"
            ))
    return _present(found)


#: Rules that look at Rust sources of macro crates alone.
MACRO_RULES = [r.id for r in TEXT_RULES if any("R" in s.units for s in r.scopes)]
assert all(s.units == ("R",) for r in TEXT_RULES if r.id in MACRO_RULES for s in r.scopes), "their findings are told by the rule"


def _of_macro_crates(hits: DataFrame, macro_crates: DataFrame | None) -> DataFrame:
    """The hits without those that count in macro crates only and lie elsewhere. Narrow hits meet the crates, not the texts, which would be shuffled for it."""
    elsewhere = ~F.col("rule_id").isin(MACRO_RULES)
    if macro_crates is None:
        return hits.where(elsewhere)
    crates = macro_crates.select(*PACKAGE).distinct().withColumn("macro_crate", F.lit(True))
    return hits.join(crates, PACKAGE, "left").where(elsewhere | F.col("macro_crate").isNotNull()).drop("macro_crate")


def _exploded(scanned: DataFrame, found: list[Column], macro_crates: DataFrame | None = None, code_of: Column | None = None) -> DataFrame:
    """The findings of all arrays, each text read once. code_of: which texts the scanner has to look at (column js)."""
    scanned = scanned.withColumn("low", F.lower("text"))
    scanned = scanned.withColumn("js", F.lit(None).cast(scanner.SCANNED) if code_of is None else scanner.scanned(F.when(code_of, F.col("text"))))
    hits = scanned.select(*PACKAGE, "ordinal", F.explode(F.concat(*found)).alias("f")).select(*PACKAGE, "ordinal", "f.*")
    return _of_macro_crates(hits, macro_crates)


def _first_file_only(hits: DataFrame) -> DataFrame:
    once = F.col("rule_id") == "NPM035"
    place = F.row_number().over(Window.partitionBy(*PACKAGE).orderBy(once, "ordinal", "location"))
    before = F.count_if(~once).over(Window.partitionBy(*PACKAGE))
    return hits.withColumns({"place": place, "before": before}).where(~once | (F.col("place") == F.col("before") + 1)).select(*FINDING)


def text_findings(scanned: DataFrame, macro_crates: DataFrame | None = None, rules: list[TextRule] | None = None) -> DataFrame:
    """scanned: of units. macro_crates: packages whose Rust sources are those of a procedural macro."""
    rules = TEXT_RULES if rules is None else rules
    hits = _exploded(scanned, [_text_findings(rules)], macro_crates, _code_matters(rules, False))
    return _first_file_only(hits) if any(r.id == "NPM035" for r in rules) else hits.select(*FINDING)


def unit_findings(scanned: DataFrame, macro_crates: DataFrame, as_of: Column) -> DataFrame:
    """Findings of all rules that look at one text: one scan, one projection."""
    found = [_text_findings(TEXT_RULES), _presence(), _blobs(), _unicode(), _bombs(as_of)]
    return _first_file_only(_exploded(scanned, found, macro_crates, _code_matters(TEXT_RULES, True)))


def _presence() -> Column:
    short = F.when(F.length("text") > 240, F.concat(F.substring("text", 1, 240), F.lit("…"))).otherwise(F.col("text"))
    installs = (F.col("unit") == "hook") & (F.col("kind") == "install_time")
    found = [finding(rule, "info", "lifecycle_script", F.col("location"), F.when(installs & (F.col("ecosystem") == eco), short), "runs code at install time", False, caps) for eco, (rule, caps) in PRESENCE_RULES.items()]
    return _present(found)


def presence_findings(lifecycle: DataFrame) -> DataFrame:
    """NPM001, CARGO001, PYPI001, NUGET001: an install hook exists."""
    return _exploded(_hooks(lifecycle), [_presence()]).select(*FINDING)


def _rows(df: DataFrame, f: Column) -> DataFrame:
    return df.select(*PACKAGE, f.alias("f")).select(*PACKAGE, "f.*")


def _blob_likely() -> Column:
    """What a text needs to have for NPM005 to look closer."""
    text, entry = F.col("text"), F.col("unit") == "entry"
    of_interest = (F.col("ecosystem") == "npm") & (~entry | F.col("kind").isin("js_source", "text"))
    likely = F.contains(text, F.lit("eval")) | F.contains(text, F.lit("Function")) | F.contains(text, F.lit("runIn"))
    return of_interest & likely & text.rlike("[A-Za-z0-9+/]{1000}")


def _blobs() -> Column:
    """NPM005. Distances run from the call's start, in bytes; the first blob with a call near it counts."""
    text, entry = F.col("text"), F.col("unit") == "entry"
    exec_re = alternatives("execution")
    blobs = F.concat(*[spans(text, alternatives(name)) for name in ("base64_blob", "hex_blob")])
    calls = spans(text, exec_re)
    calls = F.when(entry, F.filter(calls, lambda c: ~scanner.inside(F.col("js"), c["start"]))).otherwise(calls)

    def near(b: Column, x: Column) -> Column:
        at = F.when(x["start"] > b["end"], b["end"]).otherwise(x["start"])
        chars = F.when(x["start"] > b["end"], x["start"] - b["end"]).when(b["start"] > x["start"], b["start"] - x["start"]).otherwise(0)
        plain = F.octet_length(text) == F.length(text)
        return (chars <= fixed.BLOB_GAP) & (plain | (F.octet_length(F.substring(text, at + 1, chars)) <= fixed.BLOB_GAP))

    both = F.struct(blobs.alias("blobs"), calls.alias("calls"))
    hit = given(both, lambda s: F.get(F.filter(s["blobs"], lambda b: F.exists(s["calls"], lambda x: near(b, x))), F.lit(0)))
    around = lambda h: F.substring(text, F.greatest(h["start"] - 40, F.lit(0)) + 1, F.least(F.lit(200), h["end"] + 40 - F.greatest(h["start"] - 40, F.lit(0))))
    excerpt = given(hit, lambda h: F.when(h.isNotNull(), F.concat(F.lit("…"), around(h), F.lit("…"))))
    excerpt = F.when(_blob_likely(), excerpt)
    return _present([finding("NPM005", "critical", "obfuscation", F.col("location"), excerpt, "encoded blob next to code that executes it", False, ("dynamic_eval", "encoded_payload"))])


def blob_near_execution(scanned: DataFrame) -> DataFrame:
    """NPM005: an encoded run within BLOB_GAP bytes of code that executes text."""
    return _exploded(scanned, [_blobs()], code_of=_code_matters([], True)).select(*FINDING)


def native_binaries(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """NPM009: native files that no declared bin path names (the path may end with it)."""
    declared = manifests.select(*PACKAGE, F.transform(F.map_values("bin"), lambda p: F.regexp_replace(p, r"^\./", "")).alias("bins"))
    rows = entries.where("ecosystem = 'npm' AND kind = 'native_binary'").join(declared, PACKAGE, "left")
    rows = rows.where(~F.coalesce(F.exists("bins", lambda b: F.endswith(F.col("path"), b)), F.lit(False)))
    return _rows(rows, finding("NPM009", "high", "native_binary", F.col("path"), F.lit(None).cast("string"), "native binary that no bin entry declares", True, ("native_binary",)))


def _member(key: str) -> Column:
    return F.try_variant_get(F.try_parse_json("raw"), f"$.{key}", "variant")


def _is(member: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(member) == kind, F.lit(False))


def _strings_of(key: str) -> Column:
    """The strings of a list in the manifest, in order; null if it is no list."""
    items = F.try_variant_get(F.try_parse_json("raw"), f"$.{key}", "array<variant>")
    return F.transform(F.filter(items, lambda v: _is(v, "STRING")), lambda v: F.try_variant_get(v, "$", "string"))


def _string_of(key: str) -> Column:
    return F.when(_is(_member(key), "STRING"), F.try_variant_get(F.try_parse_json("raw"), f"$.{key}", "string"))


def bundled_dependencies(manifests: DataFrame) -> DataFrame:
    """NPM012: bundleDependencies and bundledDependencies, each a list of names or true; both count."""
    true = lambda key: F.when(_is(_member(key), "BOOLEAN") & (F.try_variant_get(F.try_parse_json("raw"), f"$.{key}", "boolean")), strings(["*"]))
    none = strings([])
    both = [F.coalesce(_strings_of(key), true(key), none) for key in ("bundleDependencies", "bundledDependencies")]
    rows = manifests.where("ecosystem = 'npm'").withColumn("names", F.concat(*both)).where(F.size("names") > 0)
    return _rows(rows, finding("NPM012", "high", "other", F.lit("package.json"), F.array_join("names", ", "), "bundles its dependencies", True))


def shortened(name: Column) -> Column:
    """The name, and what is left of it without one or two of its letters. Names two edits apart or less have one of these in common."""
    at = lambda x: F.sequence(F.lit(1), F.length(x))
    without = lambda x: F.when(F.length(x) > 0, F.transform(at(x), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
    once = F.array_distinct(without(name))
    return F.array_distinct(F.concat(F.array(name), once, F.flatten(F.transform(once, without))))


def lookalikes(packages: DataFrame, as_of: Column, top: list[str] | DataFrame | None = None) -> DataFrame:
    """NPM014: names one or two edits from a well-known one, of packages younger than 90 days or of unknown age.

    packages: package and package_created_at. top: names, most important first, or a table (ordinal, top) of any size. Names meet
    in a hash join of their shortened forms, never each with each; only those that have met are compared.
    """
    spark = packages.sparkSession
    if not isinstance(top, DataFrame):
        listed = list(dict.fromkeys(top or fixed.TOP_PACKAGES))
        top = spark.range(1).select(F.posexplode(strings(listed)).alias("ordinal", "top"))
    top = top.groupBy(F.lower("top").alias("listed")).agg(F.min(F.struct("ordinal", "top")).alias("t")).select("listed", "t.*")
    young = F.col("package_created_at").isNull() | (F.timestamp_diff("DAY", F.col("package_created_at"), as_of) < fixed.AGES["lookalike_days"])
    rows = packages.where((F.col("ecosystem") == "npm") & young).withColumn("own", F.lower("name"))
    # Each name once, however many versions it has; one that is listed itself, or is too long for any, looks like none.
    longest = top.agg(F.coalesce(F.max(F.length("listed")), F.lit(0))).first()[0]
    names = rows.select("own").where(F.length("own") <= longest + 2).distinct().join(top.select(F.col("listed").alias("own")), "own", "left_anti")
    index = top.select("listed", "ordinal", "top", F.explode(shortened(F.col("listed"))).alias("form"))
    met = names.select("own", F.explode(shortened(F.col("own"))).alias("form")).join(index, "form").select("own", "listed", "ordinal", "top").distinct()
    near = met.withColumn("d", F.levenshtein("own", "listed", 2)).where("d BETWEEN 1 AND 2")
    best = near.groupBy("own").agg(F.min(F.struct("d", "ordinal", "top")).alias("best"))
    rows = rows.join(best, "own").select(*PACKAGE, "own", "best").distinct()
    excerpt = F.concat("own", F.lit(" ~= "), F.col("best.top"), F.lit(" (distance "), F.col("best.d").cast("string"), F.lit(")"))
    return _rows(rows, finding("NPM014", "high", "typosquat", F.lit("package.json"), excerpt, "name looks like a well-known package's", True))


def recency(registry: DataFrame, as_of: Column) -> DataFrame:
    """NPM016: a new package with few versions; a fresh version of one with many."""
    a, none = fixed.AGES, F.lit(None).cast("string")
    days = lambda c: F.timestamp_diff("DAY", F.col(c), as_of)
    new = (days("package_created_at") < a["package_days"]) & (F.col("total_versions") <= a["package_versions"])
    fresh = (days("published_at") < a["version_days"]) & (F.col("total_versions") >= a["version_versions"])
    make = lambda severity, message: finding("NPM016", severity, "maintainer", F.lit("registry"), none, message, True)
    both = F.array_compact(F.array(F.when(new, make("medium", "new package")), F.when(fresh, make("high", "fresh version of a settled package"))))
    rows = registry.where(F.col("ecosystem").isin("npm", "cargo")).select(*PACKAGE, F.explode(both).alias("f"))
    return rows.select(*PACKAGE, "f.*")


def _glob(pattern: Column) -> Column:
    """A files pattern as a regular expression on paths: a plain one is a file or a folder; `*` crosses folders, `?` is itself."""
    p = F.regexp_replace(F.regexp_replace(pattern, r"\A(?:\./)+", ""), r"/+\z", "")
    quoted = lambda t: F.regexp_replace(t, r"([.+*?^${}()|\[\]\\])", r"\\$1")
    loose = lambda t: F.replace(quoted(t), F.lit(r"\*"), F.lit(".*"))
    rest, folder = F.substring(p, F.lit(4), F.length(p)), F.substring(p, F.lit(1), F.length(p) - 3)
    body = (
        F.when(~p.rlike(r"[*?]"), F.concat(quoted(p), F.lit("(?:/.*)?")))
        .when(F.startswith(p, F.lit("**/")), F.concat(F.lit(".*"), quoted(rest), F.lit("|"), loose(rest)))
        .when(F.endswith(p, F.lit("/**")), F.concat(quoted(folder), F.lit("(?:/.*)?")))
        .otherwise(loose(p))
    )
    return F.concat(F.lit(r"(?s)\A(?:"), body, F.lit(r")\z"))


def unlisted_files(entries: DataFrame, manifests: DataFrame, most: int = 10) -> DataFrame:
    """NPM021: shipped files that the manifest's files list doesn't cover."""
    bare = lambda p: F.regexp_replace(p, r"\A(?:\./)+", "")
    bins = F.transform(F.map_values("bin"), bare)
    named = F.array_compact(F.concat(F.array(*[bare(_string_of(k)) for k in ("main", "module", "types")]), F.coalesce(bins, strings([]))))
    allow = manifests.where("ecosystem = 'npm'").select(*PACKAGE, _strings_of("files").alias("listed"), F.transform(named, F.lower).alias("named")).where("listed IS NOT NULL")
    allow = allow.withColumn("patterns", F.transform("listed", _glob))
    rows = entries.join(allow, PACKAGE).where(~F.lower("path").isin(*fixed.IMPLICIT_FILES))
    covered = F.array_contains("named", F.lower("path")) | F.exists("patterns", lambda p: F.regexp_like(F.col("path"), p))
    rows = rows.where(~covered).groupBy(*PACKAGE).agg(F.sort_array(F.collect_list(F.struct("ordinal", "path"))).alias("extra"))
    shown = F.array_join(F.transform(F.slice("extra", 1, most), lambda x: x["path"]), ", ")
    excerpt = F.concat(shown, F.when(F.size("extra") > most, F.concat(F.lit(" (+"), (F.size("extra") - most).cast("string"), F.lit(" more)"))).otherwise(""))
    return _rows(rows, finding("NPM021", "high", "other", F.lit("package.json"), excerpt, "ships files that its list leaves out", True))


def _unicode() -> Column:
    """NPM022. Strings are what lies between equal quotes not preceded by a backslash; one that isn't closed runs to the end."""
    bidi, zero = "[\u202a-\u202e\u2066-\u2069]", "[\u200b-\u200d\u2060\ufeff]"
    blank = F.regexp_replace("text", "|".join(rf"{q}(?:[^{q}]++|(?<=\\){q})*+(?:{q}|\z)" for q in "\"'`"), " ")
    letter, other = r"[\p{IsAlphabetic}\p{N}_$]", r"[[\p{IsAlphabetic}\p{N}]&&[^\x00-\x7F]]"
    word = rf"(?<!{letter})(?={letter}*[A-Za-z])(?={letter}*{other}){letter}+"

    def at(what: str, pattern: str) -> Column:
        hit = F.regexp_substr("text", F.lit(pattern))
        before = F.octet_length(F.substring(F.col("text"), F.lit(1), F.regexp_instr("text", F.lit(pattern)) - 1))
        code = F.lpad(F.hex(F.encode(hit, "UTF-16BE")), 4, "0")
        return F.when(odd & F.col("text").rlike(pattern), F.concat(F.lit(f"{what} U+"), code, F.lit(" at offset "), before.cast("string")))

    odd = (F.col("unit") == "entry") & (F.octet_length("text") != F.length("text"))
    mixed = F.when(odd & (F.col("kind") == "js_source"), F.regexp_substr(blank, F.lit(word)))
    make = lambda severity, excerpt, defers, message: finding("NPM022", severity, "obfuscation", F.col("location"), excerpt, message, defers, ("trojan_source",))
    return _present([make("critical", at("bidi override", bidi), False, "bidirectional control"), make("high", at("zero-width", zero), True, "zero-width character"), make("high", mixed, True, "identifier of mixed alphabets")])


def hidden_unicode(scanned: DataFrame) -> DataFrame:
    """NPM022: bidirectional controls; zero-width characters; identifiers that mix alphabets (JavaScript only, outside strings)."""
    return _exploded(scanned, [_unicode()]).select(*FINDING)


def _bombs(as_of: Column) -> Column:
    where = (F.col("ecosystem") == "npm") & ((F.col("unit") == "hook") | F.col("kind").isin("js_source", "text"))
    clock, date = alternatives("date_now"), alternatives("date_literal")
    make = lambda severity, hit, message: finding("NPM028", severity, "other", F.col("location"), hit, message, True, ("time_bomb",))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(clock), F.lit(0)).alias("hit"), F.regexp_extract_all("text", F.lit(clock), F.lit(2)).alias("value"))
    times = F.filter(pairs, lambda x: x["value"].cast("long") > F.unix_millis(as_of))
    times = F.transform(times, lambda x: make("high", x["hit"], "waits for a time to come"))
    dates = F.filter(F.regexp_extract_all("text", F.lit(date), F.lit(1)), lambda x: F.substring(x, 1, 4).cast("int") > F.year(as_of))
    dates = F.transform(dates, lambda x: make("medium", x, "names a year to come"))
    none = F.filter(F.array(make("high", F.lit("x"), "")), lambda x: F.lit(False))
    return F.concat(F.when(where & F.contains("text", F.lit("Date")), times).otherwise(none), F.when(where & F.col("text").rlike("['\"](?:19|20)"), dates).otherwise(none))


def time_bombs(scanned: DataFrame, as_of: Column) -> DataFrame:
    """NPM028: comparisons of the clock with a future time, and date literals of future years; every match counts."""
    return _exploded(scanned, [_bombs(as_of)]).select(*FINDING)


def setuid_files(entries: DataFrame) -> DataFrame:
    """NPM046: entries with the set-user or set-group bit."""
    rows = entries.where(F.col("ecosystem").isin("npm", "cargo", "pypi") & (F.col("mode").bitwiseAND(0o6000) != 0))
    octal = F.concat(F.lit("0o"), F.conv(F.col("mode").cast("string"), 10, 8))
    return _rows(rows, finding("NPM046", "critical", "persistence", F.col("path"), octal, "set-user or set-group bit", False, ("setuid_binary",)))


def minified_only(entries: DataFrame) -> DataFrame:
    """NPM050: minified files in distribution folders with neither a source map nor a readable source of the same stem.

    One pass over the texts leaves a narrow row for each file that matters; a package's rows meet once.
    """
    m, path, low = fixed.MINIFIED, F.col("path"), F.lower("path")
    script = (F.col("kind") == "js_source") & F.col("text").isNotNull()
    rows = entries.where((F.col("ecosystem") == "npm") & (script | F.endswith(path, F.lit(".map"))))
    sizes = F.transform(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1), lambda x: F.octet_length(F.regexp_replace(x, r"\r\z", "")))
    total = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x)
    long_ = given(sizes, lambda s: (F.array_max(s) >= m["longest_line"]) & (F.floor(total(s) / F.size(s)) >= m["mean_line"]))
    dense = F.regexp_count("text", F.lit(r"\\[xu]")) * 1024 >= m["escapes_per_kib"] * F.octet_length("text")
    minified = script & (F.octet_length("text") > 0) & (long_ | dense)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?\z", 1)
    dist = low.rlike(r"\A(?:dist|build|out|lib)/|/(?:dist|build)/|/bundle|\.min\.js|\.bundle\.js")
    source = F.endswith(path, F.lit(".ts")) | (F.endswith(path, F.lit(".js")) & ~low.rlike(r"\.min\.js|\.bundle\.js"))
    rows = rows.select(*PACKAGE, "path", stem.alias("stem"), script.alias("script"), dist.alias("dist"), source.alias("source"), F.coalesce(minified, F.lit(False)).alias("minified"))
    bare = F.when(F.endswith(path, F.lit(".map")), F.regexp_replace("path", r"\.map\z", ""))
    met = rows.groupBy(*PACKAGE).agg(
        F.collect_list(F.when(F.col("minified") & F.col("dist"), F.struct("path", "stem"))).alias("suspects"),
        F.collect_set(bare).alias("maps"),
        F.collect_set(F.when(F.col("script") & F.col("source") & ~F.col("minified"), F.col("stem"))).alias("readable"),
    )
    left = met.select(*PACKAGE, F.explode(F.filter("suspects", lambda x: ~F.array_contains("maps", x["path"]) & ~F.array_contains("readable", x["stem"]))).alias("x"))
    return _rows(left, finding("NPM050", "medium", "source_divergence", F.col("x.path"), F.lit(None).cast("string"), "minified without a source", True, ("minified_no_source",)))


def macro_crates(manifests: DataFrame) -> DataFrame:
    """Packages whose manifest declares a procedural macro."""
    flag = F.coalesce(F.get_json_object("raw", "$.lib['proc-macro']"), F.get_json_object("raw", "$.lib.proc_macro"))
    return manifests.where((F.col("ecosystem") == "cargo") & (flag == "true"))


def macro_findings(manifests: DataFrame) -> DataFrame:
    """CARGO003."""
    return _rows(macro_crates(manifests), finding("CARGO003", "high", "other", F.lit("Cargo.toml"), F.lit("proc-macro = true"), "runs code in the compiler", True))


def tool_libraries(entries: DataFrame) -> DataFrame:
    """NUGET003: libraries in tools/ of packages with an install script."""
    own = entries.where("ecosystem = 'nuget'").withColumn("low", F.lower("path"))
    hooked = own.where("low IN ('tools/install.ps1', 'tools/init.ps1')").select(*PACKAGE)
    rows = own.where(F.col("low").rlike(r"\Atools/.*\.(?:dll|exe)\z")).join(hooked, PACKAGE, "left_semi")
    return _rows(rows, finding("NUGET003", "high", "native_binary", F.col("path"), F.lit(None).cast("string"), "library beside an install script", True))


def evaluate(entries: DataFrame, lifecycle: DataFrame, manifests: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Findings of all rules."""
    parts = [
        unit_findings(units(entries, lifecycle), macro_crates(manifests), as_of), native_binaries(entries, manifests), bundled_dependencies(manifests),
        lookalikes(registry, as_of), recency(registry, as_of), unlisted_files(entries, manifests), setuid_files(entries), minified_only(entries),
        macro_findings(manifests), tool_libraries(entries),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_report_order(findings: DataFrame) -> DataFrame:
    """findings with ordinal: the place of their rule in a report."""
    order = F.array_position(strings(fixed.RULE_ORDER), F.col("rule_id"))
    return findings.withColumn("ordinal", F.when(order > 0, order).otherwise(len(fixed.RULE_ORDER) + 1).cast("int"))
