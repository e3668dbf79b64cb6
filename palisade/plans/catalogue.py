"""The registered queries of the package analyzer over derived tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.rulespec import TEXT_RULES, Scope, TextRule
from palisade.operators import history, rules, scoring, stage2
from palisade.plans import planted
from palisade.sources import catalog
from palisade.sources import packages as packages_source
from palisade.sources.shared import stored
from palisade.streaming import feed

AS_OF = "2024-02-01 00:00:00"
COLUMNS = ["ecosystem", "name", "version", "rule_id", "severity", "category", "location", "excerpt", "defers", "capabilities"]
#: Rules that SQL can say: those whose hits in comments and strings don't count have no SQL counterpart; tests hold them.
PLAIN = [r for r in TEXT_RULES if not r.suppress]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def shown(findings: DataFrame) -> DataFrame:
    return findings.withColumn("capabilities", F.array_join("capabilities", ",")).select(*COLUMNS)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each planted package of documents."""
    i, eco = F.col("doc_id"), planted._pick(F.col("doc_id") % planted.MODULUS, planted.ENTRIES, lambda p: p.ecosystem, "npm")
    raw = (
        F.when(eco == "cargo", F.when(F.expr(f"doc_id div {planted.MODULUS}") % 3 == 2, "{}").otherwise('{"lib":{"proc-macro":true}}'))
        .when(i % 17 == 3, '{"bundleDependencies":["a","b"]}')
        .when(i % 17 == 4, '{"bundledDependencies":true}')
        .when(i % 17 == 5, '{"files":["dist","lib/*.js"]}')
        .otherwise("{}")
    )
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    bins = F.create_map(F.lit("x"), F.concat(F.lit("./bin/"), i.cast("string")))
    site = F.concat(F.lit("https://x.example/"), i.cast("string"))
    return docs.select(
        eco.alias("ecosystem"), F.concat(F.lit("pkg-"), i.cast("string")).alias("name"), F.lit("1.0.0").alias("version"), bins.alias("bin"), raw.alias("raw"),
        site.alias("repository"), F.lit(None).cast("string").alias("homepage"), F.create_map(F.lit("a"), F.lit("1")).alias("dependencies"),
    )


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.units(planted.entries(spark, sf_dir), planted.lifecycle(spark, sf_dir))


# --- text rules ---------------------------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _scope_sql(scope: Scope) -> str:
    docs = ", ".join(map(_quoted, fixed.ROOT_DOCUMENTS))
    of = {
        "S": "unit = 'entry'", "J": "unit = 'entry' AND kind IN ('js_source', 'text')", "L": "unit = 'hook'", "LI": "unit = 'hook' AND kind = 'install_time'",
        "LP": "unit = 'hook' AND kind = 'publish_time'", "D": f"unit = 'entry' AND lower(location) IN ({docs})",
        "R": f"unit = 'entry' AND kind = 'rust_source' AND (CAST(substr(name, 5) AS BIGINT) // {planted.MODULUS}) % 3 <> 2",
    }
    return " OR ".join(f"({of[u]})" for u in scope.units)


def _match_sql(pattern: str, group: int = 0) -> str:
    return f"CASE WHEN regexp_matches(text, {_quoted(pattern)}) THEN regexp_extract(text, {_quoted(pattern)}, {group}) END"


def rule_sql(rule: TextRule) -> str:
    hit = _match_sql(rule.pattern, rule.group)
    if rule.also:
        hit = f"({hit}) || ' … ' || ({_match_sql(rule.also)})"
    if rule.instead:
        hit = f"coalesce({hit}, CASE WHEN unit = 'entry' THEN {_match_sql(rule.instead)} END)"
    ecos = ", ".join(map(_quoted, rule.ecosystems))
    parts = []
    for scope in rule.scopes:
        caps = ",".join(sorted(scope.capabilities, key=fixed.CAPABILITIES.index))
        parts.append(
            f"SELECT ecosystem, name, version, '{rule.id}' AS rule_id, '{scope.severity}' AS severity, '{rule.category}' AS category, location, {hit} AS excerpt, "
            f"{str(rule.defers).lower()} AS defers, '{caps}' AS capabilities FROM units WHERE ecosystem IN ({ecos}) AND ({_scope_sql(scope)})"
        )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE excerpt IS NOT NULL"


def _with_units(sql: str) -> str:
    return f"WITH units AS ({planted.units_sql()}) {sql}"


def one_rule(rule: TextRule) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        crates = rules.macro_crates(manifests(spark, sf_dir)) if any("R" in s.units for s in rule.scopes) else None
        return shown(rules.text_findings(scanned(spark, sf_dir), crates, [rule]))

    return run


def plain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.text_findings(scanned(spark, sf_dir), rules.macro_crates(manifests(spark, sf_dir)), PLAIN)


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every rule over the planted packages."""
    return rules.evaluate(planted.entries(spark, sf_dir), planted.lifecycle(spark, sf_dir), manifests(spark, sf_dir), registry(spark, sf_dir), as_of())


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package that a rule may look at: those with files or hooks, and those known from the registry alone."""
    own = [planted.entries(spark, sf_dir), planted.lifecycle(spark, sf_dir), registry(spark, sf_dir)]
    files, hooks, known = (df.select(*rules.PACKAGE) for df in own)
    return files.unionByName(hooks).unionByName(known)


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over the planted packages."""
    return shown(evaluated(spark, sf_dir))


PLAIN_SQL = " UNION ALL ".join(rule_sql(r) for r in PLAIN)


def stage1_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by all rules. SQL can't say some of them; a test holds the query against brute force."""
    out = scoring.stage1(evaluated(spark, sf_dir), packages(spark, sf_dir))
    return out.withColumn("capabilities", F.array_join("capabilities", ","))


def stage1_plain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by the rules that SQL can say alone, for comparison with STAGE1_SQL."""
    out = scoring.stage1(plain_findings(spark, sf_dir), scanned(spark, sf_dir))
    return out.withColumn("capabilities", F.array_join("capabilities", ","))


def _caps_sql(listed: str) -> str:
    order = ", ".join(map(_quoted, fixed.CAPABILITIES))
    return f"array_to_string(list_filter([{order}], lambda c: list_contains({listed}, c)), ',')"


def stage1_sql(findings: str, packages_: str) -> str:
    """Verdicts of packages (ecosystem, name, version) by findings, both SQL over `units`."""
    return _with_units(f""", f AS ({findings}), w AS (SELECT *, CASE severity {" ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.SEVERITY_WEIGHTS.items())} END AS w FROM f),
 s AS (SELECT u.ecosystem, u.name, u.version, CAST(coalesce(sum(w.w), 0) AS BIGINT) AS score, coalesce(bool_or(NOT defers AND severity = 'critical'), false) AS critical,
   coalesce(bool_or(NOT defers AND w.w > 0), false) AS decisive, coalesce(bool_or(defers), false) AS deferring, string_split(coalesce(string_agg(w.capabilities, ','), ''), ',') AS caps
   FROM ({packages_}) u LEFT JOIN w ON u.ecosystem = w.ecosystem AND u.name = w.name AND u.version = w.version GROUP BY ALL)
SELECT ecosystem, name, version, score, CASE WHEN critical THEN 'malicious' WHEN score = 0 THEN 'clean' WHEN score >= 7 AND decisive THEN 'malicious' ELSE 'suspicious' END AS verdict,
  {_caps_sql("caps")} AS capabilities, deferring FROM s""").replace(") , f AS", "), f AS")  # fmt: skip


STAGE1_SQL = stage1_sql(PLAIN_SQL, "SELECT DISTINCT ecosystem, name, version FROM units")


# --- other rules --------------------------------------------------------------------------------------------------


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of packages named after customers; versions are their orders, moved to the weeks before AS_OF."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("total_versions"), F.max("o_orderkey").alias("k"))
    day = lambda n: F.timestamp_add("DAY", -n, as_of())
    eco = F.element_at(rules.strings(["npm", "cargo", "pypi", "nuget"]), (F.col("o_custkey") % 4 + 1).cast("int"))
    name = F.when(F.col("o_custkey") % 9 == 0, F.element_at(rules.strings(["loadash", "reakt", "expres", "lodash", "axois"]), (F.col("o_custkey") % 5 + 1).cast("int"))).otherwise(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")))
    return orders.select(
        eco.alias("ecosystem"), name.alias("name"), F.col("o_custkey").cast("string").alias("version"), day((F.col("o_custkey") % 13).cast("int")).alias("published_at"),
        day((F.col("k") % 120).cast("int")).alias("package_created_at"), "total_versions", F.lit(None).cast("string").alias("published_by"),
        F.array(F.concat(F.lit("owner-"), F.col("o_custkey").cast("string"))).alias("maintainers"),
    )


REGISTRY_SQL = f"""SELECT ['npm', 'cargo', 'pypi', 'nuget'][CAST(o_custkey % 4 + 1 AS INT)] AS ecosystem,
  CASE WHEN o_custkey % 9 = 0 THEN ['loadash', 'reakt', 'expres', 'lodash', 'axois'][CAST(o_custkey % 5 + 1 AS INT)] ELSE 'customer-' || CAST(o_custkey AS VARCHAR) END AS name,
  CAST(o_custkey AS VARCHAR) AS version, o_custkey % 13 AS version_days, max(o_orderkey) % 120 AS package_days, count(*) AS total_versions FROM orders GROUP BY o_custkey"""


def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.recency(registry(spark, sf_dir), as_of()))


_FIXED_COLUMNS = "ecosystem, name, version, '{rule}' AS rule_id, '{severity}' AS severity, '{category}' AS category, {location} AS location, {excerpt} AS excerpt, {defers} AS defers, '{caps}' AS capabilities"


def _found_sql(rule: str, severity: str, category: str, location: str, excerpt: str, defers: bool, caps: str = "") -> str:
    return _FIXED_COLUMNS.format(rule=rule, severity=severity, category=category, location=location, excerpt=excerpt, defers=str(defers).lower(), caps=caps)


RECENCY_SQL = f"""WITH r AS ({REGISTRY_SQL}) SELECT {_found_sql("NPM016", "medium", "maintainer", "'registry'", "CAST(NULL AS VARCHAR)", True)} FROM r WHERE ecosystem IN ('npm', 'cargo') AND package_days < 30 AND total_versions <= 3
 UNION ALL SELECT {_found_sql("NPM016", "high", "maintainer", "'registry'", "CAST(NULL AS VARCHAR)", True)} FROM r WHERE ecosystem IN ('npm', 'cargo') AND version_days < 7 AND total_versions >= 20"""


def lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.lookalikes(registry(spark, sf_dir), as_of()))


_TOP = ", ".join(map(_quoted, fixed.TOP_PACKAGES))
LOOKALIKES_SQL = f"""WITH r AS ({REGISTRY_SQL}), t AS (SELECT unnest([{_TOP}]) AS top, generate_subscripts([{_TOP}], 1) AS ordinal),
 m AS (SELECT r.ecosystem, r.name, r.version, arg_min(lower(name) || ' ~= ' || top || ' (distance ' || CAST(levenshtein(lower(name), top) AS VARCHAR) || ')', levenshtein(lower(name), top) * 100000 + ordinal) AS top FROM r, t
   WHERE ecosystem = 'npm' AND package_days < 90 AND lower(name) NOT IN ({_TOP}) AND levenshtein(lower(name), top) BETWEEN 1 AND 2 GROUP BY ALL)
SELECT {_found_sql("NPM014", "high", "typosquat", "'package.json'", "top", True)} FROM m"""


def setuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.setuid_files(planted.entries(spark, sf_dir)))


SETUID_SQL = _with_units(f"""SELECT {_found_sql("NPM046", "critical", "persistence", "location", "'0o4755'", False, "setuid_binary")} FROM units WHERE ecosystem IN ('npm', 'cargo', 'pypi') AND mode & {0o6000} <> 0""")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.presence_findings(planted.lifecycle(spark, sf_dir)))


PRESENCE_SQL = _with_units("""SELECT ecosystem, name, version, CASE ecosystem WHEN 'npm' THEN 'NPM001' WHEN 'cargo' THEN 'CARGO001' WHEN 'pypi' THEN 'PYPI001' ELSE 'NUGET001' END AS rule_id,
 'info' AS severity, 'lifecycle_script' AS category, location, CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '…' ELSE text END AS excerpt, false AS defers,
 CASE ecosystem WHEN 'npm' THEN 'lifecycle_install' ELSE '' END AS capabilities FROM units WHERE unit = 'hook' AND kind = 'install_time'""")


def bundled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.bundled_dependencies(manifests(spark, sf_dir)))


BUNDLED_SQL = f"""WITH p AS ({planted.ENTRIES_SQL}), q AS (SELECT *, CAST(substr(name, 5) AS BIGINT) AS i FROM p)
SELECT {_found_sql("NPM012", "high", "other", "'package.json'", "CASE i % 17 WHEN 3 THEN 'a, b' ELSE '*' END", True)} FROM q WHERE ecosystem = 'npm' AND i % 17 IN (3, 4)"""


def macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.macro_findings(manifests(spark, sf_dir)))


MACROS_SQL = f"""WITH p AS ({planted.ENTRIES_SQL}) SELECT {_found_sql("CARGO003", "high", "other", "'Cargo.toml'", "'proc-macro = true'", True)} FROM p
 WHERE ecosystem = 'cargo' AND (CAST(substr(name, 5) AS BIGINT) // {planted.MODULUS}) % 3 <> 2"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of packages made of parts: binaries, maps and minified files by key."""
    k = F.col("p_partkey")
    path = F.when(k % 6 == 0, F.concat(F.lit("bin/"), k.cast("string"))).when(k % 6 == 1, "tools/install.ps1").when(k % 6 == 2, "tools/native.dll").when(k % 6 == 3, F.concat(F.lit("dist/a"), k.cast("string"), F.lit(".min.js"))).when(k % 6 == 4, "build/x.node").when(k % 12 == 5, F.concat(F.lit("dist/a"), (k - 2).cast("string"), F.lit(".min.js.map"))).otherwise("dist/notes.txt")
    kind = F.when(k % 6 == 3, "js_source").when((k % 6).isin(0, 2, 4), "native_binary").otherwise("text")
    text = F.when(k % 6 == 3, F.repeat(F.lit("var a=1;"), 200))
    group = F.expr("p_partkey div 6")
    eco = F.when(group % 3 == 2, "nuget").otherwise("npm")
    return table(spark, sf_dir, "part").select(eco.alias("ecosystem"), F.concat(F.lit("part-"), group.cast("string")).alias("name"), F.lit("1.0.0").alias("version"), k.alias("ordinal"), path.alias("path"), kind.alias("kind"), text.alias("text"))


PART_SQL = """SELECT CASE WHEN (p_partkey // 6) % 3 = 2 THEN 'nuget' ELSE 'npm' END AS ecosystem, 'part-' || CAST(p_partkey // 6 AS VARCHAR) AS name, '1.0.0' AS version, p_partkey AS k,
  CASE p_partkey % 6 WHEN 0 THEN 'bin/' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'tools/install.ps1' WHEN 2 THEN 'tools/native.dll' WHEN 3 THEN 'dist/a' || CAST(p_partkey AS VARCHAR) || '.min.js'
    WHEN 4 THEN 'build/x.node' ELSE CASE WHEN p_partkey % 12 = 5 THEN 'dist/a' || CAST(p_partkey - 2 AS VARCHAR) || '.min.js.map' ELSE 'dist/notes.txt' END END AS path FROM part"""


def part_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_files(spark, sf_dir).where("path LIKE 'bin/%'")
    return files.select(*rules.PACKAGE, F.create_map(F.lit("x"), F.concat(F.lit("./"), "path")).alias("bin"), F.lit("{}").alias("raw"))


def native_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.native_binaries(part_files(spark, sf_dir), part_manifests(spark, sf_dir)))


NATIVE_SQL = f"""WITH p AS ({PART_SQL}) SELECT {_found_sql("NPM009", "high", "native_binary", "path", "CAST(NULL AS VARCHAR)", True, "native_binary")} FROM p
 WHERE ecosystem = 'npm' AND k % 6 IN (0, 2, 4) AND NOT EXISTS (SELECT 1 FROM p b WHERE b.name = p.name AND b.path LIKE 'bin/%' AND ends_with(p.path, b.path))"""


def tool_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.tool_libraries(part_files(spark, sf_dir)))


TOOLS_SQL = f"""WITH p AS ({PART_SQL}) SELECT {_found_sql("NUGET003", "high", "native_binary", "path", "CAST(NULL AS VARCHAR)", True)} FROM p
 WHERE ecosystem = 'nuget' AND path = 'tools/native.dll' AND EXISTS (SELECT 1 FROM p b WHERE b.name = p.name AND b.path = 'tools/install.ps1')"""


def minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.minified_only(part_files(spark, sf_dir)))


MINIFIED_SQL = f"""WITH p AS ({PART_SQL}) SELECT {_found_sql("NPM050", "medium", "source_divergence", "path", "CAST(NULL AS VARCHAR)", True, "minified_no_source")} FROM p
 WHERE ecosystem = 'npm' AND k % 6 = 3 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.name = p.name AND b.path = p.path || '.map')"""


def unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.unlisted_files(planted.entries(spark, sf_dir), manifests(spark, sf_dir)))


UNLISTED_SQL = f"""WITH p AS ({planted.ENTRIES_SQL}) SELECT {_found_sql("NPM021", "high", "other", "'package.json'", "path", True)} FROM p
 WHERE ecosystem = 'npm' AND CAST(substr(name, 5) AS BIGINT) % 17 = 5 AND lower(path) NOT IN ({", ".join(map(_quoted, fixed.IMPLICIT_FILES))})"""


def _planted_sql(plant: str, *found) -> str:
    """What one plant gives, wherever it is: an expectation that doesn't come from the rule's pattern."""
    slot = next(i for i, p in enumerate(planted.PLANTS) if p.text == plant)
    return _with_units(f"SELECT {_found_sql(*found)} FROM units WHERE unit = 'entry' AND CAST(substr(name, 5) AS BIGINT) % {planted.MODULUS} = {slot}")


#: Rules whose hits in comments and strings don't count: of their plants the one in code is found, the other one isn't.
CODE_ONLY_SQL = {
    "NPM015": _planted_sql("x = [104, 116, 116, 112]", "NPM015", "critical", "obfuscation", "location", "'104, 116, 116, 112'", False, "encoded_payload"),
    "NPM018": _planted_sql("fs.unlinkSync(__filename)", "NPM018", "critical", "persistence", "location", "'fs.unlinkSync(__filename'", False, "fs_read,self_delete"),
    "NPM038": _planted_sql("delete require.cache['x']", "NPM038", "high", "obfuscation", "location", "'delete require.cache['", True, "dynamic_eval,dynamic_require"),
    "NPM039": _planted_sql("fs.rmSync(os.homedir(), { recursive: true })", "NPM039", "critical", "persistence", "location", "'fs.rmSync(os.homedir(), { recursive: true … os.homedir('", False, "destructive_fs"),
    "NPM044": _planted_sql("process.binding('fs')", "NPM044", "high", "obfuscation", "location", "'process.binding('", True, "dynamic_eval,v8_internal"),
}
BLOBS_SQL = _planted_sql("eval(x); y = '" + planted.BLOB + "'", "NPM005", "critical", "obfuscation", "location", "'…' || substr(text, 1, 200) || '…'", False, "dynamic_eval,encoded_payload")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rules.blob_near_execution(scanned(spark, sf_dir)))


def unicode_tricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second, third and fourth file gets a control, an invisible character or an identifier of two alphabets at its end."""
    k = F.substring("name", 5, 20).cast("long") % 4
    tricky = F.concat("text", F.element_at(rules.strings(["", "\u202e x", "a\u200bb", " v\u0430lue "]), (k + 1).cast("int")))
    return shown(rules.hidden_unicode(scanned(spark, sf_dir).where("unit = 'entry'").withColumn("text", tricky)))


_LETTER, _OTHER = r"[\p{L}\p{N}_$]", r"[^\P{L}\x00-\x7F]"
_MIXED = f"{_LETTER}*(?:[A-Za-z]{_LETTER}*{_OTHER}|{_OTHER}{_LETTER}*[A-Za-z]){_LETTER}*"
_UNQUOTED = """regexp_replace(t, '"[^"]*("|$)|''[^'']*(''|$)|`[^`]*(`|$)', ' ', 'g')"""
UNICODE_SQL = _with_units(f""", q AS (SELECT *, CAST(substr(name, 5) AS BIGINT) % 4 AS k FROM units WHERE unit = 'entry'), r AS (SELECT *, text || ['', chr(8238) || ' x', 'a' || chr(8203) || 'b', ' v' || chr(1072) || 'lue '][CAST(k + 1 AS INT)] AS t FROM q),
 m AS (SELECT *, {_UNQUOTED} AS u FROM r WHERE kind = 'js_source')
 SELECT {_found_sql("NPM022", "critical", "obfuscation", "location", "'bidi override U+202E at offset ' || CAST(strlen(text) AS VARCHAR)", False, "trojan_source")} FROM r WHERE k = 1
 UNION ALL SELECT {_found_sql("NPM022", "high", "obfuscation", "location", "'zero-width U+200B at offset ' || CAST(strlen(text) + 1 AS VARCHAR)", True, "trojan_source")} FROM r WHERE k = 2
 UNION ALL SELECT {_found_sql("NPM022", "high", "obfuscation", "location", f"regexp_extract(u, '{_MIXED}')", True, "trojan_source")} FROM m WHERE regexp_matches(u, '{_MIXED}')""")  # fmt: skip


def time_bombs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.expr("try_cast(substring(name, 5) AS BIGINT)"), F.length("text").cast("long"))  # files by their package's number, hooks by their length
    snippet = F.when(k % 5 == 0, "if (Date.now() > 1999999999999) x()").when(k % 5 == 1, "if (Date.now() > 1600000000000) x()").when(k % 5 == 2, "d = '2031-01-01'").otherwise("d = '2019-01-01'")
    units = scanned(spark, sf_dir).withColumn("text", F.concat(snippet, F.lit("\n"), "text"))
    return shown(rules.time_bombs(units, as_of()))


TIME_SQL = _with_units(f""", q AS (SELECT *, coalesce(TRY_CAST(substr(name, 5) AS BIGINT), length(text)) % 5 AS k FROM units WHERE ecosystem = 'npm' AND (unit = 'hook' OR kind IN ('js_source', 'text')))
 SELECT {_found_sql("NPM028", "high", "other", "location", "'Date.now() > 1999999999999'", True, "time_bomb")} FROM q WHERE k = 0
 UNION ALL SELECT {_found_sql("NPM028", "medium", "other", "location", "'2031-01-01'", True, "time_bomb")} FROM q WHERE k = 2""")  # fmt: skip


#: Rules whose queries above look at tables with more planted into them; in the plain tables their only hits are these.
_FEW_SQL = [
    f"""WITH p AS ({planted.ENTRIES_SQL}) SELECT {_found_sql("NPM009", "high", "native_binary", "path", "CAST(NULL AS VARCHAR)", True, "native_binary")} FROM p
 WHERE ecosystem = 'npm' AND kind = 'native_binary' AND NOT ends_with(path, 'bin/' || substr(name, 5))""",
    _with_units(f""", m AS (SELECT *, {_UNQUOTED.replace("(t,", "(text,")} AS u FROM units WHERE unit = 'entry' AND kind = 'js_source')
 SELECT {_found_sql("NPM022", "high", "obfuscation", "location", f"regexp_extract(u, '{_MIXED}')", True, "trojan_source")} FROM m WHERE regexp_matches(u, '{_MIXED}')"""),
]
#: Every finding of every rule: what the rules' own SQL gives.
ALL_SQL = " UNION ALL ".join(
    f"SELECT {', '.join(COLUMNS)} FROM ({sql})"
    for sql in [_with_units(PLAIN_SQL), *CODE_ONLY_SQL.values(), BLOBS_SQL, PRESENCE_SQL, BUNDLED_SQL, LOOKALIKES_SQL, RECENCY_SQL, UNLISTED_SQL, SETUID_SQL, MACROS_SQL, *_FEW_SQL]
)
_PACKAGES_SQL = f"SELECT ecosystem, name, version FROM ({planted.ENTRIES_SQL}) UNION SELECT ecosystem, name, version FROM ({planted.LIFECYCLE_SQL}) UNION SELECT ecosystem, name, version FROM ({REGISTRY_SQL})"
VERDICTS_SQL = stage1_sql(ALL_SQL, _PACKAGES_SQL)


# --- history and differences --------------------------------------------------------------------------------------


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of packages: customers' orders; capabilities are the flags and statuses of their lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("capabilities"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    caps = F.coalesce("capabilities", F.array().cast("array<string>"))
    status = F.when(F.col("o_orderkey") % 11 == 0, "malicious").otherwise("clean")
    return orders.select(F.lit("npm").alias("ecosystem"), F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("published_at"), caps.alias("capabilities"), status.alias("status"), (F.col("o_orderkey") % 13 != 0).alias("complete"))


def _diff(versions: DataFrame) -> DataFrame:
    out = history.outcome(versions)
    return out.select("name", "version", "outcome", F.array_join(F.sort_array("introduced"), ",").alias("introduced"))


def diff_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(history.strict_baselines(order_versions(spark, sf_dir)))


def diff_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(history.parity_baselines(order_versions(spark, sf_dir)))


_VERSIONS_SQL = """v AS (SELECT o_custkey AS name, o_orderkey AS version, o_orderdate AS ts, CASE WHEN o_orderkey % 11 = 0 THEN 'malicious' ELSE 'clean' END AS status, o_orderkey % 13 <> 0 AS complete,
  coalesce(list_distinct(list(l_returnflag || l_linestatus) FILTER (l_orderkey IS NOT NULL)), []) AS caps FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
_OUTCOME_SQL = """SELECT name, version, CASE WHEN prev = 'malicious' THEN 'abstained_poisoned_baseline' WHEN n = 0 THEN 'not_attempted' WHEN NOT (n = 5 AND ok) THEN 'abstained_baseline_incomplete' ELSE 'produced' END AS outcome,
  CASE WHEN coalesce(prev, '') <> 'malicious' AND n = 5 AND ok THEN array_to_string(list_sort(list_filter(caps, lambda c: NOT list_contains(base, c))), ',') ELSE '' END AS introduced FROM b"""
STRICT_SQL = f"""WITH {_VERSIONS_SQL}, b AS (SELECT name, version, caps, lag(status) OVER o AS prev, count(*) OVER f AS n, coalesce(bool_and(complete) OVER f, false) AS ok, coalesce(flatten(list(caps) OVER f), []) AS base FROM v
  WINDOW o AS (PARTITION BY name ORDER BY ts, version), f AS (PARTITION BY name ORDER BY ts, version ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) {_OUTCOME_SQL}"""
PARITY_SQL = f"""WITH {_VERSIONS_SQL}, x AS (SELECT a.name, a.version, a.caps, o.status, o.complete, o.caps AS ocaps, row_number() OVER (PARTITION BY a.name, a.version ORDER BY o.ts DESC, o.version DESC) AS r
   FROM v a LEFT JOIN v o ON o.name = a.name AND o.version <> a.version),
 b AS (SELECT name, version, any_value(caps) AS caps, max(status) FILTER (r = 1) AS prev, count(status) AS n, coalesce(bool_and(complete), false) AS ok, coalesce(flatten(list(ocaps) FILTER (ocaps IS NOT NULL)), []) AS base
   FROM x WHERE r <= 5 GROUP BY name, version) {_OUTCOME_SQL}"""


_APPLIED = "list_filter(caps, lambda c: ok AND n = 5 AND coalesce(prev, '') <> 'malicious' AND NOT list_contains(base, c))"
CHANGES_SQL = f"""WITH {_VERSIONS_SQL}, p AS (SELECT name, version, caps, status, lead(version) OVER o AS v2, lead(caps) OVER o AS c2, lead(status) OVER o AS s2 FROM v WINDOW o AS (PARTITION BY name ORDER BY ts, version))
SELECT name, version, array_to_string(list_sort(list_filter(c2, lambda c: NOT list_contains(caps, c))), ',') AS introduced, array_to_string(list_sort(list_filter(caps, lambda c: NOT list_contains(c2, c))), ',') AS removed,
  array_to_string(list_sort(list_filter(caps, lambda c: list_contains(c2, c))), ',') AS shared, (version % 3 = 0) <> (v2 % 3 = 0) AS stage1_changed, status <> s2 AS status_changed, v2 % 12 - version % 12 AS score_delta
FROM p WHERE v2 IS NOT NULL"""


#: Capabilities that stand for the lines' flags: two that are decisive when new, and two that are not.
FLAGS = {"AF": "self_delete", "NF": "crypto_miner", "NO": "net_http", "RF": "net_dns"}


def diff_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First stage verdicts of the orders as versions, after NPM030."""
    named = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    versions = order_versions(spark, sf_dir).withColumn("capabilities", F.transform("capabilities", lambda c: F.coalesce(named[c], c)))
    versions = versions.withColumn("k", F.col("version"))
    verdict = F.when(F.col("k") % 11 == 0, "malicious").when(F.col("k") % 3 == 0, "clean").otherwise("suspicious")
    own = versions.select(*rules.PACKAGE, (F.col("k") % 12).alias("score"), verdict.alias("verdict"), (F.col("k") % 2 == 0).alias("deferring"))
    out = history.applied(own, history.outcome(history.strict_baselines(versions)))
    return out.select(*[F.col(c).cast("string").alias(c) for c in ("name", "version")], "score", "verdict", "deferring", "outcome", F.array_join(F.sort_array("introduced"), ",").alias("introduced"))


_NAMES_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FLAGS.items()) + " ELSE c END"
APPLIED_SQL = f"""{STRICT_SQL.removesuffix(_OUTCOME_SQL)}, d AS (SELECT *, {_APPLIED} AS new FROM b),
 e AS (SELECT *, len(list_filter(new, lambda c: c IN ('AF', 'NF'))) AS hard, len(list_filter(new, lambda c: c NOT IN ('AF', 'NF'))) AS soft,
   CASE WHEN version % 11 = 0 THEN 'malicious' WHEN version % 3 = 0 THEN 'clean' ELSE 'suspicious' END AS was FROM d)
SELECT CAST(name AS VARCHAR) AS name, CAST(version AS VARCHAR) AS version, version % 12 + 10 * hard + 5 * soft AS score, CASE WHEN hard > 0 THEN 'malicious' WHEN soft > 0 AND was = 'clean' THEN 'suspicious' ELSE was END AS verdict,
  version % 2 = 0 OR soft > 0 AS deferring,
  CASE WHEN prev = 'malicious' THEN 'abstained_poisoned_baseline' WHEN n = 0 THEN 'not_attempted' WHEN NOT (n = 5 AND ok) THEN 'abstained_baseline_incomplete' ELSE 'produced' END AS outcome,
  coalesce(array_to_string(list_sort(list_transform(new, lambda c: {_NAMES_SQL})), ','), '') AS introduced FROM e"""


def verdict_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's verdict against that of the customer's next one."""
    k = F.col("version")
    v = F.struct("capabilities", (k % 12).alias("score"), F.when(k % 3 == 0, "clean").otherwise("suspicious").alias("verdict"), "status")
    order = rules.Window.partitionBy("name").orderBy("published_at", "version")
    pairs = order_versions(spark, sf_dir).select("name", "version", v.alias("a"), F.lead(v).over(order).alias("b")).where("b IS NOT NULL")
    out = pairs.withColumns(history.verdict_changes(F.col("a"), F.col("b")))
    return out.select("name", "version", *[F.array_join(F.sort_array(c), ",").alias(c) for c in ("introduced", "removed", "shared")], "stage1_changed", "status_changed", "score_delta")


def order_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of each order (lines are findings) and of the same customer's next one."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("rule_id"), F.element_at(rules.strings(list(fixed.SEVERITY_WEIGHTS)), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("severity"))
    order = rules.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("before_key"), F.lead("o_orderkey").over(order).alias("after_key")).where("after_key IS NOT NULL")
    side = lambda key: pairs.join(lines, F.col(key) == F.col("l_orderkey")).select("before_key", "rule_id", "severity")
    return side("before_key"), side("after_key")


def verdict_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.side_by_side(*order_sides(spark, sf_dir), ["before_key"])


_NAMED = "['info', 'low', 'medium', 'high', 'critical'][CAST({} AS INT) + 1]"
DIFF_SQL = f"""WITH l AS (SELECT l_orderkey, 'R' || CAST(l_linenumber AS VARCHAR) AS rule_id, max(l_suppkey % 5) AS s FROM lineitem GROUP BY ALL),
 p AS (SELECT o_orderkey AS before_key, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after_key FROM orders),
 a AS (SELECT before_key, rule_id, s, 1 AS side FROM p JOIN l ON l_orderkey = before_key WHERE after_key IS NOT NULL),
 b AS (SELECT before_key, rule_id, s, 2 AS side FROM p JOIN l ON l_orderkey = after_key),
 u AS (SELECT before_key, rule_id, max(s) FILTER (side = 1) AS x, max(s) FILTER (side = 2) AS y FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT before_key, rule_id, {_NAMED.format("x")} AS before, {_NAMED.format("y")} AS after,
  CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x <> y THEN 'severity_changed' ELSE 'same' END AS change FROM u"""


# --- second stage, catalog, feed ----------------------------------------------------------------------------------


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of first and second stage that the labels give."""
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL")
    i = F.col("doc_id")
    pick = lambda values, k: F.element_at(rules.strings(values), (k + 1).cast("int"))
    verdict, second = pick(["clean", "suspicious", "malicious"], i % 3), F.when(i % 4 > 0, pick(["clean", "suspicious", "malicious"], i % 5 % 3))
    confidence = ((i % 10) / 10).cast("float")
    m = scoring.merged(verdict, second, confidence, pick(["allow", "warn", "block"], i % 7 % 3))
    return labels.select("doc_id", m.alias("m")).select("doc_id", "m.status", F.round(F.col("m.confidence").cast("double"), 4).alias("confidence"), "m.source")


MERGED_SQL = """WITH i AS (SELECT doc_id, doc_id % 3 AS own, CASE WHEN doc_id % 4 > 0 THEN doc_id % 5 % 3 END AS second, (doc_id % 10) / 10.0 AS c, doc_id % 7 % 3 AS act FROM labels WHERE doc_id IS NOT NULL),
 u AS (SELECT *, second IS NOT NULL AND c >= 0.5 AS ok FROM i)
SELECT doc_id, ['clean', 'warn', 'block'][CAST(CASE WHEN NOT ok THEN own WHEN own = 2 AND act = 0 THEN 1 ELSE greatest(own, act) END + 1 AS INT)] AS status,
  round(CAST(CASE WHEN ok THEN c ELSE [0.9, 0.5, 0.85][CAST(own + 1 AS INT)] END AS DOUBLE), 4) AS confidence, CASE WHEN ok AND NOT (own = 0 AND second = 0) THEN 'stage_merged' ELSE 'stage1' END AS source FROM u"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage2.gate(stage1_verdicts(spark, sf_dir)).select("ecosystem", "name", "version", "score", "verdict")


def gated_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage2.gate(stage1_plain_verdicts(spark, sf_dir)).select("ecosystem", "name", "version", "score", "verdict")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(rules.in_report_order(evaluated(spark, sf_dir)), "findings")  # they are read three times
    s1 = scoring.stage1(found, packages(spark, sf_dir))
    about = stage2.manifest_summary(manifests(spark, sf_dir)), stage2.registry_summary(registry(spark, sf_dir), as_of())
    out = stage2.user_message(stage2.contexts(s1, found, planted.lifecycle(spark, sf_dir), *about))
    return out.select("ecosystem", "name", "version", "approx_chars", "message")


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("call_id"), (F.col("event_id") % 97 + 1).alias("tokens"))
    return stage2.within_budget(calls, 600, 12_000).select("call_id", "hour_tokens", "day_tokens", "admitted")


def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls, a pool for each type; every tenth fails, and the others use a little less or more than estimated."""
    i = F.col("event_id")
    est, worked = i % 97 + 1, i % 10 != 0
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("pool"), "ts", i.alias("call_id"), est.alias("est_in"), F.when(worked, F.greatest(F.lit(0), est + i % 7 - 3)).alias("used_in"), F.when(worked, i % 50).alias("used_out"))
    return stage2.greedy_budget(calls, stage2.Caps(600, 400, 12_000, 6_000, 40))


BUDGET_SQL = """WITH c AS (SELECT ts, event_id AS call_id, event_id % 97 + 1 AS tokens FROM events),
 s AS (SELECT call_id, CAST(sum(tokens) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, call_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hour_tokens,
   CAST(sum(tokens) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, call_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS day_tokens FROM c)
SELECT *, hour_tokens <= 600 AND day_tokens <= 12000 AS admitted FROM s"""


def feed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change lines, back through their JSON form: the last live change of each user, from the feed's beginning."""
    row = F.struct(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("id"), (F.col("event_type") == "error").alias("deleted"))
    lines = table(spark, sf_dir, "events").select(F.to_json(row).alias("value"))
    return feed.pending(feed.changes(lines))


PENDING_SQL = "SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS seq FROM events WHERE event_type <> 'error' GROUP BY user_id"


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog paths by content (SHA-256 form) and by name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2("t", 256))), r"[\r\n]", "")
    name = F.concat(F.lit("@scope/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", catalog.integrity_path(F.lit("sha256"), b64).alias("by_content"), catalog.pointer_path(F.lit("npm"), name, F.lit("1.0.0")).alias("by_name"))


INTEGRITY_SQL = """SELECT doc_id, 'verdicts/by-integrity/sha256/' || substr(sha256(coalesce(text, '')), 1, 2) || '/' || substr(sha256(coalesce(text, '')), 3) || '.json' AS by_content,
  'verdicts/npm/%40scope%2F' || coalesce(CAST(doc_id AS VARCHAR), '') || '/1.0.0.json' AS by_name FROM documents"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as puts: the newest verdict of each user and type stays."""
    puts = table(spark, sf_dir, "events").select(F.lit("npm").alias("ecosystem"), F.col("user_id").alias("name"), F.col("event_type").alias("version"), F.col("ts").alias("analyzed_at"), F.col("event_id").alias("integrity"))
    return catalog.latest(puts).select("name", "version", "integrity")


UPSERTED_SQL = "SELECT user_id AS name, event_type AS version, arg_max(event_id, (ts, event_id)) AS integrity FROM events GROUP BY ALL"


def to_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of whom no supplier has the key, as packages without a verdict."""
    wanted = table(spark, sf_dir, "customer").select(F.lit("npm").alias("ecosystem"), F.col("c_custkey").alias("name"), F.lit("1").alias("version"))
    done = table(spark, sf_dir, "supplier").select(F.lit("npm").alias("ecosystem"), F.col("s_suppkey").alias("name"), F.lit("1").alias("version"))
    return catalog.missing(wanted, done).select("name")


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.lit("npm").alias("ecosystem"), F.col("o_custkey").alias("name"), F.lit("1").alias("version"), "o_orderkey")
    known = table(spark, sf_dir, "supplier").select(F.lit("npm").alias("ecosystem"), F.col("s_suppkey").alias("name"), F.lit("1").alias("version"), F.col("s_nationkey").cast("string").alias("status"))
    return catalog.lookup(known, wanted).select("o_orderkey", "name", "status")


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit(" @s/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("@1."), F.col("p_size").cast("string"))))
    return catalog.specs(table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 == 0, "# note").otherwise(line).alias("value")))


def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a list: some without a version, of which some have a latest one; suppliers have verdicts, customers archives."""
    k, as_text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    package = lambda name: (F.lit("npm").alias("ecosystem"), as_text(name).alias("name"), F.lit("1").alias("version"))
    items = table(spark, sf_dir, "part").select(F.lit("npm").alias("ecosystem"), (k % 1500).cast("string").alias("name"), F.when(k % 3 > 0, "1").alias("version"), k.alias("ordinal"))
    latest_ = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lit("npm").alias("ecosystem"), as_text("c_custkey").alias("name"), F.lit("1").alias("latest"))
    known, there = table(spark, sf_dir, "supplier").select(*package("s_suppkey")), table(spark, sf_dir, "customer").select(*package("c_custkey"))
    return catalog.backfill_counts(catalog.backfill(items, latest_, known, there))


BACKFILL_COUNTS_SQL = """WITH i AS (SELECT p_partkey AS o, p_partkey % 1500 AS name, p_partkey % 3 > 0 OR (p_partkey % 1500) IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS has FROM part),
 d AS (SELECT CASE WHEN NOT has THEN 'missing' WHEN name IN (SELECT s_suppkey FROM supplier) THEN 'already_present' WHEN name NOT IN (SELECT c_custkey FROM customer) THEN 'failed'
   WHEN row_number() OVER (PARTITION BY name, has ORDER BY o) = 1 THEN 'analyzed' ELSE 'already_present' END AS x FROM i)
SELECT count(*) FILTER (x = 'analyzed') AS analyzed, count(*) FILTER (x = 'already_present') AS already_present, count(*) FILTER (x = 'missing') AS missing, count(*) FILTER (x = 'failed') AS failed FROM d"""


def crate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crate's registry document for each customer with orders, which are its versions."""
    time = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    version = F.struct(F.concat(F.lit("1.0."), F.col("o_orderkey").cast("string")).alias("num"), time.alias("created_at"), F.struct(F.concat(F.lit("u"), (F.col("o_orderkey") % 9).cast("string")).alias("login")).alias("published_by"))
    name = F.col("o_custkey").cast("string")
    rows = table(spark, sf_dir, "orders").groupBy(name.alias("name")).agg(F.collect_list(version).alias("versions"), F.min(time).alias("created_at"), F.max("o_orderkey").alias("k"))
    stable = F.when(F.col("k") % 2 == 0, F.concat(F.lit("1.0."), F.col("k").cast("string")))
    crate = F.struct("name", "created_at", stable.alias("max_stable_version"), F.concat(F.lit("2.0.0-"), F.col("k").cast("string")).alias("max_version"))
    return rows.select("name", F.to_json(F.struct(crate.alias("crate"), "versions")).alias("value"))


def crate_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.cargo_registry(crate_documents(spark, sf_dir))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("name", "version", day("published_at").alias("published"), "published_by", day("package_created_at").alias("created"), "total_versions")


CRATES_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS name, '1.0.' || CAST(o_orderkey AS VARCHAR) AS version, strftime(o_orderdate, '%Y-%m-%d') AS published, 'u' || CAST(o_orderkey % 9 AS VARCHAR) AS published_by,
 strftime(min(o_orderdate) OVER (PARTITION BY o_custkey), '%Y-%m-%d') AS created, CAST(count(*) OVER (PARTITION BY o_custkey) AS INT) AS total_versions FROM orders"""


def npm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package document for each supplier: up to four versions, of which the third's time can't be read, and publishers of all but the second."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), (F.col("s_suppkey") % 4 + 1).cast("int").alias("n"))
    numbers = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("1."), i.cast("string")))
    times = F.map_concat(F.create_map(F.lit("created"), F.lit("2020-01-01T00:00:00Z")), F.map_from_arrays(numbers, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i == 3, "some day").otherwise(F.concat(F.lit("2020-02-0"), i.cast("string"), F.lit("T00:00:00Z"))))))
    tags = F.create_map(F.lit("latest"), F.concat(F.lit("1."), F.col("n").cast("string")))
    publisher = lambda v: F.when(v != "1.2", F.struct(F.concat(F.lit("by-"), v, F.lit("-"), "name").alias("name")))
    versions = F.map_from_arrays(numbers, F.transform(numbers, lambda v: F.struct(v.alias("v"), publisher(v).alias("_npmUser"))))
    owners = F.array(F.struct(F.concat(F.lit("m"), F.col("name")).alias("name")))
    return rows.select("name", F.to_json(F.struct("name", tags.alias("dist-tags"), versions.alias("versions"), times.alias("time"), owners.alias("maintainers"))).alias("value"))


def npm_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.npm_registry(npm_documents(spark, sf_dir))
    return rows.select("name", "version", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "published_by", F.date_format("package_created_at", "yyyy-MM-dd").alias("created"), F.array_join("maintainers", ",").alias("maintainers"), "total_versions")


NPM_SQL = """SELECT CAST(s_suppkey AS VARCHAR) AS name, '1.' || CAST(i AS VARCHAR) AS version, CASE WHEN i <> 3 THEN '2020-02-0' || CAST(i AS VARCHAR) END AS published,
 CASE WHEN i <> 2 THEN 'by-1.' || CAST(i AS VARCHAR) || '-' || CAST(s_suppkey AS VARCHAR) END AS published_by, '2020-01-01' AS created, 'm' || CAST(s_suppkey AS VARCHAR) AS maintainers,
 CAST(s_suppkey % 4 + 1 AS INT) AS total_versions FROM supplier, range(1, 5) r(i) WHERE i <= s_suppkey % 4 + 1"""


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest versions that registry documents name: crates of customers, packages of suppliers, PyPI's of parts, NuGet's by the rule."""
    in_eco = lambda df, eco: df.select(F.lit(eco).alias("ecosystem"), "name", "value")
    k = F.col("p_partkey")
    pypi = table(spark, sf_dir, "part").select(k.cast("string").alias("name"), F.when(k % 3 > 0, F.concat(F.lit('{"info":{"version":"'), k.cast("string"), F.lit('"}}'))).otherwise("{}").alias("value"))
    docs = in_eco(crate_documents(spark, sf_dir), "cargo").unionByName(in_eco(npm_documents(spark, sf_dir), "npm")).unionByName(in_eco(pypi, "pypi"))
    o = F.col("o_orderkey")
    listed = table(spark, sf_dir, "orders").select(F.lit("nuget").alias("ecosystem"), F.col("o_custkey").cast("string").alias("name"), F.concat(o.cast("string"), F.when(o % 3 == 0, "-beta").otherwise("")).alias("version"), o.alias("ordinal"))
    return catalog.documented_latest(docs).unionByName(catalog.latest_version(listed))


LATEST_SQL = """SELECT 'cargo' AS ecosystem, CAST(o_custkey AS VARCHAR) AS name, CASE WHEN max(o_orderkey) % 2 = 0 THEN '1.0.' ELSE '2.0.0-' END || CAST(max(o_orderkey) AS VARCHAR) AS latest FROM orders GROUP BY o_custkey
 UNION ALL SELECT 'npm', CAST(s_suppkey AS VARCHAR), '1.' || CAST(s_suppkey % 4 + 1 AS VARCHAR) FROM supplier
 UNION ALL SELECT 'pypi', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) END FROM part
 UNION ALL SELECT 'nuget', CAST(o_custkey AS VARCHAR), coalesce(CAST(max(o_orderkey) FILTER (o_orderkey % 3 <> 0) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR) || '-beta') FROM orders GROUP BY o_custkey"""


def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the files that documents' verdicts make in the catalog, and the names in them."""
    digest = F.regexp_replace(F.base64(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))), r"[\r\n]", "")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    rows = docs.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("@s/p"), F.col("doc_id").cast("string")).alias("name"), F.lit("1").alias("version"), F.struct(F.lit("sha256").alias("algo"), digest.alias("digest_b64")).alias("integrity"), F.lit("clean").alias("status"))
    at = lambda path: F.get_json_object("content", path)
    return catalog.documents(rows).select("path", at("$.artifact.name").alias("name"), F.coalesce(at("$.verdict_path"), F.lit("")).alias("verdict_path"), F.coalesce(at("$.status"), F.lit("")).alias("status"))


CATALOG_SQL = """WITH d AS (SELECT '@s/p' || CAST(doc_id AS VARCHAR) AS name, 'verdicts/npm/%40s%2Fp' || CAST(doc_id AS VARCHAR) || '/1.json' AS own,
  'verdicts/by-integrity/sha256/' || substr(sha256(coalesce(text, '')), 1, 2) || '/' || substr(sha256(coalesce(text, '')), 3) || '.json' AS v FROM documents WHERE doc_id IS NOT NULL)
SELECT v AS path, name, '' AS verdict_path, 'clean' AS status FROM d UNION ALL SELECT own, name, v, '' FROM d"""


# --- archives -----------------------------------------------------------------------------------------------------


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages_source.entries(packages_source.unpack(planted.archives(spark, sf_dir)))


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_files(spark, sf_dir).select("ecosystem", "source", "path", "kind", F.when(F.col("path").isin(*planted.CODE_FILES), F.sha2("text", 256)).alias("text_sha256"))


FILES_OUT_SQL = f"SELECT ecosystem, CAST(i AS VARCHAR) AS source, path, kind, CASE WHEN code THEN sha256(text) END AS text_sha256 FROM ({planted.FILES_SQL})"


def unpacked_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives' files by the table function."""
    packages_source.register(spark)
    planted.archives(spark, sf_dir).createOrReplaceTempView("planted_archives")
    return spark.sql("SELECT a.ecosystem, a.source, f.ordinal, f.path, f.size FROM planted_archives a, LATERAL unpack(a.ecosystem, a.source, a.content) f")


UNPACKED_SQL = f"""SELECT ecosystem, CAST(i AS VARCHAR) AS source, CAST(row_number() OVER (PARTITION BY i ORDER BY n) - 1 AS INT) AS ordinal, path, size FROM (SELECT i, ecosystem, path,
  CASE path WHEN 'package.json' THEN strlen('{{"name": "pkg-' || CAST(i AS VARCHAR) || '", "version": "1.0.0", "scripts": {{"postinstall": "echo ' || CAST(i AS VARCHAR) || '", "test": "x"}}}}')
   WHEN 'Cargo.toml' THEN strlen('[package]' || chr(10) || 'name = "pkg-' || CAST(i AS VARCHAR) || '"' || chr(10) || 'version = "1.0.0"' || chr(10)) WHEN 'build.rs' THEN 12
   WHEN 'PKG-INFO' THEN strlen('Name: pkg-' || CAST(i AS VARCHAR) || chr(10) || 'Version: 1.0.0' || chr(10) || chr(10))
   WHEN 'x.nuspec' THEN strlen('<package><metadata><id>pkg-' || CAST(i AS VARCHAR) || '</id><version>1.0.0</version></metadata></package>') ELSE strlen(text) END AS size,
  list_position(['package.json', 'index.js', 'Cargo.toml', 'src/lib.rs', 'build.rs', 'PKG-INFO', 'x.nuspec', 'setup.py', 'tools/install.ps1'], path) AS n FROM ({planted.FILES_SQL}))"""


def package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages_source.manifests(archive_files(spark, sf_dir)).select("ecosystem", "source", "name", "version", "scan_error")


MANIFESTS_SQL = f"""SELECT DISTINCT ecosystem, CAST(i AS VARCHAR) AS source, CASE WHEN NOT bare THEN 'pkg-' || CAST(i AS VARCHAR) END AS name, CASE WHEN NOT bare THEN '1.0.' || CAST(i % 7 AS VARCHAR) END AS version,
 CASE WHEN bare AND ecosystem <> 'pypi' THEN 'no manifest' END AS scan_error FROM (SELECT *, i % {planted.BARE} = 0 AS bare FROM ({planted.FILES_SQL}))"""


def package_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    unpacked = stored(packages_source.hook_files(packages_source.unpack(planted.archives(spark, sf_dir))), "hook_files")
    files = packages_source.entries(unpacked)
    out = packages_source.lifecycle(files, stored(packages_source.manifests(files), "manifests"))
    return out.select("ecosystem", "source", "hook", "kind", F.sha2("body", 256).alias("body_sha256"), F.coalesce("path", F.lit("")).alias("path"))


HOOKS_SQL = f"""SELECT ecosystem, CAST(i AS VARCHAR) AS source, CASE ecosystem WHEN 'npm' THEN 'postinstall' WHEN 'cargo' THEN 'build' ELSE path END AS hook, 'install_time' AS kind,
 sha256(CASE ecosystem WHEN 'npm' THEN 'echo ' || CAST(i AS VARCHAR) WHEN 'cargo' THEN 'fn main() {{}}' ELSE text END) AS body_sha256, CASE ecosystem WHEN 'npm' THEN '' ELSE path END AS path
 FROM ({planted.FILES_SQL}) WHERE path IN ('package.json', 'build.rs', 'setup.py', 'tools/install.ps1') AND (path <> 'build.rs' OR i % {planted.BARE} <> 0)"""


BACKFILL_SQL = "SELECT 'npm' AS ecosystem, '@s/' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 3 <> 0 THEN '1.' || CAST(p_size AS VARCHAR) END AS version FROM part WHERE p_partkey % 5 <> 0"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"rule_{r.id.lower()}": one_rule(r) for r in TEXT_RULES}
ORACLES: dict[str, str] = {f"rule_{r.id.lower()}": _with_units(rule_sql(r)) for r in PLAIN}
ORACLES |= {f"rule_{rule.lower()}": sql for rule, sql in CODE_ONLY_SQL.items()}
_MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "stage1_verdicts": (stage1_verdicts, VERDICTS_SQL),
    "stage1_plain_verdicts": (stage1_plain_verdicts, STAGE1_SQL),
    "all_findings": (all_findings, ALL_SQL),
    "rule_presence": (presence, PRESENCE_SQL),
    "rule_npm005_blob_near_execution": (blobs, BLOBS_SQL),
    "rule_npm009_native_binaries": (native_binaries, NATIVE_SQL),
    "rule_npm012_bundled": (bundled, BUNDLED_SQL),
    "rule_npm014_lookalikes": (lookalikes, LOOKALIKES_SQL),
    "rule_npm016_recency": (recency, RECENCY_SQL),
    "rule_npm021_unlisted_files": (unlisted, UNLISTED_SQL),
    "rule_npm022_hidden_unicode": (unicode_tricks, UNICODE_SQL),
    "rule_npm028_time_bombs": (time_bombs, TIME_SQL),
    "rule_npm046_setuid": (setuid, SETUID_SQL),
    "rule_npm050_minified": (minified, MINIFIED_SQL),
    "rule_cargo003_macros": (macros, MACROS_SQL),
    "rule_nuget003_tool_libraries": (tool_libraries, TOOLS_SQL),
    "capability_diff_strict": (diff_strict, STRICT_SQL),
    "capability_diff_parity": (diff_parity, PARITY_SQL),
    "verdict_diff": (verdict_diff, DIFF_SQL),
    "stage2_gate": (gated, f"SELECT ecosystem, name, version, score, verdict FROM ({VERDICTS_SQL}) WHERE verdict = 'suspicious' OR deferring"),
    "stage2_gate_plain": (gated_plain, f"SELECT ecosystem, name, version, score, verdict FROM ({STAGE1_SQL}) WHERE verdict = 'suspicious' OR deferring"),
    "stage2_messages": (messages, None),
    "stage2_merge": (merged, MERGED_SQL),
    "stage2_budget": (budget, BUDGET_SQL),
    "stage2_budget_greedy": (greedy_budget, None),
    "feed_pending": (feed_pending, PENDING_SQL),
    "catalog_paths": (integrity, INTEGRITY_SQL),
    "catalog_upsert": (upserted, UPSERTED_SQL),
    "catalog_missing": (to_analyze, "SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"),
    "catalog_lookup": (lookups, "SELECT o_orderkey, o_custkey AS name, CAST(s_nationkey AS VARCHAR) AS status FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey"),
    "backfill_specs": (backfill, BACKFILL_SQL),
    "backfill_counts": (backfill_counts, BACKFILL_COUNTS_SQL),
    "capability_diff_applied": (diff_applied, APPLIED_SQL),
    "verdict_changes": (verdict_changes, CHANGES_SQL),
    "registry_cargo": (crate_registry, CRATES_SQL),
    "registry_npm": (npm_registry, NPM_SQL),
    "latest_versions": (latest_versions, LATEST_SQL),
    "catalog_documents": (catalog_documents, CATALOG_SQL),
    "package_files": (package_files, FILES_OUT_SQL),
    "package_unpacked_by_sql": (unpacked_by_sql, UNPACKED_SQL),
    "package_manifests": (package_manifests, MANIFESTS_SQL),
    "package_hooks": (package_hooks, HOOKS_SQL),
}
QUERIES |= {name: query for name, (query, _) in _MORE.items()}
ORACLES |= {name: sql for name, (_, sql) in _MORE.items() if sql}
