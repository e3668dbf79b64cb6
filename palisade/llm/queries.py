"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import byte_bpe, cover_search, divergence, filter_audit, jaccard_join, license_scan, mixing, quality, secrets_ledger, sharding, token_counts, toxicity, url_filters
from palisade.llm.common import shared_dir, table, text_or_empty, written

#: Parameters of the queries.
SHARDS = [f"shard-{i:02d}" for i in range(64)]
SPAM_LABELS = ["spam-farm", "cheap-pills"]
#: All host families of the pages tables that are taken as bad ones, by their names.
BAD_FAMILIES = [*SPAM_LABELS, "casino-win", "free-bets", "ads-track", "adult-x"]
#: One in so many pages, by its id, has been reported; its canonical URL is listed, whatever its host.
REPORTED = 32
TOKEN_LIMIT = 512


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.add_scores(docs, model)
    return out.select("doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.add_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trip = byte_bpe.round_trip(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = docs.select("doc_id", trip(F.col("text")).alias("x"))
    return out.select(
        "doc_id",
        F.size("x.ids").cast("long").alias("n_tokens"),
        byte_bpe.ids_digest(F.col("x.ids")).alias("ids_sha256"),
        F.sha2("x.decoded", 256).alias("decoded_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, "doc_id", SHARDS)


def listed_urls(pages: DataFrame, labels: list[str] = SPAM_LABELS) -> DataFrame:
    """Every canonical URL seen on hosts with one of the labels."""
    parts = url_filters.with_parts(pages.select("url"))
    spam = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels)))
    return parts.where(spam).select(url_filters.canonical(F.col("host"), F.col("path")).alias("canon"))


def reported_urls(pages: DataFrame) -> DataFrame:
    """The canonical URLs of the reported pages. Other pages with one of them are hits of the list alone: nothing in their rows tells."""
    parts = url_filters.with_parts(pages.where(F.col("page_id") % REPORTED == 0).select("url")).where("host <> ''")
    return parts.select(url_filters.canonical(F.col("host"), F.col("path")).alias("canon"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: all URLs of the bad families, and those of reported pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = listed_urls(pages, BAD_FAMILIES).unionByName(reported_urls(pages))
    return url_filters.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op5_url_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_url_filters with the list of all bad families."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, listed_urls(pages, BAD_FAMILIES)).select("page_id", "host", "path", "rule", "verdict")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = quality.add_votes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    voted = written(voted.select("doc_id", *quality.BASE, "base_failed", "votes"), "votes")
    return quality.judged(voted).select("doc_id", *quality.BASE, "base_failed", "kept")


def ledger(spark: SparkSession) -> str | None:
    """Folder of a ledger that scans share, if the session names one in spark.palisade.secretLedger; else each scan starts afresh."""
    return spark.conf.get("spark.palisade.secretLedger", None)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = secrets_ledger.scan_with(docs, folder) if (folder := ledger(spark)) else secrets_ledger.scan(docs)[0]
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["ord"] < 3)
    return docs.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(secrets_ledger.joined(base), 256).alias("base_sha256"),
        secrets_ledger.joined(F.col("spans")).alias("spans"),
    )


def op9_secret_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with one ledger: of the documents, then of a version in which every second text, by its length, has a line more.

    Of the second: each document's spans, and whether its text had to be scanned.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/palisade-ledger-{uuid.uuid4().hex}"
    secrets_ledger.scan_with(docs, folder)
    longer = F.when(F.length(text_or_empty("text")) % 2 == 0, F.concat(text_or_empty("text"), F.lit("\ntoken = abcdefghijkl0123"))).otherwise(F.col("text"))
    out, new = secrets_ledger.scan(docs.withColumn("text", longer), ledger=secrets_ledger.read_ledger(spark, folder))
    scanned = F.coalesce("scanned", F.lit(False)).alias("scanned")
    return out.join(new.select("blob", F.lit(True).alias("scanned")), "blob", "left").select("doc_id", scanned, secrets_ledger.joined(F.col("spans")).alias("spans"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.near_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda x: x["phrase"])
    out = out.withColumn("base", F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["label"].alias("label"))))
    return out.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["start"].alias("first_word"),
        F.get("base", F.size("base") - 1)["start"].alias("last_word"),
        license_scan.labels_of(F.col("base")).alias("base_labels"),
        license_scan.labels_of(F.col("places")).alias("labels"),
        "score",
    )


def _shard_sql() -> str:
    listed = ",".join(map(str, sharding.filled(SHARDS)))
    return f"""
WITH slots AS (SELECT doc_id, source, n_chars,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents),
 filled AS (SELECT [{listed}] AS t)
SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(CAST(t[slot + 1] AS VARCHAR), 2, '0') AS shard FROM slots, filled"""


_HOST = r"translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FAMILIES_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 b AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM a),
 c AS (SELECT *, regexp_replace(regexp_replace(host, ':\d*\z', ''), '\A(www|m)\.', '')
        || regexp_replace(regexp_replace(path, '(/index)?\.html?\z', ''), '/+\z', '') AS canon,
    CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM b),
 listed AS (SELECT DISTINCT canon FROM c WHERE list_has_any(string_split(host, '.'), {BAD_FAMILIES}))
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
         WHEN host <> '' AND canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM c"""

URL_SQL = FAMILIES_SQL.replace(f"{BAD_FAMILIES})", f"{BAD_FAMILIES}) OR host <> '' AND page_id % {REPORTED} = 0")

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
 s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
 v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
 n AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM n JOIN v USING (lang)),
 l AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY lang, term),
 q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
 s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""

AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 f AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
 m AS (SELECT t.doc_id, part,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(w) < 200 WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
        WHEN 'C' THEN 100 * len(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * len(t.text) WHEN 'D' THEN regexp_matches(t.text, '[#$%&*|]')
        ELSE coalesce(t.doc_id > first, false) END) AS fails FROM t JOIN f ON f.text = t.text),
 y AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
 c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN y ON y.doc_id = m.doc_id GROUP BY part, fails),
 e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, step, filter_order[step] AS x, string_split(filter_order[1:step - 1], '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
 z AS (SELECT part, filter_order, step, n, good, toxic, list_contains(fails, x) AS failing, list_has_any(fails, before) AS gone, len(fails) AS k FROM c, s)
SELECT part, filter_order, CAST(step AS INT) AS step,
    CAST(sum(CASE WHEN gone OR failing THEN 0 ELSE n END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failing AND k = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(CASE WHEN failing THEN n * 120 // k ELSE 0 END) AS BIGINT) AS shapley
FROM z GROUP BY part, filter_order, step"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_sharding": op4_sharding,
    "op5_url_filters": op5_url_filters,
    "op5_url_families": op5_url_families,
    "op6_top_k": op6_top_k,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_secret_scan": op9_secret_scan,
    "op9_secret_rescan": op9_secret_rescan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_filter_audit": op12_filter_audit,
    "op13_license_scan": op13_license_scan,
}


def oracles() -> dict[str, str]:
    return {"op4_sharding": _shard_sql(), "op5_url_filters": URL_SQL, "op5_url_families": FAMILIES_SQL, "op6_top_k": TOP_K_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_filter_audit": AUDIT_SQL}
