"""Inventories, suggestions, overrides, mappings, caches, texts and logs made of the driver's tables.

Each view has its DuckDB text beside it, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.suggestions import AI

SIGNATURE = "sig-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders as methods, customers as classes; flags of lines are tags.
METHODS_SQL = """
orders_ AS (
    SELECT o_orderkey AS k, o_custkey AS c, min(o_orderpriority) AS pr, count(*) AS n,
           list_sort(list_distinct(list(CASE l_returnflag WHEN 'A' THEN 'security' WHEN 'N' THEN 'crypto' ELSE 'logging' END))) AS flags
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
), methods AS (
    SELECT k AS seq, 'cust.C' || c AS fqcn, 'o' || k AS method, CAST(n AS INTEGER) AS loc, CASE WHEN k % 11 = 0 THEN [] ELSE flags END AS tags,
           CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN '' ELSE pr END AS display_name,
           CASE WHEN k % 13 <> 0 THEN sha256('h' || k) END AS content_hash,
           CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS rel, CAST(k % 101 AS DOUBLE) / 100 AS conf, CAST(c % 11 AS DOUBLE) / 10 AS inter,
           CASE WHEN k % 3 = 2 THEN NULL WHEN k % 3 = 1 THEN [] WHEN k % 2 = 0 THEN ['auth', 'security'] ELSE ['security'] END AS ai_tags,
           CASE WHEN k % 3 <> 2 THEN 'name ' || k END AS ai_name, CASE WHEN k % 5 = 0 THEN 'because ' || k WHEN k % 5 = 1 THEN 'ends.' END AS reason,
           CAST(k % 90 AS INTEGER) AS begin_line, 'src/C' || c || '.java' AS file_path
    FROM orders_
)"""


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.expr("CASE l_returnflag WHEN 'A' THEN 'security' WHEN 'N' THEN 'crypto' ELSE 'logging' END")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    # lines are aggregated by order before they meet the orders
    by_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(flag)).alias("flags"))
    base = orders.join(by_order, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("pr"), "n", "flags")
    rows = base.select(
        F.col("k").alias("seq"), F.expr("'cust.C' || c").alias("fqcn"), F.expr("'o' || k").alias("method"), F.col("n").cast("int").alias("loc"),
        F.expr("CASE WHEN k % 11 = 0 THEN array() ELSE flags END").alias("tags"), F.expr("CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN '' ELSE pr END").alias("display_name"),
        F.expr("CASE WHEN k % 13 <> 0 THEN sha2('h' || k, 256) END").alias("content_hash"),
        F.expr("CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("rel"), F.expr("CAST(k % 101 AS DOUBLE) / 100").alias("conf"), F.expr("CAST(c % 11 AS DOUBLE) / 10").alias("inter"),
        F.expr("CASE WHEN k % 3 = 2 THEN NULL WHEN k % 3 = 1 THEN array() WHEN k % 2 = 0 THEN array('auth', 'security') ELSE array('security') END").alias("ai_tags"),
        F.expr("CASE WHEN k % 3 <> 2 THEN 'name ' || k END").alias("ai_name"), F.expr("CASE WHEN k % 5 = 0 THEN 'because ' || k WHEN k % 5 = 1 THEN 'ends.' END").alias("reason"),
        F.expr("CAST(k % 90 AS INT)").alias("begin_line"), F.expr("'src/C' || c || '.java'").alias("file_path"),
    )
    ai = F.when(F.col("rel").isNotNull(), F.struct(F.col("rel"), F.col("ai_name"), F.col("ai_tags"), F.col("reason"), F.col("conf"), F.col("inter")).cast(AI))
    return rows.withColumn("ai", ai)


#: Two inventories: the later one lacks, adds and changes methods.
SCANS_SQL = METHODS_SQL + """, drifted AS (
    SELECT *, list_contains(tags, 'security') AS tagged FROM methods
), scan_before AS (
    SELECT seq, fqcn, method, loc, tags, display_name, content_hash, rel AS ai_security_relevant, ai_tags, CASE WHEN rel IS NOT NULL THEN inter END AS ai_interaction_score,
           CASE WHEN rel IS NOT NULL THEN CASE WHEN tagged = rel THEN 'none' WHEN tagged THEN 'tag-only' ELSE 'ai-only' END END AS tag_ai_drift
    FROM drifted WHERE seq % 19 <> 1
), scan_after AS (
    SELECT seq, fqcn, method, CASE WHEN seq % 5 = 0 THEN loc + 1 ELSE loc END AS loc, CASE WHEN seq % 37 = 0 THEN ['new'] ELSE tags END AS tags,
           CASE WHEN seq % 7 = 0 THEN '' WHEN seq % 23 = 0 THEN display_name || '!' ELSE display_name END AS display_name,
           CASE WHEN seq % 29 = 0 THEN sha256('x' || seq) ELSE content_hash END AS content_hash,
           CASE WHEN seq % 31 = 0 THEN true ELSE rel END AS ai_security_relevant, ai_tags,
           CASE WHEN rel IS NOT NULL THEN CASE WHEN seq % 41 = 0 THEN 0.05 ELSE inter END END AS ai_interaction_score,
           CASE WHEN rel IS NOT NULL THEN CASE WHEN tagged = rel THEN 'none' WHEN tagged THEN 'tag-only' ELSE 'ai-only' END END AS tag_ai_drift
    FROM drifted WHERE seq % 17 <> 0
)"""


def scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = methods(spark, sf_dir).withColumn("tagged", F.array_contains("tags", "security"))
    drift = F.expr("CASE WHEN rel IS NOT NULL THEN CASE WHEN tagged = rel THEN 'none' WHEN tagged THEN 'tag-only' ELSE 'ai-only' END END").alias("tag_ai_drift")
    before = d.where("seq % 19 <> 1").select("seq", "fqcn", "method", "loc", "tags", "display_name", "content_hash", F.col("rel").alias("ai_security_relevant"), "ai_tags", F.expr("CASE WHEN rel IS NOT NULL THEN inter END").alias("ai_interaction_score"), drift)
    after = d.where("seq % 17 <> 0").select(
        "seq", "fqcn", "method", F.expr("CASE WHEN seq % 5 = 0 THEN loc + 1 ELSE loc END").alias("loc"), F.expr("CASE WHEN seq % 37 = 0 THEN array('new') ELSE tags END").alias("tags"),
        F.expr("CASE WHEN seq % 7 = 0 THEN '' WHEN seq % 23 = 0 THEN display_name || '!' ELSE display_name END").alias("display_name"),
        F.expr("CASE WHEN seq % 29 = 0 THEN sha2('x' || seq, 256) ELSE content_hash END").alias("content_hash"), F.expr("CASE WHEN seq % 31 = 0 THEN true ELSE rel END").alias("ai_security_relevant"), "ai_tags",
        F.expr("CASE WHEN rel IS NOT NULL THEN CASE WHEN seq % 41 = 0 THEN 0.05D ELSE inter END END").alias("ai_interaction_score"), drift,
    )
    return before, after


#: Overrides: some of methods, some of classes, some twice.
OVERRIDES_SQL = """overrides AS (
    SELECT CAST(o_orderkey AS INTEGER) AS pos, 'cust.C' || o_custkey AS fqcn, 'o' || o_orderkey AS method, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 2 THEN false END AS security_relevant,
           CASE WHEN o_orderkey % 3 = 0 THEN ['crypto'] END AS tags, CASE WHEN o_orderkey % 5 = 0 THEN 'reviewed' END AS display_name, CAST(NULL AS VARCHAR) AS reason
    FROM orders WHERE o_orderpriority LIKE '1%'
    UNION ALL
    SELECT CAST(10000000 + c_custkey AS INTEGER), 'cust.C' || c_custkey, NULL, c_custkey % 2 = 0, NULL, NULL, 'class ' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL
    SELECT CAST(20000000 + c_custkey AS INTEGER), 'cust.C' || c_custkey, NULL, NULL, ['auth'], NULL, 'again' FROM customer WHERE c_acctbal < 0
)"""


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a = o.where("o_orderpriority LIKE '1%'").selectExpr("CAST(o_orderkey AS INT) AS pos", "'cust.C' || o_custkey AS fqcn", "'o' || o_orderkey AS method", "CASE o_orderkey % 4 WHEN 0 THEN true WHEN 2 THEN false END AS security_relevant", "CASE WHEN o_orderkey % 3 = 0 THEN array('crypto') END AS tags", "CASE WHEN o_orderkey % 5 = 0 THEN 'reviewed' END AS display_name", "CAST(NULL AS STRING) AS reason")
    b = c.where("c_mktsegment = 'BUILDING'").selectExpr("CAST(10000000 + c_custkey AS INT)", "'cust.C' || c_custkey", "CAST(NULL AS STRING)", "c_custkey % 2 = 0", "CAST(NULL AS ARRAY<STRING>)", "CAST(NULL AS STRING)", "'class ' || c_custkey")
    d = c.where("c_acctbal < 0").selectExpr("CAST(20000000 + c_custkey AS INT)", "'cust.C' || c_custkey", "CAST(NULL AS STRING)", "CAST(NULL AS BOOLEAN)", "array('auth')", "CAST(NULL AS STRING)", "'again'")
    return a.union(b).union(d)


#: Tags to controls: brands of parts are controls, their sizes make tags; logging is not mapped.
FRAMEWORK = "asvs"
MAPPING_SQL = """mapping AS (
    SELECT CASE p_size % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'crypto' WHEN 2 THEN 'auth' ELSE 'unused' END AS tag, CAST(p_size % 4 AS INTEGER) AS tag_pos, CAST(min(p_partkey) AS INTEGER) AS pos,
           CASE WHEN p_size % 4 = 3 THEN 'u' ELSE '' END || p_brand AS control_id, max(CASE WHEN p_size % 4 = 1 THEN p_brand END) AS chapter, CASE WHEN p_size % 4 > 0 THEN 'title ' || (p_size % 4) END AS chapter_title
    FROM part GROUP BY p_size % 4, p_brand
)"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tag = "CASE size WHEN 0 THEN 'security' WHEN 1 THEN 'crypto' WHEN 2 THEN 'auth' ELSE 'unused' END"
    few = p.groupBy(F.expr("p_size % 4").alias("size"), "p_brand").agg(F.min("p_partkey").alias("first"))
    return few.selectExpr(f"{tag} AS tag", "CAST(size AS INT) AS tag_pos", "CAST(first AS INT) AS pos", "CASE WHEN size = 3 THEN 'u' ELSE '' END || p_brand AS control_id", "CASE WHEN size = 1 THEN p_brand END AS chapter", "CASE WHEN size > 0 THEN 'title ' || size END AS chapter_title")


#: Documents as classes, labels as cached answers: some old ones without a signature, some stale.
CLASSES_SQL = """classes AS (
    SELECT doc_id, source || '.Doc' || doc_id AS fqcn, text, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL
), cache AS (
    SELECT l.doc_id AS seq, sha256(d.text) AS content_hash, CASE l.doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'sig-1' ELSE 'sig-0' END AS prompt_signature,
           'answer ' || l.doc_id || ' ' || l.quality AS suggestion, CASE WHEN l.toxic = 1 THEN 'secrets ' || l.doc_id END AS secrets
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL
), last_cache AS (
    SELECT content_hash, arg_max(prompt_signature, seq, 1) AS dummy, max(seq) AS seq FROM cache GROUP BY content_hash
), newest AS (
    SELECT c.* FROM cache c JOIN last_cache l ON c.content_hash = l.content_hash AND c.seq = l.seq
)"""
CLASSES_SQL = CLASSES_SQL.replace("arg_max(prompt_signature, seq, 1) AS dummy, ", "")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.selectExpr("doc_id", "source || '.Doc' || doc_id AS fqcn", "text", "lang", "sha2(text, 256) AS content_hash")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", "sha2(text, 256) AS content_hash")
    both = table(spark, sf_dir, "labels").join(d, "doc_id")
    return both.selectExpr("doc_id AS seq", "content_hash", "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'sig-1' ELSE 'sig-0' END AS prompt_signature", "'answer ' || doc_id || ' ' || quality AS suggestion", "CASE WHEN toxic = 1 THEN 'secrets ' || doc_id END AS secrets")
