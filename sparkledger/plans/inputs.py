"""Queries of scanners, readers, sinks and settings: sources and files are made of the driver's tables, and read back.

Each has its DuckDB text, which names the rows without making any file.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records
from ..sinks import documents, lines, patch
from ..sources import scanners, tables
from . import scan
from . import views as V
from .queries import DRIFT_SQL, M, NUM, S, j, query


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and the tasks share: below the checkpoint folder where one is set."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/inputs-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="inputs-") + "/x"


# --- sources: customers are files, their orders are tests


@dataclass(frozen=True)
class Shape:
    """A file's text around its tests, with {c} for the customer and {k} for the order, and what a scanner finds in it as SQL over c, k and t.

    lines: of the head, of a test, and of a test before and up to its last line. declare: a line for each test in the head, after which middle follows.
    """

    path: str
    head: str
    test: str
    foot: str
    begin: int
    end: int
    fqcn: str
    method: str
    tags: str = "''"
    display_name: str = "CAST(NULL AS VARCHAR)"
    declare: str = ""
    middle: str = ""

    def texts(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """(path, content) of a file for each customer who ordered."""
        o = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
        filled = lambda s, c, k=None: _filled(s, c, k)
        c = F.col("c").cast("string")
        every = lambda s: F.array_join(F.transform("ks", lambda k: filled(s, c, k.cast("string"))), "")
        content = F.concat(filled(self.head, c), every(self.declare) if self.declare else F.lit(""), filled(self.middle, c), every(self.test), filled(self.foot, c))
        return o.select(filled(self.path, c).alias("path"), content.alias("content"))

    def sql(self) -> str:
        head, test = (self.head + self.middle).count("\n"), self.test.count("\n")
        first = f"{head} + {'n' if self.declare else '0'} + (i - 1) * {test}"
        return f"""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS n FROM orders)
            SELECT {self.fqcn} AS fqcn, {self.method} AS method, CAST({first} + {self.begin + 1} AS INTEGER) AS begin_line, CAST({first} + {self.end + 1} AS INTEGER) AS end_line, {self.end - self.begin + 1} AS loc, {self.tags} AS tags, {self.display_name} AS display_name FROM o"""


def _filled(s: str, c, k=None):
    out = F.replace(F.lit(s), F.lit("{c}"), c)
    return out if k is None else F.replace(F.replace(out, F.lit("{k}"), k), F.lit("{t}"), (k.cast("long") % 3).cast("string"))


TAG = "'t' || (k % 3)"
SHAPES = {
    "scan_java": Shape("/r/cust/C{c}Test.java", "package cust;\nimport org.junit.jupiter.api.*;\nclass C{c}Test {\n", '  // @Test void no() {}\n  @Test\n  @Tag("t{t}") @DisplayName("\\"d{k}\\"")\n  void o{k}() {\n    call("}");\n  }\n', "}\n", 1, 5, "'cust.C' || c || 'Test'", "'o' || k", TAG, "'\"d' || k || '\"'"),
    "scan_csharp": Shape("/r/C{c}.cs", "using Xunit;\nnamespace Cust;\npublic class C{c} {\n", '  [Fact(DisplayName = "d{k}")]\n  [Trait("Category", "t{t}"), Trait("Owner", "x")]\n  public void O{k}() {\n    Call("}");\n  }\n', "}\n", 0, 4, "'Cust.C' || c", "'O' || k", TAG, "'d' || k"),
    "scan_typescript": Shape("/r/src/c{c}.test.ts", "describe('C{c}', () => {\n", "  it('o{k}', () => {\n    expect(\"})\").toBe(1);\n  });\n", "});\n", 0, 2, "'c' || c || '.test'", "'C' || c || ' > o' || k"),
    "scan_go": Shape("/r/c{c}_test.go", "package c{c}\n\n", 'func TestO{k}(t *testing.T) {\n\tx := "}"\n}\nfunc Test1{k}(t *testing.T) {}\n', "", 0, 2, "'c' || c", "'TestO' || k"),
    "scan_python": Shape("/r/pkg/c{c}_test.py", "import pytest\n\n", "@pytest.mark.t{t}\ndef test_o{k}():\n    pass\n\ndef helper(): pass\n", "", 1, 2, "'pkg.c' || c || '_test'", "'test_o' || k", TAG),
    "scan_powershell": Shape("/r/C{c}.Tests.ps1", 'Describe "C{c}" -Tag "all" {\n', '  # It "no" {}\n  It "o{k}" -Tag "t{t}" {\n    $x = "}"\n  }\n', "}\n", 1, 3, "'C' || c", "'o' || k", TAG),
    "scan_abap": Shape("/r/c{c}.abap", "CLASS lcl_c{c} DEFINITION FOR TESTING.\n  PRIVATE SECTION.\n", "  METHOD o{k}.\n    x = 'METHOD two.'.\n  ENDMETHOD.\n", "ENDCLASS.\n", 0, 2, "'LCL_C' || c", "'O' || k", declare="    METHODS o{k} FOR TESTING.\n", middle="ENDCLASS.\nCLASS lcl_c{c} IMPLEMENTATION.\n"),
    "scan_ecatt": Shape("/r/c{c}.ecl", "ATTRIBUTES\n\n", "FUNCTION Z_{k}\n  DO\n\n", "", 0, 1, "'Z_' || k", "'Z_' || k"),
    "scan_cobol": Shape("/r/c{c}.cbl", "       PROCEDURE DIVISION.\n", "       MFU-TC-o{k}.\n           STOP RUN.\n", "", 0, 1, "'c' || c", "'MFU-TC-O' || k"),
}


def _scanned(shape: Shape):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scanners.scan_tree(shape.texts(spark, sf_dir), "/r").where("method IS NOT NULL")
        return found.select("fqcn", "method", "begin_line", "end_line", "loc", j("tags").alias("tags"), "display_name")

    return run


for _name, _shape in SHAPES.items():
    query(_shape.sql(), _name)(_scanned(_shape))
JAVA = SHAPES["scan_java"]


@query("""WITH o AS (SELECT DISTINCT o_custkey AS c FROM orders) SELECT 'cust.C' || c || 'Test' AS fqcn, true AS own FROM o""")
def scan_class_digest(spark, d):
    """The digest of a Java class leaves out what lies beside it: the same with and without another class in the file."""
    files = JAVA.texts(spark, d)
    more = files.withColumn("content", F.concat("content", F.lit("/* x */ class Other { @Test void z() { } }\n")))
    a, b = (scanners.class_sources(scanners.scan_tree(f, "/r"), f).where("fqcn <> 'cust.Other'").select("fqcn", F.col("content_hash").alias(n)) for f, n in ((files, "a"), (more, "b")))
    return a.join(b, "fqcn").select("fqcn", (F.col("a") == F.col("b")).alias("own"))


NAMES = ("test_{c}.py", "{c}_test.py", "{c}test.py", "T{c}.java", "t{c}.spec.tsx", "t{c}.ts", "{c}_test.go", "{c}.Tests.ps1", "{c}.cut", "{c}.cs")
OF_NAME = ("python", "python", None, "java", "typescript", None, "go", "powershell", "cobol", "dotnet")


@query("WITH n AS (SELECT c_custkey AS c, unnest(range(10)) AS i FROM customer) SELECT c, CAST(i AS INTEGER) AS i, ([" + ", ".join(f"'{p}'" if p else "NULL" for p in OF_NAME) + "])[i + 1] AS plugin FROM n")
def suffix_route(spark, d):
    names = V.table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.posexplode(F.array(*[_filled(n, F.col("c_custkey").cast("string")) for n in NAMES])).alias("i", "name"))
    route = F.udf(lambda n: scanners.plugin_of(n), "string")
    return names.select("c", "i", route("name").alias("plugin"))


@query("WITH n AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 3 <> 0) SELECT c FROM n")
def scan_python_files(spark, d):
    """Files by their names: test_*.py and *_test.py."""
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'x' || c_custkey || '.py' WHEN 1 THEN 'test_' || c_custkey || '.py' ELSE c_custkey || '_test.py' END")
    files = V.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("/r/"), name).alias("path"), F.concat(F.lit("def test_c"), "c_custkey", F.lit("(): pass\n")).alias("content"))
    return scanners.scan_tree(files, "/r").select(F.regexp_extract("method", r"(\d+)$", 1).cast("long").alias("c"))


@query("SELECT c_custkey AS c, 'text ' || c_custkey AS content FROM customer WHERE c_custkey % 10 = 0")
def scan_files(spark, d):
    """Regular files below a root by suffix, in folders of any depth."""
    root = folder(spark)
    c = V.table(spark, d, "customer").where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("text "), "c_custkey").alias("value"), F.expr("c_custkey % 10").alias("deep"))
    # files of the written table stand for a tree: one folder for each key, and only one kind of them is wanted
    c.select("value", "deep").repartition(1, "deep").write.partitionBy("deep").text(root)
    found = tables.read_files(spark, root, [".txt"]).where(F.contains("path", F.lit("/deep=0/")))
    rows = found.select(F.explode(F.split(F.rtrim(F.regexp_replace("content", "\n$", "")), "\n")).alias("content"))
    return rows.select(F.regexp_extract("content", r"(\d+)$", 1).cast("long").alias("c"), "content")


# --- inventories and other inputs


def saved(spark, d) -> str:
    """An inventory of the methods, written as a file of CSV lines."""
    path = folder(spark)
    lines.write_csv(V.methods(spark, d).withColumn("source_root", F.lit("r/")), path, metadata={"scan_timestamp": "2026-01-02"}, source_root=True, content_hash=True, ai=True, confidence=True, drift=True)
    return path


INVENTORY_SQL = f"""SELECT fqcn, method, loc, array_to_string(tags, ';') AS tags, coalesce(display_name, '') AS display_name, content_hash, rel AS ai_security_relevant, CASE WHEN rel IS NOT NULL THEN ai_name END AS ai_display_name,
    array_to_string(coalesce(ai_tags, []), ';') AS ai_tags, CASE WHEN rel IS NOT NULL THEN reason END AS ai_reason, CASE WHEN rel IS NOT NULL THEN CAST({NUM.format("conf")} AS DOUBLE) END AS ai_confidence, CASE WHEN rel IS NOT NULL THEN CAST({NUM.format("inter")} AS DOUBLE) END AS ai_interaction_score, {DRIFT_SQL} AS tag_ai_drift FROM methods"""


@query(M + " " + INVENTORY_SQL)
def scan_csv(spark, d):
    got = tables.read_inventory(spark, saved(spark, d)).drop("seq")
    return got.withColumns({"tags": j("tags"), "ai_tags": j("ai_tags")})


@query("SELECT '2026-01-02' AS value")
def sink_metadata(spark, d):
    """Comments before the head of an inventory, by key."""
    return spark.createDataFrame([(tables.metadata_of(spark, saved(spark, d)),)], "value string")


LINES = ("a,b", '"a,b",c', '"a""b",', "", '"open, end', 'x"y",z')


@query("SELECT * FROM (VALUES (0, 'a|b'), (1, 'a,b|c'), (2, 'a\"b|'), (3, ''), (4, 'open, end'), (5, 'xy|z')) t(n, fields)")
def parse_csv_line(spark, d):
    return spark.createDataFrame([(n, "|".join(tables.parse_csv_line(x))) for n, x in enumerate(LINES)], "n int, fields string")


CACHED = "SELECT l.doc_id, sha256(d.text) AS content_hash, CASE WHEN l.doc_id % 3 > 0 THEN 'sig-' || (l.doc_id % 3) END AS prompt_signature, 'C' || l.doc_id AS class_name, 'm' || l.quality AS method FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL"


def cached(spark, d) -> DataFrame:
    """(contentHash, promptSignature, suggestion) of labels, as a run would write them."""
    docs = V.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("contentHash"))
    rows = V.table(spark, d, "labels").join(docs, "doc_id")
    method = F.struct(F.concat(F.lit("m"), "quality").alias("methodName"), (F.col("toxic") == 1).alias("securityRelevant"), F.lit(None).cast("string").alias("displayName"), F.array(F.lit("auth")).alias("tags"), F.lit(None).cast("string").alias("reason"), F.lit(0.5).alias("confidence"), F.lit(0.0).alias("interactionScore"))
    fields = {"className": F.concat(F.lit("C"), "doc_id"), "classSecurityRelevant": F.lit(None).cast("boolean"), "classTags": F.array().cast("array<string>"), "classReason": F.lit(None).cast("string"), "methods": F.array(method)}
    suggestion = F.struct(*(c.alias(n) for n, c in fields.items()), F.lit(None).cast(tables.s_schema()["secrets"].dataType).alias("secrets"))
    return rows.select("contentHash", F.expr("CASE WHEN doc_id % 3 > 0 THEN 'sig-' || (doc_id % 3) END").alias("promptSignature"), suggestion.alias("suggestion"))


@query(f"SELECT content_hash, prompt_signature, class_name, method FROM ({CACHED})")
def scan_jsonl_cache(spark, d):
    path = folder(spark)
    documents.write_cache(cached(spark, d), path)
    got = tables.read_cache(spark, path)
    return got.select("content_hash", "prompt_signature", F.col("suggestion.className").alias("class_name"), F.get("suggestion.methods", F.lit(0))["methodName"].alias("method"))


@query(f"SELECT content_hash, class_name FROM ({CACHED})")
def sink_cache(spark, d):
    return scan_jsonl_cache(spark, d).select("content_hash", "class_name")


@query("WITH " + V.MAPPING_SQL + ", t AS (SELECT tag, CAST(dense_rank() OVER (ORDER BY tag) - 1 AS INTEGER) AS tag_pos, CAST(row_number() OVER (PARTITION BY tag ORDER BY pos) - 1 AS INTEGER) AS pos, control_id, chapter, chapter_title FROM mapping) SELECT tag, tag_pos, pos, control_id, chapter, chapter_title FROM t")
def scan_mapping(spark, d):
    by_tag: dict[str, list] = {}
    for r in V.mapping(spark, d).orderBy("tag", "pos").collect():
        by_tag.setdefault(r.tag, []).append({k: v for k, v in (("id", r.control_id), ("chapter", r.chapter), ("chapterTitle", r.chapter_title)) if v is not None})
    text = json.dumps({"schemaVersion": "1", "framework": "asvs", "frameworkVersion": "4", "tagToControls": by_tag})
    path = folder(spark)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return tables.read_mapping(spark, path)[1]


@query("WITH " + V.OVERRIDES_SQL + ", few AS (SELECT *, CAST(row_number() OVER (ORDER BY pos, fqcn) - 1 AS INTEGER) AS n FROM overrides WHERE pos < 20000000 AND pos % 7 = 0) SELECT n AS pos, fqcn, method, security_relevant, array_to_string(tags, ';') AS tags, display_name, reason FROM few")
def scan_overrides(spark, d):
    path = folder(spark)
    documents.write_overrides(V.overrides(spark, d).where("pos < 20000000 AND pos % 7 = 0"), path, "pos", "fqcn")
    return tables.read_override_file(spark, path).drop("note").withColumn("tags", j("tags"))


CATALOGUE = "rules:\n- {id: a, category: X, anchors: [k, l], pattern: 'k=(\\w+)', entropyMin: 1.5}\n- {id: b, category: Y, pattern: z}\n"


@query(f"SELECT * FROM (VALUES ('a', 'X', 'k;l', 1.5::DOUBLE, '{hashlib.sha256(CATALOGUE.encode()).hexdigest()}'), ('b', 'Y', '', 0::DOUBLE, '{hashlib.sha256(CATALOGUE.encode()).hexdigest()}')) t(id, category, anchors, entropy_min, digest)")
def scan_rules(spark, d):
    rules, digest = tables.read_rules(CATALOGUE)
    return spark.createDataFrame([(r.id, r.category, ";".join(r.anchors), r.entropy_min, digest) for r in rules], "id string, category string, anchors string, entropy_min double, digest string")


ANSWERED = "SELECT 'C' || c_custkey AS fqcn, CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey END AS method, 'C' || c_custkey AS class_name FROM customer WHERE c_custkey % 50 = 0"


@query(ANSWERED)
def scan_manual_response(spark, d):
    """Answers that a person saved, by file stem; a class without one has an empty suggestion."""
    classes = V.table(spark, d, "customer").where("c_custkey % 50 = 0").selectExpr("'s' || c_custkey AS file_stem", "'C' || c_custkey AS fqcn", "c_custkey")
    answers = classes.select("file_stem", F.expr("CASE WHEN c_custkey % 3 = 0 THEN '```json {\"className\": \"' || fqcn || '\", \"methods\": [{\"methodName\": \"m' || c_custkey || '\"}]} ```' ELSE 'no answer' END").alias("response"))
    got = tables.with_manual_responses(classes.select("file_stem", "fqcn"), answers)
    return got.select("fqcn", F.get("suggestion.methods", F.lit(0))["methodName"].alias("method"), F.col("suggestion.className").alias("class_name"))


@query("SELECT * FROM (VALUES ('outputMode', 'sarif'), ('securityOnly', 'True'), ('minConfidence', '0.5'), ('maxClassChars', '40000'), ('warnings', 'unknown setting colour')) t(name, value)")
def scan_config(spark, d):
    got, warnings = tables.read_config("outputMode: sarif\ncolour: red\nminConfidence: 0.3\n", {"minConfidence": 0.5})
    return spark.createDataFrame([*((k, str(got[k])) for k in ("outputMode", "securityOnly", "minConfidence", "maxClassChars")), ("warnings", ";".join(warnings))], "name string, value string")


# --- rules of rows


@query(M + ", g AS (SELECT fqcn, list(CASE seq % 3 WHEN 0 THEN method WHEN 1 THEN ' ' END ORDER BY seq) AS names FROM methods GROUP BY fqcn) SELECT fqcn, array_to_string(list_filter(names, lambda n: trim(coalesce(n, '')) <> ''), ';') AS methods FROM g")
def filter_valid_suggestion(spark, d):
    one = F.struct("seq", F.expr("CASE seq % 3 WHEN 0 THEN method WHEN 1 THEN ' ' END").alias("methodName"), F.lit(None).cast("array<string>").alias("tags"))
    g = V.methods(spark, d).groupBy("fqcn").agg(F.sort_array(F.collect_list(one)).alias("m"))
    return g.select("fqcn", F.array_join(F.transform(records.valid_suggestions(F.col("m")), lambda x: x["methodName"]), ";").alias("methods"))


@query("SELECT * FROM (VALUES (false, false, true), (false, true, true), (true, false, false), (true, true, true)) t(ai, cache, replay)")
def project_deterministic_replay(spark, d):
    return spark.createDataFrame([(a, c, records.deterministic_replay(a, c)) for a in (False, True) for c in (False, True)], "ai boolean, cache boolean, replay boolean")


@query(S + ", n AS (SELECT (SELECT count(*) FROM (SELECT fqcn, method FROM scan_before EXCEPT SELECT fqcn, method FROM scan_after)) + (SELECT count(*) FROM (SELECT fqcn, method FROM scan_after EXCEPT SELECT fqcn, method FROM scan_before)) AS n), l AS (SELECT unnest([-1, 0, 1, 1000000000]) AS max_allowed) SELECT max_allowed, n, max_allowed >= 0 AND max_allowed <= n AS stops FROM l, n")
def limit_mismatch(spark, d):
    from ..operators import reconcile

    a, b = V.scans(spark, d)
    n = reconcile.csv_not_source(a, b).count() + reconcile.source_not_csv(a, b).count()

    def stops(limit: int) -> bool:
        try:
            reconcile.guard(n, limit)
        except reconcile.TooManyMismatches:
            return True
        return False

    return spark.createDataFrame([(x, n, stops(x)) for x in (-1, 0, 1, 1_000_000_000)], "max_allowed int, n long, stops boolean")


# --- texts

WAITS = (("7", None), ("0", "Please wait 9 seconds"), (None, "please wait 1 second"), ("x", "no"), ("-1", None), ("0", ""))


@query("SELECT * FROM (VALUES (0, 7), (1, 9), (2, 1), (3, 60), (4, 60), (5, 60)) t(n, seconds)")
def fn_retry_after(spark, d):
    return spark.createDataFrame([(n, T.retry_after(*w)) for n, w in enumerate(WAITS)], "n int, seconds int")


TEMPLATES = (("triage", "{className} {candidates} {x} JSON"), ("classification", "{className}"), ("triage", "{className}{candidates} JSON"))


@query("SELECT * FROM (VALUES (0, 'unknown {x}'), (1, 'missing {classSource};missing {methods};the answer''s format isn''t named'), (2, '')) t(n, problems)")
def fn_validate_template(spark, d):
    return spark.createDataFrame([(n, ";".join(T.template_problems(*t))) for n, t in enumerate(TEMPLATES)], "n int, problems string")


@query(M + ", g AS (SELECT fqcn, list('m' || method ORDER BY seq) AS r, list(begin_line ORDER BY seq) AS l FROM methods GROUP BY fqcn) SELECT fqcn, array_to_string(list_transform(range(1, len(r) + 1), lambda i: '[' || (i - 1) || '] ' || r[i] || ' line ' || l[i] || ' s'), chr(10)) AS listed FROM g")
def fn_candidate_list(spark, d):
    one = F.struct("seq", F.concat(F.lit("m"), "method").alias("rule_id"), F.col("begin_line").alias("line"), F.lit("s").alias("snippet"))
    g = V.methods(spark, d).groupBy("fqcn").agg(F.sort_array(F.collect_list(one)).alias("c"))
    return g.select("fqcn", T.candidate_list(F.col("c")).alias("listed"))


@query("""SELECT * FROM (VALUES ('{"level": "INFO", "runId": "r", "message": "a\\"b"}'), ('{"level": "WARN", "message": "é", "path": "p"}')) t(line)""")
def json_log(spark, d):
    return spark.createDataFrame([(T.json_line("INFO", 'a"b', "r"),), (T.json_line("WARN", "é", None, path="p"),)], "line string")


# --- sinks


@query("SELECT * FROM (VALUES ('schemaVersion', '2'), ('x', '1'), ('configHash', '" + hashlib.sha256(b"a=1\nb=\n").hexdigest() + "'), ('deterministicReplay', 'True')) t(name, value)")
def sink_receipt(spark, d):
    got = json.loads(documents.receipt({"x": 1, "y": None}, {"b": None, "a": 1}, True, True))
    return spark.createDataFrame([("schemaVersion", got["schemaVersion"]), *((k, str(v)) for k, v in got["inputs"].items()), ("configHash", got["configHash"]), ("deterministicReplay", str(got["deterministicReplay"]))], "name string, value string")


@query("SELECT 'c' || c_custkey AS file_stem, 'ask about ' || c_custkey AS prompt FROM customer WHERE c_custkey % 100 = 0")
def sink_manual_prepare(spark, d):
    """One folder for each class with the prompt to be shown to a model by hand."""
    path = folder(spark)
    documents.write_prompts(V.table(spark, d, "customer").where("c_custkey % 100 = 0").selectExpr("'c' || c_custkey AS file_stem", "'ask about ' || c_custkey AS prompt"), path)
    return spark.read.text(path).select("file_stem", F.col("value").alias("prompt"))


@query(M + " SELECT (SELECT count(*) FROM methods) AS all_rows, (SELECT count(*) FROM methods WHERE coalesce(rel, false)) AS shown")
def tee(spark, d):
    """Two sinks over rows that are computed once."""
    a, b = folder(spark) + "a", folder(spark) + "b"
    documents.tee(V.methods(spark, d).select("seq", "method", "ai"), lambda df: df.select("method").write.text(a), lambda df: records.security_only(df).select("method").write.text(b))
    return spark.createDataFrame([(spark.read.text(a).count(), spark.read.text(b).count())], "all_rows long, shown long")


@query("WITH n AS (SELECT 'doc' || doc_id AS name, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL) SELECT name, sha256, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS nth FROM n")
def sort_manifest(spark, d):
    """The lines of a manifest in the order of names."""
    c = V.classes(spark, d).select(F.expr("'/x/doc' || doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    listed = documents.manifest_lines({r.name: r.sha256 for r in documents.manifest(c).collect()})
    return spark.createDataFrame([(*reversed(x.rstrip("\n").split("  ", 1)), n + 1) for n, x in enumerate(listed)], "name string, sha256 string, nth int")


CS = "using Xunit;\nnamespace A;\nclass C {\n  [Fact]\n  [Trait(\"Tag\", \"old\")]\n  public void M() { }\n}\n"


@query("SELECT * FROM (VALUES (1, '  [Fact(DisplayName = \"n\")]'), (2, '  [Trait(\"Tag\", \"a\")]'), (3, '  [Trait(\"Tag\", \"b\")]'), (4, '  public void M() { }')) t(n, line)")
def sink_source_patch_csharp(spark, d):
    after, _ = patch.patch_csharp(CS, [patch.Change("M", 4, ("b", "a"), "n")])
    return spark.createDataFrame([(n + 1, x) for n, x in enumerate(after.split("\n")[3:7])], "n int, line string")


@query("SELECT c_custkey AS c, CAST(i AS INTEGER) AS i FROM customer, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE (c_custkey % 2 = 0 AND i IN (0, 3)) OR (c_custkey % 2 = 1 AND i IN (0, 2))")
def match_scope(spark, d):
    """Files that are searched for secrets: those with tests for even customers; all that match a pattern of paths for odd ones."""
    names = ("T{c}.java", "x{c}.java", "conf/{c}.conf", "T{c}b.java")
    content = ("class T { @Test void a() { } }", "class X { }", "k", "class T { @Test void b() { } }")
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("c"))
    files = c.select("c", F.posexplode(F.array(*[F.struct(F.concat(F.lit("/r/"), _filled(n, F.col("c").cast("string"))).alias("path"), F.lit(x).alias("content")) for n, x in zip(names, content)])).alias("i", "f")).select("c", "i", "f.path", "f.content")
    scanned = scanners.scan_tree(files, "/r")
    by_tests, by_glob = scan.scoped(files.where("c % 2 = 0"), scanned, None), scan.scoped(files.where("c % 2 = 1"), scanned, "{conf/*.conf,T*[0-9].java}")
    return by_tests.select("c", "i").union(by_glob.select("c", "i"))


# --- a whole run


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT 'cust.C' || c || 'Test' AS fqcn, 'o' || k AS method, 't' || (k % 3) AS tags, i = 1 AS relevant, CASE WHEN i = 1 THEN 'crypto' ELSE '' END AS ai_tags FROM o""")
def scan_run(spark, d):
    """Sources, classes, a model's answers and the rows with them: the model calls the first test of a class relevant."""
    files = JAVA.texts(spark, d).withColumn("root", F.lit(0))
    scanned = scanners.scan_tree(files, "/r").withColumns({"root": F.lit(0), "source_root": F.lit("/r")})
    inputs = scan.Inputs(model=_first_is_relevant)
    settings = dict(tables.DEFAULTS) | {"aiEnabled": True, "contentHash": True}
    known = scan.answers(scan.classes_of(scanned, files), settings, inputs)
    rows = scan.inventory(scanned, known, settings, None)
    empty = F.array().cast("array<string>")
    return rows.select("fqcn", "method", j("tags").alias("tags"), F.coalesce("ai.relevant", F.lit(False)).alias("relevant"), j(F.coalesce("ai.tags", empty)).alias("ai_tags"))


def _first_is_relevant(fqcn: str, prompt: str) -> str:
    first = prompt.split("- ", 1)[1].split("\n", 1)[0]
    return json.dumps({"className": fqcn, "methods": [{"methodName": first, "securityRelevant": True, "tags": ["crypto"], "confidence": 1.0}]})


@query("SELECT count(DISTINCT sha256(text)) AS asked, 0::BIGINT AS again, count(DISTINCT sha256(text)) AS kept FROM documents WHERE text IS NOT NULL")
def incremental_scan(spark, d):
    """A batch of classes, and the same batch again after it was committed: nothing is asked or written twice."""
    from ..streaming import incremental

    path = folder(spark)
    batch = V.classes(spark, d).select("fqcn", F.col("text").alias("source"))
    asked = [incremental.ask_unknown(batch, n, path, _echo, "sig") for n in (0, 0)]
    return spark.createDataFrame([(*asked, incremental.read_kept(spark, path).count())], "asked long, again long, kept long")


def _echo(fqcn: str, source: str) -> str:
    return "{}"

