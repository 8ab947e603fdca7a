import hashlib
import json
import os
import stat
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkledger.functions import text as T
from sparkledger.operators import coverage, findings, suggestions
from sparkledger.plans import scan
from sparkledger.sinks import documents, lines, signing
from sparkledger.sources import models, scanners, tables
from sparkledger.streaming import incremental

LOGIN = """package a;
import org.junit.jupiter.api.*;
class LoginTest {
    @Test @Tag("auth") void opens() { /* token = "0123456789abcdef0123456789abcdef01234567" */ }
    @Test void closes() { }
}
class OtherTest {
    @Test @DisplayName("") void waits() { }
}
"""
MAP = {"schemaVersion": "1", "framework": "asvs", "frameworkVersion": "4", "tagToControls": {"auth": [{"id": "2.1", "chapter": "V2"}], "crypto": [{"id": "6.1"}], "x": [{"id": "9.9"}]}}


def tree(tmp_path):
    root = tmp_path / "src"
    (root / "a").mkdir(parents=True)
    (root / "a/LoginTest.java").write_text(LOGIN)
    (root / "a/test_more.py").write_text("def test_b():\n    password = 1\n")
    (root / "a/bad_test.py").write_text("def (")
    (root / "a/app.conf").write_text("password = 'hunter2hunter2'\n")
    return str(root)


def stub(log):
    """Answers that the first method of a class is relevant, and notes every question in a file, as tasks run elsewhere."""
    path = str(log)

    def ask(fqcn, prompt):
        with open(path, "a") as f:
            f.write(prompt.split("\n", 1)[0] + "\n")
        first = prompt.split("- ", 1)[1].split("\n", 1)[0]
        return "Sure:\n" + json.dumps({"className": fqcn, "methods": [{"methodName": first, "securityRelevant": True, "displayName": "N " + first, "tags": ["crypto"], "reason": "why", "confidence": 0.9, "interactionScore": 0.1}]})

    return ask


def mapping_of(spark):
    return spark.createDataFrame(tables.parse_mapping(json.dumps(MAP))[1], "tag string, tag_pos int, pos int, control_id string, chapter string, chapter_title string")


def test_run_from_tree_to_reports(spark, tmp_path):
    root, log = tree(tmp_path), tmp_path / "log"
    inputs = scan.Inputs(model=stub(log), mapping=mapping_of(spark), framework="asvs")
    settings = {"outputMode": "csv", "contentHash": True, "securityOnly": True, "detectSecrets": True, "confidence": True}
    done = scan.run(spark, [root], str(tmp_path / "out"), settings, inputs)
    assert done == {"methods": 4, "classes": 3, "shown": 3, "asked": 3, "cached": 0, "secrets": 1, "had_errors": True}
    assert sorted(log.read_text().split("\n")) == ["", "Class a.LoginTest", "Class a.OtherTest", "Class a.test_more"]
    rows = scan.written_text(spark, f"{tmp_path}/out/inventory").splitlines()
    assert rows[0].startswith("fqcn,method,loc,tags,display_name,content_hash,ai_security_relevant") and [r.split(",")[1] for r in rows[1:]] == ["opens", "waits", "test_b"]
    # coverage is of all rows: a filter doesn't touch it
    doc = json.loads(scan.written_text(spark, f"{tmp_path}/out/coverage"))
    assert {k: [t["method"] for t in v["tests"]] for k, v in doc["coverage"].items()} == {"ASVS-2.1": ["opens"], "ASVS-6.1": ["opens", "waits", "test_b"]} and doc["gaps"] == ["ASVS-9.9"]
    assert doc["coverage"]["ASVS-2.1"]["chapter"] == "V2" and doc["statistics"]["coveredControls"] == 2
    assert scan.receipt_of(spark, str(tmp_path / "out"))["deterministicReplay"] is False
    found = spark.read.option("header", True).csv(f"{tmp_path}/out/secrets").collect()
    assert [(r.method, r.rule_id, r.begin_line) for r in found] == [("opens", "hex-token", "4")]
    # a second run with the first one's cache asks nothing, and overrides have the last word
    over = tables.read_overrides(spark, "overrides: [{fqcn: a.LoginTest, method: closes, securityRelevant: true, tags: [auth]}]")
    again = scan.Inputs(model=stub(log), cache=tables.read_cache(spark, f"{tmp_path}/out/cache"), overrides=over)
    done = scan.run(spark, [root], str(tmp_path / "again"), {"outputMode": "sarif", "securityOnly": True}, again)
    assert (done["asked"], done["cached"], done["shown"]) == (0, 3, 4)
    run = json.loads(scan.written_text(spark, f"{tmp_path}/again/inventory"))["runs"][0]
    assert [(r["ruleId"], r["locations"][0]["logicalLocations"][0]["fullyQualifiedName"]) for r in run["results"]] == [("security/crypto", "a.LoginTest.opens"), ("security/auth", "a.LoginTest.closes"), ("security/crypto", "a.OtherTest.waits"), ("empty-display-name", "a.OtherTest.waits"), ("security/crypto", "a.test_more.test_b")]


def test_scope_of_secrets(spark, tmp_path):
    root = tree(tmp_path)
    files, scanned = scan.found_in(spark, [root], {})
    names = lambda include: sorted(r.path.rsplit("/", 1)[-1] for r in scan.scoped(files, scanned, include).collect())
    assert names(None) == ["LoginTest.java", "test_more.py"] and names("**/*.conf") == ["app.conf"] and names("a/*.{py,conf}") == ["app.conf", "bad_test.py", "test_more.py"] and names("?.conf") == []
    found = scan.secrets(files, scanned, {"secretsInclude": "**/*.conf"}, findings.RULES).collect()
    assert [(r.rule_id, r.method, r.begin_line) for r in found] == [("password-assignment", None, 1)]


def test_class_digest_is_of_the_class(spark):
    one = scanners.java_classes(LOGIN)
    two = scanners.java_classes(LOGIN.replace("void waits() { }", "void waits() { int x; }").replace("    @Test void closes() { }", "    // closes\n    @Test   void closes() {\n }"))
    digest = lambda t: hashlib.sha256(scanners.java_canonical(t).encode()).hexdigest()
    assert list(one) == ["a.LoginTest", "a.OtherTest"] and digest(one["a.OtherTest"]) != digest(two["a.OtherTest"])
    assert digest(one["a.LoginTest"]) != digest(scanners.java_classes(LOGIN.replace("closes()", "close()"))["a.LoginTest"])
    assert scanners.java_canonical('a  /* x */ b // y\n "c  d"') == 'a b "c  d"'
    files = spark.createDataFrame([("/r/a/LoginTest.java", LOGIN)], "path string, content string")
    got = {r.fqcn: r for r in scanners.class_sources(scanners.scan_tree(files, "/r"), files).collect()}
    assert got["a.OtherTest"].source == one["a.OtherTest"] and got["a.OtherTest"].content_hash == digest(one["a.OtherTest"])


def test_plugins_are_configured_and_closed(spark):
    log = []

    def configure(settings):
        log.append(settings["word"])
        word = settings["word"]
        return lambda text, path="", markers=None: iter([scanners.Found("X", word, 1, 1)])

    scanners.register("own", (".own",), scanners.scan_go, configure, lambda: log.append("closed"))
    try:
        files = spark.createDataFrame([("/r/a.own", "x"), ("/r/b.go", "y")], "path string, content string")
        with scanners.opened({"word": "w"}, ["own"]) as plugins:
            assert list(plugins) == ["own"] and [(r.plugin, r.method) for r in scanners.scan_tree(files, "/r", plugins=plugins).collect()] == [("own", "w")]
        with pytest.raises(RuntimeError), scanners.opened({"word": "v"}, ["own"]):
            raise RuntimeError
        assert log == ["w", "closed", "v", "closed"]
        with pytest.raises(ValueError), scanners.opened({}, ["nope"]):
            pass
        with pytest.raises(ValueError):
            scanners.register("own", (".x",), scanners.scan_go)
    finally:
        del scanners.PLUGINS["own"]


ANSWERS = {
    "openai": '{"choices": [{"message": {"content": "yes"}}]}',
    "anthropic": '{"content": [{"type": "thinking"}, {"type": "text", "text": "yes"}]}',
    "ollama": '{"message": {"content": "yes"}}',
}


@pytest.mark.parametrize("service", sorted(models.SERVICES))
def test_clients(service):
    sent = []

    def transport(url, headers, body, timeout):
        sent.append((url, headers, json.loads(body)))
        return 200, {}, ANSWERS[{"azure": "openai"}.get(models.SERVICES[service].kind, models.SERVICES[service].kind)]

    heard = []
    c = models.client(service, "m", "k", base="http://x/" if service == "azure_openai" else None, transport=transport, on_answer=lambda *a: heard.append(a))
    assert c("A", "prompt") == "yes" and heard == [("A", "prompt", "yes")]
    url, headers, body = sent[0]
    assert "//" not in url.split("://")[1] and "prompt" in json.dumps(body) and (body.get("model") == "m")
    assert {"anthropic": "x-api-key", "azure": "api-key", "ollama": "Content-Type"}.get(c.about.kind, "Authorization") in headers
    if c.about.keyed:
        with pytest.raises(models.ModelError):
            models.client(service, "m", " ", base="http://x")


def test_waits_and_refusals():
    replies, slept, heard = [(429, {"retry-after": "0"}, "Please wait 3 seconds"), (429, {"Retry-After": "7"}, ""), (200, {}, ANSWERS["ollama"])], [], []
    make = lambda n: models.Client("ollama", "m", retries=n, transport=lambda *a: queue.pop(0), sleep=slept.append, on_wait=lambda *a: heard.append(a))
    queue = list(replies)
    assert make(2)("A", "p") == "yes" and slept == [3, 7] and heard == [(3, 1, 2), (7, 2, 2)]
    queue = list(replies)
    with pytest.raises(models.ModelError):
        make(1)("A", "p")
    queue = [(500, {}, "no")]
    with pytest.raises(models.ModelError):
        make(3)("A", "p")
    queue = [(200, {}, '{"message": {"content": " "}}')]
    with pytest.raises(models.ModelError):
        make(0)("A", "p")
    assert (T.retry_after("0", None), T.retry_after("-5", "Please wait 0 seconds"), T.retry_after("0", "please wait 4 second"), T.retry_after(" 12 ", None)) == (60, 60, 4, 12)


def test_automatic_choice():
    assert models.client("auto", "m", is_up=lambda base: True).service == "ollama"
    assert models.client("auto", "m", "k", is_up=lambda base: False).service == "openai"
    with pytest.raises(models.ModelError):
        models.client("auto", "m", is_up=lambda base: False)


def test_keys_and_signatures(spark, tmp_path):
    ring = str(tmp_path / "ring.json")
    for alias, algorithm in (("e", None), ("r", "RSA"), ("c", "ecdsa")):
        pem = signing.generate(spark, ring, alias, algorithm)
        assert open(pem).read().startswith("-----BEGIN PUBLIC KEY-----")
    assert stat.S_IMODE(os.stat(ring).st_mode) == 0o600
    for alias, algorithm in (("e", None), ("r", "RSA-PSS"), ("c", "ECDSA"), ("e/c", "Ed25519+ECDSA")):
        text = "abc  x\n"
        signed = text + signing.sign(spark, text.encode(), ring, alias, algorithm)
        assert signing.verify(spark, signed, ring) and not signing.verify(spark, "b" + signed, ring) and not signing.verify(spark, text, ring)
    for alias, algorithm in (("e/c", "Ed25519"), ("e", "Ed25519+RSA"), ("none", None), ("e", "SPHINCS+"), ("e", "RSA")):
        with pytest.raises(signing.SigningError):
            signing.sign(spark, b"", ring, alias, algorithm)
    with pytest.raises(signing.SigningError):
        signing.generate(spark, ring, "e")
    signing.generate(spark, ring, "e", overwrite=True)
    df = spark.createDataFrame([(0, "p.A", "m", 3, ["t"], "", None, 2, "h", "r")], f"seq long, fqcn string, method string, begin_line int, tags array<string>, display_name string, ai {suggestions.AI}, loc int, content_hash string, source_root string")
    folder = str(tmp_path / "pack")
    documents.write_evidence(folder, df, "1", sign=lambda data: signing.sign(spark, data, ring, "e"))
    assert signing.verify(spark, open(f"{folder}/manifest.sha256.signed").read(), ring)


def test_replayed_batches_ask_once(spark, tmp_path):
    log, path = tmp_path / "log", f"{tmp_path}/cache"

    def model(fqcn, source):
        with open(log, "a") as f:
            f.write("x")
        return "{}"

    batch = spark.createDataFrame([("A", "s"), ("B", "s"), ("C", "t")], "fqcn string, source string")
    assert incremental.ask_unknown(batch, 0, path, model, "sig") == 2 and incremental.ask_unknown(batch, 0, path, model, "sig") == 0
    assert incremental.ask_unknown(batch, 1, path, model, "sig") == 0 and incremental.ask_unknown(batch, 2, path, model, "other") == 2
    assert incremental.read_kept(spark, path).count() == 4 and len(log.read_text()) == 4


def test_findings_that_repeat_stay(spark):
    found = spark.createDataFrame([("f", 2, "r"), ("f", 2, "r"), ("f", 2, "r"), ("f", 9, "r"), (None, 2, "r")], "file_path string, begin_line int, rule_id string")
    methods = spark.createDataFrame([("f", "A", "outer", 1, 5), ("f", "A", "inner", 2, 3)], "file_path string, fqcn string, method string, begin_line int, end_line int")
    got = sorted((str(r.file_path), r.begin_line, str(r.method)) for r in findings.at_methods(found, methods).collect())
    assert got == [("None", 2, "None"), ("f", 2, "inner"), ("f", 2, "inner"), ("f", 2, "inner"), ("f", 9, "None")]


def test_many_matches_have_their_places(spark):
    value = "0123456789abcdef0123456789abcdef01234567"
    text = "".join(f'{"é" * (i % 7)}token = "{value}"\n' for i in range(600))
    rows = findings.candidates(spark.createDataFrame([(1, text)], "id int, text string"), [findings.RULES[0]]).orderBy("begin_line").collect()
    assert [(r.begin_line, r.begin_column) for r in rows] == [(i + 1, i % 7 + 10) for i in range(600)]


def test_patterns_overlap_in_long_texts(spark):
    text = "abcabcab" * 400 + "é(.[x"
    words = ["ab", "abca", "bc", "(.[", "zz", "é"]
    got = [(r.keyword, r.start) for r in spark.createDataFrame([(text,)], "t string").select(F.explode(T.multi_pattern(F.col("t"), words)).alias("m")).select("m.*").collect()]
    assert got == sorted(((w, i) for w in words for i in range(len(text)) if text.startswith(w, i)), key=lambda x: (x[1] + len(x[0]), -len(x[0])))
    assert list(T.Automaton(words).search(text)) == got


def test_json_in_texts():
    for text, want in (('a } {"b": "\\\\"} c', '{"b": "\\\\"}'), ('{"open {', None), ('x{{}{"}"}}{}', '{{}{"}"}}'), ('{"a": "\\', None), ("}{}", "{}"), ("", None)):
        assert T.first_json_object(text) == want, text


def test_mapped_tags_by_either_way(spark):
    mapping = mapping_of(spark)
    rows = [(0, "A", "m", None, ["auth", "no", "auth"], None), (1, "A", "n", None, None, (True, None, ["x", "crypto"], None, 0.9, 0.0)), (2, None, "o", None, [], None)]
    tests = spark.createDataFrame(rows, f"seq long, fqcn string, method string, display_name string, tags array<string>, ai {suggestions.AI}")
    shown = lambda most: sorted(map(repr, coverage.tests_by_control(tests, mapping, "asvs", 0.5, most).collect()))
    assert shown(10) == shown(1) and len(shown(10)) == 3
    assert sorted(r.control for r in coverage.covered_controls(tests, mapping, "asvs", 0.5, 1).collect()) == ["ASVS-2.1", "ASVS-6.1", "ASVS-9.9"]
    parts = coverage.report(coverage.tests_by_control(tests, mapping, "asvs", 0.5), mapping, "asvs", part_rows=1)
    assert parts.count() == 3 and coverage.report(coverage.tests_by_control(tests, mapping, "asvs", 0.5), mapping, "asvs").count() == 3


def test_documents_in_parts(spark, tmp_path):
    rows = [(i, "p.A", f"m{i}", 1, ["auth"], "" if i % 3 == 0 else 'q"', None, 1, "h", "r") for i in range(40)]
    df = spark.createDataFrame(rows, f"seq long, fqcn string, method string, begin_line int, tags array<string>, display_name string, ai {suggestions.AI}, loc int, content_hash string, source_root string")
    results = documents.sarif_results(df)
    documents.write_sarif(results, f"{tmp_path}/sarif", "1")
    assert json.loads(scan.written_text(spark, f"{tmp_path}/sarif")) == json.loads(documents.sarif_document(results, "1"))
    documents.write_sarif(results.where("false"), f"{tmp_path}/none", "1")
    assert json.loads(scan.written_text(spark, f"{tmp_path}/none"))["runs"][0]["results"] == []
    mapping = mapping_of(spark)
    rep = coverage.report(coverage.tests_by_control(df, mapping, "asvs"), mapping, "asvs", part_rows=7)
    other = (coverage.gaps(coverage.covered_controls(df, mapping, "asvs"), mapping, "asvs"), coverage.statistics(coverage.covered_controls(df, mapping, "asvs"), mapping, "asvs"))
    documents.write_coverage(rep, *other, f"{tmp_path}/coverage", "asvs", "4", "", "1")
    doc = json.loads(scan.written_text(spark, f"{tmp_path}/coverage"))
    assert [t["method"] for t in doc["coverage"]["ASVS-2.1"]["tests"]] == [f"m{i}" for i in range(40)] and doc["coverage"]["ASVS-2.1"]["tests"][1]["displayName"] == 'q"'
    assert json.loads(documents.coverage_document(rep, *other, "asvs", "4", "", "1"))["coverage"] == doc["coverage"]
    lines.write_csv(df, f"{tmp_path}/csv", metadata={"a": "b"})
    assert scan.written_text(spark, f"{tmp_path}/csv").splitlines()[:3] == ["# a: b", "fqcn,method,loc,tags,display_name", "p.A,m0,1,auth,"]


def test_cache_order_is_that_of_files(spark, tmp_path):
    for n, name in enumerate(("b.json", "a.json")):
        (tmp_path / name).write_text("".join(json.dumps({"contentHash": "h", "promptSignature": f"{name}{k}"}) + "\n" for k in range(2 if n else 500)))
    got = tables.read_cache(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.prompt_signature for r in got] == ["a.json0", "a.json1", *(f"b.json{k}" for k in range(500))]


def test_texts_of_equal_tag_lists_are_made_once(spark):
    """Controls that the same tags map to share one text; a tag that maps to a control twice counts twice."""
    lists = spark.createDataFrame([("A", ["x", "y"]), ("B", ["x", "y"]), ("C", ["y", "y"]), ("D", ["z"])], "control string, tag_list array<string>")
    by_tag = spark.createDataFrame([(n, t, f"{n}{t}") for n in (10, 9, 2, 1) for t in "yx"], "seq long, tag string, value string")
    got = {tuple(r.tag_list): r.tests for r in coverage.texts_by_tags(by_tag, lists, part_rows=3).collect()}
    assert got == {("x", "y"): "1x|1y|2x|2y|9x|9y|10x|10y", ("y", "y"): "1y|1y|2y|2y|9y|9y|10y|10y"}


LONG = """
from pyspark.sql import SparkSession
from sparkledger.operators import coverage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
by_tag = spark.range(160_000).selectExpr("id AS seq", "'x' AS tag", "repeat(lpad(id, 10, '0'), 100) AS value")
lists = spark.createDataFrame([("A", ["x"]), ("B", ["x"])], "control string, tag_list array<string>")
for r in coverage.texts_by_tags(by_tag, lists).selectExpr("length(tests) AS n", "substring(tests, 1, 1002) AS head", "right(tests, 1001) AS tail").collect():
    assert (r.n, r.head, r.tail) == (160_000 * 1001 - 1, "0" * 1000 + "|0", "|" + "0000159999" * 100)
    print("whole")
"""


def test_a_text_of_a_third_of_the_heap(tmp_path):
    """160 MB in a heap of 512 MB: its parts, the text and its row are never in the heap at once."""
    root = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell", "SPARK_LOCAL_DIRS": str(tmp_path)}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    done = subprocess.run([sys.executable, "-c", LONG], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["whole"], done.stderr[-2000:]


def test_whole_texts_of_each_head(spark):
    """A row for each head, in any number; empty texts, wide characters, null chapters; none for heads without parts or parts without heads."""
    parts = spark.createDataFrame([(["x"], 2, "c"), (["x"], -1, "\u00e4"), (["x"], 0, ""), (["y"], 0, ""), (["w"], 0, "w")], "tag_list array<string>, part long, text string")
    heads = spark.createDataFrame([(["x"], "A", None), (["x"], "B", "\U0001f600"), (["y"], "C", "t"), (["z"], "D", "t")], "tag_list array<string>, control string, chapter string")
    got = sorted(tuple(r) for r in coverage.whole_texts(parts, heads).collect())
    assert got == [("A", None, "\u00e4||c"), ("B", "\U0001f600", "\u00e4||c"), ("C", "t", "")]
