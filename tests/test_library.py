import hashlib
import json
import math
import os
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkledger.functions import columns as C
from sparkledger.functions import text as T
from sparkledger.operators import aggregates, coverage, delta, findings, reconcile, records, suggestions
from sparkledger.schemas import SCAN_RECORD
from sparkledger.sinks import documents, lines, patch
from sparkledger.sources import tables
from sparkledger.streaming import incremental

AI = suggestions.AI
RECORD = "seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCAN_RECORD.fields)


def one(spark, column, **values):
    df = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def record(seq, method, **more):
    base = dict.fromkeys(SCAN_RECORD.names) | {"fqcn": "A", "method": method, "loc": 1, "tags": []}
    return Row(seq=seq, **(base | more))


def inventory(spark, *rows):
    return spark.createDataFrame([Row(**{k: r[k] for k in ["seq", *SCAN_RECORD.names]}) for r in rows], RECORD)


# --- change sets


def changes(spark, before, after):
    out = delta.compare(inventory(spark, *before), inventory(spark, *after)).orderBy("fqcn", "method").collect()
    return [(r.method, r.change, r.changed_fields) for r in out]


def test_delta(spark):
    b = [record(0, "same"), record(1, "gone"), record(2, "m", loc=1, tags=["a", "b"], content_hash="aaa", ai_security_relevant=True, ai_tags=["x"], ai_interaction_score=0.1, tag_ai_drift="none"), record(3, "n", content_hash=None, display_name=None, ai_tags=None)]
    a = [record(0, "same"), record(1, "new"), record(2, "m", loc=2, tags=["b", "b"], display_name="d", content_hash="bbb", ai_security_relevant=False, ai_tags=[], ai_interaction_score=0.2, tag_ai_drift="ai-only"), record(3, "n", content_hash="x", display_name="", ai_tags=[], ai_reason="other", ai_confidence=0.5)]
    assert changes(spark, b, a) == [
        ("gone", "REMOVED", None),
        ("m", "MODIFIED", ["loc", "tags", "display_name", "source", "ai_security_relevant", "ai_tags", "ai_interaction_score", "tag_ai_drift"]),
        ("n", "UNCHANGED", []),
        ("new", "ADDED", None),
        ("same", "UNCHANGED", []),
    ]


def test_delta_last_row_of_a_key_counts(spark):
    b = [record(0, "m", loc=1), record(1, "m", loc=5, ai_security_relevant=True)]
    a = [record(0, "m", loc=5, ai_security_relevant=True)]
    assert changes(spark, b, a) == [("m", "UNCHANGED", [])]
    assert changes(spark, [], a) == [("m", "ADDED", None)]
    df = inventory(spark, *b, record(2, "m", ai_security_relevant=True))
    assert delta.security_count(df).first()[0] == 2
    text = lines.delta_text(delta.compare(inventory(spark, *a), inventory(spark)), inventory(spark, *a), inventory(spark), timestamps=("t", None))
    assert text == ["delta report", "  before: before.csv  (scanned: t · 1 method · 1 security-relevant)", "  after:  after.csv  (0 methods · 0 security-relevant)", "", "- A  m", "", "0 added  ·  1 removed  ·  0 modified  ·  0 unchanged", "security-relevant: 1 → 0  (-1)"]


# --- files


def test_inventory_round_trip(spark, tmp_path):
    rows = [Row(seq=0, fqcn="A.B", method="m", loc=3, tags=["x", "y"], display_name='say "hi", you', source_root=None, content_hash="h", begin_line=1, ai=(True, "n", ["x"], "=r", 0.25, 0.85)), Row(seq=1, fqcn="A.B", method="n", loc=1, tags=[], display_name=None, source_root=None, content_hash=None, begin_line=0, ai=None)]
    df = spark.createDataFrame(rows, f"seq long, fqcn string, method string, loc int, tags array<string>, display_name string, source_root string, content_hash string, begin_line int, ai {AI}")
    groups = {"content_hash": True, "ai": True, "confidence": True, "drift": True}
    lines.write_csv(df, f"{tmp_path}/inv", metadata=lines.scan_metadata("1", "2026-01-01T00:00:00Z", "t"), **groups)
    text = "".join(open(f"{tmp_path}/inv/{f}").read() for f in sorted(os.listdir(f"{tmp_path}/inv")) if f.startswith("part"))
    assert text.splitlines() == ["# tool_version: 1", "# scan_timestamp: 2026-01-01T00:00:00Z", "# taxonomy: t", ",".join(lines.csv_columns(**groups)), 'A.B,m,3,x;y,"say ""hi"", you",h,true,n,x,"=r",0.9,0.3,ai-only,y,', "A.B,n,1,,,,,,,,,,,,"]
    (tmp_path / "one.csv").write_text(text)
    got = tables.read_inventory(spark, f"{tmp_path}/one.csv").orderBy("seq").collect()
    assert got[0].display_name == 'say "hi", you' and got[0].tags == ["x", "y"] and got[0].ai_confidence == 0.3 and got[0].ai_security_relevant is True
    assert got[1].display_name == "" and got[1].content_hash is None and got[1].ai_tags == [] and got[1].ai_security_relevant is None
    assert tables.metadata_of(spark, f"{tmp_path}/one.csv") == "2026-01-01T00:00:00Z"


def test_inventory_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("method,fqcn,loc\nm,A, 12 \nn,A,x\n#c,A,1\n")
    got = tables.read_inventory(spark, f"{tmp_path}/a.csv").orderBy("seq").collect()
    assert [(r.fqcn, r.method, r.loc, r.tags, r.ai_tags, r.display_name) for r in got] == [("A", "m", 12, [], None, None), ("A", "n", 0, [], None, None)]
    (tmp_path / "b.csv").write_text("method,loc\nm,1\n")
    with pytest.raises(ValueError):
        tables.read_inventory(spark, f"{tmp_path}/b.csv")


def test_inventory_in_parts(spark, tmp_path):
    """Parts of one inventory as tasks write them: the largest isn't the first, and only the first must have a head."""
    folder = tmp_path / "a b [1]"
    folder.mkdir()
    rows = [f"A,m{n},{n}" for n in range(90)]
    for n, part in enumerate((["# scan_timestamp: t", ""], ["# k: v", "fqcn,method,loc", *rows[:1]], rows[1:80], [], ["fqcn,method,loc", *rows[80:]])):
        (folder / f"part-{n:05d}.txt").write_text("".join(f"{x}\n" for x in part))
    for path in (str(folder).replace("[", "\\[").replace("]", "\\]"), f"{tmp_path}/a b*"):
        got = tables.read_inventory(spark, path).orderBy("seq").collect()
        assert [(r.fqcn, r.method, r.loc) for r in got] == [("A", f"m{n}", n) for n in range(90)]


def test_csv_line():
    assert tables.parse_csv_line('a,"b, ""c""",,"open') == ["a", 'b, "c"', "", "open"]
    assert tables.parse_csv_line("") == [""]


def test_cache_lines(spark, tmp_path):
    rows = [{"contentHash": "h", "promptSignature": "s", "suggestion": {"className": "A", "methods": [{"methodName": "m", "securityRelevant": True, "tags": None}], "secrets": []}}, {"suggestion": {}}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    got = tables.read_cache(spark, f"{tmp_path}/c.jsonl").collect()
    assert [(r.content_hash, r.prompt_signature, r.secrets) for r in got] == [("h", "s", [])]
    assert tables.looks_like_json_lines("  {") and not tables.looks_like_json_lines("fqcn")


MAP = {"schemaVersion": "1", "framework": "asvs", "frameworkVersion": "4", "tagToControls": {"auth": [{"id": "2.1", "chapter": None}, {"id": "2.2"}], "crypto": [{"id": "2.1", "chapter": "V2", "chapterTitle": "Auth"}], "other": [{"id": "9.9"}]}}


def test_mapping_errors():
    about, rows = tables.parse_mapping(json.dumps(MAP))
    assert about["framework"] == "asvs" and len(rows) == 4
    for broken in ({"schemaVersion": "2"}, {"framework": " "}, {"tagToControls": {}}, {"tagToControls": {"a": []}}, {"tagToControls": {"a": [{"id": ""}]}}):
        with pytest.raises(ValueError):
            tables.parse_mapping(json.dumps(MAP | broken))


def test_settings():
    got, warnings = tables.read_config("outputMode: annotations\nfoo: 1\nminConfidence: 0.5", {"contentHash": True})
    assert got["outputMode"] == "csv" and got["minConfidence"] == 0.5 and got["contentHash"] and warnings == ["unknown setting foo"]
    assert tables.read_config("outputMode: sarif")[0]["securityOnly"] and not tables.read_config("outputMode: sarif\nincludeNonSecurity: true")[0]["securityOnly"]
    assert tables.suffixes_for("go", [".x", "go:_t.go", "java:Y.java"]) == [".x", "_t.go"]


def test_overrides_and_rules(spark):
    df = tables.read_overrides(spark, "overrides:\n- {fqcn: A, method: m, securityRelevant: true, tags: [x], unknown: 1}\n- {method: z}\n- {fqcn: A, note: n}\n")
    assert [(r.pos, r.fqcn, r.method, r.tags) for r in df.collect()] == [(0, "A", "m", ["x"]), (2, "A", None, None)]
    rules, digest = tables.read_rules("rules:\n- {id: a, category: T, anchors: [x], pattern: 'x(.)', entropyMin: 1}\n")
    assert rules[0].groups == 1 and len(digest) == 64
    with pytest.raises(ValueError):
        findings.Rule("b", "T", (), "(a)(b)")


def test_overrides_in_parts(spark, tmp_path):
    """Entries of a document in several files are numbered in their order by tasks; every character comes back."""
    odd = "".join(map(chr, (9, 10, 13, 0x22, 0x5C, 0x7F, 0x85, 0x9F, 0xA0, 0x2028, 0x2029, 0xFEFF, 0x1F600))) + ": - # {x}"
    rows = [(n, f"C{n}" if n % 9 else " ", None if n % 2 else odd, (True, False, None)[n % 3], None if n % 4 else ["a", odd, "yes"][: n % 5], odd, None) for n in range(400)]
    df = spark.createDataFrame(rows, "pos int, fqcn string, method string, security_relevant boolean, tags array<string>, display_name string, reason string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_overrides(df, f"{tmp_path}/o", "pos")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(f"{tmp_path}/o") if f.startswith("part")]) > 1
    got = tables.read_override_file(spark, f"{tmp_path}/o").drop("note").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [r for r in rows if r[0] % 9]
    # other layouts mean the same
    text = "# c\noverrides:\n- fqcn: A\n  note: '- {x}'\n- {fqcn: B,\n   tags: [x]}\n"
    (tmp_path / "p.yaml").write_text(text)
    assert tables.read_override_file(spark, f"{tmp_path}/p.yaml").collect() == tables.read_overrides(spark, text).collect()
    (tmp_path / "q.yaml").write_text("# c\noverrides:\n\n- {method: z}\n# - {fqcn: A}\n- {fqcn: B, tags: [1], note: n}\n")
    assert [(r.pos, r.fqcn, r.tags, r.note) for r in tables.read_override_file(spark, f"{tmp_path}/q.yaml").collect()] == [(1, "B", ["1"], "n")]
    documents.write_overrides(df.where("false"), f"{tmp_path}/e", "pos")
    assert tables.read_override_file(spark, f"{tmp_path}/e").collect() == []


def test_manual_responses(spark, tmp_path):
    (tmp_path / "s.response.txt").write_text('Sure {"className": "A", "methods": [{"methodName": "m", "securityRelevant": true}]} bye')
    df = spark.createDataFrame([("s", "A"), ("t", "B")], "file_stem string, fqcn string")
    got = {r.fqcn: r.suggestion for r in tables.read_manual_responses(df, str(tmp_path)).collect()}
    assert got["A"].methods[0].methodName == "m" and got["B"].className == "B" and got["B"].methods == []


# --- records


def ai(relevant=True, name=None, tags=(), reason=None, confidence=0.5, interaction=0.0):
    return Row(relevant=relevant, display_name=name, tags=list(tags) if tags is not None else None, reason=reason, confidence=confidence, interaction_score=interaction)


@pytest.mark.parametrize("a,rule,severity", [(None, "test-method", None), (ai(False), "test-method", None), (ai(tags=["security"]), "security-test", "5.0"), (ai(tags=["security", "crypto", "auth"]), "security/crypto", "6.5"), (ai(tags=["odd"]), "security/odd", "5.0")])
def test_rule_and_severity(spark, a, rule, severity):
    df = spark.createDataFrame([(a,)], f"ai {AI}")
    r = df.select(records.rule_id(F.col("ai")).alias("r"), records.severity(records.rule_id(F.col("ai")), F.col("ai.tags")).alias("s")).first()
    assert (r.r, r.s) == (rule, severity)


@pytest.mark.parametrize("tags,a,want", [([], None, None), (["Security"], ai(), "none"), (["SECURITY"], ai(False), "tag-only"), (["x"], ai(), "ai-only"), ([], ai(False), "none")])
def test_drift(spark, tags, a, want):
    df = spark.createDataFrame([(tags, a)], f"tags array<string>, ai {AI}")
    assert df.select(records.drift(F.col("tags"), F.col("ai")).alias("d")).first().d == want


def test_message_and_annotations(spark):
    rows = [(0, "p.A", "m", 3, ["security"], "", ai(True, "N", ["auth"], "why", 0.9, 0.85)), (1, "p.A", "n", 0, [], None, ai(False)), (2, "p.A", "o", 0, [], None, None), (3, "p.A", "q", 1, ["security"], None, ai(True, " ", [], " ", 0.0, 0.1))]
    df = spark.createDataFrame(rows, f"seq long, fqcn string, method string, begin_line int, tags array<string>, display_name string, ai {AI}")
    got = [r.m for r in df.orderBy("seq").select(records.message(F.col("fqcn"), F.col("method"), F.col("ai")).alias("m")).collect()]
    assert got[0].startswith('AI suggests: @DisplayName("N") @Tag("auth"). Reason: why. Interaction score: 0.85. Confidence: 90%. Assertions primarily')
    assert got[1:3] == ["p.A.n", "p.A.o"] and got[3] == "AI classifies as security-relevant. Interaction score: 0.10."
    a = [(r.seq, r.kind, r.line) for r in lines.annotations(df, "src/").orderBy("seq", "kind").collect()]
    assert [x[:2] for x in a] == [(0, 0), (0, 1), (3, 1)]
    assert a[0][2].startswith('::notice file=src/p/A.java,line=3,title=@DisplayName("") on p.A#m::')
    assert a[1][2] == '::warning file=src/p/A.java,line=3,title=N::Suggested @DisplayName: "N" · Suggested @Tag: auth · Reason: why. · Interaction score 0.9: assertions only verify method calls, not output values or state'
    assert a[2][2] == "::notice file=src/p/A.java,line=1,title=p.A#q::Security test"
    full = df.withColumns({"loc": F.lit(2), "content_hash": F.lit("h"), "source_root": F.lit("r/")})
    doc = json.loads(documents.sarif_document(documents.sarif_results(full), "1"))
    run = doc["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["security/auth", "empty-display-name", "security-test/placebo", "test-method", "test-method", "security-test"]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["security/auth", "empty-display-name", "security-test/placebo", "test-method", "security-test"]
    first = run["results"][0]
    assert first["properties"]["security-severity"] == "7.5" and first["locations"][0]["physicalLocation"]["region"] == {"startLine": 3}
    assert "region" not in run["results"][3]["locations"][0]["physicalLocation"] and "aiConfidence" not in run["results"][4]["properties"]
    j = json.loads(full.orderBy("seq").select(documents.json_row().alias("v")).first().v)
    assert j["aiTags"] == ["auth"] and j["displayName"] == "" and j["tagAiDrift"] == "none"
    plain = [r.l for r in full.orderBy("seq").select(lines.plain_line(source_root=True, ai=True, confidence=True, drift=True).alias("l")).collect()]
    assert plain[2] == "p.A, o, LOC=2, TAGS=-, DISPLAY=-, SRCROOT=r/, AI_SECURITY=-, AI_DISPLAY=-, AI_TAGS=-, AI_REASON=-, AI_INTERACTION_SCORE=-, AI_CONFIDENCE=-, TAG_AI_DRIFT=-"
    folder = "/tmp/evidence-%d" % os.getpid()
    names = documents.write_evidence(folder, full, "1", overrides="overrides: []\n")
    manifest = dict(reversed(x.split("  ")) for x in open(f"{folder}/manifest.sha256").read().splitlines())
    assert sorted(manifest) == names == ["inventory.csv", "meta.json", "overrides.yaml", "results.sarif"]
    assert all(hashlib.sha256(open(f"{folder}/{n}", "rb").read()).hexdigest() == h for n, h in manifest.items())
    audit = lines.audit_rows(full.withColumnsRenamed({"tags": "applied_tags", "display_name": "applied_display_name"}), datetime(2026, 1, 2, 3, 4, 5)).orderBy("method").first()
    assert len(audit) == 15 and audit.saved_at == "20260102-030405" and audit.tags_added == "security"


def test_status_and_desired_state(spark):
    cases = [(True, None, [], "PENDING_SAVE"), (False, None, [], "NO_AI"), (False, ai(False), [], "NOT_SECURITY"), (False, ai(tags=[]), [], "OK"), (False, ai(tags=["a"]), ["b"], "NEEDS_REVIEW"), (False, ai(tags=["a"]), ["a", "b"], "OK")]
    for pending, a, ref, want in cases:
        df = spark.createDataFrame([(pending, a, ref)], f"p boolean, ai {AI}, r array<string>")
        assert df.select(records.tag_status(F.col("p"), F.col("ai"), F.col("r")).alias("s")).first().s == want
    df = spark.createDataFrame([([], None, ["x"], "n"), (["a"], "d", ["x"], "n")], "tags array<string>, display_name string, ai_tags array<string>, ai_display_name string")
    got = records.desired_state(df, True).select("want_tags", "want_display_name", "promoted").collect()
    assert [tuple(r) for r in got] == [(["x"], "n", True), (["a"], "d", False)]
    assert not any(r.promoted for r in records.desired_state(df, False).collect())


# --- coverage


def test_coverage(spark):
    _, rows = tables.parse_mapping(json.dumps(MAP))
    mapping = spark.createDataFrame(rows, "tag string, tag_pos int, pos int, control_id string, chapter string, chapter_title string")
    tests = [(0, "A", "src", None, ["auth", "Auth"], None), (1, "A", "low", None, [], ai(tags=["auth"], confidence=0.3)), (2, "A", "model", None, ["nope"], ai(tags=["crypto"], confidence=0.9)), (3, "A", "both", "d", ["crypto"], ai(tags=["auth", "crypto"], confidence=0.8)), (4, "A", "no", None, [], ai(False, tags=["auth"]))]
    df = spark.createDataFrame(tests, f"seq long, fqcn string, method string, display_name string, tags array<string>, ai {AI}")
    c = coverage.tests_by_control(df, mapping, "asvs", 0.8).cache()
    got = {r.control: (r.chapter, r.chapter_title, [(t.method, t.tag_source, t.confidence, t.tags) for t in r.tests]) for r in coverage.report(c, mapping, "asvs").collect()}
    both = ("both", "both", 1.0, ["crypto", "auth"])
    assert got["ASVS-2.1"] == ("V2", "Auth", [("src", "source", 1.0, ["auth"]), ("model", "ai", 0.9, ["crypto"]), both, both])
    assert got["ASVS-2.2"][2] == [("src", "source", 1.0, ["auth"]), both]
    assert [r.control for r in coverage.gaps(c, mapping, "asvs").collect()] == ["ASVS-9.9"]
    assert tuple(coverage.statistics(c, mapping, "asvs").first()) == (3, 2, 1, 66.67)
    doc = json.loads(documents.coverage_document(coverage.report(c, mapping, "asvs"), coverage.gaps(c, mapping, "asvs"), coverage.statistics(c, mapping, "asvs"), "asvs", "4", "", "1"))
    assert doc["gaps"] == ["ASVS-9.9"] and doc["statistics"]["coveragePercent"] == 66.67
    none = coverage.tests_by_control(df.where("false"), mapping, "asvs")
    assert tuple(coverage.statistics(none, mapping, "asvs").first()) == (3, 0, 3, 0.0)


# --- suggestions


def test_first_suggestion_wins(spark):
    classes = spark.createDataFrame([("A", [("m", True, None, None, None, 0.1, None), ("m", False, None, [], None, 0.2, 0.0), (" ", True, None, [], None, 0.0, 0.0), (None, True, None, [], None, 0.0, 0.0)])], "fqcn string, methods array<struct<methodName:string,securityRelevant:boolean,displayName:string,tags:array<string>,reason:string,confidence:double,interactionScore:double>>")
    s = suggestions.exploded(classes)
    assert s.count() == 2
    m = spark.createDataFrame([("A", "m"), ("A", "x")], "fqcn string, method string")
    got = {r.method: r.ai for r in suggestions.join_suggestions(m, s).collect()}
    assert got["m"].confidence == 0.1 and got["m"].tags == [] and got["x"] is None


def test_overrides(spark):
    m = spark.createDataFrame([("A", "m", ai(True, "n", ["t"], "r", 0.4, 0.9)), ("A", "x", None), ("B", "y", None), ("C", "z", ai(False)), ("C", "w", None)], f"fqcn string, method string, ai {AI}")
    o = spark.createDataFrame([(0, "A", "m", None, ["first"], None, None), (1, "A", "m", None, None, "new", None), (2, "C", None, True, None, None, "c1"), (3, "C", None, None, ["k"], None, None), (4, "C", "w", False, None, None, None), (5, None, "q", True, None, None, None)], "pos int, fqcn string, method string, security_relevant boolean, tags array<string>, display_name string, reason string")
    got = {r.method: r.ai for r in suggestions.overridden(m, o).collect()}
    assert tuple(got["m"]) == (True, "new", ["t"], "r", 1.0, 0.9)
    assert tuple(got["x"]) == (False, None, [], None, 0.0, 0.0) and got["y"] is None
    assert tuple(got["z"]) == (False, None, ["k"], None, 0.0, 0.0) and tuple(got["w"]) == (False, None, [], None, 0.0, 0.0)


def test_cache(spark):
    c = spark.createDataFrame([(0, "h", "s", "old", "v"), (1, "h", "t", "stale", None), (2, "g", None, "legacy", "v"), (3, "k", "s", "fresh", "v")], "seq long, content_hash string, prompt_signature string, suggestion string, secrets string")
    k = spark.createDataFrame([("h",), ("g",), ("k",), ("z",), (None,)], "content_hash string")
    got = {r.content_hash: (r.suggestion, r.hit) for r in suggestions.join_cache(k, c, "s").collect()}
    assert got == {"h": (None, False), "g": ("legacy", True), "k": ("fresh", True), "z": (None, False), None: (None, False)}
    assert {r.content_hash: r.secrets for r in suggestions.join_cached_verdicts(k, c, "s").collect()} == {"h": None, "g": None, "k": "v", "z": None, None: None}
    assert {r.content_hash for r in suggestions.cache_misses(k, c, "s").collect()} == {"h", "z", None}


def test_model_is_asked_once_for_each_content(spark, tmp_path):
    log = tmp_path / "asked"

    def model(name, source):
        with open(log, "a") as f:
            f.write("x\n")
        return json.dumps({"className": name, "methods": []})

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"fqcn": "A", "source": "s"}\n{"fqcn": "B", "source": "s"}\n{"fqcn": "C", "source": "t"}\n')
    run = lambda: incremental.scan_stream(spark, f"{tmp_path}/in", f"{tmp_path}/cache", f"{tmp_path}/cp", model, "sig").awaitTermination()
    run()
    assert log.read_text().count("x") == 2
    (tmp_path / "in/b.json").write_text('{"fqcn": "D", "source": "t"}\n{"fqcn": "E", "source": "u"}\n')
    run()
    assert log.read_text().count("x") == 3
    assert incremental.read_kept(spark, f"{tmp_path}/cache").count() == 3


def test_upsert(spark):
    s = "pos int, fqcn string, method string, reason string"
    old = spark.createDataFrame([(0, "A", "m", "o"), (1, "A", None, "c"), (2, "B", "n", "o")], s)
    new = spark.createDataFrame([(0, "A", None, "new"), (1, "Z", "z", "added")], s)
    assert [tuple(r) for r in suggestions.upserted(old, new).orderBy("pos").collect()] == [(0, "A", "m", "o"), (1, "A", None, "new"), (2, "B", "n", "o"), (3, "Z", "z", "added")]


# --- reconciliation and write-back


def test_guard():
    reconcile.guard(5, -1)
    reconcile.guard(0, 1)
    for n, limit in ((0, 0), (3, 3), (4, 3)):
        with pytest.raises(reconcile.TooManyMismatches):
            reconcile.guard(n, limit)


def test_patch_java_is_idempotent():
    src = "package a;\n\nclass T {\n    @Test\n    @Tag(\"old\")\n    void m() { }\n\n    @Test void n() { }\n}\n"
    want = [patch.Change("m", 4, ("b", "a"), "Name"), patch.Change("n", 8, ())]
    out, n = patch.patch_java(src, want)
    assert n == 1
    assert '    @Test\n    @DisplayName("Name")\n    @Tag("a")\n    @Tag("b")\n    void m() { }' in out and "import org.junit.jupiter.api.Tag;" in out and "old" not in out
    shift = out.count("\n", 0, out.index("@Test")) + 1 - 4
    again, n = patch.patch_java(out, [patch.Change(c.method, c.begin_line + shift + (3 - 2 if c.method == "n" else 0), c.tags, c.display_name) for c in want])
    assert (again, n) == (out, 0)
    gone, _ = patch.patch_java(out, [patch.Change("m", 4 + shift, (), "")])
    assert "Tag(" not in gone and "DisplayName(" not in gone


def test_patch_csharp():
    src = "using Xunit;\nclass C {\n    [Fact]\n    [Trait(\"Tag\", \"old\")]\n    public void M() {}\n}\n"
    out, n = patch.patch_csharp(src, [patch.Change("M", 3, ("x",), "Shown")])
    assert n == 1 and '    [Fact(DisplayName = "Shown")]\n    [Trait("Tag", "x")]\n    public void M()' in out and "old" not in out
    assert patch.patch_csharp(out, [patch.Change("M", 3, ("x",), "Shown")]) == (out, 0)


# --- findings


def test_findings(spark):
    text = 'a\ntoken = "0123456789abcdef0123456789abcdef01234567" token = "0123456789abcdef0123456789abcdef01234567"\ntoken = "' + "0" * 40 + '"\npassword: "hunter22x"'
    df = spark.createDataFrame([("f", text), ("g", "nothing"), ("h", None)], "file_path string, text string")
    got = findings.candidates(df).orderBy("begin_line", "begin_column").collect()
    assert [(r.rule_id, r.begin_line, r.begin_column, r.end_line) for r in got] == [("hex-token", 2, 10, 2), ("hex-token", 2, 61, 2), ("password-assignment", 4, 12, 4)]
    m = spark.createDataFrame([("f", "A", "outer", 1, 9), ("f", "A", "inner", 2, 3)], "file_path string, fqcn string, method string, begin_line int, end_line int")
    at = findings.at_methods(findings.candidates(df), m)
    assert sorted(r.method for r in at.collect()) == ["inner", "inner", "outer"]
    rows = documents.findings_rows(at.withColumnRenamed("file_path", "file"))
    assert rows.columns == list(documents.FINDING_COLUMNS) and rows.first().snippet_masked.count("*") > 4
    scored = spark.createDataFrame([(0, "f", 2, "hex-token", "0123456789", 0.85, "db"), (1, "f", 0, "x", "0123456789", None, None)], "seq long, file_uri string, begin_line int, rule_id string, value string, credibility_score double, endpoint string")
    r = [json.loads(x.result) for x in documents.secret_results(scored).orderBy("seq").collect()]
    assert r[0]["level"] == "error" and r[0]["properties"]["security-severity"] == "8.5" and "Likely authenticates: db." in r[0]["message"]["text"]
    assert r[1]["level"] == "warning" and "unverified" in r[1]["message"]["text"] and documents.rule_document("secret/hex-token")["name"] == "SecretHexToken"


@settings(max_examples=200, deadline=None)
@given(st.text("abcx", max_size=40), st.lists(st.text("abcx", max_size=4), max_size=5))
def test_automaton(text, words):
    got = sorted(T.Automaton(words).search(text))
    assert got == sorted((w, i) for w in set(words) if w for i in range(len(text)) if text.startswith(w, i))
    assert [i + len(w) for w, i in T.Automaton(words).search(text)] == sorted(i + len(w) for w, i in got)


def test_multi_pattern(spark):
    df = spark.createDataFrame([("xabcx",), ("none",), (None,)], "t string")
    got = [r.m for r in df.select(T.multi_pattern(F.col("t"), ["ab", "abc", "bc", ""]).alias("m")).collect()]
    assert sorted(tuple(x) for x in got[0]) == [("ab", 1), ("abc", 1), ("bc", 2)] and got[1:] == [[], []]


# --- scalars


def test_texts(spark):
    assert T.first_json_object('x {"a": "}\\"", "b": {}} {') == '{"a": "}\\"", "b": {}}' and T.first_json_object("{") is None and T.first_json_object(None) is None
    assert T.render("{a} {b} {c} {", {"a": "{b}", "b": "B"}) == "{b} B {c} {"
    assert T.template_problems("triage", "{className} {candidates} {x} JSON") == ["unknown {x}"]
    assert T.template_problems("classification", "{className}") == ["missing {classSource}", "missing {methods}", "the answer's format isn't named"]
    assert (T.retry_after("7", None), T.retry_after(None, "Please wait 9 seconds"), T.retry_after("x", "no")) == (7, 9, 60)
    assert json.loads(T.json_line("INFO", 'a"\n', run_id=None)) == {"level": "INFO", "message": 'a"\n'}
    df = spark.createDataFrame([(["m", "n"], [("r", 3, "a*b")])], "names array<string>, c array<struct<rule_id:string,line:int,snippet:string>>")
    r = df.select(T.method_list(F.col("names")).alias("m"), T.candidate_list(F.col("c")).alias("c")).first()
    assert (r.m, r.c) == ("- m\n- n", "[0] r line 3 a*b")


def test_columns(spark):
    lit = F.lit
    assert one(spark, C.split_list(lit(" a;;b ; "))) == ["a", "b"] and one(spark, C.split_list(lit(None).cast("string"))) == []
    assert [one(spark, C.parse_boolean(lit(x))) for x in ("", "yes", " TRUE ")] == [None, False, True]
    assert [one(spark, C.parse_int(lit(x))) for x in ("12", " 7 ", "x", "1.5")][:3] == [12, 7, 0]
    assert one(spark, C.parse_double(lit("1e2"))) == 100.0 and one(spark, C.parse_double(lit("x"))) is None
    assert one(spark, C.tag_difference(F.array(lit("b"), lit("a"), lit("a")), F.array(lit("b")))) == "a;a"
    assert one(spark, C.entropy(lit("0123456789abcdef"))) == pytest.approx(4.0) and one(spark, C.entropy(lit("aaaa"))) == 0 and one(spark, C.entropy(lit(""))) == 0
    assert [one(spark, C.csv_escape(lit(x))) for x in ("a", "a,b", 'q"', "=x", "a\nb")] == ["a", '"a,b"', '"q"""', '"=x"', '"a\nb"']
    assert one(spark, C.rule_name(lit("security/access-control"))) == "SecurityAccessControl"
    assert one(spark, C.masked(lit("abcdefghij"))) == "ab******ij" and one(spark, C.masked(lit("short"))) == "*****"
    assert one(spark, C.file_stem(lit("/r/a/b/X.test.ts"), "/r", [".ts", ".test.ts"])) == "a.b.X" and one(spark, C.file_stem(lit("/r/a.x.go"), "/r", [".java"])) == "a.x"
    assert one(spark, C.prompt_signature(lit("a"), lit("b"))) == hashlib.sha256(b"a\0b").hexdigest()
    assert one(spark, C.config_hash({"b": lit(None), "a": lit(1)})) == hashlib.sha256(b"a=1\nb=\n").hexdigest()
    assert json.loads(documents.receipt({"x": None, "y": 1}, {"b": None, "a": 1}, True, False)) == {"schemaVersion": "2", "inputs": {"y": 1}, "configHash": hashlib.sha256(b"a=1\nb=\n").hexdigest(), "deterministicReplay": False}


@settings(max_examples=25, deadline=None)
@given(st.text("abcé🙂", max_size=20))
def test_entropy_of_code_points(spark, s):
    n = len(s)
    want = -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0
    assert one(spark, C.entropy(F.lit(s))) == pytest.approx(want, abs=1e-9)


def test_circuit_stays_open(spark):
    df = spark.createDataFrame([("w", datetime(2026, 1, 1, 0, 0, s)) for s in (0, 10, 20, 59)] + [("w", datetime(2026, 1, 1, 1)), ("v", datetime(2026, 1, 1))], "worker string, ts timestamp")
    got = [(r.n_recent, r.open) for r in aggregates.circuit_states(df, 3, 30).where("worker = 'w'").orderBy("ts").collect()]
    assert got == [(1, False), (2, False), (3, True), (1, True), (1, True)]


def test_manifest(spark, tmp_path):
    for n in ("b.txt", "a.txt", "x.signed", "manifest.sha256"):
        (tmp_path / n).write_text(n)
    got = documents.manifest(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("name").collect()
    assert [r.line for r in got] == [f"{hashlib.sha256(n.encode()).hexdigest()}  {n}" for n in ("a.txt", "b.txt")]
