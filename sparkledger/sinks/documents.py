"""Inventories as JSON and SARIF, coverage reports, caches, findings, manifests, receipts and evidence folders."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timezone
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import records
from ..sources import tables
from . import lines

TOOL, MANIFEST = "sparkledger", "manifest.sha256"
#: Characters that JSON leaves as they are but YAML takes for line breaks, or refuses.
UNPRINTED = (*range(0x7F, 0xA0), 0x2028, 0x2029, 0xFEFF, 0xFFFE, 0xFFFF)
# Keys, rule ids and message sentences of the result format, on which consumers match.
SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
FINDING_COLUMNS = ("file", "fqcn", "method", "begin_line", "begin_column", "end_line", "rule_id", "category", "detector_id", "snippet_masked", "credibility_score", "endpoint", "rationale")
HELP = {
    "test-method": "A test that no model called security-relevant, or that no model was asked about. Nothing needs to be done.",
    "empty-display-name": "The test has no name in reports. Give it one that says what it verifies.",
    "security-test/placebo": "The assertions only verify that methods were called. Assert on results, exceptions or state as well.",
}
DESCRIPTIONS = {"test-method": "JUnit test method", "security-test": "Security-relevant test method", "empty-display-name": "@DisplayName annotation with empty string value", "security-test/placebo": "Security test with interaction-only assertions (placebo test)"}
TAGS = {"test-method": ["test"], "security-test": ["security"], "empty-display-name": ["annotation", "quality"], "security-test/placebo": ["security", "placebo", "test-quality"]}


def json_row(content_hash: bool = True, ai: bool = True, confidence: bool = True, drift: bool = True) -> Column:
    """One object for a row; absent fields are left out, lists stay lists."""
    a = F.col("ai")
    fields = [F.col("fqcn"), F.col("method"), F.col("loc"), F.col("tags"), F.col("display_name").alias("displayName")]
    if content_hash:
        fields.append(F.col("content_hash").alias("contentHash"))
    if ai:
        fields += [a["relevant"].alias("aiSecurityRelevant"), a["display_name"].alias("aiDisplayName"), a["tags"].alias("aiTags"), a["reason"].alias("aiReason"), a["interaction_score"].alias("aiInteractionScore")]
        if confidence:
            fields.append(a["confidence"].alias("aiConfidence"))
        if drift:
            fields += [records.drift(F.col("tags"), a).alias("tagAiDrift"), F.when(a.isNotNull(), C.tag_difference(F.col("tags"), a["tags"])).alias("tagsAdded"), F.when(a.isNotNull(), C.tag_difference(a["tags"], F.col("tags"))).alias("tagsRemoved")]
    return F.to_json(F.struct(*fields))


def write_json_lines(df: DataFrame, path: str, **groups: bool) -> None:
    df.select(json_row(**groups).alias("value")).write.text(path)


def _result(rule: Column, level: Column, text: Column, location: Column, properties: Column) -> Column:
    return F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(location).alias("locations"), properties.alias("properties"))


def sarif_results(df: DataFrame, prefix: str = "", ai_enabled: bool = True, confidence: bool = True, scores: bool = True) -> DataFrame:
    """(seq, nth, rule_id, result as JSON): of each row its own result, one for an empty name and one for a placebo test."""
    ai = F.col("ai")
    text = lambda c: c.cast("string")
    region = F.when(F.col("begin_line") > 0, F.struct(F.col("begin_line").alias("startLine")))
    logical = F.struct(F.concat("fqcn", F.lit("."), "method").alias("fullyQualifiedName"), F.lit("member").alias("kind"))
    location = F.struct(F.struct(F.struct(C.artifact_uri(F.col("fqcn"), prefix).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"), F.array(logical).alias("logicalLocations"))
    rule = records.rule_id(ai)
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ";"))
    use = ai.isNotNull() & F.lit(ai_enabled)
    nothing, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def properties(content_hash: Column, severity: Column, full: bool, score: Column) -> Column:
        when = lambda c: F.when(use, c) if full else F.lit(None)
        return F.struct(
            F.col("loc"), text(content_hash).alias("contentHash"), tags.alias("sourceTags"),
            when(ai["relevant"]).cast("boolean").alias("aiSecurityRelevant"), text(when(ai["display_name"])).alias("aiDisplayName"),
            text(when(F.when(F.size(ai["tags"]) > 0, F.array_join(ai["tags"], ";")))).alias("aiTags"), text(when(F.when(records.present(ai["reason"]), ai["reason"]))).alias("aiReason"),
            score.cast("double").alias("aiInteractionScore"), (when(ai["confidence"]) if confidence else number).cast("double").alias("aiConfidence"),
            text(when(records.drift(F.col("tags"), ai))).alias("tagAiDrift"), text(when(C.tag_difference(F.col("tags"), ai["tags"]))).alias("tagsAdded"),
            text(when(C.tag_difference(ai["tags"], F.col("tags")))).alias("tagsRemoved"), text(severity).alias("security-severity"),
        )

    own = _result(rule, records.level(rule), records.message(F.col("fqcn"), F.col("method"), ai, scores, confidence), location, properties(F.col("content_hash"), records.severity(rule, F.coalesce(ai["tags"], F.array().cast("array<string>"))), True, F.when(use, ai["interaction_score"])))
    where = F.concat("fqcn", F.lit("."), "method")
    unnamed = _result(F.lit("empty-display-name"), F.lit("note"), F.concat(F.lit('@DisplayName("") on '), where, F.lit(" is explicitly empty — the test will appear unnamed in CI reports and audit evidence packages.")), location, properties(nothing, nothing, False, number))
    sure = F.when((ai["confidence"] > 0) & F.lit(scores and confidence), F.format_string(" Confidence: %.0f%%.", ai["confidence"] * 100)).otherwise("")
    placebo_text = F.concat(F.format_string("Interaction score: %.2f (threshold: %.1f). This security test only verifies that methods were called, not what values they returned or what state they produced.", ai["interaction_score"], F.lit(records.PLACEBO)), sure)
    placebo = _result(F.lit("security-test/placebo"), F.lit("warning"), placebo_text, location, properties(nothing, F.lit("6.0"), False, ai["interaction_score"]))
    made = F.array(F.struct(F.lit(0).alias("nth"), own.alias("r")), F.when(records.empty_display_name(F.col("display_name")), F.struct(F.lit(1).alias("nth"), unnamed.alias("r"))), F.when(records.placebo(ai), F.struct(F.lit(2).alias("nth"), placebo.alias("r"))))
    return df.select("seq", F.explode(F.array_compact(made)).alias("x")).select("seq", "x.nth", F.col("x.r.ruleId").alias("rule_id"), F.to_json("x.r").alias("result"))


def secret_results(found: DataFrame) -> DataFrame:
    """(seq, nth, rule_id, result) of findings: seq, file_uri, begin_line, rule_id, value, credibility_score, endpoint."""
    s = F.col("credibility_score")
    credible = F.when(s.isNull(), " — unverified (no AI triage).").otherwise(F.format_string(" — credibility %.2f.", s))
    opens = F.when(records.present(F.col("endpoint")), F.concat(F.lit(" Likely authenticates: "), "endpoint", F.lit("."))).otherwise("")
    text = F.concat(F.lit("[secret] Potential "), F.replace(F.col("rule_id"), F.lit("-"), F.lit(" ")), credible, opens, F.lit(" Rule: "), "rule_id", F.lit(". Snippet: "), C.masked(F.col("value")))
    location = F.struct(F.struct(F.struct(F.col("file_uri").alias("uri")).alias("artifactLocation"), F.when(F.col("begin_line") > 0, F.struct(F.col("begin_line").alias("startLine"))).alias("region")).alias("physicalLocation"))
    rule = F.concat(F.lit("secret/"), "rule_id")
    result = _result(rule, records.secret_level(s), text, location, F.struct(F.lit(0).alias("loc"), records.secret_severity(s).alias("security-severity")))
    return found.select("seq", F.lit(3).alias("nth"), rule.alias("rule_id"), F.to_json(result).alias("result"))


def sarif_rules(results: DataFrame) -> DataFrame:
    """(rule_id, first) of each rule, in the order in which results name them."""
    return results.groupBy("rule_id").agg(F.min(F.struct("seq", "nth")).alias("first"))


def rule_document(rule: str) -> dict:
    secret = rule.startswith("secret/")
    parts = rule.split("/", 1)
    name = "".join(p[:1].upper() + p[1:] for p in rule.replace("-", "/").split("/") if p)
    tags = TAGS.get(rule) or (["security", "secret"] if secret else parts if len(parts) == 2 else ["security"])
    text = "Credential candidate in scanned source" if secret else DESCRIPTIONS.get(rule) or (f"Security test: {parts[1]}" if parts[0] == "security" and len(parts) == 2 else rule)
    helped = "Rotate a confirmed credential and move it out of the source." if secret else HELP.get(rule, "A model called this test security-relevant. Review the suggested name and tags.")
    return {"id": rule, "name": name, "shortDescription": {"text": text}, "properties": {"tags": tags}, "help": {"text": helped}}


def sarif_ends(results: DataFrame, version: str) -> tuple[str, str]:
    """What stands before and after the results of a document; rules are few."""
    rules = [rule_document(r.rule_id) for r in sarif_rules(results).orderBy("first").collect()]
    empty = json.dumps({"$schema": SCHEMA_URI, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": TOOL, "version": version, "rules": rules}}, "results": []}]}, ensure_ascii=False)
    return empty[:-4], empty[-4:]


def sarif_document(results: DataFrame, version: str) -> str:
    """One run as a text for the driver; write_sarif() is for any number of results."""
    head, tail = sarif_ends(results, version)
    return head + ",".join(r.result for r in results.orderBy("seq", "nth").toLocalIterator()) + tail


def comma_separated(df: DataFrame, *order: str) -> DataFrame:
    """Values with a comma before all but the first in the order."""
    first = df.agg(F.min(F.struct(*order)).alias("m")).first().m
    is_first = F.lit(True)
    for c in order:
        is_first = is_first & (F.col(c).eqNullSafe(F.lit(first[c])) if first is not None else F.lit(False))
    return df.withColumn("value", F.when(is_first, F.col("value")).otherwise(F.concat(F.lit(","), "value")))


def write_sarif(results: DataFrame, path: str, version: str) -> None:
    """The document as text parts in the order of their names, one result on a line; results never pass through the driver."""
    head, tail = sarif_ends(results, version)
    lines.write_ordered(comma_separated(results.select("seq", "nth", F.col("result").alias("value")), "seq", "nth"), path, [head], [tail])


def coverage_ends(gaps: DataFrame, statistics: DataFrame, framework: str, version: str, source: str, tool_version: str) -> tuple[str, str]:
    """What stands before and after the controls of a coverage document; controls of a framework are few."""
    s = statistics.first()
    row = {"schemaVersion": "1", "generatedAt": datetime.now(timezone.utc).isoformat(), "toolVersion": tool_version, "framework": framework, "frameworkVersion": version, "source": source}
    rest = {"gaps": [g.control for g in gaps.orderBy("control").collect()], "statistics": {"totalControls": s.total, "coveredControls": s.covered, "uncoveredControls": s.uncovered, "coveragePercent": s.percent}}
    return json.dumps(row, ensure_ascii=False)[:-1] + ', "coverage": {', "}, " + json.dumps(rest, ensure_ascii=False)[1:]


def coverage_pieces(report: DataFrame) -> DataFrame:
    """(control, part, value): the text of each control's parts, which joined in their order are the members of an object."""
    tests = F.transform("tests", lambda t: F.to_json(F.struct(t["fqcn"].alias("fqcn"), t["method"].alias("method"), t["display_name"].alias("displayName"), t["tags"].alias("tags"), t["tag_source"].alias("tagSource"), t["confidence"].alias("confidence"))))
    ends = report.groupBy("control").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    about = F.to_json(F.struct("chapter", F.col("chapter_title").alias("chapterTitle")))
    # {"k":"name"} holds the quoted name from its sixth character; {} or {"chapter":..} the fields before the tests
    key = F.substring(F.to_json(F.struct(F.col("control").alias("k"))), 6, 1 << 30)
    opened = F.concat(F.expr("left(_key, length(_key) - 1)"), F.lit(": "), F.when(F.col("_about") == "{}", "{").otherwise(F.concat(F.expr("left(_about, length(_about) - 1)"), F.lit(","))), F.lit('"tests":['))
    made = report.join(ends, "control").withColumns({"_key": key, "_about": about, "_tests": F.array_join(tests, ",")})
    value = F.concat(F.when(F.col("part") == F.col("first"), opened).otherwise(","), F.col("_tests"), F.when(F.col("part") == F.col("last"), "]}").otherwise(""))
    return made.select("control", "part", "first", value.alias("value"))


def coverage_rows(report: DataFrame) -> DataFrame:
    """Pieces with a comma before each control but the first."""
    pieces = coverage_pieces(report)
    least = pieces.agg(F.min("control")).first()[0]
    starts = (F.col("part") == F.col("first")) & (F.col("control") != F.lit(least))
    return pieces.select("control", "part", F.when(starts, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))


def coverage_document(report: DataFrame, gaps: DataFrame, statistics: DataFrame, framework: str, version: str, source: str, tool_version: str) -> str:
    """The document as a text for the driver; write_coverage() is for any number of tests."""
    head, tail = coverage_ends(gaps, statistics, framework, version, source, tool_version)
    return head + "".join(r.value for r in coverage_rows(report).orderBy("control", "part").toLocalIterator()) + tail


def write_coverage(report: DataFrame, gaps: DataFrame, statistics: DataFrame, path: str, framework: str, version: str, source: str, tool_version: str) -> None:
    """The document as text parts in the order of their names; tests never pass through the driver."""
    head, tail = coverage_ends(gaps, statistics, framework, version, source, tool_version)
    lines.write_ordered(coverage_rows(report), path, [head], [tail])


def write_cache(entries: DataFrame, path: str) -> None:
    """One object on a line for each class: contentHash, promptSignature, suggestion."""
    entries.select("contentHash", "promptSignature", "suggestion").write.json(path)


def write_overrides(df: DataFrame, path: str, *order: str) -> None:
    """An override document of rows (fqcn, method, security_relevant, tags, display_name, reason) in the order of some columns, one entry on a line; absent fields are left out."""
    text = F.to_json(F.struct("fqcn", "method", F.col("security_relevant").alias("securityRelevant"), "tags", F.col("display_name").alias("displayName"), "reason"))
    for c in UNPRINTED:
        text = F.replace(text, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    lines.write_ordered(df.select(*order, F.concat(F.lit("- "), text).alias("value")), path, [tables.OVERRIDES_HEAD])


def write_archive(rows: DataFrame, path: str) -> bool:
    """Prompts and answers as JSON lines; nothing is written if there are none."""
    if rows.isEmpty():
        return False
    full = rows.withColumns({"contentHash": F.lit(None).cast("string"), "promptTokens": F.lit(-1).cast("long"), "responseTokens": F.lit(-1).cast("long")})
    full.select("contentHash", "fqcn", "promptTokens", "responseTokens", "prompt", "response", "modelId", "timestampUtc").write.option("ignoreNullFields", "false").json(path)
    return True


def findings_rows(found: DataFrame, detector: str = TOOL) -> DataFrame:
    """The documented columns, in their order; values only as masked snippets."""
    have = found.withColumns({"snippet_masked": C.masked(F.col("value")), "detector_id": F.lit(detector)})
    return have.select(*[(F.col(c) if c in have.columns else F.lit(None).cast("string")).alias(c) for c in FINDING_COLUMNS])


def write_findings(found: DataFrame, path: str, detector: str = TOOL) -> None:
    findings_rows(found, detector).write.option("header", True).option("escape", '"').csv(path)


def manifest(files: DataFrame, own_name: str = MANIFEST) -> DataFrame:
    """(name, sha256, line) of files as binaryFile reads them, but for the manifest itself and signed files."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256")).where((F.col("name") != own_name) & ~F.endswith("name", F.lit(".signed"))).withColumn("line", F.concat("sha256", F.lit("  "), "name"))


def receipt(inputs: Mapping[str, object], settings: Mapping[str, object], ai_enabled: bool, cache_file: bool) -> str:
    """What a run depended on, with a digest of its settings; absent values are left out."""
    text = "".join(f"{k}={'' if settings[k] is None else settings[k]}\n" for k in sorted(settings))
    row = {"schemaVersion": "2", "inputs": {k: v for k, v in inputs.items() if v is not None}, "configHash": hashlib.sha256(text.encode()).hexdigest(), "deterministicReplay": records.deterministic_replay(ai_enabled, cache_file)}
    return json.dumps(row, ensure_ascii=False)


def write_evidence(folder: str, df: DataFrame, version: str, overrides: str | None = None, archive: DataFrame | None = None, sign: Callable[[bytes], str] | None = None) -> list[str]:
    """A folder on the driver with SARIF, CSV, overrides, archived answers, a description and a manifest of all of them.

    Each is one file, as an auditor expects, so rows pass through the driver, but one at a time and never as a whole text. sign: given the
    manifest's bytes returns a trailer, which is written beside it as manifest.sha256.signed.
    """
    os.makedirs(folder)
    digests: dict[str, str] = {}

    def put(name: str, texts: Iterable[str]) -> None:
        digest = hashlib.sha256()
        with open(os.path.join(folder, name), "wb") as f:
            for text in texts:
                data = text.encode()
                digest.update(data)
                f.write(data)
        digests[name] = digest.hexdigest()

    results = sarif_results(df)
    head, tail = sarif_ends(results, version)
    ordered = comma_separated(results.select("seq", "nth", F.col("result").alias("value")), "seq", "nth").orderBy("seq", "nth")
    put("results.sarif", chain([head], (r.value for r in ordered.toLocalIterator()), [tail]))
    groups = {"content_hash": True, "ai": True, "confidence": True, "drift": True}
    rows = df.orderBy("seq").select(lines.csv_line(**groups).alias("v")).toLocalIterator()
    put("inventory.csv", chain([",".join(lines.csv_columns(**groups)) + "\n"], (f"{r.v}\n" for r in rows)))
    if overrides is not None:
        put("overrides.yaml", [overrides])
    if archive is not None and not archive.isEmpty():
        put("ai-responses.jsonl", (f"{r.v}\n" for r in archive.select(F.to_json(F.struct("*")).alias("v")).toLocalIterator()))
    put("meta.json", [json.dumps({"tool": TOOL, "toolVersion": version})])
    names = sorted(digests)
    listed = "".join(manifest_lines(digests))
    with open(os.path.join(folder, MANIFEST), "w", encoding="utf-8", newline="") as f:
        f.write(listed)
    if sign is not None:
        with open(os.path.join(folder, MANIFEST + ".signed"), "w", encoding="utf-8", newline="") as f:
            f.write(listed + sign(listed.encode()))
    return names


def manifest_lines(digests: Mapping[str, str]) -> list[str]:
    """A manifest's lines in the order of names."""
    return [f"{digests[n]}  {n}\n" for n in sorted(digests)]


def write_prompts(prompts: DataFrame, folder: str) -> DataFrame:
    """(file_stem, prompt) as one text file for each class under folder/<stem>.prompt, through Spark's writer: partitioned by stem."""
    prompts.select("file_stem", F.col("prompt").alias("value")).repartition("file_stem").write.partitionBy("file_stem").text(folder)
    return prompts.select("file_stem")


def tee(df: DataFrame, *sinks) -> None:
    """Several sinks over the same rows, which are computed once."""
    kept = df.persist()
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()
