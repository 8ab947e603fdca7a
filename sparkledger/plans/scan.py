"""A whole scan: from source trees to inventories, reports, caches and receipts.

Walk, scan, group by class, look the class's digest up, ask a model about the rest, put human overrides over its answers; then rows go
to coverage as they are, and filtered to the inventory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coverage, findings, records, suggestions
from ..sinks import documents, lines
from ..sources import scanners, tables

PROMPT = "Class {className}\n\nTests:\n{methods}\n\nAnswer with one JSON object.\n\n{classSource}\n"


@dataclass
class Inputs:
    """What a run may have beside its settings. cache, overrides and mapping are rows as their readers give them; rules are of the catalogue."""

    model: Callable[[str, str], str] | None = None
    prompt: str = PROMPT
    cache: DataFrame | None = None
    overrides: DataFrame | None = None
    mapping: DataFrame | None = None
    framework: str = ""
    rules: Sequence[findings.Rule] = field(default_factory=lambda: findings.RULES)


def found_in(spark: SparkSession, roots: Sequence[str], settings: Mapping[str, object], plugins: Mapping[str, scanners.Plugin] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, scanned) of all roots: rows of every plug-in that takes a file, with the root's number."""
    files = scanned = None
    for n, root in enumerate(roots):
        own = tables.read_files(spark, root, []).withColumn("root", F.lit(n))
        rows = scanners.scan_tree(own, root, list(settings.get("fileSuffixes") or ()), list(settings.get("plugins") or ()), list(settings.get("testMarkers") or ()), plugins).withColumns({"root": F.lit(n), "source_root": F.lit(root)})
        files, scanned = (own, rows) if files is None else (files.union(own), scanned.union(rows))
    if files is None:
        raise ValueError("no root to scan")
    return files, scanned


def classes_of(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """(root, fqcn, methods, source, content_hash): the first file with a class stands for it; methods in their order."""
    rows = scanned.where("method is not null")
    order = F.struct("file_path", "seq")
    grouped = rows.groupBy("root", "fqcn").agg(F.min_by("file_path", order).alias("file_path"), F.sort_array(F.collect_list(F.struct("file_path", "seq", "method"))).alias("found"))
    sources = scanners.class_sources(rows, files)
    return grouped.join(sources, ["fqcn", "file_path"], "left").select("root", "fqcn", F.transform("found", lambda x: x["method"]).alias("methods"), "source", "content_hash")


def answers(classes: DataFrame, settings: Mapping[str, object], inputs: Inputs) -> DataFrame:
    """classes with suggestion (or null) and asked: from the cache where the content and the prompt are the same, else from the model, once for each content.

    A model isn't asked about classes without a text or with too long a one.
    """
    signature = signature_of(inputs)
    if inputs.cache is not None:
        known = suggestions.join_cache(classes, inputs.cache, signature)
    else:
        known = classes.withColumns({"suggestion": F.lit(None).cast(tables.s_schema()), "hit": F.lit(False)})
    known = known.select("root", "fqcn", "methods", "source", "content_hash", "suggestion", "hit")
    if inputs.model is None:
        return known.withColumn("asked", F.lit(False))
    may = known.where(~F.col("hit") & F.col("source").isNotNull() & records.small_enough(F.col("source"), int(settings["maxClassChars"])))
    prompt = T.render_column(inputs.prompt, {"className": F.col("fqcn"), "methods": T.method_list(F.col("methods")), "classSource": F.col("source")})
    once = may.groupBy("content_hash").agg(F.min_by(F.struct("fqcn", prompt.alias("prompt")), F.struct("root", "fqcn")).alias("x")).select(F.col("content_hash").alias("fqcn"), F.col("x.prompt").alias("source"))
    replies = suggestions.classified(once, inputs.model).select(F.col("fqcn").alias("content_hash"), suggestions.suggestion_of(F.col("response")).alias("reply"))
    both = known.join(replies, "content_hash", "left")
    asked = ~F.col("hit") & F.col("reply").isNotNull()
    return both.select("root", "fqcn", "methods", "source", "content_hash", F.coalesce("suggestion", F.when(asked, F.col("reply"))).alias("suggestion"), "hit", asked.alias("asked"))


def signature_of(inputs: Inputs) -> str:
    import hashlib

    return hashlib.sha256(inputs.prompt.encode()).hexdigest()


def inventory(scanned: DataFrame, known: DataFrame, settings: Mapping[str, object], overrides: DataFrame | None) -> DataFrame:
    """One row for each test, in the order (root, file, place) by seq: with the digest of its class, if asked for, and the suggestion after overrides."""
    rows = scanned.where("method is not null").select("root", "source_root", "file_path", F.col("seq").alias("nth"), "plugin", "fqcn", "method", "begin_line", "end_line", "loc", "tags", "display_name", "file_stem")
    classes = known.select("root", "fqcn", "content_hash", F.col("suggestion.methods").alias("said"))
    answered = classes.where("said is not null").select(F.concat_ws("\0", F.col("root").cast("string"), "fqcn").alias("fqcn"), F.col("said").alias("methods"))
    # suggestions are of a class in its root
    keyed = rows.withColumn("own", F.col("fqcn")).withColumn("fqcn", F.concat_ws("\0", F.col("root").cast("string"), "own"))
    given = suggestions.join_suggestions(keyed, suggestions.exploded(answered)).withColumn("fqcn", F.col("own")).drop("own")
    shown = F.col("content_hash") if settings.get("contentHash") else F.lit(None).cast("string")
    joined = given.join(classes.select("root", "fqcn", shown.alias("content_hash")), ["root", "fqcn"], "left")
    if overrides is not None:
        joined = suggestions.overridden(joined, overrides)
    # places in the whole run: files in their order, each with its rows
    sizes = joined.groupBy("root", "file_path").agg((F.max("nth") + 1).alias("size"))
    from pyspark.sql import Window

    ahead = Window.orderBy("root", "file_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("root", "file_path", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    return joined.join(offsets, ["root", "file_path"]).withColumn("seq", F.col("ahead") + F.col("nth")).drop("ahead", "nth")


def filtered(rows: DataFrame, settings: Mapping[str, object]) -> DataFrame:
    """What the inventory shows."""
    use = records.security_only(rows) if settings.get("securityOnly") else rows
    return records.min_confidence(use, float(settings.get("minConfidence") or 0), bool(settings.get("confidence")))


def scoped(files: DataFrame, scanned: DataFrame, include: str | None) -> DataFrame:
    """Texts that are searched for secrets: those of files with tests, or, with a pattern of paths, all that match it and no others."""
    if include:
        return files.where(F.col("path").rlike(glob_pattern(include)))
    return files.join(scanned.where("method is not null").select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")


def glob_pattern(glob: str) -> str:
    """A pattern for whole paths or their ends: ** takes folders, * and ? don't take slashes, {a,b} is a choice, [a-c] and [!a-c] are sets."""
    out, depth, at = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "[" and (end := glob.find("]", at + 2)) > 0:
            out.append("[" + glob[at + 1 : end].replace("\\", "\\\\").replace("!", "^", glob[at + 1] == "!") + "]")
            at = end + 1
            continue
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
            continue
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if depth else ","}.get(c) or (c if c.isalnum() or c in "_/" else "\\" + c))
        at += 1
    return "(?:^|/)" + "".join(out) + "$"


def secrets(files: DataFrame, scanned: DataFrame, settings: Mapping[str, object], rules: Sequence[findings.Rule]) -> DataFrame:
    """Findings of the rules with the method that holds each: file, fqcn, method, rule_id, category, value, begin_line, begin_column, end_line."""
    texts = scoped(files, scanned, settings.get("secretsInclude")).select(F.col("path").alias("file_path"), F.col("content").alias("text"))
    found = findings.candidates(texts, rules)
    return findings.at_methods(found, scanned.where("method is not null")).withColumnRenamed("file_path", "file")


WRITERS: dict[str, Callable[[DataFrame, str, Mapping[str, object]], None]] = {
    "csv": lambda df, path, s: lines.write_csv(df, path, **shown(s)),
    "plain": lambda df, path, s: lines.write_ordered(df.select("seq", lines.plain_line(**shown(s)).alias("value")), path, []),
    "json": lambda df, path, s: lines.write_ordered(df.select("seq", documents.json_row(bool(s.get("contentHash")), bool(s.get("aiEnabled")), bool(s.get("confidence")), bool(s.get("driftDetect"))).alias("value")), path, []),
    "sarif": lambda df, path, s: documents.write_sarif(documents.sarif_results(df, ai_enabled=bool(s.get("aiEnabled")), confidence=bool(s.get("confidence"))), path, "1"),
}


def shown(settings: Mapping[str, object]) -> dict[str, bool]:
    """The groups of columns that settings ask for."""
    return {"source_root": False, "content_hash": bool(settings.get("contentHash")), "ai": bool(settings.get("aiEnabled")), "confidence": bool(settings.get("confidence")), "drift": bool(settings.get("driftDetect"))}


def run(spark: SparkSession, roots: Sequence[str], out: str, given: Mapping[str, object] | None = None, inputs: Inputs | None = None) -> dict[str, object]:
    """Scans roots and writes to the folder out: answers, inventory, coverage, secrets, cache and receipt, each if asked for. Returns counts and had_errors.

    Coverage is of all rows, whatever the filters are. A file that can't be read makes had_errors true and stops nothing.
    """
    inputs = inputs or Inputs()
    settings = dict(tables.DEFAULTS) | dict(given or {})
    settings["aiEnabled"] = bool(settings["aiEnabled"]) or inputs.model is not None
    with scanners.opened(settings, list(settings.get("plugins") or ())) as plugins:
        files, scanned = found_in(spark, roots, settings, plugins)
        scanned = scanned.persist()
        # a model is asked once, whatever reads its answers and whichever executor is lost
        answers(classes_of(scanned, files), settings, inputs).write.parquet(f"{out}/answers")
        known = spark.read.parquet(f"{out}/answers")
        rows = inventory(scanned, known, settings, inputs.overrides).persist()
        try:
            use = filtered(rows, settings)
            WRITERS[str(settings["outputMode"])](use, f"{out}/inventory", settings)
            if inputs.mapping is not None:
                covered = coverage.tests_by_control(rows, inputs.mapping, inputs.framework, float(settings.get("minConfidence") or 0))
                all_covered = coverage.covered_controls(rows, inputs.mapping, inputs.framework, float(settings.get("minConfidence") or 0))
                documents.write_coverage(coverage.report(covered, inputs.mapping, inputs.framework), coverage.gaps(all_covered, inputs.mapping, inputs.framework), coverage.statistics(all_covered, inputs.mapping, inputs.framework), f"{out}/coverage", inputs.framework, "", "", "1")
            n_secrets = 0
            if settings.get("detectSecrets"):
                found = secrets(files, scanned, settings, inputs.rules).persist()
                n_secrets = found.count()
                documents.write_findings(found, f"{out}/secrets")
                found.unpersist()
            if inputs.model is not None:
                entries = known.where("suggestion is not null").groupBy(F.col("content_hash").alias("contentHash")).agg(F.min_by("suggestion", F.struct("root", "fqcn")).alias("suggestion"))
                documents.write_cache(entries.select("contentHash", F.lit(signature_of(inputs)).alias("promptSignature"), "suggestion"), f"{out}/cache")
            about = documents.receipt({"roots": len(roots), "prompt": signature_of(inputs) if inputs.model else None}, {k: v for k, v in settings.items()}, bool(settings["aiEnabled"]), inputs.cache is not None)
            spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{out}/receipt")
            n = rows.agg(F.count("*").alias("n"), F.countDistinct("root", "fqcn").alias("c")).first()
            asked = known.agg(F.count_if("asked").alias("a"), F.count_if("hit").alias("h")).first()
            return {"methods": n.n, "classes": n.c, "shown": use.count(), "asked": asked.a, "cached": asked.h, "secrets": n_secrets, "had_errors": scanners.had_errors(scanned)}
        finally:
            for df in (rows, scanned):
                df.unpersist()


def written_text(spark: SparkSession, path: str) -> str:
    """The text of parts in the order of their names, for a reader on the driver."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", F.decode("content", "UTF-8").alias("text")).orderBy("path")
    return "".join(r.text for r in parts.collect())


def receipt_of(spark: SparkSession, out: str) -> dict:
    return json.loads(written_text(spark, f"{out}/receipt"))
