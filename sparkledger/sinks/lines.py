"""Inventories as CSV and plain lines, annotations, delta text and audit rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import delta, records
from ..schemas import AUDIT

#: Fixed values of the output formats below, which consumers match on: column names, labels of plain lines, workflow commands and their sentences.
SEPARATOR = " · "


def joined(tags: Column) -> Column:
    return F.array_join(tags, ";")


def csv_columns(source_root: bool = False, content_hash: bool = False, ai: bool = False, confidence: bool = False, drift: bool = False) -> list[str]:
    out = ["fqcn", "method", "loc", "tags", "display_name"] + ["source_root"] * source_root + ["content_hash"] * content_hash
    if ai:
        out += ["ai_security_relevant", "ai_display_name", "ai_tags", "ai_reason", "ai_interaction_score"] + ["ai_confidence"] * confidence
        out += ["tag_ai_drift", "tags_added", "tags_removed"] * drift
    return out


def csv_values() -> dict[str, Column]:
    """Texts of the columns of a row (fqcn, method, loc, tags, display_name, source_root, content_hash, ai), before quoting."""
    ai = F.col("ai")
    score = lambda c: F.when(ai.isNotNull(), C.one_decimal(ai[c]))
    diff = lambda a, b: F.when(ai.isNotNull(), C.tag_difference(a, b))
    return {
        "fqcn": F.col("fqcn"), "method": F.col("method"), "loc": F.col("loc").cast("string"), "tags": joined(F.col("tags")), "display_name": F.col("display_name"),
        "source_root": F.col("source_root"), "content_hash": F.col("content_hash"), "ai_security_relevant": ai["relevant"].cast("string"), "ai_display_name": ai["display_name"],
        "ai_tags": joined(ai["tags"]), "ai_reason": ai["reason"], "ai_interaction_score": score("interaction_score"), "ai_confidence": score("confidence"),
        "tag_ai_drift": records.drift(F.col("tags"), ai), "tags_added": diff(F.col("tags"), ai["tags"]), "tags_removed": diff(ai["tags"], F.col("tags")),
    }


def csv_line(**groups: bool) -> Column:
    values = csv_values()
    return F.concat_ws(",", *[C.csv_escape(values[c]) for c in csv_columns(**groups)])


def csv_rows(df: DataFrame, **groups: bool) -> DataFrame:
    """The columns as texts; absent values are empty."""
    values = csv_values()
    names = csv_columns(**groups)
    return df.select(*[F.coalesce(values[c], F.lit("")).alias(f"out_{c}") for c in names]).toDF(*names)


def write_ordered(df: DataFrame, path: str, head: Sequence[str], tail: Sequence[str] = ()) -> None:
    """Text files whose parts, in the order of their names, are head, the column value in the order of the other columns, and tail.

    Rows are dealt by ranges of their order and written by tasks; only head and tail come from the driver.
    """
    order = [c for c in df.columns if c != "value"]
    nothing = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
    ends = df.sparkSession.createDataFrame([(k, i, line) for k, part in ((0, head), (2, tail)) for i, line in enumerate(part)], "_k int, _i long, value string")
    rows = df.select(F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_i"), *order, "value")
    every = rows.union(ends.select("_k", "_i", *nothing, "value"))
    every.repartitionByRange("_k", "_i", *order).sortWithinPartitions("_k", "_i", *order).select("value").write.text(path)


def write_csv(df: DataFrame, path: str, seq: str = "seq", metadata: dict[str, str] | None = None, **groups: bool) -> None:
    """Lines in the order of seq under a head: comments, then the column names."""
    head = [f"# {k}: {v}" for k, v in (metadata or {}).items()] + [",".join(csv_columns(**groups))]
    write_ordered(df.select(F.col(seq).cast("long").alias("at"), csv_line(**groups).alias("value")), path, head)


def scan_metadata(version: str, timestamp: str, taxonomy: str) -> dict[str, str]:
    return {"tool_version": version, "scan_timestamp": timestamp, "taxonomy": taxonomy}


def plain_line(source_root: bool = False, content_hash: bool = False, ai: bool = False, confidence: bool = False, drift: bool = False) -> Column:
    """fqcn, method, LOC=... with - for what is absent."""
    v = csv_values()
    shown = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    given = lambda c: F.coalesce(c, F.lit("-"))
    parts = [v["fqcn"], v["method"], F.concat(F.lit("LOC="), v["loc"]), F.concat(F.lit("TAGS="), shown(v["tags"])), F.concat(F.lit("DISPLAY="), shown(v["display_name"]))]
    if source_root:
        parts.append(F.concat(F.lit("SRCROOT="), shown(v["source_root"])))
    if content_hash:
        parts.append(F.concat(F.lit("HASH="), given(v["content_hash"])))
    if ai:
        reason = F.when(records.present(v["ai_reason"]), v["ai_reason"]).otherwise("-")
        for name, c in (("AI_SECURITY", given(v["ai_security_relevant"])), ("AI_DISPLAY", given(v["ai_display_name"])), ("AI_TAGS", shown(v["ai_tags"])), ("AI_REASON", reason), ("AI_INTERACTION_SCORE", given(v["ai_interaction_score"]))):
            parts.append(F.concat(F.lit(f"{name}="), c))
        if confidence:
            parts.append(F.concat(F.lit("AI_CONFIDENCE="), given(v["ai_confidence"])))
        if drift:
            parts.append(F.concat(F.lit("TAG_AI_DRIFT="), given(v["tag_ai_drift"])))
    return F.concat_ws(", ", *parts)


def command(level: Column, path: Column, line: Column, title: Column, message: Column) -> Column:
    where = F.when(line > 0, F.concat(F.lit(",line="), line.cast("string"))).otherwise("")
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(",title="), C.annotation_property(title))).otherwise("")
    return F.concat(F.lit("::"), level, F.lit(" file="), C.annotation_property(path), where, named, F.lit("::"), C.annotation_message(message))


def annotations(df: DataFrame, prefix: str = "") -> DataFrame:
    """(seq, kind, line): workflow commands for names declared empty (kind 0) and for relevant methods (kind 1)."""
    ai, path, at = F.col("ai"), C.artifact_uri(F.col("fqcn"), prefix), F.concat(F.col("fqcn"), F.lit("#"), F.col("method"))
    drift = records.drift(F.col("tags"), ai)
    tags = F.coalesce(ai["tags"], F.array().cast("array<string>"))
    parts = F.array_compact(F.array(
        F.when(records.present(ai["display_name"]), F.concat(F.lit('Suggested @DisplayName: "'), ai["display_name"], F.lit('"'))),
        F.when(F.size(tags) > 0, F.concat(F.lit("Suggested @Tag: "), F.array_join(tags, ", "))),
        F.when(records.present(ai["reason"]), F.concat(F.lit("Reason: "), records.sentence(ai["reason"]))),
        F.when(records.placebo(ai), F.concat(F.lit("Interaction score "), C.one_decimal(ai["interaction_score"]), F.lit(": assertions only verify method calls, not output values or state"))),
        F.when(drift == "tag-only", 'Drift: @Tag("security") present but AI disagrees — annotation may be stale').when(drift == "ai-only", 'Drift: AI classifies as security-relevant but no @Tag("security") in source'),
    ))
    message = F.when(F.size(parts) == 0, "Security test").otherwise(F.array_join(parts, SEPARATOR))
    title = F.when(records.present(ai["display_name"]), ai["display_name"]).otherwise(at)
    unnamed = F.when(records.empty_display_name(F.col("display_name")), F.struct(F.lit(0).alias("kind"), command(F.lit("notice"), path, F.col("begin_line"), F.concat(F.lit('@DisplayName("") on '), at), F.lit('@DisplayName("") declares an empty display name — the test will appear unnamed in reports, obscuring the audit trail. Replace with a meaningful description, e.g. @DisplayName("Verifies that ...").')).alias("line")))
    secure = F.when(records.relevant(ai), F.struct(F.lit(1).alias("kind"), command(F.when(records.placebo(ai), "warning").otherwise("notice"), path, F.col("begin_line"), title, message).alias("line")))
    return df.select("seq", F.explode(F.array_compact(F.array(unnamed, secure))).alias("x")).select("seq", "x.kind", "x.line")


def delta_ends(compared: DataFrame, before: DataFrame, after: DataFrame, names: tuple[str, str] = ("before.csv", "after.csv"), timestamps: tuple[str | None, str | None] = (None, None)) -> tuple[list[str], list[str]]:
    """The report's lines before and after its list of changes."""
    n_a, n_b = (delta.last_of(df).count() for df in (before, after))
    s_a, s_b = (delta.security_count(df).first()[0] for df in (before, after))
    c = delta.counts(compared).first()
    head = lambda t, n, s: f"  ({f'scanned: {t}{SEPARATOR}' if t else ''}{n} method{'' if n == 1 else 's'}{SEPARATOR}{s} security-relevant)"
    moved = s_b - s_a
    first = ["delta report", f"  before: {names[0]}{head(timestamps[0], n_a, s_a)}", f"  after:  {names[1]}{head(timestamps[1], n_b, s_b)}", ""]
    if not c.added + c.removed + c.modified:
        first.append("No changes detected.")
    return first, ["", f"{c.added} added  ·  {c.removed} removed  ·  {c.modified} modified  ·  {c.unchanged} unchanged", f"security-relevant: {s_a} → {s_b}  ({'no change' if not moved else f'{moved:+d}'})"]


def delta_lines(compared: DataFrame) -> DataFrame:
    """(fqcn, method, value) of each change."""
    return delta.entries(compared).select("fqcn", "method", delta.line(F.col("change"), F.col("fqcn"), F.col("method"), F.col("changed_fields"), F.col("before"), F.col("after")).alias("value"))


def write_delta_text(compared: DataFrame, before: DataFrame, after: DataFrame, path: str, **about) -> None:
    head, tail = delta_ends(compared, before, after, **about)
    write_ordered(delta_lines(compared), path, head, tail)


def delta_text(compared: DataFrame, before: DataFrame, after: DataFrame, names: tuple[str, str] = ("before.csv", "after.csv"), timestamps: tuple[str | None, str | None] = (None, None)) -> list[str]:
    """The report as lines for a person to read on the driver; write_delta_text() is for any number of changes."""
    head, tail = delta_ends(compared, before, after, names, timestamps)
    return [*head, *(r.value for r in delta_lines(compared).orderBy("fqcn", "method").toLocalIterator()), *tail]


def audit_rows(saved: DataFrame, at: datetime) -> DataFrame:
    """The fixed columns of an evidence file of what a reviewer applied: fqcn, method, loc, applied_tags, applied_display_name, ai."""
    ai = F.col("ai")
    values = {
        "fqcn": F.col("fqcn"), "method": F.col("method"), "loc": F.col("loc").cast("string"), "applied_tags": joined(F.col("applied_tags")), "applied_display_name": F.col("applied_display_name"),
        "ai_security_relevant": ai["relevant"].cast("string"), "ai_display_name": ai["display_name"], "ai_tags": joined(ai["tags"]), "ai_reason": ai["reason"],
        "ai_confidence": F.when(ai.isNotNull(), C.one_decimal(ai["confidence"])), "ai_interaction_score": F.when(ai.isNotNull(), C.one_decimal(ai["interaction_score"])),
        "tag_ai_drift": records.drift(F.col("applied_tags"), ai), "tags_added": F.when(ai.isNotNull(), C.tag_difference(F.col("applied_tags"), ai["tags"])),
        "tags_removed": F.when(ai.isNotNull(), C.tag_difference(ai["tags"], F.col("applied_tags"))), "saved_at": F.lit(at.strftime("%Y%m%d-%H%M%S")),
    }
    return saved.select(*[F.coalesce(values[c], F.lit("")).alias(f"out_{c}") for c in AUDIT]).toDF(*AUDIT)
