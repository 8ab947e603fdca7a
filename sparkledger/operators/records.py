"""Filters and projections of scan rows. ai is the struct of a suggestion: relevant, display_name, tags, reason, confidence, interaction_score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

PLACEBO, SECRET_ERROR, SECRET_WARNING = 0.8, 0.8, 0.4
DEFAULT_SEVERITY = "5.0"
MAX_CLASS_CHARS = 40_000
# Severity of a tag.
SEVERITY = {
    "injection": "9.0", "sqli": "9.0", "rce": "9.0", "xxe": "9.0", "deserialization": "8.5", "auth": "7.5", "authn": "7.5", "authz": "7.5",
    "access-control": "7.5", "privilege-escalation": "7.5", "idor": "7.5", "crypto": "6.5", "session": "6.5", "xss": "6.5", "csrf": "6.5",
    "path-traversal": "6.5", "redirect": "5.5", "logging": "4.0", "dos": "4.0",
}


def has_suggestion(ai: Column) -> Column:
    return ai.isNotNull()


def relevant(ai: Column) -> Column:
    return F.coalesce(ai["relevant"], F.lit(False))


def security_only(df: DataFrame, ai: str = "ai") -> DataFrame:
    return df.where(relevant(F.col(ai)))


def min_confidence(df: DataFrame, least: float, enabled: bool = True, ai: str = "ai") -> DataFrame:
    """Rows without a suggestion go too; nothing goes unless confidence is enabled and the threshold is positive."""
    return df.where(F.col(ai)["confidence"] >= least) if enabled and least > 0 else df


def enabled_plugins(df: DataFrame, ids: Sequence[str], plugin: str = "plugin") -> DataFrame:
    return df.where(F.col(plugin).isin(list(ids))) if ids else df


def valid_suggestions(methods: Column) -> Column:
    """Suggestions that name a method; missing tags become an empty list."""
    named = F.filter(methods, lambda m: F.trim(F.coalesce(m["methodName"], F.lit(""))) != "")
    return F.transform(named, lambda m: m.withField("tags", F.coalesce(m["tags"], F.array().cast("array<string>"))))


def small_enough(source: Column, most: int = MAX_CLASS_CHARS) -> Column:
    return F.length(source) <= most


def rule_id(ai: Column) -> Column:
    other = F.get(F.filter(F.coalesce(ai["tags"], F.array().cast("array<string>")), lambda t: t != "security"), F.lit(0))
    return F.when(~relevant(ai), "test-method").when(other.isNotNull(), F.concat(F.lit("security/"), other)).otherwise("security-test")


def severity(rule: Column, tags: Column) -> Column:
    """Of the first tag that has one, else the default; none for plain tests."""
    by_tag = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    known = F.get(F.filter(F.transform(tags, lambda t: F.try_element_at(by_tag, t)), lambda s: s.isNotNull()), F.lit(0))
    return F.when(rule != "test-method", F.coalesce(known, F.lit(DEFAULT_SEVERITY)))


def level(rule: Column) -> Column:
    return F.when(rule == "test-method", "none").otherwise("note")


def sentence(s: Column) -> Column:
    """Stripped, with a full stop at its end."""
    t = F.trim(s)
    return F.when(F.endswith(t, F.lit(".")), t).otherwise(F.concat(t, F.lit(".")))


def present(s: Column) -> Column:
    return F.trim(F.coalesce(s, F.lit(""))) != ""


def message(fqcn: Column, method: Column, ai: Column, scores: bool = True, confidence: bool = True) -> Column:
    head = F.when(present(ai["display_name"]), F.concat(F.lit('AI suggests: @DisplayName("'), ai["display_name"], F.lit('")'))).otherwise("AI classifies as security-relevant")
    tags = F.array_join(F.transform(F.coalesce(ai["tags"], F.array().cast("array<string>")), lambda t: F.concat(F.lit(' @Tag("'), t, F.lit('")'))), "")
    reason = F.when(present(ai["reason"]), F.concat(F.lit(" Reason: "), sentence(ai["reason"]))).otherwise("")
    parts = [head, tags, F.lit("."), reason]
    if scores:
        parts.append(F.format_string(" Interaction score: %.2f.", ai["interaction_score"]))
        if confidence:
            parts.append(F.when(ai["confidence"] > 0, F.format_string(" Confidence: %.0f%%.", ai["confidence"] * 100)).otherwise(""))
        parts.append(F.when(placebo(ai), " Assertions primarily verify method calls, not actual outcomes. See the security-test/placebo finding for remediation guidance.").otherwise(""))
    return F.when(relevant(ai), F.concat(*parts)).otherwise(F.concat(fqcn, F.lit("."), method))


def placebo(ai: Column) -> Column:
    return relevant(ai) & (F.coalesce(ai["interaction_score"], F.lit(0.0)) >= PLACEBO)


def empty_display_name(name: Column) -> Column:
    """Given but empty; null isn't given."""
    return F.coalesce(name == "", F.lit(False))


def secret_level(score: Column) -> Column:
    return F.when(score.isNull(), "warning").when(score >= SECRET_ERROR, "error").when(score >= SECRET_WARNING, "warning").otherwise("note")


def secret_severity(score: Column) -> Column:
    return F.when(score.isNotNull(), C.one_decimal(F.least(F.lit(10.0), score * 10)))


def drift(tags: Column, ai: Column) -> Column:
    """none, tag-only or ai-only; null without a suggestion. The tag counts in any case."""
    tagged = F.exists(tags, lambda t: F.lower(t) == "security")
    return F.when(ai.isNull(), F.lit(None).cast("string")).when(tagged == relevant(ai), "none").when(tagged, "tag-only").otherwise("ai-only")


def tag_status(pending: Column, ai: Column, reference: Column) -> Column:
    """What a reviewer still has to do about a method."""
    none = F.size(F.coalesce(ai["tags"], F.array().cast("array<string>"))) == 0
    settled = F.forall(ai["tags"], lambda t: F.array_contains(reference, t))
    return F.when(pending, "PENDING_SAVE").when(ai.isNull(), "NO_AI").when(~relevant(ai), "NOT_SECURITY").when(none, "OK").when(~settled, "NEEDS_REVIEW").otherwise("OK")


def desired_state(df: DataFrame, promote: bool, tags: str = "tags", display_name: str = "display_name", ai_tags: str = "ai_tags", ai_display_name: str = "ai_display_name") -> DataFrame:
    """Adds want_tags, want_display_name and promoted: curated values, or the model's where these are blank and promotion is asked for."""
    from_ai = (F.size(tags) == 0) & (F.size(F.coalesce(ai_tags, F.array().cast("array<string>"))) > 0) & F.lit(promote)
    named = ~present(F.col(display_name)) & present(F.col(ai_display_name)) & F.lit(promote)
    return df.withColumns({
        "want_tags": F.when(from_ai, F.col(ai_tags)).otherwise(F.col(tags)),
        "want_display_name": F.when(named, F.col(ai_display_name)).otherwise(F.col(display_name)),
        "promoted": from_ai | named,
    })


def deterministic_replay(ai_enabled: bool, cache_file: bool) -> bool:
    """A run can be repeated exactly if no model is asked, or its answers are kept."""
    return not ai_enabled or cache_file
