"""Credential-like values in texts: anchors first, then patterns, then entropy; where they are, and whose."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


@dataclass(frozen=True)
class Rule:
    """A pattern with at most one capturing group, whose value is reported (else the whole match)."""

    id: str
    category: str
    anchors: tuple[str, ...]
    pattern: str
    entropy_min: float = 0.0
    description: str = ""
    provenance: str = ""
    groups: int = field(init=False, default=0)

    def __post_init__(self):
        import re

        n = re.compile(self.pattern).groups
        if n > 1:
            raise ValueError(f"rule {self.id} has {n} groups")
        object.__setattr__(self, "groups", n)


#: A small catalogue of our own.
RULES = (
    Rule("hex-token", "TOKEN", ("token",), r'token = "([0-9a-f]{40})"', 2.5),
    Rule("aws-access-key", "CLOUD", ("AKIA", "ASIA"), r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", 2.0),
    Rule("github-token", "TOKEN", ("ghp_", "gho_", "ghs_"), r"\b(gh[pos]_[0-9A-Za-z]{36})\b", 3.0),
    Rule("private-key", "KEY", ("-----BEGIN",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("password-assignment", "PASSWORD", ("password", "passwd", "pwd"), r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*["']([^"'\s]{6,64})["']""", 1.5),
    Rule("jdbc-url", "CONNECTION", ("jdbc:",), r"jdbc:[a-z]+://[^\s\"']*password=([^\s&\"';]+)"),
    Rule("bearer-header", "TOKEN", ("Bearer ",), r"Bearer ([A-Za-z0-9._-]{20,})", 2.5),
    Rule("email-address", "PERSONAL", ("@",), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
)


def matches(body: Column, r: Rule) -> Column:
    """Structs (rule_id, category, value, at) of a rule's matches; at is the value's 1-based place."""
    found = F.struct(F.split(body, r.pattern).alias("outside"), F.regexp_extract_all(body, F.lit(r.pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(body, F.lit(r.pattern), F.lit(r.groups)).alias("value"))

    def keep(x: Column) -> Column:
        return (x["value"] != "") & (C.entropy(x["value"]) >= r.entropy_min) if r.entropy_min else x["value"] != ""

    def placed(m: Column) -> Column:
        # a match starts where all that lies outside of and inside of matches before it ends
        before = F.transform(m["outside"], lambda p, i: F.length(p) + F.coalesce(F.length(F.get(m["whole"], i - 1)), F.lit(0)))
        return C.let(before, lambda sizes: C.let(F.zip_with(C.running(sizes), sizes, lambda x, y: x + y), lambda starts: F.filter(F.transform(m["value"], lambda v, i: one(v, F.get(starts, i), F.get(m["whole"], i))), keep)))

    def one(v: Column, start: Column, whole: Column) -> Column:
        return F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), v.alias("value"), (start + F.call_function("instr", whole, v)).alias("at"))

    return C.let(found, placed)


def candidates(texts: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """texts without the text, with rule_id, category, value, begin_line, begin_column and end_line of each value that a rule finds.

    A rule's pattern is only tried on texts that hold one of its anchors. A place is the length of what lies outside of
    and inside of the matches before it.
    """
    rest = [c for c in texts.columns if c != text]
    body = F.col(text)
    per_rule = []
    for r in rules:
        hit = F.lit(not r.anchors)
        for a in r.anchors:
            hit = hit | F.contains(body, F.lit(a))
        per_rule.append(F.when(hit, matches(body, r)).otherwise(F.array().cast("array<struct<rule_id:string,category:string,value:string,at:int>>")))
    long = texts.select(*rest, body.alias("_body"), F.explode(F.concat(*per_rule)).alias("f"))
    at = F.col("f.at")
    line = C.line_of(F.col("_body"), at)
    return long.select(*rest, "f.rule_id", "f.category", "f.value", line.cast("int").alias("begin_line"), C.column_of(F.col("_body"), at).cast("int").alias("begin_column"), (line + F.size(F.split("f.value", "\n")) - 1).cast("int").alias("end_line"))


def at_methods(found: DataFrame, methods: DataFrame, file: str = "file_path") -> DataFrame:
    """found with the method whose lines hold it: the innermost, that which starts last. Rows that repeat stay, each alone.

    Methods are sought for each place (file and line) once, however many findings it has; files are equal first, then lines are compared.
    """
    m = methods.select(F.col(file).alias("_file"), F.col("fqcn").alias("_fqcn"), F.col("method").alias("_method"), F.col("begin_line").alias("_begin"), F.col("end_line").alias("_end"))
    places = found.select(F.col(file).alias("_path"), F.col("begin_line").alias("_line")).distinct()
    inside = (F.col("_path") == F.col("_file")) & (F.col("_line") >= F.col("_begin")) & (F.col("_line") <= F.col("_end"))
    best = F.max_by(F.struct(F.col("_fqcn").alias("fqcn"), F.col("_method").alias("method")), F.struct("_begin", "_method"))
    owners = places.join(m, inside).groupBy("_path", "_line").agg(best.alias("_m"))
    return found.join(owners, (found[file] == F.col("_path")) & (found["begin_line"] == F.col("_line")), "left").select(*found.columns, "_m.fqcn", "_m.method")


def min_score(found: DataFrame, least: float, score: str = "credibility_score") -> DataFrame:
    """Unscored findings stay."""
    return found.where(F.col(score).isNull() | (F.col(score) >= least))


def with_verdicts(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """found (fqcn, candidate_index) with credibility_score, endpoint and rationale of a model's verdicts (fqcn, secrets)."""
    v = verdicts.select("fqcn", F.explode("secrets").alias("v")).select("fqcn", F.col("v.candidateIndex").alias("candidate_index"), F.col("v.credibilityScore").alias("credibility_score"), F.col("v.endpoint").alias("endpoint"), F.col("v.rationale").alias("rationale"))
    return found.join(v.dropDuplicates(["fqcn", "candidate_index"]), ["fqcn", "candidate_index"], "left")


def by_class(found: DataFrame) -> DataFrame:
    """(fqcn, candidates): what a model is shown about a class, in the order of the text."""
    one = F.struct("begin_line", "begin_column", "rule_id", C.masked(F.col("value")).alias("snippet"))
    return found.groupBy("fqcn").agg(F.sort_array(F.collect_list(one)).alias("candidates"))
