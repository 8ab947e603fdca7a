"""Change set between two inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

KEY = ("fqcn", "method")


def last_of(df: DataFrame, keys: tuple[str, ...] = KEY, seq: str = "seq") -> DataFrame:
    """The last row of each key. Rows are aggregated in each task before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("row")).select(*keys, "row.*")


def changed_fields(a: Column, b: Column) -> Column:
    """Names of fields that differ, in a fixed order. Digests, model columns and drift count only if both rows have them."""
    tests = {
        "loc": a["loc"] != b["loc"],
        "tags": ~C.same_set(a["tags"], b["tags"]),
        "display_name": ~C.same_text(a["display_name"], b["display_name"]),
        "source": C.both_changed(a["content_hash"], b["content_hash"]),
        "ai_security_relevant": C.both_changed(a["ai_security_relevant"], b["ai_security_relevant"]),
        "ai_tags": F.coalesce(~C.same_set(a["ai_tags"], b["ai_tags"]), F.lit(False)),
        "ai_interaction_score": C.both_changed(a["ai_interaction_score"], b["ai_interaction_score"]),
        "tag_ai_drift": C.both_changed(a["tag_ai_drift"], b["tag_ai_drift"]),
    }
    return F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))


def compare(before: DataFrame, after: DataFrame, seq: str = "seq") -> DataFrame:
    """(fqcn, method, change, changed_fields, before, after), unchanged rows too; of a repeated key the last row counts."""
    sides = []
    for name, df in (("before", before), ("after", after)):
        rest = [c for c in df.columns if c not in KEY]
        one = last_of(df, seq=seq)
        sides.append(one.select(*KEY, F.struct(*rest).alias(name)))
    both = sides[0].join(sides[1], list(KEY), "full_outer")
    fields = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), changed_fields(F.col("before"), F.col("after")))
    change = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").when(F.size("changed_fields") > 0, "MODIFIED").otherwise("UNCHANGED")
    return both.withColumn("changed_fields", fields).withColumn("change", change).select(*KEY, "change", "changed_fields", "before", "after")


def entries(compared: DataFrame) -> DataFrame:
    return compared.where("change <> 'UNCHANGED'")


def counts(compared: DataFrame) -> DataFrame:
    return compared.agg(*[F.count_if(F.col("change") == k.upper()).alias(k) for k in ("added", "removed", "modified", "unchanged")])


def security_count(df: DataFrame) -> DataFrame:
    """Over all rows, repeated keys as well."""
    return df.agg(F.count_if(F.col("ai_security_relevant")).alias("n_relevant"))


def line(change: Column, fqcn: Column, method: Column, fields: Column, before: Column, after: Column) -> Column:
    """One line of the text report."""
    def part(f: Column) -> Column:
        moved = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(before[c].cast("string"), F.lit("null")), F.lit(" → "), F.coalesce(after[c].cast("string"), F.lit("null")))
        return F.when(f == "loc", moved("loc", "loc")).when(f == "ai_security_relevant", moved("security", "ai_security_relevant")).otherwise(f)

    sign = F.when(change == "ADDED", "+").when(change == "REMOVED", "-").otherwise("~")
    shown = F.when((change == "MODIFIED") & (F.size(fields) > 0), F.concat(F.lit("  ["), F.array_join(F.transform(fields, part), "; "), F.lit("]"))).otherwise("")
    return F.concat(sign, F.lit(" "), fqcn, F.lit("  "), method, shown)
