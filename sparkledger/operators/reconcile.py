"""A reviewed inventory against the code it describes: what would be changed, and what doesn't match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .delta import KEY, last_of
from .records import desired_state


class TooManyMismatches(RuntimeError):
    """The inventory and the code differ too much to be applied."""


def csv_not_source(csv: DataFrame, source: DataFrame) -> DataFrame:
    return csv.select(*KEY).distinct().join(source.select(*KEY), list(KEY), "left_anti")


def source_not_csv(csv: DataFrame, source: DataFrame) -> DataFrame:
    return source.select(*KEY).distinct().join(csv.select(*KEY), list(KEY), "left_anti")


def matched(csv: DataFrame, source: DataFrame) -> DataFrame:
    return csv.select(*KEY).intersect(source.select(*KEY))


def relevant_files(source: DataFrame, csv: DataFrame) -> DataFrame:
    """Files of which any method is in the inventory."""
    return source.where(F.col("file_path").isNotNull()).join(csv.select(*KEY).distinct(), list(KEY), "left_semi").select("file_path").distinct()


def guard(n_mismatches: int, limit: int) -> None:
    """A limit of 0 or more stops at so many mismatches (0 always does); a negative one never."""
    if 0 <= limit <= n_mismatches:
        raise TooManyMismatches(f"{n_mismatches} mismatches reach the limit of {limit}")


def patcher_for(path: Column, patchers: dict[str, tuple[str, ...]]) -> Column:
    """The first patcher, in order, that handles a file's suffix; null if none does."""
    out = None
    for name, suffixes in patchers.items():
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | F.endswith(path, F.lit(s))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")


def change_plan(csv: DataFrame, source: DataFrame, promote: bool = False) -> DataFrame:
    """(file_path, begin_line, fqcn, method, add_tags, remove_tags, set_display_name, promoted) of methods that need a change.

    csv: seq and the fields of a scan row, the last of a key counts. An empty name in the inventory removes the name; null leaves it.
    """
    want = desired_state(last_of(csv), promote).select(*KEY, "want_tags", "want_display_name", "promoted")
    now = source.select(*KEY, "file_path", "begin_line", F.col("tags").alias("now_tags"), F.col("display_name").alias("now_name"))
    both = now.join(want, list(KEY))
    empty = F.array().cast("array<string>")
    diff = lambda a, b: F.array_sort(F.array_except(F.coalesce(a, empty), F.coalesce(b, empty)))
    name = F.when(F.col("want_display_name").isNotNull() & ~C.same_text(F.col("want_display_name"), F.col("now_name")), F.col("want_display_name"))
    planned = both.select("file_path", "begin_line", *KEY, diff(F.col("want_tags"), F.col("now_tags")).alias("add_tags"), diff(F.col("now_tags"), F.col("want_tags")).alias("remove_tags"), name.alias("set_display_name"), "promoted")
    return planned.where((F.size("add_tags") > 0) | (F.size("remove_tags") > 0) | F.col("set_display_name").isNotNull())


def bottom_up(plan: DataFrame) -> DataFrame:
    """In the order in which a file is edited without moving what is still to be edited."""
    return plan.orderBy("file_path", F.desc("begin_line"), "fqcn", "method")


def summary(plan: DataFrame, csv: DataFrame, source: DataFrame) -> DataFrame:
    """(changes, files, promoted, skipped): skipped are methods of the inventory that the code lacks."""
    done = plan.agg(F.count("*").alias("changes"), F.countDistinct("file_path").alias("files"), F.count_if("promoted").alias("promoted"))
    lost = csv_not_source(csv, source).agg(F.count("*").alias("skipped"))
    return done.join(lost, F.lit(True)).select("changes", "files", "promoted", "skipped")
