"""Aggregates and ordered computations over scan rows and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_class(methods: DataFrame) -> DataFrame:
    """(fqcn, methods, n_methods, first_file): methods in their order; the first row stands for the class."""
    one = F.struct("seq", "method", "begin_line", "loc", "file_path")
    grouped = methods.groupBy("fqcn").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    return grouped.select("fqcn", F.transform("rows", lambda r: r["method"]).alias("methods"), F.size("rows").alias("n_methods"), F.get("rows", F.lit(0))["file_path"].alias("first_file"))


def by_file(methods: DataFrame) -> DataFrame:
    """(file_path, n_methods, n_classes) of rows that have a path."""
    return methods.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count("*").alias("n_methods"), F.countDistinct("fqcn").alias("n_classes"))


def model_counts(methods: DataFrame, staged: Column) -> DataFrame:
    return methods.agg(F.count("*").alias("n_methods"), F.countDistinct("fqcn").alias("n_classes"), F.coalesce(F.bool_or(staged), F.lit(False)).alias("has_staged"))


def first_seen(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Each value of key once, with the place where it is first."""
    return df.groupBy(key).agg(F.min(seq).alias("first"))


def end_lines(boundaries: DataFrame, group: str = "file_path", line: str = "line") -> DataFrame:
    """Adds end_line: the line before the next boundary that is further down, its own where there is none."""
    after = Window.partitionBy(group).orderBy(line).rangeBetween(1, Window.unboundedFollowing)
    return boundaries.withColumn("end_line", F.greatest(F.col(line), F.coalesce(F.min(line).over(after) - 1, F.col(line))))


def recent(df: DataFrame, k: int = 50, seq: str = "seq") -> DataFrame:
    """The last k rows: each task keeps k, and only those meet."""
    return df.orderBy(F.desc(seq)).limit(k)


def circuit_states(events: DataFrame, most: int = 5, seconds: int = 60, group: str = "worker", at: str = "ts", is_restart: Column | None = None) -> DataFrame:
    """Adds n_recent (restarts in the trailing window) and open, which stays true once the count has reached most."""
    restart = F.when(is_restart if is_restart is not None else F.lit(True), 1)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    recent_ = Window.partitionBy(group).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    counted = events.withColumn("n_recent", F.count(restart).over(recent_))
    sofar = Window.partitionBy(group).orderBy(micros).rangeBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("open", F.max(F.col("n_recent") >= most).over(sofar))


def archive(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): each question with the answer that follows it at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumns({"next_role": F.lead("role").over(w), "response": F.lead("text").over(w)})
    return paired.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("prompt"), "response")
