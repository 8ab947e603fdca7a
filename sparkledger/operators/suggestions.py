"""Joins of scan rows with suggestions, cached answers and human overrides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .delta import last_of
from .records import valid_suggestions

#: Override rows are numbered by stretches of so many places.
STRETCH = 1 << 16
AI = "struct<relevant:boolean,display_name:string,tags:array<string>,reason:string,confidence:double,interaction_score:double>"


def exploded(classes: DataFrame, methods: str = "methods", key: str = "fqcn") -> DataFrame:
    """(key, method, pos, ai) of an array of suggestions for each class; unnamed ones are dropped."""
    long = classes.select(key, F.posexplode(valid_suggestions(F.col(methods))).alias("pos", "m"))
    ai = F.struct(F.coalesce("m.securityRelevant", F.lit(False)).alias("relevant"), F.col("m.displayName").alias("display_name"), F.col("m.tags").alias("tags"), F.col("m.reason").alias("reason"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("m.interactionScore", F.lit(0.0)).alias("interaction_score"))
    return long.select(key, F.col("m.methodName").alias("method"), "pos", ai.cast(AI).alias("ai"))


def join_suggestions(methods: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Each method with the first suggestion for its name in its class, or null. suggestions: fqcn, method, pos, ai."""
    first = suggestions.where(F.trim(F.coalesce("method", F.lit(""))) != "").groupBy("fqcn", "method").agg(F.min_by("ai", "pos").alias("ai"))
    return methods.join(first, ["fqcn", "method"], "left")


def join_cache(classes: DataFrame, cache: DataFrame, signature: str) -> DataFrame:
    """classes with suggestion and hit: an entry of the same content whose signature is the same or missing (an old file). The last entry of a content counts."""
    last = last_of(cache, ("content_hash",))
    usable = last.where(F.col("prompt_signature").isNull() | (F.col("prompt_signature") == signature))
    found = usable.select("content_hash", F.col("suggestion"), F.lit(True).alias("hit"))
    return classes.join(found, "content_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def join_cached_verdicts(classes: DataFrame, cache: DataFrame, signature: str) -> DataFrame:
    """classes with secrets, only from entries of exactly this signature that have them."""
    last = last_of(cache, ("content_hash",)).where(F.col("prompt_signature") == signature).where(F.col("secrets").isNotNull())
    return classes.join(last.select("content_hash", "secrets"), "content_hash", "left")


def cache_misses(classes: DataFrame, cache: DataFrame, signature: str) -> DataFrame:
    """Classes for which the model has to be asked."""
    last = last_of(cache, ("content_hash",))
    usable = last.where(F.col("prompt_signature").isNull() | (F.col("prompt_signature") == signature)).select("content_hash")
    return classes.join(usable, "content_hash", "left_anti")


def cache_stats(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def legacy_cache(rows: DataFrame) -> DataFrame:
    """Rows of an old inventory (seq, content_hash, method, ai columns) as cache entries without a signature, one for each content."""
    used = rows.where(F.col("content_hash").isNotNull() & F.col("ai_security_relevant").isNotNull())
    one = F.struct("seq", F.col("method").alias("methodName"), F.col("ai_security_relevant").alias("securityRelevant"), F.col("ai_display_name").alias("displayName"), F.coalesce("ai_tags", F.array().cast("array<string>")).alias("tags"), F.col("ai_reason").alias("reason"), F.coalesce("ai_confidence", F.lit(0.0)).alias("confidence"), F.coalesce("ai_interaction_score", F.lit(0.0)).alias("interactionScore"))
    grouped = used.groupBy("content_hash").agg(F.min_by("fqcn", "seq").alias("fqcn"), F.sort_array(F.collect_list(one)).alias("methods"))
    return grouped.select("content_hash", F.lit(None).cast("string").alias("prompt_signature"), "fqcn", F.transform("methods", lambda m: m.dropFields("seq")).alias("methods"))


def overridden(methods: DataFrame, overrides: DataFrame) -> DataFrame:
    """methods (fqcn, method, ai) after human overrides (pos, fqcn, method?, security_relevant?, tags?, display_name?, reason?).

    An override of the method goes before one of the class; of several the last one counts. Each given field replaces
    the model's; confidence becomes 1 or 0. In a class with any override every other method has at least a suggestion of "not relevant".
    """
    fields = ("security_relevant", "tags", "display_name", "reason")
    named = overrides.where("fqcn is not null")
    last = lambda df, *keys: df.groupBy(*keys).agg(F.max_by(F.struct(*fields), "pos").alias("o"))
    by_method = last(named.where("method is not null"), "fqcn", "method").withColumnRenamed("o", "om")
    by_class = named.groupBy("fqcn").agg(F.max_by(F.struct(*fields), F.when(F.col("method").isNull(), F.col("pos"))).alias("oc"), F.count("*").alias("n_overrides"))
    both = methods.join(by_class, "fqcn", "left").join(by_method, ["fqcn", "method"], "left")
    o, ai = F.coalesce("om", "oc"), F.col("ai")
    is_relevant = F.coalesce(o["security_relevant"], ai["relevant"], F.lit(False))
    replaced = F.struct(
        is_relevant.alias("relevant"),
        F.coalesce(o["display_name"], ai["display_name"]).alias("display_name"),
        F.coalesce(o["tags"], ai["tags"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(o["reason"], ai["reason"]).alias("reason"),
        F.when(is_relevant, 1.0).otherwise(0.0).alias("confidence"),
        F.coalesce(ai["interaction_score"], F.lit(0.0)).alias("interaction_score"),
    ).cast(AI)
    neutral = F.struct(F.lit(False), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0)).cast(AI)
    out = F.when(o.isNotNull(), replaced).when(F.col("n_overrides").isNotNull(), F.coalesce(ai, neutral)).otherwise(ai)
    return both.withColumn("ai", out).drop("oc", "om", "n_overrides")


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("fqcn", "method")) -> DataFrame:
    """Override rows (pos, keys, ...) with new ones put in place of those of the same key, others appended; pos counts from 0."""
    from pyspark.sql import Window

    rest = [c for c in old.columns if c not in (*keys, "pos")]
    a = old.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col("pos").alias("old_pos"), F.struct(*rest).alias("old"))
    b = new.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("pos").alias("new_pos"), F.struct(*rest).alias("new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = a.join(b, on, "full_outer").withColumn("row", F.coalesce("new", "old"))
    # places are numbered inside stretches; only the stretches' sizes are summed in one window
    placed = both.withColumns({"late": F.col("old_pos").isNull(), "stretch": F.floor(F.coalesce("old_pos", "new_pos") / STRETCH)})
    sizes = placed.groupBy("late", "stretch").agg(F.count("*").alias("size"))
    before = Window.orderBy("late", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("late", "stretch", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("late", "stretch").orderBy("old_pos", "new_pos", *[F.coalesce(f"a_{k}", f"b_{k}") for k in keys]))
    numbered = placed.withColumn("within", within).join(offsets, ["late", "stretch"])
    return numbered.select((F.col("ahead") + F.col("within") - 1).cast("int").alias("pos"), *[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], "row.*")


def classified(classes: DataFrame, model: Callable[[str, str], str], fqcn: str = "fqcn", source: str = "source") -> DataFrame:
    """classes with the model's answer to each (fqcn, source), asked once for each row inside of tasks. model is any callable; tests use a stub."""
    schema = f"{fqcn} string, response string"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({fqcn: batch[fqcn], "response": [model(a, b) for a, b in zip(batch[fqcn], batch[source])]})

    return classes.select(fqcn, source).mapInPandas(ask, schema)


def suggestion_of(response: Column) -> Column:
    """A model's answer as a class suggestion; an answer without an object gives null."""
    from ..functions.text import extract_json
    from ..schemas import CLASS_SUGGESTION

    return F.from_json(extract_json(response), CLASS_SUGGESTION)
