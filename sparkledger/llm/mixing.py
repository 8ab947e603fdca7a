"""Mixing sources to target weights: iterative proportional fitting over source, language and topic."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, put_back, set_aside, table, written

DIMENSIONS = ("source", "lang", "topic")
#: Without given targets, each category's target is its share of the tokens to this power, normalised.
TEMPERATURE = 0.7
#: Share of all tokens that the sample is to have.
BUDGET = 0.5
ROUNDS, TOLERANCE = 200, 1e-9
#: With more cells than this the fitting runs as DataFrame steps instead of on the driver, with the same limit of rounds.
DRIVER_CELLS, SPARK_ROUNDS = 100_000, ROUNDS
SEED = 8


MADE = ("topic", "n_tokens", "weight", "prob", "sampled")


def token_count(text: Column) -> Column:
    """Runs of other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: terms of use, code and keys, shouted promotion, data, prose; empty where there is no text."""
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(text.contains("License") | text.contains("Copyright"), "legal")
        .when(text.contains("!!"), "promotion")
        .when(text.rlike("[0-9]"), "data")
        .otherwise("prose")
    )


def named(c: Column) -> Column:
    """A null category is a category of its own."""
    return F.coalesce(c.cast("string"), F.lit("(null)"))


def target_shares(present: Mapping[str, float], given: Mapping[str, float] | None, temperature: float) -> dict[str, float]:
    """Shares that sum to 1 over the categories that have tokens; categories without a given target aren't wanted."""
    total = sum(present.values())
    raw = {k: (max(0.0, given.get(k, 0.0)) if given else (v / total) ** temperature) for k, v in present.items()}
    whole = sum(raw.values())
    if not whole:
        raise ValueError("no category that has a target has tokens")
    return {k: v / whole for k, v in raw.items()}


def fit(keys: list[tuple], tokens: np.ndarray, targets: list[dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of cells with which the token shares meet every marginal target, as nearly as the cells allow."""
    w = np.ones(len(tokens))
    codes, goals = [], []
    for d, goal in enumerate(targets):
        names = sorted(goal)
        at = {k: i for i, k in enumerate(names)}
        codes.append(np.array([at[k[d]] for k in keys], np.int64))
        goals.append(np.array([goal[k] for k in names]))
    total = tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals):
            now = np.bincount(code, w * tokens, len(goal)) / total
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(goal - now).max()))
            w *= factor[code]
        if worst < tolerance:
            break
    return w


def scale(w: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The factor c with sum(min(1, c w) tokens) = budget, or as near as all positive weights allow."""
    use = (w > 0) & (tokens > 0)
    if not use.any():
        return 0.0
    w, tokens = w[use], tokens[use]
    if tokens.sum() <= budget:
        return float(1 / w.min())
    order = np.argsort(-w)
    w, tokens = w[order], tokens[order]
    full = np.concatenate(([0.0], np.cumsum(tokens)))
    rest = np.cumsum((w * tokens)[::-1])[::-1]
    for k in range(len(w)):
        c = (budget - full[k]) / rest[k]
        if c * w[k] <= 1:
            return float(max(c, 0.0))
    return float(1 / w[-1])


def fit_cells(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, temperature: float, budget: float) -> tuple[DataFrame, bool]:
    """(source, lang, topic, weight, prob) of each cell, and whether there are few: then they are fitted on the driver, and may be broadcast."""
    spark = cells.sparkSession
    rows = cells.limit(DRIVER_CELLS + 1).collect()
    schema = "source string, lang string, topic string, weight double, prob double"
    if len(rows) > DRIVER_CELLS:
        return fit_large(cells, targets, temperature, budget), False
    rows.sort(key=lambda r: tuple(r[d] for d in DIMENSIONS))
    tokens = np.array([float(r.tokens) for r in rows])
    if not tokens.sum():
        return spark.createDataFrame([(*(r[d] for d in DIMENSIONS), 1.0, min(1.0, budget)) for r in rows], schema), True
    keys = [tuple(r[d] for d in DIMENSIONS) for r in rows]
    goals = []
    for i, d in enumerate(DIMENSIONS):
        present: dict[str, float] = {}
        for k, t in zip(keys, tokens):
            present[k[i]] = present.get(k[i], 0.0) + t
        positive = {k: v for k, v in present.items() if v > 0}
        goals.append(dict.fromkeys(present, 0.0) | target_shares(positive, (targets or {}).get(d), temperature))
    w = fit(keys, tokens, goals)
    # cells without tokens don't change any marginal: they are sampled like the average
    w[tokens == 0] = 1.0
    c = scale(w[tokens > 0], tokens[tokens > 0], budget * tokens.sum())
    prob = np.minimum(1.0, c * w)
    prob[tokens == 0] = min(1.0, budget)
    return spark.createDataFrame([(*k, float(a), float(b)) for k, a, b in zip(keys, w, prob)], schema), True


def fit_large(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, temperature: float, budget: float) -> DataFrame:
    """The same for any number of cells, by the same stop rule: each marginal is an aggregate; only the factors of the categories are written."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*DIMENSIONS, F.lit(1.0).alias("weight"), F.lit(min(1.0, budget)).alias("prob"))
    goals, factors = {}, {}
    for d in DIMENSIONS:
        share = cells.groupBy(d).agg((F.sum("tokens") / total).alias("share"))
        given = (targets or {}).get(d)
        if given:
            wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, max(0.0, float(v)))]), F.col(d)), F.lit(0.0))
        else:
            wanted = F.pow("share", F.lit(temperature))
        raw = share.select(d, F.when(F.col("share") > 0, wanted).otherwise(0.0).alias("raw"))
        whole = float(raw.agg(F.sum("raw")).first()[0] or 0)
        if not whole:
            raise ValueError("no category that has a target has tokens")
        goals[d] = written(raw.select(d, (F.col("raw") / whole).alias("goal")), "goals")
        factors[d] = None

    def weighted() -> DataFrame:
        """The cells with the product of the factors of their categories."""
        out, weight = cells, F.lit(1.0)
        for d in DIMENSIONS:
            if factors[d] is not None:
                out = out.join(factors[d].select(d, F.col("factor").alias(f"_{d}")), d)
                weight = weight * F.col(f"_{d}")
        return out.select(*DIMENSIONS, "tokens", weight.alias("weight"))

    for _ in range(SPARK_ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            sums = weighted().groupBy(d).agg((F.sum(F.col("weight") * F.col("tokens")) / total).alias("is"))
            step = sums.join(goals[d], d).withColumn("step", F.when(F.col("is") > 0, F.col("goal") / F.col("is")).otherwise(0.0))
            before = factors[d]
            if before is not None:
                step = step.join(before.select(d, "factor"), d).withColumn("step", F.col("step") * F.col("factor"))
            factors[d] = written(step.select(d, F.col("step").alias("factor"), F.abs(F.col("goal") - F.col("is")).alias("error")), "factors")
            forget(before)
            worst = max(worst, float(factors[d].agg(F.max("error")).first()[0]))
        if worst < TOLERANCE:
            break
    now = written(weighted(), "cells")
    forget(*factors.values(), *goals.values())
    c = scale_large(now, budget * total)
    prob = F.when(F.col("tokens") == 0, F.lit(min(1.0, budget))).otherwise(F.least(F.lit(1.0), F.lit(c) * F.col("weight")))
    return now.select(*DIMENSIONS, F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("weight")).alias("weight"), prob.alias("prob"))


def scale_large(cells: DataFrame, budget: float) -> float:
    """scale() by aggregates of a single row: cells taken whole only become more, and with the same ones the factor is exact."""
    cells = cells.where("weight > 0 and tokens > 0")
    tokens, least, mass = cells.agg(F.sum("tokens"), F.min("weight"), F.sum(F.col("weight") * F.col("tokens"))).first()
    if not tokens:
        return 0.0
    if tokens <= budget:
        return 1 / least
    c, whole = budget / mass, -1
    while True:
        full = F.lit(c) * F.col("weight") >= 1
        count, taken, rest = cells.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight") * F.col("tokens")))).first()
        if count <= whole:
            return c
        if not rest:
            return 1 / least
        c, whole = max(0.0, (budget - float(taken)) / rest), count


def draw(id_col: str, text: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the row's id and text alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text))), F.lit(1 << 52)) / float(1 << 52)


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = SEED, topic: Column | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with topic, n_tokens, weight (raked token weight of the cell), prob (calibrated to the budget) and sampled.

    Tokens are pre-aggregated by cell (source, language, topic) of all rows; the weights of the cells are raked to the marginal
    targets in turn until all hold. A document is sampled if its draw, a hash of id and text, is below its probability, so
    a rerun samples the same rows, and equal rows share their fate. Null categories are categories. Documents without tokens
    change no marginal and are sampled at the budget. A probability is 1 at most: cells that need more are taken whole.
    An empty table gives none. Input columns of the names that are made here get an underscore at their end.
    """
    docs, _ = set_aside(docs, *MADE, *(f"_{d}" for d in DIMENSIONS), keep=(text, id_col))
    if not 0 < budget <= 1:
        raise ValueError("the budget is a share of all tokens")
    topics = topic if topic is not None else topic_of(F.col(text))
    counted = docs.withColumns({"topic": topics, "n_tokens": token_count(F.col(text))})
    cells = counted.groupBy(*(named(F.col(d)).alias(d) for d in DIMENSIONS)).agg(F.sum("n_tokens").alias("tokens"))
    fitted, bounded = fit_cells(written(cells, "cells"), targets, temperature, budget)
    sides = (F.broadcast(fitted) if bounded else fitted).select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "weight", "prob")
    on = [named(counted[d]) == sides[f"_{d}"] for d in DIMENSIONS]
    out = counted.join(sides, on[0] & on[1] & on[2])
    return out.withColumn("sampled", draw(id_col, text, seed) < F.col("prob")).select(*docs.columns, *MADE)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("prob", 9).alias("prob"), "sampled")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the sampled documents.

    Documents without tokens (null and blank texts) are sampled at the budget; null ids are ids; rows that repeat share their fate; other columns
    stay, whatever their names; an empty table stays empty.
    """
    clear, names = set_aside(docs, *MADE, *(f"_{d}" for d in DIMENSIONS))
    return put_back(mixed(clear).where("sampled"), docs.columns, names)
