"""Chat formatting of maximal conversations: logged snapshots that are prefixes of longer ones collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Turns that are hashed, or rendered, as one part of a conversation.
PART_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>"


def marked(c: Column) -> Column:
    """Null is told from every string."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def numbered(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, nth, role, text): places in each conversation from 1, by turn, then role and text.

    A conversation is dealt by stretches of its turns, each numbered alone, so a very long one isn't one task's work.
    """
    rows = turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-(1 << 62))))
    sizes = rows.groupBy("conv", "part").agg(F.count("*").alias("size"))
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv", "part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "role", "text"))
    placed = rows.withColumn("within", within)
    same = placed.conv.eqNullSafe(offsets.conv) & (placed.part == offsets.part)
    return placed.join(offsets, same).select(placed.conv, (F.col("ahead") + F.col("within")).alias("nth"), "role", "text")


def prefixes(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, nth, p1, p2): a 128-bit rolling hash of the first nth turns, each hashed with its place, joined by exclusive or."""
    stretch = F.floor((F.col("nth") - 1) / part_turns)
    hashed = turns.select("conv", "nth", stretch.alias("part"), *(F.xxhash64(F.lit(k), "nth", marked(F.col("role")), F.lit(k + 2), marked(F.col("text"))).alias(f"h{k}") for k in (1, 2)))
    totals = hashed.groupBy("conv", "part").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("conv", "part", *(F.coalesce(F.bit_xor(f"t{k}").over(ahead), F.lit(0)).alias(f"b{k}") for k in (1, 2)))
    sofar = Window.partitionBy("conv", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("conv", "part", "nth", *(F.bit_xor(f"h{k}").over(sofar).alias(f"r{k}") for k in (1, 2)))
    same = rolled.conv.eqNullSafe(bases.conv) & (rolled.part == bases.part)
    return rolled.join(bases, same).select(rolled.conv, "nth", *(F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"p{k}") for k in (1, 2)))


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv, n): conversations that aren't a prefix of a longer one; of equal ones that with the smallest id."""
    sizes = rolled.groupBy("conv").agg(F.max(F.struct("nth", "p1", "p2")).alias("last"))
    # one for each different conversation: equal ones are aggregated before they meet
    whole = sizes.groupBy(F.col("last.nth").alias("n"), F.col("last.p1").alias("p1"), F.col("last.p2").alias("p2")).agg(F.min("conv").alias("conv"), F.max(F.col("conv").isNull()).alias("unnamed"))
    proper = rolled.join(sizes.select(F.col("conv").alias("of"), F.col("last.nth").alias("n")), rolled.conv.eqNullSafe(F.col("of"))).where("nth < n")
    inner = proper.select(F.col("nth").alias("n"), "p1", "p2").distinct()
    return whole.join(inner, ["n", "p1", "p2"], "left_anti").select("conv", "n")


def rendered(role: Column, text: Column) -> Column:
    """One turn; markers inside of a text are broken, so a text can't start or end a turn."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(START), safe(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), safe(F.coalesce(text, F.lit(""))), F.lit(END), F.lit("\n"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int | None = PART_TURNS) -> DataFrame:
    """(conv_col, part, n_turns, rendered) of the maximal conversations, in parts of part_turns turns from 0; None: one row for each, however long.

    Turns are ordered by turn (null first), then role and text; turns that repeat are turns. Null roles are "unknown", null texts
    empty, but both differ from every string when conversations are compared. Rows whose conversation is null are one
    conversation, which gives way to an equal one that has an id. An empty table gives none; other columns are ignored.
    """
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    hashed_turns = part_turns or PART_TURNS
    placed = written(numbered(own, hashed_turns), "turns")
    kept = maximal(written(prefixes(placed, hashed_turns), "prefixes")).select(F.col("conv").alias("kept"))
    left = placed.join(kept, placed.conv.eqNullSafe(kept.kept), "left_semi")
    part = F.floor((F.col("nth") - 1) / part_turns).cast("int") if part_turns else F.lit(0)
    parts = left.groupBy("conv", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("nth", rendered(F.col("role"), F.col("text")).alias("s")))).alias("turns"))
    return parts.select(F.col("conv").alias(conv_col), "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["s"]), "").alias("rendered"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth FROM conversations
), c AS (
    SELECT conv_id, count(*) AS n, list(coalesce('=' || role, '') || chr(1) || coalesce('=' || text, '') ORDER BY nth) AS turns FROM t GROUP BY conv_id
), kept AS (
    SELECT a.conv_id FROM c a WHERE NOT EXISTS (
        SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND ((b.n > a.n AND b.turns[1:a.n] = a.turns) OR (b.n = a.n AND b.turns = a.turns AND b.conv_id < a.conv_id)))
)
SELECT conv_id, CAST((nth - 1) // 256 AS INTEGER) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY nth) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY 1, 2
"""
