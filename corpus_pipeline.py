"""The corpus pipeline: language, near copies, benchmark passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkledger.llm import common, decontaminate, langid, mixing, simhash, tokenids

STAGES = [
    ("language", langid.langid_stage),
    ("near_duplicates", simhash.simhash_stage),
    ("decontamination", decontaminate.decontaminate_stage),
    ("mixing", mixing.mixing_stage),
    ("token_ids", tokenids.token_ids_stage),
]

#: A learnt model, 64-bit sketches and a tokenizer can't be expressed in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = common.tables_so_far()
        out = common.written(stage(spark, docs, sf_dir), name)
        # a stage's own tables, and its input if that is one, are not read again
        common.sweep(spark, since, out)
        common.forget(docs)
        docs = out
    return docs
