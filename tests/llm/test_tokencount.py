import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkledger.llm import tokencount
from sparkledger.llm.tokencount import Counter, TokenTree

COUNTER = Counter(tokencount.default_tokenizer())


def whole(text):
    return len(COUNTER.encoding.encode_ordinary(text))


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text("ab1 \n.'sé🙂", max_size=900), st.lists(st.tuples(st.integers(-3, 900), st.integers(-3, 900), st.text("ab1 \n.'s", max_size=300)), max_size=6))
def test_edits_equal_counting_again(text, edits):
    tree = TokenTree(text, COUNTER)
    assert tree.n_tokens == whole(text) and tree.text() == text
    for a, b, s in edits:
        a = min(max(0, a), len(text))
        b = min(max(a, b), len(text))
        text = text[:a] + s + text[b:]
        tree.edit(a, b, s)
        assert tree.text() == text
        assert tree.n_tokens == whole(text)


def test_small_edits_reach_few_leaves():
    rng = random.Random(0)
    text = " ".join(rng.choice(["word", "other", "x1", "\n", "  "]) for _ in range(50_000))
    tree = TokenTree(text, COUNTER)
    assert len(tree.leaves) > 500
    for _ in range(40):
        before, at = tree.reencoded, rng.randrange(len(text))
        s = rng.choice(["", " ", "new words", "\n\n"])
        text = text[:at] + s + text[at + 3 :]
        tree.edit(at, at + 3, s)
        assert tree.reencoded - before <= 6
    assert tree.text() == text and tree.n_tokens == whole(text)
    tree.edit(100, 100, "long insert " * 3000)
    tree.edit(0, len(text) // 2, "")
    assert tree.n_tokens == whole(tree.text())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", "a", "ten chars.", " \n ", "x" * 30_000, "word " * 20_000, *("".join(rng.choice("ab c1'\n") for _ in range(rng.randrange(500))) for _ in range(60))]
    df = spark.createDataFrame([Row(doc_id=i % 50, text=t, lang=None, source="s", n_chars=0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")

    def revised(t):
        n = len(t)
        t = t[: max(0, n - 10)] + "."
        t = t[: n // 2] + t[n // 2 + 5 :]
        at = min(n // 3, len(t))
        return "Revised. " + t[:at] + " [sic] " + t[at:]

    got = sorted((r.doc_id, r.n_tokens, r.n_edited) for r in tokencount.op4_token_counts(spark, str(tmp_path)).collect())
    assert got == sorted((i % 50, whole(t or ""), whole(revised(t)) if t is not None else 0) for i, t in enumerate(texts))


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.token_counts(none).count() == 0
    df = spark.createDataFrame([(1, "a b", "k")], "doc_id long, text string, _key string")
    row = tokencount.token_counts(df).first()
    assert (row.n_tokens, row.n_edited, row.n_reencoded, row._key) == (2, 2, 0, "k")
    clash = df.withColumns({"n_tokens": F.lit(7), "_edits": F.lit("e"), "leaf_chars": F.lit("c"), "_TEXT": F.lit("t")})
    row = tokencount.token_counts(clash, tokencount.revision(F.col("text"))).first()
    assert (row.n_tokens, row.n_tokens_, row._edits_, row.leaf_chars_, row._TEXT_) == (2, 7, "e", "c", "t")


def test_edits_work_on_kept_trees(spark, tmp_path, monkeypatch):
    """Trees are read from a table; an edit encodes the leaves that it reaches and no other, and rows without edits nothing."""
    texts = [f"Sentence {i} of a text, with some words. " * 400 for i in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokencount.trees(df).write.parquet(f"{tmp_path}/trees")
    kept = spark.read.parquet(f"{tmp_path}/trees")
    assert [len(r.leaf_tokens) > 40 and sum(r.leaf_chars) == len(r.text) for r in kept.collect()] == [True] * 6
    one = F.when(F.col("doc_id") == 3, F.array(F.struct(F.lit(9000).alias("start"), F.lit(9004).alias("end"), F.lit("some other words").alias("replacement")))).otherwise(F.array().cast(tokencount.KIND))
    after = tokencount.edited(kept, one)
    after.write.parquet(f"{tmp_path}/after")
    got = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/after").select("*", tokencount.total("leaf_tokens").alias("n")).collect()}
    for i, text in enumerate(texts):
        new = text[:9000] + "some other words" + text[9004:] if i == 3 else text
        assert got[i].text == new and got[i].n == whole(new) and (0 < got[i].n_reencoded <= 6 if i == 3 else got[i].n_reencoded == 0)
    # what is split again is a few leaves' text and never the whole one
    counter, seen = tokencount.Counter(tokencount.default_tokenizer()), []
    split = counter.split
    counter.split = lambda s: seen.append(len(s)) or split(s)
    row = kept.where("doc_id = 3").first()
    tree = tokencount.TokenTree.stored(row.text, row.leaf_chars, row.leaf_tokens, counter)
    assert not seen and tree.n_tokens == whole(texts[3])
    tree.edit(9000, 9004, "some other words")
    assert sum(seen) < len(texts[3]) / 4 and tree.n_tokens == got[3].n
