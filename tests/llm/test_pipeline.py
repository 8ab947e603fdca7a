import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sparkledger.llm import decontaminate, langid, mixing, tokenids
from test_decontaminate import brute as leaks
from test_simhash import similar as copies

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    # language: what the model says of each text alone
    model = langid.trained(docs)
    kept = []
    for d, r in rows.items():
        spans = langid.Labeller(model).label([r.text])[0] if r.text else ([], [])
        by = np.bincount(spans[1], [len(w) for w in spans[0]], len(model.languages)) if len(spans[0]) else np.zeros(1)
        if by.sum() and by.max() / by.sum() >= langid.LEAST_SCORE:
            kept.append(d)
    # near copies: the smallest id of each group, all pairs compared
    kept = [int(d) for d, c in copies([(d, rows[d].text) for d in kept]) if int(d) == c]
    # benchmark passages
    kept = [int(x[0]) for x in leaks([(d, rows[d].text) for d in kept], bench) if not x[-1]]
    # mixture: the operator over what is left, which has tests of its own
    left = spark.createDataFrame([tuple(rows[d][c] for c in COLUMNS) for d in kept], docs.schema)
    kept = sorted(r.doc_id for r in mixing.mixed(left).where("sampled").collect())
    lib, at, want = Tokenizer.from_file(tokenids.default_tokenizer()), 0, []
    for d in kept:
        ids = [*lib.encode(rows[d].text, add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert len(want) > 30
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_ids"]


def staged(spark, docs, folder, bench=None):
    """What is left after each stage, the last but one, with all columns."""
    bench = bench or [(1, "unseen words of an item that no document of this table holds anywhere at all")]
    spark.createDataFrame(bench, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], str(folder)))
    return out


def test_stages_pass_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, very long and empty texts, and columns with the names that stages make."""
    made = ", lang_pred string, score double, topic string, n_tokens long, prob string, sampled int, _hits int, _hash string, _nth long, fp string, weight boolean"
    extra = ("p", 0.5, "t", 7, "q", 1, 2, "h", 3, "f", True)
    text = "the cat and the dog were here with some other words that are of no use at all "
    rows = [(1, text * 3, "en", "s", 1), (1, text * 3, "en", "s", 1), (None, text + "zz", None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "12 34 ½", "en", "s", 7), (5, "der die das und ein haus ist gross " * 4000, "de", "t", 9), (None, None, None, None, None), (6, text + "one more end", "en", "s", 5)]
    df = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + made)
    out = staged(spark, df, tmp_path)
    for stage in out[1:-1]:
        assert stage.columns == df.columns
        assert all(tuple(r)[5:] == extra for r in stage.collect())
    kept = {r.doc_id for r in out[2].collect()}
    assert {1, 5, 6} <= kept and not kept & {2, 3, 4} and out[2].where("doc_id = 1").count() == 1
    assert out[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    hit = staged(spark, df, tmp_path, [(9, "the cat and the dog were here with some other"), (None, "words"), (8, None)])
    assert {r.doc_id for r in hit[3].collect()} == {5}


def test_empty_tables_pass_all_stages(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # an empty benchmark drops nothing
    df = spark.createDataFrame([(1, "some words here", "en", "s", 1)], none.schema)
    assert decontaminate.decontaminate_stage(spark, df, str(tmp_path)).count() == 1


def test_last_stage_gives_the_ids_as_read_back(spark):
    lib = Tokenizer.from_file(tokenids.default_tokenizer())
    rows = [(3, "Some text, and more."), (1, None), (None, "x"), (3, "again"), (2, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokenids.token_ids_stage(spark, df, "").collect())
    at, sizes = 0, []
    for start, n, _ in got:
        assert start == at
        at += n
        sizes.append(n)
    assert sorted(sizes) == sorted(len(lib.encode(t, add_special_tokens=False).ids) + 1 if t else 1 for _, t in rows)
