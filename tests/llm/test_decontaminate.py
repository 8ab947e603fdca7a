import hashlib
import random
import re

import numpy as np
from pyspark.sql import Row

from sparkledger.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        if n and item is not None:
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((repr(doc), len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out)


def cases():
    rng = random.Random(3)
    vocab = ["a", "b", "c", "Émile", "x1", "ñu", "Zz"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 7, 10, 11, 25, 60])))) for i in range(2, 40) if i % 5]
    items += [(100, ""), (101, None), (None, "a b c"), (3, "q w e r t y u i o p"), (102, "!?"), (103, "only-seven words, here and no more")]
    docs = []
    for i in range(150):
        parts = rng.choices(vocab + ["k1", "k2", "k3", "k4"], k=rng.choice([0, 3, 12, 80]))
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([t for _, t in items if t]))
        docs.append((i, rng.choice([" ", "\n", ", ", "--"]).join(parts)))
    docs += [(500, None), (500, ""), (501, "x1 " * 9000 + "q w e r t y u i o p"), (None, "Q W E R T Y U I O P" * 2), (7, "q w e r t y u i o")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    df = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([Row(item_id=i, text=t, doc_id=5) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for size in (d.BLOCK_CHARS, 300):
        found = d.benchmark_hits(df, bench, block_chars=size).collect()
        got = []
        for r in found:
            ids = sorted(map(str, r["_items"]))
            n = sum(b - a for a, b in zip(r["_hits"][::2], r["_hits"][1::2]))
            got.append((repr(r.doc_id), r["_words"], n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0))
        assert sorted(got) == want


def test_query_and_stage(spark, tmp_path):
    docs, items = cases()
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang=None, source="s", n_chars=1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([Row(item_id=i, text=t) for i, t in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, items)
    assert sorted((repr(r[0]), *r[1:]) for r in d.op7_decontaminate(spark, str(tmp_path)).collect()) == want
    kept = d.decontaminate_stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.benchmark_hits(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
    rows = d.benchmark_hits(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()
    assert [(r["_words"], r["_hits"], r["_items"]) for r in rows] == [(2, [], [])]


def test_every_frame_has_its_minimum():
    values = np.random.default_rng(0).integers(0, 4, 500).astype(np.uint64)
    kept = set(d.kept_minima(values, 6).tolist())
    scrambled = (values * d.MIXER).tolist()
    for i in range(495):
        least = min(scrambled[i : i + 6])
        assert any(k in kept and scrambled[k] == least for k in range(i, i + 6))


def test_index_takes_few_bytes_a_character():
    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400))) for i in range(200)]
    index = d.Index.of(items)
    assert index.n_bytes < 6 * sum(len(t) for _, t in items)
    words = d.words_of(items[7][1])[50:90]
    known = d.WordHashes()
    hit, found = index.matches([b"x", *words, b"y"], np.fromiter(map(known.__getitem__, [b"x", *words, b"y"]), np.uint64, 42), 10, 5)
    assert hit.tolist() == [False] + [True] * 40 + [False] and found == {7}
