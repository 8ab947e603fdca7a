import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkledger.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, n=3000):
    df = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.array_repeat(F.lit("word"), (F.col("id") % 7 + 1).cast("int")), F.when(F.col("id") % 3 == 0, "9").when(F.col("id") % 5 == 0, "!!")).alias("text"),
        F.when(F.col("id") % 11 < 7, "en").when(F.col("id") % 11 < 9, "de").alias("lang"),
        F.when(F.col("id") % 13 < 8, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"),
        F.lit(1).cast("long").alias("n_chars"),
    )
    return df


def shares(out, d, value):
    rows = out.groupBy(F.coalesce(F.col(d), F.lit("(null)")).alias("k")).agg(F.sum(value).alias("t")).collect()
    total = sum(r.t for r in rows)
    return {r.k: r.t / total for r in rows}


def test_marginals_are_met(spark):
    targets = {"source": {"hot": 0.3, "s0": 0.1, "s1": 0.2, "s2": 0.2, "s3": 0.2}, "lang": {"en": 0.5, "de": 0.3, "(null)": 0.2}, "topic": {"data": 0.5, "prose": 0.4, "promotion": 0.1}}
    out = mixing.mixed(corpus(spark), targets, budget=0.2).cache()
    assert out.count() == 3000 and out.where("prob < 0 or prob > 1").count() == 0
    for d, goal in targets.items():
        got = shares(out, d, F.col("weight") * F.col("n_tokens"))
        assert got == pytest.approx(goal, abs=1e-6)
        assert shares(out, d, F.col("prob") * F.col("n_tokens")) == pytest.approx(goal, abs=0.02)
    tokens, expected, sampled = out.agg(F.sum("n_tokens"), F.sum(F.col("prob") * F.col("n_tokens")), F.sum(F.when(F.col("sampled"), F.col("n_tokens")))).first()
    assert expected == pytest.approx(0.2 * tokens, rel=1e-6) and sampled == pytest.approx(0.2 * tokens, rel=0.1)


def test_distributed_fitting_agrees(spark, monkeypatch):
    a = {tuple(r[:1]): r.prob for r in mixing.mixed(corpus(spark, 400), budget=0.3).select("doc_id", "prob").collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 5)
    monkeypatch.setattr(mixing, "SPARK_ROUNDS", 5)
    b = {tuple(r[:1]): r.prob for r in mixing.mixed(corpus(spark, 400), budget=0.3).select("doc_id", "prob").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.01 for k in a)


def test_distributed_fitting_stops_by_the_same_rule(spark, monkeypatch):
    """Nearly diagonal cells: the marginals hold only after many rounds."""
    rows = [(n, "w " * t, g, s, 1) for n, (s, g, t) in enumerate([("a", "x", 400), ("a", "y", 20), ("b", "y", 300), ("b", "x", 15), ("c", "x", 30), ("c", "y", 35)])]
    rows.append((99, None, "z", "d", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    targets = {"source": {"a": 0.3, "b": 0.5, "c": 0.2, "d": 0.5}, "lang": {"x": 0.6, "y": 0.4}}
    fits = []
    plain = mixing.fit

    def counted(keys, tokens, goals):
        fits.append(np.abs(plain(keys, tokens, goals, rounds=8) / plain(keys, tokens, goals) - 1)[tokens > 0].max())
        return plain(keys, tokens, goals)

    monkeypatch.setattr(mixing, "fit", counted)
    pick = lambda: {r.doc_id: (r.weight, r.prob) for r in mixing.mixed(df, targets, budget=0.4).select("doc_id", "weight", "prob").collect()}
    a = pick()
    assert fits[0] > 1e-4
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 3)
    b = pick()
    assert len(fits) == 1 and a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], rel=1e-6) for k in a)


def test_distributed_fitting_without_tokens(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 1)
    silent = spark.createDataFrame([(1, " ", "en", "s", 1), (2, None, "de", "s", 1)], SCHEMA)
    assert {(r.weight, r.prob) for r in mixing.mixed(silent, budget=0.25).collect()} == {(1.0, 0.25)}


def test_against_plain_raking(spark):
    rows = corpus(spark, 500).collect()
    topic = lambda t: "empty" if not t else "promotion" if "!!" in t else "data" if re.search("[0-9]", t) else "prose"
    cells = {}
    for r in rows:
        k = (r.source, r.lang or "(null)", topic(r.text))
        cells[k] = cells.get(k, 0) + len(r.text.split())
    goals = []
    for i in range(3):
        sums = {}
        for k, t in cells.items():
            sums[k[i]] = sums.get(k[i], 0) + t
        raw = {k: (v / sum(sums.values())) ** 0.7 for k, v in sums.items()}
        goals.append({k: v / sum(raw.values()) for k, v in raw.items()})
    w, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    for _ in range(300):
        for i in range(3):
            now = {}
            for k in cells:
                now[k[i]] = now.get(k[i], 0) + w[k] * cells[k] / total
            w = {k: w[k] * goals[i][k[i]] / now[k[i]] for k in cells}
    got = {(r.source, r.lang or "(null)", r.topic): r.weight for r in mixing.mixed(corpus(spark, 500)).collect()}
    assert got.keys() == w.keys() and all(got[k] == pytest.approx(w[k], rel=1e-5) for k in w)


def plain_topic(t):
    if not t:
        return "empty"
    for name, signs in (("legal", ("License", "Copyright")), ("promotion", ("!!",)), ("data", "0123456789")):
        if any(x in t for x in signs):
            return name
    return "prose"


def plain_draw(doc_id, text):
    """Hashes chained as they are defined, over the bytes themselves."""
    one = xxhash.xxh64_intdigest
    inner = 42 if text is None else one(text.encode(), 42)
    h = one(struct.pack("<i", mixing.SEED), 42)
    h = h if doc_id is None else one(struct.pack("<q", doc_id), h)
    h = one(struct.pack("<Q", inner), h)
    return (h % (1 << 52)) / (1 << 52)


def test_query_against_plain_probabilities_and_draws(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    name = lambda x: "(null)" if x is None else str(x)
    cell = {r.doc_id: (name(r.source), name(r.lang), plain_topic(r.text)) for r in rows}
    tokens = {r.doc_id: len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or "")) for r in rows}
    cells = {}
    for d, k in cell.items():
        cells[k] = cells.get(k, 0) + tokens[d]
    total = sum(cells.values())
    goals = []
    for i in range(3):
        share = {}
        for k, t in cells.items():
            share[k[i]] = share.get(k[i], 0) + t / total
        raw = {k: v**0.7 if v else 0.0 for k, v in share.items()}
        goals.append({k: v / sum(raw.values()) for k, v in raw.items()})
    w = dict.fromkeys(cells, 1.0)
    for _ in range(200):
        worst = 0.0
        for i in range(3):
            now = {}
            for k in cells:
                now[k[i]] = now.get(k[i], 0) + w[k] * cells[k] / total
            worst = max(worst, *(abs(goals[i][x] - now[x]) for x in now))
            w = {k: w[k] * (goals[i][k[i]] / now[k[i]] if now[k[i]] else 0.0) for k in cells}
        if worst < 1e-9:
            break
    low, high = 0.0, 1e9
    for _ in range(300):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1.0, c * w[k]) * cells[k] for k in cells) < 0.5 * total else (low, c)
    prob = {k: min(1.0, c * w[k]) if cells[k] else 0.5 for k in cells}
    got = {r.doc_id: r for r in mixing.op8_mixing(spark, data).collect()}
    assert got.keys() == cell.keys() and 0.3 * len(rows) < sum(r.sampled for r in got.values()) < 0.8 * len(rows)
    for r in rows:
        g, k = got[r.doc_id], cell[r.doc_id]
        assert (g.topic, g.n_tokens) == (k[2], tokens[r.doc_id]) and g.prob == pytest.approx(prob[k], rel=1e-5)
        assert g.sampled == (plain_draw(r.doc_id, r.text) < prob[k]) or abs(plain_draw(r.doc_id, r.text) - prob[k]) < 1e-6


def test_scale():
    w, t = np.array([4.0, 1.0, 0.5]), np.array([10.0, 50.0, 40.0])
    c = mixing.scale(w, t, 50.0)
    assert (np.minimum(1, c * w) * t).sum() == pytest.approx(50)
    assert (np.minimum(1, mixing.scale(w, t, 100.0) * w) == 1).all()


def test_edges(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a " * 100_000, "en", "s", 1), (2, "b", None, "s", 1), (2, "b", None, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(df, budget=1.0).collect()
    assert len(out) == 5 and all(r.prob == 1.0 and r.sampled for r in out)
    assert mixing.mixing_stage(spark, df, "").columns == df.columns
    silent = spark.createDataFrame([(1, " ", "en", "s", 1), (2, None, "en", "s", 1)], SCHEMA)
    assert {r.prob for r in mixing.mixed(silent, budget=0.25).collect()} == {0.25}
    clash = df.withColumns({"prob": F.lit(5), "_lang": F.lit("l")})
    out = mixing.mixed(clash)
    assert {"prob_", "_lang_", "prob"} <= set(out.columns) and {r.prob_ for r in out.collect()} <= {5}
    kept = mixing.mixing_stage(spark, clash, "")
    assert kept.columns == clash.columns and {r.prob for r in kept.collect()} <= {5}
