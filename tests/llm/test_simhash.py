import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkledger.llm import nearcopies
from sparkledger.llm.common import components
from sparkledger.llm.nearcopies import with_copies
from sparkledger.llm.simhash import SEGMENTS, fingerprint, near_duplicates, near_links, simhash_stage


def plain(text):
    words = []
    for part in (text or "").encode().split():
        words.append(bytes(c + 32 if 65 <= c <= 90 else c for c in part))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((repr(d), f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choices(vocab, k=rng.choice([3, 40, 200])) for _ in range(40)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((1000 - i, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    return [*rows, (2000, None), (2001, ""), (2002, " \t"), (2001, ""), (None, "w1 w2"), (None, None), (3, "é " * 3000), (4, "A\x0bB\xa0c d e f g")]


def test_all_rows_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([Row(doc_id=d, text=t, fp=1, key="x", root="y") for d, t in rows], "doc_id long, text string, fp int, key string, root string")
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in near_duplicates(df).collect())
    assert got == brute(rows)


def test_fingerprint_is_signed():
    for _, t in corpus():
        assert fingerprint(t) % (1 << 64) == plain(t)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300, 300)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def shingles_of(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(rows):
    """(repr of id, component) of every row: sets of five-word shingles with a similarity of 0.8 or more are linked, all pairs compared; wordless texts are equal."""
    sets = [shingles_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(repr(d), least.get(find(i))) for i, (d, _) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    df = spark.createDataFrame([Row(doc_id=d, text=t, lang="en", source="s", n_chars=1) for d, t in rows], SCHEMA)
    out = simhash_stage(spark, df, "")
    assert out.columns == df.columns
    want = {d for d, c in similar(rows) if c is not None and d == repr(c)}
    assert {repr(r.doc_id) for r in out.collect() if r.doc_id is not None} == want
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))


def test_stage_finds_chains_and_large_buckets(spark):
    """Copies of copies, long and short texts, and one passage that most texts start with; buckets are dealt to stripes of 30."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(900)]
    head = rng.choices(vocab, k=60)
    rows = []
    for base in range(12):
        words = (head if base % 2 else []) + rng.choices(vocab, k=rng.choice([25, 120, 600, 1500]))
        for _ in range(25):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 90)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
    rows += [(len(rows) + i, " ".join(head + rng.choices(vocab, k=25))) for i in range(120)]
    df = spark.createDataFrame([Row(doc_id=d, text=t, lang="en", source="s", n_chars=1) for d, t in rows], SCHEMA)
    want = {c for _, c in similar(rows)}
    assert len(want) > 20
    for hot in (nearcopies.HOT, 30):
        kept = with_copies(df, hot=hot).groupBy("root").agg(F.min("best.doc_id").alias("d")).collect()
        assert {r.d for r in kept} == want, hot


def test_no_link_is_lost_where_most_pairs_just_fail(spark):
    """Buckets of texts at a similarity of 0.76, with a few pairs at 0.8: whatever a forest of the likeliest pairs, or a stripe, leaves out is decided afterwards."""
    rng = random.Random(4)
    rows = []
    for base in range(2):
        words = [f"v{base}x{i}" for i in range(360)]
        for _ in range(100):
            own = list(words)
            for i in rng.sample(range(360), 5):
                own[i] = f"n{rng.getrandbits(40)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame([Row(doc_id=d, text=t, lang="en", source="s", n_chars=1) for d, t in rows], SCHEMA)
    want = {c for _, c in similar(rows)}
    assert 20 < len(want) < len(rows)
    for hot in (nearcopies.HOT, 8):
        kept = with_copies(df, hot=hot).groupBy("root").agg(F.min("best.doc_id").alias("d")).collect()
        assert {r.d for r in kept} == want, hot


def test_pairs_that_just_fail_are_never_rows(spark, monkeypatch):
    """One bucket of 240 texts at a similarity of 0.76 and a few pairs at 0.8: no table holds more rows than the sets have buckets, in blocks as well, and no link is lost."""
    rng = random.Random(9)
    words, rows = [f"v{i}" for i in range(360)], []
    for n in range(240):
        own = list(words)
        for i in rng.sample(range(360), 5):
            own[i] = f"n{rng.getrandbits(40)}"
        rows.append((n, " ".join(own)))
    df = spark.createDataFrame([Row(doc_id=d, text=t, lang="en", source="s", n_chars=1) for d, t in rows], SCHEMA)
    want = {c for _, c in similar(rows)}
    assert 20 < len(want) < len(rows)
    made = []

    def counted(frame, label, f=nearcopies.written):
        out = f(frame, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(nearcopies, "written", counted)
    for options in ({}, {"hot": 8, "block": 30}):
        made.clear()
        kept = with_copies(df, **options).groupBy("root").agg(F.min("best.doc_id").alias("d")).collect()
        assert {r.d for r in kept} == want, options
        assert max(n for _, n in made) <= len(rows) * (nearcopies.BANDS + 1), made


def test_groups_are_decided_as_all_pairs_are():
    """Links of one group, with sides and without, against all pairs."""
    rng = np.random.default_rng(3)
    for case in range(60):
        n, base = 30, rng.choice(5000, 40, replace=False)
        sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(33, 40), replace=False), rng.integers(0, 5000, rng.integers(0, 4))))).astype(np.uint32) for _ in range(n)]
        roots, sides = rng.integers(0, 12, n), rng.integers(0, 2, n) if case % 2 else np.full(n, 2)
        links = nearcopies.joined(sets, roots, sides, 0.8)
        pairs = [(i, j) for i in range(n) for j in range(i) if (sides[i] != sides[j] or sides[i] == 2) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        assert len(links) < 12 and all((max(x), min(x)) in pairs for x in links)

        def parts(links, roots=roots):
            label = roots.copy()
            for i, j in links:
                label[label == label[i]] = label[j]
            return [np.flatnonzero(label == x).tolist() for x in sorted(set(label.tolist()), key=label.tolist().index)]

        assert parts(links) == parts(pairs)


def test_edges_of_the_stage(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash_stage(spark, none, "").count() == 0
    a = " ".join(f"a{i}" for i in range(80))
    clash = spark.createDataFrame([(1, a, None, None, 1, "h", 2, 3), (2, a + " more", None, None, 1, "i", 4, 5), (None, None, None, None, None, None, None, None), (3, "x " * 60_000, "en", "s", 9, "j", 6, 7)], SCHEMA + ", _hash string, _nth int, sig int")
    out = simhash_stage(spark, clash, "")
    assert out.columns == clash.columns and sorted((repr(r.doc_id), r._hash, r._nth, r.sig) for r in out.collect()) == [("1", "h", 2, 3), ("3", "j", 6, 7), ("None", None, None, None)]


def test_stage_keeps_one_row_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(5, a), (5, b), (3, b), (None, c), (None, c), (None, c.upper()), (9, a), (None, a), (7, None), (7, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out = simhash_stage(spark, spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema), "").collect()
    got = sorted((repr(r.doc_id), (r.text or "").lower()) for r in out)
    assert got == sorted([("5", a), ("3", b), ("None", c), ("7", "")])


def roots_of(fps, max_bits):
    """Components of all pairs at so many bits or fewer, all compared."""
    fps = np.array(fps, np.uint64)
    root = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= max_bits)
        least = root[near].min()
        root[np.isin(root, root[near])] = least
    groups = {}
    for f, r in zip(fps.view(np.int64).tolist(), root.tolist()):
        groups.setdefault(r, set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def crowd():
    """One value of a segment shared by 1,500 fingerprints of many components, one dense group of 1,500, pairs at 1 to 5 bits."""
    rng = random.Random(3)
    out = {rng.getrandbits(64) for _ in range(400)}
    out |= {(rng.getrandbits(42) << 22) | 0x2ABCDE for _ in range(1200)}
    out |= {f ^ (1 << rng.randrange(22, 64)) ^ (1 << rng.randrange(64)) for f in sorted(out)[:300]}
    centre = rng.getrandbits(64)
    for _ in range(1500):
        f = centre
        for _ in range(rng.randrange(7)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    for f in sorted(out)[:200]:
        for n in (1, 2, 3, 4, 5):
            g = f
            for i in rng.sample(range(64), n):
                g ^= 1 << i
            out.add(g)
    return sorted(out)


@pytest.mark.parametrize(("max_bits", "hot"), [(4, 1 << 15), (4, 100), (5, 1 << 15), (1, 100)])
def test_no_link_is_lost_under_a_shared_key(spark, max_bits, hot):
    fps = crowd()
    prints = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = near_links(prints, max_bits, hot)
    assert links.count() < 30 * len(fps)
    groups = {}
    for r in components(links).collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == roots_of(fps, max_bits)
    assert SEGMENTS[1] == 22
