"""Near-duplicate documents by SimHash with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, forget, put_back, set_aside, table, written

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: First bit of each of the three segments, and the end: of at most 5 differing bits one segment has at most one.
SEGMENTS = (0, 22, 43, 64)
#: A key holds a segment's value from bit 0, the stripe of a hot key, and the number of the wildcard bit.
STRIPE, WILD = 24, 56
#: A group of so many is compared pair by pair in arrays; a key of over HOT fingerprints is dealt to stripes; so many hot keys are sent to all tasks.
FEW, HOT, LISTED = 24, 1 << 15, 100_000
#: So many hashes are counted at a time.
STEP = 1 << 14


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words than a shingle: the whole sequence is the shingle; null or no words: none."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(tokens), min(words, len(tokens))
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(tokens) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; 0 of none. Returned as a signed 64-bit value."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's shingles; null or no words: 0."""
    return simhash(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, fp, hash) of every row, with the hash of the text; rows stay where they are, only these columns are kept."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((fingerprint(x.as_py()) for x in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(2)], ["id", "fp", "hash"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(each, "id long, fp long, hash long")
    return out.select(F.col("id").alias(id_col), "fp", "hash")


def close(a: str, b: str, max_bits: int) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def segment(n: int) -> F.Column:
    """The bits of fp in a segment, as a number from 0."""
    low, high = SEGMENTS[n], SEGMENTS[n + 1]
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def variants(n: int, value: F.Column) -> list[F.Column]:
    """One-wildcard variants of a segment: the value with one bit raised, under the number of that bit."""
    low, high = SEGMENTS[n], SEGMENTS[n + 1]
    return [value.bitwiseOR(F.lit(i << WILD | 1 << (i - low))) for i in range(low, high)]


def spanning(fps: np.ndarray, wild: int | None, max_bits: int) -> list[tuple[int, int]]:
    """Links (places) of a spanning forest of the close pairs of one group: each fingerprint that is reached is
    compared with those that aren't yet, so a dense group costs little more than its size and gives fewer links than rows.
    wild: only pairs that differ in this bit."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            x = fps[left] ^ fps[a]
            near = np.bitwise_count(x) <= max_bits
            if wild is not None:
                near &= (x >> np.uint64(wild) & np.uint64(1)).astype(bool)
            if near.any():
                found = left[near].tolist()
                out += [(a, b) for b in found]
                queue += found
                left = left[~near]
    return out


def forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between close fingerprints of equal keys (sorted), a spanning forest of each group.

    Two that agree in the whole segment meet under each of its variants: they count under the first alone, and in stripes.
    """
    n = len(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    wild = keys.astype(np.uint64) >> np.uint64(WILD)
    bits, striped = np.uint64(1) << wild, keys.astype(np.uint64) >> np.uint64(STRIPE) & np.uint64((1 << (WILD - STRIPE)) - 1)
    first = np.isin(wild, np.array(SEGMENTS[:-1], np.uint64)) | (striped > 0)
    ends = np.repeat(starts + sizes, sizes)
    a, b, rows = [], [], np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW), sizes))
    for step in range(1, FEW):
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        x = fps[rows] ^ fps[rows + step]
        near = rows[(np.bitwise_count(x) <= max_bits) & (first[rows] | (x & bits[rows] != 0))]
        a.append(near)
        b.append(near + step)
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    links = []
    for i, j in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist()) if a else ():
        x, y = top(i), top(j)
        if x != y:
            up[max(x, y)] = min(x, y)
            links.append((i, j))
    for k in np.flatnonzero(sizes > FEW).tolist():
        at = int(starts[k])
        links += [(at + i, at + j) for i, j in spanning(fps[at : at + int(sizes[k])], None if first[at] else int(wild[at]), max_bits)]
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def linked(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) of a spanning forest of the close pairs under each key of keyed (key, fp)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = forest(keys, fps, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys, fps = (np.concatenate((h, batch.column(c).to_numpy().view(h.dtype))) for c, h in enumerate(held))
            # the last group may go on in the next batch
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield found(keys[:cut], fps[:cut])
            held = keys[cut:], fps[cut:]
        yield found(*held)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(each, "a long, b long")


def hot_keys(prints: DataFrame, hot: int) -> DataFrame | None:
    """(key, stripes) of keys that hold over so many fingerprints, from counts of whole segments; None: there are none."""
    values = [F.struct(F.lit(n).alias("n"), segment(n).alias("value")) for n in range(len(SEGMENTS) - 1)]
    counts = prints.select(F.explode(F.array(*values)).alias("s")).groupBy("s.n", "s.value").agg(F.count("*").alias("size")).where(F.col("size") > hot)
    counts = written(counts, "hot")
    if counts.isEmpty():
        forget(counts)
        return None
    every = F.when(F.col("n") == 0, F.array(*variants(0, F.col("value"))))
    for n in range(1, len(SEGMENTS) - 1):
        every = every.when(F.col("n") == n, F.array(*variants(n, F.col("value"))))
    # a key also holds the fingerprints of a second value, which are no more than hot if it isn't listed
    return written(counts.select(F.explode(every).alias("hot_key"), "size").groupBy("hot_key").agg(F.ceil((F.sum("size") + hot) / hot).alias("stripes")), "hot")


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, no repeats) whose components are those of all pairs
    at max_bits or fewer differing bits (at most 5).

    Three segments leave one segment that differs by at most one bit; each of its one-wildcard variants (the segment with one
    bit raised) is indexed, equal keys meet in one sorted stretch, pairs are verified bit by bit, and of each group only a spanning forest
    of its close pairs comes out: no pairs within a group, and nothing of groups without any.
    A key of over hot fingerprints is dealt to stripes of about that size, by a hash of key and fingerprint. So the fingerprints of a dense
    group meet others under each of their keys, and nearly all of the group is one component. What close pairs are left between
    components under such keys, across stripes, is joined and verified, without the pairs inside the largest component.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("three segments find pairs at 5 or fewer differing bits")
    if max_bits == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    keyed = prints.select("fp", F.explode(F.array(*(v for n in range(len(SEGMENTS) - 1) for v in variants(n, segment(n))))).alias("key"))
    many = hot_keys(prints, hot)
    if many is None:
        return linked(keyed.select("key", "fp"), max_bits)
    # a small list is sent to all tasks; a longer one is joined as any table
    listed = F.broadcast(many) if many.count() <= LISTED else many
    dealt = keyed.join(listed, keyed.key == listed.hot_key, "left")
    striped = F.when(F.col("stripes") > 1, F.col("key").bitwiseOR(F.shiftleft(1 + F.pmod(F.xxhash64("key", "fp"), F.col("stripes")), STRIPE))).otherwise(F.col("key"))
    inside = written(linked(dealt.select(striped.alias("key"), "fp"), max_bits), "links")
    roots = components(inside)
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    rooted = prints.join(roots.join(sizes, "root").select(F.col("node").alias("fp"), "root", "size"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    rows = written(keyed.join(listed, keyed.key == listed.hot_key).select("key", "fp").join(rooted, "fp"), "variants")
    tops = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("size", "root")).alias("top")).where("low <> high").select("key", F.col("top.root").alias("top"))
    mixed = written(rows.join(tops, "key").select("key", "fp", "root", "top"), "variants")
    x, y = mixed.where("root <> top").alias("x"), mixed.alias("y")
    across = (F.col("x.key") == F.col("y.key")) & ((F.col("x.root") < F.col("y.root")) | (F.col("y.root") == F.col("y.top"))) & close("x.fp", "y.fp", max_bits)
    rest = written(x.join(y, across).select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct(), "links")
    forget(rows, mixed, many)
    return inside.union(rest)


def with_roots(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """classes (column fp, no repeats) with root, which names the component of each fingerprint."""
    classes = written(classes, "classes")
    roots = components(near_links(classes.select("fp"), max_bits))
    return classes.join(roots.select(F.col("node").alias("fp"), F.col("root").alias("_root")), "fp", "left").select(*classes.columns, F.coalesce("_root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of docs.

    component_id is the smallest id reachable over links of max_bits or fewer differing bits, itself included.
    Equal fingerprints are collapsed (pre-aggregated) before any join; texts that are null, empty or blank have
    fingerprint 0 and are linked like any other. Rows whose id is null keep their row and join their
    component; an id that repeats gives one row each. An empty table gives none. Other columns are ignored.
    """
    rows = written(with_fingerprints(docs, text, id_col).drop("hash"), "prints")
    linked = with_roots(rows.groupBy("fp").agg(F.min(id_col).alias("least")), max_bits)
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(of, "fp").select(id_col, digits.alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near copies: that with the smallest id (null last), then text hash, source and language.

    Texts are near copies if their sets of five-word shingles have a similarity of 0.8 or more, or are linked by others; those without
    words are copies of each other. Ids that are null or repeat don't matter, nor do the names of other columns, which stay; an empty table stays empty.
    """
    from .nearcopies import with_copies

    own, names = set_aside(docs, "_hash", "_nth")
    keep = written(with_copies(own).groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", F.col("best.hash").alias("_hash")), "kept")
    order = ("source", "lang", F.length("text"))
    hashed = own.withColumn("_hash", F.xxhash64("text"))
    # the join and the window need the same dealing of rows, so texts are shuffled once
    named = hashed.join(keep.where("doc_id is not null").hint("shuffle_merge"), ["doc_id", "_hash"], "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy(*order)))
    nameless = hashed.where("doc_id is null").withColumn("_nth", F.row_number().over(Window.partitionBy("_hash").orderBy(*order))).where("_nth = 1").join(keep.where("doc_id is null").select("_hash"), "_hash", "left_semi")
    return put_back(named.where("_nth = 1").select(*own.columns).union(nameless.select(*own.columns)), docs.columns, names)
