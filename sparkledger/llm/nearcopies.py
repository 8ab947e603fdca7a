"""Near copies by the similarity of their word shingles, for the pipeline: a wider rule than a fingerprint's few bits.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked. At that similarity 64-bit fingerprints differ in about 8
bits, and often in 12, where segments with one wildcard are too short to select anything. So fingerprints find the closer copies, and
bands of minimum hashes the others; both only name buckets, in which the same verification decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, released, written
from .simhash import near_links, shingle_hashes, simhash
from .tokenids import gathered

WORDS, SIMILARITY = 5, 0.8
#: Permutations of a sketch, of which one byte each is kept; bands, each of so many minima. At a similarity of 0.8 two sets miss every band once in 1,600 times.
PERMUTATIONS, BANDS, ROWS = 128, 14, 4
#: Sets of at least so many shingles are decided by their sketches where these say less than LOW, or HIGH or more; smaller ones below SMALL_LOW. All others are compared as sets.
LARGE, LOW, HIGH, SMALL_LOW = 256, 0.68, 0.92, 0.5
#: Buckets up to FEW are compared pair by pair in arrays, the likeliest pairs first; those over HOT are dealt to stripes.
FEW, HOT = 256, 4096
#: What a first pass leaves of a bucket is dealt to blocks of so many sets and, where sets are held, of so many bytes; a task compares two blocks.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Shingles that are permuted at a time.
STEP = 2048
FACTORS = (np.random.default_rng(5).integers(0, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1)) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of a set under each permutation."""
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), STEP):
        np.minimum(out, (shingles[at : at + STEP, None] * FACTORS).min(axis=0), out=out)
    return out


def sketch_of(least: np.ndarray) -> bytes:
    return ((least * MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def bands_of(least: np.ndarray) -> list[int]:
    """A key for each band."""
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


PRINTS = "id long, hash long, fp long, sig long, size int, sketch binary, bands array<long>"


def with_sketches(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """PRINTS of every row: hash is that of the text, sig that of its set of shingles (0 without words), size the number of these."""
    import xxhash

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                h = shingle_hashes(value.as_py(), words)
                distinct = np.unique(h)
                least = minima(distinct)
                row = (simhash(h), xxhash.xxh64_intdigest(distinct.tobytes()) if len(h) else 0, len(distinct), sketch_of(least), bands_of(least) if len(h) else [])
                for column, x in zip(made, row):
                    column.append(x)
            signed = np.array(made[1], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made[0], pa.int64()), pa.array(signed), pa.array(made[2], pa.int32()), pa.array(made[3], pa.binary()), pa.array(made[4], pa.list_(pa.int64()))], ["id", "hash", "fp", "sig", "size", "sketch", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(lambda batches: released(each(batches)), PRINTS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from sketches; two different minima share a byte once in 256 times."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def least_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a pair's estimate must reach to be a candidate, by the sizes of its sets."""
    return np.where(np.minimum(a, b) >= LARGE, LOW, SMALL_LOW)


def likeliest(sketches: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bucket's candidates, the likeliest pairs first: so where any pair between two parts is similar enough, the one that links them is."""
    n = len(sizes)
    if n == 2:
        return [(0, 1)] if estimate(sketches[0], sketches[1]) >= least_of(sizes[:1], sizes[1:])[0] else []
    if n > FEW:
        out, left = [], np.arange(n)
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                a = queue.pop()
                near = estimate(sketches[left], sketches[a]) >= SIMILARITY
                found = left[near].tolist()
                out += [(a, b) for b in found]
                queue += found
                left = left[~near]
        return out
    a, b = np.triu_indices(n, 1)
    say = np.concatenate([estimate(sketches[i + 1 :], sketches[i]) for i in range(n - 1)])
    may = np.flatnonzero(say >= least_of(sizes[a], sizes[b]))
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for k in may[np.argsort(-say[may], kind="stable")].tolist():
        x, y = top(int(a[k])), top(int(b[k]))
        if x != y:
            up[y] = x
            out.append((int(a[k]), int(b[k])))
            if len(out) == n - 1:
                break
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, sure) from rows (key, sig, size, sketch): pairs of sigs in a bucket that may be similar enough, a spanning forest of each bucket; sure: the sketches decide."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, PERMUTATIONS), np.uint8)

        def found(keys: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
            counts = np.diff(np.append(starts, len(keys)))
            two = starts[counts == 2]
            two = two[estimate(sketches[two], sketches[two + 1]) >= least_of(sizes[two], sizes[two + 1])]
            more = [(at + x, at + y) for at, n in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist()) for x, y in likeliest(sketches[at : at + n], sizes[at : at + n])]
            pairs = np.concatenate((np.stack((two, two + 1), axis=1), np.array(more, np.int64).reshape(-1, 2)))
            i, j = pairs[:, 0], pairs[:, 1]
            sure = (np.minimum(sizes[i], sizes[j]) >= LARGE) & (estimate(sketches[i], sketches[j]) >= HIGH)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(sigs[i], sigs[j])), pa.array(np.maximum(sigs[i], sigs[j])), pa.array(sure)], ["a", "b", "sure"])

        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
            own = [*(batch.column(c).to_numpy() for c in range(3)), flat]
            keys, *others = (np.concatenate(x) for x in zip(held, own))
            # the last bucket may go on in the next batch
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield found(keys[:cut], *(x[:cut] for x in others))
            held = keys[cut:], *(x[cut:] for x in others)
        yield found(*held)

    made = rows.select("key", "sig", "size", "sketch").repartition("key").sortWithinPartitions("key", "sig").mapInArrow(lambda batches: released(each(batches)), "a long, b long, sure boolean")
    return made.groupBy("a", "b").agg(F.bool_or("sure").alias("sure"))


def buckets(classes: DataFrame, max_bits: int, hot: int = HOT) -> DataFrame:
    """(bucket, key, sig) of buckets with more than one sig: bands, and components of fingerprints at max_bits or fewer differing bits.

    A bucket of over hot sigs is dealt to stripes, its keys, by a hash of bucket and sig, so each of a sig's buckets brings it together with others;
    others have one key. What meets in a bucket but not under a key is left to rest().
    """
    roots = components(near_links(classes.select("fp").distinct(), max_bits))
    prints = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").where("size > 0")
    one = F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp"))))).alias("key")
    rows = written(prints.select("sig", one), "buckets")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    stripe = F.when(F.col("n") > hot, F.xxhash64("key", F.pmod(F.xxhash64("sig", "key"), F.ceil(F.col("n") / hot)))).otherwise(F.col("key"))
    return rows.join(sizes, "key").select(F.col("key").alias("bucket"), stripe.alias("key"), "sig")


def dealt(rows: DataFrame, block: int, held: int | None = None) -> DataFrame:
    """rows (bucket, sig, root, size) of buckets with more than one root, under key and side.

    A bucket of over block sigs (or of over held bytes of shingles) is dealt to blocks, and every two blocks meet under one key, a block with itself under
    another: side is 0 or 1, or 2 where a block meets itself. So a sig comes as often as its bucket has blocks.
    """
    n, bytes_ = F.count("*"), F.sum(F.col("size").cast("long")) * 4
    blocks = F.greatest(F.ceil(n / block), F.ceil(bytes_ / held)) if held else F.ceil(n / block)
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), blocks.alias("blocks")).where("least <> most").select("bucket", "blocks")
    own = rows.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("sig", "bucket"), "blocks"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    return met.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"), side.alias("side"), "bucket", "sig", "root", "size")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches whose first column is sorted, cut so that none ends inside a group of equal keys, and where its groups start and end."""
    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
        held = batch[starts[-1] :]
        if len(starts) > 1:
            yield batch[: starts[-1]], list(zip(starts, starts[1:]))
    if held is not None:
        yield held, [(0, held.num_rows)]


def most_common(roots: np.ndarray) -> int:
    values, counts = np.unique(roots, return_counts=True)
    return values[counts.argmax()]


def meeting(sides: np.ndarray, x: int) -> np.ndarray:
    """What is compared with x: the other side, or all where a block meets itself."""
    return (sides != sides[x]) | (sides[x] == 2)


def doubtful(roots: np.ndarray, sides: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Whether each sig of a group has another, of another root, whose sketch allows that they are similar enough."""
    out = np.zeros(len(roots), bool)
    for x in np.flatnonzero(roots != most_common(roots)).tolist():
        others = np.flatnonzero((roots != roots[x]) & meeting(sides, x))
        found = others[estimate(sketches[others], sketches[x]) >= least_of(sizes[others], sizes[x])]
        out[found] = True
        out[x] |= len(found) > 0
    return out


def joined(sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (places) between similar sets of a group that make one of its roots that any similar pair connects; no link inside a root.

    What a set has in common with all others is counted at once, from the list of the sets that hold each value.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    order = np.argsort(flat, kind="stable")
    holders, ordered = np.repeat(np.arange(len(sets)), sizes)[order], flat[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(starts, len(ordered)))
    value = np.empty(len(flat), np.int64)
    value[order] = np.repeat(np.arange(len(starts)), counts)
    labels, out = roots.copy(), []
    for x in np.flatnonzero(roots != most_common(roots)).tolist():
        may = (labels != labels[x]) & meeting(sides, x) & (sizes >= similarity * sizes[x] - 1e-9) & (similarity * sizes <= sizes[x] + 1e-9)
        if not may.any():
            continue
        own = value[ends[x] - sizes[x] : ends[x]]
        common = np.bincount(gathered(holders, starts[own], counts[own]), minlength=len(sets))
        for y in np.flatnonzero(may & (common >= similarity * (sizes + sizes[x] - common) - 1e-9)).tolist():
            if labels[y] != labels[x]:
                labels[labels == labels[y]] = labels[x]
                out.append((x, y))
    return out


def rest(docs: DataFrame, rows: DataFrame, classes: DataFrame, roots: DataFrame, text: str, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between similar sets in buckets (rows: bucket, sig) that lie in different components (roots: node, root).

    These are what stripes kept apart and what a bucket's forest left out for a pair that then failed. Pairs are compared in arrays and never are rows:
    first the sketches tell which sigs of a bucket have any candidate in another component, then the sets of these are
    brought together and decided, and of each group come out no more links than it has components. Buckets of two were decided whole.
    """
    more = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 2").select("bucket")
    rooted = classes.select("sig", "size").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "size", F.coalesce("root", "sig").alias("root"))
    every = written(rows.join(more, "bucket", "left_semi").select("bucket", "sig").join(rooted, "sig"), "rest")
    together = lambda made: made.repartition("key").sortWithinPartitions("key", "sig")

    def doubted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, groups in whole_groups(batches):
            sides, found_roots, sizes = (batch.column(c).to_numpy() for c in (1, 4, 5))
            sketches = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
            keep = np.concatenate([doubtful(found_roots[a:b], sides[a:b], sizes[a:b], sketches[a:b]) for a, b in groups])
            yield batch.select(["bucket", "sig", "root", "size"]).filter(pa.array(keep))

    first = together(dealt(every, block).join(classes.select("sig", "sketch"), "sig").select("key", "side", "bucket", "sig", "root", "size", "sketch"))
    left = written(first.mapInArrow(lambda batches: released(doubted(batches)), "bucket long, sig long, root long, size int").distinct(), "rest")
    forget(every)
    made = sets_of(docs, left.select("sig").distinct(), classes, text, words)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, groups in whole_groups(batches):
            sides, sigs, found_roots = (batch.column(c).to_numpy() for c in (1, 2, 3))
            pairs = []
            for a, b in groups:
                sets = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(4)[a:b]]
                pairs += [(a + x, a + y) for x, y in joined(sets, found_roots[a:b], sides[a:b], similarity)]
            at = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(sigs[at[:, 0]]), pa.array(sigs[at[:, 1]])], ["a", "b"])

    second = together(dealt(left, block, BLOCK_BYTES).join(made, "sig").select("key", "side", "sig", "root", "shingles"))
    out = written(second.mapInArrow(lambda batches: released(decided(batches)), "a long, b long"), "links")
    forget(left, made)
    return out


def sets_of(docs: DataFrame, sigs: DataFrame, classes: DataFrame, text: str, words: int) -> DataFrame:
    """(sig, shingles) of sigs, the sets made again from a text of each: sorted uint32 hashes."""
    hashes = classes.join(sigs, "sig", "left_semi").select(F.col("best.hash").alias("hash"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            distinct = [np.unique(shingle_hashes(x.as_py(), words)) for x in batch.column(0)]
            sigs = np.array([xxhash.xxh64_intdigest(d.tobytes()) for d in distinct], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array([np.unique((d >> np.uint64(32)).astype(np.uint32)).tobytes() for d in distinct], pa.binary())], ["sig", "shingles"])

    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("hash")).join(hashes, "hash", "left_semi")
    return written(texts.select("text").mapInArrow(lambda batches: released(sets(batches)), "sig long, shingles binary").groupBy("sig").agg(F.min("shingles").alias("shingles")), "sets")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of sigs whose sets of shingles, made again from a text of each, are similar enough."""
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint32) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    made = sets_of(docs, pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), classes, text, words)
    both = pairs.join(made.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a").join(made.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
    out = written(both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "links")
    forget(made)
    return out


def with_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY, max_bits: int = 4, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(sig, best, root) of each different set of shingles: best is (nameless, doc_id, hash) of the first row with it, root names the component.

    Rows with equal sets are one class before anything is joined. Classes are linked if their Jaccard similarity is similarity or more; links of large
    sets whose sketches leave no doubt are taken as they are, the others are compared as sets. First a forest of each bucket's likeliest pairs is
    decided, then every other candidate of a bucket between the components that these left. A pair is missed by all bands once in 1,600 times at
    the threshold, and less above it. Texts without words (null, empty, blank) are one class. Rows whose id is null come after those that have one; an empty table gives none.
    """
    best = F.min(F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("doc_id"), "hash")).alias("best")
    prints = written(with_sketches(docs, text, id_col, words), "prints")
    classes = written(prints.groupBy("sig").agg(best, F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min("bands").alias("bands")), "classes")
    forget(prints)
    rows = written(buckets(classes, max_bits, hot), "buckets")
    pairs = written(candidates(rows.join(classes.select("sig", "size", "sketch"), "sig")), "pairs")
    links = pairs.where("sure").select("a", "b").union(verified(docs, pairs.where("not sure").select("a", "b"), classes, text, words, similarity))
    roots = components(links)
    more = rest(docs, rows, classes, roots, text, words, similarity, block)
    forget(rows)
    if not more.isEmpty():
        roots = components(links.union(more))
    return classes.join(roots.select(F.col("node").alias("sig"), F.col("root").alias("_root")), "sig", "left").select("sig", "best", F.coalesce("_root", "sig").alias("root"))
