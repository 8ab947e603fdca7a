"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import put_back, released, set_aside, table

#: Words of a window of an item; every shared span of so many words is found.
WINDOW_WORDS = 10
#: Words of a hashed gram. With FRAME grams a frame covers WINDOW_WORDS words, so each such span holds a kept minimum.
GRAM_WORDS = 5
#: An index over more benchmark text than this is built in several blocks, each of which passes over the documents.
BLOCK_CHARS = 16 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are no word characters: ASCII but for digits and letters; upper case becomes lower case.
SPACED = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(SPACED).split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, kept for the most recent words up to a fixed number."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= FACTOR
        out += hashes[k : k + size]
    return out ^ (out >> np.uint64(29))


def kept_minima(values: np.ndarray, frame: int) -> np.ndarray:
    """Positions of the minimum of every frame of so many consecutive values (the last of equal ones), each once."""
    if len(values) < frame:
        return np.empty(0, np.int64)
    scrambled = values * MIXER
    size = len(values) - frame + 1
    at = np.zeros(size, np.int64)
    least = scrambled[:size].copy()
    for k in range(1, frame):
        now = scrambled[k : k + size]
        smaller = now <= least
        least = np.where(smaller, now, least)
        at[smaller] = k
    at += np.arange(size)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


@dataclass
class Index:
    """Windows of benchmark items, in arrays: a few bytes for each character of the items.

    items: ids; data: the words of all items with a space after each; starts: where each word starts, and the end; firsts: of each item its first word.
    windows: by length the hashes of the windows, sorted, and of each the place of its first word, once for an item. prints: sorted gram hashes of long items.
    """

    items: list[int] = field(default_factory=list)
    data: bytes = b""
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    firsts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    windows: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    prints: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    table: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))

    @classmethod
    def of(cls, items: Iterable[tuple[int, str | None]], window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> Index:
        self, known, found, parts, sizes, firsts, n_words = cls(), WordHashes(), [], [], [], [], 0
        by_length: dict[int, tuple[list, list]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            self.items.append(item)
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            n = min(window, len(words))
            runs, places = np.unique(grams(hashes, n), return_index=True)
            for column, x in zip(by_length.setdefault(n, ([], [])), (runs, places + n_words)):
                column.append(x)
            if n == window:
                # The minima of an item's frames: the same rule keeps the same grams in every text that holds the span.
                g = grams(hashes, gram)
                found.append(g[kept_minima(g, window - gram + 1)])
            parts.append(b" ".join(words) + b" ")
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            firsts.append(n_words)
            n_words += len(words)
        self.data, self.firsts = b"".join(parts), np.array(firsts, np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes)) if sizes else np.empty(0, np.int64)))
        for n, (runs, places) in by_length.items():
            h, at = np.concatenate(runs), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            self.windows[n] = h[order], at[order].astype(np.int32 if n_words < 1 << 31 else np.int64)
        if found:
            self.prints = np.unique(np.concatenate(found))
            self.table[(self.prints >> np.uint64(48)).astype(np.int64)] = True
        return self

    @property
    def n_bytes(self) -> int:
        return len(self.data) + sum(a.nbytes for a in (self.starts, self.firsts, self.prints, self.table, *(x for w in self.windows.values() for x in w)))

    def holders(self, words: list[bytes], h: int, n: int) -> list[int]:
        """Numbers of the items that have a window of these words, compared as they are."""
        hashes, places = self.windows[n]
        low, high = np.searchsorted(hashes, np.uint64(h)), np.searchsorted(hashes, np.uint64(h), "right")
        if low == high:
            return []
        text = b" ".join(words) + b" "
        same = [p for p in places[low:high].tolist() if self.data[self.starts[p] : self.starts[p + n]] == text]
        return (np.searchsorted(self.firsts, same, "right") - 1).tolist()

    def seeds(self, values: np.ndarray) -> np.ndarray:
        """Which of the values are gram hashes of the index."""
        maybe = np.flatnonzero(self.table[(values >> np.uint64(48)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.prints, values[maybe]), len(self.prints) - 1)
        return maybe[self.prints[at] == values[maybe]]

    def matches(self, words: list[bytes], hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, set[int]]:
        """Hit words as flags, and the numbers of the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        for n, (known, _) in self.windows.items():
            if len(words) < n:
                continue
            runs = grams(hashes, n)
            if n == window:
                g = grams(hashes, gram)
                at = kept_minima(g, window - gram + 1)
                seeds = at[self.seeds(g[at])]
                if not len(seeds):
                    continue
                # a hit is extended to every window that covers its gram
                near = (seeds[:, None] - np.arange(window - gram + 1)[None, :]).ravel()
                candidates = np.unique(near[(near >= 0) & (near < len(runs))])
            else:
                candidates = np.flatnonzero(known[np.minimum(np.searchsorted(known, runs), len(known) - 1)] == runs)
            for i in candidates.tolist():
                holders = self.holders(words[i : i + n], int(runs[i]), n)
                if holders:
                    hit[i : i + n] = True
                    items.update(holders)
        return hit, items


MADE = ("_words", "_hits", "_items")


def runs_of(hit: np.ndarray) -> list[int]:
    """Starts and ends (exclusive) of runs, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return edge.tolist()


def with_hits(docs: DataFrame, index: Index, text: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """Adds the hits of one index to docs' columns _words, _hits (run bounds) and _items, which it makes where they lack."""
    if not index.items and "_hits" in docs.columns:
        return docs
    if "_hits" not in docs.columns:
        docs = docs.withColumns({"_words": F.lit(0).cast("long"), "_hits": F.array().cast("array<int>"), "_items": F.array().cast("array<long>")})
    names, schema = docs.columns, docs.schema
    arrow = pa.schema([("_words", pa.int64()), ("_hits", pa.list_(pa.int32())), ("_items", pa.list_(pa.int64()))])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    where = names.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = WordHashes(), shared.value
        for batch in batches:
            made: list[list] = [[], [], []]
            for k, x in enumerate(batch.column(where)):
                words = words_of(x.as_py())
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                hit, items = own.matches(words, hashes, window, gram)
                before = batch.column(names.index("_hits"))[k].as_py()
                for a, b in zip(before[::2], before[1::2]):
                    hit[a:b] = True
                made[0].append(len(words))
                made[1].append(runs_of(hit))
                made[2].append([*batch.column(names.index("_items"))[k].as_py(), *(own.items[i] for i in items)])
            columns = list(batch.columns)
            for name, values, kind in zip(arrow.names, made, arrow.types):
                columns[names.index(name)] = pa.array(values, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(lambda batches: released(each(batches)), schema)


def blocks(benchmark: DataFrame, item_col: str, text: str, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in blocks of at most so many characters (or one longer item)."""
    block, size = [], 0
    for row in benchmark.select(item_col, text).where(F.col(item_col).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Docs with _words (number of words), _hits (bounds of runs of hit words) and _items (ids of items with a window in the text).

    Each document keeps the minimum gram hash of every frame; those that are a benchmark fingerprint are extended
    to all windows around them, compared word by word. Frame and gram together span one window, so no
    window is missed. Items of fewer words than a window are one window and are looked up at their own length.
    Only the index is sent to the executors; its size is bounded by block_chars, and a larger benchmark makes further
    passes, one per block, whose hits are united row by row: nothing is shuffled and no group of equal
    passages meets in a task. Null, empty and wordless texts have no words; items without an id, or without
    words, are not indexed; an id that repeats is one item; an empty benchmark hits nothing. Input columns of these names get
    an underscore at their end.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram must fit into a window")
    docs, _ = set_aside(docs, *MADE, keep=(text,))
    for block in blocks(benchmark, item_col, item_text, block_chars):
        docs = with_hits(docs, Index.of(block, window, gram), text, window, gram)
    return docs.withColumn("_items", F.array_distinct("_items"))


def digest(ids: F.Column) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ","), 256)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    signed = F.transform("_hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        digest(F.col("_items")).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs.

    Null, empty and wordless texts stay; rows that repeat share their fate; null ids don't matter; other columns stay, whatever their names;
    an empty benchmark drops nothing, and an empty table stays empty.
    """
    clear, names = set_aside(docs, *MADE)
    kept = benchmark_hits(clear, table(spark, sf_dir, "benchmark")).where(F.size("_hits") == 0)
    return put_back(kept, docs.columns, names)


ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id, rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)
), items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), lengths AS (
    SELECT DISTINCT least(10, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), runs AS (
    SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)
), found AS (
    SELECT rid, runs.n, i, item_id FROM runs JOIN windows ON runs.n = windows.n AND runs.s = windows.s
), hits AS (
    SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid
), ids AS (
    SELECT rid, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
    FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (rid) LEFT JOIN ids USING (rid)
"""
