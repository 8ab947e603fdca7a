"""Token counts that follow edits: kept segment trees over pre-tokens, re-encoded only where an edit reaches."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import kept, set_aside, table, written

#: Pre-tokens of a leaf, and characters from which a leaf is split.
LEAF, LARGE = 64, 4096
REMEMBERED = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Tokens of a pre-token under a file of ranks and a pattern without look-behind."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        pattern = pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def total(self, pieces: Iterable[str]) -> int:
        count, known = self.count, self.known.get
        return sum([known(p) or count(p) for p in pieces])


def counter_of(path: str, pattern: str | None = None) -> Counter:
    """One counter for all tasks of a worker, with what it remembers."""
    return kept(("counter", path, pattern), lambda: Counter(path, pattern))


class TokenTree:
    """A document as leaves of whole pre-tokens under a binary tree of sums of characters and tokens."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.reencoded = counter, 0
        pieces = counter.split(text)
        groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        self.build(["".join(g) for g in groups], [counter.total(g) for g in groups])

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], counter: Counter) -> TokenTree:
        """The tree that was kept of a text: nothing is split or encoded."""
        self = cls.__new__(cls)
        self.counter, self.reencoded = counter, 0
        ends = list(accumulate(chars))
        self.build([text[b - n : b] for n, b in zip(chars, ends)], tokens)
        return self

    def build(self, texts: list[str], tokens: list[int]) -> None:
        self.leaves = texts or [""]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(self.leaves), 0] = [len(x) for x in self.leaves]
        self.sums[self.width : self.width + len(self.leaves), 1] = tokens or [0]
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf, which with the text are the tree."""
        own = self.sums[self.width : self.width + len(self.leaves)]
        return own[:, 0].tolist(), own[:, 1].tolist()

    def put(self, leaf: int, text: str, tokens: int) -> None:
        """Sets a leaf and the sums above it."""
        self.leaves[leaf] = text
        k = self.width + leaf
        change = np.array([len(text), tokens]) - self.sums[k]
        while k:
            self.sums[k] += change
            k >>= 1

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at a place (the last leaf at the end), and where it starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.sums[k, 0]:
                start += int(self.sums[k, 0])
                k += 1
        leaf = min(k - self.width, len(self.leaves) - 1)
        return (leaf, start) if leaf == k - self.width else (leaf, self.n_chars - len(self.leaves[leaf]))

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces characters start to end (clipped to the text).

        What is re-encoded starts two pre-tokens before the edit or earlier, as a pre-token of white space looks at what follows its
        run, and ends at the first leaf whose start is still the start of a pre-token; text after it is split as it was.
        """
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        first, at = self.find(max(0, start - 1))
        last, last_at = self.find(max(start, end - 1) if end > start else start)
        back = 0
        # two whole pre-tokens of context: a leaf that isn't empty has one at least
        while first > 0 and back < 2:
            first -= 1
            at -= len(self.leaves[first])
            back += bool(self.leaves[first])
        inside = "".join(self.leaves[first : last + 1])
        new = inside[: start - at] + replacement + inside[end - at :]
        while True:
            ahead, k = "", last + 1
            while k < len(self.leaves) and (not ahead or ahead.isspace()):
                ahead += self.leaves[k]
                k += 1
            pieces, size, own = self.counter.split(new + ahead), 0, 0
            for own, p in enumerate(pieces):
                if size >= len(new):
                    break
                size += len(p)
            else:
                own = len(pieces)
            if size == len(new) or last + 1 == len(self.leaves):
                break
            last += 1
            new += self.leaves[last]
        self.reencoded += last + 1 - first
        pieces = pieces[:own]
        groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        for n, leaf in enumerate(range(first, last + 1)):
            # what is too much for the leaves goes to the last of them
            part = [p for g in (groups[n : n + 1] if leaf < last else groups[n:]) for p in g]
            self.put(leaf, "".join(part), self.counter.total(part))
        if len(self.leaves[last]) > LARGE and len(groups) > last + 1 - first:
            self.regroup(last, [p for g in groups[last - first :] for p in g])

    def regroup(self, leaf: int, pieces: list[str]) -> None:
        """Splits one leaf into several; no other leaf is encoded again."""
        groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        tokens = self.sums[self.width : self.width + len(self.leaves), 1].tolist()
        texts = [*self.leaves[:leaf], *("".join(g) for g in groups), *self.leaves[leaf + 1 :]]
        self.build(texts, [*tokens[:leaf], *(self.counter.total(g) for g in groups), *tokens[leaf + 1 :]])


MADE = ("n_tokens", "n_edited", "n_leaves", "n_reencoded")
LEAVES = ("leaf_chars", "leaf_tokens")
KIND = "array<struct<start:long,end:long,replacement:string>>"


def trees(docs: DataFrame, text: str = "text", tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with leaf_chars and leaf_tokens: the tree of each text, to be written to a table and kept. The text is the leaves' text.

    Whole texts are split and encoded, once. Null and empty texts have one empty leaf; every row gives a row; an empty table gives none; input
    columns of these names get an underscore at their end.
    """
    path = tokenizer or default_tokenizer()
    docs, _ = set_aside(docs, *LEAVES, keep=(text,))
    where, names = docs.columns.index(text), [*docs.columns, *LEAVES]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, pattern)
        for batch in batches:
            made = [TokenTree(x.as_py() or "", counter).kept() for x in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1))], names)

    return docs.mapInArrow(each, StructType([*docs.schema.fields, *(StructField(c, ArrayType(LongType())) for c in LEAVES)]))


def edited(stored: DataFrame, edits: Column, text: str = "text", tokenizer: str | None = None, pattern: str | None = None, counts_only: bool = False) -> DataFrame:
    """Kept trees after edits, with n_reencoded: the leaves that edits reached, and no others were encoded. Rows without edits are passed on as they are.

    edits: an array of structs (start, end, replacement), applied in turn to the text as it then is, in code points; places
    beyond the text are clipped; null edits, and null members of one, are none, 0, 0 and empty. The text and the leaves are those after the edits, so
    the result can be kept in place of the table. counts_only: neither, but n_edited, the tokens after the edits.
    """
    path = tokenizer or default_tokenizer()
    stored, _ = set_aside(stored, "n_edited", "n_reencoded", "_edits", keep=(text,))
    own = [f for f in stored.schema.fields if f.name not in (text, *LEAVES)]
    names = [f.name for f in own]
    given = stored.select(*names, F.col(text).alias("_text"), *LEAVES, edits.cast(KIND).alias("_edits"))
    n = len(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, pattern)
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for value, chars, tokens, changes in zip(batch.column(n), *(batch.column(n + k).to_pylist() for k in (1, 2, 3))):
                if not any(changes or ()):
                    now, total, reached = value.as_py() if not counts_only else None, sum(tokens), 0
                else:
                    tree = TokenTree.stored(value.as_py() or "", chars, tokens, counter)
                    for e in changes:
                        if e:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                    now, total, reached = tree.text() if not counts_only else None, tree.n_tokens, tree.reencoded
                    chars, tokens = ([], []) if counts_only else tree.kept()
                for column, x in zip(made, (now, chars, tokens, reached) if not counts_only else (total, reached)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64()) if counts_only else (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(m, k) for m, k in zip(made, kinds))], [f.name for f in schema])

    long = lambda c: StructField(c, LongType())
    made_fields = [long("n_edited"), long("n_reencoded")] if counts_only else [StructField(text, StringType()), *(StructField(c, ArrayType(LongType())) for c in LEAVES), long("n_reencoded")]
    schema = StructType([*own, *made_fields])
    return given.mapInArrow(each, schema)


def total(leaves: str) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda a, x: a + x)


def token_counts(docs: DataFrame, edits: Column | None = None, text: str = "text", tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs without the text, with n_tokens, n_edited (after the edits), n_leaves and n_reencoded (leaves that edits reached).

    The trees are written to the shared folder; counts before edits are read off their leaves, and edits (see edited()) work on the kept trees.
    Null and empty texts have no tokens before edits. Every row gives a row; an empty table gives none; input columns of the names that are made
    here get an underscore at their end.
    """
    docs, _ = set_aside(docs, *MADE, *LEAVES, "_text", "_edits", keep=(text,))
    rest = [c for c in docs.columns if c != text]
    stored = written(trees(docs, text, tokenizer, pattern), "trees").withColumns({"n_tokens": total("leaf_tokens"), "n_leaves": F.size("leaf_chars").cast("long")})
    if edits is None:
        return stored.select(*rest, "n_tokens", F.col("n_tokens").alias("n_edited"), "n_leaves", F.lit(0).cast("long").alias("n_reencoded"))
    return edited(stored, edits, text, tokenizer, pattern, counts_only=True).select(*rest, *MADE)


def revision(text: Column) -> Column:
    """The revision that the query counts: a stamp before the text, five characters less in its middle, a note at a third, a full stop for the last ten."""
    n = F.length(text)
    one = lambda a, b, s: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(s).alias("replacement"))
    half, third = F.floor(n / 2), F.floor(n / 3)
    return F.when(text.isNotNull(), F.array(one(n - 10, n, "."), one(half, half + 5, ""), one(third, third, " [sic] "), one(F.lit(0), F.lit(0), "Revised. ")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, revision(F.col("text")))
