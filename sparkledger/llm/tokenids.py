"""Token ids of whole documents, written as checksummed frames of coded blocks, and read back."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idcoder
from .common import kept, new_path, table

END_ID = 2
#: Words that are treated here: ASCII, Latin letters and common marks.
PLAIN = "^[\\x21-\\x7EÀ-ȳ‘-…]+$"
#: A frame is closed once it holds so many ids; a longer document has a frame of its own.
FRAME_IDS = 4 << 20
#: Words whose ids a worker remembers at a time, in arrays; those of more bytes aren't.
REMEMBERED, LONG_WORD = 1_500_000, 64
#: Bytes of text (or one longer document) that are encoded at a time.
SLICE_BYTES = 20 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gathered(stored: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(len(stored), total) < 1 << 31 else np.int64
    places = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return stored[places]


class Encoder:
    """Ids of texts under a tokenizers file, with add_special_tokens=False.

    The tokenizer of words (white space dropped, lower-cased, split into letters, single digits and the rest, BPE
    in each) treats words between white space alone. So many texts are cut at ASCII white space at once, each different word is
    looked up once, and the ids are gathered in arrays; those of known words are kept. Words
    of anything but plain Latin letters, ASCII and common marks, or with a special token, take the library's own path,
    as do whole texts under any other kind of tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = norm == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>" and not pre[1]["add_prefix_space"]
        if not self.by_word:
            return
        self.pieces_of = regex.compile(pre[0]["pattern"]["Regex"]).findall
        self.special = [x["content"] for x in spec["added_tokens"] if x["content"]]
        byte = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in byte]
        self.visible = {b: chr(b) for b in byte} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.normal = unicodedata.normalize
        #: The model alone, and which of its ids end a piece.
        self.model = Tokenizer(self.tokenizer.model)
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith("</w>")]] = True
        #: Known words, and of each how many ids it has and where they start.
        self.known = pa.array([], pa.string())
        self.stored, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each piece where its ids start and how many it has. Each different piece is encoded once, all in one call."""
        index: dict[str, int] = {}
        codes = np.array([index.setdefault(p, len(index)) for p in pieces], np.int64)
        if not index:
            return np.empty(0, np.uint32), codes, codes
        visible = self.visible
        seen = [p if p.isascii() and p.isprintable() else "".join([visible[b] for b in p.encode()]) for p in index]
        ids = np.array(self.model.encode_batch_fast([seen], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        upto = np.flatnonzero(self.ends[ids]) + 1
        if len(upto) != len(index):
            raise ValueError("the vocabulary lacks ends of words")
        starts = np.concatenate(([0], upto[:-1]))
        return ids, starts[codes], (upto - starts)[codes]

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an array of words, one after the other, and how many each has."""
        plain = pc.match_substring_regex(words, PLAIN)
        for x in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, x)))
        pieces, counts, other, normal = [], [], {}, self.normal
        for n, (word, simple) in enumerate(zip(words.to_pylist(), plain.to_pylist())):
            low = word.lower() if word.isascii() else normal("NFC", word).lower()
            if not simple:
                counts.append(0)
                if word:
                    other[n] = self.library(word)
            elif low.isalpha():
                pieces.append(low)
                counts.append(1)
            elif low[-1] in ",." and low[:-1].isalpha():
                pieces += (low[:-1], low[-1])
                counts.append(2)
            else:
                own = self.pieces_of(low)
                pieces += own
                counts.append(len(own))
        stored, starts, sizes = self.of_pieces(pieces)
        flat, total = gathered(stored, starts, sizes), np.concatenate(([0], np.cumsum(sizes)))
        at = np.cumsum(counts)
        upto = total[at] if len(at) else np.empty(0, np.int64)
        each = np.diff(upto, prepend=0)
        if other:
            where = np.fromiter(other, np.int64, len(other))
            lengths = np.fromiter(map(len, other.values()), np.int64, len(other))
            flat = np.insert(flat, np.repeat(upto[where], lengths), np.concatenate(list(other.values())))
            each[where] = lengths
        return flat, each

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each of the words (which differ) where its ids start and how many it has."""
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.stored, self.starts[at], self.sizes[at]
        fresh = words.take(pa.array(new))
        made, sizes = self.encoded(fresh)
        stored = np.concatenate((self.stored, made))
        starts = np.concatenate((self.starts, len(self.stored) + np.cumsum(sizes) - sizes))
        at[new] = len(self.known) + np.arange(len(new))
        all_sizes = np.concatenate((self.sizes, sizes))
        out = stored, starts[at], all_sizes[at]
        # forgets all once there are too many, and never keeps long words, which hardly come again
        short = pc.less_equal(pc.binary_length(fresh), LONG_WORD)
        if len(self.known) + len(new) > self.remembered:
            self.known, self.stored, self.starts, self.sizes = self.known[:0], self.stored[:0], self.starts[:0], self.sizes[:0]
        elif pc.all(short).as_py():
            self.known, self.stored, self.starts, self.sizes = pa.concat_arrays([self.known, fresh]), stored, starts, all_sizes
        else:
            kept = np.flatnonzero(short.to_numpy(zero_copy_only=False))
            ids = gathered(made, (np.cumsum(sizes) - sizes)[kept], sizes[kept])
            self.starts = np.concatenate((self.starts, len(self.stored) + np.cumsum(sizes[kept]) - sizes[kept]))
            self.known, self.stored, self.sizes = pa.concat_arrays([self.known, fresh.filter(short)]), np.concatenate((self.stored, ids)), np.concatenate((self.sizes, sizes[kept]))
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an array of strings, one text after the other, and how many each has; null has none."""
        if not self.by_word:
            made = [self.library(t) if t else np.empty(0, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *made]), np.fromiter(map(len, made), np.int64, len(made))
        lists = pc.ascii_split_whitespace(texts)
        words = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        stored, starts, sizes = self.looked_up(coded.dictionary)
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.cumsum(each)
        upto = np.concatenate(([0], ends))[np.cumsum(words)]
        return gathered(stored, starts[codes], each), np.diff(upto, prepend=0)

    def ids(self, text: str | bytes | None) -> bytes:
        """The ids of a text, or of its UTF-8 bytes, as little-endian uint32."""
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        return self.batch(pa.array([data], pa.binary()).view(pa.string()))[0].astype("<u4").tobytes()


def sliced(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Stretches of an array of so many bytes, or of one longer text."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield texts[at:end]
        at = end


def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker, with what it remembers."""
    return kept(("encoder", path), lambda: Encoder(path))


FRAME_SCHEMA = "part int, frame int, first long, n_docs int, n_ids long, docs binary, payload binary"


def frames(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, frame_ids: int = FRAME_IDS, parts: int | None = None) -> DataFrame:
    """One row for each frame, parts in ascending order of id_col.

    docs: int64 ids of the frame's documents (a null id: the first byte of the second half is 1) and uint32 lengths; payload: the coded ids.
    Documents are dealt by ranges of their id, ties in an order fixed by the text; a document is never split.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, number, first = TaskContext.get().partitionId(), encoder_of(tokenizer), 0, 0
        keys, nulls, sizes, chunks, held = [], [], [], [], 0

        def frame() -> pa.RecordBatch:
            flat = np.concatenate(chunks)
            index = np.concatenate(keys).astype("<i8").tobytes() + np.concatenate(nulls).astype(np.uint8).tobytes() + np.concatenate(sizes).astype("<u4").tobytes()
            row = [[part], [number], [first], [sum(map(len, sizes))], [len(flat)], [index + zlib.crc32(index).to_bytes(4, "little")], [idcoder.encode(flat)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "frame", "first", "n_docs", "n_ids", "docs", "payload"])

        for batch in batches:
            done = 0
            for texts in sliced(batch.column(1)):
                ids, counts = encoder.batch(texts)
                ends = np.cumsum(counts)
                flat, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                own = batch.column(0)[done : done + len(texts)]
                own_ids, own_nulls = own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
                done += len(texts)
                at = 0
                while at < len(ends):
                    start = int(ends[at - 1]) if at else 0
                    # up to and with the document that fills the frame
                    upto = min(len(ends), int(np.searchsorted(ends, start + frame_ids - held)) + 1)
                    keys.append(own_ids[at:upto])
                    nulls.append(own_nulls[at:upto])
                    sizes.append(np.diff(ends[at:upto], prepend=start))
                    chunks.append(flat[start : int(ends[upto - 1])])
                    held += len(chunks[-1])
                    at = upto
                    if held >= frame_ids:
                        yield frame()
                        first, number = first + held, number + 1
                        keys, nulls, sizes, chunks, held = [], [], [], [], 0
        if chunks:
            yield frame()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, F.asc_nulls_first("id"), tie) if parts else rows.repartitionByRange(F.asc_nulls_first("id"), tie)
    return dealt.sortWithinPartitions(F.asc_nulls_first("id"), tie).mapInArrow(each, FRAME_SCHEMA)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, **options) -> str:
    """Writes the frames of docs to a table at path: a binary column of coded blocks in files that any store can hold."""
    frames(docs, tokenizer or default_tokenizer(), **options).write.option("compression", "none").parquet(path)
    return path


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents in files of write_ids; every checksum is verified.

    start: ids of all documents before; from the sizes of the parts, of which there are as many as tasks wrote them.
    """
    stored = spark.read.schema(FRAME_SCHEMA).parquet(path)
    # one row for each part that was written, and nothing of the documents
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for row in sizes:
        before[row.part] = total
        total += row.n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                n, index = row["n_docs"], row["docs"]
                if len(index) != 13 * n + 4 or zlib.crc32(index[:-4]) != int.from_bytes(index[-4:], "little"):
                    raise idcoder.Corrupt("a list of documents is damaged")
                keys = np.frombuffer(index, "<i8", n)
                null = np.frombuffer(index, np.uint8, n, 8 * n)
                lengths = np.frombuffer(index[9 * n : 13 * n], "<u4").astype(np.int64)
                ids = idcoder.decode(row["payload"])
                if len(ids) != lengths.sum() or len(ids) != row["n_ids"]:
                    raise idcoder.Corrupt("a frame lacks ids")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                flat = np.ascontiguousarray(ids, "<u4")
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(keys, pa.int64(), mask=null.astype(bool)), pa.array(starts + row["first"] + before[row["part"]], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return stored.mapInArrow(each, schema)


def token_ids(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Writes the ids of docs into the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts have the end id alone. Rows whose id is null come first; ids that repeat give a row each.
    An empty table gives none. Very long texts have a frame of their own. Other columns are ignored.
    """
    path = new_path(docs.sparkSession, "ids")
    return read_ids(docs.sparkSession, write_ids(docs, path, tokenizer, **options))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the ids of what was kept, as read back."""
    return token_ids(docs)
