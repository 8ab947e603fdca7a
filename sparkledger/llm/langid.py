"""Language of whole texts: scripts narrow the candidates, then Viterbi over words labels spans."""

from __future__ import annotations

import itertools
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import kept, put_back, released, set_aside, table

#: Documents whose crc32(doc_id as text) leaves 0 are held out of learning.
FOLDS = 5
#: Bound of the sample that the classifier learns from: documents of each language, each whole; and of the languages, each of which has a column in the model.
SAMPLE_DOCS, MOST_LANGUAGES = 400, 200
#: Words whose features are counted at a time.
COUNTED_WORDS = 1 << 17
#: Hashed features of a word: its runs of 1 to 3 UTF-8 bytes, with marks at both ends.
BUCKET_BITS, LONGEST = 15, 3
BUCKETS = 1 << BUCKET_BITS
#: Log probability that a change of language between two words costs.
SWITCH = 8.0
#: A word speaks for at most so much, so that one odd word doesn't make a span.
MOST = 6.0
REMEMBERED = 150_000
#: Characters that are labelled side by side.
SLICE_CHARS = 4 << 20
UNKNOWN = "und"

#: First code points of ranges of letters, and the script of each up to the next.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
FIRSTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
OF_RANGE = np.array([NAMES.index(s) for _, s in SCRIPTS])
WORD = re.compile(r"[^\W\d_]+")


def numerals(first: int, end: int) -> re.Pattern:
    """Numerals of a range that aren't decimal digits, which \\w takes though they are no letters, as fractions and Roman numbers."""
    return re.compile("[" + "".join(chr(c) for c in range(first, end) if unicodedata.category(chr(c)) in ("No", "Nl")) + "]")


# those of the first plane are one bitmap; beyond the second plane there are none
NUMERAL, HIGH_NUMERAL, HIGH = numerals(0x80, 0x10000), numerals(0x10000, 0x20000), re.compile("[\U00010000-\U0001FFFF]")


def scripts(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return OF_RANGE[np.maximum(np.searchsorted(FIRSTS, first, "right") - 1, 0)]


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of all words at once, for runs of 1, 2 and 3 UTF-8 bytes with a mark at each end: their buckets in turn, and where each word's runs start."""
    data = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    word = np.cumsum(data == ord("<")) - 1
    h = np.zeros(len(data), np.uint32)
    for n in range(1, LONGEST + 1):
        h = h[: len(data) - n + 1] * np.uint32(0x9E3779B1) + data[n - 1 :] + np.uint32(n)
        inside = word[: len(h)] == word[n - 1 :]
        mixed = h ^ (h >> np.uint32(15))
        mixed *= np.uint32(0x85EBCA6B)
        yield (mixed >> np.uint32(32 - BUCKET_BITS))[inside], np.searchsorted(word[: len(h)][inside], np.arange(len(words)))


def lettered(text: str) -> str:
    """The text, lower-cased, with a space for each numeral that isn't a digit."""
    low = text.lower()
    if low.isascii():
        return low
    if NUMERAL.search(low):
        low = NUMERAL.sub(" ", low)
    return HIGH_NUMERAL.sub(" ", low) if HIGH.search(low) else low


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD.findall(lettered(text)) if text else []


@dataclass
class Model:
    """languages: sorted; weights: (BUCKETS, languages) log probabilities; uses: (scripts, languages) whether a language is written so."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray
    prior: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log score of each language for each word, 0 for the best; languages of another script are out unless all are."""
        s = np.zeros((len(words), len(self.languages)), np.float32)
        for buckets, starts in features(words):
            s += np.add.reduceat(self.weights[buckets], starts, axis=0)
        may = self.uses[scripts(words)]
        s = np.where(may, s, -np.inf)
        best = s.max(axis=1, keepdims=True)
        return np.where(np.isfinite(best), np.maximum(s - np.where(np.isfinite(best), best, 0), -MOST), 0).astype(np.float32)


def counted(text: str | None, buckets: np.ndarray, letters: np.ndarray) -> None:
    """Adds a whole text's features to the counts of buckets, and its letters to those of scripts."""
    found = words_of(text)
    for at in range(0, len(found), COUNTED_WORDS):
        part = found[at : at + COUNTED_WORDS]
        for places, _ in features(part):
            buckets += np.bincount(places, minlength=BUCKETS)
        letters += np.bincount(scripts(part), np.fromiter(map(len, part), np.int64, len(part)), len(NAMES)).astype(np.int64)


def model_of(counts: dict[str, np.ndarray]) -> Model:
    """A model from the counts of each language: those of BUCKETS buckets, then those of scripts."""
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool), np.zeros(0, np.float32))
    table_ = np.stack([counts[x][:BUCKETS] for x in languages], axis=1) + 0.5
    weights = np.log(table_ / table_.sum(axis=0))
    # only differences count, and unseen features say nothing
    weights -= weights.max(axis=1, keepdims=True)
    weights[(table_ == 0.5).all(axis=1)] = 0
    share = np.stack([counts[x][BUCKETS:] / max(1, counts[x][BUCKETS:].sum()) for x in languages], axis=1)
    prior = np.array([float(counts[x][:BUCKETS].sum()) for x in languages])
    return Model(languages, weights.astype(np.float32), share >= 0.02, np.log((prior + 1) / (prior + 1).sum()).astype(np.float32))


def learn(rows: Iterator[tuple[str, str]]) -> Model:
    """A model from (text, language)."""
    counts: dict[str, np.ndarray] = {}
    for text, language in rows:
        c = counts.setdefault(language, np.zeros(BUCKETS + len(NAMES), np.int64))
        counted(text, c[:BUCKETS], c[BUCKETS:])
    return model_of(counts)


def viterbi(scores: np.ndarray, lengths: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of several texts side by side. scores: the words of all texts in turn, (words, languages); lengths: words of each text.

    At each word the best way either stays in its language or comes from the best of all, less the penalty.
    """
    total, n = scores.shape
    labels = np.zeros(total, np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    alive = np.count_nonzero(sizes > 0)
    if not alive:
        return labels
    starts, sizes = starts[:alive], sizes[:alive]
    longest = int(sizes[0])
    count = np.searchsorted(-sizes, -np.arange(longest), "left")
    back = np.empty((total, n), np.int16)
    best = scores[starts] + prior
    same = np.arange(n, dtype=np.int16)
    ends = np.empty(alive, np.int16)
    for t in range(1, longest):
        m = count[t]
        if m < len(best):
            ends[m : len(best)] = best[m:].argmax(axis=1)
            best = best[:m]
        top = best.argmax(axis=1)
        jump = best[np.arange(m), top] - switch
        moves = best < jump[:, None]
        back[starts[:m] + t] = np.where(moves, top[:, None].astype(np.int16), same)
        best = np.where(moves, jump[:, None], best) + scores[starts[:m] + t]
    ends[: len(best)] = best.argmax(axis=1)
    now = np.empty(alive, np.int16)
    for t in range(longest - 1, -1, -1):
        m = count[t]
        fresh = count[t + 1] if t + 1 < longest else 0
        now[fresh:m] = ends[fresh:m]
        if t + 1 < longest and fresh:
            now[:fresh] = back[starts[:fresh] + t + 1, now[:fresh]]
        labels[starts[:m] + t] = now[:m]
    return labels


class Labeller:
    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def remember(self, words: list[list[str]]) -> None:
        """Scores words that aren't known yet, all at once."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = sorted(set().union(*words) - self.known.keys())
        if not new:
            return
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        if first + len(new) > len(self.scores):
            grown = np.zeros((2 * (first + len(new)), len(self.model.languages)), np.float32)
            grown[:first] = self.scores[:first]
            self.scores = grown
        self.scores[first : first + len(new)] = self.model.scores(new)

    def label(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text and the number of the language of each."""
        words = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not self.model.languages:
            return [(w, np.zeros(len(w), np.int16)) for w in words]
        self.remember(words)
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(lengths.sum()))
        labels = viterbi(self.scores[at], lengths, self.model.prior, self.switch)
        return list(zip(words, np.split(labels, np.cumsum(lengths)[:-1])))


def labeller_of(model: Model, switch: float) -> Labeller:
    """One labeller for all tasks of a worker that use a model, with the words that it remembers."""
    return kept(("labeller", model.key, switch), lambda: Labeller(model, switch))


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def spans(text: str | None, model: Model, switch: float = SWITCH) -> list[tuple[int, int, str]]:
    """(start, end, language) of maximal runs of words with one label, in code points of the lower-cased text."""
    out: list[tuple[int, int, str]] = []
    if not text or not model.languages:
        return out
    (_, labels), = Labeller(model, switch).label([text])
    for m, k in zip(WORD.finditer(lettered(text)), labels):
        name = model.languages[k]
        if out and out[-1][2] == name:
            out[-1] = (out[-1][0], m.end(), name)
        else:
            out.append((m.start(), m.end(), name))
    return out


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def trained(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model learnt from a sample of at most sample_docs documents of each language, whole ones, that aren't held out.

    The number of rows of each language, collected, gives a threshold for the hash of the id, under which about four times the
    sample falls, so the scan itself leaves few rows of any language; the smallest hashes of these are the sample. Tasks count features,
    and one vector of counts for each language and task is collected. Rows without a text, a language or an id aren't learnt from. Of an id
    that repeats all rows may be learnt from, up to the bound. More than most_languages different languages raise ValueError.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("of"), F.col(text).alias("text"), F.xxhash64(F.col(id_col)).alias("h"), fold(id_col).alias("fold"))
    rows = own.where("of is not null and id is not null and fold <> 0")
    sizes = {r.of: r.n for r in rows.groupBy("of").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return model_of({})
    unit = (F.col("h") / (2.0**64)) + 0.5
    bound = F.create_map(*(F.lit(x) for of, n in sorted(sizes.items()) for x in (of, 4.0 * sample_docs / n)))
    first = Window.partitionBy("of").orderBy("h", "id", F.xxhash64("text"))
    sampled = lambda df: df.where("text is not null").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_docs).select("of", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for of, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = counts.setdefault(of, np.zeros(BUCKETS + len(NAMES), np.int64))
                counted(value.as_py(), c[:BUCKETS], c[BUCKETS:])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["of", "counts"])

    total: dict[str, np.ndarray] = {}

    def learn_from(df: DataFrame) -> None:
        for r in sampled(df).mapInArrow(each, "of string, counts binary").toLocalIterator():
            total[r.of] = total.get(r.of, 0) + np.frombuffer(r.counts, np.int64)

    learn_from(rows.where(unit <= F.element_at(bound, F.col("of"))))
    # a language whose rows share few ids may have none under the threshold
    if missing := sorted(set(sizes) - set(total)):
        learn_from(rows.where(F.col("of").isin(missing)))
    return model_of(total)


MADE = ("lang_pred", "score", "n_spans")


def predict(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs with lang_pred, score (share of letters in spans of that language, 0 to 1) and n_spans.

    Null texts and texts without letters are und with score 0 and no spans; so are all if nothing was learnt. Ties go to the
    language that sorts first. Whole texts are labelled, a bounded number of characters (or one text) side by side. Rows that repeat each
    keep a row; an empty table gives none; input columns of these names get an underscore at their end.
    """
    docs, _ = set_aside(docs, *MADE, keep=(text,))
    made = MADE
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where, names = docs.columns.index(text), [*docs.columns, *made]
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_spans", LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of(shared.value, switch)
        languages = labeller.model.languages
        for batch in batches:
            best, share, runs = [], [], []
            for part in slices(batch.column(where).to_pylist()):
                for words, labels in labeller.label(part):
                    if not words or not languages:
                        best.append(UNKNOWN)
                        share.append(0.0)
                        runs.append(0)
                        continue
                    by = np.bincount(labels, np.fromiter(map(len, words), np.int64, len(words)), len(languages))
                    k = int(by.argmax())
                    best.append(languages[k])
                    share.append(float(by[k] / by.sum()))
                    runs.append(1 + int(np.count_nonzero(np.diff(labels))))
            columns = [*batch.columns, pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(runs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(lambda batches: released(each(batches)), schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", (F.coalesce(fold("doc_id"), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score", "n_spans")


#: The stage rejects documents of which less than this share of letters is in the main language.
LEAST_SCORE = 0.5


def langid_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) and those without a main language; lang stays as it was.

    Rows that repeat share their fate; null ids, sources and languages don't matter; other columns stay, whatever their names; an empty table stays empty.
    """
    clear, names = set_aside(docs, *MADE)
    stay = predict(clear, trained(clear)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return put_back(stay, docs.columns, names)
