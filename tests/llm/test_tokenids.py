import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from sparkledger.llm import idcoder, tokenids


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000, 40_000])
@pytest.mark.parametrize("kind", ["same", "few", "many", "text"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"same": np.full(n, 7), "few": rng.integers(0, 3, n), "many": rng.integers(0, 49_000, n) * 3, "text": np.minimum(rng.zipf(1.3, n), 49_000)}[kind]
    data = idcoder.encode(ids)
    assert (idcoder.decode(data) == ids).all()
    if n:
        last = (n - 1) // idcoder.BLOCK_IDS
        assert (idcoder.decode(data, only=last) == ids[last * idcoder.BLOCK_IDS :]).all()
        assert (idcoder.decode(data, only=0) == ids[: idcoder.BLOCK_IDS]).all()
    if n == 40_000 and kind == "same":
        assert len(data) < n / 10
    if n == 40_000 and kind == "few":
        # three equally likely ids hold 0.198 bytes each
        assert len(data) < n / 3


def test_a_frame_holds_more_than_65536_values():
    rng = np.random.default_rng(4)
    ids = np.concatenate((rng.permutation(200_000), rng.integers(0, 1 << 32, 300_000, dtype=np.uint64), np.full(5000, 7))).astype(np.uint32)
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


def test_every_text_of_the_table_is_encoded_as_by_the_library(spark):
    path = tokenids.default_tokenizer()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own, lib = tokenids.Encoder(path), Tokenizer.from_file(path)
    column = pa.array(texts, pa.string())
    parts = [own.batch(x) for x in tokenids.sliced(column, 100_000)]
    assert len(parts) > 5 and sum(len(n) for _, n in parts) == len(texts) == 1000
    got = [ids[end - n : end].tolist() for ids, sizes in parts for n, end in zip(sizes.tolist(), np.cumsum(sizes).tolist())]
    assert got == [lib.encode(t, add_special_tokens=False).ids if t else [] for t in texts]


def test_long_and_many_words_are_not_kept():
    path = tokenids.default_tokenizer()
    own, lib = tokenids.Encoder(path, remembered=100), Tokenizer.from_file(path)
    rng = random.Random(8)
    for _ in range(12):
        texts = [" ".join("".join(rng.choice("abcdé1,") for _ in range(rng.choice([1, 3, 5, 200]))) for _ in range(rng.randrange(30))) for _ in range(5)] + [None]
        ids, sizes = own.batch(pa.array(texts))
        assert ids.tolist() == [i for t in texts if t for i in lib.encode(t, add_special_tokens=False).ids]
        assert len(sizes) == 6 and sizes[-1] == 0 and len(own.known) <= 100 and max((len(w.as_py().encode()) for w in own.known), default=0) <= tokenids.LONG_WORD


def test_repeated_passages_are_predicted():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 40_000, 100)
    ids = np.tile(phrase, 200)
    assert len(idcoder.encode(ids)) < 1.0 * len(ids)


def test_damage_is_found():
    ids = np.random.default_rng(0).integers(0, 500, 3000)
    data = bytearray(idcoder.encode(ids))
    data[-9] ^= 4
    with pytest.raises(idcoder.Corrupt):
        idcoder.decode(bytes(data))
    with pytest.raises(idcoder.Corrupt):
        idcoder.decode(bytes(data), only=2)
    with pytest.raises(idcoder.Corrupt):
        idcoder.decode(bytes(data[:-40]))
    with pytest.raises(idcoder.Corrupt):
        idcoder.decode(b"abc")


def texts():
    rng = random.Random(2)
    out = [None, "", " \n", "Hello, WORLD's end -- don't 12345 x9y", "<|endoftext|> a<|startoftext|>b", "naïve café Ñandú ÉTÉ", "été Å", "tab\tnew\nline\x0b\x0cfeed\rx", "no break  em 　wide \x1c sep \x85 nel", "日本語 текст العربية 🙂🙂", "ΑΣ ΟΔΟΣ İstanbul ǅ ß ﬁ", "a" * 3000, "it’s “quoted” … – —", "'S 'T we'LL 'd'", "½ ² Ⅷ ª º ÷ × ¿"]
    for _ in range(200):
        out.append("".join(rng.choice("abcDEFgh ,.'!éÑßœŒ0123456789\n\t-_<|>'s’") for _ in range(rng.randrange(200))))
    return out


def test_encoder_equals_the_library():
    path = tokenids.default_tokenizer()
    own, lib = tokenids.Encoder(path, remembered=50), Tokenizer.from_file(path)
    for t in texts():
        assert np.frombuffer(own.ids(t), "<u4").tolist() == (lib.encode(t, add_special_tokens=False).ids if t else []), t


def test_other_tokenizers_take_the_library_path():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = tokenids.Encoder(path), Tokenizer.from_file(path)
    assert np.frombuffer(own.ids("Hello  there"), "<u4").tolist() == lib.encode("Hello  there", add_special_tokens=False).ids


def test_query_equals_plain_encoding(spark):
    lib = Tokenizer.from_file(tokenids.default_tokenizer())
    rows = [(i * 37 % 1009 - 20, t) for i, t in enumerate(texts())] + [(None, "null id"), (5, "twice"), (5, "twice"), (5, "other")]
    df = spark.createDataFrame([Row(doc_id=i, text=t, id=1, part="x", ids="y") for i, t in rows], "doc_id long, text string, id int, part string, ids string")
    got = tokenids.token_ids(df, frame_ids=500, parts=3).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [g.doc_id for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want, at = {}, 0
    for i, t in rows:
        ids = [*(lib.encode(t, add_special_tokens=False).ids if t else []), 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for g in got:
        assert g.start == at
        at += g.n_tokens
        want[g.doc_id].remove((g.n_tokens, g.ids_crc32))
    assert not any(want.values())


def test_read_with_ids(spark, tmp_path):
    lib = Tokenizer.from_file(tokenids.default_tokenizer())
    df = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string")
    path = tokenids.write_ids(df, f"{tmp_path}/ids")
    got = tokenids.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    assert [(g.doc_id, g.ids) for g in got] == [(1, [*lib.encode("a").ids, 2]), (2, [*lib.encode("b c").ids, 2])]


def test_empty_table(spark):
    assert tokenids.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("values, crc", [(50, 3383911670), (8192, 1306203205), (8193, 4002405999)])
def test_frames_keep_their_bytes_whatever_the_width_of_tables(values, crc):
    """Up to 8,192 different ids the tables have 16 bits an entry; the bytes, and these checksums of them, are those of the coder before that."""
    ids = np.concatenate((np.arange(values), np.arange(20_000) ** 2 % values))
    data = idcoder.encode(ids, 256)
    assert zlib.crc32(data) == crc
    assert (idcoder.decode(data) == ids).all()
    assert idcoder.Model(4, values).t2.itemsize == (2 if values <= 8192 else 4)
