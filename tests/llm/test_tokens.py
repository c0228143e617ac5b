"""Encoding, decoding and records against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ramplake.llm import bpe, records
from ramplake.llm.common import fresh_folder
from ramplake.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(PATH))


def test_every_code_point(library, encoder):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(texts), 50_000):
        want = [e.ids for e in library.encode_batch(texts[k : k + 50_000], add_special_tokens=False)]
        assert [ids.tolist() for ids in encoder.encode(texts[k : k + 50_000])] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehnrst'!#1 \n\x1c\x85é́Σ<|>"), st.characters(codec="utf-8")), max_size=200))
def test_any_text(library, encoder, text):
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["ab", "aehnrst", "a"])
def test_long_words(library, encoder, letters):
    rng = random.Random(1)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 63, 64, 65, 66, 200, 1000)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=30), st.lists(st.binary(max_size=6), max_size=10))
def test_lexicon_holds_its_words_only(entries, others):
    lexicon = Lexicon.at(compile_lexicon(entries))
    words = [*entries, *others]
    places = lexicon.places(words)
    assert sorted(places[: len(entries)]) == list(range(len(entries)))
    for word, place in zip(words, places):
        assert (place >= 0) == (word in entries)
        if place >= 0:
            assert np.frombuffer(lexicon.ids(np.array([place]))[0], np.int32).tolist() == entries[word]


def test_lexicon_shares_suffixes():
    words = {f"{a}{b}ation".encode(): [1] for a in "abcdefgh" for b in "xyz"}
    assert len(Lexicon.at(compile_lexicon(words)).targets) < 20


def test_word_counts_cover_all(spark, messy, messy_rows, encoder):
    want = Counter()
    for _, text, *_ in messy_rows:
        for chunk in encoder.vocabulary.chunks(text or ""):
            if not isinstance(chunk, int):
                want.update(p for p in encoder.vocabulary.pieces([chunk]) if p != "\n")
    assert {r["piece"]: r["n"] for r in bpe.word_counts(messy, PATH).collect()} == want


@pytest.mark.parametrize("memo", [50, 250_000])
def test_encode_and_decode_messy(spark, messy, messy_rows, library, memo, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", memo)
    lexicon = bpe.frequent_lexicon(messy, PATH, words=300)
    assert 0 < len(Lexicon.at(lexicon)) <= 300
    got = bpe.decode(bpe.encode(messy, PATH, lexicon=lexicon), PATH).collect()
    fused = bpe.encode(messy, PATH, lexicon=lexicon, decode_too=True).collect()
    assert sorted(map(str, fused)) == sorted(map(str, got))
    want = []
    for doc, text, *_ in messy_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append(str((doc, ids, library.decode(ids, skip_special_tokens=False))))
    assert sorted(str((r["doc_id"], list(r["ids"]), r["decoded"])) for r in got) == sorted(want)


def test_decode_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, 999_999, -1, 320])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()} == {1: "", 2: "", 3: "a</w> a</w>"}


def test_empty_table(spark, empty):
    lexicon = bpe.frequent_lexicon(empty, PATH)
    assert bpe.decode(bpe.encode(empty, PATH, lexicon=lexicon), PATH).count() == 0
    folder = fresh_folder(spark, "records")
    assert records.write_records(empty, folder, records.bpe_encoder(PATH)).count() == 0
    assert records.read_records(spark, folder).count() == 0


def crc32c_by_bytes(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = int(records.byte_table()[(crc ^ byte) & 255]) ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    rng = random.Random(2)
    parts = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 127, 128, 5000)] + [b"123456789"]
    assert records.crc32c(parts).tolist() == [crc32c_by_bytes(p) for p in parts]
    assert int(records.crc32c(parts)[-1]) == 0xE3069283  # the published check value


def test_frames_are_verified():
    data = bytearray(b"".join(records.frames([b"one", b"", b"three"])))
    assert records.unframe(bytes(data), [0, 19, 35]) == [b"one", b"", b"three"]
    for flip in (1, 9, 13, 16, 50):
        broken = bytes(data[:flip]) + bytes([data[flip] ^ 1]) + bytes(data[flip + 1 :])
        with pytest.raises((ValueError, Exception)):
            records.unframe(broken, [0, 19, 35])


def test_records_round_trip(spark, messy, messy_rows, library):
    folder = fresh_folder(spark, "records")
    manifest = records.write_records(messy, folder, records.bpe_encoder(PATH), end_id=70_000)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(messy_rows)
    got = sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in records.read_records(spark, folder).collect()), key=lambda r: r[1])
    ids = [np.frombuffer(r[2], "<u4") for r in got]
    assert [r[1] for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    docs = [r[0] for r in got]
    assert docs == sorted(docs, key=lambda d: (d is not None, d or 0))
    want = Counter((doc, zlib.crc32(np.array([*library.encode(text or "", add_special_tokens=False).ids, 70_000], "<u4").tobytes())) for doc, text, *_ in messy_rows)
    assert Counter((d, zlib.crc32(x.tobytes())) for d, x in zip(docs, ids)) == want


def test_records_are_read_by_many_tasks(spark, messy, messy_rows, monkeypatch):
    monkeypatch.setattr(records, "TASK_BYTES", 1 << 14)
    monkeypatch.setattr(records, "STRIDE", 4)
    folder = fresh_folder(spark, "records")
    records.write_records(messy, folder, records.bpe_encoder(PATH), end_id=1)
    read = records.read_records(spark, folder).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(read) > 4 and sum(r["count"] for r in read) == len(messy_rows)
