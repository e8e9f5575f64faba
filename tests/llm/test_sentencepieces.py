"""Agenda coding against the sentencepiece library, on whole tables, odd texts and any ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from affinity.llm.sentencepieces import Codec, encode_texts, model_path, op11_sentencepiece, token_digests
from tests.conftest import SF_CHECK
from tests.llm.cases import ROWS, empty, table

ODD = ["", " ", "  a  b ", "▁x▁", "a\tb\n", "\n", "ｆｕｌｌ 日本語 🙂🙂 é", "\x00a\x00", "<s> <0x41> </s><unk>", "a" * 900, " " * 200,
       "\n" * 77, "x" * 5000, "é ‍", "word " * 40_000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def _random_texts(count):
    rnd = random.Random(3)
    return ["".join(rnd.choice("abc ▁<>0x41éß日\n\t🙂.;the ing") for _ in range(rnd.randint(1, 300))) for _ in range(count)]


def test_whole_table_equals_the_library(spark, library):
    rows = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_sentencepiece(spark, SF_CHECK).collect()}
    assert got == want


def test_odd_and_random_texts(library):
    codec, texts = Codec(model_path()), ODD + _random_texts(1500)
    want = [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    for check in ("words", "texts"):
        raw = codec.encode(texts, check)
        assert [np.frombuffer(r, "<u4").tolist() for r in raw] == want
    assert [codec.decode(i) for i in want] == [library.decode(i) for i in want]


def test_heap_and_lockstep_agree():
    codec = Codec(model_path())
    words = sorted({w for t in _random_texts(300) for w in codec.words.findall("▁" + t.replace(" ", "▁"))})
    assert {w: np.frombuffer(i, "<u4").tolist() for w, i in codec.encode_words(words).items()} == {w: codec.word_ids(w) for w in words}


def test_any_ids_decode_as_in_the_library(library):
    rnd, codec = random.Random(1), Codec(model_path())
    for top in (300, 32_000):
        ids = [[rnd.randrange(top) for _ in range(rnd.randint(0, 30))] for _ in range(1000)]
        assert [codec.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_a_wrong_table_fails_the_check():
    codec = Codec(model_path())
    codec.known["▁the"] = np.array([5], "<u4").tobytes()
    with pytest.raises(ValueError, match="differ from the library"):
        codec.encode(["the end"], "texts")
    codec.id_of["▁zebrafish"] = 5
    codec._lockstep = lambda words, ids, out: out.update((w, b"\0\0\0\0") for w in words)
    with pytest.raises(ValueError, match="differ from the library"):
        codec.encode(["zebra"], "words")


def test_unused_pieces_fall_back():
    codec = Codec(model_path())
    codec.unused = {"▁the"}
    assert "".join(codec.merged(list("▁the"))) == "▁the" and codec.merged(list("▁the")) != ["▁the"]


def test_awkward_tables(spark, library):
    got = encode_texts(table(spark)).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter(
        (i, tuple(ids := library.encode(t or "", add_bos=True, add_eos=True)), library.decode(ids)) for i, t in ROWS)
    assert encode_texts(empty(spark)).count() == 0 and token_digests(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="unknown check"):
        encode_texts(empty(spark), check="none")
