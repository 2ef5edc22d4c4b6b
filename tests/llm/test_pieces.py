import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from daftar.llm import pieces
from daftar.llm.queries import piece_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def coder():
    return pieces.Encoder(pieces.load(piece_model()))


def same(coder, library, text):
    ids = coder.encode(text)
    assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
    assert coder.decode(ids) == library.decode(ids.tolist()), text


def test_given_documents(coder, library):
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        same(coder, library, text)


def test_random_texts(coder, library):
    rng = random.Random(5)
    letters = "abcetinoshr ABC  \n\t\r.,!'\"()-_0123éüñ日本語😀▁\u0000﻿½́</>{};=#"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        if rng.random() < 0.3:
            text = text.replace("a", " " * rng.randrange(1, 40))
        same(coder, library, text)


def test_segments_do_not_change_ids(coder, library, monkeypatch):
    text = "the  quick brown\nfox   jumps ▁ over " * 40 + "x" * 300 + " end "
    monkeypatch.setattr(pieces, "SEGMENT", 16)
    same(coder, library, text)


def test_every_usable_piece_is_its_own_encoding(coder):
    for i in list(coder.v.normal)[::50]:
        piece = coder.v.pieces[i]
        if not coder._only_spaces(piece) and coder.merged(piece) == [i] and pieces.SPACE not in piece[1:]:
            assert coder.encode_word(piece) == [i]


def test_query_rows(spark, library):
    rows = [(1, "Hello world", 0), (1, "Hello world", 1), (2, None, 2), (None, "", 3), (3, "long " * 200_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = pieces.round_trip(df, pieces.load(piece_model()))
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.round_trip(df.limit(0), pieces.load(piece_model())).collect() == []
