"""SentencePiece coding against the library."""

import collections
import random

import numpy as np
import pytest
import sentencepiece

from hostlake.llm import piece_bpe
from hostlake.llm.queries import PIECES, QUERIES

from tests.llm.conftest import EXTRA, frame, sha


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    with open(PIECES, "rb") as file:
        return piece_bpe.Codec(file.read())


def test_agenda_equals_library(codec, library):
    rng = random.Random(1)
    parts = [library.id_to_piece(k) for k in range(library.get_piece_size())] + [*" \n\t▁\x00é😀日本ﬁ", "é", "　", "  ", "──", "aaaa", "<0x41>", "</s>"]
    for k in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        text = text.replace("▁", " ") if k % 2 else text
        ids = library.encode(text, add_eos=True)
        assert (codec.encode(text).tolist() if text else [2]) == ids
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)
    for text in ("a" * 5000, "ab" * 3000, " " * 999 + "x", "\n" * 50, "═" * 77, "word " * 20_000):
        assert codec.encode(text).tolist() == library.encode(text, add_eos=True)
    assert codec.checked()


def test_any_ids_decode_as_in_the_library(codec, library):
    rng = random.Random(2)
    for _ in range(6000):
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32_000) for _ in range(rng.randint(0, 9))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_check_finds_what_differs(codec):
    codec.encode("a quite new wrd")
    codec.fresh["▁wrd"] = (1, 2)
    assert not codec.checked() and codec.wrong == {"▁wrd"}
    assert codec.agrees("something else") and codec.agrees(None) and not codec.agrees("this wrd")
    codec.wrong.clear()


@pytest.mark.parametrize("chunks", [8, piece_bpe.MAX_CHUNKS])
def test_forgetting_changes_nothing(library, monkeypatch, chunks):
    monkeypatch.setattr(piece_bpe, "MAX_CHUNKS", chunks)
    with open(PIECES, "rb") as file:
        small = piece_bpe.Codec(file.read())
    text = "the theatre of the others, then there 123 " * 5
    assert small.encode(text).tolist() == library.encode(text, add_eos=True)
    assert len(small) <= chunks


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        piece_bpe.Codec(b"not a model")


def test_code(engine, rows, library):
    docs = [*rows, rows[7], rows[7], (None, rows[11][1]), (None, None)]
    found = piece_bpe.code(frame(engine, docs, EXTRA), PIECES)
    want = collections.Counter((d, tuple(library.encode(t or "", add_eos=True)), library.decode(library.encode(t or "")), True) for d, t in docs)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], r["agrees"]) for r in found.collect()) == want
    assert {"shard", "score"} <= set(found.columns)
    both = piece_bpe.decode(piece_bpe.encode(frame(engine, docs, EXTRA), PIECES), PIECES)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], True) for r in both.collect()) == want
    without = piece_bpe.encode(frame(engine, [(1, "a"), (2, "")]), PIECES, end=False)
    assert {tuple(r["ids"]) for r in without.collect()} == {tuple(library.encode("a")), ()}
    lists = engine.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["decoded"] for r in piece_bpe.decode(lists, PIECES).collect()} == {""}


def test_empty_table(engine):
    assert piece_bpe.code(frame(engine, []), PIECES).count() == 0


def test_registered_query(engine, library):
    path = "/root/testdata/sf0.01"
    want = collections.Counter()
    for r in engine.read.parquet(f"{path}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode(ids).encode()), True] += 1
    assert collections.Counter(tuple(r) for r in QUERIES["op12_sentencepiece"](engine, path).collect()) == want
