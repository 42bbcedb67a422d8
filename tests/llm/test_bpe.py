"""Encoding against the library that reads the same ranks, and the way back."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from witnessframe.llm import bpe, queries

DOCS = "doc_id long, text string"
PATHS = [str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


LIBRARIES = {path: library(path) for path in PATHS}
VOCABULARIES = {path: bpe.Vocabulary(bpe.read_ranks(path)) for path in PATHS}
PATTERN = bpe._pattern(public_tokenizers.PATTERN)


def ids(path, text):
    return np.frombuffer(bpe.encode_text(VOCABULARIES[path], PATTERN, text), bpe.ID).tolist()


@pytest.mark.parametrize("path", PATHS)
def test_random_texts(path):
    draw = random.Random(1)
    for alphabet in ("ab", " \n\t　x", "thequick and", "éüß漢字😀 a1", "0123456789", "'stre ve", "".join(map(chr, range(256)))):
        for _ in range(400):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 80)))
            assert ids(path, text) == LIBRARIES[path].encode_ordinary(text), text


@pytest.mark.parametrize("path", PATHS)
def test_joined_tokens(path):
    """Neighbours that merging would join in another way are where longest matches go wrong."""
    draw, vocabulary = random.Random(2), VOCABULARIES[path]
    for _ in range(3000):
        raw = "".join(draw.choice(vocabulary.text) for _ in range(draw.randint(1, 6)))
        text = raw.encode("latin-1").decode("utf-8", "replace")
        assert ids(path, text) == LIBRARIES[path].encode_ordinary(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(PATHS[0], text) == LIBRARIES[PATHS[0]].encode_ordinary(text)


def plain_merge(ranks, piece):
    run = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(run, run[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in run]
        run[best[1] : best[1] + 2] = [run[best[1]] + run[best[1] + 1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=25), st.lists(st.text("abc", min_size=1, max_size=25), max_size=10))
def test_any_merges(merges, pieces):
    """Vocabularies of random merges of three letters, in every order of ranks."""
    tokens = [bytes([b]) for b in range(256)]
    seen = set(tokens)
    letters = [b"a", b"b", b"c"]
    for left, right in merges:
        made = letters[left % len(letters)] + letters[right % len(letters)]
        if made not in seen and len(made) < 20:
            seen.add(made)
            letters.append(made)
            tokens.append(made)
    ranks = {t: i for i, t in enumerate(tokens)}
    vocabulary = bpe.Vocabulary(ranks)
    for piece in pieces:
        whole = ranks.get(piece.encode())
        assert vocabulary.encode_piece(piece) == ([whole] if whole is not None else plain_merge(ranks, piece.encode()))


def test_one_long_piece_takes_linear_time():
    draw = random.Random(5)
    short, long = ("".join(draw.choice("abcdefgh") for _ in range(n)) for n in (40_000, 320_000))
    seconds = []
    for text in (short, long):
        start = time.perf_counter()
        assert ids(PATHS[0], text) == LIBRARIES[PATHS[0]].encode_ordinary(text)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 30 * seconds[0] + 1


def test_generations_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    vocabulary = bpe.Vocabulary(bpe.read_ranks(PATHS[0]))
    text = "one two three four five six one two seven eight one nine tenxyzzy eleven twelve one" * 3
    assert np.frombuffer(bpe.encode_text(vocabulary, PATTERN, text), bpe.ID).tolist() == LIBRARIES[PATHS[0]].encode_ordinary(text)
    assert len(vocabulary.pieces) <= 3 and len(vocabulary.known) <= 5


def test_odd_rows(spark):
    texts = [None, "", " ", "<|endoftext|> is text", "x" * 200_000, "a  b c", "same", "same", "\x00؀é", "word " * 50_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], DOCS).selectExpr("*", "1 as ids", "'x' as decoded", "2 as n_tokens")
    rows = bpe.decode(bpe.encode(docs, PATHS[0], public_tokenizers.PATTERN), PATHS[0]).collect()
    assert len(rows) == len(texts)
    for row, text in zip(sorted(rows, key=lambda r: 3 if r.doc_id is None else r.doc_id), texts):
        own = LIBRARIES[PATHS[0]].encode_ordinary(text or "")
        assert np.frombuffer(bytes(row.ids), bpe.ID).tolist() == own and row.n_tokens == len(own)
        assert bytes(row.decoded) == (text or "").encode() and row.n_bytes == len((text or "").encode())
    assert bpe.decode(bpe.encode(docs.limit(0), PATHS[0], public_tokenizers.PATTERN), PATHS[0]).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(unhex('61ff62') as string) as text")
    assert bytes(bpe.decode(bpe.encode(broken, PATHS[0], public_tokenizers.PATTERN), PATHS[0]).first().decoded).decode() == "a�b"


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op12_backtracking_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        own = LIBRARIES[PATHS[0]].encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(own)
        assert row.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
