"""Byte-level BPE by ranks: longest matches of an automaton, backtracking over compatible neighbours."""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

CACHED_PIECES = 1 << 18  # pieces in each of the two generations that a Python worker remembers,
CACHED_BYTES = 64  # the longest of them,
CACHED_PAIRS = 1 << 19  # and pairs of tokens
PIECES_AT_ONCE = 1 << 16
ID = np.dtype("<u4")
ENCODED = "doc_id long, n_bytes long, n_tokens long, ids binary"


class _Remembered(dict):
    """Packed tokens by piece. A full generation becomes the old one, from which pieces that come again return."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = self.encode(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Vocabulary:
    """Tokens by rank, as Latin-1 strings: one character a byte.

    ``parts[t]`` are the two tokens whose merge makes t, or None where no merge makes it (single bytes,
    and tokens that merging their own bytes never reaches). ``shorter[t]`` is the longest token that is a proper prefix of t.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.id = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        most = max(ranks.values(), default=-1) + 1
        self.text: list[str] = [""] * most
        self.paths = ahocorasick.Automaton()
        for token, rank in self.id.items():
            self.text[rank] = token
            self.paths.add_word(token, rank)
        self.widest = max(map(len, self.id), default=0)
        missing = [b for b in range(256) if chr(b) not in self.id]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.parts: list[tuple[int, int] | None] = [None] * most
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        self._split_all()
        # What starts like a token, to the longest token that it starts with. A token that no merge makes stands only for a whole piece.
        self.starts: dict[str, int] = {}
        self.shorter = [-1] * most
        for token, rank in self.id.items():
            longest = -1
            for n in range(1, len(token) + 1):
                if n == len(token):
                    self.shorter[rank] = longest
                part = self.id.get(token[:n], -1)
                if part >= 0 and (n == 1 or self.parts[part] is not None):
                    longest = part
                self.starts[token[:n]] = longest
        self.width = [len(t) for t in self.text]
        self.packed = [rank.to_bytes(4, "little") for rank in range(most)]
        self.pieces = _Remembered(self._pack)

    def _pack(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t] for t in self.encode_piece(piece.encode().decode("latin-1"))])

    def _split_all(self) -> None:
        """Lower ranks first: a token's parts are the two tokens left over when its bytes are merged without it."""
        for rank, token in enumerate(self.text):
            if len(token) < 2:
                continue
            left = self._merge(token, rank)
            if len(left) == 2:
                self.parts[rank] = left[0], left[1]
                self.merged[left[0], left[1]] = rank

    def _merge(self, piece: str, below: int) -> list[int]:
        """Plain merging by least rank with tokens of a rank below ``below``."""
        run, at = list(piece), self.id
        while len(run) > 1:
            best, place = below, -1
            for k in range(len(run) - 1):
                rank = at.get(run[k] + run[k + 1], below)
                if rank < best:
                    best, place = rank, k
            if place < 0:
                break
            run[place : place + 2] = [run[place] + run[place + 1]]
        return [at[part] for part in run]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of ``left`` and ``right`` together ends in just these two tokens; remembered.

        Both are taken apart again, the later merge first. At no time may the two tokens that touch have a merge
        that comes before the merges taken back so far, for it would have been made across the border.
        """
        a, b, limit = left, right, len(self.text)
        answer = None
        while answer is None:
            across = self.merged.get((a, b), limit)
            made_a, made_b = self.parts[a], self.parts[b]
            if across < limit:
                answer = False
            elif made_b is not None and (made_a is None or b >= a):
                # Of equal ranks the left one is merged first, so the right one is taken back first.
                limit, b = b + 1, made_b[0]
            elif made_a is not None:
                limit, a = a, made_a[1]
            else:
                answer = True
        if len(self.known) >= CACHED_PAIRS:
            self.known.clear()
        self.known[left * len(self.text) + right] = answer
        return answer

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens of one piece, exactly as merging it by least rank gives them.

        The automaton follows the text as far as any token goes on like it, which gives the longest token at a place. It is tried first, then
        its shorter prefixes, as long as it does not fit the token before it. A place from which no token
        fits is never entered again, so every place fails at most once and the work is linear in the length.
        """
        whole = self.id.get(piece)
        if whole is not None:
            return [whole]
        follow, starts, shorter, width, known, widest = self.paths.longest_prefix, self.starts, self.shorter, self.width, self.known, self.widest
        n, most, at, last = len(piece), len(self.text), 0, -1
        out: list[int] = []
        dead: set[int] = set()
        token = -1
        while at < n:
            if token < 0:
                ahead = piece[at : at + widest]
                token = starts[ahead[: follow(ahead)]]
            while token >= 0:
                end = at + width[token]
                if end not in dead:
                    fits = last < 0 or known.get(last * most + token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = end, token, -1
                continue
            # Nothing fits here: the token before gives way to a shorter one.
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= width[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@functools.lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


@functools.lru_cache(4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def encode_text(vocabulary: Vocabulary, pattern, text: str) -> bytes:
    """Tokens of a whole text as little-endian numbers, some thousand pieces at a time."""
    packed = vocabulary.pieces.__getitem__
    if len(text) <= PIECES_AT_ONCE:
        return b"".join(map(packed, pattern.findall(text)))
    found, out = (m.group() for m in pattern.finditer(text)), []
    while some := list(itertools.islice(found, PIECES_AT_ONCE)):
        out.append(b"".join(map(packed, some)))
    return b"".join(out)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Tokens of every whole text of ``docs(doc_id, text, ...)`` by the rank file at ``path``.

    -> ``doc_id, n_bytes, n_tokens, ids``; ``ids`` holds unsigned little-endian 32-bit numbers. Each match of ``pattern`` is
    encoded separately, what it does not match is left out, special tokens do not exist. Nothing is shuffled; ``path`` must name the
    file on every executor.

    A null or empty text has no tokens. A text of any length is encoded in time linear in it, also where it is one piece, and must fit in a
    row as any value does. Bytes that are not UTF-8 are read as U+FFFD. Repeated rows give equal rows, a null doc_id
    stays null, an empty table gives an empty table, extra columns are ignored whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pieces = _vocabulary(path), _pattern(pattern)
        for batch in batches:
            texts = batch.column(1)
            for row, stop, data, bounds in words.slices(texts):
                raw = memoryview(data)
                ids = [encode_text(vocabulary, pieces, str(raw[a:b], "utf-8", "replace")) for a, b in itertools.pairwise(bounds.tolist())]
                counts = pa.array([len(x) // ID.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array(np.diff(bounds)), counts, pa.array(ids, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "ids"]
                )

    return words.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ``ids`` stand for; null ids give none. An id without a token raises.

    Other columns are kept; one called ``decoded`` is replaced.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _vocabulary(path).text
        token = [t.encode("latin-1") for t in text]
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for row, stop, data, bounds in words.slices(batch.column(at)):
                part = batch.slice(row, stop - row)
                raw = data.tobytes()
                out = [b"".join([token[i] for i in np.frombuffer(raw[a:b], ID).tolist()]) for a, b in itertools.pairwise(bounds.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(work, f"{schema}, decoded binary")
