"""Document quality by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

HASHED = 1 << 15
FACTORS = 8
# Documents of each label that the model is fitted on, at most, chosen by a hash of doc_id.
SAMPLE = 3000
EPOCHS = 6
# Added to the squared norm of the word counts, so that the few words of a short text weigh little.
FEW_WORDS = 25.0
STRUCTURE = (
    "known_length", "length", "words", "word_length", "capitals", "digits", "marks", "exclaimed", "bars",
    "marked_words", "stopped_words", "repeats_last", "distinct", "lines", "long_words", "beyond_ascii",
)
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&|<>"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?!"]] = True
_U = np.uint64


def features(data: np.ndarray, bounds: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (offsets, indices, values): normalised log counts of hashed words, then structure statistics."""
    found = words.split(data, bounds)
    n = len(bounds) - 1
    owner, count = found.text_of_word, np.diff(found.first)
    hashed = words.hashes(found)

    def total(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[at])

    size = np.maximum(np.diff(bounds), 1)
    each = np.maximum(count, 1)
    last = data[found.end - 1] if len(owner) else np.zeros(0, np.uint8)
    length = found.end - found.start
    again = np.zeros(len(owner), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    key, copies = np.unique(owner.astype(np.int64) * HASHED + (hashed % _U(HASHED)).astype(np.int64), return_counts=True)
    text, index = key // HASHED, key % HASHED
    stats = np.stack([
        np.log1p(np.maximum(n_chars, 0)) / 12, np.log1p(np.diff(bounds)) / 12, np.log1p(count) / 10, total(length, found.first) / each / 10,
        total((data >= 65) & (data <= 90), bounds) / size, total((data >= 48) & (data <= 57), bounds) / size, total(_MARK[data], bounds) / size,
        total(data == 33, bounds) / size, total(data == 124, bounds) / size, total(_MARK[last], found.first) / each, total(_STOP[last], found.first) / each,
        total(again, found.first) / each, np.bincount(text, minlength=n) / each, total(data == 10, bounds) / each, total(length > 15, found.first) / each,
        total(data >= 128, bounds) / size,
    ], axis=1)
    value = np.log1p(copies)
    norm = np.sqrt(np.bincount(text, value * value, n) + FEW_WORDS)
    value = value / norm[text]
    width = len(STRUCTURE)
    per_row = np.bincount(text, minlength=n) + width
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    at_word = np.arange(len(text)) + text * width
    indices, values = np.empty(offsets[-1], np.int32), np.empty(offsets[-1], np.float32)
    indices[at_word], values[at_word] = index, value
    at_stat = (offsets[1:, None] - width) + np.arange(width)
    indices[at_stat], values[at_stat] = HASHED + np.arange(width), stats
    return offsets, indices, values


@dataclass
class Machine:
    """Bias, linear weights and factors; ``score`` is linear in the stored values of a row."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins and factor sums of rows that all hold something.

        The sum over pairs <v_i, v_j> x_i x_j is half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor.
        """
        at = offsets[:-1]
        weighed = self.factors[indices] * values[:, None]
        sums = np.add.reduceat(weighed, at)
        pairs = (sums * sums - np.add.reduceat(weighed * weighed, at)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.linear[indices] * values, at) + pairs, sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: tuple[float, float], *, seed: int = 5, batch: int = 128, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """AdaGrad on the logistic loss; ``shares`` are the weights of labels 0 and 1 among all labelled documents."""
    size = HASHED + len(STRUCTURE)
    draw = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(size, np.float32), draw.normal(0, 0.01, (size, FACTORS)).astype(np.float32))
    ones = int(labels.sum())
    if not len(labels) or ones in (0, len(labels)):
        machine.bias = 0.0 if not len(labels) else (3.0 if ones else -3.0)
        machine.factors[:] = 0
        return machine
    weight = len(labels) * np.where(labels == 1, shares[1] / ones, shares[0] / (len(labels) - ones)) / sum(shares)
    speed_l, speed_f, speed_b = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for low in range(0, len(order), batch):
            picked = order[low : low + batch]
            lengths = np.array([len(rows[i][0]) for i in picked])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            indices = np.concatenate([rows[i][0] for i in picked])
            values = np.concatenate([rows[i][1] for i in picked])
            margin, sums = machine.margins(offsets, indices, values)
            slope = ((sigmoid(margin) - labels[picked]) * weight[picked] / len(picked)).astype(np.float32)
            each = np.repeat(slope, lengths) * values
            touched, place = np.unique(indices, return_inverse=True)
            step_l = np.bincount(place, each, len(touched)).astype(np.float32) + decay * machine.linear[touched]
            pull = each[:, None] * (np.repeat(sums, lengths, axis=0) - machine.factors[indices] * values[:, None])
            step_f = np.stack([np.bincount(place, pull[:, f], len(touched)) for f in range(FACTORS)], axis=1).astype(np.float32) + decay * machine.factors[touched]
            step_b = float(slope.sum())
            speed_l[touched] += step_l**2
            speed_f[touched] += step_f**2
            speed_b += step_b**2
            machine.linear[touched] -= rate * step_l / np.sqrt(speed_l[touched])
            machine.factors[touched] -= rate * 0.3 * step_f / np.sqrt(speed_f[touched])
            machine.bias -= rate * step_b / speed_b**0.5
    return machine


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, n_chars, text) -> (quality, indices, values)."""
    for batch in batches:
        known = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        for row, stop, data, bounds in words.slices(batch.column(2)):
            offsets, indices, values = features(data, bounds, known[row:stop])
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, stop - row), pa.ListArray.from_arrays(at, pa.array(indices)), pa.ListArray.from_arrays(at, pa.array(values))],
                ["quality", "indices", "values"],
            )


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` documents of each label, none of them held out.

    The sample is the labelled documents first in a hash of doc_id, so it does not depend on
    the order of rows. At most 2 * sample ids are broadcast, and the feature rows of those
    documents come to the driver, where the model is fitted. A doc_id labelled twice counts with its lesser label, one
    with several texts with that of the least digest; rows without doc_id or label are not used.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = known.agg(F.count(F.lit(1)).alias("all"), F.sum("quality").alias("good")).first()
    shares = (held["all"] - (held["good"] or 0), held["good"] or 0)
    order = [F.xxhash64(F.lit(11), F.col("doc_id")), F.col("doc_id")]
    picked = known.where("quality = 1").orderBy(*order).limit(sample).unionByName(known.where("quality = 0").orderBy(*order).limit(sample))
    texts = words.small_batches(docs).select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "text").join(F.broadcast(picked), "doc_id")
    # One row per sampled id, so the bound holds for rows too.
    one = F.min_by(F.struct("n_chars", "text"), F.struct(F.md5("text"), "n_chars")).alias("d")
    texts = texts.groupBy("doc_id", "quality").agg(one).select("quality", "d.*")
    rows = texts.select(F.col("quality").cast("int"), "n_chars", "text").mapInArrow(_featurise, "quality int, indices array<int>, values array<float>").toArrow()
    quality = np.array(rows.column("quality").to_pylist(), np.int64)
    vectors = []
    for chunk_i, chunk_v in zip(rows.column("indices").chunks, rows.column("values").chunks):
        cut = chunk_i.offsets.to_numpy()
        index, value = chunk_i.values.to_numpy(), chunk_v.values.to_numpy()
        vectors += [(index[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    order = sorted(range(len(vectors)), key=lambda n: (quality[n], len(vectors[n][0]), vectors[n][1].tobytes(), vectors[n][0].tobytes()))
    return fit([vectors[n] for n in order], quality[order], shares)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text, n_chars, ...)``.

    Scores come from the text and its recorded length alone. A null text is scored as an
    empty one, a null n_chars as 0. Repeated rows are scored alike; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            known = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for row, stop, data, bounds in words.slices(batch.column(2)):
                margin, _ = model.margins(*features(data, bounds, known[row:stop]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(sigmoid(margin.astype(np.float64)))], ["doc_id", "score"])

    scored = words.small_batches(docs).select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "text").mapInArrow(scores, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more; decided where the row is, so nothing moves."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    text_at, length_at = docs.columns.index("text"), docs.columns.index("n_chars")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(length_at).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for row, stop, data, bounds in words.slices(batch.column(text_at)):
                margin, _ = shared.value.margins(*features(data, bounds, known[row:stop]))
                yield batch.slice(row, stop - row).filter(pa.array(sigmoid(margin.astype(np.float64)) >= 0.5))

    return words.small_batches(docs).mapInArrow(good, docs.schema)
