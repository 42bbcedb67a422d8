"""Ranked lexical search: term at a time over document blocks, with a limit on accumulators."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import words

MOST = 10
ITEMS_AT_ONCE = 4096  # items that are ranked in one pass over the documents
POSTINGS_AT_ONCE = 1 << 19  # postings of the documents that one set of accumulators covers
SALTS = 64
#: Bytes that belong to no term: ASCII without letters and digits.
APART = np.zeros(256, bool)
APART[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every term, offsets of each text's terms), ASCII capitals folded."""
    found = words.split(data, bounds, APART)
    return words.hashes(found), found.first


def forward_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Terms of every document that has any: ``doc_id, n, terms, counts``.

    n counts all terms with repeats; terms are places in ``vocabulary`` (sorted term hashes), ascending, with their counts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in batches:
            for row, stop, data, bounds in words.slices(batch.column(1)):
                hashed, first = _hashes(data, bounds)
                n = np.diff(first)
                place = np.minimum(np.searchsorted(vocabulary, hashed), size - 1)
                hit = np.flatnonzero(vocabulary[place] == hashed) if len(vocabulary) else np.zeros(0, np.int64)
                text = np.repeat(np.arange(len(n)), n)[hit]
                pairs, counts = np.unique(text * size + place[hit], return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(len(n) + 1) * size).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, stop - row), pa.array(n),
                        pa.ListArray.from_arrays(offsets, pa.array((pairs % size).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts)),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                ).filter(pa.array(n > 0))

    texts = words.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(work, "doc_id long, n long, terms array<int>, counts array<long>")


@dataclass
class Query:
    """Terms of one item, rarest first, each with its weight times its repeats."""

    item: int
    terms: np.ndarray
    weights: np.ndarray


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Postings of some documents by term: ``start[t]:start[t + 1]`` are those of term t."""

    doc_ids: np.ndarray  # of objects, as an id may be null
    start: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # the largest impact of each term


def invert(doc_ids: np.ndarray, n: np.ndarray, held: np.ndarray, terms: np.ndarray, counts: np.ndarray, size: int, n_docs: int, length: int) -> Block:
    doc = np.repeat(np.arange(len(n)), held)
    m = 25 + (75 * n * n_docs) // length
    impact = (1_000_000_000 * counts) // (1000 * counts + 8 * m[doc])
    order = np.argsort(terms, kind="stable")
    start = np.searchsorted(terms[order], np.arange(size + 1))
    most = np.zeros(size, np.int64)
    some = np.flatnonzero(np.diff(start))
    if len(some):
        most[some] = np.maximum.reduceat(impact[order], start[some])
    return Block(doc_ids, start, doc[order], impact[order], most)


def _least_of_best(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def accumulate(block: Block, query: Query, k: int, floor: int = 0) -> np.ndarray:
    """Scores of the block's documents, exact for all that can be among the best k; others may be lower or 0.

    Terms go rarest first. A document without an accumulator can get no more than what the terms to come give at most: once that is below
    ``floor``, or below the k-th partial score, no accumulator is made any more, and only those there are go on. A tie with the k-th still makes one.
    """
    score = np.zeros(len(block.doc_ids), np.int64)
    rest = np.cumsum((query.weights * block.most[query.terms])[::-1])[::-1]
    creating = True
    for j, (term, w) in enumerate(zip(query.terms.tolist(), query.weights.tolist())):
        a, b = block.start[term], block.start[term + 1]
        if a == b:
            continue
        if creating and j and score.max() > rest[j]:
            floor = max(floor, _least_of_best(score, k))
        creating = creating and rest[j] >= floor
        doc, gain = block.doc[a:b], w * block.impact[a:b]
        if not creating:
            survives = score[doc] > 0
            doc, gain = doc[survives], gain[survives]
        score[doc] += gain
    return score


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, equal ones by ascending id, null last."""
    keep = np.flatnonzero(scores >= max(1, _least_of_best(scores, k)))
    order = sorted(keep.tolist(), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:k]
    return scores[order], ids[order]


def _ranker(queries: list[Query], size: int, n_docs: int, length: int, k: int):
    """Best documents of a partition for every item; what a block has found raises the floor for the next."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten()) + batch.num_rows
            if postings >= POSTINGS_AT_ONCE:
                yield joined(held)
                held, postings = [], 0
        if held:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> Block:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = [rows.column(i).combine_chunks() for i in (2, 3)]
        return invert(
            np.array(rows.column(0).to_pylist(), object), rows.column(1).to_numpy(), lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
            lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), size, n_docs, length,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q.item: (np.zeros(0, np.int64), np.zeros(0, object)) for q in queries}
        for block in blocks(batches):
            for q in queries:
                scores, ids = best[q.item]
                found = accumulate(block, q, k, int(scores[-1]) if len(scores) == k else 0)
                some = np.flatnonzero(found)
                if len(some):
                    best[q.item] = _best(np.concatenate([scores, found[some]]), np.concatenate([ids, block.doc_ids[some]]), k)
        for item, (scores, ids) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(scores), pa.int32()), pa.array(ids.tolist(), pa.int64()), pa.array(scores)], ["item", "doc_id", "score"])

    return work


def _rank_some(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    rows = items.select("item_id", "text").collect()  # at most about ITEMS_AT_ONCE
    raw = [(r["text"] or "").encode() for r in rows]
    hashed, first = _hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    vocabulary = np.unique(hashed)
    index = durable(forward_index(docs, vocabulary))
    n_docs, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = dict(map(tuple, held.collect()))  # one number per term of the items
    queries = []
    for i in range(len(rows)):
        repeats = Counter(np.searchsorted(vocabulary, hashed[first[i] : first[i + 1]]).tolist())
        weighed = sorted((df[t], t, weight(n_docs, df[t]) * c) for t, c in repeats.items() if t in df)
        weighed = [(t, w) for _, t, w in weighed if w > 0]
        if weighed:
            queries.append(Query(i, *(np.array(x, np.int64) for x in zip(*weighed))))
    schema = items.select("item_id").schema
    if not queries:
        return docs.sparkSession.createDataFrame([], f"item_id {schema[0].dataType.simpleString()}, rank int, doc_id long, score long")
    found = index.where(F.size("terms") > 0).mapInArrow(_ranker(queries, len(vocabulary), n_docs, length, k), "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    # Every partition sends k rows an item; they are cut to k a salt before an item's rows meet.
    cut = found.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= k)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {schema[0].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = MOST) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id, text, ...)`` for each row of ``items(item_id, text, ...)``.

    -> ``item_id, rank, doc_id, score``: scores above 0, highest first, equal ones by ascending doc_id, null last.

    1. One pass keeps of each text its length and the counts of terms that any item has; N, L and every df are sums over all documents.
    2. Each task inverts its documents in blocks of about 500,000 postings and ranks all items on each by ``accumulate``; what it has found so far is the floor of its
       next block. It returns k rows an item, which are merged by salt and then by item.

    Nothing else is shuffled, so a frequent term or a hot source stays where its documents are. More than 4,096 items go in groups
    of about that many, a pass over the documents each. Terms are compared by 64-bit hashes. Whole texts count. A null text has no terms, an item without terms no rows; repeated
    documents are ranked side by side; items that share an id each get their ranks; empty tables give no rows; extra columns are ignored.
    """
    n = items.count()
    groups = max(1, -(-n // ITEMS_AT_ONCE))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    found = [_rank_some(docs, items.where(of == g) if groups > 1 else items, k) for g in range(groups)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


ORACLE = r"""
with split_ as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term,
    u from (select *, row_number() over () as u from documents)
), lengths as (
  select u, doc_id, count(*)::bigint as n from split_ group by u, doc_id
), whole as (
  select count(*)::bigint as n_docs, sum(n)::bigint as length from lengths
), postings as (
  select u, term, count(*)::bigint as tf from split_ group by u, term
), weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, whole group by term
), asked as (
  select i, item_id, term, count(*)::bigint as repeats from (
    select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select *, row_number() over () as i from benchmark)) group by all
), scores as (
  select i, item_id, u, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // length)))))::bigint as score
  from asked join postings using (term) join weights using (term) join lengths using (u), whole group by all
)
select item_id, row_number() over (partition by i order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0 qualify rank <= 10"""
