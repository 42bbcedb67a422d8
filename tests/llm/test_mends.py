"""Budgets, bounds and names that odd rows once broke."""

import collections
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from witnessframe.llm import decontaminate, minhash, mixing, pii, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(n, seed):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefgh"), 4)) for _ in range(n))


@pytest.mark.parametrize("ids", ["null", "shared", "own"])
def test_mixed_keeps_to_the_targets(spark, ids):
    """Rows without doc_id, and ids that texts of different sources share, take what their source gets and no more."""
    rows = [({"null": None, "shared": i // 3, "own": i}[ids], text_of(5 + i % 17, i), "en", "abc"[i % 3] if i % 50 else None, 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as size", "2 as `rank`", "3 as copies", "'x' as `_size`", "4 as row")
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words, copies = collections.Counter(), collections.Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
        copies[r.doc_id, r.text] += 1
    for source, wanted in target.items():
        assert abs(words[source] - wanted) <= 0.02 * wanted + 1, (source, words[source], wanted)
    taken = {(r.doc_id, r.size, r.source): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.size, r.source] += r.copies
    assert sum(taken.values()) == sum(copies.values())


def test_a_column_called_digest_is_kept(spark):
    base = text_of(60, 1)
    docs = spark.createDataFrame([(1, base, "mine"), (2, base, "other"), (3, text_of(40, 2), "third"), (3, text_of(40, 2), "third")], "doc_id long, text string, _digest string")
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r._digest) for r in left.collect()) == [(1, "mine"), (3, "third")]
    bench = spark.createDataFrame([(1, text_of(40, 2))], "item_id long, text string")
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(r._digest for r in clean.collect()) == ["mine", "other"]


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    rows = [(1, f"good text number {i}", "en", "a", 10) for i in range(400)] + [(i, text_of(20, i), "en", "a", 10) for i in range(2, 40)]
    labels = [(i, i % 2) for i in range(1, 40)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda vectors, *rest: seen.append(len(vectors)) or fit(vectors, *rest))
    quality.train(docs, known, sample=10)
    assert seen[0] <= 20


def test_emails_in_linear_time():
    seconds = []
    for n in (50_000, 400_000):
        start = time.perf_counter()
        assert pii.base_spans("@ " * n + "a.b@c.de") == [("email", 2 * n, 2 * n + 8)]
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 30 * seconds[0] + 0.5
    assert pii.base_spans("a@b@c.de x@y.z.") == [("email", 2, 8), ("email", 9, 14)]


def test_archives_are_read_where_they_were_written(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html")).repartition(6)
    manifest = warc.write_archives(pages, warc.fresh_folder(spark))
    read = warc.read_archives(manifest, payloads=False)
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert read.count() == 400 and tasks == min(manifest.select(F.spark_partition_id()).distinct().count(), manifest.count()) > 1
