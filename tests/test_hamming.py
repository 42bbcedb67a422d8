"""Near signatures at every distance, with buckets small enough to be cut again and again."""

import numpy as np
import pytest

from witnessframe.operators import hamming


def made(seed, n, words=8):
    """Signatures of smooth images: few bits differ, many are shared, with near copies at all distances."""
    draw = np.random.default_rng(seed)
    bits = np.zeros((n, 64 * words), np.uint8)
    bits[:, ::2] = 1
    loose = draw.choice(64 * words, 200, replace=False)
    bits[: n // 2, loose] = draw.random((n // 2, 200)) < draw.choice([0.05, 0.5], 200)
    bits[n // 2 :] = bits[draw.integers(0, n // 2, n - n // 2)]
    for row in bits[n // 2 :]:
        row[draw.choice(64 * words, draw.integers(0, 70), replace=False)] ^= 1
    bits = np.unique(bits, axis=0)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def brute(words, distance):
    near = np.bitwise_count(words[:, None, :] ^ words[None, :, :]).sum(axis=2)
    return {(i, j, int(near[i, j])) for i, j in zip(*np.nonzero(near <= distance)) if i < j}


@pytest.mark.parametrize("distance", [0, 1, 7, 16, 64])
@pytest.mark.parametrize("block", [24, 2048])
def test_pairs_equal_brute_force(spark, distance, block):
    words = made(1, 400)
    rows = [(i, [int(x) for x in w.view(np.int64)]) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "image long, words array<long>")
    found = [tuple(r) for r in hamming.near_pairs(df, distance, block).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(words, distance)


def test_every_pair_within_the_distance_shares_a_band():
    draw = np.random.default_rng(2)
    for distance in (0, 3, 7, 16, 40, 64):
        for n in (100_000, 10_000_000):
            bands, flips = hamming.plan(list(draw.permutation(512)), n, distance, 64)
            assert bands and len({b for band in bands for b in band}) == sum(map(len, bands)) and len(bands) * (flips + 1) > distance
            for _ in range(20):
                apart = set(draw.choice(512, distance, replace=False).tolist())
                assert min(len(apart & set(band)) for band in bands) <= flips


def test_flips_are_all_masks():
    masks = {int(m) for m in hamming._flips(6, 2)}
    assert masks == {m for m in range(64) if bin(m).count("1") <= 2}


def test_negative_distance_and_odd_rows(spark):
    df = spark.createDataFrame([(1, [0]), (2, [1]), (None, [3])], "image long, words array<long>")
    assert [tuple(r) for r in hamming.near_pairs(df, 1).collect()] == [(1, 2, 1)]
    assert hamming.near_pairs(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        hamming.near_pairs(df, -1)


def test_signatures_much_alike_are_not_dealt_to_bands(spark, monkeypatch):
    """Pairs that meet in most bands are compared once, in few blocks."""
    draw = np.random.default_rng(5)
    bits = np.unique((draw.random((3000, 512)) < 0.03).astype(np.uint8), axis=0)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    dealt, exact = [], hamming._exact
    monkeypatch.setattr(hamming, "_exact", lambda rows, distance, block: dealt.append(rows.count()) or exact(rows, distance, block))
    df = spark.createDataFrame([(i, [int(x) for x in w.view(np.int64)]) for i, w in enumerate(words)], "image long, words array<long>")
    found = [tuple(r) for r in hamming.near_pairs(df, 16, 64).collect()]
    assert dealt == [len(words)] and len(found) == len(set(found)) and set(found) == {p for k in range(0, len(words), 300) for p in near_from(words, k, 16)}


def near_from(words, k, distance):
    near = np.bitwise_count(words[k : k + 300, None, :] ^ words[None, :, :]).sum(axis=2)
    return {(int(i) + k, int(j), int(near[i, j])) for i, j in zip(*np.nonzero(near <= distance)) if i + k < j}


def test_a_pair_that_meets_in_several_bands_comes_out_of_the_first(spark, monkeypatch):
    draw = np.random.default_rng(6)
    bits = (draw.random((600, 512)) < 0.5).astype(np.uint8)
    bits[300:] = bits[:300]
    for row in bits[300:]:
        row[draw.choice(512, draw.integers(1, 12), replace=False)] ^= 1
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    dealt, met, exact = [], [], hamming._exact

    def seen(rows, distance, block):
        dealt.append(rows.count())
        pairs = exact(rows, distance, block)
        met.extend(tuple(r)[:3] for r in pairs.collect())
        return pairs

    monkeypatch.setattr(hamming, "_exact", seen)
    df = spark.createDataFrame([(i, [int(x) for x in w.view(np.int64)]) for i, w in enumerate(words)], "image long, words array<long>")
    found = {tuple(r) for r in hamming.near_pairs(df, 7, 24).collect()}
    assert found == brute(words, 7) and dealt[0] > len(words)
    assert len(met) == len(found)


def test_each_signature_is_made_once(spark):
    from witnessframe.catalog.pixels import recaptures

    plan = recaptures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") + plan.count("LogicalRDD ") == 1


def test_pairs_leave_in_parts():
    """Of signatures much alike all pairs are results; they must not be gathered before the first one leaves."""
    import pyarrow as pa

    n = 1500
    words = np.zeros((n, 8), np.int64)
    words[:, 3] = np.arange(n)
    zeros = pa.array(np.zeros(n, np.int64))
    lot = pa.RecordBatch.from_pydict({
        "bucket": zeros, "x": zeros, "y": zeros, "half": zeros, "image": pa.array(np.arange(n)), "copies": pa.array(np.ones(n, np.int64)), "words": pa.array(words.tolist(), pa.list_(pa.int64())),
        "seen": pa.array([[]] * n, pa.list_(pa.int64())), "side": pa.array(np.full(n, hamming.BOTH)),
    })
    parts = [part.to_pydict() for part in hamming._compare(16)(iter([lot.slice(0, 700), lot.slice(700)]))]
    assert len(parts) > 1 and max(len(part["image_a"]) for part in parts) < hamming.PART + hamming.TILE[0] * hamming.TILE[1]
    found = [pair for part in parts for pair in zip(part["image_a"], part["image_b"], part["distance"])]
    assert len(found) == len(set(found)) == n * (n - 1) // 2 and set(found) == brute(words.view(np.uint64), 16)
