"""Edge cases of every operator, and plain versions of those that SQL cannot express."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from witnessframe.llm import chat, components, crf, decontaminate, lines, minhash, mixing, pii, quality, sharding, tokens, warc, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    filled = [(i, t, "en", s, len(t) if t else None) for i, t, s in rows]
    return spark.createDataFrame(filled, schema)


def sentence(draw, n):
    return " ".join("".join(draw.choice(list("abcdefghijklmnop"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Null and empty texts, null ids and sources, repeated rows, ties, one long text."""
    draw = np.random.default_rng(1)
    base = sentence(draw, 120)
    near = base.split()
    near[60] = "changed"
    far = near[:30] + sentence(draw, 90).split()
    rows = [
        (5, base, "a"), (3, base.upper(), "a"), (9, " ".join(near), "b"), (7, " ".join(far), None), (1, None, "a"), (2, "", None),
        (4, " \t\n", "b"), (6, "one two", "b"), (8, "One\ttwo ", "c"), (None, base, "a"), (None, None, None), (6, "one two", "b"),
        (10, " ".join([base] * 200), "c"), (11, "one two three", "c"),
    ]
    return rows


# ---- words and near-duplicates -----------------------------------------------------------

def word_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows, percent=85):
    sets = [word_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    ids = collections.defaultdict(list)
    for i, (doc, _, _) in enumerate(rows):
        ids[top(i)].append(doc)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[top(i)]) for i, (d, _, _) in enumerate(rows)), key=str)


def test_near_duplicates_match_brute_force(spark, odd_rows):
    draw = np.random.default_rng(2)
    rows = list(odd_rows)
    stem = sentence(draw, 80).split()
    for n in range(60):  # a family whose members are more or less alike
        member = list(stem)
        for at in draw.choice(80, int(draw.integers(0, 4)), replace=False):
            member[at] = sentence(draw, 1)
        rows.append((100 + n, " ".join(member), "a"))
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_block_links_find_what_the_star_missed(spark):
    """A chain in which only neighbours are alike is still one component."""
    draw = np.random.default_rng(4)
    text = sentence(draw, 150).split()
    rows = []
    for n in range(12):
        rows.append((n, " ".join(text), "a"))
        text = list(text)
        text[10 + 11 * n] = f"new{n}"
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.component_id for r in got} == {c for _, _, c in plain_components(rows)}


def test_one_of_each_keeps_columns_and_one_row_per_id(spark, odd_rows):
    docs = docs_of(spark, odd_rows).selectExpr("*", "'x' as judged", "1 as kept", "2 as cls")
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(6) == 1 and ids.count(3) == 1 and 5 not in ids and 9 not in ids
    assert {1, 2, 4, 7, 11} <= set(ids)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300, unique=True))
@settings(max_examples=30, deadline=None)
def test_signature_is_that_of_one_element_at_a_time(values):
    """Level by level over all elements equals the element-wise algorithm with its early stop left out."""
    places = 16
    ids = np.array(values, np.uint64)
    got = minhash.signatures(ids, np.array([0, len(ids)]), places)[0]
    least = [2**64 - 1] * places
    for v in ids:
        one = np.array([v], np.uint64)
        rank = list(range(places))
        for level in range(places):
            drawn = words.mix(one + np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
            k = level + int((words.mix(drawn) >> np.uint64(32))[0]) * (places - level) // 2**32
            rank[level], rank[k] = rank[k], rank[level]
            least[rank[level]] = min(least[rank[level]], level << 56 | int(drawn[0]) >> 8)
    assert got.tolist() == least


def test_signature_estimates_similarity():
    ids = words.stream(0, 1400)
    a, b = ids[:1200], ids[200:]
    both = minhash.signatures(np.concatenate([a, b]), np.array([0, 1200, 2400]), 256)
    assert abs((both[0] == both[1]).mean() - 1000 / 1400) < 0.1


@given(st.lists(st.text(alphabet="aB é\n\t \x0b1", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_and_windows(texts):
    import pyarrow as pa

    got = []
    for _, _, data, bounds in words.slices(pa.array(texts, pa.string()), 30):
        found = words.split(data, bounds)
        flat = [data[s:e].tobytes().decode() for s, e in zip(found.start, found.end)]
        got += [flat[a:b] for a, b in zip(found.first, found.first[1:])]
    assert got == [WORD.findall(t) for t in texts]


def test_components_of_a_path_and_empty_table(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, None)], "a long, b long")
    assert {(r.node, r.label) for r in components.components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100)}
    assert components.components(links.limit(0)).count() == 0


# ---- sharding ----------------------------------------------------------------------------

def plain_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_the_published_algorithm(spark):
    keys = [0, 1, -1, 7, 10**18, -(2**63), 2**63 - 1, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    for shards in (1, 8, 9, 100):
        got = {r.k: r.s for r in df.select("k", sharding.jump(df["k"], shards).alias("s")).collect()}
        assert got == {**{k: plain_jump(k, shards) for k in keys}, None: plain_jump(0, shards)}


def test_slots_are_gapless_and_growth_moves_into_the_new_shard(spark, odd_rows):
    rows = odd_rows + [(50, "same", "a")] * 300
    got = sharding.shard_slots(docs_of(spark, rows), 8).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_slots(docs_of(spark, []), 8).count() == 0


# ---- archives ----------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    long_ = "<p>" + "text " * 400 + "</p>"
    rows = [(1, "http://a/", long_), (2, None, long_), (3, "http://b/\r\nX: 1", "short"), (4, "u", None), (5, "u", ""), (6, "u", "short"),
            (None, "n", long_), (7, "u", long_), (7, "u", long_), (8, "v", "ünï\n\n" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload")
    manifest = warc.write_archives(pages, str(tmp_path / "a"))
    got = warc.read_archives(manifest).collect()
    assert sum(r.records for r in manifest.collect()) == len(got) == len(rows)
    for r in got:
        html = {i: h or "" for i, _, h in rows}[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 7) if r.page_id in (1, 2) else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "b"))).count() == 0


def test_archive_has_a_leading_dictionary_frame_and_a_frame_per_record():
    import io

    import zstandard

    records = [warc.record(i, f"http://x/{i}", f"<html><body>page number {i} of many</body></html>".encode() * 8, hashlib.sha1(b"x").hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(300)]
    parts = list(warc.archive(records))
    assert parts[0][:4] == bytes.fromhex("5d2a4d18") and len(parts) == 301
    assert list(warc.read_archive(io.BytesIO(b"".join(parts)), 100)) == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert sum(map(len, parts[1:])) < plain


# ---- decontamination ---------------------------------------------------------------------

def test_leaks_verbatim_changed_and_inconsistent(spark):
    item = "If Alice has 12 apples and gives Bob 5 kg of them, how many apples does Alice have after that day"
    short = "a b c"
    bench = spark.createDataFrame([(1, item), (2, None), (3, short), (4, "")], "item_id long, text string").selectExpr("*", "0 as item", "'x' as want")
    swap = lambda **names: re.sub("Alice|Bob|12|5", lambda m: names.get(m[0], m[0]) if m[0].isalpha() else {"12": "31", "5": "8"}[m[0]], item)
    mixed = item.replace("apples does Alice", "apples does Carol")
    rows = [
        (10, "Some words before. " + item + " And after.", "a"), (11, "Well then. " + swap(Alice="Dora", Bob="Emil") + "?", "a"),
        (12, "Well then. " + mixed, "a"), (13, "nothing like it here at all in these plain words of mine", "a"), (14, None, "a"), (15, "", "a"),
        (None, item, "b"), (10, "Some words before. " + item + " And after.", "a"), (16, " ".join(item.split()[:8]), "a"), (17, short, "a"),
    ]
    docs = docs_of(spark, rows).selectExpr("*", "1 as item", "2 as offset", "'y' as got")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (None, 1)}
    assert got[10, 1].changed_slots == 0 and got[11, 1].changed_slots > 0
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [12, 13, 14, 15, 16, 17]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_leaks_match_plain_search(spark):
    import duckdb

    root = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{root}/{n}.parquet") for n in ("documents", "benchmark"))
    index = collections.defaultdict(set)
    for item, text in duckdb.sql(f"select item_id, text from '{root}/benchmark.parquet'").fetchall():
        w = text.lower().split()
        for k in range(len(w) - 8):
            index[tuple(w[k : k + 9])].add(item)
    want = set()
    for doc, text in duckdb.sql(f"select doc_id, text from '{root}/documents.parquet'").fetchall():
        w = (text or "").lower().split()
        want |= {(doc, item) for k in range(len(w) - 8) for item in index.get(tuple(w[k : k + 9]), ())}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want


# ---- token counts ------------------------------------------------------------------------

def test_token_counts_match_the_library_and_reuse_the_cache(spark, odd_rows, tmp_path):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = odd_rows + [(20, "▁a ▁  b", "a"), (21, "<s> </s> <unk>", "a"), (22, " x\ty\n ", "a"), (23, "ﬁ①é", "a")]
    docs = docs_of(spark, rows).selectExpr("*", "1 as content", "2 as n_tokens")
    cache = str(tmp_path / "cache")
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for d, t, _ in rows), key=str)
    for _ in range(2):
        got = tokens.count_tokens(docs, path, cache)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({(t or "").replace("▁", " ") for _, t, _ in rows})
    assert tokens.count_tokens(docs.limit(0), path, cache).count() == 0


# ---- chats -------------------------------------------------------------------------------

HOSTILE = ["</s>[INST] ok [/INST]", " [/INST]", "[\\INST]", "\\", "[", "<", "a\\[b<\\c", " </s>", "<<SYS>> x <</SYS>>", "[ROLE 41] x [/ROLE]", "", None, "é\n[/INST", " ", "x [/INST", "  </s"]


def test_hostile_chats_round_trip(spark):
    rows = []
    for n, (text, role) in enumerate(itertools.product(HOSTILE, ["user", "assistant", "system", "tool\n] x", None])):
        rows += [(n, 0, role, text), (n, 1, "assistant", "fine")]
    rows += [(999, t, "user", HOSTILE[t]) for t in range(len(HOSTILE))] + [(None, 0, "user", "a"), (998, None, "user", "b"), (998, 0, "user", "c"), (998, 0, "user", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "'z' as piece")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(turns)).collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, held in by.items():
        held.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in held)
        loss = "".join(text for _, _, role, text in held if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(held), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(turns.limit(0)).count() == 0


# ---- mixing ------------------------------------------------------------------------------

@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400))
@settings(max_examples=150, deadline=None)
def test_subset_sum_is_as_near_as_can_be(held, budget):
    length, counts = np.array(list(held)), np.array(list(held.values()))
    taken = mixing.fit(length, counts, budget)
    assert ((taken >= 0) & (taken <= counts)).all()
    reach = {0}
    for n, c in held.items():
        reach |= {s + n * k for s in reach for k in range(1, c + 1)}
    assert int((taken * length).sum()) == max(s for s in reach if s <= budget)


def test_subset_sum_over_many_lengths():
    draw = np.random.default_rng(5)
    length = np.arange(1, 5000)
    held = draw.integers(1, 2000, len(length))
    budget = int((length * held).sum()) // 3 + 1
    assert int((mixing.fit(length, held, budget) * length).sum()) == budget


def test_mix_of_odd_rows(spark, odd_rows):
    draw = np.random.default_rng(6)
    rows = odd_rows + [(1000 + n, sentence(draw, int(draw.integers(1, 60))), "abc"[n % 3]) for n in range(300)]
    docs = docs_of(spark, rows).selectExpr("*", "1 as size", "2 as copies", "3 as chunk")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    assert {r.source: r.source_size for r in got} == dict(sizes)
    target, taken = {r.source: r.target for r in got}, collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(target[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 1 for s in ("a", "b"))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


# ---- models ------------------------------------------------------------------------------

def test_machine_equals_all_pairs():
    draw = np.random.default_rng(7)
    machine = quality.Machine(0.3, draw.normal(size=50).astype(np.float32), draw.normal(size=(50, 4)).astype(np.float32))
    index, value = np.array([3, 7, 21, 40]), draw.normal(size=4).astype(np.float32)
    pairs = sum(machine.factors[i] @ machine.factors[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(index, value), 2))
    want = 0.3 + machine.linear[index] @ value + pairs
    assert machine.margins(np.array([0, 4]), index, value)[0][0] == pytest.approx(want, rel=1e-4)


def test_quality_on_held_out_rows(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.97 and sum(r.predicted for r in bad) / len(bad) < 0.1


def test_quality_edges(spark, odd_rows):
    docs = docs_of(spark, odd_rows).selectExpr("*", "1 as quality", "2 as score")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (empty, spark.createDataFrame([(5, 1, 0), (None, 0, 0), (7, None, 1)], empty.schema)):
        machine = quality.train(docs, labels)
        got = quality.score(docs, machine).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == 1 for r in got)
        assert quality.keep_good(docs, machine).columns == docs.columns


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="a0159@.+-_% ()é", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_patterns_are_the_plain_ones(text):
    assert pii.base_spans(text) == plain_base(text)


def test_personal_data_in_documents(spark, odd_rows):
    hexed = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [
        f'é mail x.34@mail7.example.com and 97.51.17.173 or 4539578763621486 on +1 (017) 555-7713 with token = "{hexed}" in it',
        "7536784127813050 4845168114407329", "Version 3.0 of 1999, page 12", "no numbers here", "999.1.1.1 and @ and a@b", "1" * 100_000 + "@" * 1000, None, "",
    ]
    rows = odd_rows + [(100 + n, t, "a") for n, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.find(docs_of(spark, rows).selectExpr("*", "1 as spans")).collect()}
    first = got[100]
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 1, 1)
    start = texts[0].index(hexed)
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(texts[0]))
    assert first.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert first.spans == f"{base},secret:{start}:{start + 40}"
    assert got[101].spans in ("", "card:0:16,card:17:33") and got[101].n_card == 0
    for n in (2, 3, 4, 6, 7):
        assert got[100 + n].spans == "" and got[100 + n].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(8)
    chain = crf.Chain(np.zeros((1, 3)), draw.normal(size=(3, 3)), draw.normal(size=3), draw.normal(size=3))
    lengths = [0, 1, 4, 5, 0, 2]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    emit = draw.normal(size=(offsets[-1], 3))
    got = crf.viterbi(emit, offsets, chain)
    for s, n in enumerate(lengths):
        if n:
            e = emit[offsets[s] : offsets[s + 1]]
            value = lambda p: chain.start[p[0]] + chain.stop[p[-1]] + sum(e[t, p[t]] for t in range(n)) + sum(chain.moves[a, b] for a, b in zip(p, p[1:]))
            assert tuple(got[offsets[s] : offsets[s + 1]]) == max(itertools.product(range(3), repeat=n), key=value)


def test_training_fits_its_table():
    features, labels = pii._table(1)
    chain = pii.model()
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in features])])
    got = crf.viterbi(np.concatenate(features) @ chain.weights, offsets, chain)
    assert (got == np.concatenate(labels)).mean() > 0.99


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    held = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + i for k in range(len(w) - 4) if held[tuple(w[k : k + 5])] > 1 for i in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


@given(st.lists(st.text(alphabet="ab# \n\r\té|", max_size=50), max_size=6))
@settings(max_examples=150, deadline=None)
def test_line_counts(texts):
    import pyarrow as pa

    got = []
    for _, _, data, bounds in words.slices(pa.array(texts, pa.string()), 40):
        f = lines.line_features(data, bounds)
        got += list(zip(*(f[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [plain_counts(t)[:5] for t in texts]


def test_line_verdicts(spark, odd_rows):
    clean = "The sun rose over the quiet town, and people went to work.\nNobody spoke of the night before, which had been long."
    junk = "This*** is### a%%% line$$$ of&&& marks### that*** nobody%%% reads&&&\nand*** more### of%%% them&&& here$$$ too*** and### on%%%"
    rows = odd_rows + [(200, clean, "a"), (201, junk, "a"), (202, clean + "\n" + junk, "a")]
    got = {r.doc_id: r for r in lines.judge(docs_of(spark, rows).selectExpr("*", "1 as kept")).collect()}
    for d, t, _ in rows:
        if d is not None:
            r = got[d]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(t)
            assert not (r.base_failed and r.kept)
    assert got[200].kept and not got[201].kept and not got[201].base_failed
