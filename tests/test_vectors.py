"""Small inputs with known answers, and the edge cases the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from witnessframe.functions import luma as P
from witnessframe.functions import text as X
from witnessframe.functions import values as V
from witnessframe.operators import coverage as C
from witnessframe.operators import ledger, network, pixels, runs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_rules(spark):
    text = F.lit("aéb\U0001f600c")
    assert value(spark, X.metadata_value(text, 100)) == "a?b??c"
    assert value(spark, X.metadata_value(F.lit(42), 10)) == "42"
    assert value(spark, X.metadata_value(F.lit(None), 10)) == ""
    assert value(spark, X.metadata_value(F.lit("abcdef"), 3)) == "abc"
    assert value(spark, X.js_slice(text, 4)) == "aéb" and value(spark, X.js_slice(text, 5)) == "aéb\U0001f600"
    assert value(spark, X.safe_segment(F.lit("--a b//c--"))) == "a-b-c" and value(spark, X.safe_segment(F.lit("///"))) == "evidence"
    assert value(spark, X.norm_text(F.lit(" A  b\n"))) == "a b"
    assert value(spark, X.encode_uri_component(F.lit("a b*(c)!~'/é"))) == "a%20b*(c)!~'%2F%C3%A9"
    assert value(spark, X.iso_ms(F.timestamp_millis(F.lit(0)))) == "1970-01-01T00:00:00.000Z"
    assert value(spark, X.compact_stamp(F.lit("2026-09-28T01:02:03.456Z").cast("timestamp"))) == "20260928T010203Z"
    assert value(spark, X.screens_tall(F.lit(1), F.lit(8))) == "0.12" and value(spark, X.screens_tall(F.lit(201), F.lit(200))) == "1.00"
    assert value(spark, X.screens_tall(F.lit(1), F.lit(0))) == "-1"


def test_value_rules(spark):
    assert value(spark, V.js_string(F.lit(1e-7))) == "0.0000001" and value(spark, V.js_string(F.lit(3.0))) == "3"
    assert value(spark, V.js_number(F.lit(" 1e2 "))) == 100.0 and value(spark, F.isnan(V.js_number(F.lit("1d"))))
    shown = {1e-19: "0.0000000000000000001", 1.23456789012345e-10: "0.000000000123456789012345", 1e21: "1000000000000000000000", -2.5e-8: "-0.000000025",
             1.5e22: "15000000000000000000000", 123456789.125: "123456789.125", 0.1: "0.1", -7.0: "-7", 100.5: "100.5"}
    assert {x: value(spark, V.js_string(F.lit(x))) for x in shown} == shown
    assert value(spark, V.js_number(F.lit("\t5\n"))) == 5.0 and value(spark, V.js_number(F.lit("\u00a0\ufeff7 "))) == 7.0 and value(spark, V.js_number(F.lit("\n"))) == 0.0
    parsed = lambda text: F.parse_json(F.lit(text))
    assert [value(spark, V.variant_truthy(parsed(t))) for t in ('"0"', '"false"', '""', "0", "false", "null", "[]", "{}", "0.5")] == [True, True, False, False, False, False, True, True, True]
    assert [value(spark, V.variant_number(parsed(t))) for t in ("true", "null", '" 4 "', "2.5")] == [1.0, 0.0, 4.0, 2.5] and value(spark, F.isnan(V.variant_number(parsed("[]"))))
    assert value(spark, V.numeric_members(F.variant_get(parsed('{"a":1,"b":"12","c":null,"d":2.5}'), "$", "map<string,variant>"))) == {"a": 1.0, "d": 2.5}
    filled = value(spark, V.pass_defaults(F.lit(6), F.lit(""), F.lit(0), F.lit(2.0), F.lit(0)))
    assert filled.asDict() == {"psm": 6, "lang": "eng", "dpi": 300, "scale": 2.0, "pixel_budget": 20_000_000}
    assert [value(spark, V.factor_within_budget(F.lit(1366), F.lit(h), 3, 20_000_000)) for h in (5477, 900, 2000)] == [1, 3, 2]
    assert [value(spark, V.valid_scale(F.lit(s))) for s in (0.5, 2.0, 1.5, -1.0, 5.0)] == [True, True, False, False, False]
    assert value(spark, V.sample_step(F.lit(1366), F.lit(5477))) == 3
    assert value(spark, P.stretch_8p8(F.lit(5), F.lit(5), F.lit(5))) == 0 and value(spark, P.stretch_8p8(F.lit(128), F.lit(0), F.lit(65280))) == 1


def test_request_rules(spark):
    def errors(passes, scale, fraction, fallback, rule):
        return value(spark, runs.spec_errors(F.lit(passes), F.lit(scale), F.lit(fraction), F.lit(fallback), F.lit(rule)))

    assert errors(0, 1.0, 1.0, 0, True) and errors(1, 1.5, 1.0, 0, True) and errors(1, 1.0, 2.0, 0, True) and errors(1, 1.0, 1.0, 1, False)
    assert errors(1, 0.5, 0.7, 1, True) == []


def test_rectangles_and_planes(spark):
    box = value(spark, pixels.widened(F.lit(10.5), F.lit(2.2), F.lit(5.0), F.lit(1.0)))
    assert tuple(box) == (10, 2, 6, 2)
    rows = [(1, 4, 2, x, y, v) for y, line in enumerate([[0, 255, 0, 0], [255, 0, 0, 0]]) for x, v in enumerate(line)]
    plane = spark.createDataFrame(rows, "image_id int, width int, height int, x int, y int, v int")
    assert [r.v for r in pixels.downscaled(plane, 0.5).orderBy("x").collect()] == [128, 0]
    up = {(r.x, r.y): r.v for r in pixels.upscaled(plane, 2).collect()}
    assert len(up) == 32 and up[0, 0] == 0 and up[7, 3] == 0 and up[1, 0] == (3 * 0 * 4 + 255 * 4 + 8) >> 4
    ragged = pixels.plane_difference(plane, plane.where("x < 3"))
    summary = pixels.difference_summary(ragged, ["image_id"]).first()
    assert (summary.unmatched, summary.error, summary.differing) == (2, "dimension mismatch", 0)


def test_gallery_hash_ignores_row_order_and_sees_constant_images(spark):
    rows = [(i, 20, 33, x, y, (x * 7 + y * i) % 256, (x * y) % 256, 40) for i in (1, 2) for x in range(20) for y in range(33)]
    rows += [(3, 20, 33, x, y, 9, 9, 9) for x in range(20) for y in range(33)]
    px = spark.createDataFrame(rows, "image_id int, width int, height int, x int, y int, b int, g int, r int")
    one = {r.image_id: r.gallery_hash for r in pixels.gallery_hash(px).collect()}
    two = {r.image_id: r.gallery_hash for r in pixels.gallery_hash(px.repartition(7, "x")).collect()}
    assert one == two and one[3] == "0" * 128 and len(one[1]) == 128

    def brute(image):
        lum = {(r[3], r[4]): 299 * r[7] + 587 * r[6] + 114 * r[5] for r in rows if r[0] == image}
        w, h = 20, 33
        d, a = [], []
        for n, out in ((17, d), (16, a)):
            for row in range(16):
                y0 = row * h // 16
                y1 = min(max((row + 1) * h // 16, y0 + 1), h)
                for col in range(n):
                    cell = [lum[x, y] for y in range(y0, y1) for x in range(w) if ((x + 1) * n - 1) // w == col]
                    out.append(sum(cell) / max(len(cell), 1))
        mean = sum(a) / 256
        bits = [d[i // 16 * 17 + i % 16] > d[i // 16 * 17 + i % 16 + 1] for i in range(256)] + [v > mean for v in a]
        return "".join(f"{sum(1 << k for k in range(64) if bits[64 * q + k]):016x}" for q in range(8))

    assert one[1] == brute(1) and one[2] == brute(2)


def coverage_case(spark, passes, keywords, floor=0.8):
    reads = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate(passes)], "shot_id int, seq int, wave string, text string")
    wanted = spark.createDataFrame([(1, i, k) for i, k in enumerate(keywords)], "shot_id int, kw_pos int, keyword string")
    shots = spark.createDataFrame([(1, floor)], "shot_id int, min_fraction double")
    row = C.outcomes(reads, wanted, shots, chunk=1).first()
    hits = {r.keyword for r in C.keyword_hits(reads, wanted, chunk=1).where("first_seq is not null").collect()}
    return row, hits


def brute_coverage(passes, keywords, floor):
    norm = lambda s: " ".join(s.split()).lower()
    wanted = [norm(k) for k in keywords if norm(k)]
    text, read, won = "", 0, None
    share = lambda: sum(k in norm(text) for k in wanted) / len(wanted) if wanted else None
    for wave in ("passes", "fallback"):
        if wave == "fallback" and (not wanted or share() >= floor):
            break
        for i, (w, t) in enumerate(passes):
            if w == wave and won is None:
                text, read = text + t + "\n", read + 1
                if wanted and share() >= floor:
                    won = i
        if won is not None:
            break
    return won, read, share(), {k for k in keywords if norm(k) and norm(k) in norm(text)}


CASES = [
    ([("passes", "header\nSAVE AND   continue footer")], ["Save  and\nContinue", "Missing", "  "], 0.8),
    ([("passes", "one save"), ("passes", "and go"), ("fallback", "more")], ["save and", "save and go", "e a"], 1.0),
    ([("passes", "nothing"), ("fallback", "here"), ("fallback", "found it"), ("fallback", "extra")], ["found it", "here"], 1.0),
    ([("passes", "all here"), ("passes", "unread"), ("fallback", "unread")], ["all", "her"], 1.0),
    ([("passes", "a"), ("passes", ""), ("passes", " \n"), ("passes", "b"), ("passes", "c d")], ["a b c d", "b c", "a b c", "b c d e"], 0.5),
    ([("passes", "a"), ("fallback", "b")], [], 0.8),
    ([("passes", "x y"), ("fallback", "z")], ["none"], 0.0),
    ([("passes", "ab abab"), ("passes", "ababa b")], ["ab ab", "b ababa", "abab a", "ab abab abab", "baba b"], 1.0),
]


@pytest.mark.parametrize("passes, keywords, floor", CASES)
def test_coverage_equals_concatenated_text(spark, passes, keywords, floor):
    if not keywords:
        keywords = [" "]
    row, hits = coverage_case(spark, passes, keywords, floor)
    won, read, share, found = brute_coverage(passes, keywords, floor)
    assert (row.won_seq, row.passes_read) == (won, read)
    assert row.fraction == (None if share is None else pytest.approx(share))
    everything = " ".join(" ".join(t for _, t in passes).split()).lower()
    assert hits == {k for k in keywords if " ".join(k.split()) and " ".join(k.split()).lower() in everything} and found <= hits


def test_reader_is_only_asked_for_unmet_shots(spark):
    texts = {(1, 0): "alpha beta", (1, 1): "unread", (2, 0): "none", (2, 1): "alp", (2, 2): "alpha", (3, 0): "x", (3, 1): "y", (3, 2): "unread"}
    plan = [(s, q, "passes" if q < 2 else "fallback", f"{s}/{q}") for s, q in texts]
    planned = spark.createDataFrame(plan, "shot_id int, seq int, wave string, pass string")
    frames = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f")], "shot_id int, image string")
    known = F.create_map(*[F.lit(v) for (s, q), t in texts.items() for v in (f"{s}/{q}", t)])
    keywords = spark.createDataFrame([(1, 0, "Alpha"), (2, 0, "alpha"), (3, 0, " ")], "shot_id int, kw_pos int, keyword string")
    shots = spark.createDataFrame([(i, 1.0) for i in (1, 2, 3)], "shot_id int, min_fraction double")
    reads = C.read_until_met(planned, frames, lambda image, one: F.element_at(known, one), keywords, shots)
    assert sorted((r.shot_id, r.seq) for r in reads.collect()) == [(1, 0), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1)]


def test_reader_has_a_round_per_pass_still_needed(spark, monkeypatch):
    """Numbers that no pass has and passes after the last unmet shot cost no round; each keyword row counts, and keywords span passes."""
    texts = {(1, 0): "alpha be", (1, 300): "ta x", (1, 301): "unread", (2, 5): "a", (3, 0): "k", (3, 1): None, (3, 2): "q r", (4, 0): "free", (4, 1): "fallback"}
    planned = spark.createDataFrame([(s, q, "fallback" if s == 4 and q else "passes", f"{s}/{q}") for s, q in texts], "shot_id int, seq int, wave string, pass string")
    frames = spark.createDataFrame([(i, "f") for i in (1, 2, 3, 4)], "shot_id int, image string")
    known = F.create_map(*[F.lit(v) for (s, q), t in texts.items() if t for v in (f"{s}/{q}", t)])
    keywords = spark.createDataFrame([(1, 0, "beta"), (1, 1, "BE  ta"), (1, 2, "no"), (1, 3, "be TA"), (2, 0, "a"), (3, 0, "k q"), (3, 1, "z")], "shot_id int, kw_pos int, keyword string")
    shots = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 1.0), (4, 0.5)], "shot_id int, min_fraction double")
    stored, durable = [], C.durable
    monkeypatch.setattr(C, "durable", lambda df: stored.append(df) or durable(df) if len(stored) < 20 else pytest.fail("a round per number"))
    reads = C.read_until_met(planned, frames, lambda image, one: F.element_at(known, one), keywords, shots)
    assert sorted((r.shot_id, r.seq) for r in reads.collect()) == [(1, 0), (1, 300), (2, 5), (3, 0), (3, 1), (3, 2), (4, 0)]


def test_containment_of_short_and_long_phrases(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over it"), (2, "quick  brown"), (3, "nothing")], "doc_id int, text string")
    items = spark.createDataFrame(
        [(1, "uick brown fox jum"), (2, "ick  Bro"), (3, "hing"), (4, "a b c d e"), (5, "he quick brown fox jumps over i"), (6, " ")], "item_id int, text string"
    )
    assert sorted(map(tuple, C.containment(docs, items).collect())) == [(1, 1), (1, 2), (1, 5), (2, 2), (3, 3)]


def test_containment_normalizes_texts_with_candidates_alone(spark, tmp_path):
    docs = [(1, "The quick\tbrown fox jumps"), (2, "the quick brown fix jumps"), (3, None), (4, "a quick brown fox jumps and the quick brown fox")]
    spark.createDataFrame(docs, "doc_id int, text string").write.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick brown fox jumps"), (3, "he QUICK brown fox")], "item_id int, text string")
    found = C.containment(spark.read.parquet(str(tmp_path / "docs")), items)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (1, 3), (4, 1), (4, 2), (4, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Above the join with the texts that have one, and not below it.
    assert "LeftSemi" in plan and "regexp_replace" not in plan[plan.index("LeftSemi"):]


def test_bags(spark):
    a = spark.createDataFrame([(1, "The $5.00, the cat.")], "k int, t string")
    b = spark.createDataFrame([(1, "the dog; $5.00")], "k int, t string")
    row = C.bag_summary(C.word_counts(a, ["k"], "t"), C.word_counts(b, ["k"], "t"), ["k"]).first()
    assert (row.common_words, row.only_a_words, row.only_b_words) == (2, 2, 1)


def test_manifest(spark):
    columns = {"bucket": "b", "key": "k", "version_id": "v", "sha256": "s", "content_length": "1", "content_type": "t", "last_modified": "", "etag": "e", "attested_at_utc": "a"}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("x\ny")).alias("observed"))
    text = ledger.statements(df, "head").first().manifest
    assert text.startswith("head\nbucket=b\n") and text.endswith("attested-at-utc=a\nobserved.a=x y\nobserved.z=1\n")


STEP = "run_id int, idx int, id string, op string, optional boolean, if_ok string, if_failed string, if_html_incomplete string, raw_ok boolean, started boolean, html_complete boolean"


def outcome(spark, steps):
    rows = [(1, i, s.get("id", f"s{i}"), s.get("op", "url"), s.get("optional", False), s.get("if_ok"), s.get("if_failed"), s.get("if_html"),
             s.get("ok", True), s.get("started", True), s.get("html", False)) for i, s in enumerate(steps)]
    out = runs.run_outcomes(spark.createDataFrame(rows, STEP)).first()
    return out.all_ok, ["skip" if r.skipped else r.ok for r in out.results]


def test_step_gates(spark):
    assert outcome(spark, [{"ok": False, "optional": True}, {"if_ok": "s0"}, {"if_ok": "s1"}, {}]) == (True, [False, "skip", "skip", True])
    assert outcome(spark, [{}, {"ok": False}, {}]) == (False, [True, False, "skip"])
    assert outcome(spark, [{"ok": False, "optional": True}, {"if_failed": "s0"}]) == (True, [False, True])
    assert outcome(spark, [{"html": True}, {"if_html": "s0"}, {"if_ok": "s1"}]) == (True, [True, "skip", "skip"])
    # an image fails only once something waits for it, or at the end
    image = {"op": "screenshot", "ok": False}
    assert outcome(spark, [image, {}, {"if_ok": "s0"}, {}]) == (False, [False, True, "skip", "skip"])
    assert outcome(spark, [image, {}, {}]) == (False, [False, True, True])
    assert outcome(spark, [{**image, "optional": True}, {"if_failed": "s0"}]) == (True, [False, True])
    assert outcome(spark, [{**image, "started": False}, {}]) == (False, [False, "skip"])


def test_steps_name_earlier_ids(spark):
    schema = "run_id int, idx int, id string, op string, if_ok string, if_failed string, if_html_incomplete string, timeout_ms bigint"
    bad = spark.createDataFrame([(1, 0, None, "url", "later", None, None, None), (1, 1, "later", "url", None, None, None, None)], schema)
    assert "EARLIER" in runs.step_errors(bad, ["url"]).orderBy("idx").first().error
    good = spark.createDataFrame([(1, 0, "a", "url", None, None, None, None), (1, 1, None, "url", "a", None, None, 5)], schema)
    assert runs.step_errors(good, ["url"]).where("error is not null").isEmpty()
    crowd = spark.createDataFrame([(1, i, None, "url", None, None, None, None) for i in range(5)], schema)
    valid, rejects = runs.split_rejects(runs.step_errors(crowd, ["url"], max_steps=4))
    assert valid.isEmpty() and "at most 4" in rejects.first().error


EVENT = "page_id int, request_id string, ts timestamp, event_id int, kind string, url string, redirect boolean, status int"


def events(spark, rows):
    full = [(1, r, i, k, redirect, status) for i, (r, k, redirect, status) in enumerate(rows)]
    df = spark.createDataFrame(full, "page_id int, request_id string, event_id int, kind string, redirect boolean, status int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 40_000)).withColumn("url", F.lit("https://x/"))


def test_legs(spark):
    e = events(spark, [
        ("a", "finished", False, None), ("a", "open", False, None), ("a", "response", False, 302), ("a", "open", True, 307), ("a", "response", False, 200),
        ("a", "finished", False, None), ("a", "response", False, 500), ("a", "open", True, None), ("b", "open", False, None), ("b", "open", False, None), ("b", "failed", False, None),
    ])
    got = {(r.request_id, r.leg): (r.state, r.status, r.end_event_id) for r in network.legs(e).collect()}
    assert got == {("a", 1): ("redirected", 307, 3), ("a", 2): ("finished", 200, 5), ("a", 3): ("pending", None, None), ("b", 1): ("pending", None, None), ("b", 2): ("failed", None, 10)}
    assert sorted(r.event_id for r in network.orphans(e).collect()) == [0, 6]


def test_the_129th_leg_is_counted_not_kept(spark):
    e = events(spark, [(f"r{i}", "open", False, None) for i in range(131)])
    kept, dropped = network.bounded_trace(network.legs(e))
    assert kept.count() == 128 and tuple(dropped.first()) == (1, 128, 3)


def test_cookies_and_receipts(spark):
    raw = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '\n[{"name":"n","value":"v","path":"/","secure":true},{"name":"","value":"v"},{"name":"z"},5]'), (3, ""), (4, "{oops"), (5, "12"), (6, "null")], "k int, raw string").withColumn("u", F.lit("https://h"))
    kept, rejects = ledger.cookie_rows(raw, ["k"], "raw", "u")
    assert sorted((r.k, r.name, r.value, r.url, sorted(r.attributes.items())) for r in kept.collect()) == [
        (1, "a", "1", "https://h", []), (1, "b", "x", "https://h", []), (2, "n", "v", "https://h", [("path", "/"), ("secure", "true")])
    ]
    assert sorted(r.k for r in rejects.collect()) == [4, 5]
    comments = spark.createDataFrame([("x\n<!-- t-identity: " + "a" * 64 + " -->\ny",), ("<!-- t-identity: " + "b" * 64 + " -->",)], "body string")
    assert [r.identity for r in ledger.posted_identities(comments, "body", "t").collect()] == ["a" * 64]


def test_finalizer_payload(spark):
    cases = {
        '{"mode":"m","exitCode":3}': ("m", "3"), '{"Payload":{"mode":"x","exitCode":"7"}}': ("x", "7"), '{"mode":null}': ("", ""), '{"x":1}': None,
        "nonsense": None, '{"mode":"0","exitCode":true}': ("0", "1"), '{"Payload":"false","mode":"m"}': None, '{"Payload":0,"mode":false,"exitCode":null}': ("", "0"), '{"mode":"m","exitCode":"oops"}': ("m", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").withColumn("p", ledger.finalizer_payload(F.try_parse_json("raw")))
    assert {r.raw: r.p and tuple(r.p) for r in df.collect()} == cases


def test_tree_cycle_raises(spark):
    from witnessframe.operators.profiles import tree_totals

    with pytest.raises(ValueError):
        tree_totals(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id int, parent int, value int"), most_rounds=3)
