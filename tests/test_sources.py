"""Files of every scanned format, written by the test and read back."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from witnessframe.operators import profiles
from witnessframe.sources import images, logs, results, sessions, sinks


def png(width, height, pixel):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, lambda x, y: (x * 10, y * 20, 7)))
    rows = images.pixel_rows(images.read_images(spark, str(tmp_path)))
    assert {(r.x, r.y): (r.r, r.g, r.b) for r in rows.collect()} == {(x, y): (x * 10, y * 20, 7) for x in range(3) for y in range(2)}
    head = images.png_catalogue(images.read_files(spark, str(tmp_path))).first()
    assert (head.width, head.height, head.fast_path, head.is_png) == (3, 2, True, True)
    frames = rows.select("origin", "width", "height").distinct()
    assert images.check_size(frames, frames).isEmpty()
    assert images.check_size(frames, frames.withColumn("height", F.lit(9))).first().error == "expected 3x9, got 3x2"


def test_pgm(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n2 2\n255\n" + bytes([1, 10, 200, 255]))
    out = images.pgm_pixels(images.read_files(spark, str(tmp_path)))
    assert sorted((r.y, r.x, r.v) for r in out.collect()) == [(0, 0, 1), (0, 1, 10), (1, 0, 200), (1, 1, 255)]
    (tmp_path / "c.pgm").write_bytes(b"P5 # a long note " + b"x" * 9000 + b"\n 3 1\n#\n255\n" + bytes([7, 8, 9]))
    long = images.pgm_pixels(images.read_files(spark, str(tmp_path / "c.pgm")))
    assert [(r.x, r.v) for r in long.orderBy("x").collect()] == [(0, 7), (1, 8), (2, 9)]
    (tmp_path / "d.pgm").write_bytes(b"P5\n2 2\n2550\n" + bytes(4))
    with pytest.raises(Exception, match="unsupported PGM header"):
        images.pgm_pixels(images.read_files(spark, str(tmp_path / "d.pgm"))).collect()
    (tmp_path / "b.pgm").write_bytes(b"P5\n2 2\n255\n" + bytes(3))
    with pytest.raises(Exception, match="PGM pixel count mismatch"):
        images.pgm_pixels(images.read_files(spark, str(tmp_path / "b.pgm"))).collect()


def test_large_plane(spark, tmp_path):
    width, height = 1366, 2915
    (tmp_path / "big.pgm").write_bytes(b"P5\n%d %d\n255\n" % (width, height) + bytes(i % 251 for i in range(width * height)))
    total = images.pgm_pixels(images.read_files(spark, str(tmp_path))).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.max("y").alias("y")).first()
    assert (total.n, total.s, total.y) == (width * height, sum(i % 251 for i in range(width * height)), height - 1)


def test_sessions(spark, tmp_path):
    doc = {"fixture": "big", "absolute_ms": {"a": {"total": [2.0, 1.0]}}, "correctness": {"a": {"pixels": 4, "differing": 1, "pct": 25.0, "maxAbsDelta": 1}}}
    (tmp_path / "big_session1.json").write_text(json.dumps(doc, indent=2))
    read = sessions.read_sessions(spark, str(tmp_path))
    assert sorted(map(tuple, sessions.samples(read).collect())) == [("big", "big_session1", "a", "total", 0, 2.0), ("big", "big_session1", "a", "total", 1, 1.0)]
    assert tuple(sessions.differences(read).first()) == ("big", "a", 4, 1, 1)


def test_run_results(spark, tmp_path):
    doc = {"run_id": 1, "ok": False, "steps": [{"id": "a", "op": "url", "ok": True}, {"id": "b", "op": "click", "skipped": True}], "http_errors": [{"url": "u", "status": 404}], "failed_requests": [{"url": "u", "error": "e"}]}
    (tmp_path / "r.json").write_text(json.dumps(doc) + "\n" + json.dumps({"run_id": 2}) + "\n")
    read = results.read_runs(spark, str(tmp_path))
    assert sorted((r.run_id, r.idx, r.id) for r in results.steps(read).where("idx is not null").collect()) == [(1, 0, "a"), (1, 1, "b")]
    assert results.http_errors(read).first().status == 404 and results.failed_requests(read).first().error == "e"
    assert results.runs(read).count() == 2


def test_logs_and_traces(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.txt").write_text('[phase] fetch +12ms https://x\nOCR {"cpu_ms": 5}\n[phase] done +20ms\nOCR-ish {}\n')
    lines = logs.read_lines(spark, str(tmp_path / "log"))
    assert [(r.phase, r.ms, r.detail) for r in logs.phases(lines).orderBy("ms").collect()] == [("fetch", 12, "https://x"), ("done", 20, "")]
    assert [r.cpu_ms for r in logs.tagged(lines, "OCR", "cpu_ms INT").collect()] == [5]
    (tmp_path / "trace").mkdir()
    (tmp_path / "trace" / "t.txt").write_text(
        "File: bench\nType: cpu\n-----------+-----\n     10ms   leaf\n             mid\n             root\n-----------+-----\n    1.5s   other\n             root\n-----------+-----\n     20ms   leaf\n             mid\n             root\n"
    )
    folds = profiles.folded(logs.read_traces(spark, str(tmp_path / "trace")))
    assert {r.stack: r.ms for r in folds.collect()} == {"root;mid;leaf": 30.0, "root;other": 1500.0}
    tree = {r.node: (r.ms, r.start) for r in profiles.flame_offsets(profiles.subtree_totals(folds)).collect()}
    assert tree["root"] == (1530.0, 0.0) and tree["root;other"] == (1500.0, 0.0) and tree["root;mid"] == (30.0, 1500.0) and tree["root;mid;leaf"] == (30.0, 1500.0)


def test_marked_blocks(spark):
    text = ["x", "\x1b[91m==== L BEGIN\x1b[0m", "old", "==== L END", "==== L BEGIN", "a", "b", "==== L END", "after"]
    open_end = ["==== L BEGIN", "tail"]
    rows = [("f", i, s) for i, s in enumerate(text)] + [("g", i, s) for i, s in enumerate(open_end)] + [("h", 0, "none")]
    out = profiles.marked_block(spark.createDataFrame(rows, "file string, line_no int, line string"), "L")
    assert sorted((r.file, r.line) for r in out.collect()) == [("f", "a"), ("f", "b"), ("g", "tail")]


def test_flame_ties_by_name(spark):
    nodes = spark.createDataFrame([("r", 6.0), ("r;b", 2.0), ("r;a", 2.0), ("r;c", 2.0), ("r;c;d", 1.0)], "node string, ms double")
    got = {r.node: r.start for r in profiles.flame_offsets(nodes).collect()}
    assert got == {"r": 0.0, "r;a": 0.0, "r;b": 2.0, "r;c": 4.0, "r;c;d": 4.0}
    assert profiles.drawn_frames(profiles.flame_offsets(nodes)).count() == 5


def test_content_sink_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "store")
    objects = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id bigint, content string")
    first = {r.id: r.deduplicated for r in sinks.write_content(objects, path).collect()}
    again = {r.id: r.deduplicated for r in sinks.write_content(objects, path).collect()}
    assert first == {1: False, 2: False, 3: True} and again == {1: True, 2: True, 3: True}
    assert spark.read.parquet(path).count() == 2
