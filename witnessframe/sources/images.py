"""Image files as pixel rows, PNG headers, PGM planes and the plane sink."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_folder

PNG_SIGNATURE = "89504E470D0A1A0A"
SLICE_BYTES = 1 << 18  # image bytes unpacked at once


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images as one row per image row: origin, width, height, y and BGR(A) bytes.

    Spark's image source decodes; a file that is no image raises instead of vanishing. The bytes of a file are cut into
    rows where they lie, a bounded number of rows at a time, so they are never repeated per row.
    """
    decoded = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    bad = F.when(F.col("width") <= 0, F.raise_error(F.concat(F.lit("not an image: "), "origin")))
    checked = decoded.withColumn("width", F.coalesce(bad.cast("int"), "width"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                origin, width, height, channels, data = (column[i] for column in batch.columns)
                stride, rows, view = width.as_py() * channels.as_py(), height.as_py(), data.as_buffer()
                step = max(1, SLICE_BYTES // max(1, stride))
                for low in range(0, rows, step):
                    n = min(step, rows - low)
                    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * stride + low * stride)
                    lines = pa.Array.from_buffers(pa.large_binary(), n, [None, offsets.buffers()[1], view]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.repeat(x, n) for x in (origin, width, height, channels)), pa.array(np.arange(low, low + n, dtype=np.int32)), lines],
                        ["origin", "width", "height", "nChannels", "y", "row"],
                    )

    return checked.select("origin", "width", "height", "nChannels", "data").mapInArrow(
        cut, "origin string, width int, height int, nChannels int, y int, row binary"
    )


def pixel_rows(lines: DataFrame) -> DataFrame:
    """(origin, width, height, x, y, b, g, r) from BGR(A) or gray image rows, unpacked by one numpy pass per
    run of rows of one image, cut at a bounded number of bytes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, width, height, channels, y, row = batch.columns
            shape = [x.to_numpy(zero_copy_only=False) for x in (width, height, channels)]
            names = origin.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(names) != 0) | np.any([np.diff(x) != 0 for x in shape], axis=0)) + 1
            edges = [0, *change, batch.num_rows]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                w, c = int(shape[0][first]), int(shape[2][first])
                step = max(1, SLICE_BYTES // max(1, w * c))
                for low in range(first, last, step):
                    n = min(step, last - low)
                    px = np.frombuffer(b"".join(row.slice(low, n).to_pylist()), np.uint8).reshape(n * w, c)
                    colours = [px[:, k if c > 1 else 0].astype(np.int16) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.repeat(x[first], n * w) for x in (origin, width, height)), pa.array(np.tile(np.arange(w, dtype=np.int32), n)),
                         pa.array(np.repeat(y.slice(low, n).to_numpy(zero_copy_only=False).astype(np.int32), w)), *map(pa.array, colours)],
                        ["origin", "width", "height", "x", "y", "b", "g", "r"],
                    )

    return lines.select("origin", "width", "height", "nChannels", "y", "row").mapInArrow(
        unpack, "origin string, width int, height int, x int, y int, b smallint, g smallint, r smallint"
    )


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of a (height, width, 3) array."""
    height, width, _ = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = np.hstack([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)]).tobytes()  # each row unfiltered
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return bytes.fromhex(PNG_SIGNATURE) + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_pngs(pixels: DataFrame, folder: str) -> DataFrame:
    """One ``<image_id>.png`` per image in ``folder``, a URI all executors can write to; -> image_id, file.

    A file needs all pixels of its image at once, as any PNG does. A task that runs again writes the same bytes.
    """

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        width, height, name = int(frame["width"].iloc[0]), int(frame["height"].iloc[0]), f"{frame['image_id'].iloc[0]}.png"
        picture = np.zeros((height, width, 3), np.uint8)
        picture[frame["y"], frame["x"]] = frame[["r", "g", "b"]]
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(png_bytes(picture))
        return pd.DataFrame({"image_id": frame["image_id"].iloc[:1], "file": [f"{folder}/{name}"]})

    wanted = pixels.select("image_id", "width", "height", "x", "y", "r", "g", "b")
    return wanted.groupBy("image_id").applyInPandas(write, "image_id bigint, file string")


def check_size(images: DataFrame, expected: DataFrame) -> DataFrame:
    """Images whose size differs from the expected one, with a message."""
    want = expected.select("origin", F.col("width").alias("_w"), F.col("height").alias("_h"))
    wrong = (F.col("width") != F.col("_w")) | (F.col("height") != F.col("_h"))
    text = F.format_string("expected %dx%d, got %dx%d", "_w", "_h", "width", "height")
    return images.join(want, "origin").where(wrong).select("origin", text.alias("error"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def png_catalogue(files: DataFrame) -> DataFrame:
    """Header facts of PNG bytes; only 8-bit non-interlaced RGB and RGBA take the fast path."""

    def number(start, length):
        return F.conv(F.hex(F.substring("content", start, length)), 16, 10).cast("bigint")

    ok = (F.hex(F.substring("content", 1, 8)) == PNG_SIGNATURE) & (F.substring("content", 13, 4) == F.encode(F.lit("IHDR"), "UTF-8"))
    rest = [c for c in files.columns if c != "content"]
    out = files.select(
        *rest, F.sha1("content").alias("sha1"), F.length("content").alias("bytes"), F.coalesce(ok, F.lit(False)).alias("is_png"),
        number(17, 4).alias("width"), number(21, 4).alias("height"), number(25, 1).cast("int").alias("bit_depth"),
        number(26, 1).cast("int").alias("color_type"), number(29, 1).cast("int").alias("interlace"),
    )
    fast = F.col("is_png") & (F.col("bit_depth") == 8) & (F.col("interlace") == 0) & F.col("color_type").isin(2, 6)
    return out.withColumn("fast_path", fast)


def _pgm(content: bytes) -> tuple[int, int, int]:
    """(offset of the pixels, width, height): lines are read until they hold four tokens, ``#`` starts a comment."""
    tokens, at = [], 0
    while len(tokens) < 4:
        end = content.find(b"\n", at)
        if at >= len(content):
            raise ValueError("truncated PGM header")
        line = content[at : len(content) if end < 0 else end]
        at = len(content) if end < 0 else end + 1
        tokens += line.split(b"#", 1)[0].split()
    if tokens[0] != b"P5" or tokens[3] != b"255" or not (tokens[1].isdigit() and tokens[2].isdigit()):
        raise ValueError("unsupported PGM header")
    width, height = int(tokens[1]), int(tokens[2])
    if len(content) - at != width * height:
        raise ValueError("PGM pixel count mismatch")
    return at, width, height


def pgm_pixels(files: DataFrame) -> DataFrame:
    """Pixels of binary PGM files; a wrong magic, depth or byte count fails the job.

    A file's bytes are unpacked where they lie, a bounded number of pixels at a time.
    """
    keys = [f for f in files.schema.fields if f.name != "content"]
    schema = StructType([*keys, *(StructField(n, IntegerType()) for n in ("width", "height", "x", "y", "v"))])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(batch.num_columns - 1)[i].as_py()
                at, width, height = _pgm(content)
                pixels = np.frombuffer(content, np.uint8, offset=at)
                for low in range(0, len(pixels), SLICE_BYTES):
                    place = np.arange(low, min(low + SLICE_BYTES, len(pixels)), dtype=np.int64)
                    same = [pa.repeat(column[i], len(place)) for column in batch.columns[:-1]]
                    size = [pa.array(np.full(len(place), n, np.int32)) for n in (width, height)]
                    x, y, v = (place % width).astype(np.int32), (place // width).astype(np.int32), pixels[place].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*same, *size, pa.array(x), pa.array(y), pa.array(v)], schema.names)

    return files.select(*[f.name for f in keys], "content").mapInArrow(unpack, schema)


def write_planes(plane: DataFrame, path: str | None = None) -> DataFrame:
    """Store gray planes as one binary row per image row and return the stored table."""
    spark = plane.sparkSession
    path = path or os.path.join(shared_folder(spark), f"planes-{uuid.uuid4().hex}")
    ordered = F.array_sort(F.collect_list(F.struct("x", "v")))
    packed = F.unhex(F.array_join(F.transform(ordered, lambda p: F.lpad(F.hex(p["v"]), 2, "0")), ""))
    plane.groupBy("image_id", "width", "height", "y").agg(packed.alias("row")).write.mode("append").parquet(path)
    return spark.read.parquet(path)
