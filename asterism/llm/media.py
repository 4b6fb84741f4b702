"""Payloads in progressive JPEG files, and their RGB tensors."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import progressive_jpeg as jpeg

GROUP = 192
#: Blocks of an MCU: four of luma, one of each chroma, each 64 coefficients.
MCU_BLOCKS = 6
#: MCUs in a row, unless there are so many that the rows would be more than a file's 16 bits can tell.
COLUMNS = 64
MOST_ROWS = 4095
#: A byte b is stored as the coefficient 256 + b: its magnitude has nine bits whatever b is, so a scan's codes are all alike.
OFFSET = 256
_ONES = np.ones(64, np.int64)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces up to a positive multiple of 192, and their number before."""
    data = (text or "").encode("utf-8", "replace")
    size = max(1, math.ceil(len(data) / GROUP)) * GROUP
    return data.ljust(size, b" "), len(data)


def _layout(n_bytes: int) -> tuple[int, int]:
    """Rows and columns of MCUs. The format ends at 4095 of each, 6.4 GB, beyond what a text of Spark can hold."""
    mcus = math.ceil(n_bytes / (64 * MCU_BLOCKS))
    cols = min(mcus, max(COLUMNS, math.ceil(mcus / MOST_ROWS)))
    return math.ceil(mcus / cols), cols


def store(data: bytes) -> bytes:
    """A progressive 4:2:0 file whose coefficients, MCU by MCU, are the bytes; the comment holds their number."""
    rows, cols = _layout(len(data))
    x = np.zeros(rows * cols * MCU_BLOCKS * 64, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    x = (x.astype(np.int32) + OFFSET).reshape(rows, cols, MCU_BLOCKS, 64)
    luma = x[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * rows, 2 * cols, 64)
    parts = [jpeg.Component(2, 2, _ONES, luma, (2 * rows, 2 * cols))]
    parts += [jpeg.Component(1, 1, _ONES, np.ascontiguousarray(x[:, :, k]), (rows, cols)) for k in (4, 5)]
    return jpeg.encode(jpeg.Image(16 * rows, 16 * cols, parts, b"%d" % len(data)))


def restore(image: jpeg.Image) -> bytes:
    """The bytes of a decoded file that ``store`` made."""
    luma, *chroma = (c.blocks for c in image.components)
    rows, cols = chroma[0].shape[:2]
    x = np.empty((rows, cols, MCU_BLOCKS, 64), np.int32)
    x[:, :, :4] = luma.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
    x[:, :, 4], x[:, :, 5] = chroma
    return (x.reshape(-1) - OFFSET).astype(np.uint8)[: int(image.comment)].tobytes()


def feature(tensor: np.ndarray) -> str:
    """Height, width, and mean and standard deviation of each colour."""
    flat = tensor.reshape(-1, 3)
    n, total = len(flat), flat.sum(axis=0, dtype=np.int64)
    squares = np.einsum("ij,ij->j", flat.astype(np.float32), flat, dtype=np.float64) / n
    mean = total / n
    deviation = np.sqrt(np.maximum(squares - mean * mean, 0))
    return f"{tensor.shape[0]}x{tensor.shape[1]};" + ",".join(f"{m:.2f}" for m in mean) + ";" + ",".join(f"{d:.2f}" for d in deviation)


def with_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each text stored losslessly as a progressive JPEG in ``media`` (binary); a null text as an empty one. An older ``media`` is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                media = pa.array([store(payload(t.as_py())[0]) for t in part.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, media], [*part.schema.names, "media"])

    docs = docs.drop("media")
    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("binary").alias("media")).schema)


def with_tensors(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with ``height``, ``width``, ``rgb`` (height x width x 3 bytes, row by row) and ``error``.

    Any progressive file with 8-bit samples is read. Null, cut or other files
    give null tensors and say why in ``error``; older columns of these names are
    replaced.
    """
    names = ("height", "width", "rgb", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(media_col)
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = []
                for m in part.column(at):
                    try:
                        if not m.is_valid:
                            raise ValueError("no media")
                        t = jpeg.rgb(jpeg.decode(m.as_py()))
                        rows.append((t.shape[0], t.shape[1], t.tobytes(), None))
                    except (ValueError, KeyError, IndexError, TypeError, OverflowError) as e:
                        rows.append((None, None, None, str(e) or type(e).__name__))
                made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else ([],) * 4, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])

    media = media.drop(*names)
    schema = media.select("*", F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("binary").alias("rgb"), F.lit(None).cast("string").alias("error")).schema
    return media.mapInArrow(run, schema)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, read back and describe each text in one pass; one row for every row."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(text: str | None) -> tuple:
        data, n = payload(text)
        media = store(data)
        image = jpeg.decode(media)
        back = restore(image)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(jpeg.rgb(image))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")[1:]]
        for batch in batches:
            if batch.num_rows:
                rows = zip(*(digest(t.as_py()) for t in batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def op3_media(spark, sf_dir: str) -> DataFrame:
    """Digests of the payload and the file of every document, and its image's feature."""
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
