"""SimHash near-duplicates: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .components import connected_components

SHINGLE = 3
BITS = 64
BANDS = 4
BAND_BITS = BITS // BANDS
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    total, counts = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64)
    for i in range(0, total, _STEP):
        n = min(_STEP, total - i)
        if len(words) < shingle:
            parts = [b" ".join(words)]
        else:
            parts = map(b" ".join, zip(*(words[i + k : i + k + n] for k in range(shingle)), strict=True))
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.dtype("<u8"), n)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc, fp`` (signed long) for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc long, fp long")


def near_pairs(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs within ``radius`` bits: of ``a`` with ``b``, or within ``a``.

    Prints are 64 bits, or rows of up to three times 64. Both are sorted by
    population count and cut into blocks; a pair of blocks whose counts lie
    further apart than the radius can hold no pair.
    """
    same = b is None
    b = a if same else b
    a, b = a.reshape(len(a), -1), b.reshape(len(b), -1)
    pa_, pb = (np.bitwise_count(x).sum(axis=1, dtype=int) for x in (a, b))
    ia, ib = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    (first, *more), pa_, pb = list(zip(np.ascontiguousarray(a[ia].T), np.ascontiguousarray(b[ib].T), strict=True)), pa_[ia], pb[ib]
    left, right = [], []
    for i in range(0, len(a), block):
        low, high = pa_[i], pa_[min(i + block, len(a)) - 1]
        for j in range(i if same else 0, len(b), block):
            if pb[j] > high + radius:
                break
            if pb[min(j + block, len(b)) - 1] < low - radius:
                continue
            apart = np.bitwise_count(first[0][i : i + block, None] ^ first[1][None, j : j + block])
            for x, y in more:
                apart += np.bitwise_count(x[i : i + block, None] ^ y[None, j : j + block])
            u, v = np.nonzero(apart <= radius)
            if same and i == j:
                u, v = u[u < v], v[u < v]
            left.append(ia[u + i])
            right.append(ib[v + j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` nodes reaches."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _compare(radius: int):
    """Compare the tiles of each row; emit a spanning star of each component found, never all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                a = left.values.to_numpy().view(np.uint64)
                b = right.values.to_numpy().view(np.uint64) if right.is_valid else None
                u, v = near_pairs(a, b, radius)
                if len(u):
                    nodes = a if b is None else np.concatenate([a, b])
                    label = _forest(len(nodes), u, v if b is None else v + len(a))
                    moved = np.nonzero(label != np.arange(len(nodes)))[0]
                    out_a.append(nodes[moved])
                    out_b.append(nodes[label[moved]])
            none = np.zeros(0, np.uint64)
            x, y = (np.concatenate(o) if o else none for o in (out_a, out_b))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = 3, tile_rows: int = 2048) -> DataFrame:
    """Links ``a, b`` that join all fingerprints within ``radius`` bits (column ``fp``, distinct).

    Two fingerprints that differ in at most ``radius`` < BANDS bits agree in one
    of BANDS bands, so only tiles of the same band value are compared; that is
    exact. A band value with over ``tile_rows`` fingerprints is cut into tiles
    by population count and hash. Its tile pairs, less those whose population
    counts lie too far apart, are spread over the tasks.
    """
    if not 0 <= radius < BANDS:
        raise ValueError(f"radius must be from 0 to {BANDS - 1}")
    bands = F.array(*(F.struct(F.lit(q).alias("q"), F.shiftrightunsigned("fp", BAND_BITS * q).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).alias("v")) for q in range(BANDS)))
    rows = prints.select("fp", F.explode(bands).alias("k")).select("fp", "k.q", "k.v", F.bit_count("fp").alias("pc"))
    cells = rows.groupBy("q", "v", "pc").agg(F.count("*").alias("n"))
    large = cells.groupBy("q", "v").agg(F.sum("n").alias("n")).filter(F.col("n") > tile_rows).select("q", "v")
    cells = materialise(cells.join(large, ["q", "v"]).select("q", "v", "pc", F.ceil(F.col("n") / tile_rows).cast("int").alias("m")))
    rows = rows.join(cells, ["q", "v", "pc"], "left")
    tiles = rows.groupBy("q", "v", F.when(F.col("m").isNull(), -1).otherwise(F.col("pc")).alias("pc"), F.coalesce(F.pmod(F.xxhash64("fp"), F.col("m")), F.lit(0)).cast("int").alias("h")).agg(F.collect_list("fp").alias("fps"))
    one = tiles.filter((F.col("pc") >= 0) | (F.size("fps") > 1)).select("fps", F.lit(None).cast("array<bigint>").alias("other"))
    reach = cells.select("q", "v", "pc", F.explode(F.sequence(F.col("pc"), F.col("pc") + radius)).alias("pc2"))
    reach = reach.join(cells.select("q", "v", F.col("pc").alias("pc2"), F.col("m").alias("m2")), ["q", "v", "pc2"])
    cut = tiles.filter("pc >= 0")
    left = cut.join(reach, ["q", "v", "pc"]).withColumn("h2", F.explode(F.sequence(F.lit(0), F.col("m2") - 1))).filter("pc2 > pc or h2 > h")
    right = cut.select("q", "v", F.col("pc").alias("pc2"), F.col("h").alias("h2"), F.col("fps").alias("other"))
    two = left.join(right, ["q", "v", "pc2", "h2"]).select("fps", "other")
    pairs = one if cells.isEmpty() else one.union(two)
    return pairs.mapInArrow(_compare(radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = SHINGLE, tile_rows: int = 2048) -> DataFrame:
    """``doc, fp, component`` for every row of ``docs``: component is the least id reachable over links.

    Equal fingerprints are grouped first, so a group of copies costs one
    fingerprint however large it is. Null texts count as empty; texts without
    words have fingerprint zero and link like any other; repeated rows stay;
    a component without any id gets null. Other columns are not read.
    """
    prints = materialise(with_fingerprint(docs, id_col, text_col, shingle))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc").alias("least")))
    roots = connected_components(near_links(distinct, radius, tile_rows))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.filter("root != fp").groupBy("root").agg(F.min("least").alias("far"))
    named = named.join(least, "root", "left").select("fp", "root", "least", "far")
    own = named.filter("root = fp").select(F.col("fp").alias("root"), F.least("least", "far").alias("component"))
    by_print = named.select("fp", "root").join(own, "root").select("fp", "component")
    return prints.join(by_print, "fp").select("doc", "fp", "component")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document of the table."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
