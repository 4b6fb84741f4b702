"""Near-duplicate texts of five-word shingles: SimHash prints that agree in a band of bits are compared in tiles, exact Jaccard within what they join, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialise
from .components import connected_components
from .passages import _hashes, _mixed, words_of
from .simhash import _forest, near_pairs
from .similar_sets import TILE, in_buckets, similar_links

SHINGLE = 5
SIMILARITY = 0.8
#: Words of 64 bits in a print; at most three, as counts of differing bits are bytes.
LANES = 3
BITS = 64 * LANES
#: Independent votes of a shingle on each bit: prints of a few shingles then seldom tie, and differ as the angle says.
VOTES = 3
_FIELDS = [f"f{k}" for k in range(LANES)]
#: A bucket of prints that agree in a band holds so many on average, however many there are in all.
BUCKET = 1024
#: Share of the pairs at the similarity that may agree in no band.
MISSED = 1e-5
#: Standard deviations by which pairs at the similarity may differ in more bits than expected.
DEVIATIONS = 5
_STEP = 255
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, (2, LANES, VOTES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.uint64(0x0101010101010101)


def agreement(similarity: float) -> float:
    """How likely prints of two sets of this Jaccard index agree in a bit: one less the share of the angle between the sets in a half turn."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_at(similarity: float) -> int:
    """Bits in which prints of texts at the similarity may differ."""
    q = 1 - agreement(similarity)
    return math.ceil(BITS * q + DEVIATIONS * math.sqrt(BITS * q * (1 - q)))


def bands_for(n: int, similarity: float, bucket: int = BUCKET) -> np.ndarray:
    """The bits of each band, bands by bits, for ``n`` prints.

    Bands are as wide as buckets of ``bucket`` prints ask for, and as many as
    leave MISSED of the pairs at the similarity without a band; few prints are
    one bucket, a band without bits.
    """
    bits = min(32, max(0, math.ceil(math.log2(max(1, n) / bucket))))
    met = agreement(similarity) ** bits
    bands = 1 if met >= 1 else math.ceil(math.log(MISSED) / math.log(1 - met))
    rng = np.random.default_rng(7)
    places = np.concatenate([rng.permutation(BITS) for _ in range(bands * bits // BITS + 1)])
    return places[: bands * bits].reshape(bands, bits)


def shingles(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, end to end, and where each text's begin; fewer words than a shingle are one, no words are one as well."""
    texts = [t or [b""] for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    h = _hashes([w for t in texts for w in t])
    counts = np.maximum(1, sizes - SHINGLE + 1)
    begins, starts = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    at = np.repeat(begins - starts, counts) + np.arange(counts.sum())
    left = np.repeat(sizes + begins, counts) - at
    out, wide = np.zeros(len(at), np.uint64), np.append(h, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(k < left, wide[at + k], np.uint64(0))
    return _mixed(out, 1), starts


def prints(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each text."""
    sizes = np.diff(np.append(starts, len(runs)))
    steps = -(-sizes // _STEP)
    first = np.cumsum(steps) - steps
    at = np.repeat(starts, steps) + _STEP * (np.arange(steps.sum()) - np.repeat(first, steps))
    counts = np.zeros((len(starts), 8, 8), np.int64)
    for k in range(8):  # bit k of all eight bytes at once; no byte counts beyond _STEP
        part = np.add.reduceat(runs >> np.uint64(k) & _BYTES, at)
        counts[:, :, k] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return np.packbits(2 * counts.reshape(-1, 64) > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def wide_prints(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of BITS bits of each text's set of hashes, texts by LANES; each hash has VOTES votes on a bit."""
    votes = lambda k: np.stack([_mixed(runs * _FACTORS[0, k, v] + _FACTORS[1, k, v], v) for v in range(VOTES)], axis=1).reshape(-1)
    return np.stack([prints(votes(k), VOTES * starts) for k in range(LANES)], axis=1)


def shingle_sets(runs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text in order, end to end, and where each text's begin."""
    runs, ends = runs.copy(), np.append(starts[1:], len(runs))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        runs[a:b].sort()
    new = np.append(True, runs[1:] != runs[:-1])
    new[starts] = True
    sizes = np.add.reduceat(new, starts, dtype=np.int64)
    return runs[new], np.cumsum(sizes) - sizes


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, content, text): id, content, hash of the words in order, and print of the set of shingles."""
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            runs, starts = shingles([words_of(t.as_py()) for t in part.column(2)])
            sizes = np.diff(np.append(starts, len(runs)))
            place = (np.arange(len(runs)) - np.repeat(starts, sizes)).astype(np.uint64)
            whole = _mixed(np.add.reduceat(runs * _mixed(place + np.uint64(1), 2), starts) + sizes.astype(np.uint64), 3)
            found = wide_prints(*shingle_sets(runs, starts)).view(np.int64)
            columns = [part.column(0), part.column(1), pa.array(whole.view(np.int64)), *(pa.array(found[:, k]) for k in range(LANES))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "content", "h", *_FIELDS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (h, fp, text): h, fp and the different shingles."""
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            found, starts = shingle_sets(*shingles([words_of(t.as_py()) for t in part.column(2)]))
            sets = pa.ListArray.from_arrays(pa.array(np.append(starts, len(found)), pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], ["h", "fp", "s"])


def _banded(places: np.ndarray, whole: bool):
    """The value of each band of each print, with h and the print if ``whole``."""
    bands, bits = places.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                found = np.stack([part.column(k).to_numpy() for k in range(1, LANES + 1)], axis=1)
                own = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, places.reshape(-1)].reshape(len(found), bands, bits)
                wide = np.zeros((len(found), bands, 8), np.uint8)
                wide[:, :, : -(-bits // 8)] = np.packbits(own, axis=2, bitorder="little")
                values = wide.view("<i8")[:, :, 0] + (np.arange(bands, dtype=np.int64) << 32)
                columns = [pa.array(values.reshape(-1))]
                if whole:
                    again = pa.array(np.repeat(np.arange(len(found)), bands))
                    columns += [part.column(k).take(again) for k in range(LANES + 1)]
                yield pa.RecordBatch.from_arrays(columns, ["value", "h", *_FIELDS][: len(columns)])

    return run


def _meet(radius: int):
    """Compare the prints of one or two tiles by exclusive or and bit counts; emit a spanning star of each component found, never all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                (h, *a), (g, *b) = ([x.values.field(k).to_numpy() for k in range(LANES + 1)] if x.is_valid else [np.zeros(0, np.int64)] for x in (left, right))
                u, v = near_pairs(np.stack(a, axis=1).view(np.uint64), np.stack(b, axis=1).view(np.uint64) if b else None, radius)
                if len(u):
                    nodes = np.concatenate([h, g])
                    label = _forest(len(nodes), u, v + len(h) if b else v)
                    moved = np.nonzero(label != np.arange(len(nodes)))[0]
                    out_a.append(nodes[moved])
                    out_b.append(nodes[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def near_prints(found: DataFrame, similarity: float = SIMILARITY, radius: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that join all ``found`` (h, and a print in f0, f1, ...) that agree in a band and differ in ``radius`` bits at most.

    Buckets of over twice ``bucket`` prints are dealt into tiles by hash; pairs
    of tiles are spread over the tasks.
    """
    radius = radius_at(similarity) if radius is None else radius
    found = found.select("h", *_FIELDS)
    places, tile = bands_for(found.count(), similarity, bucket), 2 * bucket
    large = found.mapInArrow(_banded(places, False), "value long").groupBy("value").agg(F.count("*").alias("c")).filter(F.col("c") > tile)
    large = materialise(large.select("value", F.ceil(F.col("c") / tile).cast("int").alias("m")))
    rows = found.mapInArrow(_banded(places, True), "value long, h long" + "".join(f", {f} long" for f in _FIELDS))
    whole = F.collect_list(F.struct("h", *_FIELDS)).alias("rows")
    small = rows.join(large, "value", "left_anti").groupBy("value").agg(whole)
    none = F.lit(None).cast(small.schema["rows"].dataType).alias("other")
    pairs, used = small.filter(F.size("rows") > 1).select("rows", none), [large]
    if not large.isEmpty():
        dealt = rows.join(large, "value").withColumn("t", F.pmod(F.xxhash64("h"), F.col("m")).cast("int"))
        parts = materialise(dealt.groupBy("value", "m", "t").agg(whole))
        used.append(parts)
        left = parts.filter("t < m - 1").withColumn("t2", F.explode(F.sequence(F.col("t") + 1, F.col("m") - 1))).select("value", "t2", "rows")
        right = parts.select("value", F.col("t").alias("t2"), F.col("rows").alias("other"))
        pairs = pairs.union(parts.select("rows", none)).union(left.join(right, ["value", "t2"]).select("rows", "other"))
    links = materialise(pairs.mapInArrow(_meet(radius), "a long, b long").distinct())
    for t in used:
        discard(t)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int | None = None, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the least id.

    Texts are compared as sets of five-word shingles (A to Z in lower case).
    Different texts whose SimHash prints agree in a band of bits meet in a
    bucket of ``bucket`` on average; there all prints are compared in tiles, and
    those within ``radius`` bits (``radius_at``, if not given) are candidates.
    Inside the components that these form, pairs within the radius are linked
    if their Jaccard index is ``similarity`` or more, so each set travels once.
    Copies count once, however many there are. Rows are told apart by id and
    text: of rows that share an id but not the text, each is judged for itself.
    Of equal rows one stays; rows without id come last, in the order of a hash
    of their text. Null texts count as empty, and texts without words are
    copies of each other. Other columns are kept as they are.
    """
    content = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), content.alias("content"), F.col(text_col).alias("text"))
    radius = radius_at(similarity) if radius is None else radius
    base = materialise(rows.mapInArrow(_sketches, "id long, content long, h long" + "".join(f", {f} long" for f in _FIELDS)))
    first = F.min(F.struct(F.col("id").isNull().alias("late"), F.coalesce("id", F.lit(0)).alias("id"), "content"))
    distinct = materialise(base.groupBy("h").agg(first.alias("first"), F.min("content").alias("content"), *(F.first(f).alias(f) for f in _FIELDS)))
    met = near_prints(distinct, similarity, radius, bucket)
    keyed = materialise(in_buckets(connected_components(met).select(F.col("node").alias("h"), F.col("root").alias("value"))))
    chosen = distinct.select("h", F.array(*_FIELDS).alias("fp"), "content").join(keyed.select("h"), "h", "left_semi")
    texts = rows.groupBy("content").agg(F.first("text").alias("text"))
    sets = texts.join(chosen, "content").select("h", "fp", "text").mapInArrow(_sets, "h long, fp array<long>, s array<long>")
    links = similar_links(keyed, sets, similarity, tile, radius)
    roots = connected_components(links).withColumnRenamed("node", "h")
    kept = distinct.select("h", "first").join(roots, "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("first").alias("first"))
    kept = materialise(kept.select(F.col("first.late").alias("_late"), F.col("first.id").alias("_id"), F.col("first.content").alias("_content")))
    for t in (base, distinct, met, keyed, links):
        discard(t)
    key = ["_late", "_id", "_content"]
    named = docs.withColumns({"_late": F.col(id_col).isNull(), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_content": content})
    return named.dropDuplicates(key).join(kept, key, "left_semi").select(*docs.columns)
