"""Substring dedup: passages that repeat across documents, by MinHash banding over content-cut paragraphs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, materialise
from .components import connected_components
from .similar_sets import TILE, in_buckets, similar_links

#: A paragraph begins at each word whose hash is least among so many words to either side.
REACH = 5
SHINGLE = 5
#: MinHash values, each a band of its own: two paragraphs of similarity s collide with probability 1 - (1 - s) ** BANDS, 0.992 at 0.8.
BANDS = 3
SIMILARITY = 0.8
#: Paragraphs of fewer shingles can't differ and reach the similarity; they match only as a whole.
LEAST_SHINGLES = 4
#: Paragraphs in a row that repeat are taken out from so many words on.
LEAST_WORDS = 15
#: A shorter run is taken out if it and the words around that go on like its source are so many: 0.8 of a passage of 50.
LEAST_GROWN = 40
#: Words around a source's paragraph that a run of paragraphs is grown along.
CONTEXT = 64
#: Growing steps over up to so many words on either side that differ, if a whole shingle after them is equal.
GAP = 3
_STEPS = sorted(((a, b) for a in range(GAP + 1) for b in range(GAP + 1) if a or b), key=lambda s: (max(s), sum(s)))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX[k % 5] + np.uint64(k)
    x = (x ^ x >> np.uint64(29)) * _MIX[(k + 2) % 5]
    return x ^ x >> np.uint64(32)


def _undone(x: np.ndarray, k: int) -> np.ndarray:
    """The inverse of ``_mixed``."""
    back = lambda i: np.uint64(pow(int(_MIX[i % 5]), -1, 1 << 64))
    x = x ^ x >> np.uint64(32)
    x = x * back(k + 2)
    x = x ^ x >> np.uint64(29) ^ x >> np.uint64(58)
    x = (x - np.uint64(k)) * back(k)
    return x ^ x >> np.uint64(31) ^ x >> np.uint64(62)


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hash of each word: hashing a short one costs less than to look it up among those of a block."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


@dataclass
class Paragraphs:
    """Of several texts, end to end: first words and ends, text of each, hash of the whole, hash of the shingle that begins at each word, shingles of each, and hash of each word."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    whole: np.ndarray
    runs: np.ndarray
    shingles: np.ndarray
    words: np.ndarray

    def of_texts(self, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First words, ends and hashes of the paragraphs, and 32 bits of each word's hash, text by text (``sizes`` words each)."""
        numbers, at = self.words.astype(np.uint32).view(np.int32), 0
        for i, n in enumerate(sizes):
            a, b = np.searchsorted(self.text, (i, i + 1))
            yield self.starts[a:b] - at, self.ends[a:b] - at, self.whole[a:b].view(np.int64), numbers[at : at + n]
            at += n

    def number(self) -> np.ndarray:
        """Place of each paragraph in its text."""
        first = np.append(0, np.nonzero(np.diff(self.text))[0] + 1) if len(self.text) else np.zeros(0, np.int64)
        return np.arange(len(self.text)) - np.repeat(first, np.diff(np.append(first, len(self.text))))

    def sets(self) -> list[np.ndarray]:
        """Hashes of each paragraph's shingles; a short one is one shingle."""
        return [self.runs[a : a + n] if b - a >= SHINGLE else self.whole[i : i + 1] for i, (a, b, n) in enumerate(zip(self.starts.tolist(), self.ends.tolist(), self.shingles.tolist(), strict=True))]

    def least(self, band: int) -> np.ndarray:
        """The shingle of each paragraph (with LEAST_SHINGLES or more) whose hash is least in this band's order."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        values = _mixed(self.runs, 5 + band)
        place = np.arange(len(values)) - np.repeat(self.starts, self.ends - self.starts)
        values[place >= np.repeat(self.shingles, self.ends - self.starts)] = np.iinfo(np.uint64).max
        return _undone(np.minimum.reduceat(values, self.starts), 5 + band)


def cut(texts: list[list[bytes]], reach: int = REACH) -> Paragraphs:
    """Cut texts, given as words in lower case, into paragraphs.

    A paragraph begins at the first word and at each whose hash with the next
    word is least among ``reach`` words to either side. That depends on the
    words around alone, so a passage is cut alike wherever it stands.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    h = _hashes([w for t in texts for w in t])
    n, none = len(h), np.zeros(0, np.int64)
    if not n:
        return Paragraphs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, none.astype(np.uint64))
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    behind = sizes[doc] - 1 - place
    x = _mixed(h + np.uint64(3) * np.where(behind > 0, np.append(h[1:], np.uint64(0)), np.uint64(0)), 0)
    most = np.iinfo(np.uint64).max
    least, wide = np.ones(n, bool), np.concatenate([np.full(reach, most), x, np.full(reach, most)])
    for d in range(1, reach + 1):
        least &= (x < wide[reach - d : reach - d + n]) | (place < d)
        least &= (x <= wide[reach + d : reach + d + n]) | (behind < d)
    least |= place == 0
    starts = np.nonzero(least)[0]
    ends = np.append(starts[1:], n)
    rank = (np.arange(n) - np.repeat(starts, ends - starts)).astype(np.uint64)
    whole = _mixed(np.add.reduceat(h * _mixed(rank + np.uint64(1), 2), starts) + (ends - starts).astype(np.uint64), 3)
    wide, runs = np.concatenate([h, np.zeros(SHINGLE, np.uint64)]), np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        runs = runs * _MIX[0] + wide[k : k + n]
    return Paragraphs(starts, ends, doc[starts], whole, _mixed(runs, 4), np.maximum(1, ends - starts - SHINGLE + 1), h)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words with A to Z in lower case, as UTF-8."""
    text = text or b""
    return (text if isinstance(text, bytes) else text.encode("utf-8", "replace")).lower().split()


def _scan(docs: DataFrame, what: str, reach: int) -> DataFrame:
    """A row for each paragraph of ``docs`` (doc, text, row): ``doc, h``, and its row, number and words (``k``), least shingles (``m``, null for short ones) or shingles (``s``)."""
    schema = "doc long, h long" + {"k": ", row long, k int, n int", "m": "".join(f", m{b} long" for b in range(BANDS)), "s": ", s array<bigint>"}[what]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                found = cut([words_of(t) for t in part.column(1).cast(pa.binary()).to_pylist()], reach)
                columns = [part.column(0).take(pa.array(found.text)), pa.array(found.whole.view(np.int64))]
                if what == "k":
                    columns += [part.column(2).take(pa.array(found.text)), pa.array(found.number().astype(np.int32)), pa.array((found.ends - found.starts).astype(np.int32))]
                elif what == "m":
                    columns += [pa.array(found.least(b).view(np.int64), mask=found.shingles < LEAST_SHINGLES) for b in range(BANDS)]
                else:
                    keep = found.shingles >= LEAST_SHINGLES
                    sizes, starts = found.shingles[keep], found.starts[keep]
                    ends = np.cumsum(sizes)
                    flat = found.runs[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
                    columns = [c.filter(pa.array(keep)) for c in columns] + [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def distinct_paragraphs(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``h, first, last`` (least and greatest document) and MinHash values of every different paragraph of ``docs`` (doc, text)."""
    values = [F.first(f"m{b}").alias(f"m{b}") for b in range(BANDS)]
    return materialise(_scan(docs, "m", reach).groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), *values))


def near_paragraphs(docs: DataFrame, distinct: DataFrame, similarity: float = SIMILARITY, reach: int = REACH, tile: int = TILE) -> DataFrame:
    """``a, b``: links between hashes of different paragraphs that are similar enough.

    Equal paragraphs count once. Those with a least shingle in common meet in a
    bucket, whichever band it is from; all candidates are verified however
    large a bucket is (see ``similar_links``).
    """
    least = F.array_distinct(F.array(*(f"m{b}" for b in range(BANDS))))
    keyed = materialise(in_buckets(distinct.filter("m0 is not null").select("h", F.explode(least).alias("value"))))
    chosen = keyed.select("h").distinct()
    sets = _scan(docs, "s", reach).select("h", "s").join(chosen, "h", "left_semi").groupBy("h").agg(F.array_distinct(F.first("s")).alias("s"))
    links = similar_links(keyed, sets, similarity, tile, split=True)
    discard(keyed)
    return links


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, reach: int = REACH, tile: int = TILE) -> DataFrame:
    """``h, root, first``: paragraphs whose component (``root``) several documents have, with the least of these."""
    distinct = distinct_paragraphs(docs, reach)
    roots = materialise(connected_components(near_paragraphs(docs, distinct, similarity, reach, tile)).select(F.col("node").alias("h"), "root"))
    alone = distinct.select("h", "first", "last").join(roots, "h", "left_anti").filter("first != last").select("h", F.col("h").alias("root"), "first")
    linked = distinct.select("h", "first", "last").join(roots, "h")
    spans = linked.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first != last").select("root", "first")
    shared = materialise(alone.union(roots.join(spans, "root").select("h", "root", "first")))
    discard(distinct)
    discard(roots)
    return shared


def _contexts(reach: int):
    """The words before (nearest first) and after each asked paragraph of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [words_of(t) for t in part.column(0).cast(pa.binary()).to_pylist()]
                root, before, after = [], [], []
                for (starts, ends, whole, numbers), asked in zip(cut(texts, reach).of_texts([len(t) for t in texts]), part.column(1), strict=True):
                    for x in asked.as_py():
                        if x["k"] < len(whole) and whole[x["k"]] == x["h"]:
                            begin, end = starts[x["k"]], ends[x["k"]]
                            root.append(x["root"])
                            before.append(numbers[max(0, begin - CONTEXT) : begin][::-1])
                            after.append(numbers[end : end + CONTEXT])
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(before, kind), pa.array(after, kind)], ["root", "before", "after"])

    return run


def run_ends(texts: DataFrame, places: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc, row, k, n, before, after``: paragraphs at the ends of runs that repeat, with the words around their source.

    ``places`` (doc, row, h, root, first, k, n) are the shared paragraphs of all
    documents. The source is the first paragraph of the component in its least
    document; only CONTEXT words to either side travel, and only to the ends of
    runs, however long the source or the run is.
    """
    order = Window.partitionBy("doc", "row").orderBy("k")
    ends = places.filter("doc != first").withColumn("_l", F.coalesce(F.col("k") - F.lag("k").over(order) > 1, F.col("k") > 0)).withColumn("_r", F.coalesce(F.lead("k").over(order) - F.col("k") > 1, F.lit(True)))
    ends = materialise(ends.filter("_l or _r").select("doc", "row", "root", "k", "n", "_l", "_r"))
    asked = places.filter("doc = first").join(ends.select("root").distinct(), "root", "left_semi").groupBy("root", "doc").agg(F.min(F.struct("row", "k", "h")).alias("at"))
    asked = asked.groupBy("doc", "at.row").agg(F.collect_list(F.struct("root", "at.k", "at.h")).alias("asked"))
    around = texts.join(asked, ["doc", "row"]).select("text", "asked").mapInArrow(_contexts(reach), "root long, before array<int>, after array<int>")
    around = around.groupBy("root").agg(F.first("before").alias("before"), F.first("after").alias("after"))
    return ends.join(around, "root").select("doc", "row", "k", "n", F.when(F.col("_l"), F.col("before")).alias("before"), F.when(F.col("_r"), F.col("after")).alias("after"))


def _runs(marks: list[dict]) -> list[tuple[int, int, int]]:
    """First and last number of paragraphs (k, n words) that follow each other, and their words."""
    out: list[tuple[int, int, int]] = []
    for k, n in sorted({(m["k"], m["n"]) for m in marks}):
        if out and k == out[-1][1] + 1:
            out[-1] = (out[-1][0], k, out[-1][2] + n)
        else:
            out.append((k, k, n))
    return out


def grow(left: list[int], right: list[int], before: list[int], after: list[int], words: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """How many words to the left and right of ``words`` equal ones go on like the source's (all lists nearest first).

    Equal words first; then gaps of up to GAP words are crossed while the whole
    keeps the similarity, as the Jaccard index of its aligned shingles.
    """
    out = []
    for own, other in ((left, before), (right, after)):
        i = 0
        while i < min(len(own), len(other)) and own[i] == other[i]:
            i += 1
        out.append(i)
    a = b = words + sum(out)
    same = max(0, a - SHINGLE + 1)
    for side, (own, other) in enumerate(((left, before), (right, after))):
        i = j = out[side]
        a2, b2, same2 = a, b, same
        while True:
            for x, y in _STEPS:
                part = own[i + x : i + x + SHINGLE]
                if len(part) == SHINGLE and part == other[j + y : j + y + SHINGLE]:
                    break
            else:
                break
            i, j, n = i + x, j + y, 0
            while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                n += 1
            i, j, a2, b2, same2 = i + n, j + n, a2 + x + n, b2 + y + n, same2 + n - SHINGLE + 1
            if same2 >= similarity * (a2 + b2 - 2 * (SHINGLE - 1) - same2):
                out[side], a, b, same = i, a2, b2, same2
    return out[0], out[1]


def _regions(starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray, marks: list[dict], similarity: float, least_words: int) -> list[tuple[int, int]]:
    """First words and ends of what repeats: runs of paragraphs, each grown along its source; those that meet are one."""
    before = {m["k"]: m["before"] for m in marks if m["before"] is not None}
    after = {m["k"]: m["after"] for m in marks if m["after"] is not None}
    found: list[tuple[int, int, bool]] = []
    for first, last, n in _runs(marks):
        begin, end = int(starts[first]), int(ends[last])
        left, right = numbers[max(0, begin - 2 * CONTEXT) : begin][::-1].tolist(), numbers[end : end + 2 * CONTEXT].tolist()
        less, more = grow(left, right, before.get(first, []), after.get(last, []), end - begin, similarity)
        found.append((begin - less, end + more, n >= least_words))
    out: list[tuple[int, int, bool]] = []
    for begin, end, sure in sorted(found):
        if out and begin <= out[-1][1]:
            a, b, known = out.pop()
            begin, end, sure = a, max(b, end), sure or known
        out.append((begin, end, sure))
    return [(begin, end) for begin, end, sure in out if sure or end - begin >= LEAST_GROWN]


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first character of each word, and of the first behind it."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], (c != 32) & ((c < 9) | (c > 13)), [False]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    return edges[::2], edges[1::2]


def _taken(text: str, regions: list[tuple[int, int]]) -> tuple[str, list[dict]]:
    """A text without the words of ``regions``, and the spans of characters taken out."""
    first, behind = word_bounds(text)
    parts, at, gone = [], 0, []
    for a, b in regions:
        begin, end = int(first[a]), int(behind[b - 1])
        while end < len(text) and text[end] == " ":
            end += 1
        parts.append(text[at:begin])
        gone.append({"start": begin, "end": end, "words": b - a})
        at = end
    return "".join([*parts, text[at:]]), gone


def _without(similarity: float, least_words: int, reach: int):
    """Take what repeats out of the texts that have some; the others pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            text, marks = batch.column("_text"), batch.column("_ks")
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            changed, texts = np.zeros(batch.num_rows, bool), []
            marked = np.nonzero(marks.is_valid().to_numpy(zero_copy_only=False))[0].tolist()
            for at in range(0, len(marked), 64):
                block = marked[at : at + 64]
                words = [words_of(text[i].as_py()) for i in block]
                cuts = cut(words, reach).of_texts([len(w) for w in words])
                for i, (starts, ends, _, numbers) in zip(block, cuts, strict=True):
                    regions = _regions(starts, ends, numbers, marks[i].as_py(), similarity, least_words)
                    if regions:
                        new, spans[i] = _taken(text[i].as_py(), regions)
                        texts.append(new)
                        changed[i] = True
            kept = pc.replace_with_mask(text, pa.array(changed), pa.array(texts, text.type))
            own = [i for i, c in enumerate(batch.schema.names) if c not in ("_text", "_ks")]
            removed = pa.array([sum(g["words"] for g in gone) for gone in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), kept, removed, pa.array(spans, kind)], [*(batch.schema.names[i] for i in own), "kept_text", "removed_words", "removed"])

    return run


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, reach: int = REACH, tile: int = TILE) -> DataFrame:
    """``docs`` with ``kept_text``, ``removed_words``, ``removed`` (spans of characters) and ``first_doc`` (least id that holds a passage taken out here).

    Texts are cut into paragraphs at words chosen by content, so a passage is
    cut alike inside any text. Equal and similar paragraphs form components; a
    component that several documents have stays in the document of least id and
    repeats elsewhere. Repeated paragraphs in a row grow word by word along
    their source, across small gaps while the whole stays similar enough. They
    are taken out if they have ``least_words`` words, or LEAST_GROWN as grown.
    Repeats within one document stay. Null texts stay null; rows without id are
    told apart by their text. Rows of one id count as one document, so what they
    share stays in each of them, but each row's text is cut for itself. Equal
    paragraphs are told by 64-bit hashes. Older columns of these names are
    replaced.
    """
    new = ("kept_text", "removed_words", "removed", "first_doc", "_key", "_row", "_text", "_ks")
    own = [c for c in docs.columns if c not in new]
    content = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    late = F.shiftrightunsigned(content, 2).bitwiseOR(F.lit(1 << 62))
    named = docs.select(*own, F.coalesce(F.col(id_col).cast("long"), late).alias("_key"), content.alias("_row"))
    texts = named.select(F.col("_key").alias("doc"), F.col(text_col).alias("text"), F.col("_row").alias("row"))
    shared = repeated_paragraphs(texts, similarity, reach, tile)
    places = materialise(_scan(texts, "k", reach).join(shared, "h").dropDuplicates(["doc", "row", "k"]))
    none = F.lit(None).cast("array<int>")
    again = places.filter("doc != first").select("doc", "row", "first", "k", "n", none.alias("before"), none.alias("after"))
    again = again.union(run_ends(texts, places, reach).select("doc", "row", F.lit(None).cast("long").alias("first"), "k", "n", "before", "after"))
    marks = again.groupBy(F.col("doc").alias("_key"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("k", "n", "before", "after")).alias("_ks"), F.min("first").alias("_first"))
    joined = named.join(marks, ["_key", "_row"], "left").select(*own, F.col(text_col).alias("_text"), "_ks", "_first")
    plain = docs.select(*own, F.lit(None).cast("long").alias("_first"), F.lit(None).cast("string").alias("kept_text"), F.lit(None).cast("long").alias("removed_words"), F.lit(None).cast("array<struct<start:bigint,end:bigint,words:bigint>>").alias("removed"))
    done = joined.select(*own, "_first", "_text", "_ks").mapInArrow(_without(similarity, least_words, reach), plain.schema)
    return done.select(*own, "kept_text", "removed_words", "removed", F.when(F.col("removed_words") > 0, F.col("_first")).alias("first_doc"))


def op5_passages(spark, sf_dir: str) -> DataFrame:
    """What is left of every document, how much was taken out, and the first document that has it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_passages(docs).select("doc_id", F.col("kept_text").alias("text"), "removed_words", F.size("removed").cast("long").alias("n_passages"), "first_doc")
