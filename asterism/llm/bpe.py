"""Byte-level BPE over fragments between forced boundaries."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the pattern of the byte-level pre-tokeniser.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters and numbers from here on depend on the Unicode version; texts with them are split by the library itself.
_SETTLED = regex.compile(r"[^\x00-՗]")
#: Words of one generation that each Python worker keeps with their ids; two generations are kept.
CACHE_WORDS = 150_000
#: Longest fragment whose pairs are looked through one by one.
SHORT = 40
NEVER = 1 << 29


def little_endian(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit integers."""
    return np.array(array("q", ids), copy=False).astype("<u4").tobytes()


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCoder:
    """Encodes and decodes as the vocabulary file's own library does, special tokens included.

    A pair of adjacent bytes that no vocabulary token contains can't end up
    inside one token, so a word is cut there and its fragments are merged apart.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special = {s.encode(): i for s, i in self.special.items()}
        vocab = {t: i for t, i in vocab.items() if t not in special}
        self.token = {i: t for t, i in (vocab | special).items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.merge, self.made = {}, []
        if max(vocab.values()) >> 16:
            raise ValueError("ids over 65535")
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (bytes(letters[c] for c in x) for x in (a, b))
            self.merge[vocab[a] << 16 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.inside = {pair for token in vocab for pair in zip(token, token[1:], strict=False)}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self.cache_words, self.words, self.older = path, cache_words, {}, {}
        self.table = [self.token.get(i) for i in range(max(self.token) + 1)]

    @property
    def library(self):
        if not hasattr(self, "_split"):
            self._split = Tokenizer.from_file(self.path).pre_tokenizer
        return self._split

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every forced boundary."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in inside]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def merged(self, fragment: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until none is left.

        Short fragments look through the ranks of their pairs; in longer ones
        pairs wait in a heap over a linked list, so any length takes n log n steps.
        """
        ids = [self.single[b] for b in fragment]
        return ids if len(ids) < 2 else self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, made, never = self.merge.get, self.made, NEVER
        pairs = [get(a << 16 | b, never) for a, b in zip(ids, ids[1:])]  # noqa: B905
        pairs.append(never)
        while (best := min(pairs)) != never:
            i = pairs.index(best)
            new = ids[i] = made[best]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 16 | new, never)
            if i + 1 < len(ids):
                pairs[i] = get(new << 16 | ids[i + 1], never)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 16 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            m, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            new = self.made[m]
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(new << 16 | ids[k])) is not None:
                    heappush(heap, (m, i, new, ids[k]))
            p = before[i]
            if p >= 0 and (m := get(ids[p] << 16 | new)) is not None:
                heappush(heap, (m, p, ids[p], new))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        out = self.older.get(word)
        if out is not None:
            self.words[word] = out
            return out
        out = []
        for fragment in self.fragments(word.encode("utf-8")):
            out += self.merged(fragment)
        if len(word) <= 64:
            if len(self.words) >= self.cache_words:
                self.older, self.words = self.words, {}
            self.words[word] = out
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        if _SETTLED.search(text):
            parts = [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        else:
            parts = PATTERN.findall(text)
        known = self.words.get
        for part in parts:
            ids = known(part)
            if ids is None:
                ids = self.word(part)
                known = self.words.get
            out += ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; None counts as empty."""
        out: list[int] = []
        if not text:
            return out
        parts = self.cut_special.split(text) if self.cut_special else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; ids outside the vocabulary stand for nothing."""
        try:
            return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        except (IndexError, TypeError):
            token = self.token
            return b"".join([token[i] for i in ids if i in token]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> BytePairCoder:
    """One coder for each vocabulary and Python worker."""
    return BytePairCoder(path)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with the column ``token_ids`` (array of int). A null text gives no ids.

    With ``check``, ``exact`` tells whether the ids decode to the text (null:
    the empty one); encoding and decoding then share one pass and one Python
    worker per task. Older columns of these names are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, exact = [], []
                for t in part.column(at):
                    text = t.as_py()
                    own = code.encode(text)
                    ids.append(pa.array(own, pa.int32()))
                    if check:
                        exact.append(code.decode(own) == (text or ""))
                sizes = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *[pa.array(exact)] * check], [*part.schema.names, "token_ids", *["exact"] * check])

    docs = docs.drop("token_ids", *["exact"] * check)
    new = [F.lit(None).cast("array<int>").alias("token_ids"), *[F.lit(None).cast("boolean").alias("exact")] * check]
    return docs.mapInArrow(run, docs.select("*", *new).schema)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with the column ``decoded``; null ids decode to the empty text. An older ``decoded`` is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            at = batch.schema.names.index(ids_col)
            texts = pa.array([code.decode(x.values.to_pylist() if x.is_valid else ()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("decoded")).schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            counts, coded, back = [], [], []
            for t in batch.column(1):
                ids = code.encode(t.as_py())
                counts.append(len(ids))
                coded.append(hashlib.sha256(little_endian(ids)).hexdigest())
                back.append(hashlib.sha256(code.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    """The public byte-level vocabulary; any other file of its kind may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Tokens, and digests of ids and decoded text, of every document."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
