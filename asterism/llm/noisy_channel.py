"""Restores disguised words: Viterbi decoding of character lattices under a character language model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of characters: 0 ends a word, 1 to 26 are a to z, 27 is any other letter.
CLASSES = 28
OTHER = 27
#: Letters that digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "§": "s"}
#: Log costs of the channel: a sign for a letter, a letter written again, a sign put in between, a digit put in between.
SWAP, AGAIN, BETWEEN, DIGIT = -1.0, -0.5, -0.7, -4.0
#: Three or more single characters, each apart from the next by white space.
SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_OWN = re.compile(r"[^\W\d_]")

_table = np.full(128, 0, np.uint8)
_table[97:123] = _table[65:91] = np.arange(1, 27)


def classes(text: str) -> np.ndarray:
    """The class of every character. Beyond ASCII, all but blanks and signs count as letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(codes < 128, _table[np.minimum(codes, 127)], np.where(codes < 192, 0, OTHER)).astype(np.int64)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a class after the two before it, from all texts; CLASSES cubed counts reach the driver, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    x = classes("  " + text.as_py() + " ")
                    total += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
        where = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(total[where])], ["at", "n"])

    counts = np.zeros(CLASSES**3)
    for row in docs.select(text_col).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]
    counts = counts.reshape(CLASSES, CLASSES, CLASSES) + 0.5
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def _choices(chars: str, i: int) -> list[tuple[str, float]]:
    """What a character may stand for ('' for nothing), with the channel's log cost."""
    c = chars[i]
    if c.isalpha():
        own = [(c, 0.0)]
        if i and chars[i - 1] == c:
            own.append(("", AGAIN))
        return own
    found = [(x, SWAP) for x in LEET.get(c, "")]
    if i and chars[i - 1] == c and found:
        found.append(("", AGAIN))
    return [*found, ("", DIGIT if c.isdigit() else BETWEEN)]


def decode(chars: str, model: list) -> str:
    """The likeliest word behind ``chars`` (lower case), of letters alone. The lattice has the last two classes as state."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i in range(len(chars)):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for letter, cost in _choices(chars, i):
            k = ord(letter) - 96 if "a" <= letter <= "z" else OTHER
            for (a, b), (score, path) in states.items():
                if letter:
                    state, new, step = (b, k), score + cost + model[a][b][k], (letter, path)
                else:
                    state, new, step = (a, b), score + cost, path
                if state not in after or new > after[state][0]:
                    after[state] = (new, step)
        states = after
    _, path = max(((score + model[a][b][0], path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def suspicious(core: str) -> bool:
    """Whether a token may be a disguise: a letter twice running, two letters with anything else, or one beside a sign of LEET."""
    if len(core) < 3:
        return False
    if core.isalpha():
        return any(a == b for a, b in zip(core, core[1:], strict=False))
    n = len(_OWN.findall(core))
    return n >= 2 or (n == 1 and any((a in LEET and b.isalpha()) or (a.isalpha() and b in LEET) for a, b in zip(core, core[1:], strict=False)))


def words_of(token: str, model: list) -> tuple[str, ...]:
    """The plain words of a token (lower case, no blanks): itself without signs at its ends, and what it may be in disguise."""
    core = token.strip(_EDGE)
    plain = (core,) if core.isalpha() else tuple(w for w in re.split(r"[\W\d_]+", core) if w)
    found = [*plain]
    for form in dict.fromkeys((core, token.rstrip(".,;:?!%&*#\"')"))):
        if suspicious(form) and (word := decode(form, model)) and word not in found:
            found.append(word)
    return tuple(found)


def spaced_words(text: str, model: list) -> list[str]:
    """Words of ``text`` (lower case) that are spelt out with blanks between the letters."""
    return [w for m in SPACED.finditer(text) if len(_OWN.findall(c := "".join(m[0].split()))) >= 3 and (w := decode(c, model))]
