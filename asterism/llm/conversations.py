"""Faults of conversations and their cheapest repair, by alignment to the strings of an alternating grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits; REROLE turns a role into user or assistant, CUT is added for a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Turns that are aligned at once; longer conversations go block by block.
BLOCK = 64
FULL = {"u": "user", "a": "assistant"}
#: States of the grammar ``(s?(ua)+)?``: nothing yet, after s, after u, after a; it may end in EMPTY and ANSWERED.
EMPTY, SYSTEM, ASKED, ANSWERED = range(4)
FAR = 1 << 60
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def _least(x: int) -> int:
    """The least cost of a net gain of x turns."""
    return INSERT * x if x > 0 else -DELETE * x


def align(turns: str, target: str, limit: int, behind: bool = True) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of the cheapest edits of ``turns`` that give ``target``; None if they cost over ``limit``.

    ``turns`` has a sign for each: its role's initial (x for others), a capital
    if it is truncated, D if it has to go. Wagner and Fischer's table, filled
    from its end, within Ukkonen's band: cells through which no path costs
    ``limit`` or less are left out. ``behind`` allows insertions after the last turn.
    """
    n, m = len(turns), len(target)
    band = [t for t in range(-n, m + 1) if _least(t) + _least(m - n - t) <= limit]
    if not band:
        return None
    low, high = band[0], band[-1]
    costs: list[dict[int, int]] = [{} for _ in range(n + 1)]

    def stay(i: int, j: int) -> int:
        c, want = turns[i], target[j]
        if c == "D":
            return FAR
        kept = CUT if c.isupper() else 0
        return kept if c.lower() == want else kept + REROLE if want != "s" else FAR

    for i in range(n, -1, -1):
        row, below = costs[i], costs[i + 1] if i < n else {}
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = 0 if i == n and j == m else FAR
            if i < n:
                best = min(best, below.get(j, FAR) + DELETE)
                if j < m and (down := below.get(j + 1, FAR)) < FAR:
                    best = min(best, down + stay(i, j))
            if j < m and target[j] != "s" and (i < n or behind):
                best = min(best, row.get(j + 1, FAR) + INSERT)
            row[j] = min(best, FAR)
    total = costs[0].get(0, FAR)
    if total >= FAR or total > limit:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):
        now = costs[i][j]
        if i < n and costs[i + 1].get(j, FAR) + DELETE == now:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or behind) and costs[i].get(j + 1, FAR) + INSERT == now:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def targets(state: int, m: int) -> list[tuple[str, int]]:
    """Strings of m roles that the grammar allows from a state on, and the states behind them."""
    if not m:
        return [("", state)]
    heads = {EMPTY: ("s", ""), SYSTEM: ("",), ASKED: ("a",), ANSWERED: ("",)}[state]
    out = []
    for head in heads:
        if len(head) <= m:
            text = head + "ua" * (m // 2 + 1)
            text = text[:m]
            out.append((text, {"s": SYSTEM, "u": ASKED, "a": ANSWERED}[text[-1]]))
    return out


@lru_cache(maxsize=1 << 16)
def repairs(turns: str, state: int, final: bool) -> dict[int, tuple[int, str]]:
    """By the state behind them, cost and audit of the cheapest edits of a block of turns; with ``final`` only the best that may end a conversation.

    Lengths go outwards from the number of turns that may stay; those that can't
    cost as little as what is known are left out, the others bound their band by it.
    """
    must = turns.count("D")
    free, best = len(turns) - must, {}
    least = lambda m: DELETE * must + _least(m - free)

    def attempt(m: int) -> None:
        for text, end in targets(state, m):
            if final and end not in (EMPTY, ANSWERED):
                continue
            key = ANSWERED if final else end
            limit = best[key][0] if key in best else least(m) + (DELETE + INSERT + CUT) * (len(turns) + 2)
            found = align(turns, text, limit, behind=final) if least(m) <= limit else None
            if found and (key not in best or found < best[key]):
                best[key] = found

    for m in range(free, -1, -1):
        attempt(m)
    m, open_ = free + 1, (ANSWERED,) if final else (ASKED, ANSWERED)
    while any(key not in best or least(m) <= best[key][0] for key in open_):
        attempt(m)
        m += 1
    return best


class Repair:
    """One conversation, turn by turn: its faults and the cheapest audit so far for each state of the grammar.

    Audits without insertions behind the last turn are no prefixes of each
    other, so of two paths to one state the cheaper, then the ASCII-less, stays
    so whatever follows, and their order is known by rank. Memory holds one block of turns, and for each of
    four states a hash and an audit of one letter per turn.
    """

    def __init__(self) -> None:
        self.paths: dict[int, tuple] = {EMPTY: (0, 0, None, hashlib.sha256(), True)}
        self.block: list[tuple[str, str, str]] = []
        self.low = self.high = self.turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += self.turn is None or turn != self.turn
            self.turn = self.high = turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        sign = initial if initial and initial in "sua" else "x"
        last = text.rstrip(BLANKS)[-1:]
        if not last:
            self.blank += 1
            sign = "D"
        elif seen:
            self.duplicate += 1
            sign = "D"
        elif last not in ".!?":
            self.truncated += 1
            sign = sign.upper()
        if len(self.block) == BLOCK:
            self._advance(final=False)
        self.block.append((role, text, sign))

    def _advance(self, final: bool) -> None:
        signs = "".join(b[2] for b in self.block)
        offers: dict[int, tuple] = {}
        for state, (cost, rank, *_) in self.paths.items():
            for end, (more, audit) in repairs(signs, state, final).items():
                offer = (cost + more, rank, audit, state)
                if end not in offers or offer < offers[end]:
                    offers[end] = offer
        order = {o: k for k, o in enumerate(sorted({(o[1], o[2]) for o in offers.values()}))}
        new = {}
        for end, (cost, rank, audit, state) in offers.items():
            _, _, parts, digest, first = self.paths[state]
            digest = digest.copy()
            for role, text in edited(self.block, audit, state):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            new[end] = (cost, order[rank, audit], (parts, audit), digest, first)
        self.paths, self.block = new, []

    def close(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        self._advance(final=True)
        ((cost, _, parts, digest, _),) = self.paths.values()
        pieces = []
        while parts:
            parts, piece = parts
            pieces.append(piece)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(pieces)), digest.hexdigest()


def edited(block: list[tuple[str, str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """Role and text of what an audit leaves of a block."""
    rows = iter(block)
    for edit in audit:
        want = "a" if state == ASKED else "u"
        role, text = ("", "") if edit == "I" else next(rows)[:2]
        if edit == "D":
            continue
        if edit in "IR":
            role = FULL[want]
        state = {"s": SYSTEM, "u": ASKED, "a": ANSWERED}[role[0]]
        yield role, text


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ORDER = ("turn", "role", "text", "copy")


def _prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, gone, with ``seen``: whether role and text stand earlier in the conversation.

    Whole conversations share a partition, so the window needs no further shuffle.
    """
    names = ("conv_id", "turn", "role", "text")
    copy = F.col("copy") if "copy" in rows.columns else F.lit(0)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select(*names, copy.cast("int").alias("copy"), gone.alias("gone"))
    text = F.when(~F.col("gone"), F.coalesce("text", F.lit(" ")))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), "copy", "gone")
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy("turn", "copy")
    return rows.repartition("conv_id").withColumn("seen", F.row_number().over(earlier) > 1)


def audit_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id`` and RESULT of each conversation (``rows``: conv_id, turn, role, text, and perhaps copy and gone; others are left out).

    Turns follow each other by turn (nulls first), role, text and copy. Null roles and
    texts count as one space, null ids as one id. Rows that are ``gone`` only name their
    conversation, which has zeros and an empty audit if no others are left.

    One shuffle by conversation; its turns are streamed in order, so however
    long it is a task holds one block of texts. The digest runs over all its
    texts in order, so one conversation is one task's work.
    """
    kind = rows.schema["conv_id"].dataType
    streams = _prepared(rows).sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", "role", "text", "seen", "gone")
    arrow = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        key, one, kind = None, None, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            ids, *columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(columns, arrow, strict=True))], ["conv_id", *names])

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() if i != 3 else c for i, c in enumerate(batch.columns)), strict=True):
                if one is None or row[0] != key:
                    if one is not None:
                        made.append((key, *one.close()))
                    key, one = row[0], Repair()
                if not row[5]:
                    one.add(row[1], row[2], row[3].as_py(), row[4])
            if len(made) >= 1000:
                yield batch_of(made)
                made = []
        if one is not None:
            made.append((key, *one.close()))
        if made:
            yield batch_of(made)

    return streams.mapInArrow(run, f"conv_id {kind.simpleString()}, {RESULT}")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, position, edit, turn, role, text``: what each conversation's audit leaves, numbered from 0; inserted turns have no ``turn``.

    The audits are dealt out edit by edit and meet the turns by their number, so
    a long conversation is joined by many tasks.
    """
    numbered = _prepared(rows).filter("not gone").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER)) - 1)
    edits = audits.select("conv_id", F.posexplode(F.split("audit", "")).alias("e", "edit")).filter("edit != ''")
    until = Window.partitionBy("conv_id").orderBy("e")
    count = lambda c: F.sum(c.cast("int")).over(until) - 1
    edits = edits.select("conv_id", "edit", count(F.col("edit") != "I").alias("k"), count(F.col("edit") != "D").alias("position")).filter("edit != 'D'")
    edits = edits.withColumn("k", F.when(F.col("edit") != "I", F.col("k")))
    total = audits.select("conv_id", F.length(F.regexp_replace("audit", "D", "")).alias("m"))
    held = edits.alias("e").join(numbered.select("conv_id", "k", "turn", "role", "text").alias("r"), (F.col("e.conv_id").eqNullSafe(F.col("r.conv_id"))) & (F.col("e.k") == F.col("r.k")), "left")
    held = held.select("e.conv_id", "position", "edit", "turn", "role", "text").alias("e").join(total.alias("t"), F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")))
    # an odd number of turns starts with a system turn
    made = F.when((F.col("position") - F.col("m")) % 2 == 0, "user").otherwise("assistant")
    return held.select("e.conv_id", "position", "edit", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(made).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults planted by a checksum of id and turn; dropped rows stay as ``gone``, repeated ones are told apart by ``copy``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    found = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies: Column = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return found.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), F.explode(copies).alias("copy"))


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    return audit_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
