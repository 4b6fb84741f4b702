import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from asterism.llm import conversations as C
from asterism.llm.conversations import audit_conversations, damaged, op11_conversations, repaired_turns

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """(cost, audit, repaired) by searching all edits in order of cost, then audit; turns: (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(turns) and GRAMMAR.fullmatch(roles):
            return cost, audit, out
        if (i, roles[-1:], audit.endswith("II")) in done:
            continue
        done.add((i, roles[-1:], audit.endswith("II")))
        able = lambda r: any(GRAMMAR.fullmatch(r + rest) for rest in ("", "a", "ua"))
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                if able(roles + role[0]):
                    heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], (*out, (role, ""))))
        if i < len(turns):
            role, text, must, cut = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            if not must:
                if able(roles + (role[:1] or "?")):
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, roles + role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if able(roles + new[0]):
                        heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, roles + new[0], (*out, (new, text))))
    raise AssertionError


def plain(rows):
    """One conversation's result from its undamaged rows."""
    held = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        held += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns, counts = set(), [], [0, 0, 0]
    for _, role, text in held:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults = [not words, (role, text) in seen, bool(words) and words[-1] not in ".!?"]
        seen.add((role, text))
        first = faults.index(True) if True in faults else 3
        if first < 3:
            counts[first] += 1
        turns.append((role, text, first < 2, first == 2))
    known = [t for t, *_ in held if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
    cost, audit, out = cheapest(turns)
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(), out


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(tuple(r))
    return {k: plain(v) for k, v in by.items()}


def test_query_equals_search_over_all_edits(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = op11_conversations(spark, sf_dir).collect()
    want = expected(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == {k: v[:-1] for k, v in want.items()}
    assert sum(r["cost"] > 0 for r in got) > len(got) / 4


@pytest.mark.parametrize("seed", range(12))
def test_alignment_equals_search(seed, monkeypatch):
    """Whole conversations, and the same in blocks of two turns."""
    rng = random.Random(seed)
    for size in (2, 3, 64):
        monkeypatch.setattr(C, "BLOCK", size)
        for _ in range(40):
            one, turns, counted = C.Repair(), [], set()
            for k in range(rng.randint(0, 8)):
                role = rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"])
                text = rng.choice(["", " \n", "Yes.", "No", f"{k}!", f"{k}"])
                seen = (role, text) in counted
                counted.add((role, text))
                one.add(k, role, text, seen)
                words = text.strip()
                must = not words or seen
                turns.append((role, text, must, not must and words[-1] not in ".!?"))
            cost, audit, out = cheapest(turns)
            found = one.close()
            assert found[5:7] == (cost, audit)
            assert found[7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_band_keeps_ties():
    assert C.align("uu", "ua", 1) == (1, "KR") and C.align("uu", "ua", 0) is None
    assert C.align("u", "ua", 5) == (5, "KI")
    assert C.repairs("u", C.EMPTY, True) == {C.ANSWERED: (2, "D")}
    assert C.repairs("su", C.EMPTY, True) == {C.ANSWERED: (2, "RR")}  # less than deleting both


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, "user", "a."), (1, None, "user", "a."), (1, 3, None, None), (1, 9, "assistant", "b."), (1, 9, "assistant", "b."), (1, 9, "user", "c"), (None, 0, "user", "q."), (None, 1, "assistant", "r."), (2, None, "", "x."), (3, 5, "system", "S " * 100_000 + "."), (4, -(1 << 63), "u", "x."), (4, (1 << 63) - 1, "a", "x.")]
    table = spark.createDataFrame(rows, schema)
    got = {r[0]: tuple(r)[1:] for r in audit_conversations(damaged(table.selectExpr("*", "1 AS copy_of", "2 AS seen", "3 AS h"))).collect()}
    want = expected(rows)
    want[4] = ((1 << 63) - 1, *want[4][1:]) if want[4][0] > (1 << 63) - 1 else want[4]
    assert got == {k: v[:-1] for k, v in want.items()}
    assert audit_conversations(damaged(table.limit(0))).count() == 0


def test_conversation_without_rows_after_damage(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert tuple(audit_conversations(damaged(table)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_is_streamed(spark):
    """Far more turns than a block, with faults throughout; ids are text."""
    rng = random.Random(5)
    turns = [(rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[k % 2], "x." if rng.random() < 0.05 else f"{k}" + "." * (rng.random() < 0.9)) for k in range(3000)]
    table = spark.createDataFrame([("c", k, *t) for k, t in enumerate(turns)], "conv_id string, turn long, role string, text string")
    got = audit_conversations(table).first()
    seen, plain_turns = set(), []
    for t in turns:
        must = t in seen
        seen.add(t)
        plain_turns.append((*t, must, not must and not t[1].endswith(".")))
    cost, audit, out = cheapest(plain_turns)
    assert (got["cost"], got["audit"]) == (cost, audit)
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_repaired_turns_are_what_the_audit_leaves(spark, sf_dir):
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    audits = audit_conversations(rows)
    found = defaultdict(list)
    for r in repaired_turns(rows, audits).collect():
        found[r["conv_id"]].append((r["position"], r["role"], r["text"], r["edit"]))
    for a in audits.collect():
        turns = sorted(found[a["conv_id"]])
        assert [t[0] for t in turns] == list(range(len(turns)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t, _ in turns).encode()).hexdigest() == a["repaired_sha256"]
        assert "".join(t[3] for t in turns) == a["audit"].replace("D", "")
        assert GRAMMAR.fullmatch("".join(t[1][0] for t in turns))
