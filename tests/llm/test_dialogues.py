"""op12: repaired conversations against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FIT = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
NAME = {"u": "user", "a": "assistant"}
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def cheapest(rows, faults):
    """(cost, audit, lines): least by cost, then audit, by a search in that order over (row, state)."""
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (at, state) in done:
            continue
        done.add((at, state))
        to = NEXT[state]
        heapq.heappush(heap, (cost + 3, audit + "I", at, to, [*lines, NAME[to] + ":"]))
        if at < len(rows):
            (role, text), fault = rows[at], faults[at]
            more = 3 if fault == 3 else 0
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            if fault in (0, 3):
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, to, [*lines, f"{NAME[to]}:{text}"]))
                if (state, role[:1]) in FIT:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], [*lines, f"{role}:{text}"]))


def expected(table):
    out = {}
    for conv, *_ in table:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            key = ":".join(" " if x is None else str(x) for x in (c, turn))
            kind = zlib.crc32(key.encode()) % 20
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:100].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            end = text.rstrip(" \t\n\v\f\r")
            faults.append(1 if not end else 2 if (role, text) in seen else 0 if end[-1] in ".!?" else 3)
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        said = [(r, t) for _, r, t in rows]
        cost, audit, lines = cheapest(said, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return sorted(out.values(), key=str)


def digest(df, **limits):
    from outletlens.llm.dialogues import repair_digest
    return sorted((tuple(r) for r in repair_digest(df, **limits).collect()), key=str)


def random_rows(seed, convs, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  ", " \n\t", "Yes. ", "é漢 ok.", "a.b!c?", None, "x" * 300 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "User"]
    return [(c, r.choice([i, i, i, i * 3, None]), r.choice(roles), r.choice(texts)) for c in convs for i in range(r.randint(1, most))]


@pytest.mark.parametrize("least_block", [64, 1])
def test_random_conversations(spark, least_block):
    rows = random_rows(3, [*range(60), None, -7], 14)
    rows += [(900, t, "user", "Yes.") for t in range(40)]                       # many copies of one row
    rows += [(901, 5, "user" if k % 3 else "assistant", f"Line {k % 50}.") for k in range(120)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    assert digest(df, least_block=least_block) == expected(rows)


def test_edges(spark):
    from pyspark.sql import functions as F
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert digest(empty) == []
    # all rows of these are dropped by the damage
    gone = [(c, t, "user", "Hi.") for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = [*gone, (5000, None, None, None), (5001, (1 << 63) - 1, "user", "a."), (5001, -(1 << 63), "assistant", "b.")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    for clash in ("conv", "block", "rank", "n", "code", "kind", "state", "fault"):
        df = df.withColumn(clash, F.lit("clash"))
    got = {r[0]: r for r in digest(df)}
    assert got[gone[0][0]] == (gone[0][0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want = {r[0]: r for r in expected(rows)}
    wide = want.pop(5001)                   # the gap passes 64 bits and counts as none
    assert got.pop(5001) == (wide[0], 0, *wide[2:])
    assert got == want


def test_repaired_rows(spark):
    from outletlens.llm.dialogues import damage, repair
    rows = random_rows(8, range(25), 30)
    df = spark.createDataFrame(rows, CONVERSATIONS)
    report, repaired = repair(damage(df), least_block=2)
    audits = {r.conv: r.audit for r in report.collect()}
    said = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv, r.block, r.seq)):
        said.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for conv, _, *_, audit, sha in expected(rows):
        if audit:
            assert audits[f"={conv}"] == audit
            assert hashlib.sha256("\n".join(said.get(f"={conv}", [])).encode()).hexdigest() == sha
