"""Repair of conversation structure: the cheapest edits that make roles read ``(s?(ua)+)?``.

A conversation is its rows by turn (nulls first; equal turns by role, then text up to its first
100 characters, then md5). A row's first fault counts: blank (no character but white space),
duplicate (its role and text stand earlier), truncated (its last such character is not ``.!?``).
Per row the edits are Keep (0), Rerole to the role that fits (3) and Delete (4, the only one for
blank and duplicate rows); an empty user or assistant row may be Inserted anywhere (3); a truncated
row that stays adds 3. Of all cheapest edits those are taken whose initials are ASCII-least.

The states are what a legal start may end with: nothing, s, u, a. The least cost of the rest from
each state is a vector of four. A conversation of n rows is cut into blocks of about sqrt(n) rows
(64 at least), and vectors are stored only at the blocks' ends (checkpoints):

1. each block gives the min-plus matrix from its end's vector to its start's;
2. a conversation's matrices, about sqrt(n), are run through from the last to the first;
3. each block recomputes its vectors from its checkpoint and walks forward along tight edits, from
   each state that it may be entered in, giving the edits and the state it is left in;
4. a conversation's blocks are chained from the first one, which picks the walk of each.

So a task holds sqrt(n) vectors, and one conversation with any share of the rows is spread over many
tasks (blocks, and the ranges that number the rows); only a digest over a conversation's text, which
cannot be split, streams through one task, row by row. Its edits are a value of its report row.

Null role or text is one space. A null conversation id is a conversation of its own; repeated rows are
duplicates; very long texts travel as they are; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.functions.ranking import with_global_rank
from outletlens.llm.common import lean, scratch, ship

LEAST_BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Role that an inserted or reroled row takes, by the state before it.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Whether a row with a role of this initial (0: any other) may follow a state as it is.
FITS = ((), (NOTHING,), (NOTHING, SYSTEM, ASSISTANT), (USER,))
#: Cost of the empty rest: what is missing of a pair is inserted.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
_WHITE = " \t\n\x0b\x0c\r"


def _step(code: int, after) -> tuple:
    """The costs before a row, from those after it; code = 4 * initial + fault."""
    initial, fault = code >> 2, code & 3
    cost = [DELETE + c for c in after]
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        for s in range(4):
            cost[s] = min(cost[s], REROLE + more + after[NEXT[s]])
            if s in FITS[initial]:
                cost[s] = min(cost[s], KEEP + more + after[initial])
    u, a = cost[USER], cost[ASSISTANT]
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(cost[NOTHING], INSERT + u), min(cost[SYSTEM], INSERT + u), u, a


def _matrix(codes: bytes) -> list:
    """Per state at the end (at no cost, others out of reach): the costs at the start."""
    out = []
    for end in range(4):
        v = tuple(0 if s == end else FAR for s in range(4))
        for code in reversed(codes):
            v = _step(code, v)
        out.append([min(c, FAR) for c in v])
    return out


def _ends(matrices: list) -> list:
    """The vector at the end of each block of a conversation."""
    v, out = list(END), []
    for m in reversed(matrices):
        out.append(v)
        v = [min(m[e][s] + v[e] for e in range(4)) for s in range(4)]
    return out[::-1]


def _walk(codes: bytes, vectors: list, state: int, last: bool) -> tuple:
    """ASCII-least tight edits of a block entered in ``state``, and the state after it."""
    edits = []
    for at, code in enumerate(codes):
        here, after = vectors[at], vectors[at + 1]
        initial, fault = code >> 2, code & 3
        more = TRUNCATED if fault == 3 else 0
        while True:
            if DELETE + after[state] == here[state]:
                edits.append("D")
                break
            if INSERT + here[NEXT[state]] == here[state]:
                edits.append("I")
                state = NEXT[state]
                continue
            if state in FITS[initial] and KEEP + more + after[initial] == here[state]:
                edits.append("K")
                state = initial
                break
            edits.append("R")
            state = NEXT[state]
            break
    while last and END[state]:
        edits.append("I")
        state = NEXT[state]
    return "".join(edits), state


def _legal(first: int, second: int) -> bool:
    return (first, second) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _matrices(batches):
    for pdf in batches:
        yield pd.DataFrame({"conv": pdf.conv, "block": pdf.block, "matrix": [sum(_matrix(bytes(c)), []) for c in pdf.codes]})


def _checkpoints(batches):
    for pdf in batches:
        for conv, blocks in zip(pdf.conv, pdf.blocks, strict=True):
            ends = _ends([[list(b["matrix"][i:i + 4]) for i in (0, 4, 8, 12)] for b in blocks])
            yield pd.DataFrame({"conv": conv, "block": range(len(blocks)), "after": ends})


_WALK = ("conv string, block long, first int, last int, blank long, duplicate long, truncated long, illegal long, cost long, "
         "audits array<string>, exits array<int>")


def _walks(batches):
    for pdf in batches:
        rows = []
        for conv, block, codes, after, last in zip(pdf.conv, pdf.block, pdf.codes, pdf.after, pdf["last"], strict=True):
            codes = bytes(codes)
            vectors = [tuple(after)]
            for code in reversed(codes):
                vectors.append(_step(code, vectors[-1]))
            vectors.reverse()
            found = [_walk(codes, vectors, s, last) for s in range(1 if block == 0 else 4)]
            faults, initials = [c & 3 for c in codes], [c >> 2 for c in codes]
            rows.append((conv, block, initials[0], initials[-1], faults.count(1), faults.count(2), faults.count(3),
                         sum(not _legal(a, b) for a, b in zip(initials, initials[1:])), vectors[0][NOTHING] if block == 0 else 0,
                         [f[0] for f in found], [f[1] for f in found]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _WALK.split(", ")])


def _entries(batches):
    for pdf in batches:
        for conv, blocks in zip(pdf.conv, pdf.blocks, strict=True):
            state, before, rows = NOTHING, None, []
            for b in blocks:
                rows.append((conv, b["block"], state, int(before is not None and not _legal(before, b["first"]))))
                state, before = int(b["exits"][state]), b["last"]
            yield pd.DataFrame(rows, columns=["conv", "block", "entry", "edge"])


def _apply(batches):
    """Repaired rows of blocks: each block's edits (kind 0) stand before its rows (kind 1)."""
    conv, block, edits, state, seq, out = None, 0, iter(()), NOTHING, 0, []

    def put(role, text):
        nonlocal seq
        out.append((conv, block, seq, role, text))
        seq += 1

    def insert():
        nonlocal state
        state = NEXT[state]
        put(ROLE[state], "")

    for pdf in batches:
        for c, b, kind, entry, initial, role, text in zip(pdf.conv, pdf.block, pdf.kind, pdf.entry, pdf.initial, pdf.role, pdf.text, strict=True):
            if kind == 0:
                for _ in edits:                     # what is left of the block before: inserts at its end
                    insert()
                conv, block, edits, state, seq = c, b, iter(text), entry, 0
                continue
            edit = next(edits)
            while edit == "I":
                insert()
                edit = next(edits)
            if edit == "K":
                state = initial
                put(role, text)
            elif edit == "R":
                state = NEXT[state]
                put(ROLE[state], text)
        yield pd.DataFrame(out, columns=["conv", "block", "seq", "role", "text"])
        out = []
    for _ in edits:
        insert()
    yield pd.DataFrame(out, columns=["conv", "block", "seq", "role", "text"])


def _digests(batches):
    """sha256 of each conversation's ``role:text`` lines, as they stream by in order."""
    conv, sha = None, None
    for pdf in batches:
        out = []
        for c, role, text in zip(pdf.conv, pdf.role, pdf.text, strict=True):
            if c != conv:
                if conv is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pd.DataFrame(out, columns=["conv", "sha"])
    if conv is not None:
        yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv", "sha"])


def _key(conv_id):
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("")).alias("conv")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` modulo 20
    (nulls: one space): 0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4
    makes its role user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(_key(F.col("conv_id")), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"),
                                F.pmod(F.crc32(F.encode(F.concat(one("conv_id"), F.lit(":"), one("turn")), "utf-8")), F.lit(20)).alias("kind"))
    rows = rows.where("kind <> 0").withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _numbered(rows: DataFrame, least_block: int) -> DataFrame:
    """Rows with their place (rank), block and code, written once."""
    tail = F.rtrim(F.col("text"), F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    rows = rows.select("conv", "turn", "role", "text", F.substring("text", 1, 100).alias("_head"), F.md5(F.encode("text", "utf-8")).alias("_md5"),
                       F.monotonically_increasing_id().alias("_copy"))      # parts equal rows, whose order does not matter
    rows = with_global_rank(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "_head", "_md5", "_copy"], rank_col="rank", size_col="n")
    rows = rows.select(
        "conv", "turn", "role", "text", "rank", "n",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.encode("role", "utf-8"), F.lit(":"), F.col("_md5"))).alias("same"),
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0).alias("initial"),
        F.when(tail == "", 1).when(F.substring(tail, -1, 1).isin(".", "!", "?"), 0).otherwise(3).alias("fault"))
    length = F.greatest(F.lit(least_block), F.ceil(F.sqrt(F.col("n").cast("double")))).cast("long")
    return scratch(rows.withColumn("block", F.floor(F.col("rank") / length).cast("long"))
                   .withColumn("blocks", F.ceil(F.col("n") / length).cast("long")), "dialogue-rows")


def repair(rows: DataFrame, least_block: int = LEAST_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Report (conv, blank, duplicate, truncated, illegal, cost, audit) and repaired rows (conv, block,
    seq, role, text; in that order) of rows (conv, turn, role, text) without nulls but in turn."""
    ship(rows.sparkSession)
    rows = _numbered(rows, least_block)
    again = (rows.groupBy("conv", "same").agg(F.min("rank").alias("earliest"), F.count("*").alias("c")).where("c > 1").select("conv", "same", "earliest"))
    codes = rows.select("conv", "same", "rank", "block", "blocks", "initial", "fault").join(again, ["conv", "same"], "left")
    fault = F.when(F.col("fault") == 1, 1).when(F.col("rank") > F.col("earliest"), 2).otherwise(F.col("fault"))
    blocks = (codes.groupBy("conv", "block", "blocks")
              .agg(F.sort_array(F.collect_list(F.struct("rank", (F.col("initial") * 4 + fault).alias("code")))).alias("x"))
              .select("conv", "block", "blocks", F.expr("unhex(array_join(transform(x, y -> lpad(hex(y.code), 2, '0')), ''))").alias("codes")))
    blocks = scratch(blocks, "dialogue-blocks")
    many = blocks.where("blocks > 1").select("conv", "block", "codes").mapInPandas(lean(_matrices), "conv string, block long, matrix array<long>")
    many = many.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("blocks"))
    after = many.mapInPandas(lean(_checkpoints), "conv string, block long, after array<long>")
    walks = (blocks.join(after, ["conv", "block"], "left")
             .select("conv", "block", "codes", F.coalesce("after", F.array(*[F.lit(c).cast("long") for c in END])).alias("after"),
                     (F.col("block") == F.col("blocks") - 1).alias("last"))
             .mapInPandas(lean(_walks), _WALK))
    walks = scratch(walks, "dialogue-walks")
    chain = (walks.join(blocks.where("blocks > 1").select("conv", "block"), ["conv", "block"])
             .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "first", "last", "exits"))).alias("blocks")))
    entries = chain.mapInPandas(lean(_entries), "conv string, block long, entry int, edge long")
    chosen = walks.join(entries, ["conv", "block"], "left").withColumns({"entry": F.coalesce("entry", F.lit(0)), "edge": F.coalesce("edge", F.lit(0))})
    chosen = scratch(chosen.select("conv", "block", "entry", F.expr("audits[entry]").alias("audit"), "blank", "duplicate", "truncated",
                                   (F.col("illegal") + F.col("edge")).alias("illegal"), "cost"), "dialogue-edits")
    report = chosen.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                                        F.expr("array_join(transform(sort_array(collect_list(struct(block, audit))), x -> x.audit), '')").alias("audit"))
    edits = chosen.select("conv", "block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("rank"), "entry", F.lit(0).alias("initial"),
                          F.lit("").alias("role"), F.col("audit").alias("text"))
    lines = rows.select("conv", "block", F.lit(1).alias("kind"), "rank", F.lit(0).alias("entry"), "initial", "role", "text")
    streams = edits.unionByName(lines).repartition("conv", "block").sortWithinPartitions("conv", "block", "kind", "rank")
    return report, streams.mapInPandas(lean(_apply), "conv string, block long, seq long, role string, text string")


def repair_digest(conversations: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """Per conversation id of ``conversations`` (conv_id, turn, role, text), after ``damage``: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damage(conversations)
    report, repaired = repair(rows, least_block)
    digests = (repaired.repartition("conv").sortWithinPartitions("conv", "block", "seq")
               .select("conv", "role", "text").mapInPandas(lean(_digests), "conv string, sha string"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    turns = rows.groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("d"))
    turns = turns.select("conv", F.coalesce((wide("hi") - wide("lo") + 1 - F.col("d")).try_cast("long"), F.lit(0)).alias("gaps"))
    ids = conversations.select(F.col("conv_id"), _key(F.col("conv_id"))).distinct()
    out = ids.join(report, "conv", "left").join(turns, "conv", "left").join(digests, "conv", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The same rows in DuckDB: the damage with a CRC-32 bit by bit, then the cheapest, ASCII-least edits
#: forward, row by row (the best prefix per state), instead of backward costs.
SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
        FROM range(256) r(b))),
source AS (
    SELECT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
    SELECT s.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 20 AS kind FROM source s, crc_table),
damaged AS (
    SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM hashed, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text[1:100], md5(text)) AS pos,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM damaged),
judged AS (
    SELECT *, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 2
            WHEN tail[-1:] IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
        CASE role[1:1] WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial,
        role[1:1] || lead(role[1:1]) OVER (PARTITION BY conv ORDER BY pos) AS pair, count(*) OVER (PARTITION BY conv) AS size FROM placed),
inserts(a, b, cost, audit, lines) AS (VALUES
    (0, 0, 0, '', []::VARCHAR[]), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']),
    (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
    (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
best(conv, pos, size, state, cost, audit, lines) AS (
    SELECT DISTINCT conv, 0::BIGINT, size, 0, 0, '', []::VARCHAR[] FROM judged
    UNION ALL
    SELECT conv, pos, size, state, cost, audit, lines FROM (
        SELECT b.conv, j.pos, b.size, e.state, b.cost + i.cost + e.cost AS cost, b.audit || i.audit || e.edit AS audit,
            list_concat(list_concat(b.lines, i.lines), e.line) AS lines,
            row_number() OVER (PARTITION BY b.conv, e.state ORDER BY b.cost + i.cost + e.cost, b.audit || i.audit || e.edit) AS place
        FROM best b JOIN judged j ON j.conv = b.conv AND j.pos = b.pos + 1 JOIN inserts i ON i.a = b.state,
        LATERAL (
            SELECT 'D' AS edit, i.b AS state, 4 AS cost, []::VARCHAR[] AS line
            UNION ALL SELECT 'K', j.initial, CASE j.fault WHEN 3 THEN 3 ELSE 0 END, [j.role || ':' || j.text] WHERE j.fault IN (0, 3)
                AND (i.b, j.initial) IN ((0, 1), (0, 2), (1, 2), (2, 3), (3, 2))
            UNION ALL SELECT 'R', CASE i.b WHEN 2 THEN 3 ELSE 2 END, CASE j.fault WHEN 3 THEN 6 ELSE 3 END,
                [CASE i.b WHEN 2 THEN 'assistant:' ELSE 'user:' END || j.text] WHERE j.fault IN (0, 3)) e)
    WHERE place = 1),
ended AS (
    SELECT b.conv, b.cost + i.cost AS cost, b.audit || i.audit AS audit, list_concat(b.lines, i.lines) AS lines
    FROM best b JOIN inserts i ON i.a = b.state AND (i.b = 3 OR (i.b = 0 AND b.state = 0)) WHERE b.pos = b.size
    QUALIFY row_number() OVER (PARTITION BY b.conv ORDER BY b.cost + i.cost, b.audit || i.audit) = 1),
counted AS (
    SELECT conv, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pos < size AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM source) s LEFT JOIN counted c ON c.conv = s.conv LEFT JOIN ended e ON e.conv = s.conv
"""
