"""Repair of conversation structure: faults of turns, and the cheapest edits that restore the order of roles.

A conversation's turns become a signature, one letter a turn for its role and first fault. Distinct signatures are
sorted and walked as a prefix trie: each node's layer of the dynamic programme (the best edits for every state of the
role grammar) is computed once from its parent's, and conversations that share a prefix share its layers. Answers are
emitted at terminal nodes and joined back; then each conversation's rows are replayed under its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.scratch import staged
from loomgraph.llm.shipping import ship_package

BLANKS = " \t\n\x0b\x0c\r"

# A letter of a signature: 4 * role + fault, counted from "A".
ROLES = "sua"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

# States of (s?(ua)+)?: nothing yet, after s, after u, after a.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = ("u", "u", "a", "u")
ACCEPTED = (0, 3)
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1


def letter(role: Column, fault: Column) -> Column:
    rank = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    return F.char(F.lit(65) + rank * 4 + fault)


def _inserts(state: int) -> list[tuple[int, str]]:
    """Where up to two insertions lead; a third only comes back at a price."""
    out = [(state, "")]
    for n in (1, 2):
        out.append((STEPS[out[-1][0]][FORCED[out[-1][0]]], "I" * n))
    return out


@lru_cache(maxsize=1 << 16)
def step(layer: tuple, symbol: str) -> tuple[tuple, int, tuple]:
    """The layer below one, for a turn: (layer, what its costs are counted from, (parent state, edits) of each state).

    A layer holds for each state its cost over the least and its place among the edit strings in ASCII order, or None.
    Edit strings of a layer end with an edit of the same turn, so none is the beginning of another, and their order
    stays whatever follows; insertions stand before the turn they precede.
    """
    role, fault = divmod(ord(symbol) - 65, 4)
    best: dict[int, tuple] = {}
    for state, known in enumerate(layer):
        if known is None:
            continue
        cost, place = known
        for at, inserted in _inserts(state):
            price = cost + INSERT * len(inserted)
            options = [(price + DELETE, "D", at)]
            if fault in (FINE, TRUNCATED):
                cut = CUT if fault == TRUNCATED else 0
                if role < 3 and ROLES[role] in STEPS[at]:
                    options.append((price + cut, "K", STEPS[at][ROLES[role]]))
                options.append((price + cut + REROLE, "R", STEPS[at][FORCED[at]]))
            for total, edit, to in options:
                found = (total, place, inserted + edit, state)
                if to not in best or found < best[to]:
                    best[to] = found
    least = min(f[0] for f in best.values())
    order = sorted(best, key=lambda to: best[to][1:3])
    below = tuple((best[to][0] - least, order.index(to)) if to in best else None for to in range(4))
    return below, least, tuple((best[to][3], best[to][2]) if to in best else None for to in range(4))


ROOT = ((0, 0), None, None, None)


def answers(signatures: Iterator[str]) -> Iterator[tuple[str, int, int, int, int, int, str]]:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of sorted signatures.

    The stack holds one node for each turn of the current prefix; what a signature shares with the one before stays.
    """
    # of each depth: layer, cost so far, (parent state, edits) by state, counts of the three faults and illegal neighbours
    stack: list[tuple] = [(ROOT, 0, None, (0, 0, 0, 0))]
    last = ""
    for s in signatures:
        shared, most = 0, min(len(s), len(last))
        while shared < most and s[shared] == last[shared]:
            shared += 1
        del stack[shared + 1 :]
        for i in range(shared, len(s)):
            layer, cost, _, counts = stack[-1]
            below, least, came = step(layer, s[i])
            role, fault = divmod(ord(s[i]) - 65, 4)
            pair = (ROLES + "?")[(ord(s[i - 1]) - 65) // 4] + (ROLES + "?")[role] if i else "su"
            counts = tuple(c + (fault == f) for c, f in zip(counts, (BLANK, DUPLICATE, TRUNCATED), strict=False)) + (counts[3] + (pair not in ("su", "ua", "au")),)
            stack.append((below, cost + least, came, counts))
        last = s
        layer, cost, _, counts = stack[-1]
        ends = []
        for state, known in enumerate(layer):
            if known is not None:
                ends += [(known[0] + INSERT * len(i), known[1], i, state) for at, i in _inserts(state) if at in ACCEPTED]
        extra, _, tail, state = min(ends)
        edits = [tail]
        for _, _, came, _ in reversed(stack[1:]):
            state, made = came[state]
            edits.append(made)
        yield (s, *counts, cost + extra, "".join(reversed(edits)))


ANSWER = "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in ANSWER.split(", ")]
    types = [pa.string(), *[pa.int64()] * 5, pa.string()]
    rows, size = [], 0
    for r in answers(s for b in batches for s in b.column(0).to_pylist()):
        rows.append(r)
        size += 2 * len(r[0]) + 64
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def solve(signatures: DataFrame) -> DataFrame:
    """Answers of distinct signatures(signature): sorted ranges, so that shared prefixes meet in one task."""
    return signatures.distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_solve, ANSWER)


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, live): rows after damage; a dropped row stays with live false, so that its conversation is known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    df = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), kind.alias("kind"))
    df = df.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    df = df.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).withColumn("live", F.col("kind") != 0)
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return df.select("conv_id", "turn", "role", "text", "live", again.alias("copy")).drop("copy")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, live, letter) to (conv_id, signature, gaps), a conversation at a time across batches."""
    key, letters, low, high, distinct = None, [], None, None, 0
    names = ["conv_id", "signature", "gaps"]

    def gaps() -> int:
        return 0 if low is None else high - low + 1 - distinct

    for b in batches:
        out = []
        for conv, turn, live, sign in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "live", "letter")), strict=True):
            if key is None or key[0] != conv:
                if key is not None:
                    out.append((key[0], "".join(letters), gaps()))
                key, letters, low, high, distinct = (conv,), [], None, None, 0
            if live:
                letters.append(sign)
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field("conv_id").type), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], b.schema.field("conv_id").type), pa.array(["".join(letters)], pa.string()), pa.array([gaps()], pa.int64())], names)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, audit on the first, role, text) to (conv_id, repaired_sha256); texts are digested as they come."""
    names = ["conv_id", "repaired_sha256"]
    key, audit, at, state, digest, empty = None, "", 0, 0, None, True

    def put(text: str) -> None:
        nonlocal empty
        digest.update(text.encode() if empty else b"\n" + text.encode())
        empty = False

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = FORCED[state]
            put("user:" if role == "u" else "assistant:")
            state, at = STEPS[state][role], at + 1

    for b in batches:
        out = []
        for conv, edits, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if edits is not None:
                if key is not None:
                    insert()
                    out.append((key[0], digest.hexdigest()))
                key, audit, at, state, digest, empty = (conv,), edits, 0, 0, hashlib.sha256(), True
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit == "K":
                put(f"{role}:{text}")
                state = STEPS[state][role[0]]
            elif edit == "R":
                role = FORCED[state]
                put(f"{'user' if role == 'u' else 'assistant'}:{text}")
                state = STEPS[state][role]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field("conv_id").type), pa.array([r[1] for r in out], pa.string())], names)
    if key is not None:
        insert()
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], b.schema.field("conv_id").type), pa.array([digest.hexdigest()], pa.string())], names)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Nulls of the damage key, role and text count as one space; a null conv_id is a conversation of its own, and null
    turns come first. Rows of one turn follow by role, then by the digest of their text, so repeated rows stay adjacent.
    Conversations whose rows were all dropped give zeros, an empty audit and the digest of nothing. An empty table
    gives an empty result; other columns are ignored. A conversation's rows meet in one task, sorted and read as a
    stream (the digest of its repaired text is sequential by definition): the task holds a letter a turn, never texts.
    """
    ship_package(rows.sparkSession)
    rows = staged(damaged(rows, conv_col, turn_col, role_col, text_col).withColumn("digest", F.sha2("text", 256)), "damaged")
    initial = F.left("role", F.lit(1))
    tail = F.right(F.expr(f"rtrim({_quoted(BLANKS)}, text)"), F.lit(1))
    same = Window.partitionBy("conv_id", "live", "role", "digest").orderBy("turn")
    # the second window key holds the first, so rows are shuffled once, by conversation
    turns = rows.select("conv_id", "turn", "role", "digest", "live", initial.alias("initial"), (tail == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("cut"))
    turns = turns.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    fault = F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    lettered = turns.select("conv_id", "turn", "role", "digest", "live", letter(F.col("initial"), fault).alias("letter")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    conv = rows.schema["conv_id"].dataType.simpleString()
    signed = staged(lettered.select("conv_id", "turn", "live", "letter").mapInArrow(_signatures, f"conv_id {conv}, signature string, gaps bigint"), "signatures")
    solved = staged(solve(signed.select("signature")), "answers")
    judged = staged(signed.join(solved, "signature"), "judged")
    heads = judged.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), "audit")
    body = rows.filter("live").select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    ordered = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "digest")
    repaired = ordered.select("conv_id", "audit", "role", "text").mapInArrow(_replay, f"conv_id {conv}, repaired_sha256 string")
    repaired = repaired.withColumnRenamed("conv_id", "repaired_id")
    facts = judged.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return facts.join(repaired, F.col("conv_id").eqNullSafe(F.col("repaired_id"))).drop("repaired_id")


def _quoted(chars: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in chars) + "'"


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _oracle() -> str:
    """The contract as two recursions over rows: best edits by state, each a text of nine digits of cost and the edits; then their replay."""

    def add(value: str, cost: str, edit: str) -> str:
        return f"(printf('%09d', CAST({value}[1:9] AS INT) + {cost}) || {value}[10:] || '{edit}')"

    def turn(state: int, initial: str) -> str:
        """The best of keeping a row of this initial, or giving it the role, after a state."""
        v, role = f"v{state}", f"WHEN initial = '{initial}' THEN {add(f'v{state}', 'cut', 'K')}"
        kept = f"CASE WHEN gone THEN NULL {role} END"
        return kept if initial == "s" else f"{kept}, CASE WHEN NOT gone THEN {add(v, f'{REROLE} + cut', 'R')} END"

    gone = [add(f"v{i}", str(DELETE), "D") for i in range(4)]
    best = f"{gone[0]} AS b0, least({gone[1]}, {turn(0, 's')}) AS b1, least({gone[2]}, {', '.join(turn(i, 'u') for i in (0, 1, 3))}) AS b2, least({gone[3]}, {turn(2, 'a')}) AS b3"
    put = lambda value: add(value, str(INSERT), "I")
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    line = "CASE edit WHEN 'K' THEN role || ':' || text WHEN 'R' THEN forced || ':' || text WHEN 'I' THEN forced || ':' END"
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    kinds AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM keyed),
    live AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM kinds WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, right(rtrim(text, {blanks}), 1) AS tail FROM live),
    marked AS (SELECT *, CASE WHEN tail = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {DUPLICATE} WHEN tail NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE 0 END AS fault,
      role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
    r AS (SELECT *, fault IN ({BLANK}, {DUPLICATE}) AS gone, CAST(fault = {TRUNCATED} AS INT) AS cut FROM marked),
    facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = {BLANK}) AS blank, count(*) FILTER (WHERE fault = {DUPLICATE}) AS duplicate, count(*) FILTER (WHERE fault = {TRUNCATED}) AS truncated,
      count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
    dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '000000002I' AS v2, '000000004II' AS v3 FROM r
      UNION ALL SELECT conv_id, i, b0, b1, w2, least(b3, {put("w2")}) FROM (SELECT *, least(b2, {put("b0")}, {put("b1")}, {put("b3")}) AS w2 FROM (
        SELECT r.conv_id, r.i, {best} FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))),
    done AS (SELECT dp.conv_id, CAST(least(v0, v3)[1:9] AS BIGINT) AS cost, least(v0, v3)[10:] AS audit FROM dp JOIN facts f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.i),
    play AS (SELECT conv_id, audit, 0 AS p, CAST(0 AS BIGINT) AS i, '' AS last, CAST(NULL AS VARCHAR) AS lines FROM done
      UNION ALL SELECT conv_id, audit, p + 1, i, CASE edit WHEN 'D' THEN last WHEN 'K' THEN initial ELSE forced[1:1] END, CASE WHEN edit = 'D' THEN lines ELSE coalesce(lines || chr(10), '') || {line} END
      FROM (SELECT x.conv_id, audit, p, edit, forced, last, lines, x.i, role, text, initial FROM (SELECT *, audit[p + 1 : p + 1] AS edit, CASE last WHEN 'u' THEN 'assistant' ELSE 'user' END AS forced FROM (SELECT conv_id, audit, p, last, lines, CASE WHEN audit[p + 1 : p + 1] = 'I' THEN i ELSE i + 1 END AS i FROM play WHERE p < len(audit))) x
        LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i)),
    ends AS (SELECT conv_id, sha256(coalesce(lines, '')) AS repaired_sha256 FROM play WHERE p = len(audit))
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
      coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = _oracle()
