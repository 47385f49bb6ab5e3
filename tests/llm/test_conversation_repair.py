import hashlib
import itertools
import random
import zlib

import pytest
from oracle import rows, sql_rows

from loomgraph.llm import conversation_repair as cr

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, letter int"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """Best (cost, audit) and repaired rows by plain dynamic programming over whole strings: turns of (role, text, must_go, cut)."""
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}

    def spread(layer):
        for _ in range(3):
            for s in list(layer):
                for r in "ua":
                    to = go.get((s, r))
                    if to is not None:
                        cost, audit, out = layer[s]
                        offer(layer, to, (cost + 2, audit + "I", [*out, f"{name[r]}:"]))
        return layer

    def offer(layer, to, found):
        if to not in layer or found[:2] < layer[to][:2]:
            layer[to] = found

    layer = spread({0: (0, "", [])})
    for role, text, must_go, cut in turns:
        below = {}
        for s, (cost, audit, out) in layer.items():
            offer(below, s, (cost + 3, audit + "D", out))
            if not must_go:
                if (s, role[:1]) in go:
                    offer(below, go[s, role[:1]], (cost + cut, audit + "K", [*out, f"{role}:{text}"]))
                for r in "ua":
                    if (s, r) in go:
                        offer(below, go[s, r], (cost + 2 + cut, audit + "R", [*out, f"{name[r]}:{text}"]))
        layer = spread(below)
    return min((layer[s] for s in (0, 3) if s in layer), key=lambda f: f[:2])


def brute(data):
    convs = {}
    for conv, turn, role, text in data:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, turns, n = set(), [], [0, 0, 0]
        for _, role, text in mine:
            last = text.rstrip(BLANKS)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                n[fault] += 1
            turns.append((role, text, fault < 2, int(fault == 2)))
        known = [t for t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = cheapest(turns)
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, data):
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)
    return sorted(map(tuple, cr.repair_conversations(df).collect()), key=repr)


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_query_same_as_brute_force(spark, sf):
    read = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    found, names = rows(cr.op13_conversation_repair(spark, sf))
    order = [names.index(n) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]
    assert sorted((tuple(r[k] for k in order) for r in found), key=repr) == brute([tuple(r) for r in read])


def test_same_as_sql(spark):
    assert rows(cr.op13_conversation_repair(spark, SMALL)) == sql_rows(SMALL, cr.ORACLE)


def test_random_conversations(spark):
    rng = random.Random(8)
    data = []
    for conv in [*range(150), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            data.append((conv, rng.choice([turn, turn, 2 * turn, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "so", " \n", None, "", "é?", "long " * 50])))
    assert got(spark, data) == brute(data)


def test_edges(spark):
    long = [(1, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(6000)] + [(2, t, "user", "same.") for t in range(3000)]
    data = [*long, (3, 0, "user", "x" * 1_000_000), (None, None, None, None)]
    assert got(spark, data) == brute(data)
    assert got(spark, []) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "a.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_trie_equals_brute_force_on_all_short_signatures():
    letters = {chr(65 + 4 * r + f): (("system", "user", "assistant", "x")[r], f) for r in range(4) for f in range(4)}
    alphabet = [c for c, (role, f) in letters.items() if f in (0, 2) or f == 1 and role == "user" or f == 3 and role in ("user", "assistant")]
    for n in range(4):
        words = sorted("".join(w) for w in itertools.product(alphabet, repeat=n))
        for (s, *_, cost, audit) in cr.answers(iter(words)):
            turns = [(letters[c][0], "", letters[c][1] in (1, 2), int(letters[c][1] == 3)) for c in s]
            assert (cost, audit) == cheapest(turns)[:2], s
    rng = random.Random(2)
    words = sorted("".join(rng.choices(alphabet, k=rng.randrange(4, 40))) for _ in range(400))
    for (s, *_, cost, audit) in cr.answers(iter(words)):
        assert (cost, audit) == cheapest([(letters[c][0], "", letters[c][1] in (1, 2), int(letters[c][1] == 3)) for c in s])[:2], s
