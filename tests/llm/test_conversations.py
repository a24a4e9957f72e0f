"""Operator 11 against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers import CLASHES
from pyspark.sql import functions as F

from meshloom.llm import conversations as cv, queries

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows, most_inserts=2):
    """(cost, letters, turns left) of the cheapest repair, found by trying every edit; ``rows`` are (role, text, fault)."""
    found = [(0, "", ())]
    fill = lambda ways: [(c + 5 * len(r), e + "I" * len(r), left + tuple((x, "") for x in r)) for c, e, left in ways for k in range(most_inserts + 1) for r in itertools.product(("user", "assistant"), repeat=k)]
    found = fill(found)
    for role, text, fault in rows:
        ways = []
        for c, e, left in found:
            ways.append((c + 2, e + "D", left))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways.append((c + more, e + "K", (*left, (role, text))))
                ways += [(c + 1 + more, e + "R", (*left, (r, text))) for r in ("user", "assistant")]
        found = fill(ways)
    return min(w for w in found if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in w[2])))


def by_states(rows):
    """The same for longer conversations: the least (cost, letters) of each state, letters in full."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def fill():
        for _ in range(2):
            for state, (c, e, left) in list(best.items()):
                for role in ("user", "assistant"):
                    to = after.get((state, role[0]))
                    if to:
                        best[to] = min(best.get(to, (10**9,)), (c + 5, e + "I", (*left, (role, ""))))

    fill()
    for role, text, fault in rows:
        ways = []
        for state, (c, e, left) in best.items():
            ways.append((state, (c + 2, e + "D", left)))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways.append((after.get((state, role[:1])), (c + more, e + "K", (*left, (role, text)))))
                ways += [(after.get((state, r[0])), (c + 1 + more, e + "R", (*left, (r, text)))) for r in ("user", "assistant")]
        best = {}
        for to, way in ways:
            if to is not None:
                best[to] = min(best.get(to, (10**9,)), way)
        fill()
    return min(best[s] for s in ("", "a") if s in best)


def searched(rows):
    """What ``Repair`` finds, with the most edits that were open, and how many came before the end."""
    search, edits = cv.Repair(), []
    for role, text, fault in rows:
        edits += search.read((None, role, text, fault), role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    early = len(edits)
    edits += search.close()
    cost, left = 0, []
    for letter, row, state in edits:
        cost += cv.COST[letter] + 5 * (letter in "KR" and row[3] == "truncated")
        if letter != "D":
            left.append((row[1] if letter == "K" else cv.ROLE[state], row[2] if row else ""))
    return (cost, "".join(e[0] for e in edits), tuple(left)), search.most_open, early


def some_rows(rng, n):
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher"]), f"t{i}", rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for i in range(n)]


def test_every_edit_of_short_conversations():
    rng = random.Random(1)
    for n, times in ((0, 1), (1, 30), (2, 30), (3, 4)):
        for _ in range(times):
            rows = some_rows(rng, n)
            assert searched(rows)[0] == cheapest(rows)


def test_longer_conversations():
    rng = random.Random(2)
    for k in range(400):
        rows = some_rows(rng, rng.randrange(5, 60))
        if k % 4 == 0:  # runs of one role, in which ways stay apart for long
            rows = [(rng.choice(["user", "assistant"]), f"t{i}", None) for i in range(3) for _ in range(rng.randrange(20))]
        assert searched(rows)[0] == by_states(rows)


def test_open_edits_stay_few():
    rng = random.Random(3)
    rows = some_rows(rng, 20_000)
    (_, letters, _), most, early = searched(rows)
    assert most < 300 and early > 19_000 and len(letters) >= 20_000


def test_runs_of_one_role_take_time_in_proportion():
    rows = [("assistant", f"t{i}", None) for i in range(30_001)]
    (cost, letters, left), most, _ = searched(rows)
    assert (cost, letters) == (15_000 + 2, "D" + "RK" * 15_000) and len(left) == 30_000 and most < 5 * 30_001


def damaged(rows):
    """(turn, role, text) of one conversation's (conv_id, turn, role, text)."""
    one = lambda x: " " if x is None else x
    out = []
    for conv, turn, role, text in rows:
        role, text, kind = one(role), one(text), zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def digests(rows):
    rows, seen, marked = damaged(rows), set(), []
    for turn, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(m[2] == f for m in marked)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, letters, left = by_states(marked)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def check(table, got):
    by = {}
    for r in table:
        by.setdefault(r[0], []).append(tuple(r))
    rows = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(rows) == len(got) and rows == {k: digests(v) for k, v in by.items()}


def test_op11(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    check(table, queries.op11_conversations(spark, small).collect())


def test_odd_conversations(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " \t\n", "Yes.", "No", "Yes. ", "What?\n", "Ünï!", "a ", "\x00", "😀", "long " * 20_000 + "."])
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), rng.choice(["user", "assistant", "system", None, "", "tool"]), text()) for c in [None, 1, 2, 3, 4, 5, 6, 7, 8, -9] for _ in range(rng.randrange(1, 12))]
    rows += rows[:7]
    dropped = next(i for i in range(100, 1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    kind = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in (*CLASHES, "fault", "edit", "end", "said", "seen", "audit", "cost", "step"))
    n = kind.count(",") - 3
    table = spark.createDataFrame([(*r, *["x"] * n) for r in rows], kind)
    got = cv.damaged_and_repaired(table.repartition(3)).collect()
    check(rows, got)
    assert tuple(next(r for r in got if r["conv_id"] == dropped))[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cv.damaged_and_repaired(table.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_repeats_in_other_turns(spark, threshold):
    rows = [(c, t, "user" if t % 2 else "assistant", f"Said {t % 5}." if t % 3 else f"Only {c} {t}.") for c in range(30) for t in range(40)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        check(rows, cv.damaged_and_repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi!"), (1, 3, "user", "Hi!"), (1, 4, "assistant", "Cut o")]
    got = cv.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("step").collect()
    assert [(r["edit"], r["fault"], r["cost"], r["role"], r["text"]) for r in got] == [("K", None, 0, "system", "Be kind."), ("R", None, 1, "user", "Hello."), ("R", None, 1, "assistant", "Hi!"), ("D", "duplicate", 2, None, None), ("D", "truncated", 2, None, None)]
    assert [r["step"] for r in got] == list(range(5))


def test_one_large_conversation_is_streamed(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    table = [tuple(r) for r in rows.collect()]
    check(table, cv.damaged_and_repaired(rows).collect())
