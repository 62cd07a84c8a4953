"""Conversation repair against a search over all edits and a plain program over the rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from vigilmill.llm import conversation_repair as repair
from vigilmill.llm import queries

MOST_INSERTS = 3


def cheapest(signature):
    """(cost, edits) by comparing whole edit strings."""
    codes = [divmod(ord(c) - 65, 4) for c in signature]
    after, nexts = {"s": 1, "u": 2, "a": 3}, {0: "su", 1: "u", 2: "a", 3: "u"}

    @lru_cache(None)
    def best(i, point, inserted):
        found = []
        if i == len(codes):
            found += [(0, "")] * (point in (0, 3))
        else:
            fault, role = codes[i]
            cost, rest = best(i + 1, point, 0)
            found.append((cost + 3, "D" + rest))
            for x in nexts[point] if fault < 2 else "":
                cost, rest = best(i + 1, after[x], 0)
                found += [(cost + (fault == 1), "K" + rest)] * ("sua?"[role] == x) + [(cost + 2 + (fault == 1), "R" + rest)] * (x != "s")
        for x in nexts[point].replace("s", "") if inserted < MOST_INSERTS else "":
            cost, rest = best(i, after[x], inserted + 1)
            found.append((cost + 2, "I" + rest))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def test_solver_all_short_and_some_long():
    assert all(repair.solve(s) == cheapest(s) for n in range(4) for s in map("".join, product(map(chr, range(65, 81)), repeat=n)))
    r = random.Random(3)
    for _ in range(800):
        s = "".join(chr(65 + r.choice([0, 1, 2, 1, 2, 5, 6, 9, 14, 3, r.randrange(16)])) for _ in range(r.randint(4, 180)))
        assert repair.solve(s) == cheapest(s), s


def test_solver_long_signature():
    cost, edits = repair.solve("BC" * 100_000 + "A")
    assert (cost, len(edits)) == (3, 200_001) and edits == "K" * 200_000 + "D"


def by_hand(rows):
    """The report of (conv_id, turn, role, text) rows."""
    damaged = {}
    for conv, turn, role, text in rows:
        damaged.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        damaged[conv] += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    found = {}
    for conv, mine in damaged.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            core = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "none")
            seen.add((role, text))
        signature = "".join(chr(65 + 4 * repair.FAULTS.index(f) + ("sua".find(r[:1]) if r[:1] in ("s", "u", "a") else 3)) for f, (_, r, _) in zip(faults, mine))
        cost, audit = cheapest(signature)
        out, at, left = [], "", list(mine)
        for edit in audit:
            if edit == "D":
                left.pop(0)
                continue
            given = "assistant" if at[-1:] == "u" else "user"
            _, role, text = left.pop(0) if edit != "I" else (None, given, "")
            out.append((role if edit == "K" else given, text))
            at += out[-1][0][:1]
        assert not left and re.fullmatch("(s?(ua)+)?", at)
        turns = {t for t, _, _ in mine if t is not None}
        pairs = zip((r[:1] for _, r, _ in mine), (r[:1] for _, r, _ in mine[1:]))
        said = "\n".join(f"{r}:{t}" for r, t in out)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest(), len(out), out,
        )
    return found


@pytest.fixture(scope="module")
def made_rows():
    r = random.Random(5)
    texts = ["Fine.", "no end", "", " \t\n", "Well?", "Ünï!", None, "a\nb.", "Fine. ", "...", "x" * 70_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "usher"]
    rows = [(c if c % 9 else None, r.choice([None, t, t, t, t * 3, t - 5]), r.choice(roles[:3] * 3 + roles), r.choice(texts)) for c in range(120) for t in range(r.randint(1, 9))]
    rows += [(7000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(900)] + rows[:20]
    return rows + [((1 << 62) + 1, 5, "user", "big id?"), ((1 << 62) + 3, -(1 << 62), "user", "q."), ((1 << 62) + 3, 1 << 62, "assistant", "a.")]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_report_and_rows_as_by_hand(spark, made_rows, tmp_path):
    spark.createDataFrame([(*r, 1, "x") for r in made_rows], SCHEMA + ", cost int, Signature string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    expected = by_hand(made_rows)
    assert len(found) == len(expected)
    assert {r[0]: tuple(r[1:]) for r in found} == {k: v[:-1] for k, v in expected.items()}
    rows = repair.repaired(repair.damage(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).collect()
    made = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        assert turn == len(made.setdefault(conv, []))
        made[conv].append((role, text))
    assert made == {k: v[-1] for k, v in expected.items() if v[-1]}


def test_dropped_conversation_and_empty_table(spark, tmp_path):
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA).write.parquet(f"{tmp_path}/one/conversations.parquet")
    row = queries.op11_conversation_repair(spark, f"{tmp_path}/one").collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0)]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op11_conversation_repair(spark, f"{tmp_path}/none").collect() == []


def test_solved_by_shuffle_as_by_broadcast(spark, monkeypatch):
    damaged = repair.damage(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    one = sorted(map(tuple, repair.repair_report(damaged).collect()))
    monkeypatch.setattr(repair, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, repair.repair_report(damaged).collect())) == one
