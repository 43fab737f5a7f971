"""Conversation repair against exhaustive search and a plain shortest path."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tipflow.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, piece string, cost double"


def faults(rows):
    """Kind of each (role, text), in order."""
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, repaired) by a shortest path that keeps whole audits and whole results."""
    kinds = faults(rows)
    best = {"": (0, "", [])}  # state: initials so far, cut to what matters

    def state(initials):
        return initials if initials in ("", "s") else initials[-1]

    def inserts(best):
        for _ in range(4):
            for key, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step(key, role[0])
                    if to is not None:
                        offer(best, to, (cost + 5, audit + "I", out + [(role, "")]))

    def step(key, x):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[key].get(x)

    def offer(best, key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value

    for (role, text), kind in zip(rows, kinds):
        inserts(best)
        new = {}
        for key, (cost, audit, out) in best.items():
            offer(new, key, (cost + 2, audit + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            for name, price, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                to = step(key, name[:1])
                if to is not None:
                    offer(new, to, (cost + price + 5 * (kind == "cut"), audit + letter, out + [(name, text)]))
        best = new
    inserts(best)
    return min(best[k][:2] + (best[k][2],) for k in ("", "a") if k in best)


def every_edit(rows):
    """(cost, audit) by trying all edits with up to two inserts at each place."""
    kinds, found = faults(rows), []
    for ins in itertools.product(range(3), repeat=len(rows) + 1):
        for edit in itertools.product("KRD", repeat=len(rows)):
            for fill in itertools.product("ua", repeat=sum(ins) + edit.count("R")):
                fill, roles, audit, cost = iter(fill), "", "", 5 * sum(ins)
                for i, n in enumerate(ins):
                    roles += "".join(next(fill) for _ in range(n))
                    audit += "I" * n
                    if i == len(rows):
                        break
                    audit += edit[i]
                    if edit[i] != "D":
                        roles += (rows[i][0][:1] or "?") if edit[i] == "K" else next(fill)
                        cost += (edit[i] == "R") + 5 * (kinds[i] == "cut") + 99 * (kinds[i] in ("blank", "duplicate"))
                    else:
                        cost += 2
                if re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, audit))
    return min(found)


def row_of(rows, turns):
    cost, audit, out = plain(rows)
    kinds, known = faults(rows), [t for t in turns if t is not None]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("cut"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def expected(rows):
    """By conversation, from damaged (conv_id, turn, role, text, dropped) rows."""
    out = {}
    rows = [(c, turn, " " if role is None else role, " " if text is None else text, gone) for c, turn, role, text, gone in rows]
    for conv in {r[0] for r in rows}:
        own = sorted([r[1:4] for r in rows if r[0] == conv and not r[4]], key=order)
        out[conv] = row_of([r[1:] for r in own], [r[0] for r in own])
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def some_rows(rnd, n):
    return [(rnd.choice(["system", "user", "user", "assistant", "tool", ""]), rnd.choice(["", " ", "a.", "b!", "c", "d", "e?", "f. "]))
            for _ in range(n)]


def test_plain_path_is_the_cheapest_of_all_edits():
    rnd = random.Random(5)
    for _ in range(60):
        rows = some_rows(rnd, rnd.randint(0, 3))
        assert plain(rows)[:2] == every_edit(rows), rows


def test_survivors_match_plain_path():
    rnd = random.Random(6)
    for i in range(400):
        n = rnd.randint(0, 40)
        rows = some_rows(rnd, n) if i % 2 else [(rnd.choice(["user", "assistant"] if i % 4 else ["user"]), f"{j}.") for j in range(n)]
        known, paths = repair.Faults(), repair.Survivors()
        for role, text in rows:
            body = text.rstrip(repair.SPACE)
            paths.step(repair.MOVES[known.kind(None, role[:1], role + ":" + text, not body, bool(body) and body[-1] not in ".!?")])
        state, cost, letters = paths.finish()
        tail = repair.TAIL[state]
        assert (cost + 5 * len(tail), "".join(letters) + tail) == plain(rows)[:2], rows


def test_memory_stays_small_where_survivors_meet():
    paths, most = repair.Survivors(), 0
    rnd = random.Random(7)
    for i in range(20_000):
        paths.step(repair.MOVES[("ua"[i % 2] if rnd.random() < 0.95 else "s", False, rnd.random() < 0.05)])
        most = max(most, max(len(paths.open(n)) for _, _, n in paths.paths))
    assert most < 200 and len(paths.decided) > 19_700


def test_query_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, SF)) == expected(damage(rows))


def test_edge_cases_and_pieces(spark):
    """Nulls, ties, repeated rows, clashing names; every conversation also cut into small pieces."""
    rnd = random.Random(8)
    rows = [(c, rnd.choice([None, *range(n)]), *some_rows(rnd, 1)[0]) for c, n in ((1, 5), (2, 40), (None, 30)) for _ in range(n)]
    rows += [(3, i, "user", f"{i}.") for i in range(90)]  # ties stay open to the end
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(120)]
    rows += [(5, 7, "user", "same.")] * 60 + [(6, None, None, None)] * 3 + [(7, 1, "a", "x"), (None, None, None, "é ü。")]
    rows += [(8, i, "user" if i % 2 == 0 else "assistant", "again.") for i in range(50)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], SCHEMA).repartition(3)
    want = expected([(*r, False) for r in rows])
    assert got(repair.digests(*repair.parts(df))) == want
    assert got(repair.digests(*repair.parts(df, piece_rows=8))) == want
    chunks = repair.repaired(df, piece_rows=8).where("conv_id = 4 and piece is not null").orderBy("piece").collect()
    assert len(chunks) > 3 and [(t.role, t.text) for c in chunks for t in c.turns] == [r[2:] for r in rows if r[0] == 4]
    damaged = damage(rows)
    assert got(repair.digests(*repair.parts(queries.damaged(df), F.col("dropped"), piece_rows=8))) == expected(damaged)
    empty = df.where("false")
    assert repair.repaired(empty).collect() == []
    gone = repair.repaired(df.where("conv_id = 7"), F.lit(True)).collect()
    assert [(r.conv_id, r.audit, r.turns, r.cost, r.gaps) for r in gone] == [(7, "", [], 0, 0)]


@pytest.mark.parametrize("rows", [8, 4096])
def test_one_very_long_text(spark, rows):
    data = [(1, 0, "user", "w " * 1_000_000 + "."), (1, 1, "assistant", "x" * 2_000_000), (1, 2, "user", "z.")]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in data], SCHEMA)
    assert got(repair.digests(*repair.parts(df, piece_rows=rows, piece_bytes=1 << 20))) == expected([(*r, False) for r in data])
