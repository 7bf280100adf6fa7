"""Conversation repair against a forward walk over the roles, and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from llm import conversations as C

BLANK = set(" \t\n\x0b\x0c\r")
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SCHEMA = "conv_id long, turn long, role string, text string"
NAME = {"u": "user", "a": "assistant"}


def hit(rows):
    out = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
        out.setdefault(c, []).extend([(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1))
    return out


def widened(states):
    states = dict(states)
    for _ in range(6):
        for s, (cost, audit, made) in list(states.items()):
            for ch, to in NEXT[s].items():
                new = (cost + 2, audit + "I", (*made, (NAME.get(ch), "")))
                if ch != "s" and (to not in states or new[:2] < states[to][:2]):
                    states[to] = new
    return states


def brute(rows):
    out = {}
    for c, said in hit(rows).items():
        said.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2][:64], hashlib.md5(z[2].encode()).digest()))
        turns = [z[0] for z in said if z[0] is not None]
        seen, count, states = set(), {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}, widened({0: (0, "", ())})
        for _, r, x in said:
            letters = [ch for ch in x if ch not in BLANK]
            fault = "blank" if not letters else "duplicate" if (r, x) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((r, x))
            count[fault] += 1
            new = {}
            for s, (cost, audit, made) in states.items():
                moves = [(s, cost + 3, "D", made)]
                if fault not in ("blank", "duplicate"):
                    e = cost + (fault == "truncated")
                    moves += [(to, e, "K", (*made, (r, x))) for ch, to in NEXT[s].items() if r[:1] == ch]
                    moves += [(to, e + 2, "R", (*made, (NAME[ch], x))) for ch, to in NEXT[s].items() if ch != "s"]
                for to, k, letter, done in moves:
                    v = (k, audit + letter, done)
                    if to not in new or v[:2] < new[to][:2]:
                        new[to] = v
            states = widened(new)
        cost, audit, made = min(states[s] for s in (0, 3) if s in states)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def messy(seed, n):
    """Half of the rows in one long conversation, many of them equal; odd roles and texts, null turns and ids."""
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "usr"]
    texts = [None, "", ".", "a.", "b", "c!  \n", "d" * 100 + ".", "d" * 100 + "e.", " \t"]
    return [(r.choice([1, 1, 1, 2, None, 7]) if i % 3 else r.randrange(20, n // 8), r.choice([None, r.randrange(-3, 40), r.randrange(n)]), r.choice(roles), r.choice([*texts, f"{r.randrange(n)}?"])) for i in range(n)]


def found(df):
    rows = [tuple(x) for x in C.repair_query(df).collect()]
    assert len(rows) == len({x[0] for x in rows})
    return {x[0]: x[1:] for x in rows}


@pytest.mark.parametrize("whole", [C.WHOLE, 40])
def test_repair_equals_the_walk(spark, monkeypatch, whole):
    monkeypatch.setattr(C, "WHOLE", whole)
    rows = messy(whole, 3000)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(16)) == brute(rows)


def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_sql_equals_the_walk():
    rows = messy(5, 1500)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(C.SQL).fetchall()} == brute(rows)


def test_odd_rows(spark):
    top = (1 << 63) - 1
    rows = [(5, None, None, None), (None, None, None, None), (6, -top, "user", "Hi."), (6, top, "assistant", "Long " * 200_000 + "."), (8, 3, "system", "Rules."), (8, 3, "system", "Rules.")]
    got = found(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", copies string"))
    want = brute(rows)
    want[6] = (top, *want[6][1:])  # gaps wider than a long are held at its end
    assert got == want
    assert C.repair_query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dropped_conversation_stays(spark):
    c = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark.createDataFrame([(c, 0, "user", "Hi.")], SCHEMA)) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_long_conversation_of_equal_rows(spark):
    rows = [(1, 4, "user", "Same.")] * 4000 + [(1, 5, "assistant", "Other.")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(8)) == brute(rows)
