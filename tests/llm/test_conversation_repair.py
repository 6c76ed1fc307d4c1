"""Conversation repair against every possible edit (short ones) and a search over tuples (all)."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from kpiframe.llm.conversation_repair import repair, shortest

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))


def judge(rows):
    seen, faults = set(), []
    for row in rows:
        body = row[2].rstrip(BLANKS)
        faults.append("blank" if not body else "duplicate" if row[1:] in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add(row[1:])
    return faults


def counted(rows, faults):
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
    )


def searched(rows, faults):
    """(cost, audit, repaired text): the least of all paths as tuples, up to two inserts before each row and at the end."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    name = {"u": "user", "a": "assistant"}

    def inserts(best):
        out = dict(best)
        for _ in range(2):
            for state, (cost, audit, lines) in list(out.items()):
                to = "a" if state == "u" else "u"
                way = (cost + 3, audit + "I", (*lines, name[to] + ":"))
                out[to] = min(out.get(to, way), way)
        return out

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in inserts_each(best, inserts):
            ways = [(state, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (state, role[:1]) in step:
                    ways.append((step[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                to = "a" if state == "u" else "u"
                ways.append((to, (cost + 3 + more, audit + "R", (*lines, f"{name[to]}:{text}"))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        best = after
    cost, audit, lines = min(v for s, v in inserts_each(best, inserts) if s in ("", "a"))
    return cost, audit, "\n".join(lines)


def inserts_each(best, inserts):
    """Every state with and without inserts: an insert may lose to none in its state and still be kept apart."""
    for state, value in best.items():
        yield from inserts({state: value}).items()


def want(conversations):
    out = {}
    for conv in {r[0] for r in conversations}:
        rows = damage([r for r in conversations if r[0] == conv])
        faults = judge(rows)
        cost, audit, text = searched(rows, faults)
        out[conv] = (*counted(rows, faults), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made(seed, conversations, rows, words=6):
    rng = random.Random(seed)
    out = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, rows)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rng.choice(["Yes.", "No", "", " \n", None, "Why?", "é!  ", *(f"Text {rng.randrange(words)}." for _ in range(4))])
            out.append((conv if conv else None, rng.choice([turn, turn, turn, turn, turn + 2, None]), role, text))
    return out


@pytest.mark.parametrize("seed,conversations,rows,block_rows", [(1, 60, 9, 256), (2, 12, 400, 3), (3, 40, 12, 2)])
def test_repairs_are_the_cheapest(spark, table, seed, conversations, rows, block_rows):
    data = made(seed, conversations, rows)
    random.Random(seed).shuffle(data)
    df = table(data, SCHEMA).repartition(3)
    summary, turns = repair(df, block_rows)
    got = {r["conv_id"]: r for r in summary.collect()}
    expected = want(data)
    assert set(got) == set(expected)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    for conv, row in got.items():
        assert tuple(row[c] for c in names) == expected[conv], conv
    # The turns that come out spell the text that was hashed.
    lines = {}
    for r in sorted(turns.collect(), key=lambda r: r["block"]):
        lines.setdefault(r["conv_id"], []).extend(f"{t['role']}:{t['text']}" for t in r["repaired"])
    for conv, row in got.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == row["repaired_sha256"]


def test_search_is_the_least_of_all_edits():
    """Every way to edit up to three rows, with up to two inserts anywhere, checked by the expression itself."""
    rng = random.Random(7)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c", ""])) for i in range(rng.randrange(4))]
        faults = judge(rows)
        fits = []
        for gaps in itertools.product(["", "u", "a", "uu", "ua", "au", "aa"], repeat=len(rows) + 1):
            for edits in itertools.product("DKua", repeat=len(rows)):
                if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
                    continue
                initials, audit, cost = "", "", 0
                for (_, role, _), fault, gap, e in zip(rows, faults, gaps, edits):
                    initials += gap + ("" if e == "D" else role[0] if e == "K" else e)
                    audit += "I" * len(gap) + (e if e in "DK" else "R")
                    cost += 3 * len(gap) + {"D": 4, "K": 0}.get(e, 3) + (3 if e != "D" and fault == "truncated" else 0)
                initials, audit, cost = initials + gaps[-1], audit + "I" * len(gaps[-1]), cost + 3 * len(gaps[-1])
                if re.fullmatch("(s?(ua)+)?", initials):
                    fits.append((cost, audit))
        assert searched(rows, faults)[:2] == min(fits)


def test_one_conversation_over_many_partitions(spark, table):
    """A hot conversation with rows of one turn and repeats, folded over several levels."""
    rng = random.Random(5)
    rows = [(7, rng.randrange(40), rng.choice(["user", "assistant"]), f"Text {rng.randrange(900)}.") for _ in range(700)]
    rows += [(8, 0, "user", "Hello there."), (8, 1, "assistant", "Hello.")]
    summary, _ = repair(table(rows, SCHEMA).repartition(5), 2)
    got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"]) for r in summary.collect()}
    assert got == {conv: v[-3:] for conv, v in want(rows).items()}


def test_empty_table_and_dropped_conversations(spark, table):
    assert repair(table([], SCHEMA))[0].count() == 0
    dropped = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair(table([(dropped, 0, "user", "Hi.")], SCHEMA))[0].first()
    assert (row["cost"], row["audit"], row["gaps"]) == (0, "", 0)
    assert row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_conversations_take_linear_time():
    layers = [[[(0, 0, 24)], [], [], []]] * 3000
    assert shortest(layers, 0)
