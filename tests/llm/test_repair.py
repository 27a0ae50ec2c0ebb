"""Conversation repair against every sequence of edits, and against a plain backward search."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from wardlens.llm import repair as R

SF_MID = "/root/testdata/sf0.01"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    """Rows ``(conv_id, turn, role, text)`` after damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)

    def place(conv):
        plain = "" if conv is None else str(conv)
        return lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{str(conv is None).lower()}{len(plain)}:{plain}{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {conv: sorted(own, key=place(conv)) for conv, own in out.items()}


def faults(rows):
    """The first fault of each row."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_repair(rows):
    """Backward search that carries whole audits: ``(cost, audit, lines)``."""
    found = faults(rows)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    later = None
    for i in range(len(rows), -1, -1):
        here = {}
        for state in ("", "s", "u", "a"):
            if i == len(rows):
                options = [(0, "", ())] if state in ("", "a") else []
            else:
                _, role, text = rows[i]
                options = [(3, "D", (), state)]
                if found[i] not in ("blank", "duplicate"):
                    cut = int(found[i] == "truncated")
                    first = role[:1]
                    if first == after[state] or (first == "s" and state == ""):
                        options.append((cut, "K", (f"{role}:{text}",), first))
                    options.append((2 + cut, "R", (f"{names[after[state]]}:{text}",), after[state]))
                options = [(c + later[s][0], e + later[s][1], line + later[s][2]) for c, e, line, s in options if later[s]]
            here[state] = min(options, default=None)
        for _ in range(3):
            for state in here:
                nxt = here[after[state]]
                if nxt:
                    own = (nxt[0] + 2, "I" + nxt[1], (names[after[state]] + ":",) + nxt[2])
                    here[state] = min(x for x in (here[state], own) if x)
        later = here
    return later[""]


def every_repair(rows):
    """All edits with at most two insertions in a gap, whose roles read as they should: the cheapest, ASCII-least."""
    found = faults(rows)
    gaps = [()] + [c for n in (1, 2) for c in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}
    best = None
    edits = [["D"] + (["K", "Ru", "Ra"] if f not in ("blank", "duplicate") else []) for f in found]
    for chosen in itertools.product(*edits):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines, roles = 0, "", [], ""
            for i in range(len(rows) + 1):
                for a in added[i]:
                    cost, audit, lines, roles = cost + 2, audit + "I", [*lines, names[a] + ":"], roles + a
                if i < len(rows):
                    e = chosen[i]
                    cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and found[i] == "truncated")
                    audit += e[0]
                    if e == "K":
                        lines, roles = [*lines, f"{rows[i][1]}:{rows[i][2]}"], roles + (rows[i][1][:1] or "-")
                    elif e[0] == "R":
                        lines, roles = [*lines, f"{names[e[1]]}:{rows[i][2]}"], roles + e[1]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, tuple(lines)
    return best


def brute(rows):
    out = {}
    for conv, own in damage(rows).items():
        found = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        first = [r[:1] for _, r, _ in own]
        cost, audit, lines = best_repair(own)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, rows, ddl="conv_id long, turn long, role string, text string", parts=3):
    df = spark.createDataFrame(rows, ddl).repartition(parts)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in R.repair(df).collect()}


def test_plain_search_equals_every_sequence(rng):
    for _ in range(25):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", " ", "c!"])) for i in range(rng.randint(0, 3))]
        assert best_repair(rows) == every_repair(rows)


def random_rows(rng, conversations, longest):
    return [(c, t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]), rng.choice(["yes.", "no", "why?", " ", f"text {t}.", f"cut {t}"]))
            for c in range(conversations) for t in range(rng.randint(1, longest))]


def test_random_conversations(spark, rng):
    rows = random_rows(rng, 300, 12)
    assert got(spark, rows) == brute(rows)


def test_long_conversations_in_segments(spark, rng, monkeypatch):
    rows = random_rows(rng, 4, 150) + [(9, t, rng.choice(["user", "assistant"]), f"t{t % 90}.") for t in range(900)]
    whole = got(spark, rows)
    assert whole == brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert got(spark, rows) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("size", [1, 3, 7])
def test_segments_of_any_size_join_up(rng, size):
    """Cost tables and states of the pieces give the path of the whole."""
    for _ in range(40):
        codes = np.array([rng.randrange(16) for _ in range(rng.randint(1, 30))], np.int64)
        held = codes[None]
        values = R.costs(held, R.END[None, :, None])[..., 0]
        seg, letter, at, behind, _ = R.least_paths(held, np.array([len(codes)]), values, np.array([True]), np.array([0]))
        pieces = [codes[i:i + size] for i in range(0, len(codes), size)]
        exits = [R.END]
        for p in pieces[:0:-1]:
            exits.append(R.costs(p[None], exits[-1][None, :, None])[0, 0, :, 0])
        state, found, spent = 0, [], 0
        for p, e in zip(pieces, exits[::-1]):
            v = R.costs(p[None], e[None, :, None])[..., 0]
            _, own, _, _, final = R.least_paths(p[None], np.array([len(p)]), v, np.array([e is R.END]), np.array([state]))
            spent += v[0, 0, state] - e[final[0]]
            state = final[0]
            found += own.tolist()
        assert found == letter.tolist() and spent == values[0, 0, 0]


def test_corner_rows(spark):
    rows = [(None, 1, "user", "hi."), (None, 2, "assistant", None), (1, None, "user", "a."), (1, None, None, "b."), (2, None, None, None),
            (3, 5, "user", "same."), (3, 5, "user", "same."), (3, 5, "user", "same."), (3, 9, "assistant", "x"), (4, 1, "", "y."),
            (5, 1, "system", "only."), (6, 3, "user", "w " * 40_000), (6, 4, "assistant", "é日."), (7, -3, "user", "n."), (7, 4, "assistant", "m!")]
    rows += [(c, t, "user", "q.") for c in range(100, 160) for t in range(2)]
    assert got(spark, rows) == brute(rows)
    assert any(v[-1] == hashlib.sha256(b"").hexdigest() and v[:-2] == (0,) * 6 for v in got(spark, [(c, 0, "user", "q.") for c in range(60)]).values())
    assert got(spark, rows, parts=1) == brute(rows)


def test_a_text_that_reads_null_is_no_null(spark):
    rows = [(c, t, "user", "a.") for c in ("null", None, "", " ") for t in (1, 2)]
    found = got(spark, rows, "conv_id string, turn long, role string, text string")
    assert set(found) == {"null", None, "", " "} and found == brute(rows)


def test_hot_conversation_and_repeated_rows(spark):
    rows = [(1, 1, "user", "same.")] * 3000 + [(2, t, "user", "again.") for t in range(3000)] + [(3, 1, "user", "a."), (3, 2, "assistant", "b.")]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert got(spark, []) == {}
    df = spark.createDataFrame([(1, 1, "user", "a.", 5, "x"), (1, 2, "assistant", "b.", 5, "y")], "conv_id long, turn long, role string, text string, copies int, i string")
    assert R.repair(df).count() == 1


def test_given_table(spark):
    df = spark.read.parquet(f"{SF_MID}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in R.repair(df).collect()} == brute(rows)
