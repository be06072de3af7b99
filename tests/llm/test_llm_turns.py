"""Conversation repair against all edit sequences of short conversations, and pieces against whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from tallymark.llm import turn_repair
from tallymark.llm.shared import table

GRAMMAR = re.compile(r"(s?(ua)+)?")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def after_damage(rows):
    """Contract damage of (conv_id, turn, role, text), by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def flaws_of(turns):
    out = []
    for i, (_, role, text) in enumerate(turns):
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        seen = (role, text) in [t[1:] for t in turns[:i]]
        out.append("b" if not signs else "d" if seen else "t" if signs[-1] not in ".!?" else "")
    return out


def every_repair(turns, flaws):
    """Least (cost, audit, lines) over all edits of every turn and up to two insertions in every gap."""
    best = None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    choices = [["D"] if f in ("b", "d") else ["D", "K", "Ru", "Ra"] for f in flaws]
    for edits in product(*choices):
        base = []
        for (_, role, text), f, e in zip(turns, flaws, edits):
            name = {"Ru": "user", "Ra": "assistant"}.get(e, role)
            cost = 3 if e == "D" else (2 if e[0] == "R" else 0) + (f == "t")
            base.append((cost, e[0], None if e == "D" else f"{name}:{text}"))
        floor = sum(c for c, _, _ in base)
        if best and floor > best[0]:
            continue
        for gaps in product(inserts, repeat=len(turns) + 1):
            cost = floor + 2 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for i, gap in enumerate(gaps):
                for x in gap:
                    audit += "I"
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if i < len(base):
                    audit += base[i][1]
                    if base[i][2] is not None:
                        lines.append(base[i][2])
            if GRAMMAR.fullmatch("".join(x[:1] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def plain(rows, repair):
    out = {}
    damaged = after_damage(rows)
    for conv in {r[0] for r in rows}:
        turns = damaged.get(conv, [])
        flaws = flaws_of(turns)
        numbers = {t[0] for t in turns if t[0] is not None}
        initials = [t[1][:1] for t in turns]
        cost, audit, lines = repair(turns, flaws)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            flaws.count("b"),
            flaws.count("d"),
            flaws.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def by_costs(turns, flaws):
    """Least repair of a conversation of any length: costs to the end first, then the least letters from the front."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}
    n, far = len(turns), float("inf")
    names = {"u": "user", "a": "assistant"}

    def moves(i, top):
        """(letter, cost, next place, next top, line) of one edit."""
        for x, after in step[top].items():
            if x in names:
                yield "I", 2, i, after, f"{names[x]}:"
        if i < n:
            _, role, text = turns[i]
            yield "D", 3, i + 1, top, None
            if flaws[i] not in ("b", "d"):
                for x, after in step[top].items():
                    if role[:1] == x:
                        yield "K", flaws[i] == "t", i + 1, after, f"{role}:{text}"
                    if x in names:
                        yield "R", 2 + (flaws[i] == "t"), i + 1, after, f"{names[x]}:{text}"

    left = [{t: 0 if i == n and t in ("", "p") else far for t in step} for i in range(n + 1)]
    for i in range(n, -1, -1):
        for _ in range(5):
            for t in step:
                left[i][t] = min([left[i][t], *(c + left[j][u] for _, c, j, u, _ in moves(i, t))])
    i, top, audit, lines = 0, "", "", []
    while i < n or left[i][top]:
        letter, _, j, u, line = min(m for m in ((*m[:4], m[4] or "") for m in moves(i, top)) if m[1] + left[m[2]][m[3]] == left[i][top])
        audit += letter
        if letter != "D":
            lines.append(line)
        i, top = j, u
    return left[0][""], audit, lines


def rows_of(seed, conversations, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " ", "", "Go on!  \n", None, "a b.", "x"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", None, "u", ""]
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, turns)):
            turn = rng.choice([t, t, t, t, t + 2, t - 1, None])
            out.append((c, turn, rng.choice(roles[: rng.choice([2, 5, 10])]), rng.choice(texts)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "conv_id long, turn long, role string, text string, seq int, audit string")


def result(df, **options):
    got = turn_repair.damaged_and_repaired(df, **options)
    assert got.columns == COLUMNS
    rows = got.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_every_edit_sequence_of_short_conversations(spark):
    rows = rows_of(1, 150, 4)
    want = plain(rows, every_repair)
    assert want == plain(rows, by_costs)
    for piece in (1, 2, 512):
        assert result(frame(spark, rows), piece=piece) == want


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_pieces_of_long_conversations(spark, piece):
    rows = rows_of(2, 12, 300) + [(None, *r[1:]) for r in rows_of(3, 1, 90)] + [(50, None, "user", "Hi.")] * 3
    assert result(frame(spark, rows).repartition(5), piece=piece) == plain(rows, by_costs)


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    want = plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], by_costs)
    assert result(df) == want


def test_dropped_and_no_conversations(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert result(frame(spark, [(gone, 0, "user", "Hello.")])) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert result(frame(spark, [])) == {}
