"""Conversation structure repair by generalised LR parsing over the role grammar.

Grammar: a conversation is empty or an optional system turn and one or more pairs of a user and an
assistant turn. Its LR automaton has four stack tops (``EMPTY``, ``SYSTEM``, ``USER``, ``PAIRS``; a pair is
reduced as soon as its assistant turn is shifted, so deeper symbols never tell two stacks apart). Every turn
may be kept (0), reroled to user or assistant (2) or deleted (3); a user or assistant turn without text
may be inserted anywhere (2); blank and repeated turns must be deleted, and a cut-off turn that stays costs
1 more. All these actions run at once on a graph-structured stack: stacks with equal tops are merged and
the one of least (cost, audit) stays, the audit being the edits' initials in order.

Merging is exact: of two audits of equal cost for the same turns neither begins the other (one more
letter would be one more insertion), so their order stays whatever follows.

On the cluster: turns are sorted by (conversation, turn, role, text) over all tasks, so a conversation that
holds a third of the rows is spread like any other data. A task that sees the whole of a conversation of up
to ``piece`` turns and ``chars`` characters repairs it while streaming. Conversations on the edge of a task and longer
ones become pieces; repeated turns of these are found by a shuffle of (conversation, role, text digest),
each piece is parsed from all four stack tops, a conversation's piece summaries (16 letters a turn) are
folded in order, and the repaired pieces are hashed in order as a stream. (The audit is one string and the
hash of one conversation is sequential by nature; hashing holds one piece at a time.)

Defined results: null roles and texts are one blank, as are null identifiers and turns in the row's key (they stay null
otherwise; nulls are a conversation of their own); equal turn numbers are ordered by role and text;
role initials other than s, u and a can only be reroled or deleted; conversations without rows after
damage have zeros; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import stored

EMPTY, SYSTEM, USER, PAIRS = range(4)
SHIFT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIRS}, PAIRS: {"u": USER}}
ACCEPTING = (EMPTY, PAIRS)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"
PIECE = 512
CHARS = 4_000_000

TURNS = "conv_id long, turn long, role string, text string"
DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CUT = DONE + ", seq long, turns array<struct<turn: long, role: string, text: string>>"
SUMMARY = (
    "conv_id long, seq long, blank long, duplicate long, truncated long, illegal long, least long, most long, "
    "different long, first string, last string, paths array<struct<start: int, end: int, cost: long, audit: string>>"
)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by the checksum of ``conv_id:turn`` modulo 20: 0 drops the
    row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes it a user turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text")).alias("text"),
        kind.alias("kind"),
    )
    twice = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.where("kind != 0").withColumn("time", F.explode(twice)).drop("kind", "time")


def fault(role: str, text: str, seen: bool) -> str:
    """b: blank, d: seen before, t: cut off, empty: none."""
    end = text.rstrip(SPACES)
    return "b" if not end else "d" if seen else "t" if end[-1] not in ".!?" else ""


def step(tops: dict[int, tuple[int, str]], role: str, flaw: str) -> dict[int, tuple[int, str]]:
    """The merged stack tops after one more turn; insertions before it are made here."""
    out: dict[int, tuple[int, str]] = {}

    def put(top: int, cost: int, audit: str) -> None:
        if top not in out or (cost, audit) < out[top]:
            out[top] = (cost, audit)

    for top, (cost, audit) in inserted(tops).items():
        put(top, cost + DELETE, audit + "D")
        if flaw in ("b", "d"):
            continue
        more = cost + (TRUNCATED if flaw == "t" else 0)
        for initial, after in SHIFT[top].items():
            if role[:1] == initial:
                put(after, more + KEEP, audit + "K")
            if initial in ROLES and role != ROLES[initial]:
                put(after, more + REROLE, audit + "R")
    return out


def inserted(tops: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """Stack tops with any number of insertions (more than three lead back to an earlier top)."""
    out = dict(tops)
    for _ in range(3):
        for top, (cost, audit) in list(out.items()):
            for initial, after in SHIFT[top].items():
                new = (cost + INSERT, audit + "I")
                if initial in ROLES and (after not in out or new < out[after]):
                    out[after] = new
    return out


def parse(turns: list[tuple[str, str]], start: int = EMPTY) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from one stack top to each, over turns as (role, flaw)."""
    tops = {start: (0, "")}
    for role, flaw in turns:
        tops = step(tops, role, flaw)
    return tops


def best_end(tops: dict[int, tuple[int, str]]) -> tuple[int, tuple[int, str]]:
    """The accepting top of least (cost, audit), with insertions at the end."""
    tops = inserted(tops)
    top = min((t for t in ACCEPTING if t in tops), key=tops.__getitem__)
    return top, tops[top]


def repaired(turns: list[tuple[str, str]], audit: str, top: int = EMPTY) -> list[str]:
    """``role:text`` of what the audit leaves of (role, text); roles follow from the stack tops."""
    out, left = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[next(i for i in SHIFT[top] if i in ROLES)]
        out.append(f"{role}:{text}")
        top = SHIFT[top][role[0]]
    return out


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


def repair(conv_id: int | None, turns: list[tuple]) -> dict:
    """Result row of a whole conversation of (turn, role, text), in order."""
    seen: set[tuple] = set()
    flaws = []
    for _, role, text in turns:
        flaws.append(fault(role, text, (role, text) in seen))
        seen.add((role, text))
    _, (cost, audit) = best_end(parse([(t[1], f) for t, f in zip(turns, flaws)]))
    known = {t[0] for t in turns if t[0] is not None}
    text = "\n".join(repaired([t[1:] for t in turns], audit))
    return {
        "conv_id": conv_id,
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": flaws.count("b"),
        "duplicate": flaws.count("d"),
        "truncated": flaws.count("t"),
        "illegal": illegal_pairs([t[1] for t in turns]),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
    }


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def stream(turns: DataFrame, piece: int, chars: int) -> DataFrame:
    """Result rows of the conversations that one task saw whole, and pieces (``turns`` set) of the others."""

    schema = _arrow(CUT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        out: list[dict] = []
        held: list[tuple] = []
        conv_id, size, whole = None, 0, False

        def cut() -> None:
            nonlocal seq, held, size
            cols = [{"turn": t, "role": r, "text": x} for t, r, x in held]
            out.append({"conv_id": conv_id, "seq": part << 32 | seq, "turns": cols})
            seq, held, size = seq + 1, [], 0

        started = False
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if not started or row[0] != conv_id:
                    if started:
                        if whole:
                            out.append(repair(conv_id, held))
                            held, size = [], 0
                        elif held:
                            cut()
                    # the first conversation of a task may have begun in another one
                    conv_id, whole, started = row[0], started, True
                held.append(row[1:])
                size += len(row[3])
                if len(held) >= piece or size >= chars:
                    whole = False
                    cut()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if held:
            cut()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return turns.mapInArrow(work, CUT)


def summaries(pieces: DataFrame) -> DataFrame:
    """Counts, ends and paths between all stack tops of every piece; and ``flaws`` for the text."""
    places = pieces.select("conv_id", "seq", F.posexplode("turns").alias("pos", "t")).select(
        "conv_id", "seq", "pos", F.struct("t.role", F.sha2(F.col("t.text"), 256).alias("text")).alias("said")
    )
    first = places.groupBy("conv_id", "said").agg(F.min(F.struct("seq", "pos")).alias("at"))
    known = first.select("at.seq", "at.pos").groupBy("seq").agg(F.collect_list("pos").alias("new"))

    schema = _arrow(SUMMARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turns, new = row["turns"], set(row["new"] or ())
                flaws = [fault(t["role"], t["text"], i not in new) for i, t in enumerate(turns)]
                roles = [t["role"] for t in turns]
                numbers = {t["turn"] for t in turns if t["turn"] is not None}
                paths = [
                    {"start": start, "end": end, "cost": cost, "audit": audit}
                    for start in range(4)
                    for end, (cost, audit) in parse(list(zip(roles, flaws)), start).items()
                ]
                one = {
                    "conv_id": row["conv_id"],
                    "seq": row["seq"],
                    "blank": flaws.count("b"),
                    "duplicate": flaws.count("d"),
                    "truncated": flaws.count("t"),
                    "illegal": illegal_pairs(roles),
                    "least": min(numbers, default=None),
                    "most": max(numbers, default=None),
                    "different": len(numbers),
                    "first": roles[0][:1],
                    "last": roles[-1][:1],
                    "paths": paths,
                }
                yield pa.RecordBatch.from_pylist([one], schema)

    return pieces.select("conv_id", "seq", "turns").join(known, "seq", "left").mapInArrow(work, SUMMARY)


FOLDED = DONE.replace(", repaired_sha256 string", "") + ", steps array<struct<seq: long, start: int, audit: string>>"


def folded(pieces: DataFrame) -> DataFrame:
    """A row per conversation from its piece summaries in order, and what each piece has to do."""

    schema = _arrow(FOLDED)

    def work(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["seq"])
        tops: dict[int, tuple[int, tuple]] = {EMPTY: (0, ())}
        illegal, different, last = 0, 0, None
        for row in rows:
            out: dict[int, tuple[int, tuple]] = {}
            for path in row["paths"]:
                if path["start"] in tops:
                    cost, chain = tops[path["start"]]
                    new = (cost + path["cost"], (chain, row["seq"], path["start"], path["audit"]))
                    if path["end"] not in out or _less(new, out[path["end"]]):
                        out[path["end"]] = new
            tops = out
            illegal += row["illegal"]
            different += row["different"]
            if last is not None:
                illegal += last["last"] + row["first"] not in LEGAL
                different -= last["most"] is not None and last["most"] == row["least"]
            last = row if row["least"] is not None or last is None else row | {"most": last["most"]}
        ends = [
            (found, origin)
            for origin, (cost, chain) in tops.items()
            for top, found in inserted({origin: (cost, _joined(chain))}).items()
            if top in ACCEPTING
        ]
        (cost, audit), origin = min(ends)
        steps, chain = [], tops[origin][1]
        added = audit[len(_joined(chain)) :]
        while chain:
            chain, seq, start, own = chain
            steps.append({"seq": seq, "start": start, "audit": own})
        steps.reverse()
        steps[-1]["audit"] += added
        least = [r["least"] for r in rows if r["least"] is not None]
        most = [r["most"] for r in rows if r["most"] is not None]
        total = lambda c: sum(r[c] for r in rows)
        one = {
            "conv_id": rows[0]["conv_id"],
            "gaps": max(most) - min(least) + 1 - different if least else 0,
            "blank": total("blank"),
            "duplicate": total("duplicate"),
            "truncated": total("truncated"),
            "illegal": illegal,
            "cost": cost,
            "audit": audit,
            "steps": steps,
        }
        return pa.Table.from_pylist([one], schema)

    return pieces.groupBy("conv_id").applyInArrow(work, FOLDED)


def _less(a: tuple[int, tuple], b: tuple[int, tuple]) -> bool:
    """Order by cost, then by audit; chains of pieces are compared from where they part."""
    if a[0] != b[0]:
        return a[0] < b[0]
    (one, two), parts = (a[1], b[1]), []
    while one is not two:
        parts.append((one[3], two[3]))
        one, two = one[0], two[0]
    return next((x < y for x, y in reversed(parts) if x != y), False)


def _joined(chain: tuple) -> str:
    parts = []
    while chain:
        chain, _, _, own = chain
        parts.append(own)
    return "".join(reversed(parts))


def hashed(pieces: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the repaired pieces of each conversation, hashed in order."""
    steps = whole.select("conv_id", F.explode("steps").alias("s")).select("conv_id", "s.seq", "s.start", "s.audit")
    rows = pieces.select("seq", "turns").join(steps, "seq")

    text_schema, sha_schema = _arrow("conv_id long, seq long, text binary"), _arrow("conv_id long, repaired_sha256 string")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turns = [(t["role"], t["text"]) for t in row["turns"]]
                lines = repaired(turns, row["audit"], row["start"])
                raw = "".join(f"\n{x}" for x in lines).encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "seq": row["seq"], "text": raw}], text_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, fresh = None, None, True
        for batch in batches:
            out = []
            for conv_id, raw in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist()):
                if state is None or conv_id != now:
                    if state is not None:
                        out.append({"conv_id": now, "repaired_sha256": state.hexdigest()})
                    now, state, fresh = conv_id, hashlib.sha256(), True
                if raw:
                    state.update(raw[1:] if fresh else raw)
                    fresh = False
            yield pa.RecordBatch.from_pylist(out, sha_schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": state.hexdigest()}], sha_schema)

    ordered = rows.mapInArrow(text, "conv_id long, seq long, text binary").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "seq").mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_conversations(turns: DataFrame, piece: int = PIECE, chars: int = CHARS) -> DataFrame:
    """A row per conversation of (conv_id, turn, role, text) without nulls in role and text."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.rand(1)]
    result = stored(stream(turns.select("conv_id", "turn", "role", "text").orderBy(*order), piece, chars), "turn-pieces")
    names = [c.split()[0] for c in DONE.split(", ")]
    done = result.where(F.col("turns").isNull()).select(names)
    pieces = result.where(F.col("turns").isNotNull())
    whole = stored(folded(summaries(pieces)), "turn-conversations")
    shas = hashed(pieces, whole).withColumnRenamed("conv_id", "of")
    rest = whole.join(shas, F.col("conv_id").eqNullSafe(F.col("of"))).select(names)
    return done.union(rest)


def damaged_and_repaired(rows: DataFrame, **options) -> DataFrame:
    """Every conversation of ``rows``, damaged and repaired again."""
    found = repair_conversations(damaged(rows), **options).withColumnRenamed("conv_id", "of")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
