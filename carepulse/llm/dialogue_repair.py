"""Conversation structure repair by depth-first branch-and-bound.

A conversation is repaired by edits of its rows (Keep, Rerole, Delete) and inserted rows,
so that the initials of its roles read ``(s?(ua)+)?``, at the least cost; among equally
cheap repairs that whose edits' initials come first in ASCII order is taken.

What the rows written so far allow next depends only on the last role written: none,
system, user or assistant. Rows are cut into windows of ``WINDOW``; for each of these four
states before a window and each one after it, a search finds the cheapest edits. It walks
depth-first with an explicit stack. A prefix is dropped when its cost and the lower bound of
the remaining rows (by state, for any end) exceed the incumbents, or when the table of its
node (row, state) holds a prefix that is no worse in (cost, edits). Two prefixes of one
node and one cost are never prefixes of each other (the longer one has more insertions, so
it costs more), so comparing them settles every continuation. The windows of a
conversation are then joined, ``FAN`` at a time, until one is left: joining is
associative, so a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, number_rows

WINDOW = 32
FAN = 64
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, TRUNCATED_COST, INSERT_COST = 1, 2, 5, 5
#: States by the role written last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after writing a user or assistant row: who may speak next is fixed.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEPS = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Insertions that complete a conversation that ends in this state.
_CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_FAULTS = {"blank": "b", "duplicate": "d", "truncated": "t"}

Way = tuple[int, str]


@lru_cache(maxsize=50_000)
def search(initials: str, faults: str, start: int) -> tuple[Way | None, ...]:
    """The cheapest (cost, edits) from state ``start`` to each state at the end of the window.

    ``initials`` has a role initial for every row (any character that is none of s, u, a
    fits nowhere), ``faults`` one of ``b`` (blank), ``d`` (duplicate), ``t`` (truncated)
    and ``-``. Insertions after the last row are left to what follows.
    """
    n = len(initials)
    # What row i and all later ones cost at least, by the state before row i, if any end will do.
    bound = [[0] * 4 for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        extra = TRUNCATED_COST * (faults[i] == "t")
        here = [_least(bound[i + 1], s, initials[i], extra) if faults[i] in "-t" else bound[i + 1][s] + DELETE_COST for s in range(4)]
        bound[i] = [min(c, here[_NEXT[s]] + INSERT_COST, here[ASSISTANT] + 2 * INSERT_COST if s != ASSISTANT else c) for s, c in enumerate(here)]
    best: list[Way | None] = [None] * 4
    best[start] = (DELETE_COST * n, DELETE * n)  # the first incumbent
    # Only one path ends in a state that no user or assistant row can lead to.
    if start == NOTHING:
        for i in range(n):
            if initials[i] == "s" and faults[i] in "-t":
                way = (DELETE_COST * (n - 1) + TRUNCATED_COST * (faults[i] == "t"), DELETE * i + KEEP + DELETE * (n - 1 - i))
                if best[SYSTEM] is None or way < best[SYSTEM]:
                    best[SYSTEM] = way
    seen: dict[tuple[int, int], Way] = {}
    stack: list[tuple[int, int, int, str]] = [(0, start, 0, "")]
    limit = _limit(best)
    while stack:
        i, state, cost, edits = stack.pop()
        if cost + bound[i][state] > limit:
            continue
        known = seen.get((i, state))
        if known is not None and known <= (cost, edits):
            continue
        seen[i, state] = (cost, edits)
        if i == n:
            if best[state] is None or (cost, edits) < best[state]:
                best[state] = (cost, edits)
                limit = _limit(best)
            continue
        role, fault = initials[i], faults[i]
        more = [(i, _NEXT[state], cost + INSERT_COST, edits + INSERT), (i + 1, state, cost + DELETE_COST, edits + DELETE)]
        if fault in "-t":
            extra = TRUNCATED_COST if fault == "t" else 0
            more.append((i + 1, _NEXT[state], cost + REROLE_COST + extra, edits + REROLE))
            kept = _KEEPS.get((role, state))
            if kept is not None:
                more.append((i + 1, kept, cost + extra, edits + KEEP))
        more.sort(key=lambda m: -m[2])  # the cheapest is taken up first
        stack += more
    return tuple(best)


def _least(later: list[int], state: int, initial: str, extra: int) -> int:
    """The least cost from ``state`` before a row that may stay, without insertions."""
    kept = _KEEPS.get((initial, state))
    ways = [later[state] + DELETE_COST, later[_NEXT[state]] + REROLE_COST + extra]
    return min(ways if kept is None else [*ways, later[kept] + extra])


def _limit(best: list[Way | None]) -> int:
    """No path dearer than this can be the best one to any end, insertions that follow included."""
    costs = {s: w[0] for s, w in enumerate(best) if w is not None}
    before = min(costs.get(NOTHING, 1 << 60), costs.get(SYSTEM, 1 << 60)) + INSERT_COST
    to_user = min(costs.get(USER, 1 << 60), before, costs.get(ASSISTANT, 1 << 60) + INSERT_COST)
    to_assistant = min(costs.get(ASSISTANT, 1 << 60), to_user + INSERT_COST)
    return max(min(to_user, to_assistant + INSERT_COST), to_assistant)


def join(first: list[list[Way | None]], second: list[list[Way | None]]) -> list[list[Way | None]]:
    """The ways through two neighbouring windows."""
    out: list[list[Way | None]] = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for m in range(4):
            a = first[s][m]
            if a is None:
                continue
            for e in range(4):
                b = second[m][e]
                if b is None:
                    continue
                old, cost = out[s][e], a[0] + b[0]
                if old is None or cost < old[0] or (cost == old[0] and a[1] + b[1] < old[1]):
                    out[s][e] = (cost, a[1] + b[1])
    return out


def close(ways: list[list[Way | None]]) -> Way:
    """The cheapest complete repair, from nothing written to an end the pattern allows."""
    return min((w[0] + INSERT_COST * _CLOSING[e], w[1] + INSERT * _CLOSING[e]) for e, w in enumerate(ways[NOTHING]) if w is not None)


_WAYS = T.ArrayType(T.StringType())  # 16 entries: "cost:edits" by start and end state, null for none
_WINDOW = T.StructType(
    [
        T.StructField("conv", T.LongType()),
        T.StructField("null_conv", T.BooleanType()),
        T.StructField("window", T.LongType()),
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
        T.StructField("illegal", T.LongType()),
        T.StructField("ways", _WAYS),
    ]
)


def _pack(ways) -> list[str | None]:
    return [None if w is None else f"{w[0]}:{w[1]}" for row in ways for w in row]


def _unpack(packed: list[str | None]) -> list[list[Way | None]]:
    flat = [None if p is None else (int(p[: p.index(":")]), p[p.index(":") + 1 :]) for p in packed]
    return [flat[4 * s : 4 * s + 4] for s in range(4)]


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _solve_windows(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            roles, faults = [x["role"] for x in r["rows"]], "".join(x["fault"] for x in r["rows"])
            initials = "".join(x if x in "sua" and x else "?" for x in roles)
            starts = [NOTHING] if r["window"] == 0 else range(4)
            ways = [search(initials, faults, s) if s in starts else (None,) * 4 for s in range(4)]
            illegal = sum(_illegal(x, y) for x, y in zip(roles, roles[1:]))
            out.append((r["conv"], r["null_conv"], r["window"], roles[0], roles[-1], illegal, _pack(ways)))
        yield _window_batch(out)


def _join_windows(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            parts = r["parts"]
            ways, illegal = _unpack(parts[0]["ways"]), parts[0]["illegal"]
            for p, q in zip(parts, parts[1:]):
                ways = join(ways, _unpack(q["ways"]))
                illegal += q["illegal"] + _illegal(p["last"], q["first"])
            out.append((r["conv"], r["null_conv"], r["window"], parts[0]["first"], parts[-1]["last"], illegal, _pack(ways)))
        yield _window_batch(out)


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=_WINDOW.names)


def _apply(batches):
    """Streams (conversation, edits), then its rows in order, into the repaired rows."""
    edits, at, state, place = "", 0, NOTHING, 0
    for b in batches:
        out: list[tuple] = []

        def put(conv: tuple, edit: str, role: str, text: str) -> None:
            nonlocal place
            out.append((*conv, place, edit, role, text))
            place += 1

        for conv, null_conv, n, audit, role, text in zip(*[c.to_pylist() for c in b.columns]):
            if n < 0:  # a conversation begins
                edits, at, state, place = audit, 0, NOTHING, 0
            else:
                edit, at = edits[at], at + 1
                if edit == REROLE:
                    state = _NEXT[state]
                    put((conv, null_conv), edit, "user" if state == USER else "assistant", text)
                elif edit == KEEP:
                    state = _KEEPS[role[:1], state]
                    put((conv, null_conv), edit, role, text)
            while at < len(edits) and edits[at] == INSERT:
                state, at = _NEXT[state], at + 1
                put((conv, null_conv), INSERT, "user" if state == USER else "assistant", "")
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()))],
            names=["conv", "null_conv", "place", "edit", "role", "text"],
        )


def _digest(batches):
    """One digest of ``role:text`` lines per conversation, of rows that come in order."""
    current, digest = None, None
    for b in batches:
        done: list[tuple] = []
        for conv, null_conv, place, role, text in zip(*[b.column(n).to_pylist() for n in ("conv", "null_conv", "place", "role", "text")]):
            if place == 0:
                if current is not None:
                    done.append((*current, digest.hexdigest()))
                current, digest = (conv, null_conv), hashlib.sha256()
            digest.update((("\n" if place else "") + f"{role}:{text}").encode())
        yield _digest_batch(done)
    if current is not None:
        yield _digest_batch([(*current, digest.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.string()))], names=["conv", "null_conv", "repaired_sha256"]
    )


class Repair:
    """The repair of every conversation of ``turns``: ``report()`` and the ``repaired_turns()``.

    Rows are taken by turn (nulls first), then role, text and ``copy_col``; null roles and
    texts are one space, null conversations one conversation. A row's first fault counts:
    blank (no word character), duplicate (role and text seen earlier in the conversation),
    truncated (its last such character is none of ``.!?``). A role without characters has
    no initial and fits nowhere; repeated rows are duplicates of the first of them. Further
    columns are ignored whatever their names; an empty table gives no rows.

    Conversations of any length and very long texts are streamed, not gathered; applying
    the edits of one conversation, and its digest, is by its nature done in order.
    """

    def __init__(self, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copy_col: str | None = None):
        rows = turns.select(
            F.col(conv_col).cast("long").alias("conv"),
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
            (F.col(copy_col) if copy_col else F.lit(0)).cast("int").alias("copy"),
        )
        self.numbered = number_rows(rows, ["conv"], ["turn", "role", "text", "copy"], "n").select(
            F.coalesce("conv", F.lit(0)).alias("conv"), F.isnull("conv").alias("null_conv"), "n", "turn", "role", "text"
        )
        codes = self.numbered.select(
            *_KEY,
            "n",
            "turn",
            F.substring("role", 1, 1).alias("role"),
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("same"),
            F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1)).alias("end"),
        )
        # The first row of each (conversation, role, text): partial minima, so a text that is
        # repeated very often is reduced in each task.
        first = codes.groupBy(*_KEY, "same").agg(F.min("n").alias("first_n"))
        fault = (
            F.when(F.col("end") == "", "b").when(F.col("n") > F.col("first_n"), "d").when(~F.col("end").isin(".", "!", "?"), "t").otherwise("-")
        )
        self.coded = cut(codes.join(first, [*_KEY, "same"]).select(*_KEY, "n", "turn", "role", fault.alias("fault")))
        self.solved = cut(self._windows().mapInArrow(_close_windows, _SOLVED))

    def _windows(self) -> DataFrame:
        windows = (
            self.coded.groupBy(*_KEY, F.expr(f"n div {WINDOW}").alias("window"))
            .agg(F.array_sort(F.collect_list(F.struct("n", "role", "fault"))).alias("rows"))
            .mapInArrow(_solve_windows, _WINDOW)
        )
        longest = self.coded.agg(F.max("n")).first()[0]
        count = 1 if longest is None else longest // WINDOW + 1
        while count > 1:
            windows = (
                windows.groupBy(*_KEY, F.expr(f"window div {FAN}").alias("window"))
                .agg(F.array_sort(F.collect_list(F.struct("window", "first", "last", "illegal", "ways"))).alias("parts"))
                .mapInArrow(_join_windows, _WINDOW)
            )
            count = (count + FAN - 1) // FAN
        return windows

    def repaired_turns(self) -> DataFrame:
        """(conv_id, place, edit, role, text): the rows of the repaired conversations."""
        return self._applied().select(_conv_id(), "place", "edit", "role", "text")

    def _applied(self) -> DataFrame:
        none = F.lit(None).cast("string")
        stream = self.solved.select(*_KEY, F.lit(-1).cast("long").alias("n"), "audit", none.alias("role"), none.alias("text")).unionByName(
            self.numbered.select(*_KEY, "n", none.alias("audit"), "role", "text")
        )
        schema = "conv long, null_conv boolean, place long, edit string, role string, text string"
        return stream.repartition(*_KEY).sortWithinPartitions(*_KEY, "n").mapInArrow(_apply, schema)

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

        ``illegal`` counts neighbours whose role initials are none of su, ua, au, ``gaps``
        the turn numbers missing between the least and the greatest.
        """
        faults = self.coded.groupBy(*_KEY).agg(
            *[F.count_if(F.col("fault") == code).alias(name) for name, code in _FAULTS.items()],
            F.max("turn").alias("top"),
            F.min("turn").alias("bottom"),
        )
        turns = self.coded.select(*_KEY, "turn").distinct().groupBy(*_KEY).agg(F.count("turn").alias("distinct_turns"))
        digests = self._applied().mapInArrow(_digest, "conv long, null_conv boolean, repaired_sha256 string")
        joined = self.solved.join(faults, _KEY).join(turns, _KEY).join(digests, _KEY, "left")
        return joined.select(
            _conv_id(),
            F.coalesce(F.col("top") - F.col("bottom") + 1 - F.col("distinct_turns"), F.lit(0)).cast("long").alias("gaps"),
            *[F.col(c).cast("long").alias(c) for c in (*_FAULTS, "illegal", "cost")],
            "audit",
            F.coalesce("repaired_sha256", F.lit(EMPTY_DIGEST)).alias("repaired_sha256"),
        )


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
_KEY = ["conv", "null_conv"]
_SOLVED = "conv long, null_conv boolean, illegal long, cost long, audit string"


def _conv_id():
    return F.when(~F.col("null_conv"), F.col("conv")).alias("conv_id")


def _close_windows(batches):
    for b in batches:
        rows = b.to_pylist()
        ends = [close(_unpack(r["ways"])) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["conv"] for r in rows], pa.int64()),
                pa.array([r["null_conv"] for r in rows], pa.bool_()),
                pa.array([r["illegal"] for r in rows], pa.int64()),
                pa.array([e[0] for e in ends], pa.int64()),
                pa.array([e[1] for e in ends], pa.string()),
            ],
            names=["conv", "null_conv", "illegal", "cost", "audit"],
        )
