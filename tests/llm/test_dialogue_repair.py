import hashlib
import random
import re

import duckdb

from carepulse.llm import dialogue_repair as repair
from carepulse.llm.queries import ORACLE_SQL, op13_dialogue_repair

EMPTY = hashlib.sha256(b"").hexdigest()


def every_repair(rows):
    """(cost, audit, repaired) of all repairs with at most two insertions in a row; rows are (initial, fault)."""
    out = []

    def go(i, cost, audit, roles):
        if i == len(rows):
            for k in range(3):
                for tail in ([], ["u"], ["a"], ["u", "a"], ["a", "u"]):
                    if len(tail) == k and re.fullmatch("(s?(ua)+)?", "".join(roles + tail)):
                        out.append((cost + 5 * k, audit + "I" * k))
            return
        initial, fault = rows[i]
        for ins in ([], ["u"], ["a"], ["u", "a"], ["a", "u"]):
            c, a, r = cost + 5 * len(ins), audit + "I" * len(ins), roles + ins
            go(i + 1, c + 2, a + "D", r)
            if fault in "-t":
                extra = 5 if fault == "t" else 0
                go(i + 1, c + extra, a + "K", r + [initial])
                for role in "ua":
                    go(i + 1, c + 1 + extra, a + "R", r + [role])

    go(0, 0, "", [])
    return min(out)


def by_suffixes(rows):
    """The best repair, from the last row to the first, for every role written before."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for initial, fault in reversed(rows):
        new = {}
        for state in best:
            ways = [(best[state][0] + 2, "D" + best[state][1])]
            if fault in "-t":
                extra = 5 if fault == "t" else 0
                c, a = best[after[state]]
                ways.append((c + 1 + extra, "R" + a))
                if initial == after[state] or (initial == "s" and state == ""):
                    c, a = best[initial]
                    ways.append((c + extra, "K" + a))
            new[state] = min(ways)
        for _ in range(2):
            new = {s: min(w, (new[after[s]][0] + 5, "I" + new[after[s]][1])) for s, w in new.items()}
        best = new
    return best[""]


def searched(rows, window):
    ways = None
    for lo in range(0, max(1, len(rows)), window):
        part = rows[lo : lo + window]
        found = [list(repair.search("".join(r[0] for r in part), "".join(r[1] for r in part), s)) for s in range(4)]
        ways = found if ways is None else repair.join(ways, found)
    return repair.close(ways)


def test_search_against_all_repairs():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(60):
            rows = [(rng.choice("sua?"), rng.choice("--tbd")) for _ in range(n)]
            assert by_suffixes(rows) == every_repair(rows) == searched(rows, 32)


def test_windows_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(rng.choice("ssuuaa?"), rng.choice("---tbd")) for _ in range(rng.randrange(40))]
        want = by_suffixes(rows)
        assert searched(rows, rng.choice([1, 2, 5, 16])) == want


def plain(rows):
    """The report of one conversation's rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = by_suffixes([(i if i in ("s", "u", "a") else "?", f) for i, f in zip(initials, faults)])
    left, lines, state = iter(rows), [], ""
    for e in audit:
        row = None if e == "I" else next(left)
        if e == "D":
            continue
        state = row[1][:1] if e == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        role = row[1] if e == "K" else {"u": "user", "a": "assistant"}[state]
        lines.append(f"{role}:{row[2] if row else ''}")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(c) for c in "bdt"), illegal, cost, audit, digest)


def reported(spark, rows, schema="conv_id long, turn long, role string, text string"):
    found = repair.Repair(spark.createDataFrame(rows, schema)).report().collect()
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def test_report_of_awkward_rows(spark):
    rows = [
        (1, None, "user", "no turn."),
        (1, 0, "system", "be kind."),
        (1, 2, "user", "hi!"),
        (1, 2, "user", "hi!"),
        (1, 5, "assistant", "cut off"),
        (2, 1, None, None),
        (2, None, "", "role without initial."),
        (None, 3, "bot", "unknown role  "),
        (None, 4, "User", "capital?\n "),
        (3, 7, "user", "x" * 100_000 + "."),
    ]
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")
    want = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        want[conv] = plain([(t, " " if role is None else role, " " if text is None else text) for _, t, role, text in mine])
    assert reported(spark, rows) == want


def test_empty_table_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, conv int, n int, audit string, fault string, place int"
    assert reported(spark, [], schema) == {}
    assert reported(spark, [(1, 0, "user", "a.", 1, 2, "x", "y", 3), (1, 1, "assistant", "b.", 0, 0, "", "", 0)], schema)[1][5:7] == (0, "KK")


def test_one_conversation_of_many_windows(spark):
    rng = random.Random(5)
    rows = [(9, i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"{rng.randrange(900)}{rng.choice('..!?x ')}") for i in range(3000)]
    rows += [(i + 10, 0, "user", "alone.") for i in range(20)]
    got = reported(spark, rows)
    assert got[9] == plain([r[1:] for r in rows[:3000]])
    assert all(got[i + 10][4:7] == (0, 2, "D") for i in range(20))


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (1, 3, "user", "tail")]
    turns = repair.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repaired_turns().orderBy("place").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in turns] == [("K", "user", "b."), ("K", "assistant", "c.")]


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    got = c.execute(ORACLE_SQL["op13_dialogue_repair"])
    names = [d[0] for d in got.description]
    mine = op13_dialogue_repair(spark, sf)
    assert sorted(map(tuple, mine.select(names).collect())) == sorted(got.fetchall())
    assert EMPTY == repair.EMPTY_DIGEST
