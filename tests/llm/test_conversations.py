import functools
import hashlib
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F
from rallyframe.llm import conversation_repair
from rallyframe.llm.common import table
from rallyframe.llm.queries import QUERIES

SPACE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    """(conv_id, turn, role, text, present) by the contract's wording."""
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        case, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        yield from [(conv, turn, "user" if case == 4 else role, text, case != 0)] * (2 if case == 3 else 1)


def plain_repair(rows):
    """Report of one conversation's rows (turn, role, text) in order; the search goes from the end, with the audits written out."""
    faults, seen = [], set()
    for _, role, text in rows:
        rest = text.strip(SPACE)
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    due = lambda said: "a" if said == "u" else "u"

    @functools.cache
    def best(i, said, inserts=0):
        """Least (cost, audit) from row i on, if the last role said is `said` ('' for none)."""
        ways = [(0, "")] if i == len(rows) and said in ("", "a") else []
        if inserts < 3:
            cost, audit = best(i, due(said), inserts + 1)
            ways.append((cost + 2, "I" + audit))
        if i < len(rows):
            cost, audit = best(i + 1, said)
            ways.append((cost + 3, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                cut, initial = faults[i] == "truncated", rows[i][1][:1]
                cost, audit = best(i + 1, due(said))
                ways.append((cost + 2 + cut, "R" + audit))
                if initial == due(said) or (said == "" and initial == "s"):
                    cost, audit = best(i + 1, initial)
                    ways.append((cost + cut, "K" + audit))
        return min(ways) if ways else (10**9, "")

    cost, audit = best(0, "")
    out, said, i = [], "", 0
    for edit in audit:
        role, text = rows[i][1:] if edit != "I" else ("", "")
        i += edit != "I"
        if edit != "D":
            role = role if edit == "K" else {"u": "user", "a": "assistant"}[due(said)]
            said = role[:1]
            out.append(f"{role}:{text}")
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    """By conversation, from (conv_id, turn, role, text, present)."""
    by = {}
    for conv, turn, role, text, present in rows:
        by.setdefault(conv, [])
        if present:
            by[conv].append((turn, role, text))
    return {conv: plain_repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))) for conv, r in by.items()}


def made_up_turns(conversations, seed):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(conversations)]:
        for turn in rng.sample(range(-3, 30), rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "unknown"])
            out.append((conv, None if rng.random() < 0.03 and turn == 0 else turn, role, rng.choice(["Yes.", "No!", "ok ", "  ", "", None, "Well. \n", "ñ?", "a. b"])))
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_is_the_cheapest(spark):
    rows = made_up_turns(250, 1)
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("part", "initial", "fault", "tie", "present", "copies", "copy")})
    assert got(conversation_repair.repair(conversation_repair.damage(turns), "present")) == expected(plain_damage(rows))
    undamaged = [(c, t, " " if r is None else r, " " if x is None else x, True) for c, t, r, x in rows]
    assert got(conversation_repair.repair(turns)) == expected(undamaged)


def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_conversation_repair"](spark, sf)) == expected(plain_damage(rows))


def test_repaired_turns_have_the_form(spark):
    turns = spark.createDataFrame(made_up_turns(60, 2), SCHEMA)
    digests = {c: x[-1] for c, x in got(conversation_repair.repair(turns)).items()}
    by = {c: [] for c in digests}
    for r in conversation_repair.repaired_turns(turns).orderBy("place").collect():
        by[r.conv_id].append(r)
    for conv, rows in by.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in rows)) and [r.place for r in rows] == list(range(len(rows)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows).encode()).hexdigest() == digests[conv]
        assert all((r.turn is None and r.text == "") for r in rows if r.edit == "I")


def test_long_conversations_spill(spark, monkeypatch):
    steps = conversation_repair.Steps(held=7)
    for k in range(50):
        steps.append(k)
    assert list(steps.backwards()) == list(range(49, -1, -1)) and steps.file is not None
    sys.setrecursionlimit(20_000)
    one = [(1, t, ["user", "assistant", "system"][t % 7 % 3], ["So.", "and", ""][t % 5 % 3] + f" {t % 11}" * (t % 2) + ".", True) for t in range(150)]
    whole = plain_repair([(t, r, x) for _, t, r, x, _ in one])
    monkeypatch.setattr(conversation_repair.Steps.__init__, "__defaults__", (16,))
    c = conversation_repair.Conversation(1)
    seen = set()
    for _, t, role, text, _ in one:
        rest = text.strip()
        fault = 1 if not rest else 2 if (role, text) in seen else 0 if rest[-1] in ".!?" else 3
        seen.add((role, text))
        c.look(t, "sua".index(role[0]), fault)
    for _, t, role, text, _ in one:
        list(c.edit(t, role, text))
    list(c.close())
    assert c.report() == whole


def test_the_search_has_few_states():
    search = conversation_repair.Search()
    done = 0
    while done < len(search.states):
        for initial in range(4):
            for fault in range(4):
                search.step(done, initial, fault)
        done += 1
        assert done < 500


def test_no_rows_and_very_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(empty).count() == 0 and conversation_repair.repaired_turns(empty).count() == 0
    long = "x " * 1_500_000
    rows = [(5, 1, "user", long + ".", True), (5, 2, "assistant", long, True), (6, 1, "user", "gone.", False)]
    assert got(conversation_repair.repair(spark.createDataFrame(rows, SCHEMA + ", present boolean"), "present")) == expected(rows)


@pytest.mark.parametrize("n", [1, 2])
def test_repeated_rows_and_ties(spark, n):
    rows = [(1, 4, "user", "A.", True)] * n + [(1, 4, "assistant", "B.", True)] * n
    a, b = (got(conversation_repair.repair(spark.createDataFrame(r, SCHEMA + ", present boolean"), "present")) for r in (rows, rows[::-1]))
    assert a == b and a[1][2] == 2 * (n - 1)
