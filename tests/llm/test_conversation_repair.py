import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import conversation_repair as cr
from tidewatch.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """Rows after damage, by plain Python, and every conversation."""
    out = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out.setdefault(c, []).extend([] if h == 0 else [(t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1))
    return out


def sorted_turns(turns):
    return sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def judged(turns):
    seen, faults = set(), []
    for _, r, x in turns:
        inked = BLANK.findall(x)
        faults.append("blank" if not inked else "duplicate" if (r, x) in seen else "truncated" if inked[-1] not in ".!?" else "")
        seen.add((r, x))
    return faults


def cheapest(turns, faults, most_inserts, delete=2):
    """(cost, audit, repaired lines) by trying all edits, with at most so many insertions."""
    best = None
    for inserts in range(most_inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(turns) + 1), inserts):
            for ops in itertools.product("DKua", repeat=len(turns)):
                cost, audit, roles, lines = 5 * inserts, "", [], []
                if any(o != "D" and f in ("blank", "duplicate") for o, f in zip(ops, faults)):
                    continue
                for i in range(len(turns) + 1):
                    for _ in range(places.count(i)):
                        audit += "I"
                        roles.append("?")
                        lines.append(None)
                    if i < len(turns):
                        o = ops[i]
                        audit += o if o in "DK" else "R"
                        cost += {"D": delete, "K": 0}.get(o, 1) + (5 if o != "D" and faults[i] == "truncated" else 0)
                        if o != "D":
                            roles.append(turns[i][1][:1] or "-" if o == "K" else o)
                            lines.append((turns[i][1] if o == "K" else {"u": "user", "a": "assistant"}[o], turns[i][2]))
                for filling in itertools.product("ua", repeat=roles.count("?")):
                    fill = iter(filling)
                    spelled = [next(fill) if r == "?" else r for r in roles]
                    if GRAMMAR.fullmatch("".join(spelled)):
                        done = "\n".join(f"{a}:{b}" for a, b in (x or ({"u": "user", "a": "assistant"}[s], "") for x, s in zip(lines, spelled)))
                        best = min(best, (cost, audit, done)) if best else (cost, audit, done)
    return best


def brute(conversations, most_inserts=1):
    """Five turns or fewer cost at most 10 by deletion alone, so more insertions never pay."""
    out = []
    for c, turns in conversations.items():
        turns = sorted_turns(turns)
        faults = judged(turns)
        cost, audit, done = cheapest(turns, faults, most_inserts)
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def some(seed, n=60):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No", "Why? ", "Fine!\n", "", " \t", "so\x85", "a.b", "I see.", "..."])
    role = lambda: rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "us"])
    rows = [(c, rng.choice([t, t, t + 3, None]), role(), rng.choice([text(), None])) for c in range(n) for t in range(rng.randint(1, 4))]
    return [*rows, (None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Ho."), (-5, 2, "system", "S."), (-5, 3, "user", "U."), (-5, 4, "assistant", "A.")]


def test_against_all_edits(spark):
    rows = some(3)
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit("x")).withColumn("fault", F.lit(1)).repartition(3)
    done = cr.digest(*cr.repair(cr.damaged(turns)))
    want = brute(damage(rows))
    assert len({r[7] for r in want}) > 14
    assert got(done) == want


def test_undamaged_turns_and_lost_ones(spark):
    rows = some(4, 30)
    plain = {}
    for c, t, r, x in rows:
        plain.setdefault(c, []).append((t, r if r is not None else " ", x if x is not None else " "))
    assert got(cr.digest(*cr.repair(spark.createDataFrame(rows, SCHEMA)))) == brute(plain)
    lost = spark.createDataFrame([(1, 0, "user", "Hi.", True), (2, 0, "user", "Hi.", True), (2, 1, "user", "Hi.", False)], SCHEMA + ", lost boolean")
    empty = hashlib.sha256().hexdigest()
    assert [(r[0], r[6], r[7], r[8] == empty) for r in got(cr.digest(*cr.repair(lost)))] == [(1, 0, "", True), (2, 2, "D", True)]


def test_insertions_and_truncated_turns():
    solve = {s: (c, a) for s, c, a in cr.solve(sorted(["", "s", "u", "a", "U", "ua", "uA", "UA", "suaua", "uu", "uuaa", "-", "-ua-", "xx", "x" * 6, "sssua", "uaSua", "aua"]))}
    assert solve["suaua"] == (0, "KKKKK") and solve["s"] == (2, "D") and solve["ua"] == (0, "KK") and solve["uu"] == (1, "KR")
    assert solve["-ua-"] == (4, "DKKD") and solve["uaSua"] == (2, "KKDKK") and solve["UA"] == (4, "DD") and solve["uA"] == (4, "DD") and solve["aua"] == (2, "DKK")
    assert solve["sssua"] == (2, "KRRKK") and solve["xx"] == (2, "RR") and solve[""] == (0, "")


def test_insertions_where_deletions_cost_more(monkeypatch):
    """At the contract's costs a deletion is always cheaper, so the rest of the program is tried at others."""
    monkeypatch.setattr(cr, "DELETE", 20)
    monkeypatch.setattr(cr, "EDGES", {c: cr._edges(c) for c in cr.EDGES})
    rng = random.Random(9)
    signatures = sorted({"".join(rng.choice("-suaxSUA") for _ in range(rng.randint(1, 3))) for _ in range(60)})
    found = {s: (c, a) for s, c, a in cr.solve(signatures)}
    for s in signatures:
        turns = [(0, {"-": "tool", "x": "tool"}.get(k, k.lower()), "") for k in s]
        faults = ["blank" if k == "-" else "truncated" if k.isupper() else "" for k in s]
        assert found[s] == cheapest(turns, faults, 3, 20)[:2]
    assert any("I" in a for _, a in found.values())


def test_shared_prefixes_are_computed_once(monkeypatch):
    signatures = sorted({"".join(p) for n in range(5) for p in itertools.product("suaX-", repeat=n)})
    calls, real = [], cr._layer
    monkeypatch.setattr(cr, "_layer", lambda *a: calls.append(a) or real(*a))
    alone = {s: next(cr.solve([s]))[1:] for s in signatures}
    calls.clear()
    assert {s: (c, a) for s, c, a in cr.solve(signatures)} == alone
    assert len(calls) == len(signatures) - 1


def test_long_conversation_and_repaired_turns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(6001)] + [(2, 0, "user", "x" * 300_000 + ".")]
    planned, fixed = cr.repair(spark.createDataFrame(rows, SCHEMA))
    assert {r.conv_id: (r.cost, r.audit) for r in planned.collect()} == {1: (2, "K" * 6000 + "D"), 2: (2, "D")}
    turns = [(r.place, r.role) for r in fixed.where("conv_id = 1").orderBy("place").collect()]
    assert turns == [(i, "user" if i % 2 == 0 else "assistant") for i in range(6000)]


def test_empty_table(spark):
    planned, fixed = cr.repair(cr.damaged(spark.createDataFrame([], SCHEMA)))
    assert cr.digest(planned, fixed).collect() == [] == fixed.collect()


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_query_against_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    sql = con.execute(registry.oracle_sql()["op13_conversation_repair"])
    names = [x[0] for x in sql.description]
    df = registry.op13_conversation_repair(spark, d)
    assert df.columns == names and sorted(map(tuple, df.collect())) == sorted(sql.fetchall())
