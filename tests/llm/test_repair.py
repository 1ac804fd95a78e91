"""Conversation repair against a search over all edits, for any cut of the conversations into words."""

import hashlib
import heapq
import itertools
import random
import re

import pytest

from barlake.llm import queries, queries_sql, repair

ROLES = {"u": "user", "a": "assistant"}
FITS = re.compile(r"(s?(ua)+)?")


def could_follow(sofar, initial):
    """May a repaired sequence go on with this initial."""
    return {"": "su", "s": "u", "u": "a", "a": "u"}[sofar[-1:]].find(initial) >= 0 and initial != ""


def searched(rows):
    """(cost, audit, repaired rows) of the cheapest edits by a search over partial edits in the order of cost, then audit."""
    best = None
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, k, sofar, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if k == len(rows) and FITS.fullmatch(sofar):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda b: b[:2])
            continue
        if (k, sofar[-1:], audit, cost) in seen:
            continue
        seen.add((k, sofar[-1:], audit, cost))
        for i, role in ROLES.items():
            if could_follow(sofar, i) and len(audit) < 2 * len(rows) + 4:
                heapq.heappush(heap, (cost + 5, audit + "I", k, sofar + i, (*out, f"{role}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, sofar, out))
            if fault not in ("blank", "duplicate"):
                late = 5 if fault else 0
                if could_follow(sofar, role[:1]):
                    heapq.heappush(heap, (cost + late, audit + "K", k + 1, sofar + role[:1], (*out, f"{role}:{text}")))
                for i, name in ROLES.items():
                    if could_follow(sofar, i):
                        heapq.heappush(heap, (cost + late + 1, audit + "R", k + 1, sofar + i, (*out, f"{name}:{text}")))
    return best


def plain(rows):
    """The report of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit, out = searched([(role, text, fault) for (_, role, text), fault in zip(rows, faults, strict=True)])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations():
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(1, 60)]:
        for t in range(rng.randint(1, 8)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User", None])
            text = rng.choice(["Fine.", "Cut off", "\x1c", " \t", "", None, f"Row {t}.", f"Why {t}?", f"No end {t}", "Ends. \n"])
            rows.append((conv, rng.choice([t, t, t, 2 * t, None]), role, text))
    return rows


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    got = queries.op11_conversation_repair(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    cursor = con.execute(queries_sql.OP11)
    assert got.columns == [c[0] for c in cursor.description]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(cursor.fetchall())
    assert sum(r[6] for r in rows) > 0 and any("R" in r[7] for r in rows)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_every_cut_gives_the_cheapest_edits(spark, block):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, edit string, row_index long, part int")
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.reported(repair.edited(df, block=block)).collect()}
    assert got == {conv: plain(rest) for conv, rest in by.items()}


def test_repaired_rows_make_the_digest(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    rows = repair.edited(df)
    lines = {}
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: (r["row_index"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(r)
    for r in repair.reported(rows).collect():
        own = lines.get(r["conv_id"], [])
        assert FITS.fullmatch("".join(x["role"][:1] for x in own))
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in own).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(x["edit"] for x in own) == r["audit"].replace("D", "")
    assert repair.reported(repair.edited(df.limit(0))).collect() == []


def test_one_long_conversation(spark):
    """Rows of one conversation and one turn, many of them equal, in words of 64: the whole is one sequence."""
    rows = [(1, None, "user", "Same.")] * 500 + [(1, i, "user" if i % 2 else "assistant", f"Row {i}.") for i in range(2001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = repair.reported(repair.edited(df, block=64)).collect()
    # 499 repeats go, the first user row and rows 0 to 2000 alternate, and the row too many goes last of all
    assert (got["duplicate"], got["cost"], got["gaps"]) == (499, 499 * 2, 0)
    assert got["audit"] == "K" + "D" * 499 + "K" * 2001
