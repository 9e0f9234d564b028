"""Conversation repair: SQL, a textbook chart over all splits, and every possible edit of short conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from recohort.llm import repair
from recohort.llm.registry import ORACLES, QUERIES
from tests.oracle import connect, difference

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_sql(spark, folder):
    folder = f"/root/testdata/{folder}"
    assert difference(spark, connect(folder), QUERIES["op11_conversation_repair"], ORACLES["op11_conversation_repair"], folder) is None


def row_edits(initial, fault):
    yield 2, "D", ""
    if fault != 2:
        yield 5 * fault, "K", initial
        yield 1 + 5 * fault, "R", "u"
        yield 1 + 5 * fault, "R", "a"


def every_edit(rows):
    """The least (cost, audit) of all edits with up to two inserted rows in a gap."""
    gaps = [(5 * n, "I" * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
    found = []
    for edits in itertools.product(*(list(row_edits(*r)) for r in rows)):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            chain = [between[0], *itertools.chain(*zip(edits, between[1:], strict=True))]
            if re.fullmatch("(s?(ua)+)?", "".join(c[2] for c in chain)):
                found.append((sum(c[0] for c in chain), "".join(c[1] for c in chain)))
    return min(found)


def all_splits(rows):
    """A chart of all spans and all splits, from the grammar's rules as they are written."""
    n, chart = len(rows), {}
    none = {(p, p): (0, "") for p in range(4)}

    def join(one, two):
        out = {}
        for (p, q), (c, a) in one.items():
            for (r, s), (d, b) in two.items():
                if q == r and ((p, s) not in out or (c + d, a + b) < out[p, s]):
                    out[p, s] = (c + d, a + b)
        return out

    once = none | {(p, q): (5, "I") for (p, c), q in STEPS.items() if c in "ua"}
    inserted = join(join(once, once), once)
    for k, row in enumerate(rows):
        cell = {}
        for cost, edit, role in row_edits(*row):
            for p in range(4):
                q = p if edit == "D" else STEPS.get((p, role))
                if q is not None and ((p, q) not in cell or (cost, edit) < cell[p, q]):
                    cell[p, q] = (cost, edit)
        chart[k, k + 1] = join(join(inserted, cell), inserted)
    for length in range(2, n + 1):
        for begin in range(n - length + 1):
            cell = {}
            for middle in range(begin + 1, begin + length):
                for key, value in join(chart[begin, middle], chart[middle, begin + length]).items():
                    cell[key] = min(value, cell.get(key, value))
            chart[begin, begin + length] = cell
    top = chart[0, n] if n else inserted
    return min(top[0, q] for q in (0, 3) if (0, q) in top)


def kinds(rows):
    return np.array([3 * ("uas".find(i) if i in "uas" else 3) + f for i, f in rows], np.int8)


def test_every_edit_of_short_conversations():
    for n in range(3):
        for rows in itertools.product(itertools.product("uasx", range(3)), repeat=n):
            assert repair.best(repair.cell_of(kinds(rows))) == every_edit(rows)


def test_chart_of_all_splits(monkeypatch):
    random.seed(8)
    some = [[(random.choice("uuaasx"), random.choice([0, 0, 0, 1, 2])) for _ in range(random.randrange(14))] for _ in range(120)]
    want = [all_splits(rows) for rows in some]
    assert [repair.best(c) for c in repair.parse([kinds(r) for r in some])] == want
    # In pieces, as a long conversation is parsed.
    monkeypatch.setattr(repair, "SPAN_ROWS", 3)
    assert [repair.best(repair.cell_of(kinds(r))) for r in some] == want


def plain(rows, damaged=True):
    """All columns by conversation, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            own += [(turn, "user" if lot == 4 else role, text)] * {0: 0, 3: 2}.get(lot, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit = all_splits([(i or "x", {"": 0, "truncated": 1}.get(f, 2)) for i, f in zip(initials, faults, strict=True)])
        lines, at, size = [], iter(own), len(audit.replace("D", ""))
        for edit in audit:
            row = next(at) if edit != "I" else None
            if edit != "D":
                role = row[1] if edit == "K" else ["user", "assistant"][(len(lines) + size) % 2]
                lines.append(f"{role}:{row[2] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def hard_rows():
    random.seed(5)
    texts = [None, "", " \t\n", "Yes.", "Yes.", "no", "What?\n", "Fine! \x0b", "é日本。", "a.b", "!", "x" * 20000 + "."]
    roles = ["user", "assistant", "system", "User", None, "", "sudo", "assistant", "user"]
    rows = [(c, random.choice([None, 0, 1, 2, 2, 3, 5, 9, -4]), random.choice(roles), random.choice(texts)) for c in [None, *range(12)] for _ in range(random.randrange(1, 9))]
    rows += [(50, t, ["system", "user", "assistant"][t % 3], f"text {t % 7}.") for t in range(40)] + [(51, 1, "user", "Same.")] * 30 + [(52, None, None, None)]
    return rows


@pytest.mark.parametrize("span, partitions", [(4096, 4), (3, 40)])
def test_hard_rows(spark, monkeypatch, span, partitions):
    monkeypatch.setattr(repair, "SPAN_ROWS", span)
    rows = hard_rows()
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions < 10)
    try:
        frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, same string, cost int")
        turns = repair.damage(frame)
        found = {r["conv_id"]: tuple(r[n] for n in COLUMNS) for r in repair.digest(turns, repair.diagnose(turns)).collect()}
        assert found == plain(rows)
        diagnosed = repair.diagnose(frame)
        whole = repair.repair(frame, diagnosed).orderBy("conv_id", "position").collect()
        want = plain(rows, damaged=False)
        for conv, values in want.items():
            own = [r for r in whole if r["conv_id"] == conv]
            assert [r["position"] for r in own] == list(range(len(own)))
            assert "".join(r["edit"] for r in own) == values[6].replace("D", "")
            assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == values[7]
            assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in own))
        none = frame.limit(0)
        assert repair.digest(none, repair.diagnose(none)).count() == 0 and repair.damage(none).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])


def test_conversation_of_dropped_rows(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = repair.damage(spark.createDataFrame([(lost, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string"))
    found = [tuple(r) for r in repair.digest(turns, repair.diagnose(turns)).collect()]
    assert found == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
