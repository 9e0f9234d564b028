"""Permutation importance scores only what a shuffle changed, and still equals the plain form."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from recohort.contracts import FEATURES
from recohort.operators import evaluation as ev, models as mo, ranking as rk

_RECORD = "rep int, bits int, score double, n int, hits long"


def _rows(accounts) -> list[dict]:
    """Sparse values, as those of inactive accounts are; every fifth account is no validation row."""
    rng, out = random.Random(5), []
    for account in accounts:
        values = [rng.choice([0.0] * 8 + [1.0, 2.5]) for _ in FEATURES]
        values[12] = rng.randrange(50) / 4
        out.append({"account": account, "split": "train" if (account or 0) % 5 == 4 else "validation", "label": rng.randrange(3) // 2, **dict(zip(FEATURES, values, strict=True))})
    return out


def _frame(spark, rows):
    kinds = ", ".join(["account long", "split string", "label int", *[f"{name} double" for name in FEATURES]])
    return spark.createDataFrame([tuple(r.values()) for r in rows], kinds)


def _score(row) -> float:
    return (row[FEATURES[0]] or 0.0) * 2 + (row[FEATURES[5]] or 0.0) - (row[FEATURES[12]] or 0.0) / 8


def _scorer(frame):
    name = [F.coalesce(FEATURES[i], F.lit(0.0)) for i in (0, 5, 12)]
    return frame.withColumn("score", name[0] * 2 + name[1] - name[2] / 8)


def _precision(pairs) -> float:
    value, above, hits, total = 0.0, 0, 0, sum(label for _, label in pairs)
    for score in sorted({s for s, _ in pairs}, reverse=True):
        own = [y for s, y in pairs if s == score]
        above, hits = above + len(own), hits + sum(own)
        value += sum(own) / total * hits / above
    return value


def _plain(rows, repeats, seed):
    """Means of the losses by feature, and how many values a shuffle changed."""
    rows = sorted((r for r in rows if r["split"] == "validation"), key=lambda r: (r["account"] is not None, r["account"] or 0))
    base, changed, out = _precision([(_score(r), r["label"]) for r in rows]), 0, {}
    for feature in FEATURES:
        drops = []
        for rep in range(1, repeats + 1):
            text = f":{seed}:{rep}"
            donors = sorted(rows, key=lambda r: hashlib.sha256((text[1:] if r["account"] is None else f"{r['account']}{text}").encode()).hexdigest())
            mixed = [{**r, feature: d[feature]} for r, d in zip(rows, donors, strict=True)]
            changed += sum(r[feature] != d[feature] for r, d in zip(rows, donors, strict=True))
            drops.append(base - _precision([(_score(r), r["label"]) for r in mixed]))
        mean = sum(drops) / repeats
        out[feature] = mean, math.sqrt(sum((d - mean) ** 2 for d in drops) / repeats)
    return out, changed, len(rows)


@pytest.mark.parametrize("kind", ["plain", "twice", "nulls"])
def test_only_changed_rows_are_scored_again(spark, kind):
    rows = _rows(range(120)) * (2 if kind == "twice" else 1)
    if kind == "nulls":
        rows = _rows([None, *range(1, 120)])
        for i, row in enumerate(rows):
            row[FEATURES[i % 17]] = None
    wanted, changed, count = _plain(rows, 3, 11)
    frames = []

    def scorer(frame):
        frames.append(frame)
        return _scorer(frame)

    found = {r.feature: r for r in mo.permutation_importance(scorer, _frame(spark, rows), 3, 11).collect()}
    assert set(found) == set(FEATURES)
    for feature, (mean, deviation) in wanted.items():
        assert found[feature].ap_drop_mean == pytest.approx(mean, abs=1e-12)
        assert found[feature].ap_drop_std == pytest.approx(deviation, abs=1e-9) and found[feature].repeats == 3
    # 17 x 3 copies of the rows would be scored otherwise.
    assert sorted(frame.count() for frame in frames) == sorted([count, changed]) and changed < 17 * 3 * count / 2


def test_importance_of_a_model_without_rows_or_positives(spark):
    rows = _rows(range(40))
    assert mo.permutation_importance(_scorer, _frame(spark, [{**r, "split": "train"} for r in rows]), 2, 1).collect() == []
    found = mo.permutation_importance(_scorer, _frame(spark, [{**r, "label": 0} for r in rows]), 2, 1).collect()
    assert {(r.ap_drop_mean, r.ap_drop_std, r.repeats) for r in found} == {(None, None, 2)} and len(found) == 17


def test_precision_of_variants_is_that_of_whole_runs(spark):
    """Ties, zeros, infinities, NaN and null, in many slices, against one whole run for each variant."""
    rng = random.Random(2)
    scores = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, *[i / 7 for i in range(-20, 20)]]
    base = [(rng.choice(scores), rng.randrange(2)) for _ in range(300)]
    records, runs = [(0, 0, s, 1, y) for s, y in base], [(0, 0, s, y) for s, y in base]
    for rep in (1, 2):
        moved = [(rng.randrange(8), rng.choice(scores)) for _ in base]
        records += [(rep, bits, s, -1, -y) for (s, y), (bits, _) in zip(base, moved, strict=True) if bits]
        for f in range(3):
            records += [(rep, 1 << f, new, 1, y) for (_, y), (bits, new) in zip(base, moved, strict=True) if bits >> f & 1]
            runs += [(rep, f, new if bits >> f & 1 else s, y) for (s, y), (bits, new) in zip(base, moved, strict=True)]
    whole = ev.average_precision(spark.createDataFrame(runs, "rep int, f int, score double, label int"), ("rep", "f"))
    wanted = {(r.rep, r.f): r.average_precision for r in whole.collect()}
    frame = spark.createDataFrame(records, _RECORD)
    for most in (40, 1_000_000):
        found = {(r.rep, r.f): r.average_precision for r in ev.variant_precision(frame, 2, 3, most).collect()}
        assert set(found) == set(wanted) and len(found) == 7
        assert all(found[run] == pytest.approx(wanted[run], abs=1e-12) for run in wanted)


def test_equal_records_are_summed_as_they_gather(spark):
    """A slice that is one score for many rows takes the memory of its different records."""
    import numpy as np
    import pyarrow as pa

    def batch(k):
        run = np.array([0, 1 << 3 | 0b101, -(1 << 3 | 0b111)] * 40)
        return pa.RecordBatch.from_arrays([pa.array(run), pa.array(np.where(run == 0, 0.5, k % 2 / 2)), pa.array(np.where(run < 0, -1, 1))], names=["run", "score", "hits"])

    batches = [batch(k) for k in range(50)]
    few, all_at_once = (next(ev._slice_steps(1, 3, loose)(iter(batches))) for loose in (100, 10 ** 9))
    assert few.to_pylist() == all_at_once.to_pylist() and few.num_rows == 4
    assert [(r["n"], r["hits"]) for r in few.to_pylist()] == [(2000, 2000), (2000, 2000), (0, 0), (2000, 2000)]


def test_numbers_are_positions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), rng.randrange(40) or None, i) for i in range(400)]
    frame, order = spark.createDataFrame(rows, "g int, v int, id int"), [F.desc("v"), F.asc("id")]
    for within, parts in ((("g",), 7), ((), 3), ((), 1)):
        wanted = rk.positions(frame, order, within).drop("group_size")
        found = rk.numbered(frame, order, within, parts)
        assert found.columns == wanted.columns and sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_keyed_order_is_written_without_its_keys(spark, monkeypatch):
    """A keyed order of all repeats is many rows; digests and accounts only give it."""
    written, original = [], rk.pin
    monkeypatch.setattr(rk, "pin", lambda frame, name: written.append(frame.columns) or original(frame, name))
    frame = spark.createDataFrame([(i, i * 10) for i in range(30)], "account long, v int")
    found = mo.shuffled_by_key(frame, 2, 7, [F.col("v").alias("kept")])
    assert written == [["rep", "kept", "_at"]] and found.columns == ["rep", "kept", "position"]
    for rep in (1, 2):
        order = sorted(range(30), key=lambda i: hashlib.sha256(f"{i}:7:{rep}".encode()).hexdigest())
        assert [r.kept for r in found.filter(F.col("rep") == rep).orderBy("position").collect()] == [i * 10 for i in order]
