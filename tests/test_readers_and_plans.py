"""Readers of files as they come, and the plans that stand on them."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recohort.contracts import EVENT_FIELDS
from recohort.operators import gates
from recohort.plans import history, reward_report, snapshots
from recohort.sources import events as se, files, headed, pages as pages_in, rewards as sr
from tests.fixtures import boundary_fixture

START, END = datetime(2023, 11, 15), datetime(2024, 3, 29)
COVERAGE = (datetime(2023, 9, 20), datetime(2024, 5, 29))


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿account, MARKET ,note\n1,m1,x\n2,\"m,2\",\n")
    (tmp_path / "b.csv").write_text('note,"market",account\r\nq,m3,3\r\n\r\n,,4\r\n')
    (tmp_path / "c.csv").write_text("market,account\nm5,5\nm6\nm7,7,extra\nmarket,account\nm8,8\n")
    (tmp_path / "d.csv").write_text("other,account\nm9,9\n")
    rows = headed.read_headed_csv(spark, str(tmp_path), ("account", "market")).collect()
    sound = sorted((r.account, r.market) for r in rows if r.fault is None)
    assert sound == [("1", "m1"), ("2", "m,2"), ("3", "m3"), ("4", None), ("5", "m5"), ("8", "m8")]
    bad = sorted((r.file.rsplit("/", 1)[-1], r.line, r.fault, r.account) for r in rows if r.fault)
    assert bad == [("c.csv", "m6", "malformed line", None), ("c.csv", "m7,7,extra", "malformed line", None),
                   ("d.csv", "m9,9", "no header", None), ("d.csv", "other,account", "no header", None)]
    assert headed.line_faults(headed.read_headed_csv(spark, str(tmp_path), ("account", "market"))).count() == 4
    (tmp_path / "c.csv").write_text("market,account\nm5,5\naccount,market\n8,m8\n")
    with pytest.raises(ValueError, match="two different headers"):
        headed.read_headed_csv(spark, str(tmp_path), ("account", "market"))
    with pytest.raises(ValueError, match="required columns"):
        headed.read_headed_csv(spark, str(tmp_path), ("account", "absent"))
    with pytest.raises(ValueError, match="more than 1 different"):
        headed.read_headed_csv(spark, str(tmp_path / "[ab].csv"), ("account", "market"), most_headers=1)


def test_events_of_parts_with_swapped_columns(spark, tmp_path):
    raw = boundary_fixture(spark, START, END).cache()
    key = F.pmod(F.xxhash64("tx_hash"), F.lit(2))
    raw.filter(key == 0).write.option("header", True).csv(str(tmp_path / "one"))
    swapped = [n for n in EVENT_FIELDS if n not in ("account", "market")]
    raw.filter(key == 1).select("market", *reversed(swapped), "account").write.option("header", True).csv(str(tmp_path / "two"))
    read = se.read_event_text(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert read.columns == list(EVENT_FIELDS)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, raw.select(*EVENT_FIELDS).collect()), key=str)
    (tmp_path / "two" / "part-bad.csv").write_text(",".join(EVENT_FIELDS) + "\nonly,three,values\n")
    found = gates.validate_rows(se.read_event_text(spark, [str(tmp_path / "one"), str(tmp_path / "two")]), 42161, *COVERAGE)
    assert "malformed row" in {r.rule for r in found.collect()}


@pytest.mark.parametrize("column, value, rule, typed", [
    ("log_index", "3000000000", "invalid log index", "log_index"), ("position_fee_usd", "1" + "0" * 27, "fee is not finite and non-negative", "position_fee_usd"),
    ("log_index", "2147483647", None, "log_index"), ("position_fee_usd", "9" * 26 + ".5", None, "position_fee_usd")])
def test_gate_refuses_what_typing_would_lose(spark, column, value, rule, typed):
    raw = boundary_fixture(spark, START, END).limit(1).withColumn(column, F.lit(value))
    assert [r.rule for r in gates.validate_rows(raw, 42161, *COVERAGE).collect()] == ([rule] if rule else [])
    assert (se.type_events(raw).first()[typed] is None) == (rule is not None)


def test_digests_of_files_above_the_bound(spark, tmp_path):
    contents = {"small.json": b"{}", "large file.json": b"0123456789" * 700_000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.json").write_bytes(b"")
    for bound in (files.STREAMED_ABOVE, 100, -1):
        found = {r.file.rsplit("/", 1)[-1]: r for r in files.file_digest_manifest(spark, str(tmp_path), "*.json", bound).collect()}
        assert set(found) == set(contents)
        for name, content in contents.items():
            assert found[name].bytes == len(content) and found[name].sha256 == hashlib.sha256(content).hexdigest()
            assert found[name].git_sha1 == hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def action(number, name="OrderExecuted", **more):
    tx = f"0x{number:064x}"
    return {"id": f"{tx}:{number % 7}", "eventName": name, "orderKey": tx, "orderType": 2, "account": "0x" + "3" * 40, "marketAddress": "0x" + "4" * 40,
            "sizeDeltaUsd": "5" + "0" * 30, "timestamp": 1_700_000_000 + number, "transactionHash": tx, **more}


LOW, HIGH = datetime(2023, 11, 1), datetime(2023, 12, 1)


def write_pages(folder, pages):
    folder.mkdir()
    for name, actions in pages.items():
        text = actions if isinstance(actions, str) else json.dumps({"data": {"tradeActions": actions}}, indent=1)
        (folder / f"{name}.json").write_text(text)
    return str(folder)


def test_pages_to_snapshot_and_back(spark, tmp_path):
    path = write_pages(tmp_path / "pages", {"p1": [action(1), action(1, "OrderCreated", timestamp=1_699_999_000)], "p2": [action(2), action(3, orderType=0)]})
    pages = pages_in.read_pages(spark, path)
    cursors = pages.select("page", F.lit("").alias("cursor"))
    rows = snapshots.normalize_pages(pages, 42161, LOW, HIGH)
    assert rows.count() == 2 and rows.columns == list(EVENT_FIELDS)
    with pytest.raises(ValueError, match="not_above"):
        # The creation repeats the id of the execution before it.
        snapshots.normalize_pages(pages, 42161, LOW, HIGH, cursors)
    target = str(tmp_path / "snapshot")
    assert snapshots.publish_snapshot(rows, target, (LOW, HIGH), "u", True).first().row_count == 2
    trades, manifest = snapshots.load_snapshot(spark, target, 42161)
    assert trades.count() == 2 and manifest["is_synthetic"] is True
    assert {r.order_created_at for r in trades.collect()} == {None, datetime(2023, 11, 14, 21, 56, 40)}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        snapshots.publish_snapshot(rows, target, (LOW, HIGH), "u", True)
    # A changed file, then a manifest that counts otherwise.
    part = next(p for p in (tmp_path / "snapshot" / "events").glob("*.csv") if p.stat().st_size)
    kept = part.read_text()
    # The local file system keeps checksums of its own beside the files.
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_text(kept.replace(",increase,", ",decrease,"))
    with pytest.raises(ValueError, match="changed"):
        snapshots.load_snapshot(spark, target, 42161)
    part.write_text(kept)
    stated = next((tmp_path / "snapshot" / "manifest").glob("part-*.json"))
    stated.write_text(stated.read_text().replace('"row_count":2', '"row_count":3'))
    (stated.parent / f".{stated.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="row count differs"):
        snapshots.load_snapshot(spark, target, 42161)


@pytest.mark.parametrize("bad, message", [
    ({"p2": "{not json"}, "unreadable page"), ({"p2": '{"data": {}}'}, "without a list"), ({"p2": [action(1, "OrderCreated"), action(1, "OrderCreated")]}, "creations"),
    ({"p2": [action(2, orderType=2, sizeDeltaUsd="1.5")]}, "raw integer"), ({"p2": [action(1)]}, "copies"), ({"p2": [action(4, account="0x1")]}, "invalid account")])
def test_pages_that_refuse_the_snapshot(spark, tmp_path, bad, message):
    pages = pages_in.read_pages(spark, write_pages(tmp_path / "pages", {"p1": [action(1)], **bad}))
    with pytest.raises(ValueError, match=message):
        snapshots.normalize_pages(pages, 42161, LOW, HIGH)


TOKEN = "0x" + "7" * 40


def distribution(amounts, **more):
    return json.dumps({"token": TOKEN, "distributionTypeId": 1003, "id": "2023-11-15_1003", "amounts": amounts, **more})


def test_reward_report_from_files(spark, tmp_path):
    folder = tmp_path / "2023-11-15"
    folder.mkdir()
    big = "9" * 39
    one, two = "0x" + "aB" * 20, "0x" + "1" * 40
    (folder / "d.json").write_text(distribution({one: big, two: "1"}, appliedOverrides={"0x" + "2" * 40: one}))
    texts = sr.read_distribution_texts(spark, str(tmp_path) + "/*")
    assert texts.first().epoch_start == "2023-11-15"
    batches = texts.select("file", F.lit("1" + "0" * 39).alias("total_raw"))
    found = reward_report.reward_report(texts, TOKEN, 1003, batches, "1000000000000000000000.01")
    assert found["ledger"].count() == 2 and found["epochs"].first().amount_raw == "1" + "0" * 39
    assert found["report"].first().exact_minus_published == "-0.010000000000000000"
    for amounts, more, message in (({one: "-1"}, {}, "invalid amount"), ({one: "1"}, {"token": "0x0"}, "unexpected token"), ({one: "1"}, {}, "batch total")):
        (folder / "d.json").write_text(distribution(amounts, **more))
        with pytest.raises(ValueError, match=message):
            reward_report.reward_report(sr.read_distribution_texts(spark, str(tmp_path) + "/*"), TOKEN, 1003, batches)


def test_merge_reads_all_parts_at_once(spark, tmp_path, monkeypatch):
    weeks = [("2023-09-%02dT00:00:00Z" % d, "2023-09-%02dT00:00:00Z" % (d + 1)) for d in range(10, 16)]
    parts = []
    for i, (start, end) in enumerate(weeks):
        rows = boundary_fixture(spark, START, END).limit(1).withColumns({
            "timestamp": F.lit(start), "order_created_at": F.lit(None).cast("string"), "tx_hash": F.lit("0x" + str(i) * 64)})
        columns = list(EVENT_FIELDS) if i % 2 else list(reversed(EVENT_FIELDS))
        path = str(tmp_path / f"week-{i}")
        rows.select(*columns).write.option("header", True).csv(path)
        parts.append((path, {"coverage_start": start, "coverage_end": end, "complete": True, "source_url": "u", "is_synthetic": False, "normalization_version": 2, "row_count": 1}))
    reads = []
    true = history.read_headed_csv
    monkeypatch.setattr(history, "read_headed_csv", lambda spark, paths, names: reads.append(len(paths)) or true(spark, paths, names))
    for count in (2, 6):
        merged = history.merge_history(spark, parts[:count], (datetime(2023, 9, 10), datetime(2023, 9, 10 + count)), 42161, "u", False, 2)
        assert merged.count() == count and merged.filter("account IS NULL OR market IS NULL").count() == 0
    assert reads == [2, 6]
