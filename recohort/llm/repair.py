r"""Conversation structure repair: the cheapest edits after which the roles read `(s?(ua)+)?`, by interval parsing.

The repair grammar is in Chomsky normal form. Its nonterminals are N[p,q], one for each pair of states of the automaton of
`(s?(ua)+)?` (0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant) between which there is a way:

    N[p,q] -> N[p,r] N[r,q]           a span is two spans side by side
    N[p,q] -> row                     Keep (0) or Rerole to user or assistant (1) where that leads from p to q, Delete (2), p = q
    N[p,q] -> inserted rows           Insert (5 each): the closure, applied to every cell from both sides

A chart cell holds, for a span and each nonterminal, the least (cost, audit), where the audit is the initials D, I, K, R of
the edits in order. Cells are combined bottom-up by span length: 1, 2, 4, and so on. In this grammar every split of a span
derives the same, since any way from p to q passes some state r at the split; so one split for each span gives the minimum
over all, and the work is in proportion to the number of rows. Least audits stay least when spans are joined: of two audits
of one cell with equal costs neither begins the other, because what it had more would be inserted rows, which cost.

A conversation of any length is spread: narrow rows are sorted over all tasks by (conversation, turn), each task makes one cell
of the run of a conversation that it holds, and runs are joined by conversation. Equal rows are counted before they are dealt.
Texts move once, for the repaired conversation; its digest reads them in order, in one task, without holding them.

Faults, the first of which counts for a row: blank (no `[^\x20\x09-\x0D]`), duplicate (role and text seen earlier), truncated
(the last such character is not one of `.!?`). Blank and duplicate rows must be deleted; a truncated row that stays costs 5.

Defined results: a null role or text is one space; turns are ordered nulls first, rows of one turn by role, then by the SHA-256
of their text; rows of a null conversation form one conversation; of equal rows all but the first are duplicates; other columns
are ignored. A conversation without rows, named by a row marked as gone, has zeros, an empty audit and no repaired row. An
empty table gives no row. Only the first character of a role counts for the grammar, in this very case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recohort.llm.text import small_batches
from recohort.session import pin

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
STATES, INITIALS = 4, "uas"
#: Where a role's initial leads from each state; every other one leads nowhere.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_NEVER = 1 << 40
#: Rows whose cells are made at once.
SPAN_ROWS = 4096

Cells = tuple[np.ndarray, np.ndarray]


def _reachable() -> list[tuple[int, int]]:
    ways = {(p, p) for p in range(STATES)} | {(p, q) for (p, _), q in STEPS.items()}
    while True:
        more = ways | {(p, r) for p, q in ways for s, r in ways if q == s}
        if more == ways:
            return sorted(ways)
        ways = more


NONTERMINALS = _reachable()


def _cell(productions: list[tuple[int, int, int, bytes]]) -> Cells:
    costs, audits = np.full((1, STATES, STATES), _NEVER), np.zeros((1, STATES, STATES), "S8")
    for p, q, cost, audit in productions:
        if (cost, audit) < (int(costs[0, p, q]), bytes(audits[0, p, q])):
            costs[0, p, q], audits[0, p, q] = cost, audit
    return costs, audits


def combine(left: Cells, right: Cells) -> Cells:
    """The cells of the spans made of left[k] and right[k]."""
    costs = np.full(left[0].shape, _NEVER)
    audits = np.zeros(left[0].shape, f"S{left[1].itemsize + right[1].itemsize}")
    for p, q in NONTERMINALS:
        for r in range(STATES):
            if (p, r) not in NONTERMINALS or (r, q) not in NONTERMINALS:
                continue
            cost = left[0][:, p, r] + right[0][:, r, q]
            audit = np.strings.add(left[1][:, p, r], right[1][:, r, q])
            better = (cost < costs[:, p, q]) | ((cost == costs[:, p, q]) & (audit < audits[:, p, q]))
            costs[better, p, q], audits[better, p, q] = cost[better], audit[better]
    costs = np.minimum(costs, _NEVER)
    audits[costs == _NEVER] = b""
    return costs, audits.astype(f"S{max(1, int(np.strings.str_len(audits).max(initial=1)))}")


def _closure() -> Cells:
    """Any number of inserted users and assistants, none included."""
    once = _cell([(p, p, 0, b"") for p in range(STATES)] + [(p, q, INSERT, b"I") for (p, c), q in STEPS.items() if c in "ua"])
    return combine(combine(once, once), once)


CLOSURE = _closure()
EMPTY = _cell([(p, p, 0, b"") for p in range(STATES)])


def _row_cell(initial: str, fault: int) -> Cells:
    """fault: 0 none, 1 truncated, 2 blank or duplicate."""
    made = [(p, p, DELETE, b"D") for p in range(STATES)]
    if fault < 2:
        more = TRUNCATED * fault
        made += [(p, q, KEEP + more, b"K") for (p, c), q in STEPS.items() if c == initial]
        made += [(p, q, REROLE + more, b"R") for (p, c), q in STEPS.items() if c in "ua"]
    return combine(combine(CLOSURE, _cell(made)), CLOSURE)


def _stacked(cells: list[Cells]) -> Cells:
    return np.concatenate([c for c, _ in cells]), np.concatenate([a for _, a in cells])


#: Rows are numbered 3 * initial + fault, where initial is 0 u, 1 a, 2 s, 3 any other; the last cell fills spans up.
FILLER = 12
ROWS = _stacked([_row_cell(INITIALS[k] if k < 3 else "", fault) for k in range(4) for fault in range(3)] + [EMPTY])


def parse(kinds: list[np.ndarray]) -> list[Cells]:
    """The cell of each sequence of row kinds, bottom-up by span length."""
    out: list[Cells] = [CLOSURE] * len(kinds)
    lengths = np.array([len(k) for k in kinds])
    sizes = np.where(lengths > 0, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(int), 0)
    for size in np.unique(sizes[sizes > 0]):
        some = np.flatnonzero(sizes == size)
        filled = np.full((len(some), size), FILLER)
        for row, k in zip(filled, some, strict=True):
            row[:lengths[k]] = kinds[k]
        # Rows of the same kinds have the same cell.
        filled, which = np.unique(filled, axis=0, return_inverse=True)
        costs, audits = ROWS[0][filled.ravel()], ROWS[1][filled.ravel()]
        while len(costs) > len(filled):
            costs, audits = combine((costs[::2], audits[::2]), (costs[1::2], audits[1::2]))
        for k, at in zip(some, which.ravel(), strict=True):
            out[k] = costs[at:at + 1], audits[at:at + 1]
    return out


def joined(cells: list[Cells]) -> Cells:
    """One cell of spans that stand side by side, by doubling."""
    while len(cells) > 1:
        cells = [combine(cells[k], cells[k + 1]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0] if cells else CLOSURE


def cell_of(kinds: np.ndarray) -> Cells:
    """The cell of one sequence of any length, in spans of bounded size."""
    return joined([c for at in range(0, len(kinds), SPAN_ROWS) for c in parse([kinds[at:at + SPAN_ROWS]])])


def best(cell: Cells) -> tuple[int, str]:
    cost, audit = min((int(cell[0][0, 0, q]), bytes(cell[1][0, 0, q])) for q in ENDS)
    return cost, audit.decode()


# Spark side.


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): every twentieth row dropped (gone), emptied, unpunctuated, repeated or made the user's."""
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("lot", F.crc32(key.cast("binary")) % 20)
    lot = F.col("lot")
    return rows.select(
        "conv_id", "turn", F.when(lot == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (lot == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(lot == 3, 2).otherwise(1))).alias("again")).drop("again")


def _rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, same, gone); same tells rows with another role or text apart."""
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"), gone.alias("gone"))
    return rows.withColumn("same", F.unhex(F.sha2("text", 256)))


def _kinds(rows: DataFrame) -> DataFrame:
    """Narrow rows, equal ones counted: (conv_id, turn, role, same, initial, blank, truncated, copies); gone rows name their conversation."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = rows.select(
        "conv_id", F.when(~F.col("gone"), F.col("turn")).alias("turn"), F.when(~F.col("gone"), F.col("role")).alias("role"),
        F.when(~F.col("gone"), F.col("same")).alias("same"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"),
        (~F.col("gone")).cast("long").alias("one"))
    return narrow.groupBy("conv_id", "turn", "role", "same").agg(
        F.bool_and("blank").alias("blank"), F.bool_and("truncated").alias("truncated"), F.sum("one").alias("copies"))


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_RUN = ("conv_id {0}, part int, " + ", ".join(f"{n} long" for n in _COUNTS)
        + ", first_role string, last_role string, first_turn long, last_turn long, low_turn long, costs array<long>, audits array<string>")


class Run:
    """The part of a conversation that one task holds: its counts and its cell."""

    def __init__(self, conv_id):
        self.conv_id, self.kinds = conv_id, []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_role = self.last_role = self.first_turn = self.last_turn = self.low_turn = None

    def add(self, turn, role: str, blank: bool, truncated: bool, copies: int, first: bool) -> None:
        if not copies:
            return
        initial, counts = role[:1], self.counts
        kind = INITIALS.find(initial) if initial else 3
        kind = 3 if kind < 0 else kind
        counts["blank"] += copies * blank
        counts["duplicate"] += 0 if blank else copies - first
        counts["truncated"] += not blank and first and truncated
        counts["illegal"] += (copies - 1) * ((initial, initial) not in LEGAL) + (counts["rows"] > 0 and (self.last_role, initial) not in LEGAL)
        if turn is not None and turn != self.last_turn:
            counts["turns"] += 1
        if not counts["rows"]:
            self.first_role, self.first_turn = initial, turn
        if self.low_turn is None:
            self.low_turn = turn
        counts["rows"] += copies
        self.last_role, self.last_turn = initial, turn
        kept = first and not blank
        if kept:
            self.kinds.append(np.array([3 * kind + truncated], np.int8))
        if copies > kept:
            self.kinds.append(np.full(copies - kept, 3 * kind + 2, np.int8))

    def sequence(self) -> np.ndarray:
        return np.concatenate(self.kinds) if self.kinds else np.zeros(0, np.int8)


def _make_runs(schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def table(runs: list[Run]) -> pa.RecordBatch:
            kinds = [r.sequence() for r in runs]
            short = [k for k, sequence in enumerate(kinds) if len(sequence) <= SPAN_ROWS]
            cells: dict[int, Cells] = dict(zip(short, parse([kinds[k] for k in short]), strict=True))
            rows = []
            for k, run in enumerate(runs):
                costs, audits = cells.get(k) or cell_of(kinds[k])
                rows.append({"conv_id": run.conv_id, "part": part, **run.counts, "first_role": run.first_role, "last_role": run.last_role,
                             "first_turn": run.first_turn, "last_turn": run.last_turn, "low_turn": run.low_turn,
                             "costs": costs.ravel().tolist(), "audits": [a.decode() for a in audits.ravel().tolist()]})
            return pa.RecordBatch.from_pylist(rows, schema)

        held: list[Run] = []
        marker, size = None, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "turn", "role", "same", "mark", "blank", "truncated", "copies")]
            for conv_id, turn, role, same, mark, blank, truncated, copies in zip(*columns, strict=True):
                key = (conv_id, turn, role, same)
                if mark:
                    marker = key
                    continue
                if not held or held[-1].conv_id != conv_id:
                    if size > 4 * SPAN_ROWS:
                        yield table(held)
                        held, size = [], 0
                    held.append(Run(conv_id))
                held[-1].add(turn, role or "", blank, truncated, copies, key == marker)
                size += max(1, copies)
        if held:
            yield table(held)

    return task


def _merge(runs: list[dict]) -> dict:
    """Runs of one conversation in order, as one; each with its cell."""
    out = {n: sum(r[n] for r in runs) for n in _COUNTS}
    full = [r for r in runs if r["rows"]]
    for one, two in zip(full, full[1:], strict=False):
        out["illegal"] += (one["last_role"], two["first_role"]) not in LEGAL
        out["turns"] -= one["last_turn"] is not None and one["last_turn"] == two["first_turn"]
    cells = [(np.array(r["costs"]).reshape(1, STATES, STATES), np.array(r["audits"], dtype="S").reshape(1, STATES, STATES)) for r in full]
    out["cost"], out["audit"] = best(joined(cells))
    low = next((r["low_turn"] for r in full if r["low_turn"] is not None), None)
    high = full[-1]["last_turn"] if full else None
    out["gaps"] = high - low + 1 - out["turns"] if low is not None else 0
    return out


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def diagnose(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows (conv_id, turn, role, text)."""
    small_batches(turns.sparkSession)
    kinds = pin(_kinds(_rows(turns)), "kinds")
    # Where a role and text is met first; nulls come first.
    first = kinds.where("copies > 0").groupBy("conv_id", "role", "same").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    lines = kinds.withColumn("mark", F.lit(False)).unionByName(first.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    order = ["conv_id", "turn", "role", "same"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, F.col("mark").desc())
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = _RUN.format(kind)
    arrow = _arrow(schema, turns.sparkSession)
    runs = pin(dealt.mapInArrow(_make_runs(arrow), schema), "runs")
    named = f"conv_id {kind}, " + ", ".join(f"{n} long" for n in _SUMMARY) + ", audit string"
    whole = _arrow(named, turns.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        out = []
        for conv_id, own in groupby(rows, lambda r: r["conv_id"]):
            out.append({"conv_id": conv_id, **_merge(list(own))})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, whole)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, whole)

    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(join, named)


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """Per conversation its summary and the repaired rows (edit, role, text), one after another."""

    def edits(audit: str, rows: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
        odd, position = (len(audit) - audit.count("D")) % 2, 0
        for edit in audit:
            row = next(rows) if edit != "I" else None
            if edit == "D":
                continue
            role = row["role"] if edit == "K" else "user" if position % 2 == odd else "assistant"
            position += 1
            yield edit, role, row["text"] if row else ""

    stream = (row for batch in batches for row in batch.to_pylist())
    for _, own in groupby(stream, lambda r: r["conv_id"]):
        head = next(own)
        yield head, edits(head["audit"], own)


def _in_order(turns: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """Each conversation's summary, then its rows in order, by conversation."""
    rows = _rows(turns).where(~F.col("gone")).drop("gone")
    both = diagnosed.withColumn("head", F.lit(True)).unionByName(rows.withColumn("head", F.lit(False)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").desc(), "turn", "role", "same").drop("same", "head", "turn")


def repair(turns: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """(conv_id, position from 0, edit, role, text): the repaired conversations. diagnosed: what diagnose() found in them."""
    named = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, position long, edit string, role string, text string"
    arrow = _arrow(named, turns.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for head, edits in _repaired(batches):
            for position, (edit, role, text) in enumerate(edits):
                out.append({"conv_id": head["conv_id"], "position": position, "edit": edit, "role": role, "text": text})
                size += 100 + len(text)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return _in_order(turns, diagnosed).mapInArrow(task, named)


def digest(turns: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """What was found in each conversation, and the SHA-256 of its repaired `role:text` lines."""
    named = diagnosed.schema.add("repaired_sha256", "string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(named)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, edits in _repaired(batches):
            sha = hashlib.sha256()
            for position, (_, role, text) in enumerate(edits):
                sha.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            out.append({n: head[n] for n in arrow.names if n != "repaired_sha256"} | {"repaired_sha256": sha.hexdigest()})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return _in_order(turns, diagnosed).mapInArrow(task, named)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digest(turns, diagnose(turns))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
lots AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS lot FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM lots),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS k FROM damaged),
faults AS (
  SELECT conv_id, turn, role, text, k, left(role, 1) AS ini,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS ini_before FROM placed),
steps(p, ini, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
more(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'),
  (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
one_row AS (
  SELECT conv_id, k, p, q, 2 AS c, 'D' AS a FROM faults, (VALUES (0, 0), (1, 1), (2, 2), (3, 3)) AS s(p, q)
  UNION ALL SELECT conv_id, k, p, q, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM faults JOIN steps USING (ini) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, k, p, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R' FROM faults, steps
    WHERE fault IN ('', 'truncated') AND steps.ini IN ('u', 'a')),
moves AS (
  SELECT conv_id, k, o.p, m.q, min({'c': o.c + m.c, 'a': o.a || m.a}) AS move FROM one_row AS o JOIN more AS m ON m.p = o.q GROUP BY ALL),
ids AS (SELECT DISTINCT conv_id FROM conversations),
cells AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, q, {'c': c, 'a': a} AS cell FROM ids, more WHERE p = 0
  UNION ALL
  SELECT * FROM (
    SELECT c.conv_id, m.k, m.q, min({'c': c.cell.c + m.move.c, 'a': c.cell.a || m.move.a}) AS cell
    FROM cells AS c JOIN moves AS m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.k = c.k + 1 AND m.p = c.q
    GROUP BY c.conv_id, m.k, m.q)),
sizes AS (
  SELECT i.conv_id, count(k) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (k > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids AS i LEFT JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM i.conv_id GROUP BY i.conv_id),
cheapest AS (
  SELECT s.*, w.best.c AS cost, w.best.a AS audit FROM sizes AS s JOIN (
    SELECT c.conv_id, c.k, min(cell) AS best FROM cells AS c WHERE q IN (0, 3) GROUP BY c.conv_id, c.k) AS w
  ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.k = s.n),
letters AS (
  SELECT conv_id, audit, i, audit[i] AS edit, length(replace(audit, 'D', '')) % 2 AS odd, i - length(replace(audit[1:i], 'I', '')) AS inserted,
    length(replace(audit[1:i], 'D', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM cheapest)),
repaired AS (
  SELECT l.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - 1) % 2 = odd THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS lines
  FROM letters AS l LEFT JOIN placed AS r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.k = l.i - l.inserted AND l.edit <> 'I'
  WHERE edit <> 'D' GROUP BY l.conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM cheapest AS c LEFT JOIN repaired AS r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
