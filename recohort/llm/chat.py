"""Chat formatting as a grammar round trip, with DataFrame functions only.

A turn is written as

    <turn ROLE>            or, when the text had to be escaped,   <quoted-turn ROLE>
    TEXT
    </turn>

A text is first written as it is, read back by the parser, and compared with its source; a text that conflicts with the
grammar is escaped instead. The whole conversation is then read back and compared again, and a difference is an error.

Defined results: a null role or text is empty; turns are ordered by (turn, role, text) with nulls first, so repeated rows
stay as repeated turns; rows of a null conversation form one conversation; an empty table gives no row; other columns are
ignored. A conversation is one string, so its digest takes one task, like the string itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAIN, QUOTED, CLOSE = "<turn ", "<quoted-turn ", "\n</turn>\n"
#: What the escapes \0 to \3 stand for. The backslash comes first when escaping and last when reading back.
ESCAPES = ("\\", "<", ">", "\n")


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, strings: tuple[str, ...] = ESCAPES[:2]) -> Column:
    for number, string in enumerate(strings):
        text = _replaced(text, string, f"\\{number}")
    return text


def unescape(text: Column, strings: tuple[str, ...] = ESCAPES[:2]) -> Column:
    for number in reversed(range(len(strings))):
        text = _replaced(text, f"\\{number}", strings[number])
    return text


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, quoted)."""

    def turn(piece: Column) -> Column:
        quoted = F.startswith(piece, F.lit(QUOTED))
        head = F.instr(piece, ">\n")
        begin = F.when(quoted, len(QUOTED)).otherwise(len(PLAIN))
        role = F.substr(piece, begin + 1, head - 1 - begin)
        text = F.substr(piece, head + 2)
        return F.struct(unescape(role, ESCAPES).alias("role"),
                        F.when(quoted, unescape(text)).otherwise(text).alias("text"), quoted.alias("quoted"))

    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def _bare(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of rows (conv_id, turn, role, text).

    loss_spans: array of (start from 0, length, quoted), in code points of `formatted`: the assistant texts in order.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    plain = F.concat(F.lit(PLAIN), escape(F.col("role"), ESCAPES), F.lit(">\n"), F.col("text"), F.lit(CLOSE))
    rows = rows.withColumn("written", plain)
    same = _bare(parse(F.col("written"))) == F.array(F.struct("role", "text"))
    rows = rows.withColumn("quoted", ~same)
    quoted = F.concat(F.lit(QUOTED), escape(F.col("role"), ESCAPES), F.lit(">\n"), escape(F.col("text")), F.lit(CLOSE))
    rows = rows.withColumn("written", F.when(F.col("quoted"), quoted).otherwise(F.col("written")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("written")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.instr("written", ">\n") + 1
    span = F.struct((before + head).alias("start"),
                    (F.length("written") - head - len(CLOSE)).cast("long").alias("length"), "quoted")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("span", span)
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "written", "role", "text", "span"))).alias("all"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("all", lambda t: t["written"]), ""))
    spans = F.transform(F.filter("all", lambda t: t["role"] == "assistant"), lambda t: t["span"])
    checked = F.when(_bare(parse(F.col("formatted"))) == _bare(F.col("all")), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not read back as its source")))
    return whole.select("conv_id", checked.alias("formatted"), spans.alias("loss_spans"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, joined without anything between."""

    def one(span: Column) -> Column:
        text = F.substr(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return F.when(span["quoted"], unescape(text)).otherwise(text)

    return F.array_join(F.transform(spans, one), "")


def digest(written: DataFrame) -> DataFrame:
    """What formatted conversations hold, read back from them."""
    parsed = written.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    from recohort.session import pin

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digest(pin(format_conversations(turns.unionByName(hard)), "chat"))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\0'), '<', '\1'), '>', '\2'), chr(10), '\3') AS r,
    instr(chr(10) || text || chr(10) || '</turn>' || chr(10), chr(10) || '</turn>' || chr(10)) <> length(text) + 2 AS quoted
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + 2 + 9 + CASE WHEN quoted THEN 13 + length(replace(replace(text, '\', '\0'), '<', '\1'))
      ELSE 6 + length(text) END) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
