r"""Operator 9, chat formatting with a grammar round trip, in DataFrame functions only.

Grammar: ``<s>`` and then turns: ``[INST] text [/INST]`` (user), `` text </s>`` (assistant), ``[SYS] text [/SYS]``
(system), ``[ROLE:base64] text [/ROLE]`` (any other role). A text holds no marker; in an escaped text ``\\`` is a
backslash, and a backslash after the first character of a marker breaks it. The parser splits after end markers,
reads role and text from each piece, rejects pieces whose text holds a marker, and unescapes.

A rendered conversation is parsed again and compared with the source. Should it differ, each turn is rendered and parsed
by itself, those that differ are escaped, and the conversation is parsed again; should that differ, it is escaped
throughout and parsed once more. The result is read from the final parse.

Defined results: turns are ordered by turn, role and text (null turns first); null role or text is empty; repeated
rows are turns of their own; null conv_id is a conversation; an empty table gives an empty result; further columns
are ignored. A conversation is one row, so it must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = r"</?s>|\[/?(?:INST|SYS)\]|\[/?ROLE"
ESCAPED = r"(\\|<(?=/?s>)|\[(?=/?(?:INST\]|SYS\]|ROLE)))"
END = r"(?<= \[/INST\]| </s>| \[/SYS\]| \[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def render(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit(" "), text, F.lit(" </s>")))
        .when(role == "system", F.concat(F.lit("[SYS] "), text, F.lit(" [/SYS]")))
        .otherwise(F.concat(F.lit("[ROLE:"), F.base64(role.cast("binary")), F.lit("] "), text, F.lit(" [/ROLE]")))
    )


def inner(piece: Column, head: Column, tail: int) -> Column:
    return F.substring(piece, head + 1, F.length(piece) - head - tail)


def parse_piece(piece: Column) -> Column:
    """struct(role, text, raw): raw is the text as it stands; a piece outside the grammar has a null role."""
    shut = F.instr(piece, "] ")
    role = F.unbase64(F.substring(piece, F.lit(7), shut - 7)).cast("string")

    def turn(name: Column, raw: Column) -> Column:
        bad = raw.rlike(MARKER)
        return F.struct(F.when(~bad, name).alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return (
        F.when(piece.startswith("[INST] ") & piece.endswith(" [/INST]") & (F.length(piece) >= 15), turn(F.lit("user"), inner(piece, F.lit(7), 8)))
        .when(piece.startswith("[SYS] ") & piece.endswith(" [/SYS]") & (F.length(piece) >= 13), turn(F.lit("system"), inner(piece, F.lit(6), 7)))
        .when(piece.startswith("[ROLE:") & piece.endswith(" [/ROLE]") & (shut > 0) & (F.length(piece) >= shut + 9), turn(role, inner(piece, shut + 1, 8)))
        .when(piece.startswith(" ") & piece.endswith(" </s>") & (F.length(piece) >= 6), turn(F.lit("assistant"), inner(piece, F.lit(1), 5)))
        .otherwise(F.struct(F.lit(None).cast("string").alias("role"), piece.alias("text"), piece.alias("raw")))
    )


def parse(rendered: Column) -> Column:
    """Turns of a rendered conversation: array of struct(role, text, raw)."""
    body = F.substring(rendered, F.lit(4), F.length(rendered))
    return F.transform(F.filter(F.split(body, END, -1), lambda x: x != ""), parse_piece)


def said(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, round_trip, loss_runs`` of ``conversations`` rows.

    ``turns``: the parsed turns (role, text, raw). ``loss_runs``: the loss mask, per turn after the three characters
    of ``<s>`` the code points masked, learned (the assistant's text as it stands) and masked again.
    """
    src = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    src = src.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    src = src.withColumn("source", said(F.col("source")))

    def settle(t: Column) -> Column:
        back = parse(F.concat(F.lit("<s>"), render(t["role"], t["text"])))
        same = said(back) == F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return render(t["role"], F.when(F.coalesce(same, F.lit(False)), t["text"]).otherwise(escape(t["text"])))

    def joined(pieces: Column) -> Column:
        return F.concat(F.lit("<s>"), F.array_join(pieces, ""))

    def tried(rows: DataFrame, otherwise: Column) -> DataFrame:
        """Render and parse again, where the parsed turns are not the source's yet."""
        done = F.col("same")
        rows = rows.withColumn("formatted", F.when(done, F.col("formatted")).otherwise(otherwise))
        rows = rows.withColumn("turns", F.when(done, F.col("turns")).otherwise(parse(F.col("formatted"))))
        return rows.withColumn("same", F.when(done, F.lit(True)).otherwise(F.coalesce(said(F.col("turns")) == F.col("source"), F.lit(False))))

    out = src.withColumn("formatted", joined(F.transform("source", lambda t: render(t["role"], t["text"])))).withColumn("turns", parse(F.col("formatted")))
    out = out.withColumn("same", F.coalesce(said(F.col("turns")) == F.col("source"), F.lit(False)))
    out = tried(out, joined(F.transform("source", settle)))
    out = tried(out, joined(F.transform("source", lambda t: render(t["role"], escape(t["text"])))))

    def runs(t: Column) -> Column:
        whole, ours = F.length(render(t["role"], t["raw"])), t["role"] == "assistant"
        learned = F.when(ours, F.length(t["raw"])).otherwise(F.lit(0))
        return F.struct(F.when(ours, F.lit(1)).otherwise(whole).alias("before"), learned.alias("learned"), F.when(ours, F.lit(5)).otherwise(F.lit(0)).alias("after"))

    return out.select("conv_id", "formatted", "turns", F.transform("turns", runs).alias("loss_runs"), F.col("same").alias("round_trip"))


def chat_digest(rows: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, all read back from the formatted text."""
    f = format_conversations(rows)
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose texts are made of control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN regexp_matches(text, '\\|</?s>|\[/?(INST|SYS)\]|\[/?ROLE') THEN length(text)
    + length(text) - length(replace(text, '\', ''))
    + length(regexp_replace(text, '</?s>|\[/?(INST|SYS)\]|\[/?ROLE', '#\0', 'g')) - length(text) ELSE length(text) END AS n
  FROM src
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 13
    ELSE 16 + length(to_base64(encode(role))) END) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM e GROUP BY conv_id
"""
