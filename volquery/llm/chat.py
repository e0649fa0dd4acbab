"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<s>[INST] " role " [/INST] " text "</s>"

Roles and texts are written as they are.  Every rendered turn is reparsed; where the parser does not
give the turn back, its content is escaped at the conflicting places, and if need be everywhere, until
it does.  The parser knows no levels: it always undoes escapes.  It takes each control string for
grammar wherever it stands, so content that holds one does not parse back and no control string is ever
left inside content.

Escapes are ``\\0`` for ``\\``, ``\\1`` for ``<`` and ``\\2`` for ``[``, so no control string can occur in
escaped content, and undoing them in the order 1, 2, 0 is exact.  Native column expressions only.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: Places at which raw content would read as a control string or as an escape.
CONFLICTS = ((r"\\(?=[012])", r"\\0"), (r"<(?=/?s>)", r"\\1"), (r"\[(?=/?INST\])", r"\\2"))
EVERYWHERE = ((r"\\", r"\\0"), (r"<", r"\\1"), (r"\[", r"\\2"))
LEVELS = ((), CONFLICTS, EVERYWHERE)


def _escape(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, code in rules:
        text = F.regexp_replace(text, pattern, code)
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\1"), F.lit("<")), F.lit("\\2"), F.lit("[")), F.lit("\\0"), F.lit("\\"))


def render_turn(role: Column, text: Column, level: int) -> Column:
    rules = LEVELS[level]
    return F.concat(F.lit(OPEN), _escape(role, rules), F.lit(MIDDLE), _escape(text, rules), F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """Array of ``struct(role, text, raw, raw_role)`` read from a rendered conversation; null where it
    does not follow the grammar, as where a control string stands in a role or a text.  ``raw`` and
    ``raw_role`` are as written, escapes included."""
    parts = F.split(rendered, "</s>", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def plain(part: Column) -> Column:
        """One opening, one middle and no other control string."""
        body = F.substr(part, F.lit(len(OPEN) + 1))
        at = F.instr(body, MIDDLE)
        content = F.concat_ws("\n", F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(MIDDLE)))
        return part.startswith(OPEN) & (at > 0) & ~functools.reduce(operator.or_, [content.contains(c) for c in CONTROL])

    def turn(part: Column) -> Column:
        # the role is escaped too, so the first MIDDLE ends it
        body = F.substr(part, F.lit(len(OPEN) + 1))
        at = F.instr(body, MIDDLE)
        raw = F.substr(body, at + len(MIDDLE))
        role = F.substr(body, F.lit(1), at - 1)
        return F.struct(unescape(role).alias("role"), unescape(raw).alias("text"), raw.alias("raw"), role.alias("raw_role"))

    well_formed = (F.element_at(parts, -1) == "") & F.forall(turns, plain)
    return F.when(rendered == "", F.array().cast("array<struct<role:string,text:string,raw:string,raw_role:string>>")).when(well_formed, F.transform(turns, turn))


def formatted_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per turn: ``_conv, _turn, _role, _text, _rendered, _level``; the lowest level whose
    rendering, parsed again, is exactly the turn.  The expression of a level is only evaluated when
    the one before it failed."""
    base = rows.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    # a cheap test that every conflict passes: content without these signs is its own rendering
    suspect = F.col("_role").rlike(r"[\\<\[]") | F.col("_text").rlike(r"[\\<\[]")

    def holds(level: int) -> Column:
        got = parse(render_turn(F.col("_role"), F.col("_text"), level))
        same = (F.size(got) == 1) & (got[0]["role"] == F.col("_role")) & (got[0]["text"] == F.col("_text"))
        return F.coalesce(same, F.lit(False))

    wrong = F.raise_error(F.lit("a turn does not survive its escapes")).cast("int")
    level = F.when(~suspect, 0).when(holds(0), 0).when(holds(1), 1).when(holds(2), 2).otherwise(wrong)
    leveled = base.withColumn("_level", level)
    rendered = F.when(F.col("_level") == 0, render_turn(F.col("_role"), F.col("_text"), 0))
    rendered = rendered.when(F.col("_level") == 1, render_turn(F.col("_role"), F.col("_text"), 1)).otherwise(render_turn(F.col("_role"), F.col("_text"), 2))
    return leveled.withColumn("_rendered", rendered)


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, formatted, turns, loss_spans, round_trip``.

    ``turns`` is what the parser reads back from ``formatted``; ``loss_spans`` the (start, end) code
    points of assistant texts in it, as written; ``round_trip`` whether the parse equals the source.

    Turns are ordered by ``turn``, ties by role, then text; repeated rows are turns of their own.
    Null texts and roles are empty, null turns come first, rows with a null conversation form one
    conversation, an empty table gives no rows.  Texts of any length are formatted whole.  A conversation is one output value, so its turns meet
    in one task by definition; tasks hold many conversations."""
    turns = formatted_turns(rows, conv, turn, role, text)
    item = F.struct(F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_rendered").alias("rendered"))
    whole = turns.groupBy("_conv").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    whole = whole.select("_conv", "_items", F.array_join(F.transform("_items", lambda x: x["rendered"]), "").alias("formatted"))
    read = whole.withColumn("turns", parse(F.col("formatted")))
    pairs = F.transform("_items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    back = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    same = F.coalesce(pairs == back, F.lit(False))
    # a running end over the parsed turns: roles are measured as they are written
    start = F.aggregate(
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.length(x["raw"]).alias("raw"), F.length(render_turn(x["raw_role"], F.lit(""), 0)).alias("frame"))),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["end"] + x["frame"] + x["raw"]).alias("end"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["end"] + x["frame"] - len(CLOSE)).alias("start"), (acc["end"] + x["frame"] - len(CLOSE) + x["raw"]).alias("stop"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return read.select(F.col("_conv").alias(conv), "formatted", "turns", start["spans"].alias("loss_spans"), same.alias("round_trip"))


def chat_digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what is read back from ``formatted``: turns by the parser, loss text by its spans."""
    listed = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    # each span is unescaped by itself: the end of one and the start of the next may look like an escape
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))), "")
    return formatted.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )


#: The digests of ``chat_digest`` for plain roles.  From the rule that content with a control string or an
#: escape is escaped at each of them, by one more character.
ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|\\[012]')) + length('<s>[INST] ') + length(' [/INST] ') + length('</s>') AS chars
  FROM rows_),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS listed,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars
  FROM written GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(listed) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, true AS round_trip FROM whole
"""
