"""Chat formatting with a declarative template, in DataFrame functions only.

A finite-state machine over roles validates the order of turns. Every turn becomes text segments, each with its loss
flag. Control strings inside texts are broken by a backslash after their first character, and backslashes are
doubled, so the formatted text can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, what is trained on, and which role may follow which ("" is the start and the end)."""

    open_turn: str = "<|turn|>"
    open_text: str = "<|text|>"
    close_turn: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str], ...] = (
        ("", "system"),
        ("", "user"),
        ("system", "user"),
        ("user", "assistant"),
        ("assistant", "user"),
        ("assistant", ""),
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open_turn, self.open_text, self.close_turn, *self.foreign)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """A backslash goes; of two, one stays."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\(\\?)", "$1")).otherwise(text)


def turn_order(turns: Column, template: Template) -> Column:
    """The machine's verdict over an ordered array of ``(turn, role, text)``: null if valid, else the first bad move."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in template.moves])
    roles = F.concat(F.transform(turns, lambda t: F.coalesce(t["role"], F.lit("?"))), F.array(F.lit("")))
    begin = F.struct(F.lit("").alias("state"), F.lit(None).cast("string").alias("bad"))
    return F.aggregate(
        roles,
        begin,
        lambda acc, role: F.struct(
            role.alias("state"),
            F.coalesce(
                acc["bad"],
                F.when(~F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), role)), F.concat(acc["state"], F.lit(">"), role)),
            ).alias("bad"),
        ),
        lambda acc: acc["bad"],
    )


def segments(turns: Column, template: Template) -> Column:
    """Array of ``(text, loss)``: a header, the escaped text and an end mark for every turn."""
    lit = lambda s, loss=False: F.struct(s.alias("text"), F.lit(loss).alias("loss"))

    def one(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        head = F.concat(F.lit(template.open_turn), escape(role, template), F.lit(template.open_text))
        body = F.struct(
            escape(F.coalesce(t["text"], F.lit("")), template).alias("text"), role.isin(*template.loss_roles).alias("loss")
        )
        return F.array(lit(head), body, lit(F.lit(template.close_turn)))

    return F.flatten(F.transform(turns, one))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, segments, formatted, error)``, one row a conversation.

    Turns are ordered by turn, then role, then text; a null turn comes first, a null role is formatted as an empty
    one and breaks the order, a null text is empty, null ids form one conversation, repeated rows stay. A
    conversation with an invalid order is formatted all the same; ``error`` names its first bad move. One
    conversation is one training example, so its turns meet in one row by definition. Other columns are not read.
    """
    gathered = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    made = gathered.select("conv_id", segments(F.col("turns"), template).alias("segments"), turn_order(F.col("turns"), template).alias("error"))
    return made.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "error"
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The formatted text as an array of ``(role, text)``, unescaped."""
    quoted = lambda s: "\\Q" + s + "\\E"
    pieces = F.filter(F.split(formatted, quoted(template.close_turn), -1), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(template.open_turn) + 1)), quoted(template.open_text), -1))
    return F.transform(body, lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    chats = format_chats(rows.unionByName(own))
    read = chats.select("conv_id", "formatted", "error", "segments", read_back(F.col("formatted")).alias("t"))
    # the mask comes with the output, three segments a turn; the text under it is what reads back from the output
    mask = F.filter("segments", lambda s, i: i % 3 == 1)
    trained = F.array_join(F.zip_with("t", mask, lambda t, m: F.when(m["loss"], t["text"]).otherwise("")), "")
    whole = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("error").isNull().alias("valid"),
    )


def _oracle(template: Template = Template()) -> str:
    def esc(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for c in template.controls:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    marks = len(template.open_turn + template.open_text + template.close_turn)
    moves = ", ".join(f"'{a}>{b}'" for a, b in template.moves)
    roles = ", ".join(f"'{r}'" for r in template.loss_roles)
    return f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
o AS (SELECT *, coalesce(role, '') AS r, row_number() OVER q AS k,
  coalesce(lag(coalesce(role, '?')) OVER q, '') || '>' || coalesce(role, '?') AS move FROM c
  WINDOW q AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(r || chr(10) || text || chr(10), '' ORDER BY k) AS w,
  coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE r IN ({roles})), '') AS l,
  sum({marks} + length({esc('r')}) + length({esc('text')}))::BIGINT AS formatted_chars,
  bool_and(move IN ({moves})) AND (max_by(r, k) || '>') IN ({moves}) AS valid FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(w) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256,
  formatted_chars, valid FROM g"""


OP5_SQL = _oracle()
