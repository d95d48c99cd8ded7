"""Chat formatting in DataFrame functions only: a state machine and a declarative template.

A template gives each role a prefix, a suffix and a loss flag; a table of transitions gives
the order of roles. A conversation becomes segments (text, loss): control strings are never
under the loss, an assistant's text is. Inside texts the two characters that begin every
control string, and the escape character, are replaced by two-character codes, so no text
can imitate a control string and the output can be parsed back exactly.

Every conversation is one output row, so its turns meet in one row; conversations are told
apart by their id, turns are ordered by turn, then role, then text.

Defined results: null texts and roles are empty strings; roles that the template doesn't
name get the generic form and make the order invalid; repeated turns are kept and ordered
like ties; a null conv_id is a conversation of its own; only the named columns are read; an
empty table gives an empty result. Texts of any length are formatted whole; a conversation
must fit in a row of Spark (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: role: (prefix, suffix, loss); control strings begin with "[" or "<", or are one space
    roles: dict = field(default_factory=lambda: {
        "system": ("<<SYS>> ", " <</SYS>>", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": (" ", " </s>", True),
    })
    other: tuple = ("<|", "|> ", " <|/|>")
    #: state: {role: next state}; a conversation is valid if it ends in ``final``
    order: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    final: str = "assistant"


#: the escape character first: a code never contains a character that is still to be replaced
CODES = (("\\", "\\e"), ("[", "\\b"), ("<", "\\l"), ("|", "\\p"))


def escape(c: Column) -> Column:
    for raw, code in CODES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(CODES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def _segments(template: Template, t: Column) -> Column:
    role, text = t["role"], escape(t["text"])
    seg = lambda x, loss: F.struct(x.alias("text"), F.lit(loss).alias("loss"))
    a, b, c = template.other
    out = F.array(seg(F.concat(F.lit(a), escape(role), F.lit(b)), False), seg(text, False), seg(F.lit(c), False))
    for name, (prefix, suffix, loss) in template.roles.items():
        out = F.when(role == name, F.array(seg(F.lit(prefix), False), seg(text, loss), seg(F.lit(suffix), False))).otherwise(out)
    return out


def _valid(template: Template, turns: Column) -> Column:
    steps = F.create_map(*[F.lit(x) for s, by in template.order.items() for r, n in by.items() for x in (f"{s}>{r}", n)])
    end = F.aggregate(turns, F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(">"), t["role"])), F.lit("error")))
    return end == template.final


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)


def parsed(template: Template, formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted string."""
    a, b, c = template.other
    forms = [f"{_quoted(p)}[^\\[<]*{_quoted(s)}" for p, s, _ in template.roles.values()]
    forms.append(f"{_quoted(a)}[^\\[<|]*{_quoted(b)}[^\\[<]*{_quoted(c)}")
    pieces = F.regexp_extract_all(formatted, F.lit("|".join(forms)), F.lit(0))

    def inner(x: Column, left: Column, right: int) -> Column:
        return F.substring(x, left + 1, F.length(x) - left - right)

    def turn(x: Column) -> Column:
        cut = F.instr(x, b) - 1
        role = unescape(F.substring(x, F.lit(len(a) + 1), cut - len(a)))
        out = F.struct(role.alias("role"), unescape(inner(x, cut + len(b), len(c))).alias("text"))
        for name, (p, s, _) in template.roles.items():
            out = F.when(F.startswith(x, F.lit(p)), F.struct(F.lit(name).alias("role"), unescape(inner(x, F.lit(len(p)), len(s))).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, turn)


def format_conversations(
    rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments, formatted, valid."""
    template = template or Template()
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", lambda t: _segments(template, t))).alias("segments"), _valid(template, F.col("turns")).alias("valid"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def chat_digest(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of turns and loss, both read back from the formatted output."""
    template = template or Template()
    out = format_conversations(rows, template).withColumn("back", parsed(template, F.col("formatted")))
    learned = [name for name, (_, _, loss) in template.roles.items() if loss]
    out = out.withColumn("loss_text", F.array_join(F.transform(F.filter("back", lambda t: t["role"].isin(learned)), lambda t: t["text"]), ""))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
