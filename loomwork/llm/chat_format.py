r"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

Native: DataFrame functions only. A conversation is one array of turns; a fold over it
runs the state machine, and another writes text segments, each with a loss flag. The whole
formatted text and its segments are the output.

Template: a turn is OPEN + label + SEP + text + CLOSE. Within texts and labels every backslash is
doubled, and a backslash is put after the first character of every control string. A
control string of the template then never occurs inside a text, and dropping one backslash of each
escape gives the text back.

Defined cases: null text is empty; null role is an empty role; roles that the template doesn't name
are kept under an escaped label; turns are ordered by (turn, role, text), nulls first, and repeated turns are all
kept; an order of roles that the machine rejects is flagged (`valid`, `bad_turn`), never dropped. A
conversation is the unit of the output, so all its turns meet in one row; a very long text is one
segment; empty conversations give no rows; columns are picked by exact name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import pick


@dataclass(frozen=True)
class Template:
    """What marks turns, which roles are under the loss, and which role may follow which."""

    open: str = "### "
    sep: str = ":\n"
    close: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "="  #: stands before a role that has no label
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("### System:", "### User:", "### Assistant:", "### =", "</turn>")
    #: state -> role -> next state; the machine starts in "start" and may end in `final`.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered", "asked")


CHAT = Template()


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c == " " or c == "\n" else "\\" + c for c in s)


def escape(text: Column, t: Template, more: tuple[str, ...] = ()) -> Column:
    """Double backslashes, and put one after the first character of every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    heads = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in (*t.controls, *more))
    return F.regexp_replace(text, heads, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _label(role: Column, t: Template) -> Column:
    out = F.concat(F.lit(t.other), escape(role, t, (t.sep,)))
    for name, label in t.labels.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column, t: Template) -> Column:
    out = unescape(F.substring(label, len(t.other) + 1, 2**31 - 1))
    for name, shown in t.labels.items():
        out = F.when(label == shown, F.lit(name)).otherwise(out)
    return out


def _machine(turns: Column, t: Template) -> Column:
    """struct(state, bad): the state after the last turn, and the place of the first turn that no move allows (null: none)."""
    table = F.create_map(*[F.lit(x) for s, row in t.moves.items() for r, to in row.items() for x in (f"{s}\n{r}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("rejected")).alias("state"),
            F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"])).alias("bad"),
            (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(turns, start, step)


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, n_turns, valid, bad_turn, segments, formatted), one row per conversation.

    turns: conv_id, turn, role, text. segments: array of (text, loss), whose texts make up `formatted`.
    """
    t = template
    rows = pick(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("one")
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    is_loss = lambda role: role.isin(*t.loss_roles)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.open), _label(x["role"], t), F.lit(t.sep)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"], t).alias("text"), is_loss(x["role"]).alias("loss")),
                F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _machine(F.col("turns"), t).alias("run"), segments.alias("segments"))
    return chats.select(
        "conv_id",
        "n_turns",
        (F.col("run.bad").isNull() & F.col("run.state").isin(*t.final)).alias("valid"),
        F.col("run.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_chats(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """formatted with two more columns, (turns, loss_text): the turns parsed from `formatted`, and the unescaped texts of the segments under the loss."""
    t = template
    pieces = F.split("formatted", _quoted(t.close))
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))  # after the last close nothing is left
    cut = lambda p: F.locate(t.sep, p)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            _role(F.substring(p, F.lit(len(t.open) + 1), cut(p) - len(t.open) - 1), t).alias("role"),
            unescape(F.substring(p, cut(p) + len(t.sep), F.length(p))).alias("text"),
        ),
    )
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})
