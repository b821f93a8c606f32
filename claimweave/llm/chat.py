"""Chat formatting: a declarative template, a finite-state machine over roles, segments with loss flags.

DataFrame functions only. Texts are escaped so that no control string can be forged, whatever the
template's marks are: first each backslash is doubled, then a backslash is put after the first
character of each pair that a mark begins with ("<|" in the default template). After that a single
backslash stands between two such characters only where the pair stood, so the way back is exact.
A mark of one character, or of two equal ones, is told by that character, which becomes three
others around a single backslash. Role names take the same escapes, and those of the mark that
ends a role ("\\n", which becomes "<\\+").
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles that are learnt, and the roles that may follow a state."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> next state; a conversation is valid if it runs from start to a final state.
    moves: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "briefed"),
        ("begin", "user", "asked"),
        ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("asked", "tool", "asked"),
        ("answered", "user", "asked"),
        ("answered", "tool", "asked"),
    )
    final: tuple[str, ...] = field(default=("answered",))

    def __post_init__(self):
        """Marks must be there, hold no backslash, and what stands before a text mustn't run into the end mark."""
        for mark in (self.start, self.after_role, self.end):
            if not mark or "\\" in mark:
                raise ValueError(f"a template's marks can't be empty or hold a backslash: {mark!r}")
        for before in (self.start, self.after_role):
            if self.end in before or any(self.end.startswith(before[k:]) for k in range(len(before))):
                raise ValueError(f"the end mark {self.end!r} would begin in {before!r}")


CHATML = Template()


def escapes(*marks: str) -> list[tuple[str, str]]:
    """What to replace, and by what, in order, so that none of the marks can occur in a text."""
    pairs = list(dict.fromkeys(m[:2] for m in marks if len(m) > 1 and m[0] != m[1]))
    singles = list(dict.fromkeys(m[0] for m in marks if len(m) == 1 or m[0] == m[1]))
    # what is put in must not make up a pair with what stands beside it
    around = next(c for c in "<=~^_" if c not in singles and c not in {p[1] for p in pairs})
    codes = [c for c in "+-*/.,;:ABCDEFGH" if c not in singles and c not in {p[0] for p in pairs}]
    return [("\\", "\\\\")] + [(p, f"{p[0]}\\{p[1]}") for p in pairs if p[0] not in singles and p[1] not in singles] + [(c, f"{around}\\{code}") for c, code in zip(singles, codes, strict=False)]


def escape(text: Column, template: Template = CHATML) -> Column:
    return replaced(text, escapes(template.start, template.end))


def unescape(text: Column, template: Template = CHATML) -> Column:
    return replaced(text, [(b, a) for a, b in reversed(escapes(template.start, template.end))])


def escape_role(role: Column, template: Template = CHATML) -> Column:
    return replaced(role, escapes(template.start, template.end, template.after_role))


def unescape_role(role: Column, template: Template = CHATML) -> Column:
    return replaced(role, [(b, a) for a, b in reversed(escapes(template.start, template.end, template.after_role))])


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def next_state(template: Template, state: Column, role: Column) -> Column:
    """The machine's move; anything not allowed leads to 'error', which it never leaves."""
    out = F.lit("error")
    for at, by, to in reversed(template.moves):
        out = F.when((state == at) & (role == by), F.lit(to)).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, segments array<struct<text, loss>>, formatted, state, valid: one row per conversation.

    Rows count by turn, ties by role then text, null turns first. Null role or text: empty. A
    null conv_id is a conversation of its own; repeated rows are turns of their own. Invalid
    turn orders are formatted too and marked valid = false. Empty table: no rows. Other columns
    are not read, whatever their names. A conversation must fit in one row, as its text does.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(template.start), escape_role(t["role"], template), F.lit(template.after_role))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(head(t), no),
                segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.end), no),
            ),
        )
    )
    state = F.aggregate("turns", F.lit("begin"), lambda s, t: next_state(template, s, t["role"]))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        segments.alias("segments"),
        state.alias("state"),
    ).select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("state").isin(*template.final).alias("valid"))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> from a formatted conversation: the inverse of format_chats."""
    parts = F.split(formatted, F.lit(quoted(template.end)), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last end mark is empty
    body = lambda p: F.substr(p, F.lit(len(template.start) + 1))
    cut = lambda p: F.locate(template.after_role, body(p))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substr(body(p), F.lit(1), cut(p) - 1), template).alias("role"),
            unescape(F.substr(body(p), cut(p) + len(template.after_role)), template).alias("text"),
        ),
    )


def quoted(text: str) -> str:
    """A regular expression for the literal text."""
    return "".join(c if c.isalnum() or c == "\n" else f"\\{c}" for c in text)
