"""Chat formatting by a finite-state machine over roles and a declarative template.

A template says for each role what opens and closes its turn and whether its text is learned from
(the loss flag), and which role may follow which.  A conversation's turns are folded through the
machine, which gives its validity and first wrong turn, and become text segments with a loss flag
each; the formatted text is their concatenation.  Control strings inside texts are escaped
reversibly: a backslash goes behind their first character, and backslashes are doubled.  A role
that the template does not know gets a turn that names it, so every conversation is formatted and
can be read back.

Only DataFrame operations run here.  A conversation is one record, as a document is: its turns come
together in one row.  Defined results: null text and null role count as empty; turns go by number
(null first), then role, then text, so ties and repeated rows keep a fixed order; an empty table
has an empty result; other columns take no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import text_or_empty


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    control: tuple[str, ...]                 # strings that have a meaning in the format
    turns: dict[str, Turn]
    after: dict[str, tuple[str, ...]]        # state -> roles that may come next; a role is the next state
    last: tuple[str, ...]                    # states in which a conversation may end
    start: str = "start"
    other: tuple[str, str, str] = field(default=("<<ROLE>>", "<</ROLE>>", "<<END>>"))  # of unknown roles

    def __post_init__(self):
        opens = [t.open for t in self.turns.values()] + [self.other[0]]
        for t in self.turns.values():
            if not (t.open.startswith(self.control) and any(c in t.close for c in self.control)):
                raise ValueError("a turn begins with a control string and its closing has one")
        if any(a != b and a.startswith(b) for a in opens for b in opens) or len(set(opens)) < len(opens):
            raise ValueError("no turn's opening may begin with another's")
        if any("\\" in c or len(c) < 2 or any(c != d and c in d for d in self.control) for c in self.control):
            raise ValueError("control strings: two characters or more, no backslash, none inside another")


INST = Template(
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<END>>"),
    turns={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
           "user": Turn("[INST] ", " [/INST]"),
           "assistant": Turn("<s>", "</s>", loss=True)},
    after={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    last=("user", "assistant"),
)


def escape(c: Column, t: Template) -> Column:
    """``c`` with no control string in it."""
    inside = "|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in t.control)
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), inside, r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def _of_role(t: Template, role: Column, what) -> Column:
    """``what`` of the template's turn for ``role``; null for other roles."""
    out = None
    for name, turn in t.turns.items():
        value = F.lit(what(turn))
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out


def turn_segments(role: Column, text: Column, t: Template) -> Column:
    """The three segments (text, loss) of a turn: opening, escaped text, closing."""
    head, name_end, close = t.other
    opening = F.coalesce(_of_role(t, role, lambda x: x.open), F.concat(F.lit(head), escape(role, t), F.lit(name_end)))

    def segment(s, loss):
        return F.struct(s.alias("text"), loss.alias("loss"))

    return F.array(segment(opening, F.lit(False)),
                   segment(escape(text, t), F.coalesce(_of_role(t, role, lambda x: x.loss), F.lit(False))),
                   segment(F.coalesce(_of_role(t, role, lambda x: x.close), F.lit(close)), F.lit(False)))


def _states(roles: Column, t: Template) -> Column:
    """(state, turns accepted, wrong) after the machine has read the roles; it stays at a wrong one."""

    def step(acc, role):
        ok = F.lit(False)
        for state, following in t.after.items():
            ok = ok | ((acc["state"] == state) & role.isin(*following))
        ok = ok & ~acc["wrong"]
        return F.struct(F.when(ok, role).otherwise(acc["state"]).alias("state"),
                        (acc["n"] + ok.cast("int")).alias("n"), (~ok).alias("wrong"))

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(False).alias("wrong"))
    return F.aggregate(roles, begin, step)


def format_conversations(rows: DataFrame, template: Template = INST, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, first_wrong (0-based; null if valid or
    only unfinished), segments array<struct<text, loss>>, formatted."""
    t = template
    turns = (rows.select(F.col(conv).alias("conv_id"),
                         F.struct(F.col(turn).alias("turn"), text_or_empty(role).alias("role"),
                                  text_or_empty(text).alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    made = turns.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        _states(F.col("turns.role"), t).alias("end"),
        F.flatten(F.transform("turns", lambda x: turn_segments(x["role"], x["text"], t))).alias("segments"))
    wrong = F.col("end.wrong")
    return made.select(
        "conv_id", "n_turns", (~wrong & F.col("end.state").isin(*t.last)).alias("valid"),
        F.when(wrong, F.col("end.n")).alias("first_wrong"), "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"))


def read_turns(formatted: Column, template: Template = INST) -> Column:
    """array<struct<role, text>> read back from formatted text."""
    t = template
    head, name_end, close = t.other
    forms = [(x.open, x.close) for x in t.turns.values()] + [(head, close)]
    one = "|".join(rf"\Q{a}\E[\s\S]*?\Q{b}\E" for a, b in forms)

    def parts(s):
        role, text = None, None
        for name, x in t.turns.items():
            here = s.startswith(F.lit(x.open))
            inner = F.substr(s, F.lit(len(x.open) + 1), F.length(s) - len(x.open) - len(x.close))
            role = F.when(here, F.lit(name)) if role is None else role.when(here, F.lit(name))
            text = F.when(here, inner) if text is None else text.when(here, inner)
        named = F.substr(s, F.lit(len(head) + 1), F.length(s) - len(head) - len(close))
        role = role.otherwise(F.substring_index(named, name_end, 1))
        text = text.otherwise(F.substr(named, F.instr(named, name_end) + len(name_end)))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(one), F.lit(0)), parts)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
