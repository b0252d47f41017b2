"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame expressions only."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    """What stands before and after a turn's text, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks for any other role (its name in hex stands for {role}), and the strings no text may show."""

    roles: Mapping[str, Mark]
    other: Mark
    controls: tuple[str, ...]
    #: (state, role) -> state; roles outside the template are "other"; no entry: the conversation is refused from that turn.
    moves: Mapping[tuple[str, str], str] = field(default_factory=dict)
    start: str = "start"
    accept: tuple[str, ...] = ()

    @property
    def control_pattern(self) -> str:
        """A control string, or one with backslashes after its first character: (first)(backslashes)(rest)."""
        heads = "".join(sorted({c[0] for c in self.controls}))
        tails = "|".join(re.escape(c[1:]) for c in sorted(self.controls, key=lambda c: (-len(c), c)))
        return f"([{re.escape(heads)}])(\\\\*)({tails})"


#: The instruction template with system, user and assistant marks.
INSTRUCT = Template(
    roles={"system": Mark("<<SYS>>\n", "\n<</SYS>>\n"), "user": Mark("[INST] ", " [/INST]"), "assistant": Mark("<s>", "</s>", loss=True)},
    other=Mark("<|role:{role}|>", "<|/role|>"),
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role:", "<|/role|>"),
    moves={("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    accept=("answered",),
)


def escape(text: Column, t: Template) -> Column:
    """Put one backslash more after the first character of each control string; unescape() takes it back."""
    return F.regexp_replace(text, F.lit(t.control_pattern), F.lit("$1\\\\$2$3"))


def unescape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, F.lit(t.control_pattern.replace("(\\\\*)", "\\\\(\\\\*)")), F.lit("$1$2$3"))


def _marks(role: Column, t: Template, side: str) -> Column:
    other = getattr(t.other, side).split("{role}")
    out = F.lit(other[0]) if len(other) == 1 else F.concat(F.lit(other[0]), F.hex(role), F.lit(other[1]))
    for name, m in t.roles.items():
        out = F.when(role == name, F.lit(getattr(m, side))).otherwise(out)
    return out


def _walk(roles: Column, t: Template) -> Column:
    """Run the machine: struct of its last state and the first turn it refused (from 1; 0: none)."""
    known = F.create_map(*[F.lit(x) for k, v in t.moves.items() for x in (f"{k[0]}>{k[1]}", v)])
    start = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("bad"), F.lit(0).alias("n"))

    def step(s: Column, r: Column) -> Column:
        to = F.element_at(known, F.concat(s["state"], F.lit(">"), F.when(r.isin(*t.roles), r).otherwise("other")))
        bad = F.when((s["bad"] == 0) & to.isNull(), s["n"] + 1).otherwise(s["bad"])
        return F.struct(F.coalesce(to, F.lit("refused")).alias("state"), bad.alias("bad"), (s["n"] + 1).alias("n"))

    return F.aggregate(roles, start, step)


def format_chats(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments (text, loss), valid, bad_turn.

    rows: conv_id, turn, role, text; other columns are not read.  Turns are ordered by turn, nulls first,
    then by role and text, so ties and repeated rows give one order; each row is a turn.  A null role or
    text counts as empty, a null conv_id as a conversation of its own.  Roles outside the template keep
    their name in their mark.  Conversations that the machine refuses are formatted too, with valid false
    and the turn it stopped at.  No rows: no conversations.  A conversation is one value in the result,
    so its turns must meet; nothing larger than one conversation ever does.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    loss = lambda x: F.when(x["role"].isin(*[k for k, m in template.roles.items() if m.loss]), F.lit(True)).otherwise(False)
    piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    segments = F.flatten(F.transform("_turns", lambda x: F.array(
        piece(_marks(x["role"], template, "before"), F.lit(False)),
        piece(escape(x["text"], template), loss(x)),
        piece(_marks(x["role"], template, "after"), F.lit(False)),
    )))
    d = d.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), segments.alias("segments"), _walk(F.transform("_turns", lambda x: x["role"]), template).alias("_end"))
    d = d.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return d.select("conv_id", "n_turns", "formatted", "segments", ((F.col("_end.bad") == 0) & F.col("_end.state").isin(*template.accept)).alias("valid"), F.col("_end.bad").alias("bad_turn"))


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    role_of = lambda mark: F.coalesce(*[F.when(mark == m.before, F.lit(k)) for k, m in template.roles.items()], F.decode(F.unhex(F.regexp_extract(mark, re.escape(template.other.before).replace(r"\{role\}", "([0-9A-F]*)"), 1)), "UTF-8"))
    every = [*template.roles.values(), template.other]
    java = lambda s: re.escape(s).replace(r"\{role\}", "[0-9A-F]*").replace("\\\n", "\\n").replace("\\ ", "\\x20")
    pattern = f"({'|'.join(java(m.before) for m in every)})((?s:.*?))({'|'.join(java(m.after) for m in every)})"
    marks, texts = (F.regexp_extract_all(formatted, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(marks, texts, lambda m, x: F.struct(role_of(m).alias("role"), unescape(x, template).alias("text")))


def digest(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the formatted text says when it is read back: turns and loss text, as digests."""
    d = chats.withColumn("_turns", read_back(F.col("formatted"), template))
    d = d.withColumn("_loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), ""))
    turns = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
