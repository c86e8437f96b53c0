"""Chat formatting: a declared template and turn order over rows of conversations.

The order of turns is a finite-state machine whose state is the last role, so what a turn may
follow is known from the turn before it. A conversation may hold any share of the rows: turns are
ordered inside blocks of the turn column, and only each block's last role passes between blocks.
Every turn becomes three segments in its own row; no conversation is put together in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024  # turn numbers looked at together


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles that are learned, and which role may follow which state.

    Inside texts and roles `escape` is doubled and stands between the two characters that open a
    mark, so no text can hold a mark and the escaping can be undone.
    """

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>"
    after_turn: str = "\n"
    escape: str = "\\"
    guarded: str = "<|"
    learned: tuple[str, ...] = ("assistant",)
    learn_closing: bool = False
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })
    ends: tuple[str, ...] = ("user", "assistant")


CHAT = Template()


def escaped(c: F.Column, t: Template) -> F.Column:
    a, b = t.guarded
    doubled = F.replace(c, F.lit(t.escape), F.lit(t.escape * 2))
    return F.replace(doubled, F.lit(t.guarded), F.lit(a + t.escape + b))


def escaped_role(c: F.Column, t: Template) -> F.Column:
    """As `escaped`, and the sign that ends a role is hidden too."""
    return F.replace(escaped(c, t), F.lit(t.after_role), F.lit(t.escape + t.after_role))


def unescaped(c: F.Column, t: Template) -> F.Column:
    """Undo `escaped`: every escape sign hides the one character after it."""
    return F.regexp_replace(c, "(?s)" + _quoted(t.escape) + "(.)", "$1")


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "\n" else c for c in s)


def turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with null-free role and text and the turn block."""
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / block).alias("block"),
    )


def format_turns(conversations: DataFrame, template: Template = CHAT, block: int = BLOCK) -> DataFrame:
    """Every turn as `segments` (text, loss) in the template's order, with its place and validity.

    Columns: conv_id, turn, block, place (rank inside the block), previous (the role before it; ''
    before the first), valid (the order allows it), final (nothing follows), segments. Turns are
    ordered by turn, role and text, null turns first. Null roles and texts are empty; an unknown
    role is kept, not learned and not valid, as is whatever follows it. A null conv_id is one
    conversation. Repeated rows are repeated turns. Further columns of the input are left out.
    """
    rows = turns(conversations, block)
    order = ("turn", "role", "text")
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    lasts = rows.groupBy("conv_id", "block").agg(
        F.max(F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 62))).alias("t"), "role")).alias("last")
    )
    across = Window.partitionBy("conv_id").orderBy("block")
    entered = lasts.select(
        "conv_id", "block", F.coalesce(F.lag("last.role").over(across), F.lit("")).alias("entry"),
        F.lead("block").over(across).isNull().alias("last_block"),
    )
    allowed = F.lit(False)
    for state, roles in template.follows.items():
        allowed |= (F.col("previous") == state) & F.col("role").isin(*roles)
    placed = rows.withColumns({
        "place": F.row_number().over(inside), "before": F.lag("role").over(inside),
        "final_here": F.lead("role").over(inside).isNull(),
    })
    same = placed["conv_id"].eqNullSafe(entered["conv_id"]) & placed["block"].eqNullSafe(entered["block"])
    joined = placed.join(entered, same).select(
        placed["conv_id"], "turn", placed["block"], "place", "role", "text",
        F.when(F.col("place") == 1, F.col("entry")).otherwise(F.col("before")).alias("previous"),
        (F.col("final_here") & F.col("last_block")).alias("final"),
    )
    learned = F.col("role").isin(*template.learned)

    def segment(text: F.Column, loss: F.Column) -> F.Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return joined.select(
        "conv_id", "turn", "block", "place", "previous",
        (allowed & (~F.col("final") | F.col("role").isin(*template.ends))).alias("valid"), "final",
        F.array(
            segment(F.concat(F.lit(template.opening), escaped_role(F.col("role"), template), F.lit(template.after_role)),
                    F.lit(False)),
            segment(escaped(F.col("text"), template), learned),
            segment(F.lit(template.closing + template.after_turn), learned & F.lit(template.learn_closing)),
        ).alias("segments"),
    )


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Role, text and learned text of every formatted turn, from its segments' text alone."""
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    pattern = (
        "(?s)\\A" + _quoted(template.opening)
        + "((?:[^" + _quoted(template.escape) + _quoted(template.after_role) + "]++|" + _quoted(template.escape) + ".)*+)"
        + _quoted(template.after_role) + "(.*)" + _quoted(template.closing + template.after_turn) + "\\z"
    )
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    return formatted.withColumn("whole", whole).select(
        "conv_id", "turn", "block", "place", "valid",
        unescaped(F.regexp_extract("whole", pattern, 1), template).alias("role"),
        unescaped(F.regexp_extract("whole", pattern, 2), template).alias("text"),
        unescaped(learned, template).alias("learned"),
        F.char_length("whole").cast("long").alias("chars"),
    )
