"""Chat formatting by a finite-state machine and a declarative template.

DataFrame functions only. Each turn is a row until the very end: the machine's
step needs the turn before it (a window), the template gives the turn's text
segments with a loss flag each, and only the formatted output gathers a
conversation.

Control strings inside texts are broken by a backslash after their first
character, and backslashes are doubled, so no control string of the template
can occur in an escaped text and unescaping gives the text back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles under loss, and the roles that may follow each role."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    opening: str = "### "
    colon: str = ": "
    closing: str = "</turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [self.closing.strip(), *[self.opening + label + self.colon.rstrip() for label in self.labels.values()]]


CHATML = Template()


def escape(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.controls():
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def header(role: Column, t: Template) -> Column:
    """A declared role's label; any other role escaped after a question mark, its colons too."""
    other = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    other = F.replace(other, F.lit(t.closing.strip()), F.lit(t.closing[0] + "\\" + t.closing.strip()[1:]))
    out = F.concat(F.lit("?"), other)
    for name, label in t.labels.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return F.concat(F.lit(t.opening), out, F.lit(t.colon))


def turns(conversations: DataFrame, t: Template = CHATML) -> DataFrame:
    """Each turn with ``place`` (0, 1, ...), ``allowed`` (the machine's verdict) and ``segments``.

    Turns are ordered by ``turn``, nulls first, then role, then text; equal rows
    are turns of their own. A null role counts as the empty role, which no state
    allows; a null text is empty. Roles and texts of any length are taken whole.
    Rows without a ``conv_id`` are one conversation. Other columns are dropped,
    whatever their names; an empty table gives no row.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    state = F.coalesce(F.lag("role").over(w), F.lit(START))
    allowed = F.lit(False)
    for before, after in t.follows.items():
        allowed = allowed | ((state == before) & F.col("role").isin(*after))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.array(
        part(header(F.col("role"), t), F.lit(False)), part(escape(F.col("text"), t), F.col("role").isin(*t.loss)), part(F.lit(t.closing), F.lit(False))
    )
    return c.withColumn("place", F.row_number().over(w) - 1).withColumn("allowed", allowed).withColumn("segments", segments)


def formatted(conversations: DataFrame, t: Template = CHATML) -> DataFrame:
    """``conv_id, valid, formatted, segments``: one row for each conversation.

    ``valid`` says whether the machine accepted all turns and ended in an
    accepting role; conversations that it rejects are formatted all the same.
    ``segments`` (text and loss flag) concatenate to ``formatted``.
    """
    each = turns(conversations, t).groupBy("conv_id").agg(
        F.min("allowed").alias("allowed"), F.array_sort(F.collect_list(F.struct("place", "role", "segments"))).alias("all")
    )
    last = F.element_at("all", -1)["role"]
    segments = F.flatten(F.transform("all", lambda x: x["segments"]))
    return each.select(
        "conv_id",
        (F.col("allowed") & last.isin(*t.accepts)).alias("valid"),
        F.array_join(F.transform(segments, lambda s: s["text"]), "").alias("formatted"),
        segments.alias("segments"),
    )


def read_back(output: DataFrame, t: Template = CHATML) -> DataFrame:
    """``conv_id, turns, loss_text`` from formatted conversations: roles and texts as they were, and all text under loss."""
    chunks = F.filter(F.split("formatted", r"\Q" + t.closing + r"\E"), lambda x: x != "")
    # The last chunk is what follows the last closing mark: nothing.
    end = r"(?s)^\Q" + t.opening + r"\E([^:\\]*+(?:\\.[^:\\]*+)*+)\Q" + t.colon + r"\E"  # possessive: no recursion, however long the role

    def turn(chunk: Column) -> Column:
        label = F.regexp_extract(chunk, end, 1)
        role = unescape(F.substring(label, 2, 1 << 30))
        for name, shown in t.labels.items():
            role = F.when(label == shown, F.lit(name)).otherwise(role)
        begin = F.length(label) + F.lit(len(t.opening) + len(t.colon) + 1)
        return F.struct(role.alias("role"), unescape(F.substr(chunk, begin)).alias("text"))

    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return output.select("conv_id", "valid", F.transform(chunks, turn).alias("turns"), under.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(output: DataFrame, t: Template = CHATML) -> DataFrame:
    """Counts and checksums of what ``read_back`` gives."""
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read_back(output, t).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
