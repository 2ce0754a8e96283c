"""Chat formatting by prefix-target expansion; DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and its text alone is trainable. `format_turns`
formats each turn and finds its place; `expansion` cuts each example in full, context and reply, from its conversation, and
`write_examples` stores them. So the output grows with the square of a conversation's turns, as the method has it, and a
conversation's text is one row. A formatted turn doesn't depend on what follows it, so an example's text is a prefix of its
conversation, and where only places are wanted, `examples` names the context by one, n rows for n turns.

A template opens and closes each turn with control strings. A control string within a text gets a backslash behind its first
character, or one more if there are some already, so that none is left and `unescape` gives the text back. In a role a newline
and a percent sign are written as %0A and %25.

Turns are ordered by turn (nulls last), then role, then text. Places are running sums within blocks of BLOCK turn numbers, to
which the sums of the blocks before are added, so a conversation of many turns isn't one task's. Null texts and roles are empty;
turns without a conversation's id form one. A repeated row is a turn of its own. Empty input gives empty output. Other columns
pass through `formatted`; an input column with the name of an added one is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small

#: Turn numbers of a block, and of a null turn.
BLOCK, LAST = 256, (1 << 63) - 1
ADDED = ("place", "example", "start", "n_chars", "loss_start", "loss_end", "formatted")


@dataclass(frozen=True)
class Template:
    """`open` stands before the role and a newline, `close` behind the text; `others` are control strings that a text mustn't hold either."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    target: str = "assistant"

    def __post_init__(self) -> None:
        # Else a backslash in one control string could make or break another, or `1` behind a group's number be read as one.
        firsts = {c[0] for c in self.controls}
        assert not any(ch in firsts or ch in "\\%\n" for c in self.controls for ch in c[1:]) and not firsts & {"\\", "%", "\n"}
        assert all(len(c) > 1 for c in self.controls)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.close, *self.others)

    @property
    def pattern(self) -> str:
        """Groups: first character, backslashes, rest."""
        firsts = "".join(re.escape(c) for c in sorted({c[0] for c in self.controls}))
        return rf"([{firsts}])(\\*)({'|'.join(re.escape(x) for x in sorted({c[1:] for c in self.controls}))})"


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, template.pattern, r"$1\\$2$3")


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, template.pattern.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _role(role: Column, template: Template) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), template)


def _role_back(role: Column, template: Template) -> Column:
    return F.replace(F.replace(unescape(role, template), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Every row of `turns` with its formatted text, its place, the number of its example (null but for targets), and in characters: where it starts in the conversation, its length, and the span of the trainable text."""
    keep = [c for c in turns.columns if c not in ADDED]
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    head, body = F.concat(F.lit(template.open), _role(role, template), F.lit("\n")), escape(text, template)
    rest = [c for c in keep if c not in ("role", "text")]
    # Only the text itself goes through the shuffle: its lengths are taken before, its formatted form is made behind.
    block = F.coalesce(F.floor(turns["turn"] / BLOCK), F.lit(LAST)).cast("long")
    rows = turns.select(F.struct(*rest).alias("row"), turns["conv_id"].alias("conv"), turns["turn"].alias("t"), turns["role"].alias("role"), turns["text"].alias("text"), block.alias("block"))
    rows = rows.select("*", F.length(head).alias("n_head"), F.length(body).alias("n_body"), F.coalesce(F.col("role") == template.target, F.lit(False)).alias("hit"))
    rows = rows.withColumn("n", (F.col("n_head") + F.col("n_body") + len(template.close) + 1).cast("long"))
    # Null ids are one conversation, so keys are compared with a flag beside them.
    keys = ["none", "conv", "block"]
    rows = rows.withColumns({"none": F.col("conv").isNull(), "conv": F.coalesce("conv", F.lit(0))})
    so_far = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("t"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.count(F.lit(1)).over(so_far).alias("c_place"), F.sum("n").over(so_far).alias("c_n"), F.count_if("hit").over(so_far).alias("c_hit"))
    blocks = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("b_place"), F.sum("n").alias("b_n"), F.count_if("hit").alias("b_hit"))
    before = Window.partitionBy("none", "conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only what isn't the first block of its conversation has rows before it.
    later = blocks.select(*keys, *[F.sum(c).over(before).alias(c) for c in ("b_place", "b_n", "b_hit")]).where("b_place is not null")
    rows = rows.join(small(later), keys, "left")
    add = lambda c: F.col(f"c_{c}") + F.coalesce(f"b_{c}", F.lit(0))
    start = add("n") - F.col("n")
    begin = start + F.col("n_head")
    target = lambda c: F.when(F.col("hit"), c)
    made = F.concat(head, body, F.lit(template.close + "\n"))
    given = [F.col(c) if c in ("role", "text") else F.col("row")[c].alias(c) for c in keep]
    return rows.select(*given, (add("place") - 1).alias("place"), target(add("hit") - 1).alias("example"), start.alias("start"), F.col("n").alias("n_chars"), target(begin).alias("loss_start"), target(begin + F.col("n_body")).alias("loss_end"), made.alias("formatted"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row an example: conversation, number, how many turns and characters of context the reply follows, and the whole length with the trainable span in it."""
    return formatted.where("example is not null").select("conv_id", "example", F.col("place").alias("context_turns"), F.col("start").alias("context_chars"), (F.col("start") + F.col("n_chars")).alias("n_chars"), "loss_start", "loss_end")


def expansion(formatted: DataFrame) -> DataFrame:
    """The training set: a row for each assistant turn with the whole text of all turns before it and of its own, of which only
    loss_start to loss_end is trainable; and, where turns follow a conversation's last reply, a row of theirs without example or
    trainable text. `last`: no other row repeats this row's text."""
    hit, end = F.col("example").isNotNull(), F.col("start") + F.col("n_chars")
    part = F.struct("place", "formatted")
    reply = F.when(hit, F.struct("example", F.col("place").alias("context_turns"), F.col("start").alias("context_chars"), end.alias("n_chars"), "loss_start", "loss_end"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["formatted"]), "")
    chats = formatted.groupBy("conv_id").agg(whole.alias("whole"), F.collect_list(reply).alias("replies"), F.max(end).alias("end"), F.count_if(hit).alias("n_examples"), F.coalesce(F.max(F.when(hit, end)), F.lit(0)).alias("done"), F.coalesce(F.max(F.when(hit, F.col("place"))) + 1, F.lit(0)).alias("turns"))
    none = F.lit(None).cast("long")
    rest = F.struct(none.alias("example"), F.col("turns").alias("context_turns"), F.col("done").alias("context_chars"), F.col("end").alias("n_chars"), none.alias("loss_start"), none.alias("loss_end"))
    rows = F.concat("replies", F.when(F.col("end") > F.col("done"), F.array(rest)).otherwise(F.array()))
    each = chats.select("conv_id", "whole", "n_examples", F.explode(rows).alias("r"))
    begin = F.when(F.col("r.example").isNull(), F.col("r.context_chars")).otherwise(0)
    text = F.substring("whole", (begin + 1).cast("int"), (F.col("r.n_chars") - begin).cast("int"))
    return each.select("conv_id", "r.*", (F.coalesce("r.example", F.col("n_examples") - 1) == F.col("n_examples") - 1).alias("last"), text.alias("text"))


def expanded(formatted: DataFrame, most_chars: int | None = None) -> DataFrame:
    """Examples with their whole text, as large as the sum of their lengths; only those of up to `most_chars` characters if given."""
    if most_chars is not None:
        formatted = formatted.where(F.col("start") + F.col("n_chars") <= most_chars)
    return expansion(formatted).where("example is not null").drop("last")


def write_examples(turns: DataFrame, folder: str, template: Template = DEFAULT) -> DataFrame:
    """Format, expand and write below `folder`; returns what stands there."""
    # Examples of a conversation begin alike, which zstd finds over longer distances than the default.
    expansion(format_turns(turns, template)).write.option("compression", "zstd").parquet(folder)
    return turns.sparkSession.read.parquet(folder)


def report_examples(stored: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation, from the texts and trainable spans of `expansion` alone: turns and their digest, trainable characters and their digest, characters of all rows, and the number of examples."""
    turn = lambda x: F.substring(x, 1, F.length(x) - len(template.close) - 1)
    role = lambda x: F.substring_index(x, "\n", 1)
    said = lambda x: F.concat(_role_back(role(x), template), F.lit("\n"), unescape(F.substring(x, F.length(role(x)) + 2, F.length(x)), template), F.lit("\n"))
    # No control string is left within a turn, so the opening one cuts a text into its turns.
    turns = F.split(F.substring(F.col("text"), F.lit(len(template.open) + 1), F.length("text")), re.escape(template.open))
    loss = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")), template)
    order = F.coalesce("example", F.lit(LAST))
    rows = stored.select("conv_id", "example", order.alias("at"), F.length("text").cast("long").alias("n"), F.when(F.col("last"), turns).alias("turns"), loss.alias("loss"))
    rows = rows.withColumn("said", F.array_join(F.transform("turns", lambda x: said(turn(x))), "")).withColumn("n_turns", F.coalesce(F.size("turns"), F.lit(0)))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c)))), lambda x: x[c]), "")
    out = rows.groupBy("conv_id").agg(F.sum(F.greatest("n_turns", F.lit(0))).alias("n_turns"), joined("said").alias("said"), joined("loss").alias("loss"), F.sum("n").alias("formatted_chars"), F.count("example").alias("n_examples"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Stored rows with role and text as they were, read from the formatted text alone, and `loss`, what the trainable span holds."""
    body = F.substring(F.col("formatted"), F.lit(len(template.open) + 1), F.length("formatted") - len(template.open) - len(template.close) - 1)
    rows = formatted.drop("role", "text").withColumn("body", body).withColumn("role", F.substring_index("body", "\n", 1))
    rows = rows.withColumn("text", unescape(F.substring(F.col("body"), F.length("role") + 2, F.length("body")), template))
    inner = F.substring(F.col("formatted"), (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return rows.withColumn("role", _role_back(F.col("role"), template)).withColumn("loss", unescape(inner, template)).drop("body")


def report(rows: DataFrame) -> DataFrame:
    """Per conversation of `read_back`: turns and their digest, trainable characters and their digest, and the characters of all its examples, each with its context, and of the turns behind the last reply."""
    joined = lambda part: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]), "")
    said = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    hit, end = F.col("example").isNotNull(), F.col("start") + F.col("n_chars")
    of = F.sum(F.when(hit, end).otherwise(0)) + F.max(end) - F.coalesce(F.max(F.when(hit, end)), F.lit(0))
    out = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), joined(said).alias("said"), joined(F.coalesce("loss", F.lit(""))).alias("loss"), of.cast("long").alias("formatted_chars"), F.count_if(hit).alias("n_examples"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
