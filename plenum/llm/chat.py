"""Chat formatting: every assistant turn becomes an example of its own. Built-in functions only.

Template. A turn is a start mark, the text, an end mark:

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>
    any other  <<ROLE>>role<</ROLE>>text<</TURN>>

Inside texts and role names a backslash is doubled and one backslash is put behind the first character of each
control string, so that no control string is left there and unescape() restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = r"(?:/?INST\]|/?s>|</?(?:SYS|ROLE)>>|</TURN>>)"
_MARKED = r"(?s)(\[INST\]|<s>|<<SYS>>|<<ROLE>>)(.*?)(\[/INST\]|</s>|<</SYS>>|<</TURN>>)"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"([\[<])(?={_NAMES})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(turn: Column) -> Column:
    """(formatted, chars before the text, chars of the escaped text) of one turn."""
    body = escape(turn["text"])
    role = turn["role"]
    start = (
        F.when(role == "system", "<<SYS>>")
        .when(role == "user", "[INST]")
        .when(role == "assistant", "<s>")
        .otherwise(F.concat(F.lit("<<ROLE>>"), escape(role), F.lit("<</ROLE>>")))
    )
    end = (
        F.when(role == "system", "<</SYS>>")
        .when(role == "user", "[/INST]")
        .when(role == "assistant", "</s>")
        .otherwise("<</TURN>>")
    )
    return F.concat(start, body, end)


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Prefix-target expansion.

    One row per assistant turn: conv_id, example (1, 2, ...), n_turns, prompt_chars, formatted, loss_start,
    loss_chars, whole. `formatted` holds all turns up to and including that reply; the loss mask is the
    loss_chars code points from loss_start (0-based) on, which is the reply's escaped text without its marks.
    `whole` is true on one row per conversation, whose `formatted` holds all turns. Turns after the last reply, or a
    conversation without any reply, come as one more row without a mask (loss_start null, loss_chars 0), so that no
    turn is lost.

    Nulls: a null text or role is an empty string; a null conv_id is a conversation like any other; null turns come
    first. Ties of a turn number are ordered by role and text; repeated rows stay. Other columns are ignored. An empty
    table gives no rows. The output grows with the square of a conversation's turns, as the method has it; a
    conversation is gathered into one row, so its text must fit into one string (2 GB).
    """
    told = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    shaped = (
        told.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .select("conv_id", F.size("ts").alias("n"), F.transform("ts", lambda t: t["role"]).alias("roles"), F.transform("ts", _render).alias("parts"))
        .select(
            "conv_id",
            "n",
            "parts",
            F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("roles", i) == "assistant").alias("targets"),
        )
        .select(
            "conv_id",
            "n",
            "parts",
            F.when(F.coalesce(F.try_element_at("targets", F.lit(-1)), F.lit(0)) == F.col("n"), F.col("targets"))
            .otherwise(F.concat("targets", F.array(F.lit(-1) * F.col("n"))))
            .alias("targets"),
        )
    )
    cut = shaped.select("conv_id", "n", "parts", F.posexplode("targets").alias("p", "target"))
    at = F.abs("target")
    marks = F.lit(len("<s>")), F.lit(len("</s>"))
    rows = cut.select(
        "conv_id",
        (F.col("p") + 1).cast("long").alias("example"),
        at.cast("long").alias("n_turns"),
        F.array_join(F.slice("parts", 1, at - 1), "").alias("context"),
        F.element_at("parts", at).alias("last"),
        (F.col("target") > 0).alias("masked"),
        (at == F.col("n")).alias("whole"),
    )
    return rows.select(
        "conv_id",
        "example",
        "n_turns",
        F.length("context").cast("long").alias("prompt_chars"),
        F.concat("context", "last").alias("formatted"),
        F.when(F.col("masked"), F.length("context") + marks[0]).cast("long").alias("loss_start"),
        F.when(F.col("masked"), F.length("last") - marks[0] - marks[1]).otherwise(0).cast("long").alias("loss_chars"),
        "whole",
    )


def masked_text(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The trainable text of an example, unescaped; empty without a mask."""
    piece = F.substring(formatted, (loss_start + 1).cast("int"), loss_chars.cast("int"))
    return F.coalesce(unescape(piece), F.lit(""))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    kinds = F.regexp_extract_all(formatted, F.lit(_MARKED), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(_MARKED), F.lit(2))

    def one(kind: Column, body: Column) -> Column:
        name = (
            F.when(kind == "<<SYS>>", "system")
            .when(kind == "[INST]", "user")
            .when(kind == "<s>", "assistant")
            .otherwise(unescape(F.substring_index(body, "<</ROLE>>", 1)))
        )
        said = F.when(kind == "<<ROLE>>", F.regexp_replace(body, r"(?s)^.*?<</ROLE>>", "")).otherwise(body)
        return F.struct(name.alias("role"), unescape(said).alias("text"))

    return F.zip_with(kinds, bodies, one)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples say, read back: one row per conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (code points of all its examples),
    n_examples. The examples of a conversation are where format_conversations left them, so nothing is shuffled.
    """
    turns = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.when(F.col("whole"), parse_turns(F.col("formatted"))).alias("turns"),
        "loss_start",
    ).select(
        "conv_id",
        "example",
        "chars",
        "loss",
        F.when(F.col("turns").isNotNull(), F.struct(F.size("turns").cast("long").alias("n"), F.sha2(turns, 256).alias("sha"))).alias("back"),
        F.col("loss_start").isNotNull().cast("long").alias("one"),
    )
    summed = read.groupBy("conv_id").agg(
        F.max("back").alias("back"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.sum("one").alias("n_examples"),
    )
    return summed.select(
        "conv_id",
        F.col("back.n").alias("n_turns"),
        F.col("back.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
