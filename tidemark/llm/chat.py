"""Chat formatting by prefix-target expansion, with built-in functions only.

A conversation is written as ``<|role|>text<|end|>`` per turn. Inside roles and texts a
backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles, ``|`` becomes ``\\p``), so ``<`` occurs in
markers alone and the text can be read back exactly. Every assistant turn becomes one example: all preceding turns
are its prompt (not trainable) and only its reply is its target. A conversation with turns after
its last reply, or without any, has one more example with an empty target and ``trainable``
false, so that the examples hold the whole conversation.

Turns are put in order by (turn, role, text). One row holds one conversation; a prompt is a
prefix of it and is only computed if a caller asks for it.

Defined results: NULL text or role counts as empty; a NULL turn comes first; rows with a NULL
conv_id form one conversation; repeated rows are turns of their own; an empty table gives no
rows; other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (array of role, head, body) in order. Head and body are formatted
    text: a turn is head + body, and the loss of a reply is on its body."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).select(
        "conv_id",
        F.transform(
            "t",
            lambda x: F.struct(
                x["role"].alias("role"),
                F.concat(F.lit("<|"), escape_role(x["role"]), F.lit("|>")).alias("head"),
                escape(x["text"]).alias("body"),
            ),
        ).alias("turns"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, example`` (number of the last turn in it), ``prompt``,
    ``target``, ``tail``, ``trainable``, ``is_last``. ``prompt || target || tail`` is the text;
    the loss mask covers ``target``."""
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    replies = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == REPLY, i)), lambda i: i.isNotNull())
    n = F.size("turns")
    ends = F.when(F.element_at("turns", -1)["role"] == REPLY, replies).otherwise(F.concat(replies, F.array(n - 1)))
    # the reply travels with its number, so that a caller who asks for targets alone never copies the turns
    at = F.transform(ends, lambda i: F.struct(i.alias("example"), F.get("turns", i).alias("last"), (i == n - 1).alias("is_last")))
    e = formatted.select("conv_id", "turns", F.explode(at).alias("e")).select("conv_id", "turns", "e.*")
    last = F.col("last")
    before = F.concat_ws("", F.transform(F.slice("turns", 1, F.col("example")), whole))
    reply = last["role"] == REPLY
    return e.select(
        "conv_id",
        "example",
        F.when(reply, F.concat(before, last["head"])).otherwise(F.concat(before, whole(last))).alias("prompt"),
        F.when(reply, last["body"]).otherwise("").alias("target"),
        F.when(reply, F.lit(END)).otherwise("").alias("tail"),
        reply.alias("trainable"),
        "is_last",
    )


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted text."""
    return F.transform(
        F.filter(F.split(text, r"<\|end\|>", -1), lambda x: x != ""),
        lambda x: F.struct(
            unescape_role(F.regexp_extract(x, r"^<\|([^|]*)\|>", 1)).alias("role"),
            unescape(F.regexp_replace(x, r"^<\|[^|]*\|>", "")).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, derived from the examples: the turns from the longest one, the loss from the targets of all,
    and from every example's whole text (prompt, target, tail) its length and a digest of their digests in order."""
    whole = F.concat("prompt", "target", "tail")
    last = examples.filter("is_last").select("conv_id", whole.alias("text"))
    turns = last.select("conv_id", read_back(F.col("text")).alias("turns"), F.length("text").cast("long").alias("formatted_chars"))
    each = examples.select("conv_id", "example", "target", F.length(whole).cast("long").alias("chars"), F.sha2(whole, 256).alias("sha"))
    loss = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", "target", "chars", "sha"))).alias("t")).select(
        F.col("conv_id").alias("_id"),
        unescape(F.concat_ws("", F.col("t.target"))).alias("loss"),
        F.size("t").cast("long").alias("n_examples"),
        F.aggregate("t.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("examples_chars"),
        F.sha2(F.concat_ws("", F.col("t.sha")), 256).alias("examples_sha256"),
    )
    return turns.join(loss, turns["conv_id"].eqNullSafe(loss["_id"])).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
        "examples_chars",
        "examples_sha256",
    )
