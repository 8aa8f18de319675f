"""Preference formatting: one prompt, two masked completions, DataFrame functions only.

A pair holds two conversations as arrays of turns. Their longest common turn prefix (equal role and text)
is rendered once as the prompt; what follows it on either side is a completion. A completion's mask is
its run-length list of (length, train): header characters and turns of other roles are not trained on,
the text and end mark of assistant turns are.

Result of `format_pairs`: the pair's other columns (but those named like the result's), then n_prompt_turns, prompt, chosen, chosen_mask,
rejected, rejected_mask. Lengths count code points. Null roles and texts count as empty, a null array as
no turns; equal conversations have empty completions. An empty table gives no rows. A conversation is one
row of the result, as a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chat template.
OPEN, NEWLINE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"
RESULT = ("n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(key, turns): the turns of each conversation in order; ties by role, then text.

    A null turn comes first. A null key is a conversation of its own.
    """
    part = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.select(F.col(key).alias("_key"), part.alias("_part"))
    ordered = F.array_sort(F.collect_list("_part"))
    return rows.groupBy("_key").agg(ordered.alias("_turns")).select(
        F.col("_key").alias(key),
        F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        .alias("turns"))


def _filled(turns: Column) -> Column:
    none = F.array().cast("array<struct<role:string,text:string>>")
    return F.transform(F.coalesce(turns, none), lambda t: F.struct(
        F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(
        (x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int")


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), t["role"], F.lit(NEWLINE), t["text"], F.lit(CLOSE))))


def mask(turns: Column) -> Column:
    """Run lengths over the rendered turns, and whether a run is trained on."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct((F.length(t["role"]) + len(OPEN) + len(NEWLINE)).alias("length"),
                 F.lit(False).alias("train")),
        F.struct((F.length(t["text"]) + len(CLOSE)).alias("length"),
                 (t["role"] == ASSISTANT).alias("train")))))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    names = [c for c in pairs.columns if c not in (chosen, rejected, *RESULT)]
    # Other columns travel inside one struct, so that no name of theirs meets one of ours.
    own = [F.struct(*[F.col(f"`{c}`") for c in names]).alias("own")] if names else []
    filled = pairs.select(*own, _filled(F.col(chosen)).alias("c"), _filled(F.col(rejected)).alias("r"))
    found = filled.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = {s: F.slice(s, F.col("n") + 1, F.size(s)) for s in ("c", "r")}
    return found.select(
        *[F.col("own")[c].alias(c) for c in names], F.col("n").alias("n_prompt_turns"),
        render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        render(rest["c"]).alias("chosen"), mask(rest["c"]).alias("chosen_mask"),
        render(rest["r"]).alias("rejected"), mask(rest["r"]).alias("rejected_mask"))


def cut_last_answer(turns: Column) -> Column:
    """The conversation up to its last assistant turn (else its last turn), that turn half as long."""
    n = F.size(turns)
    back = F.array_position(F.transform(F.reverse(turns), lambda t: t["role"] == ASSISTANT), F.lit(True))
    at = F.when(back == 0, n).otherwise(n - back + 1).cast("int")
    last = F.element_at(turns, at)
    half = F.struct(last["role"].alias("role"),
                    F.substring(last["text"], F.lit(1), F.floor(F.length(last["text"]) / 2).cast("int"))
                    .alias("text"))
    return F.concat(F.slice(turns, F.lit(1), at - 1), F.array(half))


def mask_text(runs: Column) -> Column:
    """A mask as text: `12-` for 12 characters masked, `30+` for 30 trained on."""
    return F.concat_ws(",", F.transform(runs, lambda m: F.concat(
        m["length"].cast("string"), F.when(m["train"], "+").otherwise("-"))))
