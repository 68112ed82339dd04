"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and joined to one text. Adjacent turns of one role share a block:

    <|im_start|>role
    text<|im_part|>text of the next turn, same role<|im_end|>

Control strings cannot arise from texts: after every ``<`` that stands before backslashes and ``|`` one backslash is added,
and taken away again on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END = "<|im_start|>", "<|im_part|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_line(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role(line: Column) -> Column:
    return F.replace(F.replace(unescaped(line), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_runs.

    ``loss_runs`` cuts ``formatted`` into stretches in order (code points of control text, of the turn's text, and
    whether the text is learned): the loss mask in run lengths. Only texts of assistants are learned, control strings
    never. Turns go by ``turn``, then role, then text; a null turn comes first; null roles and texts are empty; repeated
    rows are repeated turns; a null conv_id is a conversation of its own; no rows make no conversations. Other columns
    are ignored. A conversation is one training example and becomes one row, so its turns meet in one task.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def piece(turn: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)  # null for the first
        opened = F.concat(F.lit(START), _role_line(turn["role"]), F.lit("\n"))
        return F.struct(
            F.when(i == 0, opened)
            .when(before["role"] == turn["role"], F.lit(PART))
            .otherwise(F.concat(F.lit(END), opened))
            .alias("control"),
            escaped(turn["text"]).alias("text"),
            (turn["role"] == LEARNED_ROLE).alias("learned"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.concat(
            F.array_join(F.transform("pieces", lambda p: F.concat(p["control"], p["text"])), ""), F.lit(END)
        ).alias("formatted"),
        F.transform(
            "pieces",
            lambda p: F.struct(
                F.length(p["control"]).alias("control_chars"), F.length(p["text"]).alias("text_chars"), p["learned"].alias("learned")
            ),
        ).alias("loss_runs"),
    )


def read_conversations(formatted: DataFrame, *columns: str) -> DataFrame:
    """Turns read back from the formatted text: conv_id, turns (role and text, in order), formatted, other ``columns``."""
    # nothing stands before the first block
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def block_turns(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(line) + 2, F.length(block) - F.length(line) - 1 - len(END))
        return F.transform(
            F.split(body, r"<\|im_part\|>", -1),
            lambda part: F.struct(_role(line).alias("role"), unescaped(part).alias("text")),
        )

    return formatted.select("conv_id", F.flatten(F.transform(blocks, block_turns)).alias("turns"), "formatted", *columns)


def _learned() -> Column:
    """Texts under the loss mask, cut out of ``formatted`` by the lengths in ``loss_runs``."""

    def add(done: Column, run: Column) -> Column:
        start = done["at"] + run["control_chars"]
        cut = F.struct(start.alias("start"), run["text_chars"].alias("length"))
        return F.struct(
            (start + run["text_chars"]).alias("at"),
            F.when(run["learned"], F.array_append(done["cuts"], cut)).otherwise(done["cuts"]).alias("cuts"),
        )

    empty = F.expr("struct(1 AS at, cast(array() AS array<struct<start: int, length: int>>) AS cuts)")
    cuts = F.aggregate("loss_runs", empty, add, lambda done: done["cuts"])

    def texts(wide: Column) -> Column:
        # from the character before the text on, as a mark of byte order at the very beginning would be taken away
        one = lambda c: F.decode(F.substr(wide, 4 * c["start"] - 7, 4 * c["length"] + 4), "UTF-32")
        return F.transform(cuts, lambda c: unescaped(F.substring(one(c), 2, 1 << 30)))

    # four bytes a character, so that a cut does not read all that stands before it; encoded once, as a lambda's variable
    return F.array_join(F.flatten(F.transform(F.array(F.encode("formatted", "UTF-32")), texts)), "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted``.

    What is learned is cut out of it by ``loss_runs``.
    """
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = read_conversations(formatted.select("conv_id", "formatted", "loss_runs"), "loss_runs").select(
        "conv_id", "formatted", "turns", said.alias("said"), _learned().alias("learned")
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
