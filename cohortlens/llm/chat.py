"""Chat formatting by perspective rotation.

A dialogue of several participants becomes one training text per participant: that speaker's turns are the assistant's, those of the others
are users' with their name, and the loss mask covers the assistant's words and the mark that ends them. Turns of the `system` role are
instructions: they stay what they are in every perspective and have none of their own.

A dialogue of very many turns is rendered in parts of `part_turns` turn numbers, each with its place in the whole; the parts in order are
the text. Where numbers are null or repeat, a part of more than `PART_ROWS` turns is cut again by their position in it. The places of the
parts come from their lengths, so no task holds a whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordering import numbered_per_group
from ..session import pinned
from .common import sized_broadcast

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
PART_TURNS = 256
PART_ROWS = 1024


def escaped(value: Column) -> Column:
    """Text that can't be taken for a mark: a backslash before each backslash and inside each `<|`. Null is empty."""
    doubled = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def rotations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              system: str = SYSTEM, part_turns: int = PART_TURNS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per dialogue, perspective and part: `conv_id`, `perspective`, `part`, `n_turns`, `start`, `rendered`, `n_chars`, `mask`, `n_masked`.

    `mask` lists spans `from-to` (code points inside the part, end excluded) separated by commas; `start` is the part's place in the
    rendered dialogue. Turns come by number, nulls first, then role and text; repeated turns stay. A null role is a participant with an
    empty name, a null conversation a conversation, a null text empty. A dialogue without participants has no perspective and no row.
    Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # The turn's number gives its part. Only nulls and repeats of numbers make a part too large: its turns are numbered and cut by position.
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(None).cast("long")))
    counted = rows.groupBy("conv", "part").agg(F.count("*").alias("n")).filter(F.col("n") > part_rows)
    large = pinned(counted.select(F.col("conv").alias("c"), F.col("part").alias("p")))
    if not large.isEmpty():
        same = F.col("conv").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p"))
        sized = sized_broadcast(large)
        hot = rows.join(sized, same, "left_semi").withColumn("slot", F.struct("conv", "part")).withColumn("tie", F.monotonically_increasing_id())
        placed = numbered_per_group(hot, "slot", [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("tie")]).withColumn(
            "cut", F.floor((F.col("position") - 1) / part_rows)
        )
        rows = rows.join(sized, same, "left_anti").withColumn("cut", F.lit(0).cast("long")).unionByName(placed.select(*rows.columns, "cut"))
    else:
        rows = rows.withColumn("cut", F.lit(0).cast("long"))
    speakers = pinned(rows.filter(F.col("role") != system).groupBy("conv", "role").agg(F.lit(1).alias("one")).select(
        F.col("conv").alias("c"), F.col("role").alias("perspective")
    ))
    seen = rows.join(sized_broadcast(speakers), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    mine = F.col("role") == F.col("perspective")
    head = (
        F.when(F.col("role") == system, F.lit(f"{OPEN}system\n"))
        .when(mine, F.lit(f"{OPEN}assistant\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")))
    )
    body = F.concat(escaped(F.col("text")), F.lit(CLOSE))
    piece = F.struct(
        "turn", "role", "text", F.concat(head, body, F.lit("\n")).alias("whole"), F.char_length(head).cast("long").alias("head"),
        F.when(mine, F.char_length(body)).otherwise(0).cast("long").alias("masked"),
    )
    parts = seen.groupBy("conv", "perspective", "part", "cut").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    lengths = parts.withColumn("lengths", F.transform("pieces", lambda p: F.char_length(p["whole"]).cast("long")))
    # The begin of each piece: array positions are few, but a running sum by slices would be quadratic; aggregate carries it on.
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda state, p: F.struct(
            (state["at"] + F.char_length(p["whole"])).cast("long").alias("at"),
            F.when(p["masked"] > 0, F.array_append(state["spans"], F.concat_ws(
                "-", (state["at"] + p["head"]).cast("string"), (state["at"] + p["head"] + p["masked"]).cast("string")
            ))).otherwise(state["spans"]).alias("spans"),
        ),
        lambda state: state["spans"],
    )
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    rendered = lengths.select(
        "conv", "perspective", "part", "cut", F.size("pieces").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", lambda p: p["whole"]), "").alias("rendered"),
        total.alias("n_chars"), F.array_join(spans, ",").alias("mask"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["masked"]).alias("n_masked"),
    )
    order = [F.col("part").asc_nulls_first(), F.col("cut")]
    before = W.partitionBy("conv", "perspective").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    number = (F.row_number().over(W.partitionBy("conv", "perspective").orderBy(*order)) - 1).cast("long")
    start = F.coalesce(F.sum("n_chars").over(before), F.lit(0))
    # Places from the parts' lengths alone, so that the texts of a dialogue do not meet in a task.
    key = ["conv", "perspective", "part", "cut"]
    sums = seen.select(*key, F.char_length(piece["whole"]).cast("long").alias("n")).groupBy(*key).agg(F.sum("n").alias("n_chars"))
    places = sums.select(*[F.col(k).alias(f"of_{k}") for k in key], number.alias("number"), start.alias("start"))
    numbered = rendered.join(places, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key])
    return numbered.select(
        F.col("conv").alias(conv), "perspective", F.col("number").alias("part"), "n_turns", "start", "rendered", "n_chars", "mask", "n_masked",
    )
