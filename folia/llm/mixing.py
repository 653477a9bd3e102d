"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.llm.common import SEED, before_groups, materialize, maybe_broadcast, order_key, whole_row, with_word_counts

#: Hex digits of the order key that name a slice of a source: 16 ** 4 slices.
SLICE_DIGITS = 4


def water_fill(sources: DataFrame, budget_share: float, max_epochs: float, weights: list[float]) -> DataFrame:
    """Targets for the rows (source, total) of `sources`.

    Sources in code-point order, null last, take the weights in turn. Each target is
    min(max_epochs * total, level * weight), with the one level at which the targets add up
    to budget_share of all totals: what clamping and resharing in rounds comes to. The
    level is found from running totals over sources in order of cap / weight, without rounds.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("total") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    rows = rows.withColumn("cap_before", F.sum("cap").over(by_ratio) - F.col("cap")).withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
    rows = rows.withColumn("budget", F.sum("total").over(everything) * float(budget_share)).withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    # With too few or too many sources clamped the level comes out lower: the largest is the feasible one.
    rows = rows.withColumn("level", F.max("level").over(everything))
    return rows.select("source", "total", "weight", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: bool) -> DataFrame:
    """id, source, size, key and slice of every row, and the row itself if it is carried."""
    more = [whole_row(df).alias("row")] if carry else []
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), *more)
    sized = with_word_counts(rows, "text", "size", ["id", "source", *["row"] * carry]).withColumn("key", order_key(seed, F.col("id")))
    return sized.withColumn("slice", F.conv(F.substring("key", 1, SLICE_DIGITS), 16, 10).cast("int"))


def _quotas(sized: DataFrame, budget_share: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """Of each source: total, target, whole epochs, the slice in which the rest runs out (edge), and what is left of it there."""
    slices = materialize(sized.groupBy(F.col("source").alias("s_source"), "slice").agg(F.sum("size").alias("c")), "slices")
    targets = water_fill(slices.groupBy(F.col("s_source").alias("source")).agg(F.sum("c").alias("total")), budget_share, max_epochs, list(weights))
    epochs = F.when(F.col("total") > 0, F.floor(F.floor("target") / F.col("total"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.floor("target") - F.col("epochs") * F.col("total"))
    slices = before_groups(slices, ["s_source"], "slice")
    edge = targets.join(slices, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("c")), "left")
    edge = edge.select(F.col("source").alias("t_source"), "total", "target", "epochs", F.col("slice").alias("edge"), (F.col("rest") - F.col("before")).alias("left"))
    return maybe_broadcast(materialize(edge, "quotas"))


def _taken(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """Adds source_size, target and taken."""
    joined = sized.join(quotas, F.col("source").eqNullSafe(F.col("t_source")))
    in_edge = F.coalesce(F.col("slice") == F.col("edge"), F.lit(False))
    run = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0))

    def result(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.select(*sized.columns, F.col("total").alias("source_size"), "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))

    outside = result(joined.filter(~in_edge), F.when(F.col("slice") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    inside = joined.filter(in_edge).withColumn("run", run)
    return outside.unionByName(result(inside, F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("run") + F.col("size")))))


def mix_sources(
    df: DataFrame, *, budget_share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """Words that each row gives to the mix: id, source, key, size, source_size, target, taken.

    A source's target over its size is its number of epochs. Every row is taken as often as
    that number has whole epochs; the words that remain are filled by rows in a seeded order,
    the last of them in part, so that a source's taken words are its target rounded down.
    No source comes above max_epochs, nor any row above the next whole epoch.

    The seeded order of a source is cut into 65,536 slices; only their totals are summed, and
    only the slice in which the rest runs out is ordered row by row, so that a source with a
    third of all rows is never sorted in one task.

    Null source: a source of its own, ordered last. Null text: size 0, taken 0. Repeated rows
    count one by one. All sizes 0, or an empty table: targets 0, taken 0, or no rows. Other
    columns are ignored, whatever their names.
    """
    sized = materialize(_sized(df, id_col, text_col, source_col, seed, False), "sizes")
    rows = _taken(sized, _quotas(sized, budget_share, max_epochs, weights))
    return rows.select(F.col("id").alias(id_col), "source", "key", "size", "source_size", "target", "taken")


def mixed_rows(
    df: DataFrame, *, budget_share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """The mix itself: every row of df as often as mix_sources takes it, with its columns.

    A row taken in part has the first words of its text, one space between them. Rows without
    words, null and empty texts among them, are not in the mix. A null source is a source of its
    own, ordered last. Repeated rows count, and are repeated, one by one; rows with null ids are
    rows like others. Empty table: no rows. Columns are passed on whatever their names.
    """
    sized = materialize(_sized(df, id_col, text_col, source_col, seed, False), "sizes")
    rows = _taken(_sized(df, id_col, text_col, source_col, seed, True), _quotas(sized, budget_share, max_epochs, weights)).filter("taken > 0")
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    text = F.col(f"row.`{text_col}`")
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    first = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), words.cast("int")), " ")
    text = F.when(words >= F.col("size"), text).otherwise(first)
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
