"""The rows that queries pass from step to step."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = {
    "item_id": "string", "node_id": "string", "node_path": "string", "node_tag": "string", "node_xmlid": "string", "lib_id": "string", "article_name": "string", "kind": "string",
    "subkind": "string", "node_type": "string", "text_position": "string", "spelling": "string", "occurrences": "bigint", "raw_text": "string", "text_content": "string",
}


@dataclass(frozen=True)
class Rows:
    """A frame with the columns of ROW and of its order, in which falling columns have True; unique: no two rows have one key."""

    df: DataFrame
    order: tuple[tuple[str, bool], ...]
    unique: bool = False

    def filter(self, condition: Column) -> Rows:
        return replace(self, df=self.df.filter(condition))

    def reversed(self) -> Rows:
        return replace(self, order=tuple((c, not falling) for c, falling in self.order))

    def sort_columns(self) -> list[Column]:
        """Nulls come last in a rising order, and first in its reverse."""
        return [F.col(c).desc_nulls_first() if falling else F.col(c).asc_nulls_last() for c, falling in self.order]

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.sort_columns()).select(*ROW)

    def deduplicated(self) -> Rows:
        """The first row of each key."""
        if self.unique:
            return self
        first = Window.partitionBy("_key").orderBy(*self.sort_columns())
        df = self.df.withColumn("_key", row_key()).withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_key", "_first")
        return replace(self, df=df, unique=True)


def rows_of(df: DataFrame, order: tuple[str, ...] = ("article_name", "lib_id", "item_id"), unique: bool = False) -> Rows:
    """Fill in the columns of ROW that df lacks; raw_text and text_content stand in for each other."""
    have = set(df.columns)
    raw = F.coalesce(*[F.col(c) for c in ("raw_text", "text_content") if c in have]) if have & {"raw_text", "text_content"} else F.lit(None)
    columns = [raw.cast("string").alias(c) if c in ("raw_text", "text_content") else (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in ROW.items()]
    extra = [c for c in order if c not in ROW]
    df = df.select(*columns, *extra)
    # the order has columns of its own: later steps may change those that are shown
    df = df.withColumns({f"_o{k}": F.col(c) for k, c in enumerate(order)}).drop(*extra)
    return Rows(df, tuple((f"_o{k}", False) for k in range(len(order))), unique)


def row_key() -> Column:
    """What makes two rows the same for set operators: of xmlid, node, spelling, item and library id the first that there is."""
    spelling = F.lower(F.trim(F.coalesce("spelling", F.lit(""))))
    part = lambda name, c: F.concat(F.lit(f"{name}:"), c)
    return F.coalesce(
        part("xmlid", F.concat(F.col("article_name"), F.lit(":"), F.col("node_xmlid"))), part("node", F.col("node_id")), F.when(spelling != "", part("spelling", spelling)),
        part("item", F.col("item_id")), part("lib", F.col("lib_id")), part("row", F.xxhash64(*ROW).cast("string")),
    )


def raw_text() -> Column:
    """The text that text filters look at."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(~blank(F.col("raw_text")), F.col("raw_text")).when(~blank(F.col("spelling")), F.col("spelling")).otherwise(F.coalesce("text_content", F.lit("")))
