"""Set operators over row keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.plans.rows import ROW, Rows, row_key


def _keyed(rows: Rows):
    return rows.df.withColumn("_key", row_key())


def _kept(left: Rows, right: Rows, how: str) -> Rows:
    keys = _keyed(right).select("_key").distinct()
    return Rows(_keyed(left).join(keys, "_key", how).drop("_key"), left.order, left.unique).deduplicated()


def intersect(left: Rows, right: Rows) -> Rows:
    """Rows of left whose key is in right, in the order of left."""
    return _kept(left, right, "left_semi")


def difference(left: Rows, right: Rows) -> Rows:
    """Rows of left whose key is not in right, in the order of left."""
    return _kept(left, right, "left_anti")


def union(left: Rows, right: Rows) -> Rows:
    """Left, then right; of equal keys the first row."""

    def side(rows: Rows, mark: str, place: int):
        names = {c: f"_{mark}{k}" for k, (c, _) in enumerate(rows.order)}
        return rows.df.select(*ROW, F.lit(place).alias("_side"), *[F.col(c).alias(n) for c, n in names.items()]), [(names[c], falling) for c, falling in rows.order]

    a, by_a = side(left, "l", 0)
    b, by_b = side(right, "r", 1)
    both = a.unionByName(b, allowMissingColumns=True)
    order = [("_side", False), *by_a, *by_b]
    renamed = {c: f"_o{k}" for k, (c, _) in enumerate(order)}
    return Rows(both.withColumnsRenamed(renamed), tuple((renamed[c], falling) for c, falling in order)).deduplicated()
