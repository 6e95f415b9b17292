"""Order-dependent columns over groups of any size.

A window over a group puts the whole group into one task. Here rows are laid out by range over (group, order), so a large
group spreads over many partitions as stretches; windows run within a stretch, and only a few numbers of each stretch are
carried to the next.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_dir


def lay_out(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with a column _stretch, written once so that the stretches stay the same for every reader."""
    laid = rows.repartitionByRange(*by, *order).withColumn("_stretch", F.spark_partition_id())
    return materialize(laid, f"{shared_dir(rows.sparkSession)}/stretches")[0]


def running(laid: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """Adds, in order within each group: running sums (this row included), the last value that isn't null so far (this row
    included), and the value of the row before. order must be unique within a group."""
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    inside = Window.partitionBy(*by, "_stretch").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    box = lambda c: F.struct(c.alias("x"))
    rows = laid.withColumns(
        {"_n": F.row_number().over(inside)}
        | {f"_s_{k}": F.sum(c).over(so_far) for k, c in sums.items()}
        | {f"_l_{k}": F.last(c, ignorenulls=True).over(so_far) for k, c in lasts.items()}
        | {f"_v_{k}": box(c) for k, c in before.items()}
        | {f"_b_{k}": F.lag(box(c)).over(inside) for k, c in before.items()}
    )
    ends = rows.groupBy(*by, "_stretch").agg(
        F.max_by(F.struct(F.col("_n"), *[F.col(f"_s_{k}") for k in sums], *[F.col(f"_l_{k}") for k in lasts], *[F.col(f"_v_{k}") for k in before]), "_n").alias("_end")
    )
    across = Window.partitionBy(*by).orderBy("_stretch")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(c).alias(f"_g_{c}") for c in by],
        F.col("_stretch").alias("_at"),
        *[F.sum(F.col("_end")[f"_s_{k}"]).over(earlier).alias(f"_cs_{k}") for k in sums],
        *[F.last(F.col("_end")[f"_l_{k}"], ignorenulls=True).over(earlier).alias(f"_cl_{k}") for k in lasts],
        *[F.lag(F.col("_end")[f"_v_{k}"]).over(across).alias(f"_cb_{k}") for k in before],
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by], F.col("_stretch") == F.col("_at"))
    joined = rows.join(carried, same)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        *laid.columns,  # _stretch too: the result can be run over again
        *[(zero(F.col(f"_s_{k}")) + zero(F.col(f"_cs_{k}"))).alias(k) for k in sums],
        *[F.coalesce(f"_l_{k}", f"_cl_{k}").alias(k) for k in lasts],
        *[F.coalesce(f"_b_{k}", f"_cb_{k}")["x"].alias(k) for k in before],
    )


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in their group's order."""
    return running(lay_out(rows, by, order), by, order, sums={name: F.lit(1)}).drop("_stretch")
