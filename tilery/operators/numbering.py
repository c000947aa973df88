"""Dense row numbers in a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilery.plans.session import durable


def number_rows(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... by the order, which must be total. Rows are range-partitioned and sorted; the driver adds up
    one count per partition."""
    placed = durable(
        frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).agg(F.count("*")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total).cast("bigint")]
        total += n
    start = F.try_element_at(F.create_map(*offsets), part) if offsets else F.lit(0).cast("bigint")
    return placed.withColumn(name, start + row).drop("__at")
