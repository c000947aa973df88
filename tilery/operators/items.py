"""Operators on loaded item rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_items(items: DataFrame, keys: tuple[str, ...] = ("collection_id", "pid"), keep: tuple[str, ...] = ("name", "aliases")) -> DataFrame:
    """The row loaded last of each key: largest loaded_at (null lowest), then largest item_key.

    One shuffle with map-side combine, so a key that holds a third of all rows is no hot spot. Columns
    beside keys, item_key and `keep` are left out. Null keys form a group of their own.
    """
    row = F.struct("item_key", *keep)
    return (
        items.groupBy(*keys)
        .agg(F.max_by(row, F.struct("loaded_at", "item_key")).alias("live"))
        .select(*keys, "live.*")
    )
