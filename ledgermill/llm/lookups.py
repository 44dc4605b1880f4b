"""Rows of given ids, without shuffling wide rows when the list is short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# So many ids (8 bytes each) may be sent to every task.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among the distinct ``ids``, a written table.

    A short list is sent to the tasks, so that wide rows need no shuffle; a longer one is
    joined as Spark finds best.
    """
    short = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if short else ids, "id", "left_semi")
