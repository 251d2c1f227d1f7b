"""Conversation rows in one order over the whole table.

Rows are dealt out by ranges of their whole order (conversation, turn, then the rest), so a conversation that holds most of
the table spreads over many partitions. Nulls come first. Rows that tie in all of it are equal, so their order says nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of the last column that take part in dealing out; all of it takes part in sorting.
DEALT_CHARS = 32


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``pos`` (long), which rises in the order of conv_id and the columns of order, and by one within a partition."""
    *whole, last = ["conv_id", *order]
    dealt = [*whole, F.left(F.col(last), F.lit(DEALT_CHARS)) if dict(rows.dtypes)[last] == "string" else last]  # before the last one, a prefix would order them otherwise
    return rows.repartitionByRange(*dealt).sortWithinPartitions("conv_id", *order).withColumn("pos", F.monotonically_increasing_id())


def by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of a conversation in one partition, in order, to be streamed through: nothing holds them at once."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
