"""The changelog of a stream of events: versions from a rising id, for live reads over any append-only table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changelog(events: DataFrame, version: Column, first: Column, deleted: Column) -> DataFrame:
    """Events as writes: the first of a key adds, those marked deleted soft-delete, others change."""
    op = F.when(deleted, F.lit("soft_delete")).when(first, F.lit("add")).otherwise(F.lit("change"))
    return events.withColumns({"_version": version.cast("long"), "_op": op})
