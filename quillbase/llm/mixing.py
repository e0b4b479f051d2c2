"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Each row has a 60-bit hash of its id. A source takes all its rows ``floor(target / size)`` times and, for the rest,
the rows whose hash lies below a threshold. The threshold comes from histograms: words by source and the hash's next
BITS bits, a running sum over buckets, and then the same again inside the one bucket that crosses the budget, until
that bucket holds one hash. The crossing hash is taken if that comes nearer the budget. Nothing is sorted but the
buckets of a source (2**BITS at most). A smaller budget's rows are among a larger one's.

Null texts have size 0; rows with equal ids share a hash and so are taken together; a null id hashes like the text
'null'. Null sources are one source, last in order. A total of 0 gives targets of 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BITS, LEVELS = 10, 6
_ID, _SOURCE = "doc_id", "source"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD_RE)), F.lit(0)).cast("long")


def hash60(col: Column) -> Column:
    """The first 15 hex digits of the id's MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water filling in one pass: in order of most * size / weight, a source is full if the level that the others share
    exceeds its own ratio.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col(_SOURCE).asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % n + 1).cast("int")))
    w = w.withColumn("most", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col(_SOURCE).asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    w = w.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    shared = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everyone)
    return w.withColumn("shared", shared.getField("level")).select(
        _SOURCE, "source_size", F.when(F.col("shared").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("shared") * F.col("weight"))).alias("target")
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a[_SOURCE].eqNullSafe(b["__source"])


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, ..., times, below): rows with hash < below are taken once more than times."""
    state = C.checkpoint(
        plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("times") * F.col("source_size")))
        .withColumns({"low": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "open": F.col("rest") > 0})
    )
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        live = C.small_side(state.where("open").select(F.col(_SOURCE).alias("__source"), "low", "base", "rest"))
        inside = rows.join(live, _same(rows, live)).where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << (shift + BITS))))
        bucket = (F.shiftright(F.col("h"), shift) * F.lit(1 << shift)).alias("bucket")
        hist = inside.groupBy(_SOURCE, bucket).agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"), F.first("base").alias("base"), F.first("rest").alias("rest"))
        run = Window.partitionBy(_SOURCE).orderBy("bucket")
        hist = hist.withColumn("upto", F.col("base") + F.sum("size").over(run))
        cross = hist.where(F.col("upto") >= F.col("rest")).groupBy(F.col(_SOURCE).alias("__source")).agg(F.min(F.struct("bucket", "upto", "size", "first", "last")).alias("x"))
        x = lambda k: F.col(f"x.{k}")
        done = (x("first") == x("last")) | F.lit(level == LEVELS - 1)
        near = x("upto") - F.col("rest") < F.col("rest") - (x("upto") - x("size"))
        state = C.checkpoint(
            state.join(cross, _same(state, cross), "left").select(
                _SOURCE, "source_size", "target", "times", "rest",
                F.when(x("bucket").isNull(), F.col("low")).otherwise(x("bucket")).alias("low"),
                F.when(x("bucket").isNull(), F.col("base")).otherwise(x("upto") - x("size")).alias("base"),
                F.when(x("bucket").isNull(), F.col("below")).when(done & near, x("last") + 1).otherwise(x("bucket")).alias("below"),
                (F.col("open") & x("bucket").isNotNull() & ~done).alias("open"),
            )
        )
        if not state.where("open").head(1):
            break
    return state


def _planned(docs: DataFrame, weights: tuple, most: float) -> tuple[DataFrame, DataFrame]:
    rows = C.checkpoint(docs.select(_ID, _SOURCE, words(F.col("text")).alias("size"), hash60(F.col(_ID)).alias("h")))
    sizes = rows.groupBy(_SOURCE).agg(F.sum("size").alias("source_size"))
    plan = thresholds(rows, targets(sizes, weights, most))
    return rows, C.small_side(plan.select(F.col(_SOURCE).alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("times").alias("__times"), F.col("below").alias("__below")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """Every row's (doc_id, source, size, source_size, target, times): how often the mix takes it."""
    rows, plan = _planned(docs, weights, most)
    times = F.col("__times") + (F.col("h") < F.col("__below")).cast("long")
    return rows.join(plan, _same(rows, plan)).select(_ID, _SOURCE, "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), times.alias("times"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' own columns."""
    _, plan = _planned(docs, weights, most)
    times = plan["__times"] + (hash60(docs[_ID]) < plan["__below"]).cast("long")
    out = docs.join(plan, _same(docs, plan)).where(times > 0)
    row = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row")
    return out.select(row, F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("k")).select("row.*")
