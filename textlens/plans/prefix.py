"""Exact running totals without a single-task global window.

``Window.orderBy(...)`` with no partition moves every row into one task.  The
helpers here keep the work distributed:

1. value-range buckets from ``approxQuantile`` (an aggregate, no shuffle; only
   ``buckets - 1`` split points reach the driver) and ``Bucketizer``;
2. per-bucket totals -> a table of at most ``buckets x groups`` rows, whose
   exclusive running sum is a window over that small table;
3. the running sum inside each bucket is a window partitioned by the bucket,
   so each task sees about ``rows / buckets`` rows;
4. bucket offset + in-bucket sum = global running sum.

Equal order values always land in one bucket.  Callers pre-aggregate ties
(one row per distinct order value) so a hot value cannot swell one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.session import materialize


def default_buckets(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4, 4 * n)


def running_sums(
    df: DataFrame,
    order_col: str,
    value_cols: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    tie_cols: Sequence[str] = (),
    inclusive: bool = True,
    buckets: int | None = None,
    prefix: str = "cum_",
) -> DataFrame:
    """Add ``{prefix}{v}``: the sum of ``v`` over all earlier rows of the same
    ``by`` group in ``order_col`` order (``inclusive`` adds the row itself).

    ``order_col`` must be numeric; ``tie_cols`` break ties inside a bucket.
    """
    by = list(by)
    value_cols = list(value_cols)
    nb = buckets or default_buckets(df)
    probs = [i / nb for i in range(1, nb)]
    ordd = "_tl_ord"
    base = df.withColumn(ordd, F.col(order_col).cast("double"))
    qs = base.approxQuantile(ordd, probs, 1.0 / (4 * nb)) if nb > 1 else []
    splits = [float("-inf")] + sorted({q for q in qs if q == q}) + [float("inf")]
    if len(splits) < 3:  # empty input: Bucketizer needs one inner split
        splits = [float("-inf"), 0.0, float("inf")]
    tagged = Bucketizer(splits=splits, inputCol=ordd, outputCol="_tl_b", handleInvalid="keep").transform(base)
    bkt = F.col("_tl_b").cast("int")
    # NULL order values form their own bucket where Spark's default null
    # ordering puts them: first when ascending, last when descending.
    bkt = F.when(bkt.isNull(), F.lit(1 if descending else -1)).otherwise(-bkt if descending else bkt)
    tagged = tagged.withColumn("_tl_b", bkt).drop(ordd)

    totals = tagged.groupBy(*by, "_tl_b").agg(*[F.sum(v).alias(f"_tl_t_{v}") for v in value_cols])
    before = Window.partitionBy(*by).orderBy("_tl_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_tl_b", *[F.coalesce(F.sum(f"_tl_t_{v}").over(before), F.lit(0)).alias(f"_tl_o_{v}") for v in value_cols]
    )

    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    ties = [F.col(c) for c in tie_cols]
    inside = (
        Window.partitionBy(*by, "_tl_b")
        .orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = tagged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_tl_l_{v}") for v in value_cols])
    # Without groups the offset table has at most ``nb`` rows by construction,
    # a proven bound; with groups its size is left to AQE's runtime choice.
    offs = F.broadcast(offsets) if not by else offsets
    out = local.join(offs, [*by, "_tl_b"], "inner")
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_tl_o_{v}") + F.col(f"_tl_l_{v}")).alias(f"{prefix}{v}") for v in value_cols],
    )


def global_rank(df: DataFrame, order_col: str, tie_cols: Sequence[str] = (), by: Sequence[str] = (),
                descending: bool = False, name: str = "rank", buckets: int | None = None) -> DataFrame:
    """1-based row number in ``order_col`` (then ``tie_cols``) order, computed
    with :func:`running_sums` instead of an unpartitioned ``row_number``."""
    one = df.withColumn("_tl_one", F.lit(1).cast("long"))
    ranked = running_sums(one, order_col, ["_tl_one"], by=by, descending=descending,
                          tie_cols=tie_cols, buckets=buckets, prefix="_tl_cum")
    return ranked.withColumnRenamed("_tl_cum_tl_one", name).drop("_tl_one")


def dense_ranks(values: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """``values`` with 1, 2, ... in the order of ``col``, whose values are
    distinct, of any ordered type; strings in code-point order.

    Values are cut into ranges at sampled bounds and written with their range,
    which holds the cut fast; each range is numbered by itself and moved
    by the number of rows in the ranges before it (one row a range)."""
    cut = materialize(values.repartitionByRange(F.col(col)).withColumn("_tl_range", F.spark_partition_id()))
    sizes = cut.groupBy("_tl_range").agg(F.count(F.lit(1)).alias("_tl_n"))
    before = Window.orderBy("_tl_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_tl_range", F.coalesce(F.sum("_tl_n").over(before), F.lit(0)).alias("_tl_before"))
    inside = F.row_number().over(Window.partitionBy("_tl_range").orderBy(col))
    ranked = cut.join(F.broadcast(offsets), "_tl_range")  # as many rows as there are partitions
    return ranked.select(*values.columns, (F.col("_tl_before") + inside).alias(name))
