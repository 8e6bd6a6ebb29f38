"""Dealing small inputs over the cores.

Join sides carry no size probe: a literal table is broadcast by its known
size, and for everything else the planner's statistics and adaptive execution
choose (a side whose measured size is under the threshold is broadcast at run
time).  A probe of the form ``limit(n).count()`` would send up to ``n`` rows
of every partition through one task, and compute the side twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# An input of at most so many splits is small enough to be dealt anew.
FEW_SPLITS = 16

# Rows of a table whose fan-out (a few matches a row) one task takes.
TASK_ROWS = 25_000


def spread(df: DataFrame) -> DataFrame:
    """Deal rows round-robin over the cluster's cores when the input has
    fewer partitions than that and at most ``FEW_SPLITS`` (a few files),
    before CPU-heavy row work.  A no-op on any larger input: there the
    reader's split settings decide.

    Call it on a freshly read input (scans, filters, projections): counting
    the partitions of a plan that already shuffles would make adaptive
    execution run those stages during planning."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many tasks of about ``rows`` rows ``df`` makes, by a count of its
    rows.  For work that fans out: neither a file's size nor the bytes of a
    shuffle tell the rows of a table that compresses well."""
    return max(1, -(-df.count() // rows))
