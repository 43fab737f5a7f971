"""Dense id allocation (B10) and row numbers (A29) without funnelling rows through one task.

The reference takes ``COALESCE(MAX(id), 0) + 1`` per insert.  For a set of
new rows the equivalent is ``max + row_number()`` in a fixed order.  Sizes are
measured first:

* up to ``ONE_TASK`` rows (of a set, or of a group) are numbered by a plain
  window;
* beyond that, rows are range-partitioned and sorted, so partition p holds a
  contiguous slice of the order, in as many partitions as the measured count asks for.  Rows are
  numbered inside their partition with ``monotonically_increasing_id``
  (consecutive within a partition once sorted); offsets are kept per partition, or per
  (partition, group) of the large groups only, and broadcast: their number is
  bounded by rows / ``ONE_TASK``.  Rows are not shuffled a second time.

The sorted, tagged rows of the second form are checkpointed, so the counts and the
numbered rows come from the same materialized data even if an executor is
lost and a stage is recomputed.

Two runs that start together read the same maximum.  With a ``ledger`` folder
an id range is reserved by a commit that only one of them can make for a given
version (:mod:`tipflow.sources.commits`); the other one gets the range after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipflow.functions.columns import js_trim
from tipflow.session import checkpoint_dir
from tipflow.sources.commits import Log
from tipflow.sources.mart import Mart

ONE_TASK = 500_000


def reserve(spark: SparkSession, ledger: str, sequence: str, count: int, current_max: int) -> int:
    """Reserve ``count`` ids of a sequence; returns the id before the first of them.

    The range starts after both ``current_max`` and all ranges reserved so far.
    """
    log = Log(spark, f"{ledger}/{sequence}", lambda state, record: record)

    def next_range(state: dict) -> dict:
        base = max(current_max, state.get("last", 0))
        return {"base": base, "last": base + count}

    return log.commit(next_range)["base"]


def _tagged(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Rows in ``parts`` sorted ranges with their partition and their place in it."""
    return (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
            .checkpoint(eager=True))


def dense_ids(df: DataFrame, order_cols: list[str], base, id_col: str = "id", one_task: int | None = None,
              stored: bool = False, ledger: str | None = None) -> DataFrame:
    """Number ``df`` rows base+1, base+2, ... by ``order_cols`` (a total order).

    ``base`` is a number or a one-row, one-column DataFrame holding the current maximum id.
    ``stored`` says that ``df`` reads a checkpoint or a table, so it need not be stored again.
    ``ledger`` is the folder of reserved ranges (see the module doc); without it, runs that allocate from the
    same sequence have to follow one another.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    one_task = one_task or ONE_TASK
    df = df if stored else df.checkpoint(eager=True)
    n = df.count()
    first = int(base.first()[0]) if isinstance(base, DataFrame) else int(base)
    if ledger is not None:
        first = reserve(spark, ledger, id_col, n, first)
    if n <= one_task:
        return df.withColumn(id_col, (F.row_number().over(Window.orderBy(*order_cols)) + F.lit(first)).cast("long"))
    tagged = _tagged(df, order_cols, -(-n // one_task))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (F.lit(first) + F.col("_off") + F.col("_pos") + 1).cast("long"))
            .drop("_pid", "_pos", "_off"))


def wanted_categories(m: Mart) -> DataFrame:
    """Distinct (tenant, upper-case trimmed name) named in credit sheets; names trimmed as the sheets' checks do."""
    name = F.upper(js_trim("categoria"))
    return (m.credit_sheet.filter(js_trim("categoria") != "")
            .select("cli_id", name.alias("set_name")).distinct())


def new_category_ids(m: Mart, ledger: str | None = None) -> DataFrame:
    """Categories named in sheets but missing in the tenant, with ids from MAX(set_id)+1."""
    existing = m.category.select("cli_id", F.upper("set_name").alias("set_name"))
    fresh = wanted_categories(m).join(existing, ["cli_id", "set_name"], "left_anti")
    current_max = m.category.agg(F.coalesce(F.max("set_id"), F.lit(0)).alias("m"))
    return dense_ids(fresh, ["cli_id", "set_name"], current_max, "set_id", ledger=ledger).select(
        "cli_id", "set_name", "set_id")


def number_within(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str = "line",
                  sizes: DataFrame | None = None, one_task: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without a task for a whole large group.

    ``sizes`` is a table that is cheaper to count than ``df`` and has at least as many rows in each
    group.  Groups of at most ``one_task`` rows there share a window; larger ones are cut into
    sorted ranges (see the module doc), so a group holding a third of all rows is numbered by many
    tasks.  ``order_cols`` must make the order total within a group.
    """
    spark = df.sparkSession
    one_task = one_task or ONE_TASK
    counted = df if sizes is None else sizes
    plain = F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order_cols))
    if counted.count() <= one_task:
        return df.withColumn(out_col, plain)
    checkpoint_dir(spark)
    large = (counted.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > one_task)
             .checkpoint(eager=True))
    total = large.agg(F.sum("_size")).first()[0]
    if total is None:
        return df.withColumn(out_col, plain)
    # at most rows / one_task groups; null keys are groups like others
    names = large.select(*[F.col(c).alias(f"_large_{c}") for c in group_cols])
    same = None
    for c in group_cols:
        test = F.col(c).eqNullSafe(F.col(f"_large_{c}"))
        same = test if same is None else same & test
    small = df.join(F.broadcast(names), same, "left_anti").withColumn(out_col, plain)
    keys = group_cols + order_cols
    tagged = _tagged(df.join(F.broadcast(names), same, "left_semi"), keys, -(-total // one_task))
    runs = tagged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # a run of each large group in each of its partitions
    offsets = runs.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        F.col("_pid").alias("_run_pid"), *[F.col(c).alias(f"_large_{c}") for c in group_cols], "_off", "_first")
    numbered = (tagged.join(F.broadcast(offsets), (F.col("_pid") == F.col("_run_pid")) & same)
                .withColumn(out_col, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("int")))
    return small.unionByName(numbered.select(*df.columns, out_col))
