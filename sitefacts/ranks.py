"""Ranks over any number of rows: range partitions, a count a partition, and the sum of the counts before it."""

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workdir import shared_dir

PART_BITS = 33  # monotonically_increasing_id is (partition << 33) + place in the partition


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`rows` with their place (long, from 1) in the whole order; rows equal in all of `order` come in any order.

    The sorted rows are written once to the shared folder, so places stay as they are when an executor is lost. Only
    one count a partition passes through the driver. Rows of one value of `order` share a task, so it should end
    with keys that tell rows apart. A null stands where the order puts it; no rows give no rows.
    """
    spark, out = rows.sparkSession, shared_dir(rows.sparkSession)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()).write.parquet(out)
    placed = spark.read.parquet(out)
    part = F.shiftright("__place", PART_BITS)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    before = [0, *accumulate(r["count"] for r in counts)]
    starts = spark.createDataFrame([(int(r.part), b) for r, b in zip(counts, before)], "__part long, __before long")
    joined = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND((1 << PART_BITS) - 1) + 1).drop("__part", "__before", "__place")


def first_of_each(rows: DataFrame, groups: list, order: list, most: int, place: str = "place", total: str = "total") -> DataFrame:
    """The first `most` rows of each group with their place (from 1) and the number of all rows of the group.

    The place alone limits the window, so every task passes on at most `most` rows a group (up to
    spark.sql.optimizer.windowGroupLimitThreshold), and no group is sorted whole in one task; the number comes from an
    aggregate of its own. A null in `groups` is a group. `rows` is read twice: save it if it is dear.
    """
    names = [f"__{i}" for i in range(len(groups))]
    counts = rows.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)]).agg(F.count("*").alias(total))
    top = rows.withColumn(place, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(place) <= most)
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names)]
    if not groups:
        return top.crossJoin(counts)  # one row
    on = same[0]
    for c in same[1:]:
        on = on & c
    return top.join(counts, on).drop(*names)
