"""Problem 1: the N best items of every group, by a global sort and prefix-summed positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import materialize


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int, partitions: int | None = None) -> DataFrame:
    """The n rows of highest score in every group, equal scores by smaller identifier first.

    Returns (group, score, ident, position) with position 1..n; other columns of df are not carried, so names that
    clash with the operator's own cannot disturb it. Rows with a null group, identifier or score, or a NaN score,
    do not take part. Rows that repeat (group, score, identifier) count once. An empty table gives an empty result.

    The rows are sorted globally by (group, score descending, identifier): the range partitioner cuts inside groups,
    so a group that holds a third of all rows is spread over many tasks. Each task numbers its rows within their
    group; only the group that a task starts in the middle of can have rows in earlier tasks, so one summary row a
    task is enough to turn local numbers into exact positions by a prefix sum. Its size is the number of tasks,
    whatever the data.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    src = df.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(ident).alias("i"))
    src = src.where("g is not null and i is not null and s is not null and not isnan(s)")
    kinds = {f.name: f.dataType for f in src.schema}
    ordered = src.withColumn("s", F.expr("s + 0.0D")).repartitionByRange(parts, F.col("g"), F.col("s").desc(), F.col("i")).sortWithinPartitions(F.col("g"), F.col("s").desc(), F.col("i"))
    schema = T.StructType([T.StructField("g", kinds["g"]), T.StructField("s", T.DoubleType()), T.StructField("i", kinds["i"]), T.StructField("local", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("rest", T.LongType()), T.StructField("whole", T.BooleanType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first = last = last_key = None
        begun, count, groups, kind = False, 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.table(b)
            kind = t.schema
            g, s, i = (t.column(c).combine_chunks() for c in ("g", "s", "i"))
            differ = lambda x: np.asarray(pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False), dtype=bool)
            new_group = np.ones(len(g), dtype=bool)
            new_row = np.ones(len(g), dtype=bool)
            new_group[1:] = differ(g)
            new_row[1:] = new_group[1:] | differ(s) | differ(i)
            head = (g[0].as_py(), s[0].as_py(), i[0].as_py())
            if begun:
                new_group[0] = head[0] != last
                new_row[0] = new_group[0] or head[1:] != last_key
            else:
                first, begun = head[0], True
            running = np.cumsum(new_row)
            starts = np.flatnonzero(new_group)
            base = np.full(len(g), -count, dtype=np.int64)
            if len(starts):
                which = np.searchsorted(starts, np.arange(len(g)), side="right") - 1
                base = np.where(which >= 0, running[starts[which]] - 1, -count)
            local = running - base
            groups += int(new_group.sum())
            count, last, last_key = int(local[-1]), g[-1].as_py(), (s[-1].as_py(), i[-1].as_py())
            keep = np.flatnonzero(new_row & (local <= n))
            if len(keep):
                take = pa.array(keep)
                m = len(keep)
                yield pa.record_batch([g.take(take), s.take(take), i.take(take), pa.array(local[keep]), pa.array([task] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_())], names=["g", "s", "i", "local", "task", "rest", "whole"])
        if begun:
            # the summary: the group the task ends in, how many rows it has here, and whether it is the task's only one
            yield pa.record_batch([pa.array([last], kind.field("g").type), pa.nulls(1, pa.float64()), pa.nulls(1, kind.field("i").type), pa.nulls(1, pa.int64()), pa.array([task], pa.int32()), pa.array([count], pa.int64()), pa.array([groups == 1])], names=["g", "s", "i", "local", "task", "rest", "whole"])

    numbered = materialize(ordered.mapInArrow(number, schema), "topn")
    tasks = numbered.where("rest is not null").select(F.col("task"), F.col("g").alias("tail"), "rest", "whole")
    # rows before a task in the group it begins with: the run of tasks, each wholly of that group, and the one before them
    w = Window.orderBy("task")
    run = tasks.withColumn("open", F.coalesce(F.lag("tail").over(w) == F.col("tail"), F.lit(False)) & F.col("whole"))
    run = run.withColumn("block", F.sum(F.when(F.col("open"), 0).otherwise(1)).over(w))
    run = run.withColumn("upto", F.sum("rest").over(Window.partitionBy("block").orderBy("task")))
    before = run.select((F.lead("task").over(w)).alias("task"), F.col("tail").alias("g"), F.col("upto").alias("offset")).where("task is not null")
    rows = numbered.where("rest is null").join(F.broadcast(before), ["task", "g"], "left")
    rows = rows.withColumn("position", F.col("local") + F.coalesce("offset", F.lit(0))).where(F.col("position") <= n)
    return rows.select(F.col("g").alias(group), F.col("s").alias(score), F.col("i").alias(ident), F.col("position").cast("int").alias("position"))
