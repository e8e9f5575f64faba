"""Global order over a DataFrame without one task per group.

``sequence`` gives every row its 0-based position in a global sort and,
optionally, the dense rank of its group and values from the row before it
inside its group.  Groups may be of
any size: the data is range-partitioned on the full sort key, so a group holding
a third of all rows is split over many partitions, and partition boundaries are
repaired from a summary with one row per partition (bounded by the partition
count, so broadcasting it is safe).

Passes: one range shuffle and sort; one narrow per-partition scan (JVM when only
the position is wanted; on Arrow batches when a group rank or a previous value
is wanted, where the scan compares the key columns and appends its results, and
every other column passes through untouched); a reliable checkpoint, so that both following passes
see identical partitions; a tiny summary job; and a broadcast join of the
summary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.plans.materialize import materialize

PID, LOCAL, HEAD, TAIL, GL, GS, HG = "_sq_pid", "_sq_local", "_sq_head", "_sq_tail", "_sq_gl", "_sq_gs", "_sq_hg"


def _ranged(df: DataFrame, order_cols: Sequence[str], partitions: int | None, tie: str | None):
    """Range-partition and sort.  Without an explicit count the session's
    shuffle partition count applies and AQE may merge adjacent small ranges
    (merged ranges stay contiguous, so the global order holds)."""
    # Rows equal on the whole key (copies) would all land in one range
    # partition; a unique ``tie`` column as last key spreads them.  They are
    # equal on every ordering column, so any order among them gives the same
    # result.  The tie column must be stable when tasks rerun (for instance a
    # row id taken from checkpointed or stored data).
    keys = list(order_cols) + ([tie] if tie else [])
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def _offsets(counts: DataFrame) -> DataFrame:
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(PID, F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias("_off"))


def _pinned(summary: DataFrame) -> DataFrame:
    """Compute the per-partition summary once and keep it as a local relation.

    It has at most one row per partition (bounded by the partition count, like
    the partition sizes ``zipWithIndex`` gathers), so it goes to the driver and
    back as a broadcast; later actions do not recompute it.
    """
    rows = summary.collect()
    return summary.sparkSession.createDataFrame(rows, summary.schema)


def sequence(df: DataFrame, order_cols: Sequence[str], *, index: str | None = None,
             group_cols: Sequence[str] = (), run_cols: Sequence[str] | None = None,
             lag: Mapping[str, str] | None = None, group_index: str | None = None,
             group_offset: str | None = None, partitions: int | None = None,
             tie: str | None = None) -> DataFrame:
    """Position and previous values in the order of ``order_cols`` (ascending).

    * ``index``: name of the 0-based global position column.
    * ``group_index``: name of the 0-based dense rank of ``group_cols``.
    * ``group_offset``: name of the 0-based position of the row inside its group.
    * ``group_cols``: leading columns of ``order_cols``; previous values never
      cross a group boundary (null for a group's first run).
    * ``run_cols``: columns after ``group_cols`` that define runs; all rows of a
      run take the previous values of the run's first row.  Default: the rest of
      ``order_cols``.
    * ``lag``: ``{output: source}``, source columns of integral or string type.
    * ``tie``: a unique, stable column used as the last sort key to split
      groups of identical rows across partitions.
    """
    order_cols = list(order_cols)
    group_cols = list(group_cols)
    if order_cols[:len(group_cols)] != group_cols:
        raise ValueError("group_cols must be a prefix of order_cols")
    run_cols = list(order_cols[len(group_cols):] if run_cols is None else run_cols)
    lag = dict(lag or {})
    original = df.columns
    ranged = _ranged(df, order_cols, partitions, tie)

    if not lag and not group_index and not group_offset:
        tagged = ranged.select("*", F.spark_partition_id().alias(PID),
                               (F.monotonically_increasing_id()
                                - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias(LOCAL))
        fixed = materialize(tagged)
        counts = fixed.groupBy(PID).agg(F.count(F.lit(1)).alias("_n")).repartition(1)
        out = fixed.join(F.broadcast(_pinned(_offsets(counts))), PID)
        cols = [F.col(c) for c in original]
        if index:
            cols.append((F.col("_off") + F.col(LOCAL)).alias(index))
        return out.select(*cols)

    schema = ranged.schema
    for out_name, src in lag.items():
        dtype = schema[src].dataType
        if not isinstance(dtype, (T.IntegralType, T.StringType)):
            raise TypeError(f"lag source '{src}' must be integral or string, not {dtype.simpleString()}")
    out_schema = T.StructType(
        list(schema.fields)
        + [T.StructField(PID, T.IntegerType()), T.StructField(LOCAL, T.LongType()),
           T.StructField(HEAD, T.BooleanType()), T.StructField(TAIL, T.BooleanType()),
           T.StructField(GL, T.LongType()), T.StructField(GS, T.LongType()), T.StructField(HG, T.BooleanType())]
        + [T.StructField(o, schema[s].dataType) for o, s in lag.items()]
    )
    scan = _partition_scan(group_cols, group_cols + run_cols, lag)
    fixed = materialize(ranged.mapInArrow(scan, out_schema))

    # Summary: first and last row of every non-empty partition.
    g = F.struct(*group_cols) if group_cols else F.lit(True)
    r = F.struct(*(group_cols + run_cols))
    srcs = sorted(set(lag.values()))
    dummy = [F.lit(0).alias("_")]  # keeps the structs non-empty when no lag is asked for
    # At most two rows per partition survive the (distributed) filter; they are
    # gathered into one partition so the grouping and windows below need no
    # further shuffle.
    ends = fixed.where((F.col(LOCAL) == 0) | F.col(TAIL)).select(
        PID, LOCAL, g.alias("g"), r.alias("r"), F.struct(*[F.col(s).alias(s) for s in srcs], *dummy).alias("v"),
        F.struct(*[F.col(o).alias(o) for o in lag], *dummy).alias("p"), F.col(HEAD).alias("head"),
        F.col(GL).alias("gl"), F.col(GS).alias("gs"), F.col(HG).alias("hg")).repartition(1)
    summary = ends.groupBy(PID).agg(
        F.min_by("g", LOCAL).alias("f_g"), F.min_by("r", LOCAL).alias("f_r"),
        (F.max(LOCAL) + 1).alias("_n"), F.max_by("g", LOCAL).alias("l_g"), F.max_by("r", LOCAL).alias("l_r"),
        F.max_by("v", LOCAL).alias("l_v"), F.max_by("p", LOCAL).alias("l_p"), F.max_by("head", LOCAL).alias("l_head"),
        (F.max_by("gl", LOCAL) + 1).alias("_gn"), F.max_by("gs", LOCAL).alias("l_gs"),
        F.max_by("hg", LOCAL).alias("l_hg"))

    w = Window.orderBy(PID)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s1 = summary.select(
        "*", F.lag("l_g").over(w).alias("p_g"), F.lag("l_r").over(w).alias("p_r"),
        F.lag("l_v").over(w).alias("p_v"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_off"))
    cont = F.coalesce(F.col("f_r") == F.col("p_r"), F.lit(False))
    same_group = F.coalesce(F.col("f_g") == F.col("p_g"), F.lit(False))
    # dense group rank: groups counted in earlier partitions, minus the
    # partitions (up to this one) whose first group continues the one before
    s1 = s1.select("*", cont.alias("_cont"),
                   F.struct(*[F.when(same_group, F.col("p_v")[s]).alias(o) for o, s in lag.items()],
                            *dummy).alias("_fresh"),
                   (F.coalesce(F.sum("_gn").over(before), F.lit(0))
                    - F.sum(same_group.cast("long")).over(upto)).alias("_goff"),
                   same_group.alias("_same_g"))
    # Global start of the last group of each partition, unless that group is
    # the partition's first one and continues from before (then it carries).
    s1 = s1.select("*", F.when(~(F.col("l_hg") & F.col("_same_g")), F.col("_off") + F.col("l_gs")).alias("_gs_end"))
    s1 = s1.select("*", F.last("_gs_end", ignorenulls=True).over(upto).alias("_gs_upto"))
    s1 = s1.select("*", F.lag("_gs_upto").over(w).alias("_gs_before"))
    # Value that holds at the end of a partition: its own last run, unless the
    # whole partition continues a run from before (then the value carries over).
    own = F.struct(*[F.when(F.col("l_head"), F.col("_fresh")[o]).otherwise(F.col("l_p")[o]).alias(o) for o in lag],
                   *dummy)
    anchor = F.when(~(F.col("l_head") & F.col("_cont")), F.struct(own.alias("v")))
    s2 = s1.select("*", F.last(anchor, ignorenulls=True).over(upto).alias("_end"))
    s3 = s2.select(PID, "_off", "_goff", "_cont", "_fresh", "_same_g", "_gs_before",
                   F.lag("_end").over(w).alias("_end_before"))
    heads = s3.select(PID, "_off", "_goff", "_same_g", "_gs_before", *[
        F.when(F.col("_cont"), F.col("_end_before")["v"][o]).otherwise(F.col("_fresh")[o]).alias(f"_h_{o}")
        for o in lag])

    out = fixed.join(F.broadcast(_pinned(heads)), PID)
    cols = [F.col(c) for c in original]
    if index:
        cols.append((F.col("_off") + F.col(LOCAL)).alias(index))
    if group_index:
        cols.append((F.col("_goff") + F.col(GL)).alias(group_index))
    if group_offset:
        start = F.when(F.col(HG) & F.col("_same_g"), F.col("_gs_before")).otherwise(F.col("_off") + F.col(GS))
        cols.append((F.col("_off") + F.col(LOCAL) - start).alias(group_offset))
    cols += [F.when(F.col(HEAD), F.col(f"_h_{o}")).otherwise(F.col(o)).alias(o) for o in lag]
    return out.select(*cols)


def _changes(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    """For every row but the first: does any of ``cols`` differ from the row before?"""
    out = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for name in cols:
        column = batch.column(name)
        before, after = column.slice(0, batch.num_rows - 1), column.slice(1)
        differs = pc.coalesce(pc.not_equal(before, after), pc.not_equal(pc.is_null(before), pc.is_null(after)))
        out |= differs.to_numpy(zero_copy_only=False)
    return out


def _partition_scan(group_cols, run_key, lag):
    """Per-partition scan: local position, in-partition previous values, and
    flags for rows whose values depend on earlier partitions.  Only key columns
    are read; all columns of a batch go on as they came."""
    lag_items = list(lag.items())

    def scan(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        local = 0
        carry = None  # last row of the previous batch of this partition
        pending = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            ends = [{c: batch.column(c)[k].as_py() for c in dict.fromkeys([*group_cols, *run_key])} for k in (0, n - 1)]
            new_group, new_run = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            new_group[1:], new_run[1:] = _changes(batch, group_cols), _changes(batch, run_key)
            if carry is not None:
                new_group[0] = any(ends[0][c] != carry["key"][c] for c in group_cols)
                new_run[0] = any(ends[0][c] != carry["key"][c] for c in run_key)
            rid = np.cumsum(new_run) - 1  # -1: continues the previous batch's last run
            gl = (carry["gl"] if carry is not None else -1) + np.cumsum(new_group)
            # local position of each row's group start; rows of a group that
            # began in an earlier batch keep the carried start
            positions = np.arange(local, local + n, dtype=np.int64)
            gstart = np.where(new_group, positions, -1)
            gstart[0] = gstart[0] if new_group[0] else carry["gs"]
            gstart = np.maximum.accumulate(gstart)
            starts = np.flatnonzero(new_run)
            head = np.zeros(n, dtype=bool)
            if carry is None:
                head[rid == 0] = True  # first run of the partition: resolved later
            elif carry["head"]:
                head[rid == -1] = True
            # Where each row's previous value stands: 0 the carried run's, 1 the
            # carried last row's, 2 + i row i of this batch, none at a group start.
            origin = np.zeros(n, dtype=np.int64)
            inside = rid >= 0
            origin[inside] = (starts + 1)[rid[inside]]
            none = np.zeros(n, dtype=bool)
            none[inside] = new_group[starts][rid[inside]]
            origin = pa.array(origin, pa.int64(), mask=none)
            columns, last = list(batch.columns), {}
            added = {PID: pa.array(np.full(n, pid, dtype=np.int32)), LOCAL: pa.array(positions),
                     HEAD: pa.array(head), TAIL: pa.array(np.zeros(n, dtype=bool)), GL: pa.array(gl.astype(np.int64)),
                     GS: pa.array(gstart), HG: pa.array(gl == 0)}
            for out, source in lag_items:
                column = batch.column(source)
                before = (carry["p"][out], carry["v"][source]) if carry is not None else (None, None)
                added[out] = pa.concat_arrays([pa.array(before, column.type), column]).take(origin)
                last[out] = added[out][n - 1].as_py()
            local += n
            carry = {"key": ends[1], "head": bool(head[-1]), "gl": int(gl[-1]), "gs": int(gstart[-1]),
                     "v": {s: batch.column(s)[n - 1].as_py() for s in lag.values()}, "p": last}
            if pending is not None:
                yield pending
            pending = pa.RecordBatch.from_arrays(columns + list(added.values()), names=[*batch.schema.names, *added])
        if pending is not None:
            tail = np.zeros(pending.num_rows, dtype=bool)
            tail[-1] = True
            yield pending.set_column(pending.schema.get_field_index(TAIL), TAIL, pa.array(tail))

    return scan


def group_position(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], name: str,
                   partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, in ``order_cols`` order.

    One sequence pass: each row's distance to its group's first row, with
    groups that span partitions resolved from the per-partition summary, so
    large groups stay split and no join is needed.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    return sequence(df, group_cols + order_cols, group_cols=group_cols, group_offset=name, partitions=partitions)


def dense_index(keys: DataFrame, order_cols: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Distinct ``order_cols`` of ``keys`` numbered 0..n-1 in sorted order."""
    distinct = keys.select(*order_cols).distinct()
    return sequence(distinct, order_cols, index=name, partitions=partitions)
