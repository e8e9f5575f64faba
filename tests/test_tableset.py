"""Committed table sets: failures between tables, resumption, refusals, checksums."""

import os

import pytest
from pyspark.errors import PySparkException

from affinity import sinks
from affinity.job import PreferenceRequest, build
from affinity.tableset import TableSet, TableSetError, read_set

LINES = ["s,u1,x,0,7", "s,u1,y,172800000,3", "s,u2,x,86400000,1", "s,u2,z,86400005,2"]


def _request(scratch, uid, sink="PARQUET", lines=LINES):
    path = os.path.join(scratch, "events.txt")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")
    return PreferenceRequest(uid=uid, name="set", algorithm="EPREF", source="FILE", sink=sink, output=os.path.join(scratch, "out"),
                             source_args={"path": path})


def _tables(spark, scratch, uid):
    return {k: (df.columns, sorted(map(str, df.collect()))) for k, df in read_set(spark, os.path.join(scratch, "out"), "set", uid).items()}


@pytest.mark.parametrize("sink,fails_at", [("PARQUET", 3), ("FILE", 5), ("PARQUET", 1)])
def test_a_killed_build_goes_on(spark, scratch, monkeypatch, sink, fails_at):
    build(_request(scratch, "whole", sink), spark)
    real, calls = sinks.write_table, []

    def dies(df, path, *args):
        calls.append(path)
        if len(calls) == fails_at:
            raise RuntimeError("killed")
        real(df, path, *args)

    monkeypatch.setattr(sinks, "write_table", dies)
    with pytest.raises(RuntimeError, match="killed"):
        build(_request(scratch, "cut", sink), spark)
    with pytest.raises(TableSetError, match="not a finished"):
        read_set(spark, os.path.join(scratch, "out"), "set", "cut")
    written = []
    monkeypatch.setattr(sinks, "write_table", lambda df, path, *args: (written.append(path[-1]), real(df, path, *args)))
    # the source has changed meanwhile: finished ratings are kept, so all tables still fit together
    changed = LINES if fails_at == 1 else [*LINES, "s,u9,q,5,7"]
    paths = build(_request(scratch, "cut", sink, changed), spark)
    assert written == [str(k) for k in range(fails_at, 6)] and sorted(paths) == [1, 2, 3, 4, 5]
    assert _tables(spark, scratch, "cut") == _tables(spark, scratch, "whole")


def test_a_damaged_part_is_written_again(spark, scratch):
    base = os.path.join(scratch, "out")
    df = spark.range(100).selectExpr("id", "cast(id % 7 as string) AS v")
    TableSet(spark, base, "n", "1", request="r").write(1, df)
    df.where("id < 99").write.mode("overwrite").parquet(os.path.join(base, "n", "1", "1"))
    again = TableSet(spark, base, "n", "1", request="r")
    assert again.write(1, df).count() == 100 and again.kept == []
    more = TableSet(spark, base, "n", "1", request="r")
    assert more.write(1, df).count() == 100 and more.kept == [1]
    with pytest.raises(TableSetError, match="lacks parts"):
        more.commit([1, 2])
    more.commit([1])
    with pytest.raises(TableSetError, match="already built"):
        TableSet(spark, base, "n", "1", request="r")


def test_other_requests_and_foreign_files_are_refused(spark, scratch):
    base = os.path.join(scratch, "out")
    TableSet(spark, base, "n", "2", request="one")
    with pytest.raises(TableSetError, match="another request"):
        TableSet(spark, base, "n", "2", request="two")
    with pytest.raises(TableSetError, match="another request"):
        TableSet(spark, base, "n", "2", "FILE", request="one")
    spark.range(3).write.parquet(os.path.join(base, "n", "3", "1"))
    with pytest.raises(PySparkException):
        TableSet(spark, base, "n", "3").write(1, spark.range(5))
    assert spark.read.parquet(os.path.join(base, "n", "3", "1")).count() == 3


def test_an_empty_set_can_be_read(spark, scratch):
    request = _request(scratch, "none", lines=["s,u,i,0,-1"])
    build(request, spark)
    assert {k: len(rows) for k, (_, rows) in _tables(spark, scratch, "none").items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
