"""Sinks and the request-driven job."""

import os

import pytest
from pyspark.errors import PySparkException

from affinity.job import PreferenceRequest, build


def _text(path, lines):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")
    return path


def test_npref_from_text(spark, scratch):
    src = _text(os.path.join(scratch, "o.txt"), ["s,1,u1,g1,10", "s,1,u1,g1,20", "s,2,u1,g2,10", "s,3,u2,g3,20"])
    out = os.path.join(scratch, "out")
    req = PreferenceRequest(uid="42", name="shop", algorithm="NPREF", source="FILE", output=out,
                            source_args={"path": src})
    paths = build(req, spark)
    got = sorted(tuple(r) for r in spark.read.parquet(paths[1]).collect())
    assert got == [("s", "u1", 10, 5), ("s", "u1", 20, 3), ("s", "u2", 20, 5)]
    with pytest.raises(PySparkException):
        build(req, spark)  # existing output is never overwritten


def test_epref_writes_five_tables(spark, scratch):
    src = _text(os.path.join(scratch, "e.txt"), ["s,u1,x,0,7", "s,u1,y,172800000,3", "s,u2,x,86400000,1"])
    out = os.path.join(scratch, "out")
    req = PreferenceRequest(uid="7", name="ev", algorithm="EPREF", source="FILE", output=out, sink="FILE",
                            source_args={"path": src})
    paths = build(req, spark)
    assert sorted(paths) == [1, 2, 3, 4, 5]
    assert all(os.path.isdir(p) for p in paths.values())
    # five entries per rating, plus the previous item for u1's second rating
    assert spark.read.option("header", "true").csv(paths[4]).count() == 3 * 5 + 1
    matrix = spark.read.option("header", "true").csv(paths[4])
    assert matrix.where("cat = 'label'").count() == 3
    assert spark.read.option("header", "true").csv(paths[5]).count() == 3


def test_epref_explicit_parquet(spark, scratch):
    df = spark.createDataFrame([("s", "u", "i", 1000, 7, 2.5), ("s", "u", "i", 1000, 7, 2.5)],
                               "site string, user string, item string, timestamp long, event int, score double")
    p = os.path.join(scratch, "ev.parquet")
    df.write.parquet(p)
    req = PreferenceRequest(uid="1", name="x", algorithm="EPREF", source="PARQUET", rating="explicit",
                            output=os.path.join(scratch, "out"), source_args={"path": p})
    paths = build(req, spark)
    assert spark.read.parquet(paths[1]).count() == 2
    assert spark.read.parquet(paths[5]).count() == 2


@pytest.mark.parametrize("field,value", [("algorithm", "XPREF"), ("source", "REDIS"), ("sink", "REDIS"),
                                         ("rating", "both"), ("uid", ""), ("name", ""), ("output", "")])
def test_bad_arguments(field, value):
    args = dict(uid="1", name="n", algorithm="NPREF", source="FILE", output="/tmp/x")
    args[field] = value
    with pytest.raises(ValueError):
        PreferenceRequest(**args).validate()


def test_npref_explicit_documents(spark, scratch):
    import json
    src = os.path.join(scratch, "r.json")
    with open(src, "w", encoding="utf-8") as fh:
        fh.write("\n".join(json.dumps(d) for d in [
            {"site": "s", "user": "u", "item": "3", "score": "4.9", "timestamp": "1"},
            {"site": "s", "user": "u", "item": "3", "score": "4.9", "timestamp": "2"}]))
    req = PreferenceRequest(uid="9", name="ex", algorithm="NPREF", source="ELASTIC", rating="explicit",
                            output=os.path.join(scratch, "out"), source_args={"source": src})
    paths = build(req, spark)
    assert sorted(tuple(r) for r in spark.read.parquet(paths[1]).collect()) == [("s", "u", 3, 4), ("s", "u", 3, 4)]


def test_command_line(spark, scratch, capsys):
    from affinity.__main__ import main

    src = _text(os.path.join(scratch, "e.txt"), ["s,u1,x,0,7", "s,u1,y,86400000,3"])
    out = os.path.join(scratch, "out")
    assert main(["--uid", "5", "--name", "cli", "--algorithm", "EPREF", "--source", "FILE", "--path", src,
                 "--output", out]) == 0
    printed = capsys.readouterr().out.split()
    assert len(printed) == 5 and all(os.path.isdir(p) for p in printed)
    assert spark.read.parquet(printed[0]).count() == 2
