"""Cases that once went wrong: exact keys in sinks, 64-bit values, given indexes, score tables, options."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from affinity import schemas
from affinity import session as SE
from affinity.__main__ import parse
from affinity.job import PreferenceRequest, build
from affinity.operators import engagement as E
from affinity.operators import features as FT
from affinity.plans.sequence import sequence
from affinity.sinks import read_table, write_engagement
from affinity.sources.fieldspec import FieldSpec
from affinity.sources.orderlog import log_options
from affinity.sources.readers import jdbc_options
from affinity.sources.scores import default_scores


@pytest.mark.parametrize("n", [1])
def test_sinks_write_equal_tables(spark, scratch, n):
    keys = ["u1", " u1", "u1 ", "", 'q"u', "b\\s", "two\nlines", "a,b", "\ttab"]
    rows = [("s", k, f" i{j} ", float(j), 86_400_000 * j, 7) for j, k in enumerate(keys)]
    ratings = spark.createDataFrame(rows, schemas.ENGAGEMENT_RATING)
    kinds = {}
    for sink in ("PARQUET", "FILE"):
        paths = write_engagement(ratings, os.path.join(scratch, sink), "n", "1", sink)
        schema = {part: spark.read.parquet(p).schema for part, p in paths.items()} if sink == "PARQUET" else schema
        kinds[sink] = [sorted(map(tuple, read_table(spark, p, sink, schema[part]).collect())) for part, p in paths.items()]
    assert kinds["PARQUET"] == kinds["FILE"]
    assert len(kinds["FILE"][1]) == len(keys)


def test_sequence_keeps_64_bit_values_beside_nulls(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([("g", 1, big), ("g", 2, None), ("g", 3, big + 2)], "g string, t long, payload long")
    out = sequence(df, ["g", "t"], group_cols=["g"], lag={"prev": "t", "before": "payload"}, index="i", partitions=2)
    got = {r.t: (r.payload, r.prev, r.before) for r in out.collect()}
    assert got == {1: (big, None, None), 2: (None, 1, big), 3: (big + 2, 2, None)}


@pytest.mark.parametrize("rows_per_batch", [1, 7, 10_000])
def test_sequence_does_not_depend_on_batches(spark, rows_per_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    try:
        df = spark.range(60).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 4).alias("t"), F.col("id").alias("v"))
        out = sequence(df, ["g", "t", "v"], group_cols=["g"], run_cols=["t"], lag={"prev": "v"}, index="i",
                       group_index="gi", group_offset="o", partitions=3)
        got = sorted((r.g, r.t, r.v, r.prev, r.i, r.gi, r.o) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = sorted((k % 3, k // 4, k) for k in range(60))
    expected = []
    for i, (g, t, v) in enumerate(rows):
        mine = [r for r in rows if r[0] == g]
        earlier = [r for r in mine if r[1] < t]
        expected.append((g, t, v, earlier[-1][2] if earlier else None, i, g, mine.index((g, t, v))))
    assert got == expected


RATINGS = [("s", "u2", "x", 5.0, 0, 7), ("s", "u3", "y", 60.0, 1, 3)]


def test_given_indexes_are_used(spark):
    ratings = spark.createDataFrame(RATINGS, schemas.ENGAGEMENT_RATING)
    users = spark.createDataFrame([("s", "u1", 0), ("s", "u2", 1), ("s", "u3", 2)], schemas.USER_INDEX)
    items = spark.createDataFrame([("w", 0), ("x", 1), ("y", 2)], schemas.ITEM_INDEX)
    ff = FT.prepare(ratings, users, items)
    assert sorted((r.urow, r.icol) for r in ff.rating_rows().collect()) == [(1, 1), (2, 2)]
    assert (ff.n_users, ff.n_items) == (3, 3)


def test_ratings_missing_from_a_given_index_fail(spark):
    ratings = spark.createDataFrame(RATINGS, schemas.ENGAGEMENT_RATING)
    users, items = FT.index_tables(ratings)
    with pytest.raises(PySparkException, match="item is not in the index"):
        FT.prepare(ratings, users, items.where("item = 'x'")).matrix().collect()
    with pytest.raises(PySparkException, match="user is not in the index"):
        FT.prepare(ratings, users.where("user = 'u2'"), items).matrix().collect()


def test_score_table_of_any_size_and_repeated_codes(spark):
    net = spark.createDataFrame([("s", "u", "i", 19_999, 2, 5)], "site string, user string, item string, event int, net long, latest long")
    large = [(k, "x", [k, k + 1]) for k in range(1, 20_001)]
    assert E.score_events(net, large).first().rating == 20_000
    with pytest.raises(PySparkException, match="listed twice"):
        E.score_events(net, [(19_999, "x", [5]), (19_999, "y", [50])]).collect()
    assert default_scores(spark).count() == 11


class _Bare:
    """A session without any checkpoint folder."""

    class sparkContext:  # noqa: N801
        master = "local[1]"

        @staticmethod
        def getCheckpointDir():
            return None

        @staticmethod
        def getConf():
            return {}

    conf = {}


def test_no_checkpoint_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        SE.checkpoint_dir(_Bare)


def test_jdbc_options():
    with pytest.raises(ValueError, match="partition_column"):
        jdbc_options("jdbc:x", "t")
    assert "partitionColumn" not in jdbc_options("jdbc:x", "t", num_partitions=1)
    got = jdbc_options("jdbc:x", "t", {"user": "me"}, "id", 0, 9, 3)
    assert got == {"url": "jdbc:x", "dbtable": "t", "user": "me", "partitionColumn": "id", "lowerBound": "0",
                   "upperBound": "9", "numPartitions": "3"}
    log = log_options("jdbc:x", "log", "2020-01-01 00:00:00", "2020-02-01 00:00:00", 8)
    assert (log["partitionColumn"], log["lowerBound"], log["upperBound"], log["numPartitions"]) == (
        "server_time", "2020-01-01 00:00:00", "2020-02-01 00:00:00", "8")


def test_command_line_jdbc(scratch):
    secret = os.path.join(scratch, "secret")
    with open(secret, "w", encoding="utf-8") as fh:
        fh.write("word\n")
    base = ["--uid", "1", "--name", "n", "--algorithm", "NPREF", "--output", "/out", "--url", "jdbc:x", "--table", "t",
            "--user", "me", "--password-file", secret, "--driver", "d.D", "--num-partitions", "4"]
    req = parse([*base, "--source", "JDBC", "--partition-column", "id", "--lower-bound", "0", "--upper-bound", "9"])
    assert jdbc_options(**{k: v for k, v in req.source_args.items()})["numPartitions"] == "4"
    assert req.source_args["properties"] == {"user": "me", "password": "word", "driver": "d.D"}
    log = parse([*base, "--source", "LOG", "--site", "1", "--startdate", "2020-01-01", "--enddate", "2020-02-01"])
    log.validate()
    assert log.source_args["partitions"] == 4
    with pytest.raises(ValueError, match="missing startdate"):
        PreferenceRequest(uid="1", name="n", algorithm="NPREF", source="LOG", output="/o", site=1).validate()


def test_npref_from_parquet_and_spec_from_storage(spark, scratch):
    source = os.path.join(scratch, "lines.parquet")
    spark.createDataFrame([("s", 1, "u1", "g1", "10"), ("s", 1, "u1", "g1", "20"), ("s", 2, "u1", "g2", "10"), ("s", 3, "u2", "g3", "20")],
                          "shop string, at long, who string, basket string, sku string").write.parquet(source)
    spec = os.path.join(scratch, "spec.xml")
    names = {"site": "shop", "timestamp": "at", "user": "who", "group": "basket", "item": "sku"}
    with open(spec, "w", encoding="utf-8") as fh:
        fh.write("<fieldspec>" + "".join(f'<field name="{k}" type="String">{v}</field>' for k, v in names.items()) + "</fieldspec>")
    req = PreferenceRequest(uid="3", name="p", algorithm="NPREF", source="PARQUET", output=os.path.join(scratch, "out"),
                            source_args={"path": source, "spec": FieldSpec.load("file://" + spec, spark)})
    got = sorted(tuple(r) for r in spark.read.parquet(build(req, spark)[1]).collect())
    assert got == [("s", "u1", 10, 5), ("s", "u1", 20, 3), ("s", "u2", 20, 5)]
