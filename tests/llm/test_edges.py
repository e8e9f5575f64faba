"""Every operator on the awkward table and on an empty one."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinity.llm import decontamination, line_dedup, lm_scoring, nearest, packing, personal_data, quality, sharding, simhash_dedup, substring_dedup
from tests.llm.cases import BASE, ROWS, empty, table

IDS = Counter(i for i, _ in ROWS)


def _labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (6, 1, 0), (9, None, 0), (None, 1, 0), (10, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def _benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20, 60))), (2, None), (3, "too short"), (4, "")],
                                 "item_id long, text string")


PER_ROW = {
    "simhash": lambda s, d: simhash_dedup.simhash_groups(d),
    "lm": lambda s, d: lm_scoring.score_texts(d),
    "sharding": lambda s, d: sharding.shuffled_shards(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "personal": lambda s, d: personal_data.find_personal_data(d, steps=5),
    "quality": lambda s, d: quality.classify(d, _labels(s)),
    "substring": lambda s, d: substring_dedup.dedup_substrings(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row(spark, name):
    got = PER_ROW[name](spark, table(spark)).select("doc_id").collect()
    assert Counter(r.doc_id for r in got) == IDS
    assert PER_ROW[name](spark, empty(spark)).count() == 0


def test_packing(spark):
    got = packing.pack_documents(table(spark)).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == IDS
    lone = [r for r in got if r.doc_id in (1, 2)]
    assert [r.length for r in lone] == [1, 1]  # the end id alone
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert packing.pack_documents(empty(spark)).count() == 0


def test_decontamination(spark):
    got = decontamination.contaminations(table(spark), _benchmark(spark)).collect()
    hits = [i for i, t in ROWS if t and BASE in t.lower()]
    assert Counter(r.doc_id for r in got) == Counter(hits)
    assert {(r.item_id, r.start, r.n_words, r.similarity) for r in got} == {(1, 20, 40, 1.0)}
    kept = decontamination.decontaminated(table(spark), _benchmark(spark))
    assert kept.columns == table(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == IDS - Counter(hits)
    assert decontamination.contaminations(empty(spark), _benchmark(spark)).count() == 0
    assert decontamination.contaminations(table(spark), _benchmark(spark).where("false")).count() == 0


def test_simhash_keeps_one_of_each_group(spark):
    groups = simhash_dedup.simhash_groups(table(spark)).collect()
    kept = simhash_dedup.keep_one_per_group(table(spark))
    assert kept.columns == table(spark).columns
    heads = Counter(r.component_id for r in groups)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(heads.keys())
    assert simhash_dedup.keep_one_per_group(empty(spark)).count() == 0


def test_nearest_with_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]),
            (5, [float("nan"), 1.0]), (6, [3.0]), (None, [1.0, 1.0]), (7, [float("inf"), 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit(2), "bucket": F.lit(3)})
    got = sorted(map(tuple, nearest.nearest(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 5.0), (0, 2, 20, 5.0), (0, 3, 6, 3.0), (20, 1, 0, 5.0), (20, 2, 1, 5.0), (20, 3, 6, 3.0)]
    assert nearest.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages_take_both_tables(spark, tmp_path):
    folder = str(tmp_path)
    _labels(spark).write.parquet(f"{folder}/labels.parquet")
    _benchmark(spark).write.parquet(f"{folder}/benchmark.parquet")
    for docs in (table(spark).withColumn("n_chars", F.char_length("text").cast("long")), empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == columns, name
            assert out.count() <= docs.count()
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns
