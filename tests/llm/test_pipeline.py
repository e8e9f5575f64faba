"""Every stage of the pipeline against plain Python or SQL, each on its own input, and the whole run."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from affinity.llm import quality
from affinity.llm.line_dedup import OP5_SQL
from affinity.llm.shared import read_documents, stored
from tests.conftest import SF_CHECK
from tests.llm.test_brute_force import _fingerprint, _roots, _shingles

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage, by name."""
    docs, out = read_documents(spark, SF_CHECK), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, SF_CHECK), name)
        out[name] = docs, result
        docs = result
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_order_and_columns(spark, steps):
    assert list(STAGES) == ["quality_classifier", "line_dedup", "simhash_dedup", "benchmark_decontamination", "best_fit_packing"]
    columns = read_documents(spark, SF_CHECK).columns
    assert all(result.columns == columns for name, (_, result) in steps.items() if name != "best_fit_packing")


def test_quality(spark, steps):
    docs, result = steps["quality_classifier"]
    rated = quality.classify(docs, spark.read.parquet(f"{SF_CHECK}/labels.parquet"))
    assert set(_texts(result)) == {r.doc_id for r in rated.where("__score >= 0.3").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    kept = Counter(labels[i] for i in _texts(result) if i in labels)
    assert kept[1] == sum(labels.values()) and kept[0] <= 0.1 * (len(labels) - sum(labels.values()))


def test_lines(steps):
    docs, result = steps["line_dedup"]
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    expected = dict(con.sql(f"SELECT doc_id, kept_sha256 FROM ({OP5_SQL})").fetchall())
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in _texts(result).items()} == expected
    assert all(r.n_chars == len(r.text) or r.text == _texts(docs)[r.doc_id] for r in result.collect())


def test_near_duplicates(steps):
    docs, result = steps["simhash_dedup"]
    prints = {i: _fingerprint(t) for i, t in _texts(docs).items()}
    by_print = defaultdict(list)
    for i, p in prints.items():
        by_print[p].append(i)
    different = sorted(by_print)
    links = [(a, b) for k, a in enumerate(different) for b in different[k + 1:] if (a ^ b).bit_count() <= 3]
    groups = defaultdict(list)
    for p, root in _roots(different, links).items():
        groups[root] += by_print[p]
    assert set(_texts(result)) == {min(ids) for ids in groups.values()}


def test_decontamination(spark, steps):
    docs, result = steps["benchmark_decontamination"]
    items = [_shingles(r.text) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    holders = defaultdict(set)
    for k, grams in enumerate(items):
        for g in grams:
            holders[g].add(k)

    def clean(text):
        grams = _shingles(text)
        for k in set().union(*(holders.get(g, ()) for g in grams)) if grams else ():
            want, n = Counter(items[k]), len(items[k])
            for s in range(max(1, len(grams) - n + 1)):
                window = Counter(grams[s:s + n])
                shared = sum((window & want).values())
                if shared >= 0.8 * (sum(window.values()) + n - shared):
                    return False
        return True

    assert set(_texts(result)) == {i for i, t in _texts(docs).items() if clean(t)}


def test_whole_run(spark, steps):
    docs, result = steps["best_fit_packing"]
    run = corpus_pipeline.run(spark, SF_CHECK)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*columns).collect())) == sorted(map(tuple, result.select(*columns).collect()))
    assert {r.doc_id for r in run.select("doc_id").distinct().collect()} == set(_texts(docs))
    fill = Counter()
    for r in run.select("sequence_id", "length").collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * sum(fill.values()) / 1024 + 2
