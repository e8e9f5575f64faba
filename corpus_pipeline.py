"""Corpus pipeline: five stages over ``documents``, each calling one operator of ``affinity.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and reads again as the next
one's docs.  All stages but the last return the columns of ``documents`` (extra
columns travel along); the last returns the packed pieces.

Every stage takes null, empty and very long texts, null ids, repeated rows and
an empty table; the operators' docstrings say what becomes of each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from affinity.llm.decontamination import decontaminated
from affinity.llm.line_dedup import dedup_lines
from affinity.llm.packing import pack_documents
from affinity.llm.quality import classify
from affinity.llm.shared import read_documents, stored
from affinity.llm.simhash_dedup import keep_one_per_group


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier, trained on ``labels.quality``, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("__predicted = 1").drop("__score", "__predicted")


def line_dedup(spark, docs, sf_dir):
    """Lines of 20 characters or more that three documents share stay in the last of them only; ``n_chars`` follows."""
    cleaned = dedup_lines(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def simhash_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays (3-word shingles, at most 3 bits apart)."""
    return keep_one_per_group(docs, shingle=3, max_distance=3)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go (five-word shingles, similarity of 0.8 or more)."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark, docs, sf_dir):
    """Token pieces with their sequence and place in it."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the classifier, the fingerprints and the tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, run on the whole ``documents`` table."""
    docs = read_documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
