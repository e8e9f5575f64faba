"""Quality classifier: naive-Bayes support vectors on n-gram indicators.

1. *Features.*  Which hashed n-grams a text has (indicators, no counts): character
   trigrams, and word bigrams by form: each word's shape (letter case, marks,
   length class) and whether it repeats the word before.  They carry over to new
   words, where the words themselves would not.
2. *Log-count ratios* of every feature between the two classes, over all
   labelled training texts (partial counts per task, summed by feature).
3. *Support vectors.*  Indicators are scaled by their ratio and a linear
   hinge-loss model is fitted by dual coordinate descent, on half of a sample
   of at most ``sample_rows`` training ids per class (the smallest id hashes).
4. *Scores* in 0 to 1: a logistic curve over the margin, fitted on the other
   half, which the model has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.shared import read_documents, small_batches
from affinity.plans.materialize import materialize

FEATURES = 1 << 16
#: Bound of the labelled ids of each class that are sampled, and of their different texts: half of these fit the support vectors, half the curve.
SAMPLE_ROWS = 3000
#: The labels are broadcast if they have at most this many rows (16 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000
COST = 1.0
ROUNDS = 20
THRESHOLD = 0.3
#: Bytes of a text turned into features at a time; cut between words.
SLICE = 1 << 20
#: Class of each byte in a word's shape: lower, upper, digit, other ASCII mark, beyond ASCII.
_CLASS = np.full(256, 4, np.uint32)
_CLASS[:128] = 3
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _hash(values: np.ndarray) -> np.ndarray:
    mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def _slices(data: np.ndarray) -> list[tuple[int, int, bool]]:
    """Byte ranges of about ``SLICE`` bytes that end before a word, and whether a range begins two words early.

    The two words repeat the end of the range before, so neighbours are seen together; a longer word is not cut.
    """
    blank = _BLANK[data]
    begin = np.flatnonzero(~blank & np.append(True, blank[:-1])) if len(data) else np.zeros(0, np.int64)
    if len(begin) < 3 or len(data) <= SLICE:
        return [(0, len(data), False)]
    out, word = [], 0
    while word < len(begin):
        after = max(word + 1, int(np.searchsorted(begin, begin[word] + SLICE)))
        early = max(0, word - 2)
        out.append((int(begin[early]) if word else 0, int(begin[after]) if after < len(begin) else len(data), early > 0 or word > 2))
        word = max(after, 2)
    return out


def text_features(text: bytes | None) -> np.ndarray:
    """Distinct feature numbers of a text, sorted; empty for a null or empty text."""
    data = np.frombuffer(text or b"", np.uint8)
    found = np.zeros(FEATURES, bool)
    for lo, hi, early in _slices(data):
        part = data[lo:hi].astype(np.uint32)
        if len(part) > 2:
            found[_hash(part[:-2] << 16 | part[1:-1] << 8 | part[2:])] = True
        blank = _BLANK[part]
        if blank.all():
            continue
        first = int(np.argmin(blank))
        part, blank = part[first:], blank[first:]
        begin = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        # a word: which classes it has, those of its ends, its length, and a sum that tells words apart
        # (the blanks after a word weigh nothing)
        weight = np.where(blank, 0, part + 1).astype(np.uint64)
        length = np.add.reduceat((~blank).astype(np.int64), begin)
        place = np.arange(len(part)) - np.repeat(begin, np.diff(np.append(begin, len(part))))
        own = np.add.reduceat(weight * (place.astype(np.uint64) * np.uint64(0x10001) + np.uint64(1)), begin)
        has = np.bitwise_or.reduceat(np.where(blank, 0, 1 << _CLASS[part]), begin).astype(np.uint64)
        last = part[np.minimum(begin + length - 1, len(part) - 1)]
        shape = has | _CLASS[part[begin]].astype(np.uint64) << np.uint64(5) | _CLASS[last].astype(np.uint64) << np.uint64(8) \
            | np.minimum(length, 12).astype(np.uint64) // np.uint64(3) << np.uint64(11)
        again = np.append(False, own[1:] == own[:-1]).astype(np.uint64)
        shape = (shape << np.uint64(1) | again)[1 if early else 0:]  # (what stands before the first word of a range is not known)
        found[_hash(shape | np.uint64(1 << 40))] = True
        found[_hash(shape[1:] << np.uint64(20) | shape[:-1] | np.uint64(1 << 60))] = True
    return np.flatnonzero(found)


def class_counts(labelled: DataFrame) -> DataFrame:
    """``(feature, bad, good)`` over all rows of ``labelled`` ``(text, y)``, plus feature -1 with the row counts."""
    def run(batches):
        counts = np.zeros((FEATURES + 1, 2), np.int64)
        for batch in small_batches(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[text_features(text), y] += 1
                counts[FEATURES, y] += 1
        held = np.flatnonzero(counts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held, 0]), pa.array(counts[held, 1])],
                                         names=["feature", "bad", "good"])

    partial = labelled.select("text", "y").mapInArrow(run, "feature long, bad long, good long")
    return partial.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def ratios(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-count ratio of each feature (add-one smoothed shares of the classes' texts)."""
    share = (counts + 1) / (rows + 2)
    return np.log(share[:, 1] / share[:, 0])


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, rounds: int, seed: int = 11) -> np.ndarray:
    """Linear hinge-loss weights by dual coordinate descent; classes weigh alike; rows have unit length."""
    sign = np.where(y > 0, 1.0, -1.0)
    limit = cost * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    values = [unit(r, scale) for r in rows]
    alpha, w = np.zeros(len(y)), np.zeros(FEATURES + 1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x, at = values[i], rows[i]
            slope = sign[i] * (w[at] @ x + w[-1]) - 1
            step = min(max(alpha[i] - slope / (x @ x + 1), 0.0), limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[at] += step * sign[i] * x
                w[-1] += step * sign[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def unit(row: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = scale[row]
    return x / max(1e-9, np.sqrt(x @ x))


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins (Newton steps, slightly ridged)."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        gradient = np.array([((target - p) * margins).sum() - 1e-3 * a, (target - p).sum()])
        hessian = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        a, b = np.array([a, b]) + np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    return float(a), float(b)


def train(labelled: DataFrame, sample: DataFrame, cost: float = COST, rounds: int = ROUNDS) -> dict:
    """Model from ``labelled`` and its bounded ``sample``, both ``(doc_id, text, y)``.

    Counts cover all labelled rows; the driver holds the counts (a fixed number
    of features) and the sample's features.  If all rows are of one class, every
    text scores 0 or 1 accordingly; without labelled rows it scores 0.5.
    """
    table = class_counts(labelled).toPandas()
    counts = np.zeros((FEATURES + 1, 2))
    counts[table.feature.to_numpy(int)] = table[["bad", "good"]].to_numpy(float)
    size = counts[FEATURES].copy()
    flat = {"weights": np.zeros(FEATURES + 1), "scale": np.zeros(FEATURES)}
    if not size.all():
        return {**flat, "curve": (0.0, float(30 * np.sign(size[1] - size[0])))}
    scale = ratios(counts[:FEATURES], size)

    def run(batches):
        for batch in small_batches(batches):
            feats = [text_features(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(feats, pa.binary()), batch.column(2)],
                                             names=["doc_id", "f", "y"])

    rows = sorted(sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, f binary, y int").collect())
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return {**flat, "curve": (0.0, float(np.log(size[1] / size[0])))}
    feats = [np.frombuffer(r.f, "<i4") for r in rows]
    # every second row of a class fits the weights, the others the curve
    rank = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y == 0))
    fit = np.flatnonzero(rank % 2 == 1)
    tune = np.flatnonzero(rank % 2 == 0) if (rank % 2 == 0).any() else fit
    w = fit_hinge([feats[k] for k in fit], y[fit], scale, cost, rounds)
    return {"weights": w, "scale": scale,
            "curve": fit_curve(np.array([_margin(feats[k], w, scale) for k in tune]), y[tune])}


def _margin(row: np.ndarray, w: np.ndarray, scale: np.ndarray) -> float:
    return float(w[row] @ unit(row, scale) + w[-1]) if len(row) else float(w[-1])


def scores(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``__score`` (double, 0 to 1; never null)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: two numbers per feature

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        a, b = m["curve"]
        # (one text as an object at a time)
        margins = np.array([_margin(text_features(t.as_py()), m["weights"], m["scale"]) for t in texts])
        return pa.array(1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30))))

    return docs.withColumn("__score", score(F.col(text_col).cast("binary")))


def kept_out(id_col):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             sample_rows: int = SAMPLE_ROWS, **options) -> dict:
    """Model from the labelled rows of ``docs`` that are not kept out (null ids and labels are no labels)."""
    known = materialize(labels.where(F.col(label_col).isin(0, 1) & ~kept_out(F.col("doc_id")))
                        .groupBy(F.col("doc_id").alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    picked = [known.where(F.col("y") == k).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample_rows) for k in (0, 1)]
    picked = F.broadcast(materialize(picked[0].unionByName(picked[1])))  # 2 * sample_rows ids at most
    # an id may stand on any number of rows: its different texts, and of all of them again sample_rows a class
    held = texts.withColumn("key", F.xxhash64("text")).join(picked, F.col("doc_id") == F.col("id"))
    rows = held.select("doc_id", "key", "y").distinct()
    rows = [rows.where(F.col("y") == k).orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(sample_rows) for k in (0, 1)]
    rows = F.broadcast(materialize(rows[0].unionByName(rows[1])))
    sample = held.join(rows, ["doc_id", "key", "y"]).groupBy("doc_id", "key", "y").agg(F.min("text").alias("text"))
    return train(texts.join(known, F.col("doc_id") == F.col("id")).select("doc_id", "text", "y"),
                 sample.select("doc_id", "text", "y"), **options)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD, **options) -> DataFrame:
    """All columns of ``docs`` plus ``__score`` and ``__predicted`` (1 if the score reaches ``threshold``).

    Null and empty texts have no features and get the score of the bare bias.
    Repeated rows score alike.  Labels, language, source and id are no inputs of
    a score.  A doc_id labelled twice counts as good if any label is.
    """
    rated = scores(docs, train_on(docs, labels, id_col, text_col, **options), text_col)
    return rated.withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))


def op9_quality_classifier(spark, sf_dir):
    """Contract query: doc_id, held_out, score, predicted."""
    docs, labels = read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = classify(docs.select("doc_id", "text"), labels)
    return rated.select("doc_id", F.coalesce(kept_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                        F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))
