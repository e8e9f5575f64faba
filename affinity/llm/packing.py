"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become token ids plus an end id.  Longer ones are cut into pieces of
``capacity`` tokens (the first piece takes the remainder); full pieces are
sequences of their own.  The other pieces are packed:

* They are dealt by hash into cells of about ``cell_items``; a cell is one
  packing problem, held as one row.
* Each cell is solved on several *islands* (rows that evolve apart).  An
  individual is a grouping of the pieces into bins; the first ones come from
  best-fit decreasing and from best fit in random order.  Crossover injects
  whole well-filled bins of one parent into the other, removes the bins that
  hold duplicates, and best-fits the displaced pieces.
* After each epoch the elite of every island migrates to the next island of its
  cell (a join on cell and island).
* The best island of a cell gives its plan.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.shared import read_documents, small_batches, stored
from affinity.plans.materialize import materialize

CAPACITY = 1024
END_ID = 2
CELL_ITEMS = 16384
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 24
POPULATION = 4
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens that the tokenizer's JSON beside the rank file lists; none if there is no such file."""
    import json
    import os

    path = path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"]
    for token in listed:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token with its own matching rules: {token}")
    return {token["content"]: token["id"] for token in listed}


def load_encoder(path: str):
    """Byte-level BPE from a rank file; texts are split at the strings of the added tokens, as the JSON's tokenizer does."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


# ------------------------------------------------------------------ pieces

def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)`` per piece; ``ids`` are little-endian uint32."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        encoder = load_encoder(path)
        for batch in small_batches(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode_to_numpy(text or "", allowed_special="all"), end_id).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[lo:hi].tobytes()
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


# ------------------------------------------------------------------ grouping genetic algorithm

def best_fit(lengths, order, bins: np.ndarray, fill: list[int], capacity: int) -> np.ndarray:
    """Put the pieces of ``order`` into the fullest bins that take them, else into new ones."""
    gaps = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    for item in order:
        need = int(lengths[item])
        at = bisect_left(gaps, (need, -1))
        if at < len(gaps):
            gap, target = gaps.pop(at)
        else:
            gap, target = capacity, len(fill)
            fill.append(0)
        bins[item] = target
        fill[target] += need
        if gap > need:
            insort(gaps, (gap - need, target))
    return bins


def fitness(lengths, bins, capacity: int) -> tuple:
    """Fewer bins first, then fuller ones (larger sum of squared fills)."""
    fill = np.bincount(bins, weights=lengths)
    return len(fill), -float((fill * fill).sum())


def crossover(lengths, host, donor, capacity: int, rng) -> np.ndarray:
    """Inject well-filled bins of ``donor`` into ``host``; displaced pieces are best-fitted."""
    fill = np.bincount(donor, weights=lengths)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, max(1, len(well) // 3), replace=False)] = True
    injected = chosen[donor]
    broken = np.zeros(host.max() + 1, bool)
    broken[host[injected]] = True  # these hold duplicates of injected pieces
    weak = np.flatnonzero(np.bincount(host, weights=lengths) < 0.9 * capacity)
    if len(weak):  # and a few badly filled bins are dissolved
        broken[rng.choice(weak, max(1, len(weak) // 4), replace=False)] = True
    displaced = broken[host] & ~injected
    labels = np.where(injected, donor + len(broken), host)
    kept = ~displaced
    child = np.zeros(len(host), np.int32)
    child[kept] = np.unique(labels[kept], return_inverse=True)[1]
    totals = np.bincount(child[kept], weights=lengths[kept]).astype(int).tolist()
    order = np.flatnonzero(displaced)
    return best_fit(lengths, order[np.argsort(-lengths[order], kind="stable")], child, totals, capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, size: int, rng) -> list:
    """``generations`` offspring; returns the best ``size`` individuals, best first."""
    n = len(lengths)
    if not population:
        falling = np.argsort(-lengths, kind="stable")
        population = [best_fit(lengths, falling, np.zeros(n, np.int32), [], capacity)]
        while len(population) < size:
            noisy = np.argsort(-(lengths * rng.uniform(0.8, 1.25, n)), kind="stable")
            population.append(best_fit(lengths, noisy, np.zeros(n, np.int32), [], capacity))
    ranked = sorted(((fitness(lengths, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    least = math.ceil(lengths.sum() / capacity)
    for k in range(generations):
        if ranked[0][0][0] <= least or n < 2:
            break
        a, b = rng.choice(len(ranked), 2, replace=len(ranked) < 2)
        child = crossover(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2], capacity, rng)
        ranked.append((fitness(lengths, child, capacity), len(population) + k, child))
        ranked = sorted(ranked, key=lambda x: x[:2])[:size]
    return [p for _, _, p in ranked[:size]]


def _epoch(cells: DataFrame, epoch: int, capacity: int, generations: int, size: int, seed: int) -> DataFrame:
    """One epoch on every island.  ``cells``: cell, island, rows, lengths, population, migrant (binary)."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                held = [row["population"], row["migrant"]]
                population = [p.copy() for x in held if x for p in np.frombuffer(x, "<i4").reshape(-1, len(lengths))]
                rng = np.random.default_rng([seed, epoch, row["cell"], row["island"]])
                best = evolve(lengths, population, capacity, generations, size, rng)
                bins, spread = fitness(lengths, best[0], capacity)
                out.append({**{k: row[k] for k in ("cell", "island", "rows", "lengths")}, "bins": bins, "spread": spread,
                            "population": np.concatenate(best).astype("<i4").tobytes(),
                            "elite": best[0].astype("<i4").tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("rows", pa.binary()), ("lengths", pa.binary()),
                        ("bins", pa.int32()), ("spread", pa.float64()), ("population", pa.binary()), ("elite", pa.binary())])
    return cells.mapInArrow(run, "cell long, island int, rows binary, lengths binary, bins int, spread double, "
                                 "population binary, elite binary")


def placements(items: DataFrame, capacity: int = CAPACITY, cell_items: int = CELL_ITEMS, islands: int = ISLANDS,
               epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION,
               seed: int = 7) -> DataFrame:
    """Pack ``items`` ``(row_id long, length long)``, lengths 1 to capacity: ``(row_id, sequence_id, offset)``."""
    count = items.count()
    cells = max(1, round(count / cell_items))

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")  # a cell's rows in a fixed order, whatever way they came
        return pa.table({"cell": table["cell"].slice(0, 1),
                         "rows": pa.array([table["row_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "lengths": pa.array([table["length"].to_numpy().astype("<i4").tobytes()], pa.binary())})

    dealt = items.select(F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(cells)).alias("cell"), "row_id", "length")
    packed = dealt.groupBy("cell").applyInArrow(gather, "cell long, rows binary, lengths binary")
    none = F.lit(None).cast("binary")
    state = packed.select("cell", F.explode(F.array([F.lit(k) for k in range(islands)])).alias("island"),
                          "rows", "lengths", none.alias("population"), none.alias("migrant")).repartition("cell", "island")
    for epoch in range(epochs):
        evolved = materialize(_epoch(state, epoch, capacity, generations, population, seed))
        migrants = evolved.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                                  F.col("elite").alias("migrant"))
        state = evolved.select("cell", "island", "rows", "lengths", "population").join(migrants, ["cell", "island"])
    best = evolved.groupBy("cell").agg(F.min(F.struct("bins", "spread", "island")).alias("best"))
    winners = evolved.join(best, "cell").where(F.col("island") == F.col("best.island")).select("cell", "rows", "lengths", "elite")

    def lay(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                bins = np.frombuffer(row["elite"], "<i4")
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                first = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1]))
                begin = (ends - lengths[order])[first]
                offset = ends - lengths[order] - np.repeat(begin, np.diff(np.append(first, len(order))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[order]), pa.array(row["cell"] * (1 << 32) + bins[order].astype(np.int64)), pa.array(offset)],
                    names=["row_id", "sequence_id", "offset"])

    return winners.mapInArrow(lay, "row_id long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, vocabulary: str | None = None, **options) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)`` per piece.

    Null and empty texts are the end id alone.  Every row of ``docs`` is packed,
    repeated ones each on their own; null ids stay null.  Other columns are not
    read.  The token ids are stored once in the shared folder.
    """
    table = stored(pieces(docs, id_col, text_col, capacity, end_id, vocabulary)
                   .withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    items = table.where(F.col("length") < capacity).select("row_id", "length")
    full = table.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -F.col("row_id") - 1, "offset": F.lit(0).cast("long")})
    placed = table.where(F.col("length") < capacity).join(placements(items, capacity, **options), "row_id")
    return full.unionByName(placed).drop("row_id")


def op8_best_fit_packing(spark, sf_dir):
    """Contract query: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = pack_documents(read_documents(spark, sf_dir))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
