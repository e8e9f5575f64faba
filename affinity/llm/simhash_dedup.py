"""SimHash near-duplicate groups by bit-sliced comparison.

Every text gets a 64-bit fingerprint (majority vote of its shingle hashes).
Different fingerprints within ``max_distance`` bits are found in two steps:

1. *Keys.*  With ``r = max_distance`` the 64 bits are cut into ``r + 1`` blocks,
   and for each block the other bits again into ``r + 1`` blocks.  Two
   fingerprints within ``r`` bits agree on one outer block and then on one inner
   block, so they share one of the ``(r + 1)**2`` keys (28 bits each for r = 3):
   no link is lost.
2. *Bit-sliced comparison* of the fingerprints under one key.  64 fingerprints
   stand in a block of 64 vertical bit planes; a fingerprint is compared with a
   whole block by adding the planes' differences into carry-save counters (one
   word operation adds to 64 distances).  A block is abandoned as soon as all
   its distances exceed the radius.

Keys with many fingerprints are cut into pieces, and pieces are compared pair by
pair, so no task holds a whole key.  A comparison returns a spanning forest of
its links (never all pairs); ``shared.components`` joins the forests.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.shared import components, small_batches, stored
from affinity.plans.materialize import materialize

BITS = 64
SEED = 42
#: Words hashed at a time, so that a very long text needs little memory.
SLICE = 1 << 16
#: Fingerprints of one key compared in one piece.
PIECE = 512
#: Pairs (fingerprint, block) in the counters at a time.
CHUNK = 1 << 17
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ------------------------------------------------------------------ fingerprints

def fingerprint(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit SimHash of one text (UTF-8); 0 for a null or wordless text."""
    words = (text or b"").lower().split()  # on bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    votes, total = np.zeros(BITS, np.int64), len(words) - shingle + 1
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    for start in range(0, total, SLICE):
        part = words[start:start + SLICE + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter(map(digest, grams), np.dtype("<u8"))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)`` per row of ``docs``.

    ``text_key`` is ``xxhash64`` of the text, which tells apart rows that share a
    doc_id.  Null and empty texts get fingerprint 0.
    """
    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(2).to_pylist()
            fps = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "text_key", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                         F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, text_key long, fp long")


# ------------------------------------------------------------------ keys

def _ones(width: int) -> int:
    """A signed 64-bit number with the lowest ``width`` bits set."""
    return (1 << width) - 1 if width < BITS else -1


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` nearly equal blocks of ``width`` bits."""
    edges = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_keys(fp, max_distance: int) -> list:
    """The ``(max_distance + 1)**2`` key columns (strings of table, outer and inner block)."""
    keys = []
    for at, wide in _cuts(BITS, max_distance + 1):
        outer = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(_ones(wide)))
        low = fp.bitwiseAND(F.lit(_ones(at)))
        high = F.shiftrightunsigned(fp, at + wide) if at + wide < BITS else F.lit(0).cast("long")
        rest = F.shiftleft(high, at).bitwiseOR(low)
        for inner_at, inner_wide in _cuts(BITS - wide, max_distance + 1):
            inner = F.shiftrightunsigned(rest, inner_at).bitwiseAND(F.lit(_ones(inner_wide)))
            keys.append(F.struct(F.lit(len(keys)).alias("t"), outer.alias("a"), inner.alias("b")))
    return keys


# ------------------------------------------------------------------ bit-sliced comparison

def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n items over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (step := root[root]).tobytes() != root.tobytes():
            root = step
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def bit_sliced_links(fps: np.ndarray, starts: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(i, j)``, j < i, inside each group of ``fps`` (uint64; groups begin at ``starts``).

    Returns a spanning forest of the pairs within ``max_distance`` bits.
    """
    n = len(fps)
    sizes = np.diff(np.append(starts, n))
    local = np.arange(n) - np.repeat(starts, sizes)
    words_of = (sizes + 63) // 64
    first_word = np.cumsum(words_of) - words_of
    own_word = np.repeat(first_word, sizes) + local // 64
    bit = (local % 64).astype(np.uint64)
    begins = np.flatnonzero(np.append(True, own_word[1:] != own_word[:-1]))
    planes = np.empty((BITS, len(begins)), np.uint64)
    one = np.uint64(1)
    for b in range(BITS):
        planes[b] = np.bitwise_or.reduceat(((fps >> np.uint64(b)) & one) << bit, begins)
    # A fingerprint meets its group's blocks up to its own, there only the members before it.
    meets = own_word - np.repeat(first_word, sizes) + 1
    depth = int(max_distance).bit_length()
    lead = (1 << depth) - (max_distance + 1)  # counters start here, so they overflow past the radius
    root = np.arange(n)
    bounds = np.searchsorted(np.cumsum(meets), np.arange(0, meets.sum() + CHUNK, CHUNK), side="left")
    for lo, hi in zip(bounds, np.append(bounds[1:], n), strict=False):
        if lo >= hi:
            continue
        query = np.repeat(np.arange(lo, hi), meets[lo:hi])
        block = np.repeat(np.repeat(first_word, sizes)[lo:hi], meets[lo:hi]) \
            + np.arange(len(query)) - np.repeat(np.cumsum(meets[lo:hi]) - meets[lo:hi], meets[lo:hi])
        over = np.where(block == own_word[query], ~((one << bit[query]) - one), np.uint64(0))
        keep = over != ALL
        query, block, over = query[keep], block[keep], over[keep]
        sums = [np.full(len(query), ALL if lead >> k & 1 else 0, np.uint64) for k in range(depth)]
        for b in range(BITS):
            carry = planes[b][block] ^ (np.uint64(0) - ((fps[query] >> np.uint64(b)) & one))
            for k in range(depth):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            over |= carry
            if b % 8 == 7:
                keep = over != ALL  # the others are abandoned
                if not keep.all():
                    query, block, over = query[keep], block[keep], over[keep]
                    sums = [s[keep] for s in sums]
                    if not len(query):
                        break
        if len(query):
            near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, col = np.nonzero(near)
            target = (block[row] - np.repeat(first_word, sizes)[query[row]]) * 64 + col + np.repeat(starts, sizes)[query[row]]
            # keep the forest only: earlier roots first, then these links
            old = np.flatnonzero(root != np.arange(n))
            root = _local_roots(n, np.concatenate([old, query[row]]), np.concatenate([root[old], target]))
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def fingerprint_links(fps: DataFrame, max_distance: int = 3, piece: int = PIECE) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that span all pairs within the radius."""
    keyed = fps.select("fp", F.explode(F.array(*block_keys(F.col("fp"), max_distance))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / F.lit(piece)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("piece")), pieces).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), pieces - 1),
                        lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    dealt = keyed.join(sizes, "key").select("fp", "key", F.explode(pairs).alias("pair"))
    dealt = dealt.select("fp", F.xxhash64("key", "pair").alias("task"), "key", "pair")
    ordered = dealt.repartition("task").sortWithinPartitions("task", "key", "pair", "fp").select(
        "task", F.col("key.t").alias("t"), F.col("key.a").alias("a"), F.col("key.b").alias("b"),
        F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "fp")

    def run(batches):
        kept = None
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not len(table):
                continue
            if kept is not None:
                table = np.concatenate([kept, table])
            starts = np.flatnonzero(np.append(True, (table[1:, :6] != table[:-1, :6]).any(1)))
            kept, done = table[starts[-1]:], table[:starts[-1]]
            if len(done):
                yield links(done, starts[:-1])
        if kept is not None and len(kept):
            yield links(kept, np.zeros(1, np.int64))

    def links(table, starts):
        values = np.ascontiguousarray(table[:, 6])
        i, j = bit_sliced_links(values.view(np.uint64), starts, max_distance)
        return pa.RecordBatch.from_arrays([pa.array(values[i]), pa.array(values[j])], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


# ------------------------------------------------------------------ operator

def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_distance: int = 3) -> DataFrame:
    """Near-duplicate groups: ``(doc_id, text_key, fp, component_id, root)``, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_distance`` differing bits, the row's own included.  Null and empty
    texts have fingerprint 0 and are linked like any other; a null doc_id never
    becomes a component id unless its group has no other (then it is null).
    ``root`` is the group's smallest fingerprint, its own even where two groups share a component id.
    Repeated rows stay repeated.  Other columns of ``docs`` are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fingerprint_links(distinct.select("fp"), max_distance), "a", "b")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # Stored, so that the join shuffles both sides itself and Spark can split a fingerprint with very many copies.
    found = stored(placed.join(heads, "root").select("fp", "component_id", "root"), "components")
    return marked.join(found, "fp")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_distance: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one per near-duplicate group, the smallest doc_id.

    If that doc_id is repeated with different texts, the text with the smallest
    hash stays; rows repeated with equal id and text stay once.  A group with
    only null ids keeps its row of the smallest text hash.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, max_distance)
    # (by the root, as a doc_id with two texts can be the smallest of two groups; summed before the shuffle, however large the group)
    best = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k"))
    # Keys without nulls: the semi-join and the last step share one partitioning, so texts move once.
    key = ["__nil", "__id", "__key"]
    keepers = best.select(F.col("k.doc_id").isNull().alias("__nil"), F.coalesce("k.doc_id", F.lit(0)).alias("__id"),
                          F.col("k.text_key").alias("__key")).distinct()
    own = F.col(id_col).cast("long")
    rows = docs.withColumns({"__nil": own.isNull(), "__id": F.coalesce(own, F.lit(0)), "__key": F.xxhash64(text_col)})
    return rows.join(keepers, key, "left_semi").dropDuplicates(key).drop(*key)


def op1_simhash_dedup(spark, sf_dir):
    """Contract query: doc_id, fingerprint, component_id."""
    from affinity.llm.shared import read_documents

    groups = simhash_groups(read_documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
