"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (DataFrame operations only).

A document is contaminated by a benchmark item if one of its windows as long as
the item has a weighted shingle similarity (shared over all shingles, counting
repeats) of at least ``similarity``.

1. *Windows.*  Only windows that share a shingle with an item of their length
   can be similar, and sliding a window to the right up to its next shared
   shingle loses nothing; so windows start at shared shingles (or end with the
   text).  No other window can be better.
2. *SimHash* of every such window and of every item: 64 bits by majority vote of its
   shingles, repeated ones numbered, so that each has a vote of its own.  Windows slide:
   each place that they cover gives its votes once when it comes and once when it goes,
   and running sums give all windows, so the work is linear in the places covered,
   whatever the length of the items.
3. *Multi-index Hamming blocks.*  Fingerprints within ``radius`` bits differ in
   at most ``radius // blocks`` bits on one of the blocks; items are listed under
   every value within that distance of their blocks, windows look up their own
   values.  So all pairs within the radius are found, and checked bit by bit.
   (Two windows at similarity 0.8 differ in 9.7 bits on average, with a deviation of
   2.9: radius 19 is more than three deviations away.)
4. *Exact check* of every candidate on its shingles, again by what comes and goes, of
   the item's own shingles only.

Texts are taken once each: copies are joined to their text's result at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.llm.shared import BLANK_CLASS, BLANKS, read_documents, stored

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 5
BITS, HALF = 64, 32
#: A side of a join is broadcast if it has at most this many rows (16 to 24 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shingle_hashes(text, size: int = SHINGLE):
    """Array of 64-bit hashes of the ``size``-word shingles (lower case, ASCII blanks); empty if there are fewer words."""
    clean = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    words = F.transform(F.split(clean, BLANK_CLASS + "+"), lambda w: F.xxhash64(w))
    return words, lambda w: F.when(F.size(w) >= size, F.transform(
        F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))
    )).otherwise(F.array().cast("array<bigint>"))


def shingled(df: DataFrame, keep: list, text_col: str, size: int) -> DataFrame:
    """``keep`` columns plus ``hs`` (shingle hashes) of every row."""
    words, grams = shingle_hashes(F.col(text_col), size)
    return df.select(*keep, words.alias("__w")).withColumn("hs", grams(F.col("__w"))).drop("__w")


def votes(g, sign):
    """32 sums of the bits of the hashes ``g``: each counts a bit of the lower half in its low 32 bits, its partner in the high ones."""
    return [F.sum(F.shiftrightunsigned(g, b).bitwiseAND(F.lit((1 << HALF) + 1)) * sign).alias(f"v{b}") for b in range(HALF)]


def majority(n):
    """The fingerprint of summed ``votes``: a bit is set if it is in over half of ``n`` hashes."""
    bits = F.lit(0).cast("long")
    for b in range(BITS):
        count = F.col(f"v{b}").bitwiseAND(F.lit((1 << HALF) - 1)) if b < HALF else F.shiftrightunsigned(F.col(f"v{b - HALF}"), HALF)
        value = (1 << b) - ((1 << BITS) if b == BITS - 1 else 0)
        bits = bits.bitwiseOR(F.when(count * 2 > n, F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return bits


def covered(starts: DataFrame, texts: DataFrame) -> DataFrame:
    """``(t1, t2, m, n, pos, h, alone)``: every place that a window starting at ``starts`` covers, once per length.

    ``alone`` says that no window holds another place of the same shingle.
    """
    before = F.lag("start").over(Window.partitionBy("t1", "t2", "m").orderBy("start"))
    parts = starts.withColumn("first", F.greatest("start", F.coalesce(before + F.col("n"), F.col("start"))))
    # (slices do not overlap, so all of them together are no longer than the text)
    places = parts.join(texts, ["t1", "t2"]).select(
        "t1", "t2", "m", "n", "first", F.posexplode(F.expr("slice(hs, first + 1, start + n - first)")).alias("at", "h")) \
        .withColumn("pos", F.col("first") + F.col("at"))
    same = Window.partitionBy("t1", "t2", "m", "h").orderBy("pos")
    near = [F.coalesce(gap < F.col("n"), F.lit(False)) for gap in (F.col("pos") - F.lag("pos").over(same), F.lead("pos").over(same) - F.col("pos"))]
    return places.select("t1", "t2", "m", "n", "pos", "h", (~(near[0] | near[1])).alias("alone"))


def changes(places: DataFrame) -> DataFrame:
    """``(t1, t2, m, n, s, h, j, sign)``: what the window gains (1) or loses (-1) when its start comes to ``s``.

    The ``j``-th copy of shingle ``h`` comes with the last place of the window that it is the ``j``-th in, and goes with the
    first place of the one it was the ``j``-th in: so the copies in a window are always numbered from 1.
    """
    keep = ["t1", "t2", "m", "n", "h"]
    gain, loss = F.col("pos") - F.col("n") + 1, F.col("pos") + 1

    def pair(s, sign):
        return F.struct(s.alias("s"), F.lit(sign).alias("sign"))

    single = places.where("alone").select(*keep, F.inline(F.array(pair(gain, 1), pair(loss, -1)))).withColumn("j", F.lit(1))
    # places are counted up to the one before the window (gain) and up to the end of the window (loss)
    same = Window.partitionBy("t1", "t2", "m", "h")
    asked = places.where("not alone").withColumn("nth", F.row_number().over(same.orderBy("pos"))).select(*keep, "nth", F.inline(F.array(
        F.struct(F.col("pos").alias("upto"), F.lit(None).cast("int").alias("s"), F.lit(0).alias("sign")),
        F.struct((F.col("pos") - F.col("n")).alias("upto"), gain.alias("s"), F.lit(1).alias("sign")),
        F.struct((F.col("pos") + F.col("n") - 1).alias("upto"), loss.alias("s"), F.lit(-1).alias("sign")))))
    seen = F.sum(F.when(F.col("sign") == 0, 1).otherwise(0)).over(same.orderBy("upto"))
    several = asked.withColumn("seen", seen).where("sign <> 0").withColumn(
        "j", F.when(F.col("sign") == 1, F.col("nth") - F.col("seen")).otherwise(F.col("seen") - F.col("nth") + 1).cast("int"))
    return single.unionByName(several.select(*single.columns))


def fingerprints(moves: DataFrame, starts: DataFrame) -> DataFrame:
    """``(t1, t2, m, n, start, fp)`` of the windows at ``starts``: running sums of the votes that come and go."""
    keys = ["t1", "t2", "m"]
    rows = moves.select(*keys, "n", "s", F.xxhash64("h", "j").alias("g"), "sign", F.lit(0).alias("asked")).unionByName(
        starts.select(*keys, "n", F.col("start").alias("s"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("sign"), F.lit(1).alias("asked")))
    # one shuffle for the sums per start and the running sums
    steps = rows.repartition(*keys).groupBy(*keys, "n", "s").agg(F.max("asked").alias("asked"), *votes(F.col("g"), F.col("sign")))
    order = Window.partitionBy(*keys).orderBy("s")
    slid = steps.select(*keys, "n", "s", "asked", *(F.sum(f"v{b}").over(order).alias(f"v{b}") for b in range(HALF)))
    return slid.where("asked = 1").select(*keys, "n", F.col("s").alias("start"), majority(F.col("n")).alias("fp"))


def shared_shingles(moves: DataFrame, candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``candidates`` (t1, t2, m, n, start, i1, i2) with ``shared``, the shingles (counting repeats) that window and item share.

    A copy of a shingle is shared if the item has as many; only places of the item's own shingles are looked at.
    """
    keys = ["t1", "t2", "m", "i1", "i2"]
    wanted = candidates.select(*keys).distinct().join(counts, ["i1", "i2", "m"])
    steps = wanted.join(moves, ["t1", "t2", "m", "h"]).where(F.col("j") <= F.col("c")) \
        .select(*keys, "n", "s", "sign", F.lit(0).alias("asked"))
    rows = steps.unionByName(candidates.select(*keys, "n", F.col("start").alias("s"), F.lit(0).alias("sign"), F.lit(1).alias("asked")))
    sums = rows.repartition(*keys).groupBy(*keys, "n", "s").agg(F.max("asked").alias("asked"), F.sum("sign").alias("step"))
    slid = sums.withColumn("shared", F.sum("step").over(Window.partitionBy(*keys).orderBy("s")))
    return slid.where("asked = 1").select(*keys, "n", F.col("s").alias("start"), "shared")


def _values(block, value, width: int, widen: int):
    """Array of (block, v) for every v within ``widen`` bits of ``value``."""
    if not widen:
        return F.array(F.struct(block.alias("k"), value.alias("v")))
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= widen)
    return F.transform(masks, lambda m: F.struct(block.alias("k"), value.bitwiseXOR(m).alias("v")))


def _blocks(fp, blocks: int, widen: int):
    """Array of (block, value) of all blocks, each with every value within ``widen`` bits."""
    out, edges = [], [BITS * k // blocks for k in range(blocks + 1)]
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        value = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << hi - lo) - 1)).cast("int")
        out.append(_values(F.lit(k), value, hi - lo, widen))
    return F.concat(*out)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY,
                       radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(t1, t2, item_id, start, n_words, similarity)``: each text (two hashes) and item it holds, best window.

    Items are searched by their text (two hashes), one row each.  Ids come last: an id with several texts gives its best
    one, and the rows without an id are one item whose id is null.
    """
    item = [F.xxhash64(item_text).alias("i1"), F.xxhash64(F.lit(1), item_text).alias("i2")]
    names = benchmark.select(F.col(item_id).cast("long").alias("item_id"), *item).distinct()
    own = benchmark.select(*item, F.col(item_text).alias("__text")).dropDuplicates(["i1", "i2"])
    # (stored first: a filter on the array, explode's own too, would split the text again for every shingle)
    hashed = stored(shingled(own, ["i1", "i2"], "__text", size), "shingles")
    items = hashed.select("i1", "i2", F.size("hs").alias("m"), F.explode("hs").alias("h"))
    items = stored(items.groupBy("i1", "i2", "m", "h").agg(F.count(F.lit(1)).cast("int").alias("c")), "items")
    marks = items.select("h", "m").distinct()
    text = [F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2")]
    source = shingled(docs, text, text_col, size)
    # (the outer form, since a filter on the array would compute the shingles again)
    places = source.select("t1", "t2", F.posexplode_outer("hs").alias("pos", "h"))
    hits = stored(places.join(_small(marks.select("h").distinct()), "h").distinct(), "hits")
    # the hashes of the texts with hits, once per text
    flagged = hits.select("t1", "t2").distinct()
    chosen = docs.select(*text, F.col(text_col).alias("__text")).join(_small(flagged), ["t1", "t2"], "left_semi") \
        .dropDuplicates(["t1", "t2"])
    chosen = stored(shingled(chosen, ["t1", "t2"], "__text", size).withColumn("size", F.size("hs")), "texts")
    # windows by their number of shingles m, clipped to the text
    starts = hits.join(marks, "h").join(chosen.select("t1", "t2", "size"), ["t1", "t2"]).select(
        "t1", "t2", "m", F.least("m", "size").alias("n"),
        F.least("pos", F.greatest(F.lit(0), F.col("size") - F.col("m"))).alias("start")).distinct()
    starts = stored(starts, "starts")
    moves = changes(stored(covered(starts, chosen.select("t1", "t2", "hs")), "places"))
    prints = stored(fingerprints(moves, starts), "prints")
    # equal fingerprints are looked up once
    looked = prints.select("m", "fp").distinct().select("m", "fp", F.inline(_blocks(F.col("fp"), blocks, 0)))
    copies = items.select("i1", "i2", "m", F.explode(F.expr("transform(sequence(1, c), j -> xxhash64(h, j))")).alias("g"))
    listed = copies.groupBy("i1", "i2", "m").agg(*votes(F.col("g"), F.lit(1))).select(
        "i1", "i2", "m", majority(F.col("m")).alias("item_fp")).select(
        "*", F.inline(_blocks(F.col("item_fp"), blocks, radius // blocks)))
    near = looked.join(listed, ["m", "k", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) \
        .select("m", "fp", "i1", "i2").distinct()
    pairs = stored(prints.join(near, ["m", "fp"]).drop("fp"), "candidates")
    scored = shared_shingles(moves, pairs, items).withColumn(
        "similarity", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
    window = F.struct("similarity", (-F.col("start")).alias("back"), (F.col("n") + size - 1).alias("n_words"))
    held = scored.where(F.col("similarity") >= similarity).groupBy("t1", "t2", "i1", "i2").agg(F.max(window).alias("best"))
    return held.join(names, ["i1", "i2"]).groupBy("t1", "t2", "item_id").agg(F.max("best").alias("best")) \
        .select("t1", "t2", "item_id", (-F.col("best.back")).alias("start"), "best.n_words", "best.similarity")


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """``(doc_id, item_id, start, n_words, similarity)``: one row per document row and item it holds.

    ``start`` and ``n_words`` give the best window (in words; the first of equal
    ones).  Null, empty and short texts, and items of fewer than ``size`` words,
    hold and match nothing.  Null ids, of items too, stay null; an id with several
    texts is found by each of them; repeated rows repeat their
    result; other columns are not read.
    """
    found = stored(contaminated_texts(docs, benchmark, text_col, **options), "contaminated")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t1"),
                      F.xxhash64(F.lit(1), text_col).alias("t2"))
    return own.join(found, ["t1", "t2"]).drop("t1", "t2")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that hold no benchmark item; null texts stay."""
    found = stored(contaminated_texts(docs, benchmark, text_col, **options).select(
        F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct(), "contaminated")
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("own1"), F.xxhash64(F.lit(1), text_col).alias("own2"))
    return own.join(_small(found), (F.col("own1") == F.col("__t1")) & (F.col("own2") == F.col("__t2")), "left_anti").select("row.*")


def op4_decontamination(spark, sf_dir):
    """doc_id, item_id, start, n_words, similarity of every benchmark item found in a document."""
    return contaminations(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
