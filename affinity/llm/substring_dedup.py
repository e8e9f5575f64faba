"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words.  Its *minimiser* is the smallest hash
among its runs of ``gram`` words; it depends on the window's words alone, so
equal windows have equal minimisers wherever they stand.  Consecutive windows
with one minimiser form a *super-k-mer*.

1. The texts are stored once, bucketed by doc_id, so no later join moves them.
2. Every document gives its distinct minimisers.  Only those found in two
   documents or more can hold a repeated window; nothing else needs to travel.
3. The super-k-mers under such a minimiser are listed by 128-bit hash.  Equal
   ones are combined into one row with their smallest doc_id, so any number of
   copies weighs as one.  Where a minimiser has one string only, all its windows
   have that doc_id.
4. Where it has several, one copy of each travels as a packed string to the
   minimiser's bucket, which sorts the windows by their words and gives every
   window the smallest doc_id that holds it.  A bucket with many different
   strings is dealt over tasks of bounded size by string; what each task found
   for a window is combined by the window's 128-bit hash, one row per task, so
   a passage in any number of different surroundings is no group of its own.
5. Per document, the windows held by a smaller doc_id cover the words that go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.shared import read_documents, small_batches, stored, stored_in_buckets

WIDTH = 50
GRAM = 8
#: Windows in one packed string at most (periodic texts have long runs of one minimiser).
RUN = 64
#: Different strings of one bucket in a task at a time.
BUCKET_STRINGS = 1024
CACHE_WORDS = 200_000
BASE = 0x9E3779B97F4A7C15 | 1


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_minimisers(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Minimiser (uint64) of every window of ``width`` words; empty if there are fewer words."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    powers = np.full(n + 1, np.uint64(BASE))
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    # sums[j] - BASE**gram * sums[j - gram] by Horner's rule, with wrap-around in 64 bits
    inverse = np.full(n + 1, np.uint64(pow(BASE, -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * inverse[:n], dtype=np.uint64, out=sums[1:])
    low = _mix((sums[gram:] - sums[:n - gram + 1]) * powers[:n - gram + 1])
    span, reach = width - gram + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[:len(low) - (span - reach)], low[span - reach:]) if span > reach else low


def super_kmers(minimisers: np.ndarray, run: int = RUN) -> list[tuple[int, int]]:
    """(first window, windows) of each stretch of windows with one minimiser, at most ``run`` long."""
    starts = np.flatnonzero(np.append(True, minimisers[1:] != minimisers[:-1])) if len(minimisers) else []
    ends = [*starts[1:], len(minimisers)]
    return [(a, min(run, b - a)) for s, b in zip(starts, ends, strict=False) for a in range(int(s), int(b), run)]


def _hashes(words: list, cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).cast("binary").alias("text"))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def bucketed(source: DataFrame) -> DataFrame:
    """Store the texts once, bucketed by doc_id: joins on doc_id then move only their other side."""
    buckets = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored_in_buckets(source.repartition(buckets, "doc_id"), "texts", buckets, ["doc_id"])[0]


def document_minimisers(source: DataFrame, width: int, gram: int) -> DataFrame:
    """Distinct ``(doc_id, h)`` of each text."""
    def run(batches):
        cache = WordHashes()
        for batch in small_batches(batches):
            found = [np.unique(window_minimisers(_hashes((t or b"").split(), cache), width, gram))
                     for t in batch.column(1).to_pylist()]
            times = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(times), _signed(np.concatenate(found) if found else np.empty(0, np.uint64))],
                names=["doc_id", "h"])

    return source.select("doc_id", "text").mapInArrow(run, "doc_id long, h long")


def listed_strings(flagged: DataFrame, width: int, gram: int) -> DataFrame:
    """``(doc_id, text_key, at, n, h, k1, k2)``: super-k-mers under the minimisers ``hs`` of each text, by hash."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "text_key", "at", "n", "h", "k1", "k2"]

    def run(batches):
        cache = WordHashes()
        for batch in small_batches(batches):
            for doc, key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or b"").split()
                low = window_minimisers(_hashes(words, cache), width, gram).view(np.int64)
                wanted = set(wanted)
                rows = []
                for a, n in super_kmers(low):
                    if int(low[a]) in wanted:
                        digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words[a:a + n + width - 1])), "<i8")
                        rows.append((doc, key, a, n, int(low[a]), int(digest[0]), int(digest[1])))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return flagged.mapInArrow(run, "doc_id long, text_key long, at long, n long, h long, k1 long, k2 long")


def packed_strings(chosen: DataFrame, width: int) -> DataFrame:
    """``(h, k1, k2, packed, low, n)``: the strings listed in ``parts`` of each text; low is its doc_id."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = ["h", "k1", "k2", "packed", "low", "n"]

    def run(batches):
        for batch in small_batches(batches):
            for doc, key, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or b"").split()
                rows = [(p["h"], p["k1"], p["k2"], b" ".join(words[p["at"]:p["at"] + p["n"] + width - 1]), doc, p["strings"])
                        for p in parts if p["text_key"] == key]
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[k:k + 4096], strict=True), kinds, strict=True)], names=names)

    return chosen.mapInArrow(run, "h long, k1 long, k2 long, packed binary, low long, n long")


def _word_bounds(packed: bytes) -> tuple[list[int], list[int]]:
    blanks = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
    return [0, *(b + 1 for b in blanks)], [*blanks, len(packed)]


def _tasks(strings: DataFrame, bucket_strings: int) -> DataFrame:
    """Strings with ``parts``, the tasks of their bucket, and their own ``part``: equal ones once, about ``bucket_strings`` in each."""
    parts = F.ceil(F.col("n") / bucket_strings)
    return strings.select("h", F.pmod("k1", parts).alias("part"), parts.alias("parts"), "k1", "k2", "packed", "low")


def sorted_window_lows(strings: list[bytes], lows: list[int], width: int) -> list[list[int]]:
    """Per string, the smallest of ``lows`` among the strings that hold each of its windows (windows sorted)."""
    windows, owner = [], []
    for s, packed in enumerate(strings):
        begin, end = _word_bounds(packed)
        for j in range(len(begin) - width + 1):
            windows.append(packed[begin[j]:end[j + width - 1]])
            owner.append(s)
    order = sorted(range(len(windows)), key=windows.__getitem__)
    best = [0] * len(windows)
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and windows[order[stop]] == windows[order[at]]:
            stop += 1
        low = min(lows[owner[k]] for k in order[at:stop])
        for k in order[at:stop]:
            best[k] = low
        at = stop
    out: list[list[int]] = [[] for _ in strings]
    for s, low in zip(owner, best, strict=True):
        out[s].append(low)
    return out


def _window_hashes(packed: bytes, width: int) -> np.ndarray:
    """128-bit hashes of the windows of a string, one row of two numbers per window."""
    begin, end = _word_bounds(packed)
    digests = [xxhash.xxh3_128_digest(packed[begin[j]:end[j + width - 1]]) for j in range(len(begin) - width + 1)]
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def window_lows(tasks: DataFrame, width: int) -> DataFrame:
    """``(h, part, k1, k2, lows, w1, w2)``: the smallest doc_id of its task holding each window of a string.

    The windows' hashes are given where the bucket has several tasks, else they are empty.
    """
    ordered = tasks.repartition("h", "part").sortWithinPartitions("h", "part")
    names = ["h", "part", "k1", "k2", "lows", "w1", "w2"]
    lists = pa.list_(pa.int64())

    def solve(rows):
        lows = sorted_window_lows([r[5] for r in rows], [r[6] for r in rows], width)
        hashes = [_window_hashes(r[5], width) if r[2] > 1 else np.empty((0, 2), np.int64) for r in rows]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 3, 4)), pa.array(lows, lists),
             pa.array([w[:, 0] for w in hashes], lists), pa.array([w[:, 1] for w in hashes], lists)], names=names)

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[-1][:2]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return ordered.mapInArrow(run, "h long, part long, k1 long, k2 long, lows array<bigint>, w1 array<bigint>, w2 array<bigint>")


def _distinct_windows(held: DataFrame) -> DataFrame:
    """``(h, part, w1, w2, low)`` of the windows of the strings, copies in a batch once."""
    keys = ["h", "part", "w1", "w2"]

    def run(batches):
        for batch in batches:
            h, part, low, w1, w2 = batch.columns
            times = pa.array(np.repeat(np.arange(batch.num_rows), low.value_lengths().to_numpy()))
            cells = pa.table([h.take(times), part.take(times), w1.flatten(), w2.flatten(), low.flatten()], names=[*keys, "low"])
            once = cells.group_by(keys).aggregate([("low", "min")])
            yield from once.select([*keys, "low_min"]).rename_columns([*keys, "low"]).to_batches()

    return held.select("h", "part", "lows", "w1", "w2").mapInArrow(run, "h long, part long, w1 long, w2 long, low long")


def lows_over_tasks(held: DataFrame) -> DataFrame:
    """``(k1, k2, lows)`` of the strings of buckets with several tasks, ``lows`` over the whole bucket.

    A window has one low per task, so its minimum is over as many rows as the
    bucket has tasks at most; it goes back to a task once, for all its strings.
    """
    partial = _distinct_windows(held).groupBy("h", "part", "w1", "w2").agg(F.min("low").alias("low"))
    whole = partial.groupBy("h", "w1", "w2").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most")
    lower = partial.join(whole, ["h", "w1", "w2"]).where("least < low").select("h", "part", "w1", "w2", "least")

    def combine(_, strings: pa.Table, lower: pa.Table) -> pa.Table:
        w1, w2, least = (lower[c].to_pylist() for c in ("w1", "w2", "least"))
        best = dict(zip(zip(w1, w2, strict=True), least, strict=True))
        lows = [[best.get((a, b), low) for low, a, b in zip(*row, strict=True)]
                for row in zip(*(strings[c].to_pylist() for c in ("lows", "w1", "w2")), strict=True)]
        return pa.table([strings["k1"], strings["k2"], pa.array(lows, pa.list_(pa.int64()))], names=["k1", "k2", "lows"])

    keys = ["h", "part"]
    return held.groupBy(*keys).cogroup(lower.groupBy(*keys)).applyInArrow(combine, "k1 long, k2 long, lows array<bigint>")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                     gram: int = GRAM, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row of ``docs``; ``kept`` is the remaining words, space-joined.

    A word goes if a window covering it also starts in a document with a smaller
    doc_id; windows are those of the input.  Null and empty texts have no words.
    Rows with a null id keep all words and remove none elsewhere; repeated rows
    are treated alike.  Other columns are not read.
    """
    source = _source(docs, id_col, text_col)
    texts = bucketed(source.where("doc_id is not null"))
    listed = stored(document_minimisers(texts, width, gram), "minimisers")
    shared = listed.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    wanted = listed.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    flagged = texts.join(wanted, "doc_id").select("doc_id", "text_key", "text", "hs")
    found = stored(listed_strings(flagged, width, gram), "superkmers")
    first = F.min(F.struct("doc_id", "text_key", "at", "n")).alias("first")
    strings = stored(found.groupBy("h", "k1", "k2").agg(first), "strings")
    sizes = strings.groupBy("h").agg(F.count(F.lit(1)).alias("strings"))
    sized = stored(strings.join(sizes, "h"), "sized")
    parts = sized.where("strings > 1").select("first.*", "h", "k1", "k2", "strings") \
        .groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "at", "n", "h", "k1", "k2", "strings")).alias("parts"))
    packed = packed_strings(texts.join(parts, "doc_id").select("doc_id", "text_key", "text", "parts"), width)
    alone = sized.where("strings = 1").select(
        "k1", "k2", F.array_repeat(F.col("first.doc_id"), F.col("first.n").cast("int")).alias("lows"))
    held = stored(window_lows(_tasks(packed, bucket_strings), width), "windows")
    several = F.size("w1") > 0
    lows = alone.unionByName(held.where(~several).select("k1", "k2", "lows")).unionByName(lows_over_tasks(held.where(several)))
    marks = found.select("doc_id", "text_key", "at", "k1", "k2").distinct().join(lows, ["k1", "k2"]) \
        .where(F.array_min("lows") < F.col("doc_id")) \
        .groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "at", "lows")).alias("marks"))
    bare = source.where("doc_id is null").withColumn("marks", F.lit(None).cast(dict(marks.dtypes)["marks"]))
    both = [texts.join(marks, "doc_id", "left").select("doc_id", "text_key", "text", "marks"), bare]

    def run(batches):
        for batch in small_batches(batches):
            counts, gone, kept = [], [], []
            for doc, key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or b"").split()
                cover = np.zeros(len(words) + 1, np.int32)
                for span in spans or ():
                    if span["text_key"] != key:
                        continue
                    starts = span["at"] + np.flatnonzero(np.array(span["lows"]) < doc)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + width, -1)
                drop = np.cumsum(cover[:-1]) > 0
                counts.append(len(words))
                gone.append(int(drop.sum()))
                kept.append(b" ".join(words if not gone[-1] else [w for w, d in zip(words, drop, strict=True) if not d]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    whole, rest = (part.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string") for part in both)
    return whole.unionByName(rest)


def op10_substring_dedup(spark, sf_dir):
    """Contract query: doc_id, n_words, n_removed, kept_sha256."""
    result = dedup_substrings(read_documents(spark, sf_dir))
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
