"""Language-model scores from a weighted backoff automaton over smoothed word n-grams.

States are histories of up to ``order - 1`` tokens that training has seen (a text
begins in the state of its start) and the root, the empty history.  From state ``h``
the arc of token ``w`` exists if ``hw`` was seen; it weighs
``log10((1 - b) * c(hw) / c(h) + b * p(w | h'))`` and leads to the longest seen
history that ends ``hw``.  Else the failure arc of ``h`` weighs ``log10(b)`` and leads to ``h'``,
``h`` without its first token; at the root every token has an arc of
``log10 p(w)``, ``p(w) = (c(w) + a) / (N + a(V + 1))``.  ``b`` is the share of a
history's mass that new successors take; by Heaps' law a history seen ``c`` times has
about ``k * c**g`` different successors, so ``b = k / (k + c**(1 - g))``.  For every history the
probabilities of all words and the unknown word sum to 1.  Each text is read once, left to
right, with its state; all texts of a block walk side by side.

The automaton grows with the corpus, so no task holds it whole:

1. Rows are dealt by number into blocks of bounded size (equal rows lie apart), read into tokens
   and stored, in a bounded number of buckets.
2. Every block lists its different n-grams with their training counts, as packed
   lists in order of their hashes, one per part of the hash space.
3. Every part adds up the lists of all blocks and answers each block with the
   totals of what it listed: one number per n-gram, whatever its count.  There are
   at most ``FAN`` parts.  If they would not fit a task, the lists of ``FAN`` blocks are merged
   into the list of a joint source, which is cut again by the next bits, and the answers
   travel back the same way.  The number of lists so grows in proportion to the corpus.
4. Every block builds its piece of the automaton from the answers and walks its
   texts through it.

The lists are larger than the corpus, so steps 2 and 3 run in rounds, each over its
share of the parts: a round lists what falls to its parts, stores the answers, and its
lists leave the disk before the next begins.
"""

from __future__ import annotations

import collections
import functools
import itertools
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.shared import drop_folder, read_documents, shuffles_dropped, stored, stored_in_buckets

#: Longest n-gram.
ORDER = 3
#: Added to every count of the unigram level.
PRIOR = 0.1
#: Heaps' law of a history's successors (see above).
SUCCESSORS, GROWTH = 2.0, 0.8
#: Text of a block; n-grams of one part, of which a task holds one length in memory; parts of one cut; buckets of the stored texts.
BLOCK_BYTES = 4 << 20
PART_ENTRIES = 8_000_000
FAN = 4096
BUCKETS = 20_000
#: Rounds over the hash space for each time that lists are cut (joint lists are stored beside those they are made of).
ROUNDS = 3
START, END = 0, 1

_TOKENS = "block long, held_out boolean, doc_id long, tokens binary, words binary"
_LISTS = "source long, kind int, part long, keys binary, counts binary"
_ANSWERS = "source long, kind int, part long, totals binary, different long, tokens long"


# ------------------------------------------------------------------ n-grams of a block

def _read_tokens(texts: list) -> tuple[list, np.ndarray]:
    """The tokens of each text, numbered through all texts, and the hash of each token."""
    ids = collections.defaultdict(itertools.count(END + 1).__next__)
    lines = []
    for text in texts:
        words = (text or b"").lower().split()
        lines.append(np.fromiter(itertools.chain(map(ids.__getitem__, words), (END,)), "<i4", len(words) + 1))
    first = np.empty(len(ids) + 2, np.uint64)
    first[START], first[END] = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b"\n\n")  # words hold no line ends
    first[2:] = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    return lines, first


def tokenized(texts: DataFrame) -> DataFrame:
    """The rows of each block with their tokens for their text; one row of a block has the hashes of its tokens."""
    def run(table: pa.Table) -> pa.Table:
        lines, first = _read_tokens(table["text"].to_pylist())
        words = [first.astype("<u8").tobytes(), *[None] * (len(lines) - 1)]
        return _rows([*(table[c].combine_chunks() for c in ("block", "held_out", "doc_id")), [x.tobytes() for x in lines], words], _TOKENS)

    return texts.select("block", "held_out", "doc_id", "text").groupBy("block").applyInArrow(run, _TOKENS)


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block's rows one after the other, how many each row has, and the hash of each token."""
    sizes = pc.binary_length(table["tokens"]).to_numpy() // 4
    tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), "<i4").astype(np.int64)
    return tokens, sizes.astype(np.int64), np.frombuffer(table["words"].drop_null()[0].as_py(), "<u8")


def _longer(history: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams from those of their histories and of their last tokens."""
    mixed = history * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(n)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def hashes(tokens: np.ndarray, starts: np.ndarray, first: np.ndarray, order: int):
    """For each length n, the positions where an n-gram ends, and its hash there."""
    at_start = np.zeros(len(tokens), bool)
    at_start[starts] = True
    own = first[tokens]
    here, ends = own, np.ones(len(tokens), bool)
    yield 1, np.arange(len(tokens)), own
    for n in range(2, order + 1):
        history = np.empty_like(own)
        history[1:], history[at_start] = here[:-1], first[START]
        if n > 2:
            ends = np.append(False, ends[:-1]) & ~at_start
        here = _longer(history, own, n)
        where = np.flatnonzero(ends)
        yield n, where, here[where]


class Grams:
    """The n-grams of some texts: per length n, which one ends at each position, its history and its suffix."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, first: np.ndarray, order: int):
        self.tokens, self.starts = tokens, starts
        # place[n]: index of the n-gram that ends at a position, -1 where the text is too short;
        # history[n], suffix[n]: index of the (n-1)-gram before the last token, and of the one without the first token
        self.place, self.hash = {1: self.tokens}, {1: first}
        self.history: dict = {}
        self.suffix: dict = {}
        at_start = np.zeros(len(self.tokens), bool)
        at_start[self.starts] = True
        for n in range(2, order + 1):
            before = np.empty_like(self.tokens)
            before[0], before[1:] = -1, self.place[n - 1][:-1]
            before[at_start] = START if n == 2 else -1
            ok = np.flatnonzero(before >= 0)
            pairs, where, inverse = np.unique(before[ok] << 32 | self.tokens[ok], return_index=True, return_inverse=True)
            place = np.full(len(self.tokens), -1, np.int64)
            place[ok] = inverse
            self.place[n], self.hash[n] = place, _longer(self.hash[n - 1][pairs >> 32], first[pairs & 0xFFFFFFFF], n)
            self.history[n], self.suffix[n] = pairs >> 32, self.place[n - 1][ok[where]]


class Automaton:
    """A block's piece of the automaton: states, arcs with weights, failure arcs with weights."""

    def __init__(self, grams: Grams, totals: dict[int, np.ndarray], order: int, root: np.ndarray, successors: float, growth: float):
        self.grams, self.order = grams, order
        seen = dict(totals)
        seen[1] = totals[1].copy()
        seen[1][START] = seen[1][END]  # every training text has one start and one end
        #: Per length of history: is it a state, and what its failure arc weighs; it leads to the history's suffix.
        self.state = {m: seen[m] > 0 for m in range(1, order)}
        self.failure = {}
        #: Per n-gram: is there an arc from its history, and its weight.  value: weight of the walk from the history.
        self.arc, value = {}, {1: root}
        for n in range(2, order + 1):
            m = n - 1
            known = np.maximum(seen[m], 1).astype(np.float64)
            back = successors / (successors + known ** (1 - growth))
            self.failure[m] = np.where(self.state[m], np.log10(back), 0.0)  # a history that is no state weighs nothing
            history = grams.history[n]
            self.arc[n] = totals[n] > 0
            lower = value[m][grams.suffix[n]]
            share = back[history]
            weight = np.log10((1 - share) * totals[n] / known[history] + share * 10.0 ** lower)
            value[n] = np.where(self.arc[n], weight, self.failure[m][history] + lower)
        self.value = value

    def walk(self) -> np.ndarray:
        """Weight that the walk takes on at each token: the arc of its state, or failure arcs and the first arc below."""
        out = self.value[1][self.grams.tokens]
        for n in range(2, self.order + 1):
            place = self.grams.place[n]
            out = np.where(place >= 0, self.value[n][place], out)
        return out


# ------------------------------------------------------------------ lists and answers

def _cut(keys: np.ndarray, parts: int, shift: int) -> np.ndarray:
    """Part of each key by the bits below ``shift``."""
    bits = (keys << np.uint64(64 - shift)) >> np.uint64(32) if shift < 64 else keys >> np.uint64(32)
    return ((bits * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _ordered(keys: np.ndarray, parts: int, shift: int):
    """Keys in order of part, and the bounds of the parts."""
    part = _cut(keys, parts, shift)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _packed(keys: np.ndarray, width: int) -> np.ndarray:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def _numbers(counts: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte and as many bytes each as the largest takes, which stand first."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _read_numbers(raw: bytes) -> np.ndarray:
    wide = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    wide[:, :raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T
    return wide.view("<i8").ravel()


def _summed(place: np.ndarray, counts, size: int) -> np.ndarray:
    """Counts summed by place (in doubles, exact to 2**53)."""
    return np.bincount(place, np.concatenate([_read_numbers(raw.as_py()) for raw in counts]), size).astype(np.int64)


def _rows(columns: list, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for c, (name, kind) in zip(columns, fields, strict=True)})


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, the different keys in it, their summed counts, and how often each occurs."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1])[:len(keys)])
    sums = np.add.reduceat(counts[order], new) if len(new) else np.zeros(0, np.int64)
    return order, keys[new], sums, np.diff(np.append(new, len(keys)))


def listings(texts: DataFrame, order: int, parts: int, width: int, low: int, high: int) -> DataFrame:
    """``(source, kind, part, keys, counts)``: what each block holds of the parts from ``low`` to ``high``, in order of hash."""
    def run(table: pa.Table) -> pa.Table:
        source = table["block"][0].as_py()
        tokens, sizes, first = _block(table)
        train = np.repeat(~table["held_out"].to_numpy(), sizes).astype(np.int64)
        out = []
        for n, where, found in hashes(tokens, np.cumsum(sizes) - sizes, first, order):
            part = _cut(found, parts, 64)
            mine = (part >= low) & (part < high)
            _, found, sums, _ = _added(found[mine], train[where[mine]])
            bounds = np.searchsorted(_cut(found, parts, 64), np.arange(low, high + 1))
            raw = _packed(found, width)
            out += [(source, n, k, raw[a:b].tobytes(), _numbers(sums[a:b]))
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False), low) if a < b]
        return _rows(list(zip(*out, strict=True)) or [[]] * 5, _LISTS)

    return texts.select("block", "held_out", "tokens", "words").groupBy("block").applyInArrow(run, _LISTS)


def totals(lists: DataFrame, width: int) -> DataFrame:
    """Answers ``(source, kind, part, totals, different, tokens)``; ``different`` and ``tokens`` stand on one answer of a part."""
    def run(table: pa.Table) -> pa.Table:
        raw = table["keys"].to_pylist()
        bounds = np.cumsum([0, *map(len, raw)]) // width
        keys = _unpacked(b"".join(raw), width)
        del raw
        order, _, sums, times = _added(keys, np.concatenate([_read_numbers(c.as_py()) for c in table["counts"]]))
        filled = np.empty(len(keys), np.int64)
        filled[order] = np.repeat(sums, times)
        first = np.arange(table.num_rows) == 0
        return _rows([table["source"].to_pylist(), table["kind"].to_pylist(), table["part"].to_pylist(),
                      [_numbers(filled[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)],
                      np.where(first, (sums > 0).sum(), 0), np.where(first, sums.sum(), 0)], _ANSWERS)

    return lists.groupBy("kind", "part").applyInArrow(run, _ANSWERS)


def answered(lists: DataFrame, cuts: list[int], width: int, fan: int, folder: str, bits: int = 64) -> DataFrame:
    """Answers to lists that were cut into ``cuts[0]`` parts; further cuts are made of joint lists, stored in ``folder``."""
    if len(cuts) == 1:
        return totals(lists, width)
    bits -= math.ceil(math.log2(cuts[0]))
    grouped = lists.withColumn("joint", F.floor(F.col("source") / fan).cast("long"))

    def merge(table: pa.Table):
        """Members of a joint list in order, their different keys, and each member's places among these."""
        table = table.sort_by([("source", "ascending")])
        keys = [_unpacked(raw, width) for raw in table["keys"].to_pylist()]
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        order, bounds = _ordered(found, cuts[1], bits)
        return table, np.cumsum([0, *map(len, keys)]), found[order], np.argsort(order)[place], bounds

    def join(table: pa.Table) -> pa.Table:
        joint, kind, upper = table["joint"][0].as_py(), table["kind"][0].as_py(), table["part"][0].as_py()
        table, ends, found, place, bounds = merge(table)
        sums = _summed(place, table["counts"], len(found))
        raw = _packed(found, width)
        out = [(joint, kind, upper * cuts[1] + k, raw[a:b].tobytes(), _numbers(sums[a:b]))
               for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
        return _rows(list(zip(*out, strict=True)), _LISTS)

    def part(_, table: pa.Table, replies: pa.Table) -> pa.Table:
        table, ends, found, place, bounds = merge(table)
        filled = np.zeros(len(found), np.int64)
        for k, raw in zip(replies["part"].to_pylist(), replies["totals"], strict=True):
            k %= cuts[1]
            filled[bounds[k]:bounds[k + 1]] = _read_numbers(raw.as_py())
        first = np.arange(table.num_rows) == 0
        return _rows([table["source"].to_pylist(), table["kind"].to_pylist(), table["part"].to_pylist(),
                      [_numbers(filled[place[a:b]]) for a, b in zip(ends, ends[1:], strict=False)],
                      *(np.where(first, sum(replies[c].to_pylist()), 0) for c in ("different", "tokens"))], _ANSWERS)

    merged = stored(grouped.groupBy("kind", "part", "joint").applyInArrow(join, _LISTS), f"{folder}/lists")
    below = answered(merged, cuts[1:], width, fan, folder, bits)
    below = below.withColumnRenamed("source", "joint").withColumn("upper", F.floor(F.col("part") / cuts[1]).cast("long"))
    return grouped.groupBy("kind", "part", "joint").cogroup(below.groupBy("kind", "upper", "joint")).applyInArrow(part, _ANSWERS)


def cuts_for(entries: int, fan: int, limit: int) -> list[int]:
    """Numbers of parts, cut after cut, so that the last parts hold about ``limit`` of the entries."""
    parts, cuts = max(1, math.ceil(entries / limit)), []
    while parts > fan:
        cuts.append(fan)
        parts = math.ceil(parts / fan)
    return [*cuts, parts]


# ------------------------------------------------------------------ scores

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(texts: DataFrame, answers: DataFrame, order: int, tokens_seen: int, words_seen: int, prior: float,
           successors: float, growth: float) -> DataFrame:
    """Scores of every text of a block from the block's piece of the automaton."""
    norm = tokens_seen + prior * (words_seen + 1)

    def run(_, table: pa.Table, replies: pa.Table) -> pa.Table:
        tokens, sizes, first = _block(table)
        grams = Grams(tokens, np.cumsum(sizes) - sizes, first, order)
        counted = {}
        replies = replies.sort_by([("kind", "ascending"), ("part", "ascending")])  # so the totals of a kind stand in order of hash
        kinds = replies["kind"].to_numpy()
        for n in range(1, order + 1):
            found, place = np.unique(grams.hash[n][START + 1 if n == 1 else 0:], return_inverse=True)  # the start is no token
            a, b = np.searchsorted(kinds, [n, n + 1])
            filled = np.concatenate([np.zeros(0, np.int64), *(_read_numbers(raw.as_py()) for raw in replies["totals"].slice(a, b - a))])
            if len(filled) != len(found):
                raise ValueError(f"{len(filled)} totals of {len(found)} n-grams of length {n}")
            counted[n] = filled[place]
        counted[1] = np.append(0, counted[1])
        root = np.log10((counted[1] + prior) / norm)
        walked = Automaton(grams, counted, order, root, successors, growth).walk()
        seen = (counted[1][grams.tokens] > 0).astype(np.int64)
        return _rows([table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), sizes, np.add.reduceat(seen, grams.starts),
                      np.full(len(sizes), tokens_seen), np.add.reduceat(root[grams.tokens], grams.starts),
                      np.add.reduceat(walked, grams.starts)], _SCORES)

    replies = answers.select(F.col("source").alias("block"), "kind", "part", "totals")
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _SCORES)


def held_out(id_col):
    """Documents kept out of training: crc32 of the id as text, modulo 10, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES,
                prior: float = PRIOR, successors: float = SUCCESSORS, growth: float = GROWTH, fan: int = FAN,
                part_entries: int = PART_ENTRIES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    A null or empty text is one end token.  Rows with a null id are training
    texts.  Repeated rows count and are scored each.  ``base_score`` is the root's
    score alone.  An empty table gives no rows.  Other columns are not read.  Rows are
    numbered as they are read, so ``docs`` should come from files or another stored table.
    A text longer than ``block_bytes`` is a block of its own with those that share its number.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    row = F.monotonically_increasing_id()
    numbered = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                           F.col(text_col).cast("binary").alias("text"), row.alias("row"))
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    buckets = min(blocks, BUCKETS)
    with shuffles_dropped(docs.sparkSession):
        texts, _ = stored_in_buckets(tokenized(dealt.repartition(buckets, "block")), "blocks", buckets, ["block"])
        answers, seen = _all_answers(texts, order, cuts_for(order * size // 5, fan, part_entries), fan)  # a token is five bytes or more with its blank, mostly
    return scored(texts, answers, order, seen[0] or 0, seen[1] or 0, prior, successors, growth)


def _all_answers(texts: DataFrame, order: int, cuts: list[int], fan: int) -> tuple[DataFrame, tuple]:
    """The answers to all blocks, made in rounds, and the numbers of training tokens and of different ones."""
    parts = cuts[0]
    width = 8 if len(cuts) > 1 and parts < 256 else 7  # bytes listed of a hash; its parts stand for the other
    rounds = min(parts, ROUNDS * len(cuts))
    bounds = [parts * r // rounds for r in range(rounds + 1)]
    made = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        folder = f"round-{uuid.uuid4().hex}"
        lists = listings(texts, order, parts, width, low, high)
        if len(cuts) > 1:
            lists = stored(lists, f"{folder}/lists")
        made.append(stored(answered(lists, cuts, width, fan, folder), "totals"))
        drop_folder(texts.sparkSession, folder)
    answers = functools.reduce(DataFrame.unionByName, made)
    return answers, answers.where(F.col("kind") == 1).agg(F.sum("tokens"), F.sum("different")).first()


def op2_lm_scoring(spark, sf_dir):
    """Contract query: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_texts(read_documents(spark, sf_dir))
