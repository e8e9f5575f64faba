"""Operators against plain Python on the smallest driver table and on planted cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from affinity.llm import decontamination, line_dedup, lm_scoring, nearest, packing, personal_data, personal_forms, quality, sharding, simhash_dedup, substring_dedup
from affinity.llm.shared import components
from affinity.session import checkpoint_dir
from tests.conftest import SF_CHECK, SF_SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ------------------------------------------------------------------ SimHash

def _fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, texts):
    got = simhash_dedup.op1_simhash_dedup(spark, SF_SMALL).collect()
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = _roots(ids, links)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


@pytest.mark.parametrize("radius,piece", [(3, 512), (3, 4), (0, 512), (5, 16), (7, 512)])
def test_bit_sliced_links_find_every_component(spark, radius, piece):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):  # chains of near ones, and a dense group
        for _ in range(4):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 2)))
            prints.add(p)
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash_dedup.fingerprint_links(df, radius, piece)
    got = _roots(signed, [tuple(r) for r in links.collect()])
    every = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    assert got == _roots(signed, every)
    assert links.count() <= (radius + 1) ** 2 * len(signed)  # forests, never all pairs


def test_groups_that_share_their_smallest_id_keep_a_row_each(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(5, "quite another text of its own"), (5, near), (9, near.upper()), (None, "no id here at all"), (None, "NO id here at all")]
    kept = simhash_dedup.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == [(0, "no id here at all"), (5, "quite another text of its own"), (5, near)]


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(5000, 5000)]
    links += [(9000, 9001 + k) for k in range(500)]  # a hub
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    expected = _roots({n for e in links for n in e}, links)
    assert got == {n: r for n, r in expected.items() if n != 5000}


# ------------------------------------------------------------------ language model

def test_lm_scores(spark, texts):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.op2_lm_scoring(spark, SF_SMALL).collect()}
    # many blocks; and lists that are cut three times, of four blocks at a time
    small = {r.doc_id: r for r in lm_scoring.score_texts(docs, block_bytes=40_000).collect()}
    cuts = lm_scoring.cuts_for(3 * docs.agg(F.sum(F.octet_length("text"))).first()[0] // 5, 4, 10_000)
    assert len(cuts) == 3
    deep = {r.doc_id: r for r in lm_scoring.score_texts(docs, block_bytes=40_000, fan=4, part_entries=10_000).collect()}
    pairs_only = {r.doc_id: r for r in lm_scoring.score_texts(docs, order=2).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    grams = Counter()
    for i, line in tokens.items():
        if not out[i]:
            line = ["<", *line]
            for n in (1, 2, 3):
                grams.update(tuple(line[k:k + n]) for k in range(len(line) - n + 1))
    texts_seen = grams.pop(("<",))
    total, different = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    k, g = lm_scoring.SUCCESSORS, lm_scoring.GROWTH

    def prob(history, w):
        """Probability of a token after a history of up to two."""
        if not history:
            return (grams[w,] + 0.1) / (total + 0.1 * (different + 1))
        c = texts_seen if history == ("<",) else grams[history]
        lower = prob(history[1:], w)
        if not c:
            return lower
        back = k / (k + c ** (1 - g))
        return (1 - back) * grams[*history, w] / c + back * lower

    sums = Counter()
    for i, line in tokens.items():
        seen = ["<", *line]
        base = sum(math.log10(prob((), w)) for w in line)
        score = sum(math.log10(prob(tuple(seen[max(0, at - 1):at + 1]), w)) for at, w in enumerate(line))
        two = sum(math.log10(prob(tuple(seen[at:at + 1]), w)) for at, w in enumerate(line))
        for r, want in ((got[i], score), (small[i], score), (deep[i], score), (pairs_only[i], two)):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(line), sum(grams[w,] > 0 for w in line), total)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(want, rel=1e-9)
        if out[i]:
            sums.update({"base": base, "two": two, "three": score})
    assert sums["two"] > sums["base"] and sums["three"] > sums["base"]


def test_repeated_rows_and_very_frequent_tokens(spark):
    """A row repeated on most of the table lies in many blocks; its copies count and are scored alike."""
    rows = spark.range(30_000).select((F.col("id") % 3 + 1).alias("doc_id"), F.lit("same words again").alias("text")).unionByName(
        spark.createDataFrame([(50, "other words")], "doc_id long, text string"))
    got = lm_scoring.score_texts(rows, block_bytes=20_000).collect()
    assert Counter(r.doc_id for r in got) == {1: 10_000, 2: 10_000, 3: 10_000, 50: 1}
    assert len({(r.score, r.base_score, r.n_tokens, r.train_tokens) for r in got if r.doc_id in (1, 2, 3)}) == 1


def _left_on_disk(spark):
    """Bytes of the shuffle files, and of each kind of stored table."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = [f for top in manager.localDirsString() for f in Path(top).rglob("shuffle_*")]
    shared = Path(checkpoint_dir(spark).removeprefix("file:"))
    kinds = Counter()
    for f in shared.rglob("part-*"):
        kinds[re.split("[-_]", f.relative_to(shared).parts[0])[0]] += f.stat().st_size
    return sum(f.stat().st_size for f in files if f.exists()), kinds


def test_lm_lists_leave_the_disk(spark):
    """Lists, cut once into more parts than a byte numbers or cut three times, are listed in rounds; none stays when all are answered."""
    rng = random.Random(5)
    words = [f"word{k}" for k in range(300)]
    rows = [(i, " ".join(words[int(300 * rng.random() ** 3)] for _ in range(rng.randint(0, 150)))) for i in range(800)]
    docs = spark.createDataFrame([*rows, (800, None), (801, rows[7][1])], "doc_id long, text string")
    entries = 3 * sum(len(t) + 1 for _, t in rows) // 5
    want = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    for cut in ({"part_entries": entries // 300}, {"part_entries": entries // 60, "fan": 4}):
        spark.sparkContext._jvm.System.gc()
        shuffled, kinds = _left_on_disk(spark)
        scores = lm_scoring.score_texts(docs, block_bytes=40_000, **cut)
        for _ in range(50):
            now, made = _left_on_disk(spark)
            if now < shuffled + 10_000:  # the rows of sums
                break
            time.sleep(0.2)
        assert now < shuffled + 10_000
        assert {k for k in made if made[k] > kinds[k]} == {"blocks", "totals"}
        got = {r.doc_id: r for r in scores.collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert r[:5] == want[i][:5] and r[5:] == pytest.approx(want[i][5:], rel=1e-12)


@pytest.mark.parametrize("counts", [[], [0], [0, 255], [256, 1], [2 ** 32, 7, 0], [2 ** 62, 2 ** 40 + 1, 3]])
def test_lm_numbers_take_the_bytes_they_need(counts):
    raw = lm_scoring._numbers(np.array(counts, np.int64))
    assert lm_scoring._read_numbers(raw).tolist() == counts
    assert len(raw) == 1 + len(counts) * max(1, math.ceil(max(counts, default=0).bit_length() / 8))


@pytest.mark.parametrize(("cuts", "most"), [([40], 3), ([2], 2), ([1], 1), ([4, 4], 6)])
def test_lm_rounds_share_the_parts(spark, monkeypatch, cuts, most):
    """Every part is listed in one round; no round but that of a single part lists them all."""
    asked, texts = [], spark.createDataFrame([(0, False, b"", b"")], "block long, held_out boolean, tokens binary, words binary")
    none = spark.createDataFrame([], lm_scoring._ANSWERS)
    monkeypatch.setattr(lm_scoring, "listings", lambda texts, order, parts, width, low, high: asked.append((low, high)) or none)
    monkeypatch.setattr(lm_scoring, "answered", lambda lists, *rest: none)
    lm_scoring._all_answers(texts, 3, cuts, 4)
    assert len(asked) == min(most, cuts[0])
    assert [p for low, high in asked for p in range(low, high)] == list(range(cuts[0]))
    assert max(high - low for low, high in asked) <= math.ceil(cuts[0] / len(asked))


def test_probabilities_of_a_history_sum_to_one(spark):
    # Texts of one unseen word after a history leave the root's weights; every known word, the end and one unknown
    # word are tried after "a", with the end read off a text that stops there.
    train = {1: "a b a c", 2: "b a", 3: "a a b"}
    ids = [i for i in range(100, 10_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    known = ["a", "b", "c"]
    probes = ["", "a", "zz", *(f"a {w}" for w in [*known, "zz"]), *known]
    rows = spark.createDataFrame([*train.items(), *zip(ids, probes, strict=False)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm_scoring.score_texts(rows, order=2).where("held_out").collect()}
    value = {t: 10 ** score[i] for i, t in zip(ids, probes, strict=False)}
    # end(w) = P(end | w), first(w) = P(w | start): value[w] = first(w) * end(w); value["a w"] = first(a) * P(w | a) * end(w)
    k, g = lm_scoring.SUCCESSORS, lm_scoring.GROWTH
    words, pairs = Counter(), Counter()
    for text in train.values():
        line = [*text.split(), None]
        words.update(line)
        pairs.update(zip(["<"] + line[:-1], line, strict=True))
    total, different = sum(words.values()), len(words)

    def end(w):
        p = (words[None] + 0.1) / (total + 0.1 * (different + 1))
        back = k / (k + words[w] ** (1 - g)) if words[w] else 1
        return (1 - back) * pairs[w, None] / max(1, words[w]) + back * p

    first = value["a"] / end("a")
    after = [value[f"a {w}"] / first / end(w) for w in [*known, "zz"]] + [end("a")]
    assert sum(after) == pytest.approx(1)


# ------------------------------------------------------------------ sharding

def test_shards(spark, texts):
    got = sharding.op3_sharding(spark, SF_CHECK).collect()
    assert len({r.doc_id for r in got}) == len(got) == 1000
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_keep_whole_records_and_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = sharding.shuffled_shards(docs, bucket_bytes=50_000).collect()
    two = sharding.shuffled_shards(docs.repartition(7), bucket_bytes=50_000).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert sorted(tuple(r)[:5] for r in one) == sorted(map(tuple, docs.collect()))
    order = [r.doc_id for r in sorted(one, key=lambda r: (r["__slot"], r["__shard"]))]
    assert order != sorted(order)
    assert [r.doc_id for r in sorted(sharding.shuffled_shards(docs, seed=2).collect(), key=lambda r: (r["__slot"], r["__shard"]))] != order


def test_shard_columns_against_plain_python(spark, texts):
    for r in sharding.op3_sharding(spark, SF_SMALL).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_equal_rows_are_scattered_over_buckets(spark):
    """Half of the rows are one row: its copies lie in all buckets, and the law still holds."""
    docs = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                      F.when(F.col("id") % 2 == 0, F.lit("one text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = sharding.shuffled_shards(docs, bucket_bytes=30_000).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["__shard"]].append(r["__slot"])
    assert sorted(map(len, slots.values())) == [5000] * 8 and all(sorted(s) == list(range(5000)) for s in slots.values())
    copies = [r["__slot"] for r in got if r.doc_id == 7]
    assert len(copies) == 20_000
    spread = np.bincount(np.array(copies) // 250, minlength=20)  # about half of every stretch of the order
    assert spread.max() < 2 * np.median(spread)
    with pytest.raises(ValueError, match="names of the operator"):
        sharding.shuffled_shards(docs.withColumn("__slot", F.lit(1)))


def test_long_texts_have_the_features_of_the_whole(monkeypatch):
    rng = random.Random(4)
    words = ["a", "bb", "ccc", "Dd", "e5", "ünï", "x" * 90, "repeat", "repeat"]
    for n in (0, 1, 2, 3, 7, 400):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " \t"]) for _ in range(n)).encode()
        for text in (text, b" \n" + text, text.strip()):
            want = quality.text_features(text).tolist()
            for size in (1, 5, 64, 300):
                monkeypatch.setattr(quality, "SLICE", size)
                assert quality.text_features(text).tolist() == want, (n, size)
            monkeypatch.undo()


def test_a_labelled_id_on_many_rows_is_bounded(spark, monkeypatch):
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5]
    hot, bad = ids[0], ids[1::2]
    docs = spark.range(20_000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("Good words stand here, number "), F.col("id") % 5000).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, "zzz qqq ### 123" if i in bad else "Good words stand here.") for i in ids[1:]], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 0 if i in bad else 1) for i in ids], "doc_id long, quality int")
    seen = []
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda labelled, sample, **kw: (seen.append(sample.groupBy("doc_id", "y").count().collect()), real(labelled, sample, **kw))[1])
    got = {r.doc_id: r["__score"] for r in quality.classify(docs, labels, sample_rows=50).where(F.col("doc_id") != hot).collect()}
    assert sum(r["count"] for r in seen[0]) <= 100
    assert min(got[i] for i in got if i not in bad) > 0.3 > max(got[i] for i in bad)


# ------------------------------------------------------------------ decontamination

def _shingles(text):
    words = text.lower().split()
    return [" ".join(words[k:k + 5]) for k in range(len(words) - 4)]


def test_contaminations(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()}
    rng = random.Random(1)
    # planted: an item with a word changed, one doubled inside, one as a whole text, repeated words
    item = bench[0].split()
    changed = [*item[:len(item) // 2], "CHANGED", *item[len(item) // 2 + 1:]]
    docs |= {90001: " ".join([*(f"p{k}" for k in range(30)), *changed, "tail"]), 90002: " ".join(item[1:]), 90003: " ".join(item),
             90004: " ".join(rng.sample(item, len(item))), 90005: "again and again " * 40}
    bench |= {901: "again and again " * 6}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = decontamination.contaminations(df, spark.createDataFrame(list(bench.items()), "item_id long, text string")).collect()
    items = {i: _shingles(t) for i, t in bench.items()}
    holders = defaultdict(set)
    for i, grams in items.items():
        for g in grams:
            holders[g].add(i)
    expected = {}
    for d, text in docs.items():
        grams = _shingles(text)
        for i in set().union(*(holders.get(g, ()) for g in grams)) if grams else ():
            want, best = Counter(items[i]), 0
            for s in range(max(1, len(grams) - len(items[i]) + 1)):
                window = Counter(grams[s:s + len(items[i])])
                shared = sum((window & want).values())
                best = max(best, shared / (sum(window.values()) + len(items[i]) - shared))
            if best >= 0.8:
                expected[d, i] = best
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == expected
    assert {d for d, _ in expected} >= {90002, 90003, 90005}


def test_near_copies_with_repeated_shingles(spark):
    rng = random.Random(14)
    bench = {k: [f"w{rng.getrandbits(40)}" for _ in range(105)] for k in range(60)}
    docs = {100 + k: words[:94] + [f"filler{k}"] * 11 for k, words in bench.items()}  # 90 shingles of 101 shared, one repeated 7 times
    tables = [spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{n} long, text string") for x, n in ((docs, "doc_id"), (bench, "item_id"))]
    got = decontamination.contaminations(*tables).collect()
    assert {(r.doc_id - 100, r.item_id): r.similarity for r in got} == {(k, k): 90 / 112 for k in bench}


def test_sliding_windows_hold_their_shingles(spark):
    """What came and went up to a start is the window's multiset, copies numbered from 1, with gaps between windows and repeats."""
    rng = random.Random(6)
    texts, starts = {}, []
    for t in range(12):
        hs = [rng.randrange(1, 3 + 5 * t) for _ in range(rng.choice([1, 9, 80]))]
        texts[t] = hs
        for m in (1, 4, 30):
            n = min(m, len(hs))
            starts += [(t, 0, m, n, s) for s in sorted(rng.sample(range(len(hs) - n + 1), min(4, len(hs) - n + 1)))]
    starts_df = spark.createDataFrame(starts, "t1 long, t2 long, m int, n int, start int")
    texts_df = spark.createDataFrame([(t, 0, hs) for t, hs in texts.items()], "t1 long, t2 long, hs array<bigint>")
    moves = defaultdict(list)
    places = decontamination.covered(starts_df, texts_df)
    for r in decontamination.changes(places).collect():
        moves[r.t1, r.m].append(r)
    for t, _, m, n, s in starts:
        held = Counter()
        for r in moves[t, m]:
            if r.s <= s:
                held[r.h, r.j] += r.sign
        window = Counter(texts[t][s:s + n])
        assert {k: c for k, c in held.items() if c} == {(h, j): 1 for h, c in window.items() for j in range(1, c + 1)}
    assert places.count() == sum(len({p for x in starts if (x[0], x[2]) == key for p in range(x[4], x[4] + x[3])}) for key in {(x[0], x[2]) for x in starts})


def test_long_items_are_linear(spark):
    """An item of 20,000 words (its windows hold 10**8 shingles in all), changed and repeated words included."""
    item = [f"w{k % 15_000}" for k in range(20_000)]  # a quarter of its shingles stand twice
    near = [*item[:300], "CHANGED", *item[301:]]
    docs = [(1, " ".join(item)), (2, " ".join(["head"] * 50 + near + [f"t{k}" for k in range(30_000)])), (3, " ".join(item[:9_000])), (4, "clean")]
    got = decontamination.contaminations(spark.createDataFrame(docs, "doc_id long, text string"),
                                         spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    shared = 19_996 - 5
    assert {(r.doc_id, r.start, r.n_words): r.similarity for r in got} == {(1, 0, 20_000): 1.0, (2, 50, 20_000): shared / (2 * 19_996 - shared)}


def test_kept_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30))), (2, "clean")], "doc_id long, text string")
    docs = docs.withColumns({name: F.lit(name) for name in ("row", "own1", "__own1", "__t1", "t1", "t2", "hs", "m", "start", "__text")})
    kept = decontamination.decontaminated(docs, docs.where("doc_id = 1").select(F.col("doc_id").alias("item_id"), "text"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", *docs.columns[2:])]


def test_items_without_an_id_or_with_a_shared_one(spark):
    texts = [" ".join(f"{name}{k}" for k in range(30)) for name in ("a", "b", "c", "d")]
    docs = spark.createDataFrame([(k, f"some words before {t} and after") for k, t in enumerate(texts)] + [(9, "clean words only in this one")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[3]), (7, None)],
                                  "item_id long, text string")
    got = decontamination.contaminations(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == [(0, None), (1, None), (2, 5), (3, 5), (3, 6)]
    assert all(r.similarity == 1 and r.start == 3 and r.n_words == 30 for r in got)
    assert [r.doc_id for r in decontamination.decontaminated(docs, bench).collect()] == [9]


# ------------------------------------------------------------------ line dedup

def test_lines_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_CHECK}/documents.parquet')")
    expected = con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.OP5_SQL})").fetchall()
    got = line_dedup.op5_line_dedup(spark, SF_CHECK).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (5, 2), (7, 3)])
def test_runs_do_not_depend_on_batches(spark, batches, fan_out):
    rng = random.Random(3)
    lines = [f"this is common line number {k}" for k in range(12)]
    docs = {d: "\n".join(rng.choices([*lines, "tiny", f"a line of document {d} alone"], k=8)) for d in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, batches=batches, fan_out=fan_out).collect()}
    holders = defaultdict(set)
    for d, t in docs.items():
        for line in t.split("\n"):
            if len(line) >= 20:
                holders[line].add(d)
    gone = {(d, line) for line, ds in holders.items() if len(ds) >= 3 for d in ds if d != max(ds)}
    assert got == {d: "\n".join(line for line in t.split("\n") if (d, line) not in gone) for d, t in docs.items()}


# ------------------------------------------------------------------ nearest neighbours

@pytest.mark.parametrize("folder", [SF_CHECK, "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = defaultdict(dict)
    for r in nearest.op6_nearest_neighbours(spark, folder).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    found = 0
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[queries].tolist())
    for q in queries:
        score = vectors @ vectors[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        mine = got[ids[q]]
        assert sorted(mine) == list(range(1, 21))
        ordered = [mine[k] for k in range(1, 21)]
        assert ordered == sorted(ordered, key=lambda x: (-x[1], x[0]))
        at = {v: k for k, v in enumerate(ids)}
        assert np.allclose([s for _, s in ordered], [score[at[v]] for v, _ in ordered], atol=1e-12)
        found += len({v for v, _ in ordered} & set(best.tolist()))
    assert found / (20 * len(queries)) >= 0.9


def test_copies_and_norms(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(400, 6)) * rng.uniform(0.1, 5, (400, 1))
    vectors[50:200] = vectors[50]  # one vector many times
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, tables=12, axes=8, probes=16).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    for q in range(0, 400, 20):  # all buckets probed: exact, ties to the smaller id
        score = vectors @ vectors[q]
        score[q] = -np.inf
        expected = sorted(range(400), key=lambda k: (-round(score[k], 9), k))[:20]
        assert [v for _, v in sorted(got[q])] == expected


@pytest.mark.parametrize("norms", ["one long vector", "spread", "extreme"])
def test_recall_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(6000, 64))
    vectors /= np.sqrt((vectors * vectors).sum(1, keepdims=True))
    if norms == "spread":
        vectors *= rng.lognormal(0, 0.5, (6000, 1))
    vectors[7] *= 10
    if norms == "extreme":  # the square of the longest one is no double
        vectors = np.concatenate([vectors * 1e-100, [[1e160, *[0.0] * 63]]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 1).collect():
        got[r.query_id].add(r.vec_id)
    found = 0
    for q in range(1, 6000, 50):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        found += len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist()))
    assert found / (20 * 120) >= 0.95


# ------------------------------------------------------------------ personal data

EMAIL, IP, CARD, PHONE = map(re.compile, (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]"))


def _rules(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(number):
        odd, even = number[::-2], number[-2::-2]
        return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


ODD = ["a@b@c.com", "x.y+z@d-e.f.g.", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 007.0.0.1", "1.2.3", "4111 1111 1111 1111-", "4111-1111-1111-1112",
       "+1 (253) 555-0199 x", "+1+2 345 678 901", "++12345678901", "é+49 30 1234567 ü", "12 34", "0000 0000 0000", "a..b@c..d", "q@w.e@r.t",
       "99999999999999999999.1.1.1", "1-2-3-4-5-6-7-8-9-0-1-2"]


def test_rule_spans():
    rng = random.Random(9)
    pieces = [*ODD, " ", "\n", "a", "@", ".", "+", "7", "-"]
    for text in [*ODD, *("".join(rng.choices(pieces, k=9)) for _ in range(3000)), *("".join(rng.choices("a1@.+- (", k=14)) for _ in range(6000))]:
        assert personal_data.rule_spans(text) == _rules(text), text


def test_long_texts_are_quick():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "a@" * 100_000, "+1" + " " * 100_000):
        personal_data.rule_spans(text)


def test_personal_data(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    found = extra = 0
    for r in personal_data.op7_personal_data(spark, SF_CHECK).collect():
        base = _rules(texts[r.doc_id])
        joined = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        found += len(base)
        extra += len(set(r.spans.split(",")) - set(joined.split(",")) - {""})
    assert found > 20 and extra <= 0.05 * found  # the field leaves clean texts alone


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    field = (rng.normal(size=(personal_data.FEATURES, personal_data.TAGS)), rng.normal(size=(personal_data.TAGS,) * 2), rng.normal(size=personal_data.TAGS))
    chains = [[list(rng.integers(0, 50, 3)) for _ in range(n)] for n in (1, 2, 3, 3)]
    for chain, tags in zip(chains, personal_data.viterbi(chains, field), strict=True):
        def value(path, chain=chain):
            return field[2][path[0]] + sum(field[0][f, t] for t, fs in zip(path, chain, strict=True) for f in fs) \
                + sum(field[1][a, b] for a, b in zip(path, path[1:], strict=False))
        every = np.array(np.meshgrid(*[range(personal_data.TAGS)] * len(chain))).reshape(len(chain), -1).T
        assert value(tags) == pytest.approx(max(value(p) for p in every))


def test_field_learns_what_the_rules_show():
    lines = [f"call +1 ({a}) 555-{b} now" for a in range(200, 260) for b in (1000, 2345)] + [f"version {k}.0 of {k} items" for k in range(120)]
    chains, tags = [], []
    for line in lines:
        spans = personal_data.rule_spans(line)
        for run in personal_data.runs(line):
            chains.append([f for _, _, f in run])
            tags.append(personal_data.rule_tags(run, spans))
    field = personal_data.train_field(chains, tags, 60)
    assert personal_data.viterbi(chains, field) == tags


def _judged(train, test):
    """Spans found, spans there and spans both, by a field of the labelled lines ``train`` on those of ``test``."""
    field, counts = personal_data.train_field(*personal_data.form_table(train)), np.zeros(3, int)
    for text, kind, start, end in test:
        there = {(start, personal_data.KINDS.index(kind), end)} if kind else set(_rules(text))
        chains = list(personal_data.runs(text))
        tags = personal_data.viterbi([[f for _, _, f in c] for c in chains], field)
        found = {span for c, t in zip(chains, tags, strict=True) for span in personal_data.tagged_spans(c, t, text)}
        counts += len(found), len(there), len(found & there)
    return counts


def test_labelled_values_are_what_they_say():
    lines = personal_forms.labelled_lines()
    kinds = Counter(kind for _, kind, _, _ in lines)
    assert min(kinds[k] for k in (*personal_data.KINDS, "")) > 100
    missed = [(t, k, a, b) for t, k, a, b in lines if k and (a, personal_data.KINDS.index(k), b) not in _rules(t)]
    assert len(missed) == sum(kinds[k] for k in personal_data.KINDS)  # the rules find none of them
    digits = {(k, sum(c.isdigit() for c in t[a:b])) for t, k, a, b in lines if k == "card"}
    assert digits == {("card", 15), ("card", 16)}


@pytest.mark.parametrize("fold", range(3))
def test_field_on_unseen_sentences(fold):
    train = personal_forms.labelled_lines(carriers=lambda at: at % 3 != fold)
    found, there, both = _judged(train, personal_forms.labelled_lines(1, 5, carriers=lambda at: at % 3 == fold))
    assert both >= 0.95 * found and both >= 0.95 * there


def test_field_on_unseen_forms():
    """Each form is left out of the training in turn; the field judges its values by digits, checks and neighbours (measured: 0.89 and 0.87)."""
    counts = np.zeros(3, int)
    for form in dict.fromkeys(f for forms in personal_forms.FORMS.values() for f in forms):
        rest, only = ({k: [f for f in fs if (f == form) == own] for k, fs in personal_forms.FORMS.items()} for own in (False, True))
        counts += _judged(personal_forms.labelled_lines(1, table=rest), personal_forms.labelled_lines(1, 5, table=only))
    found, there, both = counts
    assert both >= 0.85 * found and both >= 0.8 * there


def test_long_words_count_whole():
    ends = [personal_data.word_shape("a1" * 500 + end) for end in ("-", "/")]
    assert ends[0] != ends[1]
    long = "9" * 5000
    assert [len(run) for run in personal_data.runs(f"a {long} b")] == [1]
    started = time.time()
    for text in ("1" * 300_000, "a1" * 150_000, "1 " * 100_000, "1:" * 150_000, "@" * 300_000):
        list(personal_data.runs(text))
    assert time.time() - started < 60


def test_field_adds_spans_where_the_rules_miss(spark):
    """Spans of forms the rules miss are added to a table of them; base spans stay."""
    lines = personal_forms.labelled_lines(1, seed=77)
    docs = spark.createDataFrame([(k, text) for k, (text, *_) in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in personal_data.find_personal_data(docs).collect()}
    there = {k: {(a, personal_data.KINDS.index(kind), b)} if kind else set(_rules(t)) for k, (t, kind, a, b) in enumerate(lines)}
    both = sum(len(there[k] & set(got[k])) for k in there)
    assert both >= 0.8 * sum(map(len, there.values())) and both >= 0.95 * sum(map(len, got.values()))
    assert all(set(_rules(lines[k][0])) <= set(got[k]) for k in got)


def test_copies_of_lines_change_nothing(spark):
    # few lines hold each kind, the others are many different ones; then a thousand copies of all, with one hotter still
    kinds = ["mail a.b@c.org now", "host 10.1.2.3 is up", "card 4111 1111 1111 1111 ok", "call +1 (253) 555-0199 now"]
    plain = [f"{a} {'9' * k}{m} {b}" for a in ("item", "Row", "the") for b in ("of", "Of", "IN", "x.") for k in range(1, 6) for m in ("", "-", "/", "a", "%")]
    one = spark.createDataFrame(list(enumerate(kinds + plain)), "doc_id long, text string")
    many = one.crossJoin(spark.range(1000).select()).unionByName(one.limit(1).crossJoin(spark.range(1000).select()))
    table = personal_data.labelled_table(one, "doc_id", "text", 120)
    copied = personal_data.labelled_table(many, "doc_id", "text", 120)
    assert copied[:2] == table[:2] and 60 < len(table[0]) <= 120
    for held in (table, copied):
        assert {(t - 1) // 2 for tags in held[1] for t in tags if t} == set(range(4)) and sum(held[2]) == pytest.approx(120)
    missed = {"call (253) 555-0147 now": "phone:5:19", "card 4012.8888.8888.1881 please": "card:5:24", "write to jane.roe@mailhost": "email:9:26",
              "card 4012.8888.8888.1882 please": "", "on 2023-04-05 at 11:20": ""}
    assert not any(personal_data.rule_spans(t) for t in missed)
    asked = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(missed)], one.schema)
    for docs in (one, many):
        got = personal_data.find_personal_data(docs.unionByName(asked)).where("doc_id >= 1000")
        got = got.select("doc_id", personal_data.spans_text(F.col("spans")).alias("spans")).collect()
        assert [r.spans for r in sorted(got)] == list(missed.values())


# ------------------------------------------------------------------ packing

def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in texts.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * math.ceil(sum(r.length for r in got) / 1024) + 1


def test_tokens_of_texts_with_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    pieces = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<", " ", "  ", "\n", "a", " word", "'s", "12", "é", "日本", "🙂", "\u00a0", "<|startoftext|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", *("".join(rng.choices(pieces, k=12)) for _ in range(2000)),
             "<|endoftext|> many words " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(dict)
    for r in packing.pieces(df).collect():
        got[r.doc_id][r.piece] = r.ids
    for i, text in enumerate(texts):
        ids = np.frombuffer(b"".join(got[i][k] for k in sorted(got[i])), "<u4").tolist()
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text
    assert np.frombuffer(got[0][0], "<u4").tolist() == [64, 220, 50256, 275, 2]


def test_evolution_never_gets_worse_and_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(200, 500, 300)
    first = packing.evolve(lengths, [], 1024, 0, 4, np.random.default_rng(3))
    later = packing.evolve(lengths, first, 1024, 60, 4, np.random.default_rng(3))
    for bins in later:
        assert np.bincount(bins, weights=lengths).max() <= 1024 and set(bins) == set(range(bins.max() + 1))
    assert packing.fitness(lengths, later[0], 1024) <= packing.fitness(lengths, first[0], 1024)
    assert packing.fitness(lengths, later[0], 1024) < packing.fitness(lengths, first[-1], 1024)


# ------------------------------------------------------------------ quality classifier

def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op9_quality_classifier(spark, "/root/testdata/sf0.1").collect()}
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    good, bad = [r.score for r, y in labels if y], [r.score for r, y in labels if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    assert np.mean([r.predicted == y for r, y in labels]) > 0.98
    assert np.mean([s >= 0.3 for s in good]) > 0.995  # clean documents stay


def test_hinge_solution_is_optimal():
    rng = np.random.default_rng(5)
    scale = np.ones(quality.FEATURES)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(60)]
    y = np.array([int(7 in r or rng.random() < 0.2) for r in rows])
    w = quality.fit_hinge(rows, y, scale, 1.0, 400)
    sign = np.where(y > 0, 1, -1)
    cost = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)

    def primal(w):
        margins = np.array([w[r] @ quality.unit(r, scale) + w[-1] for r in rows])
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * margins)).sum()

    best = primal(w)
    for _ in range(200):
        other = w.copy()
        other[rng.integers(0, 40, 5)] += rng.normal(0, 0.05, 5)
        assert primal(other) >= best - 1e-2


# ------------------------------------------------------------------ substring dedup

def _removed(docs, width=50):
    words = {i: (t or "").encode().split() for i, t in docs.items()}
    low = {}
    for i in sorted(words):
        for j in range(len(words[i]) - width + 1):
            low.setdefault(tuple(words[i][j:j + width]), i)
    out = {}
    for i, line in words.items():
        gone = np.zeros(len(line), bool)
        for j in range(len(line) - width + 1):
            if low[tuple(line[j:j + width])] < i:
                gone[j:j + width] = True
        out[i] = (len(line), int(gone.sum()), b" ".join(w for w, g in zip(line, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("bucket_strings", [4096, 3, 1])
def test_substrings(spark, texts, bucket_strings):
    rng = random.Random(6)
    passage = [f"shared{k}" for k in range(80)]
    docs = dict(texts)
    for k in range(12):  # a passage among other words, pieces of it, periodic texts, near copies
        own = [f"own{k}_{j}" for j in range(rng.randint(0, 60))]
        cut = passage[rng.randint(0, 20):rng.randint(60, 80)]
        docs[1000 + k] = " ".join([*own, *cut, *own[::-1]])
        docs[2000 + k] = " ".join(["to and fro"] * rng.randint(10, 60))
        near = list(passage) * 2
        near[rng.randrange(len(near))] = f"edit{k}"
        docs[3000 + k] = " ".join(near)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = substring_dedup.dedup_substrings(df, bucket_strings=bucket_strings).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == _removed(docs)


def test_a_passage_in_many_surroundings(spark):
    """One passage between different words in every document: its windows meet once per task, in any order of the ids."""
    passage = [f"held{k}" for k in range(60)]
    ids = random.Random(8).sample(range(10_000), 400)
    docs = {i: " ".join([f"a{i}_{k}" for k in range(i % 45)] + passage + [f"b{i}_{k}" for k in range(45)]) for i in ids}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    got = substring_dedup.dedup_substrings(df, bucket_strings=16).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == _removed(docs)
    assert sum(r.n_removed for r in got) == 60 * 399

    strings = spark.createDataFrame([(7, i, 0, " ".join(docs[i].split()).encode(), i, 400) for i in ids],
                                    "h long, k1 long, k2 long, packed binary, low long, n long")
    tasks = substring_dedup._tasks(strings, 16)
    assert tasks.groupBy("part").count().agg(F.max("count")).first()[0] < 3 * 16
    held = substring_dedup.window_lows(tasks, 50)
    hot = held.select("part", F.explode("w1").alias("w1")).distinct().groupBy("w1").count().agg(F.max("count")).first()[0]
    assert hot == 25  # rows of the hottest window: one per task of its bucket, not one per string
    best = substring_dedup.lows_over_tasks(held).collect()
    assert sorted(r.k1 for r in best) == sorted(ids)
    # windows inside the passage have the smallest id, all others their own
    assert all(sorted(low for low in r.lows if low != r.k1) == [min(ids)] * 11 for r in best if r.k1 != min(ids))
