"""Personal data: fixed rules, and a linear-chain conditional random field over word shapes.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers.
The field adds spans the rules miss.  It is trained here from a small labelled
table: about ``labelled_lines`` different runs of words of the corpus, labelled by
the rules, dealt evenly over the kinds they hold and weighted to their numbers in
the corpus (so copies change nothing; long runs train in pieces of ``PIECE_WORDS`` words), and
the lines of ``personal_forms``, which hold forms the rules miss and negatives.  A word's
features are its own shape, what its numbers' own checks say, its digits and its run's,
and the words around it; words count whole, whatever their length.  Only words that
hold a digit or an ``@`` (*active* words) can be tagged, a constraint of the
field itself; other words are outside every span, so each run of active words is
a chain of its own and the runs are decoded exactly by Viterbi, in numpy batches
of equal lengths.
"""

from __future__ import annotations

import ipaddress
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.personal_forms import labelled_lines
from affinity.llm.shared import read_documents, small_batches, stored

#: Kinds of spans, in the order of the contract (fixed values).
KINDS = ("email", "ip", "card", "phone")
LABELLED_LINES = 3000
FEATURES = 4096
STEPS = 80
#: Tags: outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)

#: Share of the labelled table's weight that the lines of ``personal_forms`` have.
FORMS_SHARE = 0.5
#: Longer runs train as pieces of this many words (they are decoded whole).
PIECE_WORDS = 16
#: Places in a word's features of those that hold its exact shape, or its marks.
SHAPED = (0, 2, 5, 6, 7, 9, 11)

ACTIVE = re.compile("[0-9@]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The pattern of the contract; a match cannot begin inside a digit run that an earlier start would take.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
#: Marks that close a sentence or a quotation.
CLOSING = ".,;:!?\"'"


# ------------------------------------------------------------------ rules

def emails(text: str):
    """Leftmost matches of local part, ``@`` and dotted domain: each ``@`` with the longest local part before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        if domain:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _is_ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _is_card(match: str) -> bool:
    digits = "".join(DIGITS.findall(match))
    return 12 <= len(digits) <= 19 and _luhn(digits)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all rule matches, sorted; end exclusive, in code points."""
    if not ACTIVE.search(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _is_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(found)


# ------------------------------------------------------------------ words and features

def word_shape(word: str) -> str:
    """Letters become a or A (runs as one), digit runs their length class, marks stay."""
    out = []
    for part in re.findall(r"[0-9]+|[a-z]+|[A-Z]+|[^\W\d_]+|.", word, re.DOTALL):
        if part[0] in "0123456789":
            out.append("9" * min(len(part), 5) if len(part) < 9 else "N")
        else:
            out.append("a" if part.islower() else "A" if part.isalpha() else part)
    return "".join(out)


def word_check(word: str) -> str:
    """What a number's own rules say of a word: card checksum, address parts, names on both sides of an ``@``, or nothing."""
    if "@" in word:
        return f"at {bool(re.search('[0-9A-Za-z]@[0-9A-Za-z]', word))}"
    digits = DIGITS.findall(word)
    if 12 <= len(digits) <= 19 and not re.search("[A-Za-z]", word):
        return f"luhn {_luhn(''.join(digits))}"
    if 2 <= word.count(":") <= 7 and len(word) <= 39:  # no longer word is an address
        try:
            return f"address {bool(ipaddress.IPv6Address(word))}"
        except ValueError:
            return "address False"
    address = IP.search(word)
    return f"parts {_is_ip(address[0])}" if address else ""


def _number(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "replace")) % FEATURES


def _features(core: str, word: str, shapes: list[str], cue: str, digits: int, whole: str) -> list[int]:
    """Feature numbers of a word; ``core`` has no closing marks, ``shapes`` are those of the word before, its own and the next."""
    before, own, after = shapes
    check, marks = word_check(core), "".join(sorted(set(re.findall("[^0-9A-Za-z]", core))))
    count = f"{min(digits, 20)}"
    return [_number(f) for f in ("0" + own, "c" + check, "C" + check + marks, "-" + before, "+" + after, "<" + before + " " + own, ">" + own + " " + after,
                                 "m" + marks, "d" + count + " " + check, "D" + count + marks, whole, "R" + whole + marks, "w" + cue,
                                 f"t{word[len(core):len(core) + 1]}", f"z{core[:1] == '0'}{core[:1] == '('}{count}")]


def runs(text: str):
    """Runs of active words in the lines of a text: lists of (start, end, features)."""
    at = 0
    for line in text.split("\n"):
        if ACTIVE.search(line):
            words = [(m.start() + at, m.end() + at, m[0]) for m in WORDS.finditer(line)]
            cores = [w.rstrip(CLOSING) for _, _, w in words]
            shapes = ["<", *map(word_shape, cores), ">"]
            cues = ["<", *(c.lower() if c.isalpha() else "" for c in cores), ">"]
            k = 0
            while k < len(words):
                stop = k
                while stop < len(words) and ACTIVE.search(words[stop][2]):
                    stop += 1
                if stop > k:
                    digits = [len(DIGITS.findall(c)) for c in cores[k:stop]]
                    whole = f"r{min(sum(digits), 20)} {min(stop - k, 5)}"
                    yield [(*words[j][:2], _features(cores[j], words[j][2], shapes[j:j + 3], cues[j], digits[j - k], whole)) for j in range(k, stop)]
                k = stop + 1
        at += len(line) + 1


# ------------------------------------------------------------------ the field

def _by_length(chains: list):
    """Indexes of chains of one length, with their features (chains, words, features)."""
    groups = defaultdict(list)
    for k, chain in enumerate(chains):
        groups[len(chain)].append(k)
    for at in groups.values():
        for lo in range(0, len(at), 4096):
            part = at[lo:lo + 4096]
            yield part, np.array([chains[k] for k in part])


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train_field(chains: list, tags: list, steps: int = STEPS, weights: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission, transition and start weights by gradient ascent (AdaGrad) on the likelihood (each chain with its weight), forward-backward in batches."""
    mass = np.ones(len(chains)) if weights is None else np.array(weights, float)
    emit, move, first = np.zeros((FEATURES + 1, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    grown = [np.full_like(x, 1e-6) for x in (emit, move, first)]
    batches = [(feats, np.array([tags[k] for k in part]), mass[part]) for part, feats in _by_length(chains)]
    for _ in range(steps):
        slope = [-1e-3 * x for x in (emit, move, first)]
        for feats, gold, times in batches:
            n, size, _ = feats.shape
            local = emit[feats].sum(2)
            forward = [first + local[:, 0]]
            for t in range(1, size):
                forward.append(_lse(forward[-1][:, :, None] + move, 1) + local[:, t])
            backward = [np.zeros((n, TAGS))]
            for t in range(size - 1, 0, -1):
                backward.insert(0, _lse(move + (local[:, t] + backward[0])[:, None, :], 2))
            whole = _lse(forward[-1], 1)
            for t in range(size):
                gap = times[:, None] * (np.eye(TAGS)[gold[:, t]] - np.exp(forward[t] + backward[t] - whole[:, None]))
                for f in range(feats.shape[2]):
                    np.add.at(slope[0], feats[:, t, f], gap)
                if t:
                    pair = np.exp(forward[t - 1][:, :, None] + move + (local[:, t] + backward[t])[:, None, :] - whole[:, None, None])
                    slope[1] -= (times[:, None, None] * pair).sum(0)
                    np.add.at(slope[1], (gold[:, t - 1], gold[:, t]), times)
                else:
                    slope[2] += gap.sum(0)
        slope[0][FEATURES] = 0  # a feature left out weighs nothing
        for x, g, total in zip((emit, move, first), slope, grown, strict=True):
            total += g * g
            x += 0.5 * g / np.sqrt(total)
    return emit, move, first


def viterbi(chains: list, field) -> list[list[int]]:
    """Best tags of every chain."""
    emit, move, first = field
    out: list = [None] * len(chains)
    for part, feats in _by_length(chains):
        local = emit[feats].sum(2)
        score, back = first + local[:, 0], []
        for t in range(1, feats.shape[1]):
            options = score[:, :, None] + move
            back.append(options.argmax(1))
            score = options.max(1) + local[:, t]
        path = [score.argmax(1)]
        for step in reversed(back):
            path.insert(0, np.take_along_axis(step, path[0][:, None], 1)[:, 0])
        for k, tags in zip(part, np.stack(path, 1).tolist(), strict=True):
            out[k] = tags
    return out


def rule_tags(run: list, spans: list) -> list[int]:
    """Tags of a run's words from rule spans (a word belongs to the span that covers its first digit or ``@``)."""
    tags, open_span = [], None
    for a, b, _ in run:
        span = next((s for s in spans if s[0] < b and s[2] > a), None)
        tags.append(0 if span is None else 1 + 2 * span[1] + (span == open_span))
        open_span = span
    return tags


def tagged_spans(run: list, tags: list[int], text: str):
    """Spans of a tagged run, without marks that close a sentence."""
    at = 0
    while at < len(run):
        if not tags[at]:
            at += 1
            continue
        kind, stop = (tags[at] - 1) // 2, at + 1
        while stop < len(run) and tags[stop] == 2 + 2 * kind:
            stop += 1
        start, end = run[at][0], run[stop - 1][1]
        while end > start and text[end - 1] in CLOSING:
            end -= 1
        if end > start:
            yield start, kind, end
        at = stop


def form_table(lines=None) -> tuple[list, list]:
    """Different runs of active words of the labelled lines and their tags, each also without its exact shapes.

    The second form makes the field weigh what unseen shapes have too: marks, numbers of digits, checks.
    """
    table = {}
    for text, kind, start, end in labelled_lines() if lines is None else lines:
        spans = [(start, KINDS.index(kind), end)] if kind else rule_spans(text)
        for chain in runs(text):
            table.setdefault(str([f for _, _, f in chain]), ([f for _, _, f in chain], rule_tags(chain, spans)))
    chains, tags = [c for c, _ in table.values()], [t for _, t in table.values()]
    return chains + [[[FEATURES if k in SHAPED else f for k, f in enumerate(word)] for word in c] for c in chains], tags + tags


def shares(sizes: dict[int, int], lines: int) -> dict[int, int]:
    """``lines`` dealt evenly over strata of these sizes; what a small one leaves goes to the others."""
    out, left = {}, lines
    for at, (key, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[key] = min(size, left // (len(sizes) - at))
        left -= out[key]
    return out


def labelled_table(docs: DataFrame, id_col: str, text_col: str, lines: int) -> tuple[list, list, list]:
    """Chains, tags and weights of at most ``lines`` different runs of active words with their rule tags (bounded, on the driver).

    The strata are the sets of kinds a run holds.  Each gives the runs of its
    smallest hashes, weighted by their counts and, if it gives only some, up to
    the count of the whole stratum; all weights sum to ``lines``.
    """
    def run(batches):
        for batch in small_batches(batches):
            feats, tags = [], []
            for text in batch.column(0).to_pylist():
                spans = rule_spans(text)
                for chain in runs(text):
                    own = rule_tags(chain, spans)
                    for lo in range(0, len(chain), PIECE_WORDS):
                        feats.append([f for _, _, f in chain[lo:lo + PIECE_WORDS]])
                        tags.append(own[lo:lo + PIECE_WORDS])
            held = [sum({1 << (t - 1) // 2 for t in row if t}) for row in tags]
            yield pa.RecordBatch.from_arrays([pa.array(feats, pa.list_(pa.list_(pa.int32()))), pa.array(tags, pa.list_(pa.int32())),
                                              pa.array(held, pa.int32())], names=["features", "tags", "held"])

    # every text with an active word is read; copies of a run are one row with their count, combined before the shuffle
    texts = docs.where(F.col(text_col).rlike("[0-9@]")).select(text_col)
    every = texts.mapInArrow(run, "features array<array<int>>, tags array<int>, held int")
    table = stored(every.groupBy("features", "tags", "held").agg(F.count(F.lit(1)).alias("n")), "runs")
    sizes = {r.held: r for r in table.groupBy("held").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}  # 16 at most
    if not sizes:
        return [], [], []
    wanted = shares({k: r["rows"] for k, r in sizes.items()}, lines)
    # hashes are even, so the smallest ones of a stratum are those under a bound
    key = F.xxhash64(F.to_json(F.struct("features", "tags")))
    bound = F.get(F.array(*(F.lit(float(2 * wanted.get(k, 0) / sizes[k]["rows"] if k in sizes else 0)) for k in range(1 << len(KINDS)))), F.col("held"))
    some = table.withColumn("key", key).where(F.shiftrightunsigned("key", 1) / float(1 << 63) <= bound).collect()  # 2 * lines, about
    chains, tags, weights = [], [], []
    for held, most in sorted(wanted.items()):
        rows = sorted((r for r in some if r.held == held), key=lambda r: (r.key, r.features, r.tags))[:most]
        scale = sizes[held]["n"] / sum(r.n for r in rows) if rows else 0
        chains += [[list(f) for f in r.features] for r in rows]
        tags += [list(r.tags) for r in rows]
        weights += [r.n * scale for r in rows]
    total = sum(weights)
    return chains, tags, [w * lines / total for w in weights]


def _forms_held(chain: list, lengths: set[int]) -> set[tuple]:
    """Shapes and checks of every stretch of a run's words of one of these lengths."""
    kinds = [tuple(word[:2]) for word in chain]
    return {tuple(kinds[at:at + size]) for size in lengths for at in range(len(kinds) - size + 1)}


def training_table(docs: DataFrame, id_col: str, text_col: str, lines: int) -> tuple[list, list, list]:
    """The corpus' labelled runs and those of ``personal_forms``.

    The rules know nothing of a form that they miss: a corpus run that they leave untagged does not train
    if it holds the words (shapes and checks) of a span of ``personal_forms``.
    """
    chains, tags = form_table()
    spans = {tuple(tuple(word[:2]) for word, tag in zip(c, t, strict=True) if tag) for c, t in zip(chains, tags, strict=True)
             if any(t) and FEATURES not in c[0]}
    lengths = {len(span) for span in spans}
    weights = [FORMS_SHARE * lines / len(chains)] * len(chains)
    for chain, own, weight in zip(*labelled_table(docs, id_col, text_col, lines), strict=True):
        if any(own) or not spans & _forms_held(chain, lengths):
            chains.append(chain)
            tags.append(own)
            weights.append(weight)
    return chains, tags, weights


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       labelled_lines: int = LABELLED_LINES, steps: int = STEPS) -> DataFrame:
    """``(doc_id, spans)`` per row: array of (kind number, start, end, base), by start and kind; end exclusive.

    ``base`` spans come from the rules; the field's spans are added where they
    touch no base span.  Null and empty texts have none; null ids stay null;
    repeated rows repeat their result.  Other columns are not read.
    """
    chains, tags, weights = training_table(docs, id_col, text_col, labelled_lines)
    field = train_field(chains, tags, steps, weights)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # fixed size
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [rule_spans(t) for t in texts]
            found = [[(a, k, b, True) for a, k, b in spans] for spans in base]
            owned = [(d, chain) for d, text in enumerate(texts) if ACTIVE.search(text) for chain in runs(text)]
            if owned:
                best = viterbi([[f for _, _, f in chain] for _, chain in owned], shared.value)
                for (d, chain), tags in zip(owned, best, strict=True):
                    for a, k, b in tagged_spans(chain, tags, texts[d]):
                        if all(b <= x or a >= y for x, _, y in base[d]):
                            found[d].append((a, k, b, False))
            rows = [[{"kind": k, "start": a, "end": b, "base": own} for a, k, b, own in sorted(spans)] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:long,end:long,base:boolean>>")


def spans_text(spans):
    """``kind:start:end`` of every span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_personal_data(spark, sf_dir):
    """Contract query: doc_id, counts of base spans per kind, base_sha256, spans."""
    found = find_personal_data(read_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


def _count(kind: int):
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
