"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda.

A text, normalised by the model's own rules, starts as one symbol per character.
Every adjacent pair whose joint string is a piece stands on an agenda, best score
first, leftmost first among equals; the best pair merges, its new neighbours join
the agenda, and pairs whose symbols have changed are skipped when they come up.
What is left are the pieces; a character without a piece becomes its UTF-8 bytes
(or the unknown id, if the model has no byte pieces).

A merge never crosses two neighbouring characters that stand side by side in no
piece, so a text may be cut there and its parts encoded apart with the same
result.  ``Codec`` takes the pairs from the vocabulary: texts are cut before a
blank mark (where no piece holds a blank mark after another character), words
are remembered in a table of bounded size, and the agendas of a batch's new
words run side by side in arrays (long words: a heap each).

Every batch is checked against the sentencepiece library: the ids of each word
that went to the agenda (``check="words"``) or of every whole text
(``check="texts"``), and every decoded text.  A difference fails the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.shared import read_documents

MODEL = "piece_bpe_32k.model"
#: The blank mark of sentencepiece (fixed value).
MARK = "▁"
#: Words that a task remembers; the table is emptied when it is full.  Longer words are not remembered.
WORDS, WORD_CHARS = 400_000, 64
#: Words up to this length advance side by side in arrays, longer ones each by a heap of their own.
LOCKSTEP = 24
NO_PAIR = 1 << 40
#: Text that a task codes at a time.
SLICE_BYTES = 4 << 20


def model_path(name: str = MODEL) -> str:
    """Place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder of one model; one per task."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.pieces = [lib.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -lib.get_score(i) for i in plain}
        self.unused = {self.pieces[i] for i in plain if lib.is_unused(i)}
        self.bytes_of = {int(self.pieces[i][3:5], 16): i for i in ids if lib.is_byte(i)}
        self.byte_at = {i: b for b, i in self.bytes_of.items()}
        self.pairs = {pair for piece in self.id_of for pair in pairwise(piece)}
        # Words: blank marks and what follows them, if no piece joins another character to a blank mark.  Characters
        # that stand beside others in no piece are words of their own.
        split = not any(b == MARK and a != MARK for a, b in self.pairs)
        social = "".join(map(re.escape, sorted({c for pair in self.pairs for c in pair} - {MARK} if split else set())))
        self.words = re.compile(f"{MARK}+[{social}]*|[{social}]+|." if social else ".+", re.DOTALL)
        self.between = next((c for c in "\n\t\x01\x02" if social and re.escape(c) not in social and c != MARK), None)
        self.surface = [self._surface(i) for i in ids]
        self.known: dict[str, bytes] = {}
        self._joint_table()

    def _joint_table(self):
        """Arrays for the lockstep: id of each character, and rank and piece of every pair of ids that makes a piece."""
        self.character = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.character[ord(piece)] = i
        order = {score: k for k, score in enumerate(sorted(set(self.rank.values())))}
        rows = sorted((self.id_of[a] << 32 | self.id_of[b], order[self.rank[piece]], i) for piece, i in self.id_of.items()
                      for cut in range(1, len(piece)) if (a := piece[:cut]) in self.id_of and (b := piece[cut:]) in self.id_of)
        table = np.array(rows or [(-1, NO_PAIR, 0)], np.int64)
        self.joints, self.joint_rank, self.joint_piece = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].astype(np.int32)

    def _surface(self, i: int) -> str:
        if self.library.is_unknown(i):
            return " ⁇ "
        return "" if self.library.is_control(i) else self.pieces[i].replace(MARK, " ")

    # ------------------------------------------------------------ encoding
    def merged(self, symbols: list[str]) -> list[str]:
        """Pieces of a run of symbols by the agenda."""
        rank, made = self.rank, {}
        agenda = []

        def propose(left: int, right: int):
            joint = symbols[left] + symbols[right]
            score = rank.get(joint)
            if score is not None:
                agenda.append((score, left, right, len(joint)))
                if joint in self.unused:
                    made[joint] = (symbols[left], symbols[right])
                return True
            return False

        last = len(symbols) - 1
        for k in range(last):
            propose(k, k + 1)
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        after, before = list(range(1, last + 2)), list(range(-1, last))
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has merged since
            symbols[left] += symbols[right]
            symbols[right] = ""
            follower = after[left] = after[right]
            if follower <= last:
                before[follower] = left
                if propose(left, follower):
                    heapq.heappush(agenda, agenda.pop())
            if before[left] >= 0 and propose(before[left], left):
                heapq.heappush(agenda, agenda.pop())
        out = []
        for symbol in symbols:
            if symbol:
                self._taken_apart(symbol, made, out)
        return out

    def _taken_apart(self, symbol: str, made: dict, out: list):
        """Unused pieces only lead to others; in a result they fall back to what they were made of."""
        todo = [symbol]
        while todo:
            one = todo.pop()
            if one in made:
                todo += reversed(made[one])
            else:
                out.append(one)

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word by a heap, cut where no piece can reach across."""
        out: list[int] = []
        pairs, start = self.pairs, 0
        cuts = [k + 1 for k, pair in enumerate(pairwise(word)) if pair not in pairs]
        for end in (*cuts, len(word)):
            for piece in self.merged(list(word[start:end])):
                known = self.id_of.get(piece)
                if known is not None:
                    out.append(known)
                elif self.bytes_of:
                    out.extend(self.bytes_of[b] for b in piece.encode())
                else:
                    unknown = self.library.unk_id()
                    if not out or out[-1] != unknown:  # neighbouring unknown characters are one
                        out.append(unknown)
            start = end
        return out

    def _joint(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score rank and piece of each pair of ids; rank ``NO_PAIR`` where they make no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.joints, key), len(self.joints) - 1)
        return np.where(self.joints[at] == key, self.joint_rank[at], NO_PAIR), self.joint_piece[at]

    def _lockstep(self, words: list[str], ids: np.ndarray, out: dict[str, bytes]):
        """Agendas of words of one length side by side: in every step each takes its best pair, leftmost among equals."""
        which = np.arange(len(words))
        rank, piece = self._joint(ids[:, :-1], ids[:, 1:])
        while True:
            width = ids.shape[1]
            if width > 1:
                best = rank.argmin(axis=1)
                done = rank[np.arange(len(ids)), best] == NO_PAIR
            else:
                done = np.ones(len(ids), bool)
            raw, size = ids[done].astype("<u4").tobytes(), 4 * width
            for at, k in enumerate(which[done].tolist()):
                out[words[k]] = raw[at * size:at * size + size]
            if done.all():
                return
            live = ~done
            which, ids, rank, piece, best = which[live], ids[live], rank[live], piece[live], best[live]
            row = np.arange(len(ids))
            ids[row, best] = piece[row, best]
            place = np.arange(width - 1)
            ids = np.take_along_axis(ids, place + (place > best[:, None]), axis=1)
            place = np.arange(width - 2)
            kept = place + (place >= best[:, None])
            rank, piece = np.take_along_axis(rank, kept, axis=1), np.take_along_axis(piece, kept, axis=1)
            for side in (best - 1, best):
                ok = (side >= 0) & (side < width - 2)
                r, c = row[ok], side[ok]
                rank[r, c], piece[r, c] = self._joint(ids[r, c], ids[r, c + 1])

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words: short ones in lockstep by length, others by a heap each."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word) if len(word) <= LOCKSTEP else 0, []).append(word)
        for length, group in by_length.items():
            if length and not self.unused:
                codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)
                ids = self.character[codes]
                plain = (ids >= 0).all(axis=1)
                self._lockstep([w for w, ok in zip(group, plain.tolist(), strict=True) if ok], ids[plain], out)
                group = [w for w, ok in zip(group, plain.tolist(), strict=True) if not ok]
            for word in group:
                out[word] = np.array(self.word_ids(word), "<u4").tobytes()
        return out

    def encode(self, texts: list[str], check: str) -> list[bytes]:
        """Ids of texts with begin and end, as little-endian unsigned 32-bit numbers, checked against the library."""
        words = [self.words.findall(self.library.normalize(t)) for t in texts]
        known = self.known
        fresh = self.encode_words(list({w: None for one in words for w in one if w not in known}))
        known.update(fresh)
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        out = [b"".join([begin, *map(known.__getitem__, one), end]) for one in words]
        if check == "texts":
            self._check_texts(texts, out)
        else:
            self._check_words(fresh)
        if len(known) > WORDS:
            known.clear()
        else:
            for word in fresh:
                if len(word) > WORD_CHARS:
                    del known[word]
        return out

    # ------------------------------------------------------------ decoding
    def decode(self, ids: list[int]) -> str:
        """Text of the ids: pieces joined, blank marks to blanks, bytes to characters, the first blank mark dropped."""
        surface, byte_at = self.surface, self.byte_at
        if not byte_at or byte_at.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in byte_at:
                    run.append(byte_at[i])
                    continue
                if run:
                    out.append(_characters(run))
                    run.clear()
                out.append(surface[i])
            text = "".join((*out, _characters(run)))
        first = next((self.pieces[i] for i in ids if not self.library.is_control(i)), "")
        return text[1:] if first.startswith(MARK) else text

    # ------------------------------------------------------------ the library
    def _check_words(self, fresh: dict[str, bytes]):
        """The library's ids of the new words, joined to one text; a word without a blank mark follows a lone character."""
        if self.between is None:
            raise ValueError("the vocabulary leaves no lone character to check words with; check texts instead")
        mark, lone = (np.array(self.word_ids(w), "<u4").tobytes() for w in (MARK, self.between))
        words = list(fresh)
        groups = [words[k:k + 500] for k in range(0, len(words), 500)]
        joined = ["".join([self.between + w for w in group]) for group in groups]
        for group, there in zip(groups, self.library.encode(joined, num_threads=1), strict=True):
            own = b"".join([mark, *(lone + fresh[w] for w in group)])
            if own != np.array(there, "<u4").tobytes():
                wrong = (w for w in group if np.array(self.library.encode(self.between + w), "<u4").tobytes() != mark + lone + fresh[w])
                raise ValueError(f"ids differ from the library: {next(wrong, group[0])[:80]!r}")

    def _check_texts(self, texts: list[str], ids: list[bytes]):
        for text, own, there in zip(texts, ids, self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1), strict=True):
            if own != np.array(there, "<u4").tobytes():
                raise ValueError(f"ids differ from the library: {text[:80]!r}")

    def check_decoded(self, ids: list[list[int]], decoded: list[str]):
        for own, there in zip(decoded, self.library.decode(ids, num_threads=1), strict=True):
            if own != there:
                raise ValueError(f"decoded text differs from the library: {own[:80]!r}")


def _characters(raw: bytearray) -> str:
    """UTF-8 bytes as text; each byte that is part of no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        text, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    text.append(raw[at:at + size].decode())
                    break
                except UnicodeDecodeError:
                    size = 0
            else:
                text.append("�")
            at += max(size, 1)
        return "".join(text)


def _pieces_of(batches, size: int):
    """Slices of Arrow batches with about ``size`` bytes of text, so that a worker holds few texts as objects at a time."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _coded(path: str, check: str, finish):
    """Arrow batches of (id, text) -> what ``finish`` makes of (id, raw ids, ids, decoded)."""
    def run(batches):
        codec = Codec(path)
        for batch in _pieces_of(batches, SLICE_BYTES):
            raw = codec.encode([t or "" for t in batch.column(1).to_pylist()], check)
            ids = [np.frombuffer(r, "<u4").tolist() for r in raw]
            decoded = [codec.decode(i) for i in ids]
            codec.check_decoded(ids, decoded)
            yield finish(batch.column(0), raw, ids, decoded)
    return run


def _whole(keys, raw, ids, decoded):
    lists = pa.array(ids, pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([keys, lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])


def _digests(keys, raw, ids, decoded):
    return pa.RecordBatch.from_arrays(
        [keys, pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
         pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _run(docs: DataFrame, id_col, text_col, path, check, finish, schema) -> DataFrame:
    if check not in ("words", "texts"):
        raise ValueError(f"unknown check '{check}', expected words or texts")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return keyed.mapInArrow(_coded(path or model_path(), check, finish), schema)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 check: str = "words") -> DataFrame:
    """``(doc_id, ids array<int>, decoded)`` per row: ids with begin and end, and the text they decode to.

    A null text is an empty one: begin and end alone, decoded empty.  Null ids
    stay null, repeated rows are coded each, an empty table gives no rows, other
    columns are not read.  Texts of any length are coded whole.  No shuffle.
    """
    return _run(docs, id_col, text_col, path, check, _whole, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  check: str = "words") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``encode_texts``, digested where they are made."""
    return _run(docs, id_col, text_col, path, check, _digests,
                "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark, sf_dir):
    """Contract query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return token_digests(read_documents(spark, sf_dir))
