"""SentencePiece encoding and decoding by vectorised merge rounds.

The vocabulary is read from a model of the BPE kind with byte fallback, identity normalisation and
a dummy prefix. No piece holds a space sign behind another character, so merges never cross the
start of a word (spaces with what follows them) and every distinct word is encoded once. The words
new to a batch are one flat array of symbols: a round looks up the rank of every neighbouring pair,
finds the best pair of each word (the leftmost among equals) by a segmented minimum, merges it in all
words at once and drops the symbols merged away; words without a pair left leave the array. Very long
words, for which rounds would be quadratic, go through a priority queue in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LONG_WORD = 200
CACHED_WORDS = 400_000
NONE = np.int64(1) << 40


class Vocabulary:
    """Pieces, merge ranks and byte ids of a model file."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(self.size) if lib.is_byte(i)}
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(self.size)]
        self.value = {v: k for k, v in self.bytes.items()}
        self.silent = {i for i in range(self.size) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        self.code = {p: i for i, p in enumerate(self.text) if not special[i]}
        whole = dict(self.code)
        for p in whole:  # characters that only occur inside pieces take part in merges too
            for c in p:
                self.code.setdefault(c, len(self.code) + self.size)
        if any(SPACE in p.lstrip(SPACE) for p in whole):
            raise ValueError("pieces with a space sign behind another character cross words")
        self.by_point = -1 - np.arange(0x110000, dtype=np.int64)  # -1 - code point for a character that no piece holds
        for c, i in self.code.items():
            if len(c) == 1:
                self.by_point[ord(c)] = i
        self.number = [str(i) for i in range(self.size)]
        self.plain = [None if b else p.replace(SPACE, " ") for p, b in zip(self.text, special, strict=True)]
        scores = np.array([lib.get_score(i) for i in range(self.size)])
        order = {s: r for r, s in enumerate(sorted({-s for s in scores.tolist()}))}
        rows = sorted(
            (self.code[p[:k]] << 32 | self.code[p[k:]], order[-scores[i]], i)
            for p, i in whole.items()
            for k in range(1, len(p))
            if p[:k] in self.code and p[k:] in self.code
        )
        self.pairs = np.array([r[0] for r in rows] or [-1], np.int64)
        self.ranks = np.array([r[1] for r in rows] or [0], np.int64)
        self.merged = np.array([r[2] for r in rows] or [0], np.int64)
        lines = "" if any("\n" in p for p in whole) else "\n"
        self.words = re.compile(f"{lines}|{SPACE}+[^{SPACE}{lines}]*|[^{SPACE}{lines}]+" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such piece) and merged piece of symbol pairs."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NONE), self.merged[at]

    def ids(self, symbols: list[int], chars: dict[int, str]) -> list[int]:
        """Piece ids of final symbols; what is no piece is spelled in bytes."""
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
                continue
            for b in (chr(-1 - s) if s < 0 else chars[s]).encode():
                out.append(self.bytes.get(b, self.unknown))
        return out

    def merge_rounds(self, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of words given as one array with their lengths, and the final lengths."""
        owner = np.repeat(np.arange(len(counts)), counts)
        rank, merged = self.rank(symbol, np.append(symbol[1:], -1))
        rank[np.cumsum(counts) - 1] = NONE  # a word's last symbol has no partner
        done_symbol, done_owner = [], []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            length = np.diff(np.append(starts, len(symbol)))
            place = np.arange(len(symbol)) - np.repeat(starts, length)
            best = np.minimum.reduceat(rank << 20 | place, starts)
            live = best < (NONE << 20)
            going = np.repeat(live, length)
            done_symbol.append(symbol[~going])
            done_owner.append(owner[~going])
            spot = (starts + (best & 0xFFFFF))[live]
            symbol[spot] = merged[spot]
            rank[spot] = rank[spot + 1]  # NONE if the word ends here; else looked up anew below
            going[spot + 1] = False
            now = (np.cumsum(going) - 1)[spot]
            symbol, owner, rank, merged = symbol[going], owner[going], rank[going], merged[going]
            changed = np.concatenate([now, now[now > 0] - 1])
            changed = changed[changed < len(symbol) - 1]
            inside = owner[changed] == owner[changed + 1]
            rank[changed[~inside]] = NONE
            changed = changed[inside]
            rank[changed], merged[changed] = self.rank(symbol[changed], symbol[changed + 1])
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        return symbol[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(counts))

    def merge_queue(self, symbols: list[int]) -> list[int]:
        """The same for one long word: best rank first, leftmost among equals."""
        symbol, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        whole = np.array(symbols, np.int64)
        rank, merged = self.rank(whole[:-1], whole[1:])
        queue = [(r, i, symbol[i], symbol[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), merged.tolist(), strict=True)) if r < NONE]
        heapq.heapify(queue)
        gone = [False] * n
        while queue:
            _, i, left, right, piece = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], gone[j], after[i] = piece, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    r, m = self.pair(symbol[a], symbol[b])
                    if r < NONE:
                        heapq.heappush(queue, (r, a, symbol[a], symbol[b], m))
        return [s for s, g in zip(symbol, gone, strict=True) if not g]

    def pair(self, left: int, right: int) -> tuple[int, int]:
        if left < 0 or right < 0:
            return int(NONE), 0
        key = left << 32 | right
        at = int(np.searchsorted(self.pairs, key))
        known = at < len(self.pairs) and self.pairs[at] == key
        return (int(self.ranks[at]), int(self.merged[at])) if known else (int(NONE), 0)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        counts = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        symbol = self.by_point[points]
        rare = np.flatnonzero(symbol >= self.size)
        chars = {c: chr(p) for c, p in zip(symbol[rare].tolist(), points[rare].tolist(), strict=True)}
        long = np.flatnonzero(counts > LONG_WORD)
        first = np.cumsum(counts) - counts
        if len(long):
            short = np.repeat(counts <= LONG_WORD, counts)
            flat, sizes = self.merge_rounds(symbol[short], np.where(counts > LONG_WORD, 0, counts)[counts <= LONG_WORD])
        else:
            flat, sizes = self.merge_rounds(symbol, counts)
        odd = (flat < 0) | (flat >= self.size)
        ends = np.cumsum(sizes)
        strange = np.add.reduceat(np.append(odd, False), np.append(0, ends[:-1])) > 0 if len(sizes) else np.zeros(0, bool)
        listed = flat.tolist()
        out = [listed[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        for i in np.flatnonzero(strange & (sizes > 0)).tolist():
            out[i] = self.ids(out[i], chars)
        for i in long.tolist():
            out.insert(i, self.ids(self.merge_queue(symbol[first[i] : first[i] + counts[i]].tolist()), chars))
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text with its dummy prefix; an empty text has none."""
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def spell(self, ids: list[int]) -> str:
        """Pieces joined, bytes as UTF-8 (a wrong byte is U+FFFD), space signs as spaces."""
        plain = [self.plain[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(decode_bytes(bytes(raw)))
                raw = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i >= 0 and i not in self.silent:
                out.append(self.text[i].replace(SPACE, " "))
        return "".join(out)


def decode_bytes(raw: bytes) -> str:
    """Complete characters, and U+FFFD for every other byte."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=4)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def encode(texts: list[str], vocab: Vocabulary) -> list[list[int]]:
    """The ids of each text."""
    split = [vocab.split(t) for t in texts]
    words = list(dict.fromkeys(w for s in split for w in s))
    known = dict(zip(words, vocab.encode_words(words), strict=True)) if words else {}
    return [[i for w in s for i in known[w]] for s in split]


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text of ids; the dummy prefix goes."""
    text = vocab.spell(ids)
    first = next((i for i in ids if i not in vocab.silent), None)
    dummy = first is not None and first not in vocab.value and vocab.text[first].startswith(SPACE)
    return text[1:] if dummy else text


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    Null texts count as empty: no ids, an empty decoded text. Rows are independent, so repeated rows
    and null ids just pass, and other columns are not read. ``model`` is a path every executor has.
    A task keeps the words it has met with their ids, up to a fixed number.
    """
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        known: dict[str, tuple[int, str, str]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                split = [vocab.split(t or "") for t in part.column("text").to_pylist()]
                if len(known) > CACHED_WORDS:
                    known = {}
                fresh = list({w for s in split for w in s if w not in known})
                for word, ids in zip(fresh, vocab.encode_words(fresh) if fresh else [], strict=True):
                    known[word] = (len(ids), ",".join([vocab.number[i] for i in ids]), vocab.spell(ids))
                counts, hashes, decoded = [], [], []
                for s in split:
                    found = [known[w] for w in s]
                    counts.append(sum(f[0] for f in found))
                    hashes.append(hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest())
                    # every text starts with the dummy prefix, the first word's first sign
                    decoded.append(hashlib.sha256("".join([f[2] for f in found])[1:].encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return named.mapInArrow(run, "id long, " + RESULT).withColumnRenamed("id", id_col)
