"""Language-model scores of texts: the marginal likelihood of all their segmentations into subwords.

The pieces of an existing vocabulary file are symbols drawn independently, and an end symbol closes a
text. A word is a space sign with the word behind it; no piece holds a space sign behind another
character, so a text's probability is the product of its words' and the end's, and a word's is the sum
over all paths through its lattice of pieces, by a forward recursion in log space. A character
without a piece of its own is spelled in byte pieces.

The file's scores are the starting weights: log probabilities where the file is a unigram model, ranks
(weight 1 / (2 + rank)) where it is a BPE model. ``rounds`` of expectation maximisation, forward and
backward, fit them to the words of the training texts, each word once with its count. Tasks sum expected
counts by piece, so a round sends the vocabulary's size for each task, whatever the corpus.

Counts and word scores stay a Spark table of all words. The most frequent words (HOT_WORDS at most,
chosen by a histogram of counts) are broadcast and cover most tokens, so no hot word is shuffled;
occurrences of all others are joined with the table by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.session import cut_lineage

SPACE_SIGN = "▁"
MODULUS, REMAINDER = 7, 2
ROUNDS = 2
PRIOR = 0.1  # added to each piece's expected count
HOT_WORDS = 200_000
CHUNK_LETTERS = 150_000
FILTER_BITS = 20
LN10 = float(np.log(10.0))
U = np.uint64


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % MODULUS == REMAINDER


def point_hash(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of code points."""
    up, down = tx.powers(len(points) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(points) + 1, U)
        np.cumsum(tx.mix(points.astype(U) + U(1)) * up[: len(points)], out=sums[1:])
        return tx.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Vocabulary:
    """The pieces of a model file that can lie inside a word, and weights for them.

    ``log_p`` has a natural-log probability for every id of the file and, last, for the end symbol.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        text = [lib.id_to_piece(i) for i in range(size)]
        plain = [not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)) and SPACE_SIGN not in text[i][1:] for i in range(size)]
        self.bytes = np.full(256, -1, np.int64)
        for i in range(size):
            if lib.is_byte(i):
                self.bytes[int(text[i][1:-1], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no piece for some byte")
        ids = np.array([i for i in range(size) if plain[i]], np.int64)
        lengths = np.array([len(text[i]) for i in ids], np.int64)
        ends = np.cumsum(lengths)
        hashes = point_hash(code_points("".join(text[i] for i in ids)), ends - lengths, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        self.longest = int(lengths.max())
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.hashes >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        self.live = np.zeros(size + 1, bool)
        self.live[ids] = self.live[self.bytes] = self.live[size] = True
        scores = np.array([lib.get_score(i) for i in range(size)])
        # a unigram model's scores are log probabilities, which fractions tell from ranks
        ranked = bool((scores == np.round(scores)).all())
        weight = 1.0 / (2.0 - np.minimum(scores, 0)) if ranked else np.exp(scores)
        self.log_p = self.normal(np.append(weight, weight[ids].mean()))

    def normal(self, weight: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(np.where(self.live, weight, 0.0) / weight[self.live].sum())


class Lattice:
    """All pieces of the words of a list, as edges between flat nodes (a word of n characters has n + 1)."""

    def __init__(self, words: list[str], v: Vocabulary) -> None:
        self.v = v
        points = code_points("".join(SPACE_SIGN + w for w in words)).copy()
        length = np.array([len(w) + 1 for w in words], np.int64)
        self.first_node = np.cumsum(length + 1) - (length + 1)
        self.last_node = self.first_node + length
        start = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(points)) - start[owner]
        inner = np.flatnonzero((points == ord(SPACE_SIGN)) & (place > 0))
        looked_up = points.copy()
        looked_up[inner] = 0x110000  # a space sign of the word itself is no start of a word: spelled in bytes
        left = length[owner] - place
        froms, tos, pieces = [], [], []
        whole = np.zeros(len(points), bool)
        i = np.arange(len(points))
        up, down = tx.powers(len(points) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(points) + 1, U)
            np.cumsum(tx.mix(looked_up.astype(U) + U(1)) * up[: len(points)], out=sums[1:])
            for k in range(1, v.longest + 1):
                i = i[left[i] >= k]
                if not len(i):
                    break
                h = tx.mix((sums[i + k] - sums[i]) * down[i] + U(k))
                likely = np.flatnonzero(v.maybe[(h >> U(64 - FILTER_BITS)).astype(np.int64)])
                at = np.minimum(np.searchsorted(v.hashes, h[likely]), len(v.hashes) - 1)
                hit = v.hashes[at] == h[likely]
                s, at = i[likely[hit]], at[hit]
                if k == 1:
                    whole[s] = True
                node = self.first_node[owner[s]] + place[s]
                froms.append(node)
                tos.append(node + k)
                pieces.append(v.ids[at])
        # characters without a piece: the piece number is -1 - (index into ``spelled``)
        bare = np.flatnonzero(~whole)
        self.spelled = [v.bytes[list(chr(p).encode("utf-8", "surrogatepass"))] for p in points[bare].tolist()]
        node = self.first_node[owner[bare]] + place[bare]
        self.start = np.concatenate([*froms, node]).astype(np.int64)
        self.end = np.concatenate([*tos, node + 1]).astype(np.int64)
        self.piece = np.concatenate([*pieces, -1 - np.arange(len(bare))]).astype(np.int64)
        self.n_nodes = int((length + 1).sum())
        self.depth = np.arange(self.n_nodes) - np.repeat(self.first_node, length + 1)

    def edge_scores(self, log_p: np.ndarray) -> np.ndarray:
        out = log_p[np.maximum(self.piece, 0)]
        bare = self.piece < 0
        if bare.any():
            spelled = np.array([log_p[b].sum() for b in self.spelled])
            out[bare] = spelled[-1 - self.piece[bare]]
        return out

    def sums(self, score: np.ndarray, a: np.ndarray, b: np.ndarray, origin: np.ndarray, step: int) -> np.ndarray:
        """Log of the summed weight of all paths from ``origin`` nodes to each node, over edges a -> b."""
        out = np.full(self.n_nodes, -np.inf)
        out[origin] = 0.0
        order = np.lexsort((b, step * self.depth[b]))
        a, b, score = a[order], b[order], score[order]
        depth = self.depth[b]
        cuts = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1]])) if len(b) else np.zeros(0, np.int64)
        groups = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else cuts
        of_group = np.searchsorted(groups, np.append(cuts, len(b)))
        for k, lo in enumerate(cuts.tolist()):
            hi = int(cuts[k + 1]) if k + 1 < len(cuts) else len(b)
            g = groups[of_group[k] : of_group[k + 1]]
            out[b[g]] = np.logaddexp.reduceat(out[a[lo:hi]] + score[lo:hi], g - lo)
        return out

    def forward(self, score: np.ndarray) -> np.ndarray:
        return self.sums(score, self.start, self.end, self.first_node, 1)

    def log_likelihood(self) -> np.ndarray:
        """The natural log of each word's probability."""
        return self.forward(self.edge_scores(self.v.log_p))[self.last_node]

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words, each ``counts`` times."""
        score = self.edge_scores(self.v.log_p)
        ahead = self.forward(score)
        back = self.sums(score, self.end, self.start, self.last_node, -1)
        word = np.searchsorted(self.first_node, self.start, "right") - 1
        share = np.exp(ahead[self.start] + score + back[self.end] - ahead[self.last_node[word]]) * counts[word]
        out = np.zeros(len(self.v.log_p))
        known = self.piece >= 0
        out += np.bincount(self.piece[known], weights=share[known], minlength=len(out))
        for j, n in zip((-1 - self.piece[~known]).tolist(), share[~known].tolist(), strict=True):
            np.add.at(out, self.spelled[j], n)
        return out


def text_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, word hashes and words of each text."""
    data, offsets = tx.flat(part.column("text"))
    data = tx.LOWER[data]
    start, end, counts = tx.word_spans(data, offsets)
    return data, start, end, tx.span_hash(data, start, end), counts


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n): uses of every word in training texts and in all, of (text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                data, start, end, hashes, counts = text_words(part)
                _, first, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                train = ~np.repeat(part.column("held_out").to_numpy(zero_copy_only=False), counts)
                c = np.bincount(which, weights=train, minlength=len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([tx.span_texts(data, start[first], end[first]), pa.array(c), pa.array(n.astype(np.int64))], names=["word", "c", "n"])

    parts = rows.mapInArrow(run, "word string, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def lattices(batch: pa.RecordBatch, v: Vocabulary) -> Iterator[tuple[pa.RecordBatch, Lattice]]:
    for part in tx.pieces(batch, "word", CHUNK_LETTERS):
        yield part, Lattice(part.column("word").to_pylist(), v)


def fitted(words: DataFrame, v: Vocabulary, n_ends: int, rounds: int = ROUNDS, prior: float = PRIOR) -> Vocabulary:
    """``v`` with weights fitted to the training ``words`` (word, c) and ``n_ends`` text ends."""
    spark = words.sparkSession
    known = words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v = shared.value
            total = np.zeros(len(v.log_p))
            for batch in batches:
                for part, lattice in lattices(batch, v):
                    total += lattice.expected(part.column("c").to_numpy().astype(float))
            piece = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": piece, "n": total[piece]})

        sums = known.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.full(len(v.log_p), prior)
        for r in sums.collect():  # a number for each piece of the vocabulary at most
            expected[r["piece"]] += r["n"]
        expected[-1] += n_ends
        v.log_p = v.normal(expected)
    return v


def word_scores(words: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, hash, c, n, log_c, log_m): log10 of c + 1 and of the word's probability."""
    shared = words.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lattice in lattices(batch, shared.value):
                data, offsets = tx.flat(part.column("word"))
                hashes = tx.span_hash(data, offsets[:-1], offsets[1:])
                c = part.column("c").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("word"), pa.array(hashes.view(np.int64)), part.column("c"), part.column("n"),
                        pa.array(np.log10(c + 1.0)), pa.array(lattice.log_likelihood() / LN10),
                    ],
                    names=["word", "hash", "c", "n", "log_c", "log_m"],
                )

    return words.mapInArrow(run, "word string, hash long, c long, n long, log_c double, log_m double")


def hot_words(scores: DataFrame, most: int) -> tuple[np.ndarray, ...]:
    """(hash, known, log_c, log_m) of the most frequent words, by hash; all with a count above a cut."""
    step = F.floor(F.log2("n") * 4).cast("int")
    cut, total = None, 0
    for r in sorted(scores.groupBy(step.alias("step")).count().collect(), reverse=True):  # a row for each step
        if total + r["count"] > most:
            break
        cut, total = r["step"], total + r["count"]
    if cut is None:
        return np.zeros(0, U), np.zeros(0, bool), *[np.zeros(0)] * 2
    rows = scores.where(step >= cut).select("hash", F.col("c") > 0, "log_c", "log_m").toArrow()
    hashes, *rest = [c.to_numpy() for c in rows.columns]
    order = np.argsort(hashes.view(U))
    return hashes.view(U)[order], *[c[order] for c in rest]


def text_sums(rows: DataFrame, hot: tuple[np.ndarray, ...]) -> DataFrame:
    """(id, version, word, n, known, log_c, log_m): sums over a text's hot words, and a row for each other word of it.

    The row with the sums has a ``word`` of its own with a space, which no word holds, so it meets none in a join
    and no task gets all such rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot)
    schema = "id long, version long, word string, n long, known long, log_c double, log_m double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, *logs = shared.value
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                data, start, end, own, counts = text_words(part)
                owner = np.repeat(np.arange(part.num_rows), counts)
                at = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
                hit = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
                at, of = at[hit], owner[hit]
                rest = np.flatnonzero(~hit)
                add = lambda w: np.bincount(of, weights=w[at], minlength=part.num_rows)
                version = part.column("version")
                marks = pa.array([f" {x}" for x in version.to_pylist()], pa.string())
                which = pa.array(np.concatenate([np.arange(part.num_rows), owner[rest]]))
                zero, nought = np.zeros(len(rest)), np.zeros(len(rest), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(which),
                        version.take(which),
                        pa.concat_arrays([marks, tx.span_texts(data, start[rest], end[rest])]),
                        pa.array(np.concatenate([counts, nought]).astype(np.int64)),
                        pa.array(np.concatenate([add(known.astype(float)).astype(np.int64), nought])),
                        *[pa.array(np.concatenate([add(w), zero])) for w in logs],
                    ],
                    names=["id", "version", "word", "n", "known", "log_c", "log_m"],
                )

    return rows.mapInArrow(run, schema)


def lattice_scores(
    docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS, prior: float = PRIOR, hot: int = HOT_WORDS
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Counts and weights come from rows that are not held out. Null and empty texts have the end alone; equal rows
    train each and get a row each; rows of one id with different texts are told apart by xxhash64 of the text. An
    empty table, or one without training rows, leaves the file's weights with ``prior``. Very long words cost a
    step for each character. Other columns are not read, whatever their names.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.col(f"`{id_col}`")
    rows = docs.select(key.cast("long").alias("id"), F.xxhash64(t).alias("version"), held_out(key).alias("held_out"), t.alias("text"))
    words = cut_lineage(word_counts(rows.select("held_out", "text")))
    ends = rows.where("NOT held_out").count()
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n_train, distinct = seen[0] + ends, seen[1] + (1 if ends else 0)
    v = fitted(words, Vocabulary(model), ends, rounds, prior)
    scores = cut_lineage(word_scores(words, v))
    found = text_sums(rows.select("id", "version", "text"), hot_words(scores, hot))
    table = scores.select("word", "c", F.col("log_c").alias("own_c"), F.col("log_m").alias("own_m"))
    first = F.startswith("word", F.lit(" "))
    sums = found.join(table, "word", "left").groupBy("id", "version").agg(
        F.count(F.when(first, 1)).alias("copies"),
        F.sum("n").alias("n"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, 1).otherwise(0)).alias("known"),
        F.sum(F.col("log_c") + F.coalesce("own_c", F.lit(0.0))).alias("log_c"),
        F.sum(F.col("log_m") + F.coalesce("own_m", F.lit(0.0))).alias("log_m"),
    )
    n_tokens = (F.expr("n div copies") + 1).cast("long")
    n_known = (F.expr("known div copies") + (1 if ends else 0)).cast("long")
    base = F.col("log_c") / F.col("copies") + float(np.log10(ends + 1.0)) - n_tokens * float(np.log10(n_train + distinct + 1.0))
    each = sums.select(
        F.col("id").alias("of"),
        F.col("version").alias("at"),
        n_tokens.alias("n_tokens"),
        n_known.alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("log_m") / F.col("copies") + float(v.log_p[-1] / LN10)).alias("score"),
    )
    own = rows.select("id", "version", "held_out")
    whole = own.join(each, own["id"].eqNullSafe(each["of"]) & (own["version"] == each["at"]))
    return whole.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
