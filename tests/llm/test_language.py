"""Collocations, lattice scores and spelling variants against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tabloom.llm import collocations, lattice, spelling

from .conftest import words_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def id_text(i):
    return "" if i is None else str(i)


# --- collocations ----------------------------------------------------------------------


def phrases_by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = defaultdict(list)
    longer = defaultdict(int)
    for (lang, p), v in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], v)
    for (lang, p), a in f.items():
        if len(p) == 1 or longer[lang, p] >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    found = set()
    for lang, rows_of in out.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            found.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return found


@pytest.mark.parametrize("summary_rows", [4_000_000, 700])
def test_collocations_equal_brute_force(spark, documents, monkeypatch, summary_rows):
    monkeypatch.setattr(collocations, "SUMMARY_ROWS", summary_rows)
    rows = [(r["lang"], r["text"]) for r in documents.select("lang", "text").collect()]
    got = {tuple(r) for r in collocations.collocations(documents, least=20, top=150).collect()}
    assert got == phrases_by_hand(rows, 20, 150) and len(got) > 100


def test_collocations_of_odd_rows(spark, odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()]
    got = {tuple(r) for r in collocations.collocations(odd, least=2, top=50).collect()}
    assert got == phrases_by_hand(rows, 2, 50) and got
    assert collocations.collocations(empty).count() == 0


def test_summaries_keep_every_frequent_key():
    """Cut and merged summaries: a count and what its partition lost are never below the true count."""
    rng = np.random.default_rng(3)
    key_of = collocations.tx.mix(np.arange(1, 40_001, dtype=np.uint64))
    stream = key_of[np.minimum(rng.zipf(1.2, 300_000), 40_000) - 1]
    slot = (stream >> np.uint64(64 - collocations.SLOT_BITS)).astype(int)
    capacity = np.bincount(slot, minlength=1 << collocations.SLOT_BITS) // 50 + 1
    lost = np.zeros(len(capacity), np.int64)
    state = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in np.array_split(stream, 12):
        own = np.unique(part, return_counts=True)
        small = collocations.cut_to(*own, capacity, lost)
        both = collocations.summed(np.concatenate([state[0], small[0]]), np.concatenate([state[1], small[1]]))
        state = collocations.cut_to(*both, capacity, lost)
    held = dict(zip(state[0].tolist(), state[1].tolist()))
    assert lost.sum() > 0 and (np.bincount((state[0] >> np.uint64(52)).astype(int), minlength=4096) <= capacity).all()
    for key, n in Counter(stream.tolist()).items():
        bound = held.get(key, 0) + lost[key >> (64 - collocations.SLOT_BITS)]
        assert bound >= n if key in held else lost[key >> (64 - collocations.SLOT_BITS)] >= n
        if n >= 50:
            assert key in held and held[key] <= n


def test_a_small_bitmap_changes_nothing(spark, documents, monkeypatch):
    want = {tuple(r) for r in collocations.collocations(documents, least=25, top=60).collect()}
    monkeypatch.setattr(collocations, "MOST_BITS", 15)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 50)
    monkeypatch.setattr(collocations, "MOST_HELD", 400)
    monkeypatch.setattr(collocations, "MERGE_ROWS", 100)
    assert {tuple(r) for r in collocations.collocations(documents, least=25, top=60).collect()} == want


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame(
        [("x", "a", 3_000_000_019), ("x", "b", 3_000_000_021), ("x", "a b", 2_999_999_999)], "lang string, phrase string, f long"
    ).selectExpr("*", "split(phrase, ' ') AS words")
    totals = spark.createDataFrame([("x", 9_000_000_000_000_007)], "lang string, n long")
    row = collocations.scored(found, totals).first()
    assert row["score"] == 1000 * 2_999_999_999 * 9_000_000_000_000_007 // (3_000_000_019 * 3_000_000_021)


# --- lattice scores --------------------------------------------------------------------


def all_paths(word, p):
    """Sums over segmentations by plain recursion: ``p`` maps pieces to probabilities, bytes to bytes' ones."""
    s = [lattice.SPACE_SIGN, *word]

    def char(i):
        c = s[i]
        return None if c == lattice.SPACE_SIGN and i else c

    total = [1.0] + [0.0] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - 40), end):
            chars = [char(i) for i in range(start, end)]
            if None not in chars and "".join(chars) in p:
                total[end] += total[start] * p["".join(chars)]
        c = char(end - 1)
        if c is None or c not in p:
            total[end] += total[end - 1] * math.prod(p[b] for b in s[end - 1].encode("utf-8", "surrogatepass"))
    return total[-1]


def weights(v):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    p = {lib.id_to_piece(i): math.exp(v.log_p[i]) for i in v.ids.tolist()}
    return p | {b: math.exp(v.log_p[i]) for b, i in enumerate(v.bytes.tolist())}


def test_marginals_equal_plain_recursion():
    v = lattice.Vocabulary(MODEL)
    words = ["the", "international", "é", "日本語", "a▁b", "", "😀x", "zzzzzzzz", "\x00q"]
    got = lattice.Lattice(words, v).log_likelihood()
    p = weights(v)
    for word, value in zip(words, got):
        assert value == pytest.approx(math.log(all_paths(word, p)), rel=1e-9)
    assert math.isclose(np.exp(v.log_p[v.live]).sum(), 1.0)
    # very long words stay finite
    assert np.isfinite(lattice.Lattice(["x" * 30_000], v).log_likelihood()).all()


def test_expected_counts_equal_finite_differences():
    """An expected count is the derivative of the log likelihood by the piece's log probability."""
    v = lattice.Vocabulary(MODEL)
    words, counts = ["there", "日本語q", "ing"], np.array([3.0, 1.0, 2.0])
    own = lattice.Lattice(words, v).expected(counts)
    before = v.log_p.copy()
    for piece in np.argsort(-own)[:12].tolist():
        values = []
        for step in (1e-5, -1e-5):
            v.log_p = before.copy()
            v.log_p[piece] += step
            values.append((lattice.Lattice(words, v).log_likelihood() * counts).sum())
        assert own[piece] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-4, abs=1e-6)


def base_by_hand(rows):
    train = [words_of(t) for i, t in rows if zlib.crc32(id_text(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    total, distinct = sum(c.values()) + len(train), len(c) + bool(train)
    out = Counter()
    for i, t in rows:
        w = words_of(t)
        n = [c[x] for x in w] + [len(train)]
        base = sum(math.log10((x + 1) / (total + distinct + 1)) for x in n)
        out[i, zlib.crc32(id_text(i).encode()) % 7 == 2, len(n), sum(x > 0 for x in n), total, round(base, 4)] += 1
    return out


def rounded(rows):
    return Counter((*r[:5], round(r[5], 4)) for r in rows)


@pytest.mark.parametrize("hot", [lattice.HOT_WORDS, 40, 0])
def test_base_scores_equal_brute_force(spark, documents, hot):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = lattice.lattice_scores(documents, MODEL, rounds=0, hot=hot).collect()
    assert rounded(got) == base_by_hand(rows)


def test_scores_are_sums_over_words(spark, documents):
    """Fitted by hand in plain Python over the same words, two rounds."""
    few = documents.where("doc_id < 12").cache()
    rows = [(r["doc_id"], r["text"]) for r in few.select("doc_id", "text").collect()]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in words_of(t))
    v = lattice.Vocabulary(MODEL)
    first = v.log_p.copy()
    words = sorted(c)
    for _ in range(lattice.ROUNDS):
        got = lattice.Lattice(words, v).expected(np.array([float(c[w]) for w in words])) + lattice.PRIOR
        got[-1] += len(train)
        v.log_p = v.normal(got)
    p = weights(v)
    cache = {w: math.log10(all_paths(w, p)) for t in rows for w in words_of(t[1])}
    want = {i: sum(cache[w] for w in words_of(t)) + v.log_p[-1] / math.log(10) for i, t in rows}
    got = {r["doc_id"]: r["score"] for r in lattice.lattice_scores(few, MODEL, hot=30).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    # fitting helps on texts that it has not seen
    v.log_p = first
    start = {r["doc_id"]: r["score"] for r in lattice.lattice_scores(few, MODEL, rounds=0).collect()}
    unseen = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    assert unseen and sum(got[i] for i in unseen) > sum(start[i] for i in unseen)


def test_lattice_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = lattice.lattice_scores(odd, MODEL, rounds=1, hot=10).collect()
    assert rounded(got) == base_by_hand(rows) and len(got) == len(rows)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lattice.lattice_scores(empty, MODEL).count() == 0


# --- spelling --------------------------------------------------------------------------


def variants_by_hand(rows, least_length=7, least_count=2, ratio=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{id_text(i)}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        if len(b) != len(a) + 1:
            return False
        k = next((j for j, x in enumerate(a) if x != b[j]), len(a))
        return a[k:] == b[k + 1 :]

    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_variants_equal_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling.spelling_variants(documents).collect()}
    assert got == variants_by_hand(rows)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("symbols", [1, 2, 5, 30])
def test_any_number_of_symbols_finds_all_pairs(spark, symbols):
    """Chains of forms, ties, letters beyond ASCII and words that only inserts and deletions tell apart."""
    counts = {"letterss": 2000, "letters": 200, "lettrs": 20, "lettrz": 2, "aaaaaaa": 3, "aaaaaaaa": 30, "aaaaaaaaa": 300,
              "écolièrs": 5, "écoliers": 50, "ecoliers": 50, "spellings": 7, "spellingx": 7, "spelling": 70, "spellin": 6}
    docs = spark.createDataFrame([(10**6 + i, w) for i, (w, k) in enumerate(counts.items()) for _ in range(k)], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for least in (6, 7):
        got = {tuple(r) for r in spelling.spelling_variants(docs, symbols=symbols, least_length=least).collect()}
        assert got == variants_by_hand(rows, least_length=least)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_neighbourhoods_are_whole_and_without_repeats():
    words = ["aabab", "b", "aaa"]
    symbols = 2
    reduced = spelling.Reduced(words, symbols)
    own = reduced.own()
    found = defaultdict(list)
    for w, h in reduced.neighbours():
        for i, x in zip(w.tolist(), h.tolist()):
            found[i].append(x)
    start = reduced.start
    for i, word in enumerate(words):
        s = tuple(reduced.symbol[start[i] : start[i] + len(word)].tolist())
        want = {s}
        for j in range(len(s) + 1):
            want |= {s[:j] + (c,) + s[j:] for c in range(symbols)}
            if j < len(s):
                want |= {s[:j] + s[j + 1 :]} | {s[:j] + (c,) + s[j + 1 :] for c in range(symbols)}
        assert len(found[i]) == len(set(found[i])) == len(want) and own[i] in found[i]


def test_variants_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling.spelling_variants(odd).collect()}
    assert got == variants_by_hand(rows) and got
    long = spark.createDataFrame([(1, "ab" * 8000), (3, "ab" * 8000), (4, "ab" * 8000 + "c"), (5, "ab" * 8000 + "c")], "doc_id long, text string")
    assert {r["n_near"] for r in spelling.spelling_variants(long).collect()} <= {0, 1}
    assert spelling.spelling_variants(empty).count() == 0
