"""N-gram join, paragraph dedup, line chunks and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import fingerprint, line_chunks, links, ngram_join, paragraphs
from tabloom.llm import text as tx

from .conftest import BLOCK, components_of, shingle_set


def test_join_equals_brute_force(documents, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(documents).collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = components_of(sets)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_join_of_odd_rows(odd, empty):
    rows = ngram_join.jaccard_components(odd).collect()
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == odd.count()
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[4] == (1, 4) and by_id[5] == (1, 5)
    assert by_id[6][1] == by_id[7][1] == by_id[8][1] == 6
    assert by_id[10][1] == 9
    assert ngram_join.jaccard_components(empty).count() == 0


def test_chains_without_a_hub_are_joined(spark):
    """Sliding texts: neighbours are similar, the pivot of a group is similar to few."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(1000 - i, " ".join(words[12 * i : 12 * i + 160])) for i in range(80)]
    rows += [(5000 + i, " ".join(words[12 * i : 12 * i + 160][:-60] + [f"other{i}x{j}" for j in range(60)])) for i in range(80)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of({i: shingle_set(t) for i, t in rows})
    assert len({c for i, c in got.items() if i < 5000}) == 1


@pytest.mark.parametrize("percent", [75, 90])
def test_signatures_lose_no_similar_pair(percent):
    draw = np.random.default_rng(5)
    common = np.sort(draw.integers(0, 1 << 63, 50, dtype=np.uint64))
    for size in [3, 4, 7, 15, 16, 21, 40, 255, 256, 300, 700, 4100]:
        for _ in range(30):
            shared = np.concatenate([draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2), common[: size // 3]])
            n = len(shared)
            spare = (100 - percent) * n // percent
            own = int(draw.integers(0, spare + 1))
            a = np.unique(np.concatenate([shared, draw.integers(0, 1 << 63, own, dtype=np.uint64)]))
            b = np.unique(np.concatenate([shared, draw.integers(0, 1 << 63, spare - own, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= percent * (len(a) + len(b) - both)
            if not np.array_equal(a, b):
                assert np.intersect1d(ngram_join.signatures(a, common, percent), ngram_join.signatures(b, common, percent)).size


def test_sets_in_few_partitions_still_meet():
    """Features that all fall into one partition leave only empty signatures to share."""
    a = np.arange(10, 20, dtype=np.uint64)
    b = np.append(np.arange(11, 20, dtype=np.uint64), np.uint64(30))
    assert np.intersect1d(ngram_join.signatures(a, np.zeros(0, np.uint64)), ngram_join.signatures(b, np.zeros(0, np.uint64))).size


def test_sketches_rule_out_no_similar_pair():
    draw = np.random.default_rng(9)
    similar = 0
    for _ in range(300):
        a = np.unique(draw.integers(0, 1 << 63, 400, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(draw.integers(200, 400))], draw.integers(0, 1 << 63, int(draw.integers(0, 60)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            similar += 1
            assert may(a, b, 64)
    assert similar > 20
    for size in (400, 5000, 20_000):  # long sets are told apart as well
        assert not may(*(np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(2)), 256)
    long = np.unique(draw.integers(0, 1 << 63, 1030, dtype=np.uint64))
    assert may(long, long[:1000], 64) and not may(long, long[:700], 64) and len(links.sketch(long, 64)) == 2 * len(links.sketch(long[:1000], 64))


def may(a, b, buckets):
    s, t = (links.Sketches(pa.array([links.sketch(x, buckets)])) for x in (a, b))
    zero = np.zeros(1, np.int64)
    return links.may_be_similar(np.array([len(a)]), np.array([len(b)]), s, zero, t, zero, 75).all()


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_groups_are_compared_whole(spark, monkeypatch, block):
    """Any block size finds the pairs of different labels in every group."""
    monkeypatch.setattr(links, "GROUP_BLOCK", block)
    random.seed(block)
    same, rows, want = bytes([1] * 64), [], set()
    for sig in range(40):
        members = random.sample(range(100), random.choice([2, 3, 7, 20]))
        rows += [(sig, rn, len(members), m, m % 3, 64, same) for rn, m in enumerate(members, 1)]
        want |= {(max(a, b), min(a, b)) for a in members for b in members if a % 3 != b % 3}
    frame = spark.createDataFrame(rows, "sig long, rn int, count long, node long, label long, n long, sketch binary")
    got = links.near_pairs(frame, 75).collect()
    assert {(r["node"], r["rep"]) for r in got} == want and len(got) == len(want)


def test_pairs_inside_runs():
    for limit in (1, 4, 1000):
        got = [(i, j) for a, b in links.pairs_inside(np.array([0, 3, 4]), np.array([3, 1, 4]), limit) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(got) == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]


def test_components_of_chains_and_stars(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(random.randrange(2000, 2100), random.randrange(2000, 2100)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in links.components(spark.createDataFrame(edges, "node long, rep long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_paragraphs_equal_brute_force(documents, texts):
    got = {(r["id"], r["line"]): (r["kept_id"], r["members"], r["removed"]) for r in paragraphs.repeated_paragraphs(documents).collect()}
    sets = {}
    for i, t in texts.items():
        for n, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= paragraphs.LEAST_WORDS:
                sets[i, n] = shingle_set(line)
    comp = components_of(sets)
    members = {}
    for c in comp.values():
        members[c] = members.get(c, 0) + 1
    want = {k: (c[0], members[c], k != c) for k, c in comp.items() if members[c] > 1}
    # a pair right at the threshold shares no band with probability 0.002
    assert set(got) <= set(want) and len(set(want.items()) ^ set(got.items())) <= 0.03 * len(want)


def test_paragraphs_of_odd_rows(odd, empty):
    clean = paragraphs.remove_repeated_paragraphs(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    by_id = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by_id[1] is None and by_id[2] == "" and by_id[13] == "other" and by_id[12].startswith("start here\npassage0")
    assert by_id[7] == "" and by_id[6] != ""
    assert paragraphs.remove_repeated_paragraphs(empty).count() == 0


def test_bands_are_tuned():
    assert paragraphs.tuned(75, 4, 0.997) == 16
    assert 1 - (1 - 0.75**4) ** paragraphs.tuned() >= paragraphs.RECALL


def brute_lines(rows):
    """Ids with texts in order, every chunk dropped that was seen before."""
    seen, out = set(), {}
    for i, t in rows:
        part = pa.RecordBatch.from_pydict({"id": pa.array([i]), "version": pa.array([0]), "text": pa.array([t])})
        lines, gone = t.split("\n"), set()
        for c in line_chunks.chunk_batch(part).to_pylist():
            span = range(c["first_line"], c["first_line"] + c["n_lines"])
            body = "\n".join(lines[n] for n in span)
            gone |= set(span) if body in seen else set()
            seen.add(body)
        out[i] = "\n".join(line for n, line in enumerate(lines) if n not in gone)
    return out


def test_line_chunks_equal_brute_force(documents, texts):
    got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeated_lines(documents).collect()}
    assert got == brute_lines(sorted(texts.items()))


def test_line_chunks_of_odd_rows(odd, empty):
    clean = line_chunks.remove_repeated_lines(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    by_id = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by_id[1] is None and by_id[2] == "" and by_id[3] == " \n\t "
    assert by_id[14] == BLOCK + "\nown tail of this text" and len(by_id[15]) < len("own head\n" + BLOCK)
    assert line_chunks.remove_repeated_lines(empty).count() == 0


def test_chunks_resist_shifts():
    lines = [f"line number {i * i}" for i in range(200)]
    chunks = lambda ls: {tuple(ls[c["first_line"] : c["first_line"] + c["n_lines"]]) for c in line_chunks.chunk_batch(pa.RecordBatch.from_pydict({"id": pa.array([1]), "version": pa.array([1]), "text": pa.array(["\n".join(ls)])})).to_pylist()}
    before, after = chunks(lines), chunks(["new first line", *lines])
    assert len(before & after) >= len(before) - 4


def test_chunk_lengths_are_bounded():
    places = line_chunks.cut_places([False] * 100)
    assert places == [0, 32, 64, 96, 100] and line_chunks.cut_places([True] * 5) == [0, 2, 4, 5]


@pytest.mark.parametrize("size", range(2, 11))
def test_short_blocks_are_removed_whole(spark, size):
    """The block of 2 to 10 lines between different surroundings goes from every later text, and nothing else does."""
    draw = random.Random(size)
    own = lambda what: [f"{what} {n} {draw.random()}" for n in range(draw.randrange(1, 12))]
    rows, want = [], {}
    for case in range(60):
        block, gap = [f"block {case} line {n} {draw.random()}" for n in range(size)], draw.randrange(1, size)
        block = block[:gap] + [""] * draw.randrange(2) + block[gap:]
        for i in (2 * case, 2 * case + 1):
            head, tail = own(f"head {i}"), own(f"tail {i}")
            rows.append((i, "\n".join(head + block + tail)))
            want[i] = "\n".join(head + tail if i % 2 else head + block + tail)
    got = line_chunks.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), into="removed").collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all([s["kept_id"] for s in r["removed"] or []] == ([r["doc_id"] - 1] if r["doc_id"] % 2 else []) for r in got)


def test_runs_share_no_line():
    span = lambda *s: dict(zip(("first_line", "n_lines", "kept_id"), s, strict=True))
    given = [span(0, 2, 1), span(0, 5, 2), span(1, 2, 3), span(4, 3, 2), span(9, 2, 2)]
    assert line_chunks.disjoint(given) == [span(0, 2, 1), span(2, 5, 2), span(9, 2, 2)]


def test_every_removed_line_stays_somewhere_earlier(spark):
    rows = [(1, "a\nb"), (2, "a\nb\nc"), (3, "z\nb\nc\ny"), (4, "b\nc\na\nb"), (5, "x\nx\nx")]
    got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\nb", 2: "c", 3: "z\ny", 4: "", 5: "x"}


@pytest.mark.parametrize("bits", [(12, 27), (6, 6)])
def test_only_repeated_chunks_travel_and_a_full_filter_changes_nothing(documents, texts, monkeypatch, bits):
    """The texts are never joined by a shuffle: a chunk's bytes are sent if the filter knows its place."""
    monkeypatch.setattr(line_chunks, "FILTER_BITS", bits)
    sent, plain = [], line_chunks.held_rows
    monkeypatch.setattr(line_chunks, "held_rows", lambda *a: sent.append(plain(*a)) or sent[-1])
    got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeated_lines(documents).collect()}
    assert got == brute_lines(sorted(texts.items()))
    rows = documents.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text").filter("text IS NOT NULL")
    chunks = line_chunks.chunk_rows(rows)
    again = chunks.groupBy("hash").count().filter("count > 1")
    n, repeated = chunks.count(), chunks.join(again, "hash", "left_semi").count()
    assert repeated <= sent[0].count() <= (n if bits == (6, 6) else repeated + 0.05 * n)


def test_tasks_of_the_text_stages_hold_little():
    """Peak of what the first tasks of the n-gram join and the line dedup allocate over 6 MB of text, beside the text."""
    import tracemalloc

    draw = random.Random(4)
    body = ["\n".join(" ".join(str(draw.randrange(10**6)) for _ in range(12)) for _ in range(25)) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(3000)), "version": pa.array(range(3000)), "text": pa.array(body)})
    chunked = lambda b: (line_chunks.chunk_batch(p) for p in tx.pieces(b, "text", line_chunks.SLICE_BYTES))
    for run in (lambda: ngram_join.describe(iter([batch])), lambda: chunked(batch)):
        tracemalloc.start()
        assert sum(b.num_rows for b in run()) >= 3000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 45e6


def test_equal_hashes_need_equal_bytes(documents, monkeypatch):
    """With a constant hash all chunks collide; the byte comparison still tells them apart."""
    docs = documents.limit(20).select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    frame = documents.sparkSession.createDataFrame(rows, "doc_id long, text string")
    plain = line_chunks.chunk_rows
    monkeypatch.setattr(line_chunks, "chunk_rows", lambda r: plain(r).withColumn("hash", F.lit(7).cast("long")))
    assert {r["doc_id"]: r["text"] for r in line_chunks.remove_repeated_lines(frame).collect()} == brute_lines(rows)


def test_fingerprints_equal_brute_force(documents, texts):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(documents).collect()}
    ids = sorted(texts, reverse=True)
    far = []
    for n, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((got[i]["near_edited"], edited), (got[i]["near_next"], after)):
            a, b = shingle_set(text), shingle_set(other)
            far.append(abs(value - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(far) < 0.2 and sum(far) / len(far) < 0.03
    prints = {}
    for i, t in texts.items():
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_fingerprints_across_blocks(spark):
    ids = [-5, 0, 3, 2047, 2048, 9000, 5_000_000, 1 << 40]
    frame = spark.createDataFrame([(i, f"text number {i} with a few words of its own") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.fingerprint_documents(frame).collect()}
    order = sorted(ids, reverse=True)
    for n, i in enumerate(order):
        t, after = (f"text number {j} with a few words of its own" for j in (i, order[(n + 1) % len(order)]))
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprint.fingerprint_documents(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == by_id[3]["fingerprint"] and by_id[2]["near_next"] == 1.0
    assert by_id[None]["edited_sha256"] is None and by_id[None]["fingerprint"]
    assert fingerprint.fingerprint_documents(empty).count() == 0


def test_near_duplicates_find_the_copies(documents, texts):
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_duplicates(documents).collect()}
    comp = components_of({i: shingle_set(t) for i, t in texts.items()})
    many = {i for i in comp if sum(c == comp[i] for c in comp.values()) > 1}
    assert set(got) <= many and len(got) >= 0.95 * len(many)


def template_family(frame_words=404, pairs=150, base=2, own=5):
    """Twins at about 0.78 that differ by single words from one frame; most other pairs lie near 0.70."""
    draw, rows = random.Random(12), []
    for p in range(pairs):
        places = draw.sample(range(2, frame_words - 2, 6), base + 2 * own)
        for twin in range(2):
            words = [f"f{i}" for i in range(frame_words)]
            for n, at in enumerate(places[:base] + places[base + own * twin :][:own]):
                words[at] = f"base{p}x{n}" if n < base else f"own{p}x{twin}x{n}"
            rows.append((2 * p + twin, " ".join(words)))
    draw.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def test_links_inside_a_template_family_are_found(spark):
    """Equal to brute force over all pairs that share a band, whoever has the smallest id in it."""
    rows = template_family()
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    low = fingerprint.minima(pa.array([t for _, t in rows])).reshape(len(rows), fingerprint.BANDS, -1)
    sets, meet = [shingle_set(t) for _, t in rows], 0
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(rows)):
        for j in np.flatnonzero((low[:i] == low[i]).all(axis=2).any(axis=1)).tolist():
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                meet += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert meet >= 140
    want = {i: find(i) for i in range(len(rows))}
    assert got == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}


def test_query_gives_every_document_its_class(spark, documents, texts):
    """The registered query groups the copies; documents alone are classes of one."""
    from tabloom.llm.queries import op10_fingerprint

    from .conftest import SF

    rows = op10_fingerprint(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    comp = components_of({i: shingle_set(t) for i, t in texts.items()})
    size = {c: list(comp.values()).count(c) for c in comp.values()}
    assert {r["doc_id"]: (r["class_id"], r["class_members"]) for r in rows} == {i: (c, size[c]) for i, c in comp.items()}


def test_classes_of_odd_rows(odd, empty):
    rows = fingerprint.fingerprints_and_classes(odd).collect()
    assert len(rows) == odd.count() and fingerprint.fingerprints_and_classes(empty).count() == 0
    by_id = {r["doc_id"]: (r["class_id"], r["class_members"]) for r in rows}
    assert by_id[1] == (1, 1) and by_id[2] == (2, 1) and by_id[3] == (3, 1) and by_id[None] == (None, 1)
    assert by_id[6] == by_id[7] == by_id[8] == (6, 4) and by_id[9] == by_id[10] == (9, 2)


def test_word_arrays_match_a_plain_split():
    random.seed(4)
    made = ["".join(random.choice("aB é\t\n\x0b\x0c\r日😀") for _ in range(random.randrange(30))) for _ in range(300)]
    hashes, counts = tx.word_hashes(pa.array([*made, None]), lower=False)
    plain = [w for t in made for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    assert counts.sum() == len(plain) and counts[-1] == 0
    seen = {}
    for w, h in zip(plain, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("spread", ["hashed", "dense", "repeated"])
def test_the_following_document_for_any_ids(spark, spread):
    """Blocks of ids in order, whether they hold one id or thousands."""
    draw = random.Random(4)
    ids = {"hashed": [draw.randrange(-(2**63), 2**63) for _ in range(3000)], "dense": list(range(9000)), "repeated": [7] * 4000 + list(range(100_000, 102_000))}[spread]
    frame = spark.createDataFrame([(i, i >> fingerprint.BLOCK_BITS) for i in ids], "id long, block long").repartition(5)
    got = {r["low"]: r["next"] for r in fingerprint.block_edges(frame).collect()}
    lows = {}
    for i in sorted(set(ids), reverse=True):
        lows[i >> fingerprint.BLOCK_BITS] = i
    order = sorted(set(ids))
    assert got == {low: order[order.index(low) - 1] for low in lows.values()}
