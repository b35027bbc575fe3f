"""Repeated passages against word windows of plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom import session
from tabloom.llm import paragraphs, passages, text

from .conftest import PASSAGE, words_of

FILLER = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "st", "un", "vi") for c in ("", "el", "os", "ix")]


def spans(spark, rows):
    frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    return passages.repeated_passages(paragraphs.text_rows(frame, "doc_id", "text")).collect()


def covered(found):
    out = defaultdict(set)
    for r in found:
        out[r["id"]] |= set(range(r["first_word"], r["first_word"] + r["n_words"]))
    return out


def repeated_words(rows, width=50):
    """Word places inside windows of ``width`` words that an earlier place holds."""
    seen, out = set(), defaultdict(set)
    for i, t in sorted(rows):
        w = words_of(t)
        for a in range(len(w) - width + 1):
            window = tuple(w[a : a + width])
            if window in seen:
                out[i] |= set(range(a, a + width))
            seen.add(window)
    return out


def planted(draw, size, wrapped):
    """Forty texts; the passage stands at a chance place in ten of them, inside a line or wrapped at 12 words."""
    passage = draw.choices(FILLER, k=size)
    rows = []
    for i in range(40):
        own = draw.choices(FILLER, k=draw.randrange(60, 200))
        at = draw.randrange(len(own))
        body = own[:at] + (passage if i % 4 == 0 else []) + own[at:]
        step = 12 if wrapped else 90
        rows.append((i, "\n".join(" ".join(body[k : k + step]) for k in range(0, len(body), step))))
    return rows


@pytest.mark.parametrize("size", [51, 60, 100])
def test_passages_anywhere_in_a_text(spark, size):
    """Twelve passages, each in ten of forty texts, inside long lines or wrapped at 12 words."""
    rows = []
    for seed in range(12):
        rows += [(100 * seed + i, t) for i, t in planted(random.Random(1000 * size + seed), size, seed % 2 == 0)]
    want, got = repeated_words(rows), covered(spans(spark, rows))
    assert len(want) == 108
    assert sum(bool(want[i] & got[i]) for i in want) >= 0.94 * 108
    # two later copies may share a word beyond the passage that the first does not go on with
    assert all(len(want[i] - got[i]) <= 2 for i in want if got[i]) and not any(got[i] - want[i] for i in got)


def test_a_passage_of_51_words_holds_a_segment():
    """How often a passage shares a segment of enough words with its copy between other words."""
    draw, hits = random.Random(2), 0
    for _ in range(1000):
        passage = [draw.randrange(1 << 60) for _ in range(51)]
        keys = []
        for _ in range(2):
            w = np.array([draw.randrange(1 << 60) for _ in range(40)] + passage + [draw.randrange(1 << 60) for _ in range(40)], np.uint64)
            start, end = passages.segments(w, np.array([len(w)]))
            long = end - start >= passages.LEAST_SEGMENT
            keys.append(set(passages.run_hash(w, start[long], end[long]).tolist()))
        hits += bool(keys[0] & keys[1])
    assert hits >= 960


def test_corpus_equals_word_windows(documents, texts):
    """All words in repeated windows go and no others, but for edits within a run and texts that repeat a few words."""
    found = passages.repeated_passages(paragraphs.text_rows(documents, "doc_id", "text")).collect()
    got, want = covered(found), repeated_words(texts.items())
    plain = {i: w for i, w in want.items() if len(set(words_of(texts[i]))) > 0.3 * len(words_of(texts[i]))}
    hit = sum(len(w & got[i]) for i, w in plain.items())
    assert hit >= 0.95 * sum(map(len, plain.values()))
    assert sum(len(got[i] - want[i]) for i in got) <= 0.05 * sum(map(len, got.values()))
    for r in found:
        assert r["n_words"] >= passages.LEAST_PASSAGE and r["kept_id"] <= r["id"]


def test_an_edited_passage_goes_in_parts_or_whole(spark):
    """Five words of a hundred replaced: what is left between them and longer than fifty words goes."""
    draw = random.Random(5)
    passage = draw.choices(FILLER, k=100)
    edited = passage[:70] + ["other"] + passage[71:]
    rows = [(1, " ".join(draw.choices(FILLER, k=40) + passage)), (2, " ".join(edited + draw.choices(FILLER, k=40)))]
    assert set(range(70)) <= covered(spans(spark, rows))[2]


def test_segments_follow_content():
    draw = random.Random(1)
    words = [draw.randrange(1 << 60) for _ in range(300)]

    def cuts(front):
        w = np.array(front + words, np.uint64)
        start, end = passages.segments(w, np.array([len(w)]))
        assert start[0] == 0 and end[-1] == len(w) and (start[1:] == end[:-1]).all()
        return {s - len(front) for s in start.tolist() if 20 < s - len(front) < 280}

    assert cuts([]) == cuts([3, 5, 7]) == cuts(list(range(17)))
    assert passages.segments(np.zeros(0, np.uint64), np.zeros(3, np.int64))[0].size == 0


def test_words_and_lines_are_cut_out():
    body = "one two three\nfour five six\nseven"
    assert paragraphs.without_repeats(body, [], [(1, 3)]) == "one \n five six\nseven"
    assert paragraphs.without_repeats(body, [1], [(6, 1)]) == "one two three"
    assert paragraphs.without_repeats(body, [], [(0, 7), (2, 1)]) == ""
    assert paragraphs.without_repeats("a\n\nb", [], [(1, 1)]) == "a\n"


def test_stage_removes_passages_and_keeps_columns(spark):
    """The lines as a whole are not alike, so only the passage goes."""
    draw = random.Random(8)
    passage = " ".join(draw.choices(FILLER, k=60))
    own = [(" ".join(draw.choices(FILLER, k=30)), " ".join(draw.choices(FILLER, k=30))) for _ in range(4)]
    rows = [(i, f"{a} start{i} {passage} end{i} {b}", 1, 2, 3) for i, (a, b) in enumerate(own)] + [(None, passage, 0, 0, 0), (9, None, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__of` int, `__at` int, `__removed` int")
    out = {r["doc_id"]: r for r in paragraphs.remove_repeated_paragraphs(docs).collect()}
    assert out[None]["text"] == passage and out[9]["text"] is None
    for i, (a, b) in enumerate(own):
        assert re.fullmatch(f"{a} start{i} +end{i} {b}", out[i]["text"]) and tuple(out[i])[2:] == (1, 2, 3)
    assert text.fresh_names(docs, "of", "at", "removed") == ["___of", "___at", "___removed"]


def test_repeated_rows_and_hot_passages(spark):
    """A passage that a third of all rows holds, and rows that repeat as they are."""
    draw = random.Random(9)
    passage = " ".join(draw.choices(FILLER, k=70))
    rows = [(i, " ".join(draw.choices(FILLER, k=30)) + (f" {passage}" if i % 3 == 0 else "")) for i in range(300)]
    rows += [rows[3]] * 50
    got, want = covered(spans(spark, rows)), repeated_words(dict(rows).items())
    assert set(got) == set(range(3, 300, 3)) and all(got[i] <= want[i] and len(want[i] - got[i]) <= 3 for i in got)
    odd = spans(spark, [(1, None), (2, ""), (3, "x" * 100_000), (4, "a " * 60_000)])
    assert odd == []


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, stage):
    import corpus_pipeline

    names = ["__words", "__lines", "__measures", "__kept", "__cut0", "__stratum", "__of", "__at", "__had", "__removed", "__text", "own0", "__id", "__row"]
    body = " ".join(random.Random(3).choices(FILLER, k=90))
    rows = [(i, f"{body} {' '.join(random.Random(i).choices(FILLER, k=60 * (i % 2)))}", "en", "s", 0, *range(len(names))) for i in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    assert all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect()) and out.count() > 0


def test_a_batch_of_long_texts_is_bounded(spark):
    """The written tables of an operator come from batches of a few MB, however long the texts; the session's limits stay."""
    texts = spark.range(40, numPartitions=1).select(F.repeat(F.lit("word "), 200_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    before = spark.conf.get(session.BATCH_CONF)
    most = session.cut_lineage(texts.mapInArrow(sizes, "n long")).agg(F.max("n")).first()[0]
    assert most <= session.BATCH_BYTES + 1_100_000
    assert spark.conf.get(session.BATCH_CONF) == before


def test_removal_makes_each_text_once(spark):
    docs = spark.createDataFrame([(1, "head\n" + PASSAGE), (2, "other\n" + PASSAGE + "\ntail"), (3, None), (4, "")], "doc_id long, text string")
    out = corpus_pipeline.paragraph_stage(spark, docs, "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    left = {r.doc_id: r.text for r in out.collect()}
    assert left == {1: "head\n" + PASSAGE, 2: "other\ntail", 3: None, 4: ""}
