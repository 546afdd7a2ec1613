"""Alignment against a plain dynamic programme, and planted passages."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meteoqc.llm import decontaminate as dc

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string, score string"


def plain(item, text):
    grid = np.zeros((len(item) + 1, len(text) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            grid[i, j] = max(0, grid[i - 1, j - 1] + (dc.MATCH if a == b else dc.MISMATCH), grid[i - 1, j] + dc.GAP, grid[i, j - 1] + dc.GAP)
    return grid.max()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=20))
def test_alignment_score(item, text):
    score, matched, first, last = dc.align(np.array(item), np.array(text))
    assert score == plain(item, text)
    assert 0 <= matched <= len(item) and (not score or 0 <= first <= last < len(text))


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(5)]
    filler = lambda n: [word() for _ in range(n)]
    edited = list(items[1])
    for k in range(3, 30, 7):
        edited[k] = word()
    shifted = items[2][:10] + ["extra", "words"] + items[2][11:]
    docs = [
        (1, " ".join(filler(50) + items[0] + filler(20))), (2, " ".join(filler(10) + edited)), (3, " ".join(shifted + filler(300))),
        (4, " ".join(filler(400))), (5, " ".join(items[3][:8] + filler(60))), (6, None), (7, ""),
        (8, (" ".join(items[4]) + ". ").upper() * 40), (9, " ".join(items[0])), (9, " ".join(items[0]))]
    docs += [(100 + i, " ".join(filler(5) + items[3] + filler(5))) for i in range(60)]  # leaked into most documents
    return [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, "too short"), (51, None), (None, "no words in common with any of the documents")], docs


def test_planted_passages(spark):
    items, docs = corpus()
    df, bench = spark.createDataFrame([(*d, "x") for d in docs], DOCS).repartition(4), spark.createDataFrame(items, ITEMS)
    got = sorted((r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect())
    want = sorted([(1, 0), (2, 1), (3, 2), (8, 4), (9, 0), (9, 0)] + [(100 + i, 3) for i in range(60)])
    assert got == want
    kept = dc.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]


def test_edited_passage_in_many_documents(spark):
    """Every third word is followed by a filler, or every fifth replaced; in 60 copies no seed that is left is rare."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(5))
    items = [[word() for _ in range(39)] for _ in range(3)]
    longer = [w for k, x in enumerate(items[0]) for w in ([x, word()] if k % 3 == 2 else [x])]
    replaced = [word() if k % 5 == 4 else x for k, x in enumerate(items[1])]
    stock = items[2][:6]  # a part of an item that is no evidence
    docs = [(100 * g + i, " ".join([word() for _ in range(20)] + own + [word() for _ in range(20)]), "x")
            for g, own in enumerate((longer, replaced, stock), 1) for i in range(60)]
    df, bench = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id): round(r.score, 2) for r in dc.contaminated(df, bench).collect()}
    assert set(got) == {(100 * g + i, g - 1) for g in (1, 2) for i in range(60)}
    assert {s for (d, _), s in got.items() if d < 200} == {0.85}
    assert sorted(r.doc_id for r in dc.decontaminated(df, bench).collect()) == [300 + i for i in range(60)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 5), min_size=1, max_size=20))
def test_no_alignment_matches_more(item, text):
    assert dc.align(np.array(item), np.array(text))[0] <= dc.MATCH * dc.most_matched(np.array(item), np.array(text))


def test_small_blocks_find_the_same(spark, monkeypatch):
    items, docs = corpus()
    df, bench = spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)
    whole = sorted(map(tuple, dc.contaminated(df, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_GRAMS", 40)
    assert len(dc.blocks_of(bench)) > 2
    assert sorted(map(tuple, dc.contaminated(df, bench).collect())) == whole


def test_empty_tables(spark):
    items, docs = corpus()
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)
    assert dc.contaminated(none[0], full[1]).count() == 0 and dc.contaminated(full[0], none[1]).count() == 0
    assert dc.decontaminated(full[0], none[1]).count() == len(docs)
