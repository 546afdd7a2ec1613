"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from meteoqc.llm import ngram_join as nj
from meteoqc.llm import sketch as sk
from meteoqc.llm.common import table
from meteoqc.llm.sketch import SENT, Sketch

SMALL = (Sketch(rows=1, cells=1 << 16, parts=4),) * 2


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        own = (d is not None, d or 0)
        low[top(i)] = min(low.get(top(i), own), own)
    return sorted(((d is not None, d or 0), len(sets[i]), low[top(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    k = lambda d: (d is not None, d or 0)
    return sorted((k(r.doc_id), r.n_shingles, k(r.component_id)) for r in df.collect())


def near_copies(seed, families, members, edits, words=60):
    """Families of copies of copies, so that links chain, with a passage that all families share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(25)]
    out = []
    for _ in range(families):
        base = [[word() for _ in range(words)] + passage]
        for _ in range(members - 1):
            copy = list(rnd.choice(base))
            for _ in range(rnd.randint(0, edits)):
                copy[rnd.randrange(len(copy))] = word()
            base.append(copy)
        out += [" ".join(b) for b in base]
    rnd.shuffle(out)
    return out


ODD = [(None, "one two"), (None, "ONE  two"), (7000, None), (7001, ""), (7001, " \n"), (7002, "x"), (7003, "X"), (7003, "x y z w v " * 40), (7004, "x y z w v " * 50)]


@pytest.mark.parametrize("seed,families,members,edits,block,cells", [
    (1, 6, 12, 2, 1024, 1 << 16), (2, 3, 40, 3, 16, 1 << 16), (3, 2, 60, 4, 8, 1 << 16), (4, 4, 20, 3, 16, 64)])
def test_groups_equal_brute_force(spark, seed, families, members, edits, block, cells):
    rows = list(enumerate(near_copies(seed, families, members, edits))) + (ODD if seed < 3 else [])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(nj.groups(df, sketches=(Sketch(rows=1, cells=cells, parts=4),) * 2, block=block)) == brute(rows)


def test_empty_table(spark):
    assert got(nj.groups(spark.createDataFrame([], "doc_id long, text string"), sketches=SMALL)) == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert got(nj.op7_ngram_join(spark, sf)) == brute(rows)


def test_first_of_groups_keeps_columns(spark):
    rows = [(2, "a b c d e f", 1), (1, "A b c d e f", 2), (3, "other words are in this", 3), (4, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = nj.first_of_groups(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_a_passage_of_many_documents_makes_no_large_family(spark, monkeypatch):
    rows = list(enumerate(near_copies(5, 12, 8, 2)))
    monkeypatch.setattr(nj, "large_family_links", lambda *_: pytest.fail("families are chained by the passage that all documents hold"))
    assert got(nj.groups(spark.createDataFrame(rows, "doc_id long, text string"), block=16)) == brute(rows)


def test_sketches_follow_the_text(spark):
    def cells(n):
        return [s.cells for s in nj.sketches_for(spark.range(n).selectExpr("repeat('abcd ', 20000) AS text"))]

    assert cells(1000) == [1 << 25, 1 << 24] and cells(1) == [1 << 16] * 2


@pytest.mark.parametrize("tally", [False, True])
def test_large_sketch_is_read_part_by_part(spark, monkeypatch, tally):
    sketch = Sketch(rows=2, cells=1 << 12, parts=8)
    keys = np.arange(900, dtype=np.uint64)
    often = np.concatenate([keys, keys[:300], keys[:100]])
    sent = spark.createDataFrame([r for b in sketch.touched(often, tally) for r in b.to_pylist()], SENT)
    merged = sketch.bits(sent, tally)
    look = sketch.counts if tally else sketch.repeated
    held = look(merged, keys)
    assert (held[:100] >= 3).all() and (held[100:300] >= 2).all() and (held >= 1).all() if tally else held[:300].all() and not held.all()
    monkeypatch.setattr(sk, "HELD", 0)
    assert merged.large and (look(merged, keys) == held).all()
