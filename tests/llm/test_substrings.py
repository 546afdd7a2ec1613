"""Repeated byte strings and word windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meteoqc.llm import anchors
from meteoqc.llm import suffix_dedup as sd
from meteoqc.llm import window_dedup as wd
from meteoqc.llm.common import table
from meteoqc.llm.sketch import Sketch

FIRST = lambda r: (r[0] is not None, r[0] or 0)


def brute_bytes(rows, length):
    docs = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k:k + length] for _, d in docs for k in range(len(d) - length + 1))
    out = []
    for i, d in docs:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (*FIRST(r), *r[1:]))


def brute_words(rows, window):
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in sorted(rows, key=lambda r: (*FIRST(r), r[1] is not None, r[1] or ""))]
    seen, out = set(), []
    for i, words in docs:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if key in seen:
                gone[k:k + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=lambda r: (*FIRST(r), *r[1:]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (*FIRST(r), *r[1:]))


def mixture(seed, letters, n=40, gap=" "):
    """Documents that share passages, copy each other with edits, and repeat themselves."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4)))
    passages = [gap.join(word() for _ in range(rnd.randint(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [gap.join(word() for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        parts.insert(rnd.randint(0, 3), rnd.choice(passages))
        if rnd.random() < 0.3:
            parts += [parts[0]] * 2
        texts.append(gap.join(parts))
        if rnd.random() < 0.3:
            copy = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 2)):
                copy.insert(rnd.randint(0, len(copy)), "é")
            texts.append("".join(copy))
    return texts


ODD = [(3, None), (3, ""), (None, "short"), (8, "a" * 3000), (9, "ab" * 900), (10, "tie " * 200), (10, "tie " * 200), (11, " \t \n ")]


@pytest.mark.parametrize("seed,length,gram", [(1, 40, 16), (2, 40, 8), (3, 100, 40)])
def test_bytes_equal_brute_force(spark, seed, length, gram):
    rows = list(enumerate(mixture(seed, "abc"))) + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(sd.dedup_substrings(df, length, gram)) == brute_bytes(rows, length)


@pytest.mark.parametrize("seed,window,gram", [(1, 20, 8), (2, 7, 3)])
def test_words_equal_brute_force(spark, seed, window, gram):
    rows = list(enumerate(mixture(seed, "ab", gap="  "))) + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(wd.dedup_windows(df, window, gram)) == brute_words(rows, window)


@pytest.mark.parametrize("cells", [1 << 6, 1 << 12, 1 << 20])
def test_sketch_never_estimates_too_low(cells):
    sketch = Sketch(rows=2, cells=cells, parts=8)
    batch = pa.RecordBatch.from_pydict({"text": mixture(5, "ab") + [None, ""]})
    sent = (b for half in (batch.slice(0, 20), batch.slice(20)) for b in wd._sketching(sketch, 20, 8)(iter([half])))
    merged = {r["part"]: r["bits"] for b in sketch.merge(sent) for r in b.to_pylist()}
    bits = [merged.get(i, b"") for i in range(sketch.rows * sketch.parts)]
    seeds = np.sort(wd._spans(batch, 20, 8)[-1])
    repeated = seeds[1:][seeds[1:] == seeds[:-1]]
    assert len(repeated) and sketch.repeated(bits, repeated).all()
    if cells == 1 << 20:
        once = np.array([x for x, n in Counter(seeds.tolist()).items() if n == 1], np.uint64)
        assert not sketch.repeated(bits, once).any()


def test_full_sketch_gives_the_same(spark):
    rows = list(enumerate(mixture(6, "ab", gap="  "))) + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(wd.dedup_windows(df, 7, 3, Sketch(rows=1, cells=64, parts=4))) == brute_words(rows, 7)


def test_anchors_follow_content_beyond_longest(monkeypatch):
    monkeypatch.setattr(anchors, "LONGEST", 256)
    rnd = np.random.default_rng(4)
    passage, text = rnd.integers(1, 1 << 60, 90).astype(np.uint64), rnd.integers(1, 1 << 60, 5000).astype(np.uint64)
    for at in (10, 240, 256, 1000, 4096, 4900):
        text[at:at + 90] = passage
    _, first, last, anchor, _ = anchors.spans(text, np.array([0, 5000]), 40, 16)
    assert sum(last - first + 1) == 5000 - 40 + 1 and (first[1:] == last[:-1] + 1).all()
    assert ((last <= anchor) & (anchor <= first + 40 - 16)).all()
    place = np.repeat(anchor, last - first + 1) - np.arange(5000 - 40 + 1)
    assert all((place[at:at + 51] == place[1000:1051]).all() for at in (10, 4096, 4900))
    grams = anchors.gram_hashes(text, 16) & ~np.uint64(255)
    assert (np.arange(len(place)) + place == [k + np.argmin(grams[k:k + 25]) for k in range(len(place))]).all()


def test_repeats_beyond_longest_are_removed(spark):
    """A text of 17 MB shares one passage with another text, and one with itself, beyond its first 16 MB."""
    letters = np.random.default_rng(5).integers(97, 123, 17_000_000).astype(np.uint8)
    short = bytes(letters[:1000])
    letters[16_900_000:16_900_500] = letters[2_000_000:2_000_500]
    long = bytes(letters[1000:]) + short[200:900]
    want = [(1, len(long), 500 + 500 + 700, 3), (2, 1000, 700, 1)]
    df = spark.createDataFrame([(1, long.decode()), (2, short.decode())], "doc_id long, text string")
    assert [r[:4] for r in got(sd.dedup_substrings(df))] == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, a string")
    assert got(sd.dedup_substrings(df)) == [] and got(wd.dedup_windows(df)) == []


def test_queries_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert got(sd.op5_suffix_dedup(spark, sf)) == brute_bytes(rows, 400)
    assert got(wd.op8_window_dedup(spark, sf)) == brute_words(rows, 20)
