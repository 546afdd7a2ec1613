"""Periodic runs of words against brute force over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from meteoqc.llm import periodic_runs as pr
from meteoqc.llm.common import table


def brute_runs(words, least=12):
    """Every stretch that keeps a period as long as possible, with its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)  # smaller periods come first
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items() if not smaller(words[a:b], q))


def smaller(stretch, q):
    return any(stretch[p:] == stretch[:-p] for p in range(1, q))


def brute_row(doc_id, text, planted=True):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {k for a, size, q in runs for k in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def random_words(rnd, n):
    parts = []
    while len(parts) < n:
        base = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))]
        parts += base * rnd.randint(1, 6) + [rnd.choice("abcd") for _ in range(rnd.randint(0, 4))]
    return parts[:n]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    rnd = random.Random(least)
    texts = [random_words(rnd, rnd.randint(0, 120)) for _ in range(300)] + [["a"] * 40, ["a", "b"] * 30, []]
    borders = np.cumsum([0] + [len(t) for t in texts])
    symbols = np.array([ord(w) for t in texts for w in t], np.uint64)
    found = pr.find_runs(symbols, borders, least)
    got = [[] for _ in texts]
    for d, a, size, q in zip(*(x.tolist() for x in found)):
        got[d].append((a, size, q))
    assert got == [brute_runs(t, least) for t in texts]


def test_fibonacci_words():
    """Words with as many runs as can be."""
    a, b = "b", "a"
    while len(b) < 700:
        a, b = b, b + a
    found = pr.find_runs(np.array([ord(c) for c in b], np.uint64), np.array([0, len(b)]))
    assert list(zip(*(x.tolist() for x in found[1:]))) == brute_runs(b)


ODD = [(1, None), (2, ""), (None, "a b " * 10), (3, " \n\t "), (3, "x " * 30), (4, "x " * 30), (4, "é ü " * 8 + "é")]


def test_rows_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = ODD + [(i, " ".join(random_words(rnd, rnd.randint(1, 200)))) for i in range(100, 300)]
    df = spark.createDataFrame([(i, t, "s", None, 3) for i, t in rows], "doc_id long, text string, start string, period string, words int").repartition(3)
    assert order(pr.run_digests(df, planted=True).collect()) == order(brute_row(i, t) for i, t in rows)
    assert order(pr.run_digests(df).collect()) == order(brute_row(i, t, False) for i, t in rows)


def test_listing_and_collapsing(spark):
    df = spark.createDataFrame([(1, "w  " + "a b c " * 5 + "z"), (2, "one  two"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in pr.periodic_runs(df).collect()] == [(1, 1, 15, 3)]
    assert sorted((r.doc_id, r.text) for r in pr.without_runs(df).collect()) == [(1, "w a b c z"), (2, "one  two"), (3, None)]


def test_long_text(spark):
    """Half a million words: two long periods and one word that repeats throughout."""
    rnd = random.Random(3)
    part = [f"w{rnd.randint(0, 10**6)}" for _ in range(70_000)]
    words = part * 3 + ["q"] * 200_000 + [f"v{i}" for i in range(50_000)]
    df = spark.createDataFrame([(5, " ".join(words))], "doc_id long, text string")
    assert sorted((r.start, r.length, r.period) for r in pr.periodic_runs(df).collect()) == [(0, 210_000, 70_000), (210_000, 200_000, 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pr.run_digests(df, planted=True).collect() == [] and pr.periodic_runs(df).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    short = {i for i, t in rows if len((t or "").split()) <= 1500}  # brute force is quadratic; the query takes all
    got = [r for r in order(pr.op11_periodic_runs(spark, sf).collect())]
    assert len(got) == len(rows)
    assert [r for r in got if r[0] in short] == order(brute_row(i, t) for i, t in rows if i in short)
