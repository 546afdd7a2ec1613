"""Packing: every id in exactly one piece, full sequences, mixture in every window."""

import struct
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from meteoqc.llm import packing as pk  # noqa: E402
from meteoqc.llm.common import table  # noqa: E402


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return ids_of.t.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, docs, sequence):
    by_seq, total = defaultdict(list), 0
    for p in pieces:
        by_seq[p.sequence_id].append(p)
    for s, own in by_seq.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == sequence or s == max(by_seq)
        total += at
    assert sorted(by_seq) == list(range(len(by_seq)))
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(ids_of(t))
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert got.keys() == want.keys() and total == sum(len(x) for v in want.values() for x in v)
    for i, own in got.items():
        if len(want[i]) == 1:
            ids, at = want[i][0], 0
            for p in sorted(own, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                part = ids[at:at + p.length]
                assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
                at += p.length
            assert at == len(ids)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check(pk.op10_packing(spark, sf).collect(), docs, 2048)


ROWS = [(1, "one two three", "a"), (2, None, "a"), (3, "", None), (4, "long text " * 500, "b"), (5, "x", "c"), (5, "x", "c"), (None, "y", "b")]


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.5}, {"b": 1.0, None: 3.0}])
def test_odd_rows(spark, targets):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, n int").repartition(3)
    got = pk.pack(df, P.path("word_bpe_49k.json"), 1, sequence=16, window_sequences=2, targets=targets).collect()
    check(got, [(i, t) for i, t, _ in ROWS], 16)


def test_targets_hold_in_every_window(spark):
    rows = [(i, "word " * (20 + i % 7), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = pk.pack(df, P.path("word_bpe_49k.json"), 1, sequence=32, window_sequences=4, targets={"a": 0.6, "b": 0.3, "c": 0.1}).collect()
    check(got, [r[:2] for r in rows], 32)
    share = defaultdict(lambda: defaultdict(int))
    for p in got:
        share[p.window][p.queue] += p.length
    for w in sorted(share)[:15]:  # before the first source runs dry
        n = sum(share[w].values())
        assert abs(share[w]["source a"] / n - 0.6) < 0.03 and abs(share[w]["source c"] / n - 0.1) < 0.03


def test_every_source_is_named(spark):
    rows = [(i, "some words here", f"s{i}") for i in range(300)] + [(300, "more", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pk.pack(df, P.path("word_bpe_49k.json"), 1, sequence=8, window_sequences=2).collect()
    check(got, [r[:2] for r in rows], 8)
    assert {(p.doc_id, p.queue) for p in got} == {(i, "none" if s is None else f"source {s}") for i, _, s in rows}


@pytest.mark.parametrize("targets", [None, {"s0": 0.6, "s1": 0.3, "s2": 0.1}])
def test_every_source_keeps_its_share(spark, targets):
    n = 300
    rows = [(i, "word " * (60 if i % n < 3 else 4 + i % 3), f"s{i % n}") for i in range(4 * n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = pk.pack(df, P.path("word_bpe_49k.json"), 1, sequence=32, window_sequences=4, targets=targets).collect()
    check(got, [r[:2] for r in rows], 32)
    share, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for p in got:
        share[p.window][f"s{p.doc_id % n}"] += p.length
        total[f"s{p.doc_id % n}"] += p.length
    size = {w: sum(x.values()) for w, x in share.items()}
    if targets is None:
        assert len(share) > 40 and all(abs(x[s] - total[s] / len(share)) < 1 for x in share.values() for s in total)
    else:
        before_dry = [w for w in sorted(share) if set(share[w]) <= set(targets)][:2]
        assert before_dry and all(abs(share[w][s] / size[w] - v) < 0.03 for w in before_dry for s, v in targets.items())
        assert {p.queue for p in got if f"s{p.doc_id % n}" in targets} == {f"source {s}" for s in targets}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pk.pack(df, P.path("word_bpe_49k.json"), 1).count() == 0


def test_phases_serve_every_token():
    plan = pk.phases({"a": 10, "b": 1000, "c": 7}, {"a": 1, "b": 1}, 64)
    assert [sum(p["take"][i] for p in plan) for i in range(3)] == [10, 1000, 7]
