"""Token files and counts against whole-text encoding."""

import functools
import struct
import zlib

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from meteoqc.llm import token_counts as tc  # noqa: E402
from meteoqc.llm import token_files as tf  # noqa: E402
from meteoqc.llm.common import new_folder, table  # noqa: E402

ROWS = [(5, "Hello  world\n\nagain ", "x"), (2, None, "y"), (2, "", None), (None, "no id", "z"), (9, "long " * 30000, "x"), (9, "tie", "x"), (-4, "é<|endoftext|>", "x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def library(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def expected(rows):
    out, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library(t)
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def written(spark, df):
    folder = new_folder(spark, "test-files")
    got = tf.read_token_files(tf.write_token_files(df, folder, P.path("byte_bpe_50k.json"), 0), folder).collect()
    return sorted((tuple(r)[:4] for r in got), key=lambda r: r[1])


def test_round_trip_of_odd_rows(spark):
    assert written(spark, frame(spark)) == expected(ROWS)


def test_empty_table(spark):
    assert written(spark, frame(spark, [])) == []
    assert tc.token_counts(frame(spark, []), P.path("piece_bpe_32k.model")).count() == 0


def test_query_equals_library(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted((tuple(r)[:4] for r in tf.op1_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_counts_equal_library(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = table(spark, sf, "documents").select("doc_id", "text").union(frame(spark).select("doc_id", "text"))
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in docs.collect())
    got = sorted((r[0] or 0, *r[1:]) for r in map(tuple, tc.token_counts(docs, P.path("piece_bpe_32k.model")).collect()))
    assert got == want
