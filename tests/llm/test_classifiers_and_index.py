"""Classifiers on held-out labels, their odd rows, and the index against brute force."""

import math
import random
import zlib

import numpy as np
import pytest

from meteoqc.llm import multi_index as mi
from meteoqc.llm import quality as ql
from meteoqc.llm import toxicity as tx
from meteoqc.llm.common import table

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_on_rows_that_training_did_not_see(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = ql.train(docs, labels.where("doc_id % 4 != 0"))
    got = ql.scores(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    right = sum(r.keep == (r.quality == 1) for r in got) / len(got)
    lost = sum(r.quality == 1 and not r.keep for r in got) / sum(r.quality == 1 for r in got)
    assert right > 0.97 and lost < 0.005


def test_every_unlabelled_document_may_teach(spark):
    """The surest of all rows, by a full sort of their odds; labelled and taught ones are left out."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels").where("quality IS NOT NULL")
    views = ql.views_of(docs)
    rnd = np.random.default_rng(3)
    weights, had = [rnd.normal(0, 2, ql.WIDTH + 1) for _ in range(2)], [set(range(0, 1000, 7)), set()]
    given = ql.whole_pool(views, labels, taught=25, sure=0.6)(weights, had)
    every = views.toArrow()
    ids, marked = every["doc_id"].to_pylist(), {r.doc_id for r in labels.collect()}
    odds = [v.times(w) + w[-1] for v, w in zip(ql.read_rows(every), weights)]
    for own, (found, rows, label) in enumerate(given):
        free = sorted((o, i) for i, o in zip(ids, odds[own]) if i not in marked and i not in had[1 - own])
        low, high = [i for o, i in free if o <= -np.log(1.5)][:25], [i for o, i in sorted(((-o, i) for o, i in free)) if -o >= np.log(1.5)][:25]
        assert dict(zip(found, label)) == {i: 0.0 for i in low} | {i: 1.0 for i in high} and len(rows[0]) == len(rows[1]) == len(found)


def test_long_words_count_in_pieces():
    rnd = random.Random(1)
    word = "".join(rnd.choice("aB3-") for _ in range(1000))
    assert [len(p) for p in ql.pieces(["ab", word])] == [2, *[64] * 15, 40] and "".join(ql.pieces([word])) == word
    assert len(ql.text_view(word)) > 10


def test_toxicity_on_the_held_out_fold(spark):
    got = tx.op4_toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    score, label = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    wins = (score[label == 1][:, None] > score[label == 0][None]).mean()
    flagged = np.array([r.predicted for r in got]) == 1
    assert wins > 0.93 and (label[flagged] == 1).mean() > 0.9 and ((0 <= score) & (score <= 1)).all()


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    turned = labels.withColumn("toxic", tx.F.when(tx.held_out(tx.F.col("doc_id")), 1 - labels.toxic).otherwise(labels.toxic))
    a, b = (sorted(map(tuple, tx.scores(docs, tx.model_for(docs, x)).collect())) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (None, 0, 1), (2, None, None)], [(1, 1, 1), (2, 0, 0), (2, 0, 0), (3, 1, 0), (4, 0, 1)]])
def test_odd_rows_are_scored(spark, labels):
    rows = [(1, "fine text", "en", "s", 9), (2, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "xx", "t", 5), (3, "Aa! " * 50_000, "en", "s", 200_000), (4, "b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ql.train(docs, marks)
    assert ql.scores(docs, model).count() == len(rows)
    kept = ql.accepted(docs.withColumn("score", tx.F.lit("mine")), model)
    assert kept.columns[-1] == "score" and (labels[2:3] != [] or kept.count() == len(rows))
    got = tx.scores(docs, tx.model_for(docs, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert ql.scores(docs.limit(0), model).count() == 0 and tx.scores(docs.limit(0), None).count() == 0


def exact(rows, queries, k):
    out = []
    for q in queries:
        d = sorted((math.dist(v, dict(rows)[q]), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d)]
    return out


def test_index_without_limits_is_exact(spark):
    rnd = random.Random(1)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(5)]) for i in range(400)]
    rows = [r for r in rows if any(r[1])]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 5), (1003, [1.0, None, 1.0, 1.0, 1.0]), (1004, [float("nan")] * 5), (1005, [float("inf")] * 5), (1006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    ids = [i for i, _ in rows if i % 20 == 0]
    got = sorted(tuple(r) for r in mi.nearest(df, df.where("vec_id % 20 = 0"), k=10, share=1.0, codes=6).collect())
    want = sorted(exact(rows, ids, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_index_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, SF, "embeddings").collect()]
    df = table(spark, SF, "embeddings")
    got = mi.nearest(df, df.where("vec_id % 100 = 0"), least=200).collect()
    want = {w[:1] + w[2:3] for w in exact(rows, [i for i, _ in rows if i % 100 == 0], 10)}
    assert len({(r.query_id, r.vec_id) for r in got} & want) / len(want) >= 0.9


def test_empty_index(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mi.nearest(df, df).count() == 0


def test_toxicity_training_holds_only_features_that_occur():
    import tracemalloc

    import numpy as np

    from meteoqc.llm import toxicity

    sets = [toxicity.features(f"word{i % 7} other{i % 5} " + ("awful awful slur" if i % 3 == 0 else "kind day")) for i in range(60)]
    label = np.array([int(i % 3 == 0) for i in range(60)])
    tracemalloc.start()
    model = toxicity.train(sets, label)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.columns) == toxicity.FEATURES and model.score("awful awful slur") > 0.5 > model.score("kind day")
    assert peak < 120 * 2**20  # one array over all feature numbers takes 64 MB in doubles; there were more than six
