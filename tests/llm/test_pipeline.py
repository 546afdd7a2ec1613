"""The pipeline's stages on a small table: what each keeps, and that its decisions reach the next."""

import corpus_pipeline as cp
from test_ngram_join import brute
from test_substrings import brute_bytes

from meteoqc.llm.common import staged, table


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    good = staged(cp.quality_classifier(spark, docs, sf))
    assert good.columns == docs.columns and 0.7 * docs.count() < good.count() < docs.count()
    one = staged(cp.near_duplicates(spark, good, sf))
    groups = brute([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted({g[2][1] for g in groups}) and one.columns == docs.columns
    cut = staged(cp.repeated_substrings(spark, one, sf))
    want = {i: n - r for i, n, r, *_ in brute_bytes([(r.doc_id, r.text) for r in one.collect()], cp.REPEATED_BYTES)}
    got = {r.doc_id: len((r.text or "").encode()) for r in cut.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 6 for i in want) and cut.columns == docs.columns
    clean = staged(cp.benchmark_decontamination(spark, cut, sf))
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    left = clean.collect()
    assert not [r.doc_id for r in left if any(t in r.text for t in items)]
    assert [r for r in cut.collect() if not any(t in r.text for t in items)] and len(left) <= cut.count()
    packed = cp.packed_sequences(spark, clean, sf).collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in left}


def test_run_ends_in_packed_sequences(spark, sf):
    out = cp.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf))
    assert cp.packed_sequences(spark, docs, sf).count() == 0
