"""The pipeline against brute-force versions of its stages, each on what its predecessor kept."""

import os
import sys
from collections import defaultdict

import pytest
from conftest import SF

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_llm_operators import brute_contamination, brute_fingerprint, brute_lines, brute_roots  # noqa: E402

import corpus_pipeline  # noqa: E402
from uttermill.llm import quality_pu  # noqa: E402
from uttermill.llm.queries import PIECE_MODEL  # noqa: E402


def brute_pipeline(spark, rows):
    """(doc_id, ids) of every document that all stages keep; ``rows`` are what the classifier kept."""
    import sentencepiece

    rows = [(i, kept) for i, _, _, kept in brute_lines(rows)]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    roots, first = brute_roots(prints.values()), defaultdict(list)
    for i, p in prints.items():
        first[roots[p]].append(i)
    stay = {min(ids) for ids in first.values()}
    rows = [(i, t) for i, t in rows if i in stay]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute_contamination(rows, items) if r[-1]}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    return sorted((i, library.encode(t)) for i, t in rows if i not in hit)


def test_pipeline_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_pu.scores(docs, quality_pu.fit(docs, labels))
    good = {r.doc_id for r in scored.filter("predicted = 1").collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    assert 100 < len(kept) < docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip"]
    got = sorted((r.doc_id, r.token_ids) for r in out.collect())
    assert got == brute_pipeline(spark, kept)


def test_stages_keep_columns_and_survive_odd_tables(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"
    ]
    rows = [(1, None, "en", "s", None, "x"), (2, "", None, None, 0, "y"), (None, "some words " * 9_000, "en", "s", 5, "z"), (2, "", None, None, 0, "y")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for docs in (odd, odd.limit(0)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter("NOT round_trip").count() == 0


@pytest.mark.parametrize("name", ["pipeline"])
def test_pipeline_is_registered(name):
    import __spark_entry__ as entry

    assert entry.queries()[name] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
