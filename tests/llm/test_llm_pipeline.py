"""The pipeline stage by stage against plain versions, over a whole small table."""

from collections import Counter

import corpus_pipeline
from tallymark.llm import language, resampling
from tallymark.llm.shared import stored, table

from .conftest import LOWER
from .test_llm_copies import near_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    labels = table(spark, SF, "labels")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stored(stage(spark, docs, SF), f"test-{name}")
        assert left.columns == columns
        rows = {r.doc_id: r for r in left.collect()}
        assert all(before[i] == r for i, r in rows.items())
        if name == "quality":
            want = {r.doc_id for r in resampling.resample(docs, labels).where("kept").collect()}
        elif name == "language":
            want = {r.doc_id for r in language.identify(docs).where("lang_pred != 'und' and score >= 0.35").collect()}
        elif name == "exact_dedup":
            best = {}
            for i, r in before.items():
                key = (r.text or "").translate(LOWER)
                best[key] = max(i, best.get(key, i))
            want = set(best.values())
        else:
            ids = sorted(before)
            _, root = near_brute([before[i].text for i in ids], 80)
            want = {ids[c] for c in set(root)}
        assert set(rows) == want, name
        docs, before = left, rows
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({r.doc_id: r.doc_tokens for r in pieces}) and set(tokens) == set(before)


def test_stages_on_messy_and_empty_tables(spark, messy, no_rows):
    for docs in (messy, no_rows):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = stored(stage(spark, kept, SF), f"messy-{name}")
        assert (kept.count() > 0) == (docs is messy)
