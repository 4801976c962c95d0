"""The pipeline stage by stage against brute force."""

import re

import pytest

pytest.importorskip("tessera.llm")
pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def groups_of(values, linked):
    """Least member of each one's group under a relation, by trying all pairs."""
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if root(i) != root(j) and linked(values[i], values[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_every_stage_against_brute_force(spark):
    """What each stage keeps of its own input, worked out without the operators' plans."""
    import numpy as np

    from tessera.llm import decontamination, simhash
    from tests.llm.test_operators import accepted

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = lambda df: sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    stages = dict(pipeline.STAGES)

    before = rows(docs)
    docs = pipeline.written(stages["language_id"](spark, docs, SF), "t")
    assert docs.columns == columns and rows(docs) == [(i, t) for i, t in before if any(c.isalpha() for c in t)]

    before = rows(docs)
    docs = pipeline.written(stages["exact_dedup"](spark, docs, SF), "t")
    first = {}
    for i, t in before:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert [i for i, _ in rows(docs)] == sorted(first.values())

    before = rows(docs)
    docs = pipeline.written(stages["simhash_near_dedup"](spark, docs, SF), "t")
    least = groups_of([simhash.fingerprint(t) for _, t in before], lambda a, b: (a ^ b).bit_count() <= 2)
    assert rows(docs) == [before[k] for k in sorted(set(least))]

    before = rows(docs)
    docs = pipeline.written(stages["decontamination"](spark, docs, SF), "t")
    df, n = decontamination.document_frequencies(spark.createDataFrame(before, "doc_id long, text string"))
    idf = np.log((n + 2) / (df + 1)) + 0.1
    items = [p.words for p in decontamination.passages([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])]
    leaks = {i for i, t in before if any(accepted(p, w, idf) for w in [decontamination.words_of(t)] for p in items if 2 * len(set(p) & set(w)) >= len(set(p)))}
    gone = {i for i, _ in before} - {i for i, _ in rows(docs)}
    assert gone <= leaks and len(gone) >= 0.9 * len(leaks)

    packed = stages["best_fit_packing"](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == {i for i, _ in rows(docs)}
    for _, part in packed.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all() and part.length.sum() <= 2048


def test_stages_on_empty_tables_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id long, fp long, hit string"
    rows = [(1, "Some words of a text", "en", "s", 1, 0.5, 9, 9, "x"), (2, "Some  words of a text", "en", "s", 1, 0.5, 9, 9, "x"), (3, None, None, None, None, None, None, None, None), (None, "no id", "en", None, None, None, None, None, None)]
    for content in ([], rows):
        docs = spark.createDataFrame(content, schema)
        for name, stage in pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns, name
            assert after.count() <= docs.count()
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == len(content)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = docs.count()
        assert 0.5 * before < after <= before
        before = after
    kept = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len({" ".join(t.split()) for t in kept.values()}) == len(kept)
    packed = pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(kept)
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_a_row_without_text_goes_and_order_holds(spark):
    rows = [(1, "The night was long and the road was old.", "en", "s", 1), (2, "The night was  long and the road was old.", "en", "s", 1), (3, None, None, None, None), (4, "123 456", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.identify_language(spark, docs, SF)
    assert {r.doc_id for r in left.collect()} == {1, 2}
    assert {r.doc_id for r in pipeline.drop_exact_copies(spark, left, SF).collect()} == {1}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
