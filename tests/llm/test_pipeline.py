"""The pipeline on the smallest tables."""

from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F

from panelwright.llm import language_id, quality_model
from panelwright.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == n


def test_stages_on_odd_rows(spark):
    """Null, empty, very long and repeated texts, null ids, and columns whose names operators
    use inside: each stage answers for every row that the one before kept."""
    docs = table(spark, DATA, "documents").limit(120)
    first = docs.first()
    long = " ".join(r["text"] for r in docs.collect())
    rows = [(-1, None), (-2, ""), (None, first["text"]), (-3, long), (-3, long), (-4, "日本語の文章です"), (first["doc_id"], "another text of the same id")]
    more = spark.createDataFrame([(i, t, None, "src0", 0) for i, t in rows], docs.schema)
    names = ("fp", "sig", "set", "x", "h", "ll", "name", "node", "root", "words", "length", "offset")
    docs = materialize(docs.unionByName(more).withColumns({n: F.lit("a") for n in names}), "odd")
    columns, n = docs.columns, docs.count()
    good = quality_model.quality_scores(docs, table(spark, DATA, "labels"))
    assert good.count() == n
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns, name
        kept = docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text"))
        assert kept.isEmpty(), name
        if name == "quality classifier":
            want = good.where("predicted = 1").select("doc_id")
            assert docs.select("doc_id").exceptAll(want).isEmpty() and want.exceptAll(docs.select("doc_id")).isEmpty()
        if name == "language ID":
            found = language_id.identify_documents(before).where("language <> 'und'").select("doc_id")
            assert docs.select("doc_id").exceptAll(found).isEmpty() and found.exceptAll(docs.select("doc_id")).isEmpty()
    texts = [r["text"] for r in docs.collect()]
    sets = [{tuple(re.findall(r"[^ \t-\r]+", t.lower())[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in texts]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert len(packed.groupby("doc_id", dropna=False)) == docs.select("doc_id").distinct().count()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
