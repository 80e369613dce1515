"""The pipeline's stages, one after another, against what each should keep."""

from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontaminate, near_dup
from gridloom.llm.common import read_table, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        seen.append((name, before, docs.count()))
    assert [n for n, *_ in seen] == ["language ID", "quality rules", "near-duplicates", "decontamination"]
    assert seen[0][2] >= 0.95 * seen[0][1]
    judged = near_dup.near_duplicates(docs, near_dup.STAGE_PERCENT)
    assert judged.filter("not kept").count() == 0
    hits = decontaminate.phrase_hits(decontaminate.build_index(docs), read_table(spark, SF, "benchmark"))
    assert hits.filter("contaminated").count() == 0
    packed = stored(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "packed")
    assert packed.select("doc_id").distinct().count() == docs.count()
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.filter("n > 2048").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_null_and_repeated_ids(spark):
    """A stage takes the rows it rejects, not the others of their ids."""
    docs = read_table(spark, SF, "documents").filter("doc_id is not null and length(text) > 400").limit(3)
    clean = [r.text for r in docs.collect()]
    bad = read_table(spark, SF, "benchmark").filter("length(text) > 100").first().text
    rows = [(None, clean[0]), (7, clean[1]), (7, clean[2]), (None, None), (7, None), (None, bad), (7, bad)]
    made = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    texts = lambda df: sorted(r.text or "" for r in df.collect())
    assert texts(corpus_pipeline.decontamination(spark, made, SF)) == sorted(clean + ["", ""])
    # the model comes from the made rows, so every text of words fits
    told = corpus_pipeline.language_id(spark, made, SF)
    assert texts(told) == sorted(clean + [bad, bad])
    twice = made.filter("doc_id = 7").union(made.filter("doc_id = 7"))
    assert texts(corpus_pipeline.near_duplicates(spark, twice, SF)) == sorted([clean[1], clean[2], "", bad])
