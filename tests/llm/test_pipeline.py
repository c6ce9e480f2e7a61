import corpus_pipeline
from pyspark.sql import functions as F

from tidemill.llm import ngram_join, quality_model

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["quality", "languages", "near_duplicates", "pack"]
    good = by["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    kept = quality_model.scored(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))).where("quality_kept")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in kept.collect())
    clean = labels.where("quality = 1").join(docs, "doc_id")
    assert clean.join(good, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    assert by["languages"](spark, good, SF).count() >= 0.98 * good.where("text rlike '\\\\p{L}'").count()
    alone = by["near_duplicates"](spark, good, SF)
    groups = ngram_join.near_groups(good, shingle=5, percent=80)
    assert alone.count() == groups.select(F.coalesce("component_id", "id")).distinct().count()
    packed = by["pack"](spark, alone, SF)
    assert packed.select("doc_id").distinct().count() == alone.count()


def test_run_takes_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, df in (("documents", docs.where("false")), ("labels", spark.read.parquet(f"{SF}/labels.parquet"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
