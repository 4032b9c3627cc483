"""The corpus pipeline: its stages take effect, keep clean documents and run end to end."""

from pyspark.sql import functions as F

import corpus_pipeline
from orisite.llm import decontaminate, simhash_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) == docs.count()
            kept[name] = ids
        if name == "simhash_dedup":
            c = simhash_dedup.simhash_components(before, 3, 2).collect()
            assert ids == {r.component_id for r in c}
        if name == "suffix_dedup":
            done = suffix_dedup.remove_repeats(before).collect()
            assert {r.doc_id: r.text for r in docs.collect()} == {r.doc_id: r.kept_text for r in done} and len(ids) == len(done)
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            leaked = {r.doc_id for r in decontaminate.leaks(before, items).collect()}
            assert ids == kept["suffix_dedup"] - leaked
    assert {"mix_shard", "mix_place", "mix_pass"} < set(docs.columns) and docs.count() > 0


def test_run_repeats_itself(spark):
    def ids():
        return sorted((r.doc_id, r.mix_shard, r.mix_place) for r in corpus_pipeline.run(spark, SF).collect())

    assert ids() == ids()


CLASHES = ["toxicity", "Kept_Text", "n_bytes", "mix_size", "MIX_SHARD", "__size", "__key", "__id", "__text", "__row", "__no_id", "a.b", "row", "fp", "mix_draws"]


def test_columns_of_any_name_pass_every_stage_unchanged(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        assert done.columns[: len(docs.columns)] == docs.columns and (name == "mixing" or done.columns == docs.columns)
        done.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name)).select(*(F.col(f"`{c}`") for c in docs.columns))
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHES), name


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
