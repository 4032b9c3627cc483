"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orisite.llm import (conversation_repair, decontaminate, html_text, language_id, lm_scoring, mixing, secret_scan, simhash_dedup,
                         suffix_dedup, token_counts, topk_search, toxicity, whitening)
from orisite.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(m: int) -> F.Column:
    """Rows that nothing is learned from; rows without an id are among them."""
    return F.coalesce(crc_mod(F.col("doc_id"), m) == 2, F.lit(True))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_texts(table(spark, sf_dir, "documents"), train=~held_out(7))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(~held_out(4)), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(4).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(4)))
    told = language_id.predict(docs, model, keep=["doc_id"])
    return told.select("doc_id", held_out(4).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_text.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return done.select("page_id", "url", F.col("page_text").alias("text"), F.length("page_text").cast("long").alias("n_chars"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_common", "n_item", "containment")


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
dw AS (
  SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT r, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d)),
dg AS (
  SELECT r, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS g, i, n
  FROM dw WINDOW o AS (PARTITION BY r ORDER BY i)),
ds AS (SELECT DISTINCT r, g FROM dg WHERE i <= greatest(n - 4, 1)),
b AS (SELECT row_number() OVER () AS r, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
bw AS (
  SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT r, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM b)),
bg AS (
  SELECT r, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS g, i, n
  FROM bw WINDOW o AS (PARTITION BY r ORDER BY i)),
bs AS (SELECT DISTINCT r, g FROM bg WHERE i <= greatest(n - 4, 1)),
n AS (SELECT r, count(*) AS n_item FROM bs GROUP BY r),
c AS (SELECT ds.r AS dr, bs.r AS br, count(*) AS n_common FROM ds JOIN bs USING (g) GROUP BY ALL)
SELECT d.doc_id, b.item_id, c.n_common, n.n_item, c.n_common / n.n_item AS containment
FROM c JOIN n ON n.r = c.br JOIN d ON d.r = c.dr JOIN b ON b.r = c.br
WHERE c.n_common >= 0.8 * n.n_item
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_draws")).alias("taken"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=100, with_text=False, keep=["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs), keep=["doc_id"])

    def told(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = told(F.filter("spans", lambda s: s["kind"] != "markov"))
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
                        told(F.col("spans")).alias("spans"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    damaged = conversation_repair.damage(turns, F.crc32(name.cast("binary")) % 20)
    audits, repaired = conversation_repair.repair(damaged)
    digests = conversation_repair.line_digests(repaired)
    found = audits.join(digests.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return every.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in conversation_repair.TOTALS),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000, keep=["vec_id"])
    each = done.select("row.vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "explained", "identity_error",
                       F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_token_counts": op1_token_counts,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_toxicity": op3_toxicity,
        "op4_language_id": op4_language_id,
        "op5_html_extraction": op5_html_extraction,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_mixing": op7_mixing,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_topk_search": op9_topk_search,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
        "op11_secret_scan": op11_secret_scan,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_embedding_whitening": op13_embedding_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_benchmark_decontamination": OP6_SQL, "op9_topk_search": OP9_SQL}
