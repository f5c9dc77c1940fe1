"""Registered queries of the text operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planline.llm.shared import documents
from planline.llm.twins import OP11_SQL, OP12_SQL, OP13_SQL


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.language import identify, train_profiles

    docs = documents(spark, sf_dir)
    profiles = train_profiles(docs.where(_remainder(3) != 1))
    return identify(docs, profiles).select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.toxicity import score, train

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(4) != 2)
    lexicon = train(docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id"))
    return score(docs, lexicon).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.fingerprint import fingerprint_neighbours

    return fingerprint_neighbours(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


#: The production key comes from the deployment's own secrets; this one is for the registered query.
PSEUDONYM_KEY = b"registered-query"


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.private_data import KINDS, pseudonyms

    found = pseudonyms(documents(spark, sf_dir), PSEUDONYM_KEY)
    numbers = [F.coalesce(F.col("counts")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", total.alias("n_values"), *numbers, "text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.decontaminate import decontaminate

    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.token_files import write_token_files

    return write_token_files(documents(spark, sf_dir), tokenizer_path()).documents()


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.jaccard_join import jaccard_join

    return jaccard_join(documents(spark, sf_dir))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.language_model import score_blocks, train

    model = train(documents(spark, sf_dir))
    return score_blocks(model.blocks, model)


#: Domains of the production mix: the bulk source, and two kinds of others by their number.
DOMAIN_WEIGHTS = {("bulk",): 0.3, ("web",): 0.5, ("books",): 0.2} | {
    (d, lang): w for d in ("bulk", "web", "books") for lang, w in (("en", 0.5), ("fr", 0.2), ("de", 0.2), ("es", 0.1))
}
MIX = {"share": 0.8, "epochs": 3, "seed": 1}


def domain() -> Column:
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) AS int)"), F.lit(1))
    return F.when(number == 0, "bulk").when(number % 2 == 1, "web").otherwise("books")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.mixing import mix

    mixed = mix(documents(spark, sf_dir), domain(), DOMAIN_WEIGHTS, **MIX)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("n_copies"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.spelling import counted, damaged_runs, group_spellings

    return group_spellings(counted(damaged_runs(documents(spark, sf_dir))))


N_SHARDS = 24


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.sharding import write_shards

    shards = write_shards(documents(spark, sf_dir), N_SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planline.llm.conversation import audit_conversations, damaged

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audit_conversations(damaged(rows), rows)


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
it AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + 12], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM it WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN lens)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.w = win.w AND dw.n = win.n),
pos AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit
  FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_language,
        op2_suffix_dedup,
        op3_pseudonyms,
        op4_decontamination,
        op5_toxicity,
        op6_fingerprints,
        op7_token_files,
        op8_pseudo_likelihood,
        op9_jaccard_join,
        op10_mixing,
        op11_spelling_variants,
        op12_sharding,
        op13_conversation_repair,
    )
}
SQL = {"op4_decontamination": OP4_SQL, "op11_spelling_variants": OP11_SQL, "op12_sharding": OP12_SQL, "op13_conversation_repair": OP13_SQL}
