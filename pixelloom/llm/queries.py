"""The thin queries over the operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import flac, langid, masked_lm, packing, quality, secrets, sentpiece, simhash, tokencount, topk
from pixelloom.llm._common import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every vector whose vec_id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned only from documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes, padded to whole blocks, stored as FLAC and read back."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.octet_length(text)
    full = F.greatest(F.lit(flac.BLOCK), F.ceil(n / flac.BLOCK) * flac.BLOCK)
    payload = F.concat(text, F.repeat(F.lit(" "), (full - n).cast("int"))).cast("binary")
    media = flac.write_media(docs.select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("payload")))
    return flac.media_features(media)


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return masked_lm.fit_and_score(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(line(F.col("base_spans")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to piece ids and decoded again: token count, and digests of ids and decoded text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = sentpiece.transcode(table(spark, sf_dir, "documents"), model)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return got.select("doc_id", n, F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_language_id": op2_language_id,
    "op3_flac_columns": op3_flac_columns,
    "op4_masked_lm": op4_masked_lm,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash": op6_simhash,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_counts": op8_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * b.e[i])) AS BIGINT) AS score
              FROM v q JOIN v b ON q.vec_id % 100 = 0 AND q.r <> b.r AND len(q.e) = len(b.e)),
        t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10""",
}
