"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.durable import written_once
from . import alignment, bpe, embeddings, html_text, mixing, quality, quality_scores, repeats, secrets, simhash, token_counts, vector_codes, wavelet
from .tables import documents, table

TOKEN_LIMIT = 2_048
TARGETS = mixing.Targets(
    domains={"d0": 1, "d1": 2, "d2": 3, "d3": 4}, langs={"en": 4, "de": 3, "fr": 2, "es": 1}, budget_percent=60, max_epochs=2, seed=1
)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ledger = secrets.Ledger(spark)
    secrets.scan_new(docs, ledger)
    found = F.col("found")
    kinds = [rule.kind for rule in secrets.RULES]
    return secrets.with_findings(docs, ledger, carry=("doc_id",)).select(
        "row.doc_id",
        *[secrets.count_of(found, kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(secrets.listed(found, kinds), 256).alias("base_sha256"),
        secrets.listed(found).alias("spans"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_counts.prefix_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    n_tokens = token_counts.tokens_in(F.col("counts"))
    return stored.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > TOKEN_LIMIT).alias("over_limit"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(documents(spark, sf_dir))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(documents(spark, sf_dir))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = wavelet.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.document_rows(wavelet.read(spark, folder))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen(documents(spark, sf_dir), TARGETS)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.print_components(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path, digest=True)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = written_once(alignment.aligned(documents(spark, sf_dir), *paths, digest=True), "aligned-texts")
    scored = alignment.scored(found, alignment.link_counts(found, paths[1]), *paths)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = vector_codes.encoded(table(spark, sf_dir, "embeddings"), carry=("label",))
    coded = vector_codes.summed_by(written_once(coded, "vector-codes"), "label", "error", "label_error")
    return coded.select("vec_id", vector_codes.as_hex().alias("code"), "error", "label_error", F.col("codebooks").alias("codebooks_sha256"))


REGISTRY = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_repeats": op4_repeats,
    "op5_html_text": op5_html_text,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_token_shards": op7_token_shards,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
    "op11_quality_scores": op11_quality_scores,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}
