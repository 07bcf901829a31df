"""The registered queries of the text operators: one ``opN_<name>`` each, over the whole of its table."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    chunks,
    divergence,
    exact,
    html_content,
    langid,
    licenses,
    packing,
    pseudo_likelihood,
    quality,
    simhash,
    substring,
    viterbi,
)
from .common import table

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=1024)


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op3_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op6_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edited_likeness(table(spark, sf_dir, "documents"))


def op7_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.of_documents(table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all its evidence; the text model is trained on the labelled documents."""
    model = langid.train(table(spark, sf_dir, "documents"), F.col("lang"))
    return langid.of_pages(table(spark, sf_dir, "pages"), model)


def op8_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), public_tokenizers.path(RANKS))


def op9_tree_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_msd_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_phrase_automata": op2_phrase_automata,
    "op3_piece_viterbi": op3_piece_viterbi,
    "op4_simhash_bktree": op4_simhash_bktree,
    "op5_masked_likelihood": op5_masked_likelihood,
    "op6_gear_chunks": op6_gear_chunks,
    "op7_language_evidence": op7_language_evidence,
    "language_of_pages": language_of_pages,
    "op8_tokeniser_fertility": op8_tokeniser_fertility,
    "op9_tree_marginals": op9_tree_marginals,
    "op10_license_dice": op10_license_dice,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_msd_radix": op13_msd_radix,
}

ORACLES: dict[str, str] = {
    "op10_license_dice": licenses.oracle(),
    "op12_source_divergence": divergence.ORACLE,
    "op13_msd_radix": exact.ORACLE,
}
