"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecflow.llm import backoff, chat, decontamination, language, lattice, licenses, merkle, mixing, oddsketch, phrases, randomness, simhash, sql, tokens
from vecflow.llm.common import stored, table

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document and every page; the ids of the other table are null."""
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    model = language.fit(docs)
    nothing = F.lit(None).cast("long")
    ids = lambda doc, page: F.struct(doc.alias("doc_id"), page.alias("page_id"))
    of_docs = language.documents(docs, model, ids(F.col("doc_id"), nothing))
    of_pages = language.pages(pages, model, ids(nothing, F.col("page_id")))
    found = [language.identify(stored(x, "evidence"), model) for x in (of_docs, of_pages)]
    return found[0].union(found[1]).select("row.*", "found.lang", "found.confidence", "found.text_lang", "found.declared", "found.kept")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


def op4_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.report(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents"))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return oddsketch.groups(table(spark, folder, "documents"))


def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.round_trip(table(spark, folder, "documents"), tokenizer_path())


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return randomness.digest(randomness.scan(table(spark, folder, "documents")))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(text))
    return chat.read_back(chat.format_conversations(rows.union(more)))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.report(table(spark, folder, "documents"))


def op12_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.linked(table(spark, folder, "embeddings"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_licenses, op2_language, op3_mixing, op4_backoff, op5_decontamination, op6_fingerprints, op7_minhash, op8_tokens, op9_secrets, op10_chat, op11_manifest, op12_embeddings, op13_phrases)}
# the others hash in ways SQL does not offer, fit a model, draw at random or run a tokenizer; tests/llm checks them by brute force
ORACLES: dict[str, str] = {
    "op4_backoff": sql.BACKOFF,
    "op5_decontamination": sql.DECONTAMINATION,
    "op7_minhash": sql.NEAR_DUPLICATES,
    "op10_chat": sql.CHAT,
    "op11_manifest": sql.MANIFEST,
    "op12_embeddings": sql.NEAR_VECTORS,
    "op13_phrases": sql.PHRASES,
}
