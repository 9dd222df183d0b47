"""Queries over the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm import (
    contamination, divergence, fingerprints, jaccard, mixing, neighbours, packing, quality, repeats, secrets, toxicity,
    urlfilters, variants)
from lurewatch.llm.common import stored, table

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a capture, judged by dated list entries made from the pages."""
    pages = table(spark, folder, "pages")
    return urlfilters.filtered(urlfilters.page_captures(pages), urlfilters.page_entries(pages))


ORACLES["op1_url_filters"] = urlfilters.ORACLE


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    words = stored(mixing.sized(docs).drop("text"), "words")
    plan = stored(mixing.mixture(words), "mixture")
    return mixing.taken(words, plan).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_mixing"] = mixing.ORACLE


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and where they lie."""
    return packing.packed(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of every text."""
    return secrets.report(table(spark, folder, "documents"))


ORACLES["op8_secrets"] = secrets.oracle()


@query
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text, its edited text and the likeness to the next text."""
    return fingerprints.fingerprinted(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Category probabilities of every text, and whether it is rejected."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.judged(docs, table(spark, folder, "labels"))
    return found.select("doc_id", "p_junk", "p_toxic", "rejected")


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade and tail probabilities of every text, and whether it is kept."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = quality.graded(docs, table(spark, folder, "labels"))
    return found.select("doc_id", "expected_grade", "p_ge_1", "p_ge_2", "kept")


@query
def op2_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class and number of links of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = jaccard.classes(docs)
    return found.select("doc_id", "class_id", "n_links", "n_text_links")


@query
def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found of every 20th vector."""
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What every document keeps without the 50-byte strings of earlier documents."""
    return repeats.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the corpus with its commoner form."""
    return variants.grouped(table(spark, folder, "documents").select("doc_id", "text"))


ORACLES["op11_variants"] = variants.oracle()


@query
def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """What every document shares with the benchmark's items."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contamination.report(docs, table(spark, folder, "benchmark"))


ORACLES["op12_decontamination"] = contamination.oracle()


@query
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How the sources of each language differ in their words."""
    return divergence.audited(table(spark, folder, "documents").select("lang", "source", "text"))


ORACLES["op13_divergence"] = divergence.oracle()
