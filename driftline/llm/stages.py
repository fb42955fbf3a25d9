"""The stages of the corpus pipeline: each takes documents and returns documents, or packed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, language, mixing, packing, similar
from driftline.llm.common import table

#: Mean probability of no language from which a document goes; no labelled document of the
#: held-out fold at sf0.1 reaches it.
NO_LANGUAGE = 0.99


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, those without a label under the language that is predicted.

    The network also learns what is no language (bytes in any order); a document goes if
    that has a mean probability of NO_LANGUAGE over its whole text, and so do null texts and
    texts without a letter. A text that mixes languages stays, however even its
    probabilities. Without a labelled row outside the held-out fold there is no network,
    and all documents stay as they are.
    """
    net = language.fit(docs, noise=True)
    if net is None:
        return docs
    found, said = language.annotate(docs, net, "__found"), F.col("__found.lang_pred")
    known, score = said != language.UNDETERMINED, F.col("__found.score")
    # und with a score of 0 is a text without a letter
    kept = found.where(known | ((score > 0) & (score < NO_LANGUAGE)))
    named = F.coalesce("lang", F.when(known, said)).cast(docs.schema["lang"].dataType)
    return kept.withColumn("lang", named).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Near-duplicates have a Jaccard similarity of 0.8 or more on five-word shingles. They meet
    by SimHash fingerprints of these shingles, as in op5, and where three bits don't reach
    by an exact way; whole shingle sets decide on both. op5's digest rule (three words, three
    bits, nothing verified) stays with op5.
    """
    return similar.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark's windows."""
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), "__contaminated")
    return found.where(~F.col("__contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.mix_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)
