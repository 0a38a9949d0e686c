"""Corpus cleaning pipeline: quality rules, line deduplication, near-duplicates, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is written as Parquet to
the shared folder and read again, so a lost executor repeats one stage at most. All stages but the last return the
columns of documents, further ones included, whatever their names.

Defined results of all stages: an empty table gives an empty table. A null or empty text has no words, so the quality
stage rejects it; a later stage on its own keeps it (line_dedup and near_dedup, which takes all such texts as copies of
one) or takes it with the epoch (mix), and bpe gives it no ids. A null doc_id is smaller than any other. A very long text
is one row throughout. Each stage's docstring says what it does with repeated rows and ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.bpe import encoded
from tallymark.llm.common import documents, ship, stored
from tallymark.llm.line_dedup import without_repeated_lines
from tallymark.llm.mixing import Mix, mixed_documents
from tallymark.llm.quality import clean_documents
from tallymark.llm.jaccard import representatives

#: Languages are thinned to these weights, sources within a language evenly; no document is repeated. The share of all
#: words is high, as the mix is to shape the corpus rather than to shrink it.
MIX = Mix(levels=("lang", "source"), weights={"lang": {"en": 6.0, "de": 1.5, "fr": 1.5, "es": 1.5}}, share=0.9, epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rules and those depleted of their boilerplate lines, and removes these lines.
    Repeated rows share one verdict; counts decide, so there are no ties."""
    return clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes long lines that five or more documents hold out of all of them but the one of largest doc_id. Rows of equal
    doc_id are one document, which keeps or loses a line as a whole."""
    ship(spark)
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose sets of five-word shingles are 0.8 alike or more (Jaccard), links found by
    the SimHash operator and completed. Of a group the least doc_id stays, of repeated rows and ties one."""
    ship(spark)
    return representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to the target weights of languages and sources, in a seeded order. Of repeated rows as many are
    taken as the budget pays for."""
    return mixed_documents(docs, MIX)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and whether decoding the ids gives the text's bytes. Rows are encoded one
    by one, so repeated rows get equal results."""
    import public_tokenizers

    ship(spark)
    rows = encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source", "text"])
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", "n_tokens", F.col("ids").alias("token_ids"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", bpe),
]

#: SimHash and byte-pair merging have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the rows of the last."""
    rows = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
