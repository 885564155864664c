"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder
and reads again as the next stage's docs.

In every stage: null text counts as empty (line dedup and mixing keep it null), null doc_ids, languages and sources are values like others;
very long texts are read whole; ties are settled as each stage says; repeated rows are each treated as a row; an empty
table gives an empty table; columns beside those of documents stay as they are up to the encoder, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import bpe, jaccard, langid, line_dedup, mixing
from textquarry.llm.common import cut
from textquarry.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty, or no letter in them) go; the others stay as they are. A tie between languages,
    which the smaller name wins, decides nothing here. Repeated rows stay or go together."""
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Content-defined chunks of lines that occur again go, after their bytes were compared; a document of which no word is left
    goes with them. The first occurrence stays, in the order of doc_id (nulls first), text and place; rows that repeat
    both doc_id and text are one in that order, and all stay."""
    out = line_dedup.passages(docs, line_dedup.SPARE)
    left = (F.col("n_removed_lines") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0d]")
    return out.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id, and of its rows the smallest hash of the
    text. Repeated rows become one; texts without a word have no near duplicates, but repeated rows of them become one, too, once
    any row repeats."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated towards their source's target share, in shuffled order. Rows of one doc_id draw the same number, as do
    rows without one that have the same text; a source without a character goes."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to; null text has no ids. Repeated rows are encoded alike."""
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("bpe_encode_decode", encode),
]
#: The join and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
