"""The queries of these operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, classifier, fingerprints, jaccard, langid, line_dedup, mixing, neighbours, quality_rules, repair, sessions, suffix_dedup

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary file of a public tokenizer lies; elsewhere its path is a parameter of the operator."""
    try:
        import public_tokenizers
    except ImportError as e:
        raise RuntimeError(f"the package public_tokenizers, which has {name}, is not installed: give the path of a vocabulary file to bpe.digests()") from e
    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": lambda s, d: fingerprints.edited(read(s, d, "documents")),
    "op2_jaccard_join": lambda s, d: jaccard.linked_documents(read(s, d, "documents")),
    "op3_quality_rules": lambda s, d: quality_rules.verdicts(read(s, d, "documents"), read(s, d, "labels")),
    "op4_line_dedup": lambda s, d: line_dedup.removed(read(s, d, "documents")),
    "op4_passage_dedup": lambda s, d: line_dedup.removed_passages(read(s, d, "documents")),
    "op5_bpe": lambda s, d: bpe.digests(read(s, d, "documents"), tokenizer_path()),
    "op6_mixing": lambda s, d: mixing.mixture(read(s, d, "documents")),
    "op7_quality_classifier": lambda s, d: classifier.qualities(read(s, d, "documents"), read(s, d, "labels")),
    "op8_suffix_dedup": lambda s, d: suffix_dedup.removals(read(s, d, "documents")),
    "op9_chat": lambda s, d: chat.digests(read(s, d, "conversations")),
    "op10_language_id": lambda s, d: langid.identify(read(s, d, "documents")),
    "op11_nearest_neighbours": lambda s, d: neighbours.nearest(read(s, d, "embeddings")),
    "op12_session_merging": lambda s, d: sessions.session_versions(read(s, d, "conversations")),
    "op13_structure_repair": lambda s, d: repair.audits(read(s, d, "conversations")),
}
ORACLES: dict[str, str] = {"op3_quality_rules": quality_rules.SQL, "op4_line_dedup": line_dedup.SQL, "op4_passage_dedup": line_dedup.PASSAGES_SQL, "op6_mixing": mixing.SQL, "op9_chat": chat.SQL, "op12_session_merging": sessions.SQL, "op13_structure_repair": repair.SQL}
