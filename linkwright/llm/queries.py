"""Queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.text import bare
from linkwright.llm.addresses import locate, location_pairs
from linkwright.llm.components import connected_components
from linkwright.llm.dedup import formatting_duplicates
from linkwright.llm.matching import match_entities
from linkwright.llm.mixing import actual_shares, mixture
from linkwright.llm.spans import shared_portion, shared_spans
from linkwright.llm.variants import name_variants
from linkwright.llm.tokens import count_tokens, encode_corpus
from linkwright.sources import table
from linkwright.store import write

Query = Callable[[SparkSession, str], DataFrame]


def _registrations(spark: SparkSession, d: str) -> DataFrame:
    return formatting_duplicates(
        table(spark, d, "df_a"), "idx",
        {"street": bare("street_name"), "house": F.col("house_number"), "year": F.col("birth_year"), "gender": F.col("gender")},
        {"name": [bare("last_name"), bare("first_name")]})


def _both(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "df_a").select(*columns).unionByName(table(spark, d, "df_b").select(*columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _both(spark, d, "idx", "last_name", "first_name", "house_number", "street_name", "birth_year", "gender")
    return name_variants(rows, table(spark, d, "given_name_forms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _registrations(spark, d).where("copy <> keep").select(F.col("keep").alias("keep_idx"), F.col("copy").alias("copy_idx"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every registration once, with the number of its copies."""
    rows = table(spark, d, "df_a").select("idx")
    groups = _registrations(spark, d)
    kept = groups.where("copy = keep").select(F.col("keep").alias("idx"), "n_copies")
    gone = groups.where("copy <> keep").select(F.col("copy").alias("idx"))
    return rows.join(gone, "idx", "left_anti").join(kept, "idx", "left").select("idx", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(table(spark, d, "linkage_indices"), "idx_a", "idx_b")


def _matches(spark: SparkSession, d: str, with_confidence: bool) -> DataFrame:
    return match_entities(table(spark, d, "df_a"), table(spark, d, "df_b"), table(spark, d, "given_name_forms"), with_confidence=with_confidence)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, False)


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The matches with their confidence."""
    return _matches(spark, d, True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t: table(spark, d, t).select("idx", "house_number", "street_name", F.lit(t).alias("side"))
    rows = side("df_a").unionByName(side("df_b")).withColumn("bare", F.concat(bare("house_number"), bare("street_name")))
    located = write(locate(rows, "house_number", "street_name", ["idx", "side", "bare"]), "located").df
    return location_pairs(located.where("side = 'df_a'"), located.where("side = 'df_b'"), located.count())


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = write(count_tokens(table(spark, d, "documents").select("doc_id", "source", "text")), "sizes").df
    targets = table(spark, d, "mix_targets")
    # drawn once, read by the sample and by the report
    return write(mixture(sizes, targets, "doc_id", "source", "n_tokens"), "mixed").df, sizes, targets


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture, each copy a row, beside the target and the actual share of its source."""
    mixed, sizes, targets = _mixed(spark, d)
    shares = actual_shares(mixed, sizes, targets, "source", "n_tokens")
    return mixed.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The report of the mixture by source."""
    return actual_shares(*_mixed(spark, d), "source", "n_tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


def p9_portion(spark: SparkSession, d: str) -> DataFrame:
    """Of every document, how much is shared with others."""
    docs = table(spark, d, "documents")
    return shared_portion(docs, shared_spans(docs))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_counts, p3_found, p5_found, p5_confidence, p6_found, p7_ids, p8_mixture, p8_shares, p9_found, p9_portion)}
