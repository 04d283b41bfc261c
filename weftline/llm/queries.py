"""The pN_ queries of the llm operators; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import canon, cutoffs, encode, packing, repetition, splits, subjects
from weftline.runtime import checkpoint, table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return splits.related_pairs(table(spark, directory, "dataset"))


def p1_members(spark: SparkSession, directory: str) -> DataFrame:
    return splits.related_members(table(spark, directory, "dataset"))


def p1_splits(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "dataset").select("sample_id", "video_id", "speaker", "written_at")
    return splits.assign_splits(rows, table(spark, directory, "split_targets"))


def p1_parted(spark: SparkSession, directory: str) -> DataFrame:
    """Of each unit that holds a recording: its rows and in how many splits they are, which must be one."""
    rows = p1_splits(spark, directory).where("split_unit NOT LIKE '\u0001%'")
    return rows.groupBy("split_unit").agg(F.count("*").alias("n_rows"), F.countDistinct("assigned_split").alias("n_splits"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return cutoffs.kept_hits(table(spark, directory, "candidates"), table(spark, directory, "keep_targets"))


def p2_cutoffs(spark: SparkSession, directory: str) -> DataFrame:
    return cutoffs.cutoffs(table(spark, directory, "candidates"), table(spark, directory, "keep_targets"))[1]


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return repetition.repetitive_texts(table(spark, directory, "transcripts"), table(spark, directory, "lane_transcripts"))


def p3_shares(spark: SparkSession, directory: str) -> DataFrame:
    clips = table(spark, directory, "transcripts").select(F.lit("transcripts").alias("tbl"), "video_id", F.col("seg_id").alias("rec_id"), "text")
    lanes = table(spark, directory, "lane_transcripts").select(F.lit("lane_transcripts").alias("tbl"), "video_id", F.col("chunk_id").alias("rec_id"), "text")
    return repetition.repetition(clips.unionByName(lanes)).drop("text")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    clips = table(spark, directory, "dataset").select(F.col("sample_id").alias("seg_id"), "text_plain")
    return canon.same_reading(table(spark, directory, "transcripts"), clips, "seg_id", "text", "text_plain")


def p4_forms(spark: SparkSession, directory: str) -> DataFrame:
    texts = table(spark, directory, "transcripts").select("seg_id", "text")
    plain = table(spark, directory, "dataset").select(F.col("sample_id").alias("seg_id"), F.col("text_plain").alias("text"))
    return texts.unionByName(plain).withColumn("form", canon.canonical_form(F.col("text")))


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode.encode(table(spark, directory, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _packed(spark: SparkSession, directory: str) -> DataFrame:
    sizes = checkpoint(encode.token_counts(table(spark, directory, "documents").select("doc_id", "text")).select("doc_id", "n_tokens"))
    return packing.pack(sizes, table(spark, directory, "container_sizes"))


def p7_containers(spark: SparkSession, directory: str) -> DataFrame:
    return _packed(spark, directory)


def p7_fill(spark: SparkSession, directory: str) -> DataFrame:
    return packing.fill(_packed(spark, directory), table(spark, directory, "container_sizes"))


def p7_whole(spark: SparkSession, directory: str) -> DataFrame:
    """Per kind of container: the documents that have a place, tokens above the capacity of a bin, documents with missing or repeated pieces, and documents that were cut though they fit."""
    kinds = table(spark, directory, "container_sizes").where("capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    packed = checkpoint(_packed(spark, directory).join(F.broadcast(kinds), "container"))
    bins = packed.where("bin_id IS NOT NULL").groupBy("container", "capacity", "bin_id").agg(F.sum("tokens").alias("t")).groupBy("container").agg(F.sum(F.greatest(F.col("t") - F.col("capacity"), F.lit(0))).cast("long").alias("overflow"))
    docs = packed.groupBy("container", "capacity", "doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.countDistinct("piece").alias("d"), F.sum("tokens").alias("t"))
    each = docs.groupBy("container").agg(F.count("*").alias("documents"), F.count_if((F.col("d") != F.col("n")) | (F.col("last") + 1 != F.col("n"))).alias("broken"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("cut"))
    return each.join(bins, "container")


def _about(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, directory, "documents").select("doc_id", "text"), table(spark, directory, "subject_labels"), table(spark, directory, "subjects")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return subjects.document_subjects(*_about(spark, directory))


def p8_posteriors(spark: SparkSession, directory: str) -> DataFrame:
    return subjects.subject_posteriors(*_about(spark, directory))


def p8_makeup(spark: SparkSession, directory: str) -> DataFrame:
    """The make-up of the corpus: documents by subject."""
    return subjects.document_subjects(*_about(spark, directory)).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_members, p1_splits, p1_parted, p2_found, p2_cutoffs, p3_found, p3_shares, p4_found, p4_forms, p6_ids, p7_containers, p7_fill, p7_whole, p8_found, p8_posteriors, p8_makeup)
}
