"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import contamination, quality, rank_bpe, similar_texts, suffix_dedup
from tagloom.llm.common import saved, table
from tagloom.llm.queries import BYTE_BPE


_KEY = "__row"


def _operated(docs: DataFrame, run: Callable[[DataFrame], DataFrame], own: Sequence[str]) -> DataFrame:
    """``run`` over ``docs``, whose columns named like the operator's own are kept under other names.

    The result has the operator's columns and, as ``__in_<name>``, all columns of ``docs`` but those
    that the operator reads.
    """
    aside = [c for c in docs.columns if c not in own]
    return run(docs.select(*own, *[F.col(f"`{c}`").alias(f"__in_{c}") for c in aside]))


def _restored(docs: DataFrame, operated: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from what ``_operated`` returned, some of them changed."""
    names = set(operated.columns)
    return operated.select(
        *[changed[c].alias(c) if c in changed else F.col(f"`__in_{c}`" if f"__in_{c}" in names else f"`{c}`").alias(c) for c in docs.columns]
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose co-trained quality score is high enough."""
    read = ["doc_id", "text", "lang", "source", "n_chars"]
    scored = _operated(docs, lambda d: quality.score(d, table(spark, sf_dir, "labels")), read)
    return _restored(docs, scored.where(F.col("score") >= quality.REJECT_BELOW))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, that with the least id; null ids stay.

    Similar are texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Each row is
    judged by its own text, so rows of one id and unlike texts all stay; of rows that repeat an id
    and text, the one whose other columns are least in order stays.
    """
    found = saved(similar_texts.similar(docs).select("doc_id", F.col("row").alias(_KEY), "root"), "similar")
    named, key = found.where("doc_id IS NOT NULL"), ["doc_id", _KEY]
    keep = named.groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    repeated = named.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    keyed = docs.withColumn(_KEY, F.xxhash64("doc_id", "text"))
    kept = keyed.join(keep, key, "left_semi")
    several = kept.join(repeated, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*docs.columns)).alias("one"))
    once = kept.join(repeated, key, "left_anti").select(*docs.columns)
    return once.unionByName(several.select("one.*")).unionByName(docs.where("doc_id IS NULL"))


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that an earlier one has; n_chars follows the text.

    A character of which only some bytes are removed goes as a whole.
    """
    cut = _operated(docs, suffix_dedup.deduplicated, ["doc_id", "text"])
    changed = F.size("spans") > 0
    left = suffix_dedup.whole_characters(F.when(changed, F.col("kept")))
    cut = cut.withColumn("text", F.when(changed, left).otherwise(F.col("text")))
    new = {"n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("__in_n_chars"))}
    return _restored(docs, cut, **(new if "n_chars" in docs.columns else {}))


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated."""
    found = _operated(docs, lambda d: contamination.contamination(d, table(spark, sf_dir, "benchmark")), ["doc_id", "text"])
    return _restored(docs, found.where(~contamination.contaminated()))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number, and the text decoded from them.

    Columns of ``docs`` named ``ids`` or ``n_tokens`` give way to these.
    """
    found = _operated(docs, lambda d: rank_bpe.round_trip(d, BYTE_BPE, decoded="text"), ["doc_id", "text"])
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_tokens", "ids")]
    return found.select(
        "doc_id", "text", *[F.col(f"`__in_{c}`").alias(c) for c in rest], F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_text", repeated_text_stage),
    ("contamination", contamination_stage),
    ("encoding", encoding_stage),
]

# SQL expresses neither the trained classifier nor the tokenizer; tests compare with plain versions
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
