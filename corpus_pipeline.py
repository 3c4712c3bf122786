"""From raw documents to a file of token ids: language, near duplicates, benchmark passages, mixture, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import fm_decontam, langid, mixing, setsketch, token_records
from emberline.llm.queries import tokenizer_path
from emberline.session import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters (null and empty texts among them), or likelier wrong than right. Rows without doc_id or lang
    are judged like others, and rows that repeat a doc_id each on their own; an empty table stays one."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest")
    found = langid.identify(docs.select("doc_id", "text", "lang", rest))
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.REJECT))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group, by shingles of five words. Rows that repeat a doc_id are one document: if one of their texts
    links it to a smaller doc_id, all of them go. Null and empty texts, and rows without doc_id, link with nothing and stay."""
    gone = setsketch.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages from the texts; every row stays, a null text null. Each row of a repeated doc_id is cut on its own; null items cut nothing."""
    cleaned = fm_decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents none, one or two times, to its target. A null source is one of its own, a null text has no words and stays as often as
    its length is taken; equal rows share what they are taken for."""
    return mixing.mixed_documents(docs)


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the record files, reads them back and returns a row for each record: one for each row, in the order of doc_id (null ids first), null and empty
    texts with the end id alone. An empty table gives no rows."""
    read = token_records.round_trip(docs, tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", records),
]
#: Trained models, seeded draws and tokenization aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
