"""The corpus pipeline: each stage takes the documents that its predecessor kept.

toxicity -> near duplicates -> benchmark decontamination -> personal data -> source mixing. All but the
last return the columns of ``documents``; the last adds how often and where the mixture schedules each
document (with the default budget every document has a place).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm import decontam, minmax, mixing, pii, toxicity
from twinlake.llm.common import table, written

TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches TOXIC go; the model is fitted on labelled rows."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.drop_toxic(docs, model, threshold=TOXIC)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 or more on five-word shingles the smallest id stays.

    Of rows that repeat an id and its text one stays, that with the smallest other columns. Rows with one id
    and different texts belong together: all stay, or all go. Rows without an id stay.
    """
    ids = minmax.near_duplicates(docs, k=5, percent=80).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"))
    marks = written(ids.filter("doc_id is not null and (n > 1 or not kept)"))
    once = docs.join(marks.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    repeated = docs.join(marks.filter("kept").select("doc_id"), "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = repeated.distinct()
    if others:
        one = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("rest")).select("doc_id", "text", "rest.*")
    return once.unionByName(one.select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, question and answer, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its copies and their blocks in the mixture of sources.

    A column of the documents that has the name of one of these results is replaced by it. Rows of one id and different
    texts are different documents, each with copies of its own.
    """
    added = ("n_tokens", "weight_ppm", "copies", "blocks")
    plan = mixing.mix_sources(docs, by_text=True).alias("p")
    names = docs.drop(*added).columns
    marks = {f"__{n}": c for n, c in mixing.text_marks().items()}
    kept = docs.drop(*added).withColumns(marks).alias("d")
    same = " and ".join(["d.doc_id <=> p.doc_id", "d.source <=> p.source", *(f"d.{n} = p.{n[2:]}" for n in marks)])
    return kept.join(plan, F.expr(same)).select(*(f"d.`{c}`" for c in names), *(f"p.{c}" for c in added))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
]

#: SQL cannot express the fitted toxicity model, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
