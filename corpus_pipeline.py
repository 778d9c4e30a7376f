"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's docs.  All but the last keep the columns of documents.

Defined cases, for every stage: an empty table gives an empty result with the same columns as any other.  Further columns pass through all but the last, whatever their names.
Texts of any length are taken whole.  What null ids, null or empty texts, ties and repeated rows give is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, packing, quality_nbsvm
from quillspark.llm.minhash_dedup import drop_near_duplicates
from quillspark.llm.names import apart
from quillspark.llm.queries import BYTE_BPE, MIX, domain_of
from quillspark.llm.storage import Shelf


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of a text without n-grams; repeated rows, null ids included, are judged each, equal texts alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_nbsvm.fit(docs.select("doc_id", "text"), labels, quality_nbsvm.not_held_out())
    score = "score"
    while apart([score], docs.columns) == []:
        score += "_"
    scored = model.score(docs, score_col=score)
    return scored.where(quality_nbsvm.predicted(F.col(score)) == 1).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt to the target weights; no document twice.

    The document that a leaf's budget ends in stays whole.  Null sources and languages are a leaf of their own; null ids and documents without tokens have their place in
    the order like others, so they stay if the budget reaches it; of rows that repeat an id all stay if one does."""
    return mixing.mix_documents(docs, MIX, domain_of(F.col("source")), budget_share=0.9, max_epochs=1, seed=17)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Null and empty texts consist of the end id; repeated rows are packed each; a null id stays null."""
    return packing.pack(docs, BYTE_BPE, length=2048, end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: Hashed features, confirmed near duplicates and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shelf = Shelf(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = shelf.saved(docs)
    return docs
