"""Documents to packed training sequences in five stages.

Toxic documents go, one document of each near-duplicate group stays, personal data is
masked, sources are mixed to their target weights, and the mix is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import mixing, packing, private_data, simhash, toxicity
from rillwork.llm.common import small_batches, stored, table
from rillwork.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; null and empty texts are scored like others, repeated rows alike."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(spark, weights, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group; rows without words are one group, rows without an id are never merged by it."""
    return simhash.one_of_each(docs)


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span masked; null texts stay null, columns of other names are untouched."""
    own = "_row"
    while own in docs.columns:
        own += "_"
    found = private_data.find_private(docs, with_rows=True).withColumnRenamed("row", own)
    text = F.col(own)["text"]
    clean = F.when(F.size("spans") > 0, private_data.masked(text, F.col("spans"))).otherwise(text)
    new = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return found.select(*[new.get(c, F.col(own)[c]).alias(c) for c in docs.columns])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows it does not take are gone. A null source is one of its own."""
    mixed = mixing.mix_sources(docs, with_rows=True).where("copies > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place; a null text is one end token, repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("private_data", mask_private_data),
          ("mixing", mix_to_weights), ("packing", pack_sequences)]

#: Trained models, hashes and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
