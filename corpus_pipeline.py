"""A training corpus from documents: toxic documents go, one of each group of near
copies stays, personal data get pseudonyms, sources are mixed to their weights,
and what is left is packed into sequences.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes its result as Parquet in
the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import mixing, neardup, packing, pii, toxicity
from vicinage.llm.common import Staged
from vicinage.llm.queries import DEMO_KEY, vocabulary_path
from vicinage.session import importable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, as they are.

    The model is learnt from labelled rows of ``docs``; a document's score comes
    from its text alone.  Null and empty texts, repeated rows and other columns stay.
    """
    importable(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity
    of 0.8 or more), that with the smallest id.  Of repeated rows one stays;
    documents without words and rows with a null id all stay."""
    importable(spark)
    found = neardup.near_duplicates(docs, width=5)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    return neardup.one_row_an_id(left)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with format-preserving pseudonyms; ``n_chars`` follows the text."""
    importable(spark)
    return pii.with_pseudonyms(docs, DEMO_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once a whole pass, and a part of
    the text where the mix takes a part.  ``n_chars`` follows the text; documents
    that the mix takes no word of are left out."""
    importable(spark)
    return mixing.expand(mixing.mix(docs, keep=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens (see ``packing.pack``)."""
    importable(spark)
    return packing.pack(docs, vocabulary_path(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the keyed permutation and the packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        after = Staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            before.drop()  # what the stage after it has written replaces it
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
