"""N-gram Jaccard join of a table of documents with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.near import Banding, near_links
from causeway.llm.tables import rows_of, text_key

#: A pair of Jaccard 0.8 meets in one of 32 bands of five rows with chance 0.999997.
PRODUCTION = Banding(bands=32, rows=5, threshold="0.8")
HAS_WORD = "[^ \\t-\\r]"


def _uid() -> Column:
    return F.when(F.col("text").rlike(HAS_WORD), text_key(F.col("text")))


def _linked_texts(rows: DataFrame, banding: Banding) -> DataFrame:
    """(uid, least doc_id, copies, links, root of the class) of every text with a word."""
    with_words = rows.where("uid is not null")
    near = near_links(with_words, F.col("uid"), banding)
    texts = with_words.groupBy("uid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    return texts.join(near, "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def jaccard_join(docs: DataFrame, banding: Banding = PRODUCTION) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, n_links.

    Two rows are linked if the Jaccard coefficient of their sets of five-word shingles
    (a text of fewer words is one shingle) is the threshold or more, so exact copies
    are linked too. ``n_links`` counts a row's partners, ``class_id`` is the least
    doc_id of its connected component.

    Bands give candidates with the stated recall; all pairs of a candidate component are
    then compared exactly. A text that is null or has no word is linked to nothing and
    its own class. Repeated rows count and come back each. A null doc_id takes part and
    names a class only if all ids in it are null. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = rows_of(docs).withColumn("uid", _uid())
    texts = _linked_texts(rows, banding)
    classes = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    placed = texts.join(classes, "root").select("uid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = rows.select("doc_id", "uid").join(placed, "uid", "left")
    return own.select(
        "doc_id",
        F.when(F.col("uid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def one_of_each(docs: DataFrame, banding: Banding = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` that stand for their class: one document of each group stays.

    It is the text with the least doc_id of the class, a null one only where all are null,
    and the least hash among equals. Rows equal in doc_id and text are one document and
    stay together. A text that is null or has no word stays. All columns stay.
    """
    rows = rows_of(docs).withColumn("uid", _uid())
    order = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("uid").alias("uid"))
    chosen = _linked_texts(rows, banding).groupBy("root").agg(F.min(order).alias("c")).select(F.col("c.uid").alias("_cw_uid"), F.col("c.id").alias("_cw_id"))
    named = docs.where(_uid().isNotNull())
    kept = named.join(chosen, (_uid() == F.col("_cw_uid")) & named["doc_id"].eqNullSafe(F.col("_cw_id")), "left_semi")
    return kept.unionByName(docs.where(_uid().isNull()))
