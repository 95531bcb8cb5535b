"""Column helpers that keep operators safe from clashing names, nulls and repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.memory import small_batches


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names equal, in any case, those that an operator adds."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text; a null text has those of an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def rows_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; everything an operator works on, whatever else the table has."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


#: Bits of the largest membership filter: it has at most 2 ** 20 rows whatever the input.
MOST_BITS = 26


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame, both: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``df`` whose key may occur in ``keys``, and with ``both`` the rows whose key surely does not).

    ``keys`` has one column and should be checkpointed. A bitmap over hashed keys, of
    bounded size, is broadcast, so the rows are told apart where they lie and only the
    first part needs to move for an exact join. With more keys than a bitmap of that size
    can tell apart, all rows are in the first part.
    """
    n = keys.count()
    bits = max(16, min(MOST_BITS, (16 * n).bit_length()))
    if n > 1 << (MOST_BITS - 2):
        return df, df.limit(0) if both else None
    place = lambda c: F.pmod(F.xxhash64(F.lit(13), c), F.lit(1 << bits))
    bit = lambda p: F.expr("shiftleft(1L, cast(_cw_place & 63 as int))")
    words = (
        keys.select(place(F.col(f"`{keys.columns[0]}`")).alias("_cw_place"))
        .groupBy(F.shiftright("_cw_place", 6).alias("_cw_word")).agg(F.bit_or(bit("_cw_place")).alias("_cw_bits"))
    )
    joined = df.withColumn("_cw_place", place(key)).withColumn("_cw_word", F.shiftright("_cw_place", 6)).join(F.broadcast(words), "_cw_word", "left")
    there = F.coalesce(F.col("_cw_bits").bitwiseAND(bit("_cw_place")) != 0, F.lit(False))
    pick = lambda which: joined.where(which).select(*[f"`{c}`" for c in df.columns])
    return pick(there), pick(~there) if both else None
