"""Quality rules as a bitmask ledger: measure once, store failure bits, apply policies by masks.

Built-in DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t-\\r]+"
_BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: name -> condition of failure over the measurements, in whole numbers; the place in this list is the bit.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "short_or_long_words": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    "upper_case": lambda: 100 * F.col("n_upper") > 40 * F.col("word_chars"),
    "huge": lambda: F.col("n_words") > 1000000,
}
#: Versioned policies: the rules that drop a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "short_or_long_words", "symbols", "repeated_lines", "upper_case"),
}
CURRENT = "v2"
BASE = POLICIES["v1"]


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that is found twice or more."""

    def of_hashes(h: Column) -> Column:
        numbered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(
            F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda x: x.isNotNull()
        )
        covered = F.size(F.array_distinct(F.flatten(F.transform(_let(numbered, again), lambda i: F.array(i, i + 1, i + 2)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(windows(w), of_hashes)))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements) of every row of ``docs``, in one pass without a shuffle.

    Words are runs of characters other than space and \\t..\\r. A null text has none.
    Windows of three words are compared by 64-bit hashes within their own text.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    packed = F.translate(text, _BLANKS, "")
    count = lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("again"))
    doubled = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    parts = docs.select(
        "doc_id", _let(words, count).alias("w"), _let(lines, doubled).alias("l"), F.length(packed).alias("chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))).alias("upper"),
    )
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return parts.select(
        "doc_id", long("w.n", "n_words"), long("chars", "word_chars"), long("symbols", "n_symbols"), long("l.dup", "n_dup_lines"),
        long("w.again", "n_repeat_words"), long("l.n", "n_lines"), long("upper", "n_upper"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: bit i is set where rule i of ``RULES`` fails.

    One row a row of ``docs``; repeated rows and null ids come back as they are, other
    columns are ignored, an empty table gives an empty ledger.
    """
    bits = [F.when(rule(), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", total.cast("long"))


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy; nothing is measured again."""
    fails = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    return rows.withColumn("base_failed", fails(mask(BASE))).withColumn("kept", ~fails(mask(BASE) | mask(POLICIES[policy])))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails, and rows kept without it.

    The ledger is first counted by its bits (at most 2 ^ rules groups), so each ablation
    is a sum over masks.
    """
    used = POLICIES[policy]
    whole = mask(used)
    counted = rows.groupBy("fail_bits").count()
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in used]))
    bits = F.col("fail_bits").bitwiseAND(F.lit(whole))
    total = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0)).alias(name)
    return (
        counted.select("fail_bits", "count", one.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(bits.bitwiseAND(F.col("r.bit")) != 0, "n_failed"), total(bits == F.col("r.bit"), "n_failed_alone"),
            total(bits.bitwiseAND(F.lit(whole) - F.col("r.bit")) == 0, "n_kept_without"),
        )
    )
