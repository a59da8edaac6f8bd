"""Substring search by grams: patterns as in ILIKE, where `_` stands for one character and `%` for any number.

A text's grams are its distinct stretches of one to three characters, lower-case, and the empty one. A pattern's literal
pieces give its grams: those of three characters of each piece, a shorter piece as a whole; a pattern of wildcards alone gives
the empty gram. A text that holds the pattern holds all of its grams, so candidates come from an equi-join on the
pattern's rarest grams, and the pattern is tried on these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZES = (1, 2, 3)
#: Of a pattern's grams, so many of the rarest are looked up.
RAREST = 3
#: Patterns up to this number are sent to every task; more meet the grams by a shuffle.
FEW = 10_000


def stretches(text: Column, size: int) -> Column:
    """Stretches of `size` characters, in order; none of a shorter text."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def grams(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The index: key, gram. A row for each distinct gram of each text; null texts have none."""
    low = rows.filter(F.col(text).isNotNull()).select(key, F.lower(text).alias("__low"))
    every = F.concat(F.array(F.lit("")), *[stretches(F.col("__low"), n) for n in SIZES])
    return low.select(key, F.explode(F.array_distinct(every)).alias("gram"))


def pattern_grams(pattern: str | Column) -> Column:
    """The grams that a text must hold to hold the pattern."""
    low = F.lower(F.col(pattern) if isinstance(pattern, str) else pattern)
    pieces = F.filter(F.split(low, "[_%]"), lambda p: p != "")
    of_pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) < SIZES[-1], F.array(p)).otherwise(stretches(p, SIZES[-1]))))
    return F.when(F.size(pieces) > 0, F.array_distinct(of_pieces)).otherwise(F.array(F.lit("")))


def containing(rows: DataFrame, patterns: DataFrame, key: str, text: str, index: DataFrame | None = None) -> DataFrame:
    """The columns of rows and of patterns (pattern, and others) for every text that holds a pattern, in any case.

    index: the grams of rows, where they are kept; made on the way otherwise. Null patterns and texts meet nothing.

    Files are small beside the rows and grams they hold, so their sizes must not choose what is broadcast: neither the grams nor
    the rows ever are, the patterns and their grams are where there are few of them."""
    index = grams(rows, key, text) if index is None else index
    columns = patterns.columns
    marked = patterns.filter(F.col("pattern").isNotNull()).withColumn("__p", F.monotonically_increasing_id())
    few = marked.limit(FEW + 1).count() <= FEW
    sent = lambda small: F.broadcast(small) if few else small.hint("merge")
    asked = marked.select("__p", F.explode(pattern_grams("pattern")).alias("gram"))
    frequency = index.join(sent(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    weighed = asked.join(frequency, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    by = Window.partitionBy("__p")
    chosen = weighed.withColumn("place", F.row_number().over(by.orderBy("texts", "gram"))).filter(F.col("place") <= RAREST).withColumn("needed", F.count(F.lit(1)).over(by))
    met = index.join(sent(chosen.select("__p", "gram", "needed")), "gram").groupBy("__p", "needed", key).agg(F.count(F.lit(1)).alias("met")).filter("met = needed")
    named = met.select("__p", key).join(sent(marked.select("__p", *columns)), "__p").join(rows.hint("merge"), key)
    held = F.expr(f"lower(`{text}`) ilike concat('%', pattern, '%')")
    return named.filter(held).select(*rows.columns, *[c for c in columns if c not in rows.columns])
