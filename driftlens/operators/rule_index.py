"""An inverted index over rule patterns: which rules can match a message at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Characters of an indexed stretch; shorter patterns cannot be indexed.
GRAM = 3


def grams(text: Column) -> Column:
    """The distinct stretches of ``GRAM`` characters of a text, found in one pass however long it is.

    The pattern matches the empty string before every stretch and only looks at what follows. Of a character outside
    the basic plane it also gives a stretch from its second half on, in a rule's pattern just as in a message.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))


def pattern_index(rules: DataFrame, pattern: str, number: str) -> DataFrame:
    """The rules with a pattern long enough, each under one of its grams (``_gram``): the one that the fewest rules have.

    ``number`` tells rules apart. A message that contains the pattern has that gram, so nothing else needs to be looked up.
    """
    spread = rules.where(F.length(pattern) >= GRAM).select(F.col(number).alias("_no"), F.explode(grams(F.col(pattern))).alias("_gram"))
    used = spread.groupBy("_gram").agg(F.count(F.lit(1)).alias("_used"))
    rarest = spread.join(used, "_gram").groupBy("_no").agg(F.min(F.struct("_used", "_gram")).alias("_best"))
    return rules.join(rarest.select(F.col("_no").alias(number), F.col("_best._gram").alias("_gram")), number)


def candidates(events: DataFrame, message: str, index: DataFrame, condition: Column) -> DataFrame:
    """Events joined to the rules whose gram they hold, at most once each, where ``condition`` holds too.

    An equal join in the stage that reads the events: no shuffle of events, and rules are looked at only where their
    rarest gram occurs. The index has one row per rule; callers bound their number.
    """
    spread = events.withColumn("_gram", F.explode(grams(F.col(message))))
    return spread.join(F.broadcast(index), "_gram").where(condition).drop("_gram")
