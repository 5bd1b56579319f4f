"""Domains that imitate one of many brands, by equi-joins.

Two words are within two edits exactly if some deletions of at most two letters from each give the same word and their
distance, which is then checked, is two or less. So names and brands meet on their words with letters left out, and no name is
held against a brand that it shares none with. A brand hidden in a name by look-alike characters is found among the
name's parts that begin like a brand: the first letters of all brands are few (their number is bounded by the alphabet, not
by the brands) and sent to every task, so of the parts only those go on that begin like a brand and are as long. Every step
works on distinct names, labels or brands; a label of n letters has 1 + n + n(n - 1)/2 such words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import in_place, names

EDITS = 2
#: Letters of a brand by which parts of names are looked for; shorter brands are looked for whole.
HEAD = 3


def _without_one(word: Column) -> Column:
    """The word with each of its letters left out."""
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def shortened(word: Column, edits: int = EDITS) -> Column:
    """The distinct words that are left when up to ``edits`` letters are deleted."""
    found = [F.array(word)]
    for _ in range(edits):
        found.append(F.array_distinct(F.flatten(F.transform(found[-1], _without_one))))
    return F.array_distinct(F.concat(*found))


def near_words(words: DataFrame, brands: DataFrame, edits: int = EDITS) -> DataFrame:
    """(word, brand) within ``edits`` edits of each other, for distinct ``words`` and ``brands``."""
    left = words.select("word", F.explode(shortened(F.col("word"), edits)).alias("_short"))
    right = brands.select("brand", F.explode(shortened(F.col("brand"), edits)).alias("_short"))
    met = left.join(right, "_short").select("word", "brand").distinct()
    return met.where(in_place(names.is_similar(F.col("word"), F.col("brand"), edits)))


def hidden_brands(names_written: DataFrame, brands: DataFrame) -> DataFrame:
    """(domain, brand) where ``full_normal`` holds the brand and the domain itself does not. Distinct ``brands``."""
    heads = brands.groupBy(F.substring("brand", 1, HEAD).alias("_head")).agg(F.collect_set(F.length("brand")).alias("_sizes"))
    shown = heads.agg(F.collect_set(F.length("_head"))).scalar()
    places = names_written.select(
        "domain", "full_normal", F.explode(F.sequence(F.lit(1), F.length("full_normal"))).alias("_at"), shown.alias("_shown")
    )
    starts = places.select("domain", "full_normal", "_at", F.explode("_shown").alias("_n")).where(
        F.col("_at") + F.col("_n") - 1 <= F.length("full_normal")
    )
    starts = starts.withColumn("_head", F.substring(F.col("full_normal"), F.col("_at"), F.col("_n")))
    met = starts.join(F.broadcast(heads), "_head")
    fits = F.filter("_sizes", lambda n: F.col("_at") + n - 1 <= F.length("full_normal"))
    parts = F.transform(fits, lambda n: F.substring(F.col("full_normal"), F.col("_at"), n))
    pieces = met.select("domain", F.explode(parts).alias("brand")).where(~F.contains("domain", "brand"))
    return pieces.join(brands, "brand").select("domain", "brand")


def imitated_brands(domains: DataFrame, brands: DataFrame) -> DataFrame:
    """(domain, spoofed_brand): the alphabetically first of the ``brands`` that each distinct ``domain`` imitates.

    The rule of ``functions.names.imitated_brand`` for a table of any size: the label before the last equals a brand once
    look-alike characters are replaced or is within two edits of one, or the whole name hides one. Domains whose label is a
    brand imitate nothing. Null and empty brands are left out; domains come back cleaned.
    """
    brands = brands.select("brand").where("brand <> ''").distinct()
    clean = domains.select(names.clean_domain("domain").alias("domain")).where("domain IS NOT NULL").distinct()
    parts = clean.withColumn("main", F.try_element_at(F.split("domain", r"\."), F.lit(-2))).where("main IS NOT NULL")
    parts = parts.join(brands.withColumnRenamed("brand", "main"), "main", "left_anti")
    written = parts.withColumns(
        {"main_normal": names.normalize_lookalike("main"), "full_normal": names.normalize_lookalike("domain")}
    )
    same = written.join(brands, F.col("main_normal") == F.col("brand")).select("domain", "brand")
    near = near_words(parts.select(F.col("main").alias("word")).distinct(), brands)
    near = parts.join(near, F.col("main") == F.col("word")).select("domain", "brand")
    # A name that no character changes in hides nothing.
    hidden = hidden_brands(written.where("full_normal <> domain"), brands)
    found = reduce(DataFrame.unionAll, [same, near, hidden])
    return found.groupBy("domain").agg(F.min("brand").alias("spoofed_brand"))
