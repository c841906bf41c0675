"""Term matching: texts against dictionaries of names and labels.

A dictionary (id, label, term, order columns) is joined to the texts. A plain term can only match where its longest word is
a word of the text, so plain terms are found by an equi-join on that word and then checked; their number does not multiply
the texts. Only terms with other letters, which match inside words too, are compared term by term by a plain substring
test, against a dictionary whose size is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.session import small_side

PLAIN = r"^[a-z0-9][a-z0-9 .+/-]*$"


def term_hits(rows: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, *columns of terms): each dictionary row whose term a text names. Terms match as whole words if plain, else anywhere.

    terms: has a column term; null and empty terms match nothing, null texts hold nothing.
    """
    t = terms.withColumn("_t", F.lower("term")).filter(F.col("_t") != "")
    low = F.lower(F.coalesce(text, F.lit("")))
    r = rows.select(F.col(key), low.alias("_low"))
    longest = F.array_max(F.transform(F.split("_t", "[^a-z0-9]+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    plain = t.filter(F.col("_t").rlike(PLAIN)).withColumn("_w", longest)
    words = r.select(key, "_low", F.explode(F.array_distinct(F.split("_low", "[^a-z0-9]+"))).alias("_w"))
    hits = words.join(small_side(plain), "_w").filter(X.term_matches(F.col("_low"), F.col("_t"))).drop("_low", "_t", "_w")
    other = r.join(small_side(t.filter(~F.col("_t").rlike(PLAIN))), F.col("_low").contains(F.col("_t"))).drop("_low", "_t")
    return hits.unionByName(other.select(*hits.columns)).distinct()


def ordered_labels(hits: DataFrame, keys: list[str], order: str, label: str, out: str = "labels") -> DataFrame:
    """(keys, out): the distinct labels of each key in dictionary order."""
    g = hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col(label).alias("l")))).alias("_x"))
    return g.select(*keys, F.array_distinct(F.transform("_x", lambda x: x["l"])).alias(out))


def term_counts(text: Column, terms: list[str]) -> Column:
    """How many of a short literal list of terms occur anywhere in text (in lower case), as one expression without a join."""
    total = F.lit(0)
    for t in terms:
        total = total + F.when(text.contains(t.lower()), 1).otherwise(0)
    return total
