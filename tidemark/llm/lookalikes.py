"""Visually identical text with different characters: find the values concerned and bring them to one form.

Only values with a character outside the ordinary ones reach Python objects. Of each token of several scripts the dominant
one is determined, and its forms in one script are looked up in the corpus vocabulary: the distinct forms (few) are joined
with the words of the whole corpus, so no vocabulary is ever held in one place; the planner broadcasts the forms only while
they are small. A look-alike is substituted if the form occurs in the corpus, or, in a token dominated by Latin, if the letter
has no use of its own beside Latin letters (all Cyrillic ones and the Greek capitals and omicron): two differently mixed
spellings of an otherwise unknown name must become equal. Such values bear the kind "unproven" too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import text as X
from tidemark.session import small_side, stored

REPAIRED = T.StructType([T.StructField("clean", T.StringType()), T.StructField("latin", T.BooleanType()), T.StructField("unproven", T.BooleanType())])


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        folded = [X.fold(v) for v in b["value"]]
        mixed = [X.mixed_tokens(f) for f, _ in folded]
        yield pd.DataFrame(
            {
                "id": b["id"],
                "field": b["field"],
                "folded": [f for f, _ in folded],
                "kinds": [sorted(k) for _, k in folded],
                "forms": [sorted({form.lower() for _, form, _ in m}) for m in mixed],
            }
        )


@F.pandas_udf(REPAIRED)
def _repaired(folded: pd.Series, known: pd.Series) -> pd.DataFrame:
    out = [X.repaired(f, set(k) if k is not None else set()) for f, k in zip(folded, known)]
    return pd.DataFrame([(X.squeeze(c), a, b) for c, a, b in out], columns=["clean", "latin", "unproven"])


def values(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, value), repeated rows included; null values left out."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return rows.select(F.col(key).alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", "p.value").filter(F.col("id").isNotNull() & F.col("value").isNotNull())


def repaired(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, kinds, clean): a row per key and field whose value holds such characters, with the kinds found and its one form.

    kinds: compat, marks, invisible, space, hyphen, lookalike, and unproven beside lookalike. Null and empty values have no row; a key that occurs in
    repeated equal rows comes out once; an empty table gives an empty result.
    """
    return _all_repaired(rows, key, fields).filter(F.size("kinds") > 0)


def _all_repaired(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """repaired(), with the values that were looked at but are no case: their kinds are empty."""
    v = values(rows, key, fields)
    seen = v.filter(X.suspect(F.col("value"))).dropDuplicates(["id", "field"])
    schema = f"id {dict(rows.dtypes)[key]}, field string, folded string, kinds array<string>, forms array<string>"
    seen = stored(seen.mapInPandas(_inspect, schema), "inspected")
    forms = stored(seen.select(F.explode("forms").alias("word")).distinct(), "forms")
    words = v.select(F.explode(F.split(F.lower("value"), X.NOT_WORD)).alias("word"))
    known = words.join(small_side(forms), "word", "left_semi").distinct()
    by_row = (
        seen.filter(F.size("forms") > 0)
        .select("id", "field", F.explode("forms").alias("word"))
        .join(stored(known, "known"), "word")
        .groupBy("id", "field")
        .agg(F.collect_set("word").alias("known"))
    )
    done = seen.join(by_row, ["id", "field"], "left")
    done = done.select("id", "field", "kinds", _repaired("folded", "known").alias("x"))
    more = lambda c, kind: F.when(F.col(c), F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    kinds = F.concat("kinds", more("x.latin", "lookalike"), more("x.unproven", "unproven"))
    return done.select("id", "field", kinds.alias("kinds"), F.col("x.clean").alias("clean"))


def consistent(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, clean): every value of every row in its one form; values without such characters only have their spaces squeezed."""
    v = values(rows, key, fields).dropDuplicates(["id", "field"])
    fixed = _all_repaired(rows, key, fields).select("id", "field", F.col("clean").alias("_clean"))
    plain = F.trim(F.regexp_replace("value", r"\s+", " "))
    return v.join(fixed, ["id", "field"], "left").select("id", "field", F.coalesce("_clean", plain).alias("clean"))
