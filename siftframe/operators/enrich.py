"""Header translation and value normalization by fixed rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.functions.values import col, dtype_of, show_cell, slug, strip
from siftframe.operators.clean import rename, without_collisions
from siftframe.operators.fuzzy import apply_mapping
from siftframe.work import written

# --- fixed values -----------------------------------------------------------
# header key -> (standard name, description, type)
HEADER_DICTIONARY = {
    "ctn_wgt": ("carton_weight_grams", "Weight of the carton or item in grams", "float"),
    "ctn_weight": ("carton_weight_grams", "Weight of the carton or item in grams", "float"),
    "item_wgt": ("item_weight_kg", "Weight of the item in kilograms", "float"),
    "org_cotton": ("organic_cotton_pct", "Percentage of organic cotton content", "float"),
    "cust_id": ("customer_id", "Unique identifier for the customer", "str"),
    "cust_name": ("customer_name", "Full name of the customer", "str"),
    "first_name": ("first_name", "First name of the customer", "str"),
    "eml": ("email_address", "Email address of the contact", "str"),
    "email": ("email_address", "Email address of the contact", "str"),
    "ph_num": ("phone_number", "Phone contact number", "str"),
    "ph": ("phone_number", "Phone contact number", "str"),
    "dt_joined": ("date_joined", "Date when the user or customer registered", "datetime"),
    "reg_date": ("registration_date", "Date when the registration was recorded", "datetime"),
    "txn_amt": ("transaction_amount", "Value of the transaction in currency", "float"),
    "amt": ("transaction_amount", "Value of the transaction in currency", "float"),
}
DESCRIPTION_PREFIX = "(Heuristic fallback) "
# value rules, first hit wins: (words of which one is contained, exact words,
# words that select the first outcome, outcome with them, outcome otherwise)
VALUE_RULES = (
    (("cotton", "ctn"), (), ("org", "gots"), "organic_cotton", "standard_cotton"),
    (("poly", "pes"), (), ("recy",), "recycled_polyester", "polyester"),
    (("wool",), (), ("recy",), "recycled_wool", "wool"),
    (("success", "paid", "complete"), ("s",), (), "completed", "completed"),
    (("fail", "decline"), ("f",), (), "failed", "failed"),
    (("pend", "wait"), ("p",), (), "pending", "pending"),
)
# ----------------------------------------------------------------------------


def header_key(name: Column) -> Column:
    return F.translate(strip(F.lower(name)), " -", "__")


def header_translations(prof: DataFrame) -> DataFrame:
    """(column, standardized_name, description, clean_datatype) for each row of a profile.

    Known headers come from the dictionary, joined as a 15-row table. Others get a
    cleaned name and a type guessed from the sample values.
    """
    rows = [(k, *v) for k, v in HEADER_DICTIONARY.items()]
    known = prof.sparkSession.createDataFrame(rows, "key string, known_name string, known_text string, known_type string")
    digits = r"^(?U)\d+$"
    decimal = r"^(?U)(?:\d+\.\d*|\.\d+)$"
    guessed = (
        F.when(F.exists("sample_values", lambda v: strip(v).rlike(decimal)), F.lit("float"))
        .when(F.exists("sample_values", lambda v: strip(v).rlike(digits)), F.lit("int"))
        .otherwise(F.lit("str"))
    )
    cleaned = slug(F.col("column"))
    generic = F.concat(F.lit("Auto-standardized representation of column '"), F.col("column"), F.lit("'"))
    return (
        prof.withColumn("key", header_key(F.col("column")))
        .join(F.broadcast(known), "key", "left")
        .select(
            "column",
            F.coalesce("known_name", F.when(cleaned == "", F.lit("column_clean")).otherwise(cleaned)).alias("standardized_name"),
            F.concat(F.lit(DESCRIPTION_PREFIX), F.coalesce("known_text", generic)).alias("description"),
            F.coalesce("known_type", guessed).alias("clean_datatype"),
        )
    )


def translation_map(translations: DataFrame, columns: list[str]) -> dict[str, str]:
    """Old header to new one, in column order; one row per column reaches the driver."""
    found = {r["column"]: r["standardized_name"] for r in translations.collect()}
    names = [found.get(c, c) for c in columns]
    return dict(zip(columns, without_collisions(names)))


def translate_headers(df: DataFrame, translations: DataFrame) -> DataFrame:
    return rename(df, translation_map(translations, df.columns))


def normalized_value(c: Column) -> Column:
    """A text value by the fixed rules, or as a slug."""
    text = F.lower(strip(c))
    contains_any = lambda words: F.lit(False) if not words else _any([text.contains(w) for w in words])
    out = None
    for words, exact, select, chosen, other in VALUE_RULES:
        hit = contains_any(words)
        if exact:
            hit = hit | text.isin(*exact)
        value = F.when(contains_any(select), F.lit(chosen)).otherwise(F.lit(other)) if select else F.lit(other)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(slug(strip(c)))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    text = show_cell(col(column), dtype_of(df, column))
    return df.where(text.isNotNull()).select(text.alias("original")).distinct()


def value_mapping(df: DataFrame, column: str) -> DataFrame:
    """(original, standard): the fixed rules on each distinct value."""
    return distinct_texts(df, column).select("original", normalized_value(F.col("original")).alias("standard"))


def mapped_values(df: DataFrame, column: str, function: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(original, standard) by a caller's function on batches of distinct values.

    The place to plug in a lookup service; values for which it returns nothing
    fall back to the fixed rules.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"original": part["original"], "standard": function(part["original"])})

    mapped = distinct_texts(df, column).mapInPandas(batches, "original string, standard string")
    return mapped.select("original", F.coalesce("standard", normalized_value(F.col("original"))).alias("standard"))


MEMO_SCHEMA = "context string, original string, standard string"


def remembered_values(df: DataFrame, column: str, function: Callable[[pd.Series], pd.Series], memo: str, context: str = "") -> DataFrame:
    """As :func:`mapped_values`, with a table of all values ever mapped in a context at the path ``memo``.

    The function is called for values that are not there yet, and what it returns - nothing, too - is appended, so a
    later table costs calls for its new values only. A value that two runs append at once has two rows, of which the least counts.
    """
    spark = df.sparkSession
    wanted = written(distinct_texts(df, column), "values-wanted")

    def known() -> DataFrame:
        rows = spark.read.schema(MEMO_SCHEMA).parquet(memo).where(F.col("context") == context)
        return rows.groupBy("original").agg(F.min("standard").alias("standard"))

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"context": context, "original": part["original"], "standard": function(part["original"])})

    # an empty append makes the table exist
    spark.createDataFrame([], MEMO_SCHEMA).write.mode("append").parquet(memo)
    new = wanted.join(known(), "original", "left_anti")
    new.mapInPandas(batches, MEMO_SCHEMA).write.mode("append").parquet(memo)
    found = wanted.join(known(), "original", "left")
    return found.select("original", F.coalesce("standard", normalized_value(F.col("original"))).alias("standard"))


def normalize_values(df: DataFrame, column: str) -> DataFrame:
    """Replace the values of a column by their normalized form.

    The rules are row-local, so no mapping table or join is needed. A value is
    looked up trimmed, so surrounding spaces never hide it.
    """
    text = show_cell(col(column), dtype_of(df, column))
    return df.select(*[normalized_value(text).alias(c) if c == column else col(c) for c in df.columns])


def enrich(
    cleaned: DataFrame,
    names: dict[str, str] | None = None,
    replacements: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Rename by ``names``, then apply (original, standard) tables keyed by column.

    A replacement may name the column as it was before renaming.
    """
    names = names or {}
    df = rename(cleaned, names) if names else cleaned
    for column, mapping in (replacements or {}).items():
        target = column if column in df.columns else names.get(column, column)
        df = apply_mapping(df, target, mapping)
    return df
