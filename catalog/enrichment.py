"""Header translation and value normalization queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.profiling import rows_of
from catalog.registry import query
from catalog.sqlgen import per_column
from catalog.views import EMAIL, view, view_sql
from siftframe.operators import enrich as N
from siftframe.operators.profile import profile, profile_frame
from siftframe.plans.cleaning import clean_and_enrich, new_config
from siftframe.work import new_table_path

MATERIALS = view_sql("materials")
_SLUG = "trim(regexp_replace(regexp_replace(translate({v}, ' -', '__'), '[^\\p{L}\\p{N}_]', '', 'g'), '_+', '_', 'g'), '_')"


def normal_sql(v: str) -> str:
    """The value rules on lower(trim(v))."""
    t = f"lower(trim({v}))"
    has = lambda *words: "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"
    return f"""CASE WHEN {v} IS NULL THEN NULL
    WHEN {has('cotton', 'ctn')} THEN CASE WHEN {has('org', 'gots')} THEN 'organic_cotton' ELSE 'standard_cotton' END
    WHEN {has('poly', 'pes')} THEN CASE WHEN {has('recy')} THEN 'recycled_polyester' ELSE 'polyester' END
    WHEN {has('wool')} THEN CASE WHEN {has('recy')} THEN 'recycled_wool' ELSE 'wool' END
    WHEN {has('success', 'paid', 'complete')} OR {t} = 's' THEN 'completed'
    WHEN {has('fail', 'decline')} OR {t} = 'f' THEN 'failed'
    WHEN {has('pend', 'wait')} OR {t} = 'p' THEN 'pending'
    ELSE {_SLUG.replace('{v}', t)} END"""


_SLUG_NAME = _SLUG.replace("{v}", "lower('{column}')")
_KEY = "translate(trim(lower('{column}')), ' -', '__')"
_KNOWN = """(VALUES ('ctn_wgt', 'carton_weight_grams', 'Weight of the carton or item in grams', 'float'),
  ('cust_id', 'customer_id', 'Unique identifier for the customer', 'str'),
  ('cust_name', 'customer_name', 'Full name of the customer', 'str'),
  ('eml', 'email_address', 'Email address of the contact', 'str'),
  ('txn_amt', 'transaction_amount', 'Value of the transaction in currency', 'float')) AS k(key, std, description, kind)"""
_SAMPLE = "(SELECT t FROM {source} WHERE t IS NOT NULL ORDER BY _row LIMIT 5)"

_TRANSLATIONS = per_column(
    "cryptic_customers",
    f"""SELECT '{{column}}' AS "column",
    coalesce((SELECT std FROM {_KNOWN} WHERE key = {_KEY}), nullif({_SLUG_NAME}, ''), 'column_clean') AS standardized_name,
    '(Heuristic fallback) ' || coalesce((SELECT description FROM {_KNOWN} WHERE key = {_KEY}),
      'Auto-standardized representation of column ''{{column}}''') AS description,
    coalesce((SELECT kind FROM {_KNOWN} WHERE key = {_KEY}),
      (SELECT CASE WHEN bool_or(regexp_full_match(trim(t), '[0-9]+\\.[0-9]*|\\.[0-9]+')) THEN 'float'
       WHEN bool_or(regexp_full_match(trim(t), '[0-9]+')) THEN 'int' ELSE 'str' END FROM {_SAMPLE})) AS clean_datatype""",
)


def _translations(spark, folder):
    df, row = rows_of(spark, folder, "cryptic_customers")
    return df, N.header_translations(profile_frame(df, profile(df, row, quartiles=False)))


@query("header_translations", _TRANSLATIONS)
def _(spark, folder):
    return _translations(spark, folder)[1]


@query("header_dictionary_hits", f"SELECT \"column\", standardized_name FROM ({_TRANSLATIONS}) WHERE description NOT LIKE '%Auto-%'")
def _(spark, folder):
    found = _translations(spark, folder)[1]
    return found.where("description not like '%Auto-%'").select("column", "standardized_name")


@query(
    "headers_translated",
    f"""SELECT "Cust ID" AS customer_id, "Cust Name" AS customer_name, "Eml" AS email_address, "Ctn Wgt" AS carton_weight_grams,
    "Txn-Amt" AS transaction_amount, "Nation  Key (%)" AS nation_key, "mkt_Segment_" AS mkt_segment, "???" AS column_clean
    FROM ({view_sql('cryptic_customers')})""",
)
def _(spark, folder):
    df, found = _translations(spark, folder)
    return N.translate_headers(df, found)


@query(
    "value_mapping",
    f"SELECT DISTINCT material AS original, {normal_sql('material')} AS standard FROM ({MATERIALS}) WHERE material IS NOT NULL",
)
def _(spark, folder):
    return N.value_mapping(view(spark, folder, "materials"), "material")


@query("values_normalized", f"SELECT p_partkey, {normal_sql('material')} AS material FROM ({MATERIALS})")
def _(spark, folder):
    return N.normalize_values(view(spark, folder, "materials"), "material").select("p_partkey", "material")


@query(
    "values_mapped_by_function",
    f"""SELECT DISTINCT material AS original, CASE WHEN contains(material, ' - ') THEN split_part(material, ' - ', 1)
    ELSE {normal_sql('material')} END AS standard FROM ({MATERIALS}) WHERE material IS NOT NULL""",
)
def _(spark, folder):
    def before_dash(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v.split(" - ")[0] if " - " in v else None)

    return N.mapped_values(view(spark, folder, "materials"), "material", before_dash)


@query(
    "values_mapped_with_memo",
    f"""SELECT DISTINCT material AS original, CASE WHEN contains(material, ' - ') THEN split_part(material, ' - ', 1)
    ELSE {normal_sql('material')} END AS standard FROM ({MATERIALS}) WHERE material IS NOT NULL""",
)
def _(spark, folder):
    """The second run asks for the values that the first one, over other parts, has not mapped."""

    def before_dash(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v.split(" - ")[0] if " - " in v else None)

    memo, df = new_table_path(spark, "memo"), view(spark, folder, "materials")
    first = df.where(F.col("p_brand") == df.agg(F.min("p_brand")).first()[0])
    N.remembered_values(first, "material", before_dash, memo)
    return N.remembered_values(df, "material", before_dash, memo)


@query(
    "clean_translate_replace",
    f"""SELECT c_custkey AS customer_id, c_name AS customer_name, {EMAIL} AS email_address, {normal_sql('c_mktsegment')} AS mkt_segment,
    c_custkey AS row_index FROM customer""",
)
def _(spark, folder):
    """Cleaning keeps the old headers here; the replacement names the column as it was before translation."""
    df = view(spark, folder, "cryptic_customers").select("Cust ID", "Cust Name", "Eml", "mkt_Segment_")
    translations = N.header_translations(profile_frame(df, profile(df, "Cust ID", quartiles=False)))
    names = N.translation_map(translations, df.columns)
    replacements = {"mkt_Segment_": N.value_mapping(df, "mkt_Segment_")}
    config = new_config(standardize_headers=None)
    return clean_and_enrich(df.withColumn("row_index", F.col("`Cust ID`")), config, names, replacements)
