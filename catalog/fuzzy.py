"""Similarity, clustering and replacement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.profiling import rows_of
from catalog.registry import query
from catalog.sqlgen import facts_sql
from catalog.views import view, view_sql
from siftframe.functions.similarity import similarity
from siftframe.operators import fuzzy as Z
from siftframe.operators.profile import profile

# longest common subsequence of {a} and {b}, one table row per character
LCS = """list_reduce(
  list_transform(string_split({a}, ''), lambda ch: [unicode(ch)]),
  lambda p, c: list_reduce(
    list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INTEGER)]),
    lambda acc, j: list_append(acc, greatest(acc[j[1]], p[j[1] + 1],
      p[j[1]] + CASE WHEN unicode(substr({b}, j[1], 1)) = c[1] THEN 1 ELSE 0 END)),
    [0]),
  list_transform(range(0, length({b}) + 1), lambda j: 0))[-1]"""


def ratio_sql(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE "
        f"(1 - ({total} - 2 * {LCS.format(a=a, b=b)}) / CAST({total} AS DOUBLE)) * 100 END"
    )


def values_sql(view_name: str, column: str, row: str, threshold: float) -> str:
    """u(value, norm, n, r, i): distinct values from the best on; e(a, b): similar pairs a before b."""
    return f"""u AS (SELECT *, row_number() OVER (ORDER BY n DESC, r) AS i FROM
      (SELECT {column} AS value, lower(trim({column})) AS norm, count(*) AS n, min({row}) AS r
       FROM ({view_sql(view_name)}) WHERE {column} IS NOT NULL AND trim({column}) <> '' GROUP BY {column})),
    e AS (SELECT * FROM (SELECT x.i AS a, y.i AS b, x.r AS ra, y.r AS rb, x.value AS va, y.value AS vb,
      {ratio_sql('x.norm', 'y.norm')} AS s FROM u x JOIN u y ON x.i < y.i) WHERE s >= {threshold})"""


def stars_sql(view_name: str, column: str, row: str, threshold: float) -> str:
    """stars(canonical, member, n, first_row, canonical_n) by going through the values one by one."""
    return f"""WITH RECURSIVE {values_sql(view_name, column, row, threshold)},
    nb AS (SELECT u.i, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS better FROM u LEFT JOIN e ON e.b = u.i GROUP BY u.i),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS centers UNION ALL
      SELECT nb.i, CASE WHEN list_has_any(centers, better) THEN centers ELSE list_append(centers, nb.i) END
      FROM g JOIN nb ON nb.i = g.i + 1),
    c AS (SELECT unnest(centers) AS i FROM (SELECT centers FROM g ORDER BY i DESC LIMIT 1)),
    m AS (SELECT i AS i, i AS center FROM c UNION ALL
      SELECT e.b, min(e.a) FROM e WHERE e.a IN (FROM c) AND e.b NOT IN (FROM c) GROUP BY e.b),
    stars AS (SELECT k.value AS canonical, u.value AS member, u.n, u.r AS first_row, k.n AS canonical_n
      FROM m JOIN u ON u.i = m.i JOIN u k ON k.i = m.center
      WHERE m.center IN (SELECT center FROM m GROUP BY center HAVING count(*) > 1))"""


@query(
    "similarity_scores",
    f"""WITH v AS ({view_sql('dirty_parts')}),
    d AS (SELECT *, round({ratio_sql('lower(p_name)', 'lower(name_var)')}, 4) AS similarity
      FROM (SELECT DISTINCT p_name, name_var FROM v))
    SELECT p_partkey, similarity FROM v JOIN d USING (p_name, name_var)""",
)
def _(spark, folder):
    df = view(spark, folder, "dirty_parts")
    return df.select("p_partkey", F.round(similarity(F.col("p_name"), F.col("name_var")), 4).alias("similarity"))


@query(
    "similar_value_pairs",
    f"""WITH {values_sql('dirty_parts', 'name_var', 'p_partkey', 85)}
    SELECT CASE WHEN ra < rb THEN va ELSE vb END AS value1, CASE WHEN ra < rb THEN vb ELSE va END AS value2,
    round(s, 4) AS similarity FROM e""",
)
def _(spark, folder):
    pairs = Z.similar_pairs(view(spark, folder, "dirty_parts"), "name_var", 85, "p_partkey")
    return pairs.withColumn("similarity", F.round("similarity", 4))


def _stars(name: str, view_name: str, column: str, row: str, threshold: float) -> None:
    @query(name, f"{stars_sql(view_name, column, row, threshold)} SELECT * FROM stars")
    def _(spark, folder):
        return Z.star_clusters(view(spark, folder, view_name), column, threshold, row)


_stars("fuzzy_groups_80", "dirty_parts", "name_var", "p_partkey", 80)
_stars("fuzzy_groups_60", "materials", "material", "p_partkey", 60)


def crowd_sql(view_name: str, column: str, row: str, threshold: float) -> str:
    """As stars_sql for values that are nearly all alike: a step compares one centre with those left, not all pairs."""
    return f"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (ORDER BY n DESC, r) AS i FROM
      (SELECT {column} AS value, lower(trim({column})) AS norm, count(*) AS n, min({row}) AS r
       FROM ({view_sql(view_name)}) WHERE {column} IS NOT NULL AND trim({column}) <> '' GROUP BY {column})),
    g AS (SELECT CAST(0 AS BIGINT) AS step, i, norm, min(i) OVER () AS c, first_value(norm) OVER (ORDER BY i) AS cn FROM u UNION ALL
      SELECT step + 1, i, norm, min(i) OVER (), first_value(norm) OVER (ORDER BY i)
      FROM (SELECT * FROM g WHERE i <> c AND {ratio_sql('norm', 'cn')} < {threshold})),
    m AS (SELECT i, arg_max(c, step) AS center FROM g GROUP BY i)
    SELECT k.value AS canonical, u.value AS member, u.n, u.r AS first_row, k.n AS canonical_n
      FROM m JOIN u ON u.i = m.i JOIN u k ON k.i = m.center
      WHERE m.center IN (SELECT center FROM m GROUP BY center HAVING count(*) > 1)"""


@query("fuzzy_groups_customer_names", crowd_sql("customer", "c_name", "c_custkey", 80))
def _(spark, folder):
    return Z.star_clusters(view(spark, folder, "customer"), "c_name", 80, "c_custkey")


_PARTS = stars_sql("dirty_parts", "name_var", "p_partkey", 80)


@query(
    "fuzzy_group_records",
    f"""{_PARTS} SELECT canonical, string_agg(member, '|' ORDER BY member <> canonical, n DESC, first_row) AS members,
    string_agg(CAST(n AS VARCHAR), '|' ORDER BY member <> canonical, n DESC, first_row) AS frequencies FROM stars GROUP BY canonical""",
)
def _(spark, folder):
    records = Z.group_records(Z.star_clusters(view(spark, folder, "dirty_parts"), "name_var", 80, "p_partkey"))
    counts = F.transform("members", lambda m: F.element_at("frequencies", m).cast("string"))
    return records.select(
        "canonical", F.array_join("members", "|").alias("members"), F.array_join(counts, "|").alias("frequencies")
    )


@query(
    "fuzzy_replacements",
    f"{_PARTS} SELECT 'name_var' AS \"column\", member AS original, canonical AS standard FROM stars WHERE member <> canonical",
)
def _(spark, folder):
    return Z.replacement_map(Z.star_clusters(view(spark, folder, "dirty_parts"), "name_var", 80, "p_partkey"), "name_var")


@query(
    "fuzzy_standardized",
    f"""{_PARTS} SELECT p_partkey, coalesce(canonical, name_var) AS name_var FROM ({view_sql('dirty_parts')}) v
    LEFT JOIN stars ON stars.member = v.name_var AND member <> canonical""",
)
def _(spark, folder):
    df = view(spark, folder, "dirty_parts")
    mapping = Z.replacement_map(Z.star_clusters(df, "name_var", 80, "p_partkey"), "name_var")
    return Z.apply_mapping(df, "name_var", mapping).select("p_partkey", "name_var")


@query(
    "mapping_applied",
    f"""SELECT p_partkey, CASE material WHEN 'PES' THEN 'polyester' WHEN 'Paid' THEN 'completed' ELSE material END AS material
    FROM ({view_sql('materials')})""",
)
def _(spark, folder):
    mapping = {"PES": "polyester", "Paid": "completed", "not there": "x"}
    return Z.apply_mapping(view(spark, folder, "materials"), "material", mapping).select("p_partkey", "material")


@query(
    "fuzzy_candidate_columns",
    facts_sql("dirty_contacts") + " SELECT \"column\" FROM facts WHERE ty IN ('categorical', 'text')",
)
def _(spark, folder):
    df, row = rows_of(spark, folder, "dirty_contacts")
    names = Z.candidate_columns(profile(df, row, quartiles=False))
    return spark.createDataFrame([(n,) for n in names], "column string")
