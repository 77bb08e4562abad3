"""Near-duplicate values: similar pairs, star clusters around frequent values, replacement.

Two texts of lengths a and b with similarity >= t differ by at most
``d = (1 - t/100) (a + b)`` inserted or removed characters. From this follow, for
each text on its own, (1) the lengths it can pair with and (2) how many of its
letter pairs (or letters) a partner can lack. Taking one more of them than that,
in one global order from rare to common, gives every text a few *keys* such that
any two similar texts share one that both keep at the same place of their common
part. That place is moved by no more than the characters inserted before it, or
removed, so a key carries its place, and texts meet on a key only where lengths and
places fit. Nothing similar is lost, texts without a common key are never compared,
and keys are made by built-in functions alone.

Star clusters go through the values in order, in batches of ranks. A batch is as large as
its candidate pairs allow - all values, where they are few - and twice the one before
at most. Its similar pairs settle its centres, and everything after the batch that is
similar to a new centre leaves with it. So a crowd of alike values never forms
its pairs, and the number of batches is bounded by the logarithm of the number of
values and the square root of the candidate pairs over FEW_PAIRS.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftframe.functions.similarity import normal_form, similar_udf, similarity
from siftframe.functions.values import col, dtype_of, show_cell
from siftframe.operators.joins import BROADCAST_ROWS, lookup
from siftframe.operators.profile import ColumnProfile
from siftframe.operators.rowid import ROW_INDEX, with_row_index
from siftframe.work import written

# --- fixed values -----------------------------------------------------------
DEFAULT_THRESHOLD = 80.0
CANDIDATE_TYPES = ("categorical", "text")
# ----------------------------------------------------------------------------

EPS = 1e-6
COMMON_TOKENS = 64  # the most frequent letters and letter pairs are keys last; all others count as rare
EDIT_FILTER_LENGTH = 512  # the built-in edit distance is a cheap test up to this length
BROADCAST_LETTERS = 50_000_000  # most letters of all texts together for them to be broadcast
TILE = 2000  # values of one key compared in one task
BATCH = 1000  # least number of values in a batch
GROUP_RECORD = 100_000  # members of a group in one record, about
FEW_PAIRS = 20_000_000  # candidate pairs of a batch; more if that is
VALUE_PAIRS = 200  # so many per value
ONE_TASK = 500_000  # similar pairs that one task may go through in order


def candidate_columns(prof: list[ColumnProfile]) -> list[str]:
    return [p.column for p in prof if p.inferred_type in CANDIDATE_TYPES]


def text_frequencies(df: DataFrame, column: str, row_id: str = ROW_INDEX) -> DataFrame:
    """(value, n, first_row) per distinct text, without those empty after trimming."""
    value = show_cell(col(column), dtype_of(df, column))
    return (
        df.where(value.isNotNull())
        .groupBy(value.alias("value"))
        .agg(F.count("*").alias("n"), F.min(col(row_id).cast("long")).alias("first_row"))
    )


# --- keys -------------------------------------------------------------------


def _grams(size: int) -> Column:
    """(token, place) of the letters or letter pairs of ``norm``, repeats included."""
    letters = F.filter(F.split("norm", ""), lambda c: c != "")
    following = letters if size == 1 else F.zip_with(letters, F.slice(letters, 2, 1 << 30), lambda a, b: F.concat(a, b))
    # beyond the shorter array the second letter is missing
    known = F.array_compact(following)
    return F.transform(known, lambda token, i: F.struct(token.alias("token"), i.alias("place")))


def _common_tokens(nodes: DataFrame) -> list[str]:
    """The most frequent letters and letter pairs, the rarer first."""
    tokens = F.array_distinct(F.concat(*[F.transform(_grams(n), lambda g: g["token"]) for n in (1, 2)]))
    counts = nodes.select(F.explode(tokens).alias("token")).groupBy("token").count()
    return [r["token"] for r in counts.orderBy(F.desc("count"), "token").limit(COMMON_TOKENS).collect()][::-1]


def _keys(size: int, slack: float, common: list[str]) -> Column:
    """One gram more than a partner can lack, rare ones first; none if it can lack all."""
    lacking = F.floor(F.length("norm") * F.lit(slack) + EPS).cast("int")
    rank = lambda token: F.array_position(F.lit(common), token) if common else F.lit(0)
    ordered = F.array_sort(F.transform(_grams(size), lambda g: F.struct(rank(g["token"]).alias("rank"), g["token"].alias("token"), g["place"].alias("place"))))
    return F.when(F.size(ordered) > lacking, F.slice(ordered, F.lit(1), lacking + 1)).otherwise(F.slice(ordered, 1, 0))


def _keyed(nodes: DataFrame, threshold: float, common: list[str]) -> DataFrame:
    """One row per key of a text: ``length``, ``token`` and ``place`` beside the other columns but ``norm``.

    A text all of whose letter pairs a partner can lack has letters as keys. Those that may pair with such a
    text, by length, have both.
    """
    r = 1 - threshold / 100
    # taking one letter out breaks two pairs, putting one in breaks one; a partner as long as that allows
    pairs = max(4 * r / (1 + r), 2 * r / (1 - r)) if r < 1 else math.inf
    length = F.length("norm")
    keys = []
    if pairs < 1:
        keys.append(_keys(2, pairs, common))
    # pairs lack for lengths n with n - 1 <= pairs * n; partners of these are at most so long
    reach = 1 / (1 - pairs) * (1 + r) / (1 - r) + EPS if pairs < 1 else math.inf
    letters = _keys(1, 2 * r / (1 + r), common)
    keys.append(F.when(length <= F.lit(reach), letters).otherwise(F.slice(letters, 1, 0)))
    rest = [c for c in nodes.columns if c != "norm"]
    found = nodes.select(*rest, length.alias("length"), F.explode(F.concat(*keys)).alias("key"))
    return found.select(*rest, "length", F.col("key.token").alias("token"), F.col("key.place").alias("place"))


def _fits(threshold: float) -> Column:
    """Whether lengths, and the places of a shared key, of sides 1 and 2 allow the threshold."""
    longer = F.col("length2") - F.col("length1")
    edits = (1 - threshold / 100) * (F.col("length1") + F.col("length2")) + EPS
    moved = 2 * (F.col("place2") - F.col("place1"))
    return (F.abs(longer) <= edits) & (moved >= longer - edits) & (moved <= longer + edits)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, small: bool) -> DataFrame:
    """Pairs (id1, id2, ...) that are similar; built-in edit distance first, Python only for survivors.

    ``small``: the texts are few enough, by count and size, to be broadcast.
    """
    side = lambda n: (F.broadcast if small else lambda d: d)(
        texts.select(F.col("id").alias(f"id{n}"), F.col("norm").alias(f"norm{n}"))
    )
    both = pairs.join(side(1), "id1").join(side(2), "id2")
    total = F.length("norm1") + F.length("norm2")
    # removing and inserting one character each can make up for one edit, so
    # the edit distance never exceeds the number of removed and inserted ones
    allowed = F.floor((1 - threshold / 100) * total + EPS).cast("int")
    near = (total > 2 * EDIT_FILTER_LENGTH) | (F.call_function("levenshtein", F.col("norm1"), F.col("norm2"), allowed) >= 0)
    similar = similar_udf(threshold)
    return both.where(near).where(similar("norm1", "norm2")).drop("norm1", "norm2")


class _Facts(NamedTuple):
    n: int
    small: bool  # at most BROADCAST_ROWS texts with BROADCAST_LETTERS letters together


def _facts(texts: DataFrame) -> _Facts:
    row = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("norm")), F.lit(0)).alias("letters")).first()
    return _Facts(row["n"], row["n"] <= BROADCAST_ROWS and row["letters"] <= BROADCAST_LETTERS)


# --- all similar pairs ------------------------------------------------------


def _candidates(left: DataFrame, right: DataFrame, first: Column, threshold: float, heavy: bool) -> DataFrame:
    """Distinct (id1, id2) of keyed texts that share a fitting key and for which ``first`` holds.

    If there may be ``heavy`` keys, with more than TILE texts on the right, these texts are cut into parts, and the
    left ones meet every part, so that no task compares all texts of such a key.
    """
    side = lambda d, n: d.select("token", *[F.col(c).alias(f"{c}{n}") for c in d.columns if c not in ("token", "part", "parts")])
    on = ["token"]
    one, two = side(left, 1), side(right, 2)
    if heavy:
        counts = right.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
        parts = written(counts.select("token", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "heavy-keys")
        known = F.coalesce("parts", F.lit(1))
        one = lookup(one, parts, "token").withColumn("part", F.explode(F.sequence(F.lit(0), known - 1))).drop("parts")
        two = lookup(two, parts, "token").withColumn("part", F.pmod(F.xxhash64("id2"), known).cast("int")).drop("parts")
        on.append("part")
    return one.join(two, on).where(first & _fits(threshold)).select("id1", "id2").distinct()


def similar_pairs(df: DataFrame, column: str, threshold: float = DEFAULT_THRESHOLD, row_id: str = ROW_INDEX) -> DataFrame:
    """(value1, value2, similarity) of all pairs of distinct values at or above the threshold.

    ``value1`` is the one seen first. The result itself grows with the number of
    similar pairs; :func:`star_clusters` does not build them.
    """
    values = text_frequencies(df, column, row_id).select(
        F.col("first_row").alias("id"), "value", normal_form(F.col("value")).alias("norm")
    )
    values = written(values.where("norm <> ''"), "values")
    keyed = written(_keyed(values.select("id", "norm"), threshold, _common_tokens(values)), "keys")
    facts = _facts(values)
    pairs = _candidates(keyed, keyed, F.col("id1") < F.col("id2"), threshold, facts.n > TILE)
    pairs = _verified(pairs, values, threshold, facts.small)
    one = values.select(F.col("id").alias("id1"), F.col("value").alias("value1"))
    two = values.select(F.col("id").alias("id2"), F.col("value").alias("value2"))
    named = pairs.join(one, "id1").join(two, "id2")
    return named.select("value1", "value2", similarity(F.col("value1"), F.col("value2")).alias("similarity"))


# --- star clusters ----------------------------------------------------------


def _candidate_pairs(keyed: DataFrame) -> float:
    """Pairs of texts per key, added up over the keys; the key counts are combined map-side."""
    counts = keyed.groupBy("token").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]


def _in_order(links: pd.DataFrame) -> pd.DataFrame:
    """Members and their centres, going through the linked texts from the best rank on."""
    centre: dict[int, int] = {}
    members = []
    for worse, better in links.sort_values(["worse", "better"])[["worse", "better"]].itertuples(index=False):
        # links of a text come together, the best neighbour first; neighbours are settled before
        if worse not in centre and centre.get(better, better) == better:
            centre[worse] = better
            members.append((worse, better))
    return pd.DataFrame(members, columns=["rank", "centre"])


def _one_by_one(links: DataFrame) -> DataFrame:
    return links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_in_order, "rank long, centre long")


def _settled(links: DataFrame) -> DataFrame:
    """(rank, centre) of the members that the similar pairs (better, worse) make.

    A text without an undecided better neighbour is a centre and its neighbours are members.
    Few pairs are gone through in one task, in order; else a round takes the pairs of all such
    centres away, so that rounds are as many as the longest chain of better neighbours.
    """
    if links.count() <= ONE_TASK:
        return _one_by_one(links)
    every, members = links, links.select(F.col("worse").alias("rank")).limit(0)
    while not links.isEmpty():
        heads = links.select("better").join(links.select(F.col("worse").alias("better")), "better", "left_anti").distinct()
        taken = written(links.join(heads, "better", "left_semi").select(F.col("worse").alias("rank")).distinct(), "members")
        members = members.unionByName(taken)
        for end in ("better", "worse"):
            links = links.join(taken.select(F.col("rank").alias(end)), end, "left_anti")
        links = written(links, "links")
    members = written(members, "members")
    from_centres = every.join(members.select(F.col("rank").alias("better")), "better", "left_anti")
    return from_centres.groupBy(F.col("worse").alias("rank")).agg(F.min("better").alias("centre"))


def _ranked(nodes: DataFrame, most: int) -> DataFrame:
    """The nodes (weight, id, norm) with their rank by weight and id; there are ``most`` of them or fewer."""
    if most <= BROADCAST_ROWS:
        # so few rows are numbered in one task
        return nodes.withColumn("rank", F.row_number().over(Window.orderBy("weight", "id")) - F.lit(1).cast("long"))
    return with_row_index(nodes, ["weight", "id"], name="rank")


def _clustered(nodes: DataFrame, facts: _Facts, threshold: float) -> DataFrame:
    """(rank, centre) of all members among the nodes (rank, norm), ranks 0 to n - 1."""
    texts, n = nodes.select(F.col("rank").alias("id"), "norm"), facts.n
    before = F.col("id1") < F.col("id2")
    similar = lambda pairs: _verified(pairs, texts, threshold, facts.small)
    named = lambda pairs: pairs.select(F.col("id1").alias("better"), F.col("id2").alias("worse"))
    if n <= BATCH:  # any keys will do, and one task has all pairs
        keyed = _keyed(texts, threshold, [])
        return _one_by_one(named(similar(_candidates(keyed, keyed, before, threshold, False))))
    keyed = written(_keyed(texts, threshold, _common_tokens(nodes)), "keys")
    few = max(FEW_PAIRS, VALUE_PAIRS * n)
    opened, low, size = keyed, 0, n
    if n * (n - 1) / 2 > few and _candidate_pairs(keyed) > few:
        size = BATCH
    members = None
    while low < n:
        inside = opened.where(F.col("id") < low + size)
        while size > BATCH and low + size < n and _candidate_pairs(inside) > few:
            size = max(BATCH, size // 2)
            inside = opened.where(F.col("id") < low + size)
        found = written(_settled(written(named(similar(_candidates(inside, inside, before, threshold, size > TILE))), "links")), "members")
        if low + size < n:
            after = opened.where(F.col("id") >= low + size)
            centres = inside.join(found.select(F.col("rank").alias("id")), "id", "left_anti")
            late = similar(_candidates(centres, after, F.lit(True), threshold, True))
            late = written(late.groupBy(F.col("id2").alias("rank")).agg(F.min("id1").alias("centre")), "late-members")
            opened = written(after.join(late.select(F.col("rank").alias("id")), "id", "left_anti"), "open-keys")
            found = found.unionByName(late)
        members = found if members is None else members.unionByName(found)
        low, size = low + size, 2 * size
    return members


def star_clusters(df: DataFrame, column: str, threshold: float = DEFAULT_THRESHOLD, row_id: str = ROW_INDEX) -> DataFrame:
    """(canonical, member, n, first_row, canonical_n): groups of more than one value, one row per member.

    Values are taken from the most frequent on (first seen on ties). Each not yet
    grouped value becomes a centre and takes in all ungrouped values similar to
    *it* - not to each other. Equivalently: a value is a centre if no better value
    similar to it is one, and any other value belongs to its best similar centre.
    """
    raw = written(text_frequencies(df, column, row_id).withColumn("norm", normal_form(F.col("value"))), "texts")
    raw = raw.where("norm <> ''")
    # spellings equal in normal form share their fate; the best of them stands for all
    best = raw.groupBy("norm").agg(F.min(F.struct((-F.col("n")).alias("weight"), F.col("first_row").alias("id"))).alias("best"))
    nodes = written(_ranked(best.select("best.weight", "best.id", "norm"), raw.count()), "nodes")
    facts = _facts(nodes)
    if not facts.n:
        none = F.lit(0).cast("long")
        return raw.limit(0).select(F.col("value").alias("canonical"), F.col("value").alias("member"), "n", "first_row", none.alias("canonical_n"))
    placed = nodes.select("norm", "rank").join(_clustered(nodes, facts, threshold), "rank", "left")
    members = raw.join(placed.select("norm", F.coalesce("centre", "rank").alias("centre")), "norm")
    members = written(members.select("centre", "value", "n", "first_row"), "clusters")
    best = nodes.select(F.col("rank").alias("centre"), F.col("id").alias("first_row"))
    heads = members.join(best, ["centre", "first_row"]).select(
        "centre", F.col("value").alias("canonical"), F.col("n").alias("canonical_n")
    )
    sizes = members.groupBy("centre").agg(F.count("*").alias("size")).where("size > 1")
    return (
        members.join(sizes.select("centre").join(heads, "centre"), "centre")
        .select("canonical", F.col("value").alias("member"), "n", "first_row", "canonical_n")
    )


def group_records(stars: DataFrame, most: int = GROUP_RECORD) -> DataFrame:
    """(canonical, part, members, frequencies) from :func:`star_clusters`, members from the most frequent on.

    A group of more than ``most`` members has as many numbered parts as it takes, of about that
    size, over which its members are dealt by hash; the canonical value leads part 1.
    """
    # fewer than rows / most groups are so large
    large = stars.groupBy("canonical").count().where(F.col("count") > most)
    parts = large.select("canonical", F.ceil(F.col("count") / most).alias("parts"))
    stars = stars.join(F.broadcast(parts), "canonical", "left")
    dealt = F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))) + 1
    stars = stars.withColumn("part", F.when(F.col("member") == F.col("canonical"), 1).otherwise(dealt))
    order = F.struct(
        (F.col("member") != F.col("canonical")).alias("other"), (-F.col("n")).alias("weight"), "first_row", "member", "n"
    )
    return (
        stars.groupBy("canonical", "part")
        .agg(F.sort_array(F.collect_list(order)).alias("g"))
        .select(
            "canonical",
            "part",
            F.transform("g", lambda s: s["member"]).alias("members"),
            F.map_from_entries(F.transform("g", lambda s: F.struct(s["member"], s["n"]))).alias("frequencies"),
        )
    )


def replacement_map(stars: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """(column, original, standard) for each member other than the canonical one; ``keep`` opts members out."""
    out = stars.where(F.col("member") != F.col("canonical"))
    if keep:
        out = out.where(~F.col("member").isin(keep))
    return out.select(F.lit(column).alias("column"), F.col("member").alias("original"), F.col("canonical").alias("standard"))


# --- replacement ------------------------------------------------------------


def mapping_table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "original string, standard string")


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame | dict[str, str]) -> DataFrame:
    """Replace values found in an (original, standard) table; others, and nulls, stay as they are.

    The column becomes text. An unknown column leaves the table alone.
    """
    if column not in df.columns:
        return df
    if isinstance(mapping, dict):
        mapping = mapping_table(df.sparkSession, mapping)
    keyed = df.withColumn("_key", show_cell(col(column), dtype_of(df, column)))
    table = mapping.select(F.col("original").alias("_key"), F.col("standard").alias("_standard"))
    joined = lookup(keyed, table, "_key")
    return joined.select(
        *[F.coalesce(F.col("_standard"), F.col("_key")).alias(c) if c == column else col(c) for c in df.columns]
    )
