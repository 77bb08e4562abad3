"""Audit of how filters interact: what every order of them keeps, removes and hides.

Documents are reduced to *cells*: per part and mask of failed filters the number of documents, of good
and of toxic ones. There are at most 2^k masks for k filters, however many documents there are, and
counting them combines map-side. Each cell is then folded across the array of all k! orders, a literal
of the plan: ``aggregate`` walks one order and carries whether the cell is already removed,
``transform`` does so for every order. This gives k! x k structs (600 for five filters) weighted by the
cell's counts, and the structs of a part's cells are merged by elementwise sums. No documents
meet in these steps, so a part that holds most of the rows is as cheap as any other.

Copies (filter E of :func:`five_filters`) are told by digest. A row fails if its id is larger than the
least id of its text; groups of copies of any size meet their least id by ``attach``, which keeps the
rows of large groups where they lie. Only digests, ids and flags shuffle, never texts.

Defined results: null text counts as empty, null part as the empty text; a row with a null id is never
a later copy and makes none; rows that repeat an id count each, and do not make copies of one
another; a label row for an unknown id is ignored, and of several rows for one id any 1 counts; a part without failures has its 600 rows as
well; an empty table gives an empty table. Columns of the tables other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import attach, filled
from siftframe.work import written

MOST_FILTERS = 6  # 720 orders; the literal and the structs of a cell grow with the factorial

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def row_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of filters A to D."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_of(filters: Mapping[str, Column]) -> Column:
    """Bit i is set where the i-th filter fails."""
    mask = F.lit(0)
    for i, failed in enumerate(filters.values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return mask.cast("int")


def five_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, good, toxic), one row per document, by the filters A to D and E for later copies."""
    whole = filled(text)
    slim = docs.select(
        F.col(f"`{id}`").alias("id"),
        filled(part).alias("part"),
        mask_of(row_filters(whole)).alias("mask"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
    )
    slim = written(slim, "filter-masks")
    firsts = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = attach(slim, written(firsts, "filter-copies"), "digest", "n", slim.count())
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    masks = found.select("id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))
    flags = labels.groupBy(F.col(f"`{id}`").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    none = F.lit(False)
    return masks.join(flags, "id", "left").select("part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def cells(masks: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and mask."""
    ones = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return masks.groupBy("part", "mask").agg(F.count("*").alias("n"), ones("good"), ones("toxic"))


def _fold(letters: str) -> Column:
    """The structs of one cell, k for each order, in the sequence of the orders."""
    orders = F.lit(["".join(p) for p in permutations(letters)])
    zero = F.lit(0).cast("long")

    def bit(letter: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), (F.instr(F.lit(letters), letter) - 1).cast("int"))

    def step(order: Column, k: Column, gone: Column) -> tuple[Column, Column]:
        """Whether the cell fails the k-th filter, and its struct there."""
        letter = F.substring(order, k, F.lit(1))
        fails = F.col("mask").bitwiseAND(bit(letter)) != 0
        here = fails & ~gone
        counted = {
            "kept": F.when(gone | fails, zero).otherwise(F.col("n")),
            "removed": F.when(here, F.col("n")).otherwise(zero),
            "redundant": F.when(fails & gone, F.col("n")).otherwise(zero),
            "unique_fails": F.when(F.col("mask") == bit(letter), F.col("n")).otherwise(zero),
            "good_lost": F.when(here, F.col("good")).otherwise(zero),
            "toxic_lost": F.when(here, F.col("toxic")).otherwise(zero),
        }
        return fails, F.struct(order.alias("filter_order"), k.alias("step"), letter.alias("letter"), *[c.alias(name) for name, c in counted.items()])

    shape = "array<struct<filter_order:string,step:int,letter:string,{}>>".format(",".join(f"{c}:bigint" for c in COUNTS))
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(shape).alias("steps"))

    def pass_on(order: Column, state: Column, k: Column) -> Column:
        fails, counted = step(order, k, state["gone"])
        return F.struct((state["gone"] | fails).alias("gone"), F.concat(state["steps"], F.array(counted)).alias("steps"))

    places = F.lit(list(range(1, len(letters) + 1)))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(places, start, lambda state, k: pass_on(order, state, k))["steps"]))


def audit(masks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic) per document.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail it, removed before), ``unique_fails``
    (fail it alone), ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``: what the
    step's filter removes, added up over all orders.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with a letter of their own each")
    folded = cells(masks).select("part", _fold(letters).alias("folded"))
    kept = ("filter_order", "step", "letter")

    def added(a: Column, b: Column) -> Column:
        return F.struct(*[a[c].alias(c) for c in kept], *[(a[c] + b[c]).alias(c) for c in COUNTS])

    # a part has at most 2^k cells
    lists = folded.groupBy("part").agg(F.collect_list("folded").alias("lists"))
    first, rest = F.element_at("lists", 1), F.slice("lists", 2, 1 << len(letters))
    merged = lists.select("part", F.aggregate(rest, first, lambda a, b: F.zip_with(a, b, added)).alias("merged"))

    def removed_by(letter: str) -> Column:
        return F.aggregate("merged", F.lit(0).cast("long"), lambda total, s: total + F.when(s["letter"] == letter, s["removed"]).otherwise(0))

    shares = merged.select("part", "merged", F.array(*[removed_by(x) for x in letters]).alias("shares"))
    rows = shares.select("part", "shares", F.explode("merged").alias("s"))
    return rows.select(
        "part",
        *[F.col("s")[c].alias(c) for c in ("filter_order", "step", *COUNTS)],
        F.element_at("shares", F.instr(F.lit(letters), F.col("s")["letter"])).alias("shapley"),
    )
