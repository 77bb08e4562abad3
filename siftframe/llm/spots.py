"""Document fingerprints by spot signatures: chains of content words that follow common words.

Every occurrence of a common word (an anchor: a frequent function word, or a word of just
ANCHOR_LENGTH characters, for texts without such) gives one signature: the anchor and the next two words that are not common. A text's fingerprint is its
set of signatures; a text without any has the set of its words instead. Likeness is the Jaccard
of two sets. Everything is a DataFrame expression.

``near_duplicates`` finds the pairs of a table: texts of equal sets are one class, classes are
partitioned by the size of their set so that only neighbouring sizes meet, and within these a
class is looked up by its rarest signatures alone, as many as a similar set cannot all lack.

Defined results: null text is the empty text; texts without words have the empty fingerprint and
are alike only to each other; a null id comes after all others (in no order that its rows could
be told by); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.llm.common import filled
from siftframe.operators.rowid import with_row_index
from siftframe.work import written

# Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were which with you not but have"
    " als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht sich sie sind und von war wie zu zum zur"
    " au aux avec ce ces cette comme dans de du elle en est et il la le les leur mais ne nous ou par pas plus pour qui que sa se son sont sur un une"
    " al como con del el ella era esta este ha lo los las más no o para pero por sin sobre su sus también y ya"
).split()

ANCHOR_LENGTH = 7  # words of so many characters are anchors too, so that lists and unknown languages have spots
CHAIN = 2  # content words of a signature
BUCKET_ROWS = 5_000  # documents of a stretch of the order that one task walks through
MAX_BUCKETS = 10_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def is_anchor(word: Column) -> Column:
    return word.isin(*ANCHORS) | (F.char_length(word) == ANCHOR_LENGTH)


def with_signatures(rows: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """The rows with the sorted distinct signatures, as eight hexadecimal digits each, of a text column.

    The j-th anchor stands at place i, so i - j content words come before it. Each array is a
    column of its own: inside a lambda it would be made anew for every element.
    """
    short = lambda c: F.substring(F.md5(c.cast("binary")), 1, 8)
    rows = rows.withColumn("all_words", words(F.col(text)))
    places = F.array_compact(F.transform("all_words", lambda w, i: F.when(is_anchor(w), i)))
    rows = rows.withColumns({"places": places, "content": F.filter("all_words", lambda w: ~is_anchor(w))})
    follow = lambda i, j: [F.get("content", i - j + k) for k in range(chain)]
    chains = F.transform("places", lambda i, j: F.when(i - j + chain <= F.size("content"), F.concat_ws(" ", F.get("all_words", i), *follow(i, j))))
    rows = rows.withColumn("chains", F.array_distinct(F.array_compact(chains)))
    units = F.when(F.size("chains") > 0, F.col("chains")).otherwise(F.array_distinct("all_words"))
    rows = rows.withColumn(name, F.sort_array(F.array_distinct(F.transform(units, short))))
    return rows.drop("all_words", "places", "content", "chains")


def likeness(a: str, b: str) -> Column:
    """Jaccard of two signature sets; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(F.col(a)) + F.size(F.col(b)) - common
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


def in_order_with_next(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(stretch, id, text, ahead) such that within a stretch each row's successor in descending id follows.

    The last row of a stretch finds its successor as a copy of the next stretch's first row, which
    is marked ``ahead``; the last stretch is followed by the first. Stretches are bounded by
    quantiles of numeric ids; ids of other types, texts among them, are numbered in their order first. Only ids are
    read to find the bounds.
    """
    slim = docs.select(F.col(f"`{id}`").alias("id"), filled(text).alias("text"))
    if not isinstance(slim.schema["id"].dataType, T.NumericType):
        # equal ids are one place; there are as many places as ids, in the ids' own order
        places = with_row_index(slim.select("id").where("id is not null").distinct(), ["id"], name="place")
        slim = slim.join(written(places, "id-places"), "id", "left")
    else:
        slim = slim.withColumn("place", F.col("id"))
    rows = slim.count()
    stretches = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    cuts: list[float] = []
    value = F.col("place").cast("double")
    if stretches > 1:
        cuts = slim.agg(F.percentile_approx(value, [k / stretches for k in range(1, stretches)], 20 * stretches).alias("q")).first()["q"] or []
    bounds = sorted(set(cuts))
    inner = F.lit(0)
    if bounds:
        # two levels of some hundred bounds at most: which group of bounds, then which of the group
        step = max(1, math.isqrt(len(bounds)))
        groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
        below = lambda xs: F.size(F.filter(F.array(*map(F.lit, xs)), lambda b: b < value))
        slim = slim.withColumn("group", below([g[0] for g in groups]))
        for k, g in enumerate(groups):
            inner = F.when(F.col("group") == k + 1, below(g) + k * step).otherwise(inner)
    numbered = slim.select("id", "text", F.when(F.col("id").isNull(), -1).otherwise(inner).cast("int").alias("stretch"))
    heads = numbered.groupBy("stretch").agg(F.max("id").alias("head"))
    # a row per stretch: the stretch before it in descending order is the next greater one
    order = Window.orderBy(F.col("stretch").desc())
    to = F.coalesce(F.lag("stretch").over(order), F.min("stretch").over(Window.partitionBy()))
    heads = written(heads.select("stretch", "head", to.alias("to")), "stretch-heads")
    first = numbered.join(F.broadcast(heads.withColumnRenamed("stretch", "of")), (F.col("stretch") == F.col("of")) & F.col("id").eqNullSafe(F.col("head")))
    first = first.groupBy("of", "to").agg(F.max(F.struct("id", "text")).alias("row"))
    ahead = first.select(F.col("to").alias("stretch"), F.col("row.id").alias("id"), F.col("row.text").alias("text"), F.lit(True).alias("ahead"))
    return numbered.select("stretch", "id", "text", F.lit(False).alias("ahead")).unionByName(ahead)


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    In the edited text the last third of the code points gives way to as many first ones of the
    next document in descending id. Columns: id, n_chars, edited_text, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    order = Window.partitionBy("stretch").orderBy("ahead", F.col("id").desc_nulls_last(), F.col("text").desc())
    # texts alone shuffle; signatures are made where the stretch lies
    rows = with_signatures(in_order_with_next(docs, id, text).repartition("stretch"), "text", "own")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next": F.lead("own").over(order)}).where("not ahead")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut)))
    rows = with_signatures(rows, "edited_text", "edited")
    joined = lambda c: F.array_join(c, " ")
    return rows.select(
        F.col("id").alias(id),
        n.cast("long").alias("n_chars"),
        "edited_text",
        joined("own").alias("fingerprint"),
        joined("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (id, class) of all texts, and the pairs (a, b, likeness) of classes from the threshold on.

    A class is named by the SHA-256 of its fingerprint. Sets of sizes s and t can only be alike if
    t >= threshold * s, so sizes fall into partitions of that ratio and meet their own and the next.
    """
    slim = docs.select(F.col(f"`{id}`").alias("id"), filled(text).alias("text"))
    signed = with_signatures(slim, "text", "own").select("id", "own", F.sha2(F.array_join("own", " "), 256).alias("class"))
    signed = written(signed, "spot-signatures")
    classes = written(signed.where(F.size("own") > 0).groupBy("class").agg(F.any_value("own").alias("own")), "spot-classes")
    sizes = classes.withColumn("part", F.floor(F.log(F.size("own").cast("double")) / math.log(1 / threshold)).cast("int"))
    entries = sizes.select("class", "part", F.size("own").alias("n"), F.explode("own").alias("spot"))
    ranked = entries.join(entries.groupBy("spot").agg(F.count("*").alias("df")), "spot")
    rarest = ranked.groupBy("class", "part", "n").agg(F.sort_array(F.collect_list(F.struct("df", "spot"))).alias("all"))
    need = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    prefix = rarest.select("class", "part", "n", F.explode(F.slice("all", 1, need)).alias("low")).withColumn("spot", F.col("low.spot")).drop("low")
    prefix = written(prefix, "spot-prefixes")
    left = prefix.select(F.col("class").alias("a"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("n").alias("n_a"), F.col("part").alias("own_part"), "spot")
    right = prefix.select(F.col("class").alias("b"), "part", F.col("n").alias("n_b"), "spot")
    once = (F.col("own_part") < F.col("part")) | (F.col("a") < F.col("b"))
    alike = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - F.lit(1e-9)
    pairs = left.join(right, ["part", "spot"]).where(once & alike).select("a", "b").distinct()
    sets = classes.select("class", "own")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("own").alias("y")), "b")
    found = both.select("a", "b", likeness("x", "y").alias("likeness")).where(F.col("likeness") >= threshold - 1e-9)
    return signed.select(F.col("id").alias(id), "class"), found
