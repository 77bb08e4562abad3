"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation of the 32-bit circle scatters the shingles, a second one, shifted by k places,
gives the k-th signature coordinate as its least value. Coordinates are hashed in bands; sets
that share a band are candidates and are verified on their full shingle sets.

No pair list of a crowded band is ever formed. Equal sets are one vertex. In every band the
member whose bands are fullest is compared with all others; members that this leaves in other
components than the centre are then compared with the rest of the band, in blocks of bounded
size, so that every candidate pair that is not already connected is verified. What can be
missed is only a pair that shares no band: with 24 bands of 4 coordinates, 3 in a million
pairs at a Jaccard of 0.8 and fewer above.

Defined results: null text and text without words have the empty set and are linked with
nothing; a text of fewer words than a shingle is one shingle of its own; rows with null id take
part like others and count as larger than any id; rows that repeat an id and text are one
document; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import attach, filled, fresh, stretches
from siftframe.llm.components import components
from siftframe.work import written

BANDS = 24
ROWS = 4  # coordinates of a band
CACHED_WORDS = 1 << 16
SLICE = 1 << 16  # shingles hashed at once
STRAGGLERS, MEMBERS = 128, 512  # of a block of comparisons
BROADCAST_KEYS = 500_000  # of about 40 bytes each

_U = np.uint64


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = Words()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; bytes.lower and bytes.split are exactly A-Z and ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if not n:
        return hashes
    width = min(width, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = _mix64(h * _U(3) + hashes[k : n - width + 1 + k])
    return np.unique(h)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Least places, in each shift of the permutation, of sets that are not empty."""
    out = np.empty((len(sets), coordinates), np.uint32)
    scattered = [(_mix64(s + _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32) for s in sets]
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= SLICE):
            size += len(sets[end])
            end += 1
        places = np.concatenate(scattered[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        for k in range(coordinates):
            out[at:end, k] = np.minimum.reduceat(_permuted(places + np.uint32(k)), starts)
        at = end
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        h = _mix64(h * _U(0x100000001B3) + parts[:, :, k])
    return h.view(np.int64)


def _key(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def _signed(width: int, bands: int, rows: int):
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, part in ((b, part) for b in batches for part in stretches(b["text"].tolist())):
            sets = [shingles(t, width) for t in batch["text"].iloc[part]]
            known = [s for s in sets if len(s)]
            hashes = iter(band_hashes(signatures(known, bands * rows), bands, rows)) if known else iter(())
            yield pd.DataFrame({"id": batch["id"].iloc[part].to_numpy(), "n": [len(s) for s in sets], "key": [_key(s) if len(s) else None for s in sets], "bands": [next(hashes) if len(s) else None for s in sets]})

    return signed


def _links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Verified links of a block: of each straggler one to every other component that has one."""
    members, stragglers = group[~group["straggler"]], group[group["straggler"]]
    found = []
    if len(members) and len(stragglers):
        sizes = members["grams"].map(len).to_numpy()
        values, codes = np.unique(np.concatenate(members["grams"].to_list()), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        labels = members["label"].to_numpy()
        keys = members["key"].to_numpy()
        for key, label, grams in zip(stragglers["key"], stragglers["label"], stragglers["grams"]):
            at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
            hit = np.zeros(len(values), np.int64)
            hit[at[values[at] == grams]] = 1
            common = np.add.reduceat(hit[codes], starts)
            near = 100 * common >= percent * (sizes + len(grams) - common)
            seen = {label}
            for k in np.flatnonzero(near):
                if labels[k] not in seen:
                    seen.add(labels[k])
                    found.append((key, keys[k]))
    return pd.DataFrame(found, columns=["a", "b"])


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id of its component), kept.

    ``options``: width (words of a shingle, 5), percent (of the union, 80), bands and rows (of a signature).
    """
    return _grouped(docs, id, text, **options).drop("set_key")


def _grouped(docs: DataFrame, id: str, text: str, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As ``near_groups`` with ``set_key``, which tells the shingle sets of rows with one id apart; null for the empty set."""
    slim = docs.select(F.col(f"`{id}`").alias("id"), filled(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    signed = written(slim.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(_signed(width, bands, rows), "id string, n long, key binary, bands array<long>").withColumn("id", F.col("id").cast(kind)), "signatures")
    total = signed.count()
    vertices = written(signed.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "vertices")

    entries = vertices.select("key", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    crowded = written(entries.join(buckets, "bucket"), "crowded-bands")
    fullness = crowded.groupBy("key").agg(F.sum("m").alias("full"))
    placed = crowded.join(fullness, "key")
    centres = written(placed.groupBy("bucket").agg(F.max(F.struct("full", "key"))["key"].alias("centre")), "band-centres")

    # the full sets of candidates, from the one row that stands for each
    wanted = vertices.join(crowded.select("key").distinct(), "key", "left_semi").select(F.col("id").alias("of"), "key")
    texts = slim.join(_small(wanted), slim["id"].eqNullSafe(F.col("of"))).select("key", "text")

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, part in ((b, part) for b in batches for part in stretches(b["text"].tolist())):
            pairs = zip(batch["key"].iloc[part], (shingles(t, width) for t in batch["text"].iloc[part]))
            right = [(key, s.view(np.int64)) for key, s in pairs if _key(s) == key]  # an id may repeat
            yield pd.DataFrame(right, columns=["key", "grams"])

    grams = written(texts.mapInPandas(gathered, "key binary, grams array<long>").dropDuplicates(["key"]), "candidate-sets")

    star = crowded.join(centres, "bucket").where("key <> centre").select("key", "centre").distinct()
    one = grams.join(_small(star), "key")
    pairs = one.join(grams.select(F.col("key").alias("centre"), F.col("grams").alias("other")), "centre")
    common = F.size(F.array_intersect("grams", "other"))
    near = 100 * common >= percent * (F.size("grams") + F.size("other") - common)
    star_links = written(pairs.where(near).select(F.col("key").alias("a"), F.col("centre").alias("b")), "centre-links")
    labels = components(star_links)

    # what the centres have not joined: stragglers of a band against its other components
    known = crowded.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    main = centres.join(labels.withColumnRenamed("key", "centre"), "centre", "left").select("bucket", "centre", F.coalesce("label", "centre").alias("main"))
    mixed = written(mixed.join(main, "bucket"), "mixed-bands")
    open_rows = written(known.join(_small(mixed), "bucket").where("key <> centre").select("bucket", "key", "label", (F.col("label") != F.col("main")).alias("straggler")), "open-bands")
    sizes = open_rows.groupBy("bucket").agg(F.count_if("straggler").alias("u"), F.count("*").alias("w")).where("u > 0 and w > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("u") / STRAGGLERS).alias("across"), F.ceil(F.col("w") / MEMBERS).alias("down"))
    sized = open_rows.join(_small(written(sizes, "open-band-sizes")), "bucket")
    own = lambda n: F.pmod(F.xxhash64("key"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    blocks = sized.where("straggler").select("bucket", own(F.col("across")).alias("i"), every(F.col("down")).alias("j"), "key", "label", "straggler")
    blocks = blocks.unionByName(sized.select("bucket", every(F.col("across")).alias("i"), own(F.col("down")).alias("j"), "key", "label", F.lit(False).alias("straggler")))
    compared = blocks.join(grams, "key").groupBy("bucket", "i", "j").applyInPandas(lambda group: _links(group, percent), "a binary, b binary")
    more = written(compared.distinct(), "straggler-links")
    if not more.isEmpty():
        labels = components(star_links.unionByName(more))

    joined = labels.join(vertices.select("key", "id"), "key")
    least = joined.groupBy("label").agg(F.min("id").alias("least"))
    heads = joined.join(least, "label").select("key", "least")
    heads = written(vertices.select("key", "id", "copies").join(heads, "key", "left").select("key", F.coalesce("least", "id").alias("head"), "copies"), "component-heads")
    found = attach(signed.where("n > 0").select("id", "n", "key"), heads, "key", "copies", total).select("id", "n", "head", "key")
    empty = signed.where("n = 0").select("id", "n", F.col("id").alias("head"), "key")
    kept = F.col("id").eqNullSafe(F.col("head")).alias("kept")
    return found.unionByName(empty).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("head").alias("component_id"), kept, F.col("key").alias("set_key"))


def drop_near(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows with all their columns, of every group of near-duplicates only the least id; null ids stay.

    Rows that share an id are told apart by their shingle sets: a row goes only if its own set is in
    the group of a lesser id.
    """
    gone, key, mine = fresh(docs, "near_id", "near_key", "near_own")
    found = _grouped(docs, id, text, **options).where("not kept and set_key is not null")
    dropped = found.select(F.col(f"`{id}`").alias(gone), F.col("set_key").alias(key)).where(F.col(gone).isNotNull())
    dropped = written(dropped.distinct(), "near-copies")
    # an id of one row in the table goes with its row; only the texts of repeated ids are looked at again
    repeated = docs.groupBy(F.col(f"`{id}`").alias(gone)).count().where("count > 1").select(gone)
    repeated = written(dropped.select(gone).distinct().join(repeated, gone, "left_semi"), "repeated-ids")
    single = docs.join(_small(dropped.join(repeated, gone, "left_anti").select(gone)), F.col(f"`{id}`") == F.col(gone), "left_anti")
    if repeated.isEmpty():
        return single
    shared = F.col(f"`{id}`") == F.col(gone)
    width = options.get("width", 5)

    @F.pandas_udf("binary")
    def set_key(texts: pd.Series) -> pd.Series:
        sets = [shingles(t, width) for t in texts]
        return pd.Series([_key(s) if len(s) else None for s in sets], dtype=object)

    told = docs.join(_small(repeated), shared, "left_semi").withColumn(mine, set_key(filled(text)))
    told = told.join(_small(dropped), shared & F.col(mine).eqNullSafe(F.col(key)), "left_anti").drop(mine)
    return single.join(_small(repeated), shared, "left_anti").unionByName(told)
