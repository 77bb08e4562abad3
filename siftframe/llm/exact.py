"""Exact duplicates by two-pass Bloom filtering.

The first pass turns every text hash into a few positions of a blocked Bloom filter
whose positions count to two. A text that occurs twice has all its positions counted
twice; so the second pass calls rows *possibly repeated* by looking them up, and only
those rows shuffle to be compared by their SHA-256. All other rows pass straight through.

Defined results: null text counts as the empty text; a null id is smaller than any other;
rows that repeat both id and text are one document (labelled alike, one of them is left by
``drop_copies``); an empty table gives an empty table; other columns are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import attach, filled, fresh
from siftframe.work import written

BLOCK_BITS = 1 << 16  # positions of a block, so that one is an unsigned 16-bit number
BITS_PER_ROW = 16
PROBES = 4  # at 16 bits a row, about 0.2 % of the unique rows are called possibly repeated
PARTIAL_ROWS = 1 << 18  # rows of a task that one partial filter covers
BROADCAST_BLOCKS = 8192  # of 8 KB each: 64 MB at most are broadcast at a time
SLICES = 32


def _addresses(text: str, blocks: int) -> list:
    """Block number and the packed positions in it."""
    return [F.pmod(F.xxhash64(filled(text)), F.lit(blocks)).alias("block"), F.xxhash64(filled(text), F.lit(PROBES)).alias("probes")]


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block: positions counted, and those counted more than once, as 16-bit numbers."""

    def filters(block: np.ndarray, probes: np.ndarray) -> pd.DataFrame:
        spots = probes.astype(np.uint64)[:, None] >> (np.arange(PROBES, dtype=np.uint64) * np.uint64(16))
        keys = (block.astype(np.uint64)[:, None] << np.uint64(16)) | (spots & np.uint64(0xFFFF))
        keys, counts = np.unique(keys.ravel(), return_counts=True)
        owner, spot = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype("<u2")
        cuts = np.flatnonzero(np.diff(owner)) + 1
        return pd.DataFrame(
            {
                "block": owner[np.r_[0, cuts]] if len(owner) else owner,
                "seen": [x.tobytes() for x in np.split(spot, cuts)] if len(owner) else [],
                "again": [x[c > 1].tobytes() for x, c in zip(np.split(spot, cuts), np.split(counts, cuts))] if len(owner) else [],
            }
        )

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= PARTIAL_ROWS:
            whole = pd.concat(held)
            held, rows = [], 0
            yield filters(whole["block"].to_numpy(), whole["probes"].to_numpy())
    if held:
        whole = pd.concat(held)
        yield filters(whole["block"].to_numpy(), whole["probes"].to_numpy())


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """Bit words of the positions that two or more rows have."""
    counts = np.zeros(BLOCK_BITS, np.uint8)
    for seen, again in zip(group["seen"], group["again"]):
        spots = np.frombuffer(seen, "<u2")
        counts[spots] = np.minimum(counts[spots] + 1, 2)
        counts[np.frombuffer(again, "<u2")] = 2
    words = np.packbits(counts > 1, bitorder="little").view("<i8")
    return pd.DataFrame({"block": [group["block"].iloc[0]], "words": [words]})


def repeat_filter(docs: DataFrame, text: str) -> tuple[DataFrame, int, int]:
    """The filter of positions counted twice (block, words), its number of blocks, the rows counted."""
    rows = docs.count()
    blocks = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    partial = docs.select(*_addresses(text, blocks)).mapInPandas(_partial, "block long, seen binary, again binary")
    merged = partial.groupBy("block").applyInPandas(_merged, "block long, words array<long>")
    return written(merged, "repeat-filter"), blocks, rows


def _hit(bits: str, probes: Column) -> Column:
    """Whether all positions are set in the bit words."""
    hit = F.lit(True)
    for k in range(PROBES):
        spot = F.shiftrightunsigned(probes, 16 * k).bitwiseAND(F.lit(0xFFFF))
        word = F.element_at(bits, (F.shiftright(spot, 6) + 1).cast("int"))
        # the shift distance is a column, so the bit is tested in SQL
        hit = hit & (F.call_function("bit_get", word, spot.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return F.coalesce(hit, F.lit(False))


def mark_possible_repeats(docs: DataFrame, text: str, flag: str) -> tuple[DataFrame, int]:
    """The rows with a boolean column: false means that no other row has this text.

    A filter of at most BROADCAST_BLOCKS blocks is broadcast. A larger one is cut into slices of so many, each a
    broadcast that answers for the rows of its blocks, so that rows stay where they are: up to SLICES of them, with which
    executors hold 2 GB for a billion rows. Beyond that the rows are joined with the filter on the block and shuffle whole,
    so callers with more rows bring a digest instead of the text, as ``label_copies`` always does.
    """
    words, blocks, rows = repeat_filter(docs, text)
    block, probes, bits = fresh(docs, "block", "probes", "words")
    words = words.select(F.col("block").alias(block), F.col("words").alias(bits))
    marked = docs.withColumns(dict(zip((block, probes), (c for c in _addresses(text, blocks))))).withColumn(flag, F.lit(False))
    if blocks <= BROADCAST_BLOCKS:
        parts = [F.broadcast(words)]
    elif blocks <= BROADCAST_BLOCKS * SLICES:
        parts = [F.broadcast(words.where(F.col(block).between(low, low + BROADCAST_BLOCKS - 1))) for low in range(0, blocks, BROADCAST_BLOCKS)]
    else:
        parts = [words]
    for part in parts:
        marked = marked.join(part, block, "left").withColumn(flag, F.col(flag) | _hit(bits, F.col(probes))).drop(bits)
    return marked.drop(block, probes), rows


def label_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, keep_id (the largest id of equal texts), group_size, kept, text_sha256."""
    # no text passes this line, so whatever shuffles is a digest with an id
    slim = docs.select(F.col(f"`{id}`").alias("id"), F.sha2(filled(text), 256).alias("sha"))
    marked, rows = mark_possible_repeats(slim, "sha", "maybe")
    maybe = written(marked.where("maybe").drop("maybe"), "possible-repeats")
    groups = written(maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1"), "copy-groups")
    alone = marked.where("not maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    found = attach(maybe, groups, "sha", "n", rows)
    found = found.select("id", "sha", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"))
    return alone.unionByName(found).select(
        F.col("id").alias(id),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all their columns, of equal texts only the one with the largest id."""
    flag, sha, keep = fresh(docs, "maybe", "sha", "keep_id")
    marked, _ = mark_possible_repeats(docs, text, flag)
    maybe = marked.where(flag).drop(flag).withColumn(sha, F.sha2(filled(text), 256))
    winners = maybe.groupBy(sha).agg(F.max(f"`{id}`").alias(keep))
    # a group meets its winner on (hash, id), which no two documents share: no hot key
    pairs = winners.select(F.col(sha).alias("_h"), F.col(keep).alias("_i"))
    kept = maybe.join(pairs, (maybe[sha] == pairs["_h"]) & maybe[f"`{id}`"].eqNullSafe(pairs["_i"]), "left_semi")
    kept = kept.dropDuplicates([sha, id]).drop(sha)
    return marked.where(~F.col(flag)).drop(flag).unionByName(kept)
