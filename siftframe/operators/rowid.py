"""Stable 0-based row numbers without sending the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from siftframe.functions.values import col, dtype_of, fresh
from siftframe.work import written

ROW_INDEX = "row_index"
SPARSE_BITS = 12  # keys are sparse if there is more than a bucket per 2**12 rows,
DENSE_BLOCKS = 64  # beyond so many buckets
BUCKET_BITS = 18  # a bucket of 2**18 consecutive unique integers holds at most that many rows


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row number."""
    return [c for c in df.columns if c != ROW_INDEX]


def _before(order: list[str], size: str) -> Column:
    """Rows of all blocks before a block.

    The input has one row per block (rows / 2**18, or one per input partition or split),
    so ordering it in a single task is cheap at any table size.
    """
    return F.coalesce(F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _finish(df: DataFrame, columns: list[str], number: Column, name: str) -> DataFrame:
    return df.select(*[col(c) for c in columns if c != name], number.cast("long").alias(name))


def _file_order(df: DataFrame, name: str) -> DataFrame | None:
    """Rows by file path, place of the split in the file and place in the split; None if not a file scan.

    Tasks take files by size, so the number of the task says nothing about their order.
    """
    path, start, mid, size, first, last, offset = fresh(df, "_path", "_start", "_mid", "_size", "_first", "_last", "_offset")
    try:
        marked = df.select(
            "*",
            F.col("_metadata.file_path").alias(path),
            F.col("_metadata.file_block_start").alias(start),
            F.monotonically_increasing_id().alias(mid),
        )
        marked.schema  # noqa: B018 - resolves the hidden columns
    except AnalysisException:
        return None
    # a split's rows come to one task one after the other, unless they have been dealt anew since the scan
    blocks = marked.groupBy(path, start).agg(F.count("*").alias(size), F.min(mid).alias(first), F.max(mid).alias(last))
    if not blocks.where(F.col(last) - F.col(first) + 1 != F.col(size)).isEmpty():
        return None
    # bounded by the number of input splits
    offsets = blocks.select(path, start, first, _before([path, start], size).alias(offset))
    joined = marked.join(F.broadcast(offsets), [path, start])
    return _finish(joined, df.columns, F.col(offset) + F.col(mid) - F.col(first), name)


def _by_partition(df: DataFrame, mid: str, columns: list[str], name: str) -> DataFrame:
    """Number rows by their partition and place in it, both held by ``mid``."""
    block, local, size, offset = fresh(df, "_block", "_local", "_size", "_offset")
    marked = df.select("*", F.shiftright(mid, 33).alias(block), F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)).alias(local))
    sizes = marked.groupBy(block).agg(F.count("*").alias(size))
    # bounded by the number of partitions
    joined = marked.join(F.broadcast(sizes.select(block, _before([block], size).alias(offset))), block)
    return _finish(joined, columns, F.col(offset) + F.col(local), name)


def _input_order(df: DataFrame, name: str) -> DataFrame:
    by_file = _file_order(df, name)
    if by_file is not None:
        return by_file
    (mid,) = fresh(df, "_mid")
    return _by_partition(df.withColumn(mid, F.monotonically_increasing_id()), mid, df.columns, name)


def _integer_order(df: DataFrame, key: str, name: str, dense: bool = False) -> DataFrame:
    """By buckets of consecutive integers; ``dense`` keys are known to be unique and without large gaps."""
    block, local, size, offset = fresh(df, "_block", "_local", "_size", "_offset")
    marked = df.withColumn(block, F.shiftright(col(key).cast("long"), BUCKET_BITS))
    sizes = marked.groupBy(block).agg(F.count("*").alias(size))
    if not dense:
        rows, blocks, fullest = sizes.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*"), F.coalesce(F.max(size), F.lit(0))).first()
        if fullest > 1 << BUCKET_BITS or blocks > DENSE_BLOCKS + (rows >> SPARSE_BITS):
            return _key_order(df, [key], name)  # repeated or sparse keys
    number = F.row_number().over(Window.partitionBy(block).orderBy(col(key))) - 1
    # one row per non-empty bucket, so at most rows / 2**18 plus one per gap;
    # left unhinted: the join side size is decided from run-time statistics
    joined = marked.withColumn(local, number).join(sizes.select(block, _before([block], size).alias(offset)), block)
    return _finish(joined, df.columns, F.col(offset) + F.col(local), name)


def _key_order(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    # The input position is the last sort key: ties keep input order, and a key
    # value shared by many rows still splits over several range partitions.
    tie, mid = fresh(df, "_tie", "_mid")
    order = [col(k) for k in keys] + [F.col(tie)]
    placed = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(mid, F.monotonically_increasing_id())
        .drop(tie)
    )
    # Range bounds are sampled, so fix the outcome in a table before counting it.
    return _by_partition(written(placed, "row-index"), mid, df.columns, name)


def with_row_index(
    df: DataFrame,
    order_by: str | list[str] | None = None,
    name: str = ROW_INDEX,
    unique_integer: bool = False,
) -> DataFrame:
    """Add a dense 0-based row number.

    * no ``order_by``: position in the input; two narrow passes, no shuffle of the rows.
      The input must have a fixed row order (a file scan and row-local steps on it).
    * ``unique_integer``: ``order_by`` is one integer column without repeats (an older
      row number, a key). Rows shuffle once by fixed-width integer buckets.
    * otherwise: range partitioning on the keys, written once.
    """
    if order_by is None:
        return _input_order(df, name)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if unique_integer:
        if len(keys) != 1 or not isinstance(dtype_of(df, keys[0]), (T.LongType, T.IntegerType)):
            raise ValueError("unique_integer needs exactly one integer column")
        return _integer_order(df, keys[0], name)
    return _key_order(df, keys, name)


def renumber(df: DataFrame, row_id: str = ROW_INDEX) -> DataFrame:
    """Close the gaps left by removed rows; row order is kept.

    The numbers are those of :func:`with_row_index`, so they need no check before they are used.
    """
    return _integer_order(df, row_id, row_id, dense=True)


def preview(df: DataFrame, n: int = 8, row_id: str = ROW_INDEX) -> DataFrame:
    """First ``n`` rows in row order (a bounded top-n, not a full sort)."""
    return df.orderBy(col(row_id)).limit(n)
