"""Small helpers the operators of this package share."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators.skew import hot_keys, salted_join

#: White space and words, as every operator of this package understands them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one key that a task takes without splitting it.
ROWS_PER_SALT = 200


def by_value(module: str) -> None:
    """Send the module's functions to the workers by value, so they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents from which no label is learned; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def map_rows(rows: DataFrame, fn, outputs: str) -> DataFrame:
    """``mapInPandas`` over rows with a ``doc_id``, which passes through as text: beside nulls, pandas would round large whole numbers."""
    kind = rows.schema["doc_id"].dataType
    through = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(fn, f"doc_id string, {outputs}")
    return through.withColumn("doc_id", F.col("doc_id").cast(kind))


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], salt_on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join each row with the facts of its key; keys with many rows are split by a hash of ``salt_on``.

    ``facts`` has one row per key. The keys' rows are counted with map-side combine.
    """
    return salted_join(rows, facts, keys, salt_on, how, rows_per_salt=ROWS_PER_SALT)


def salts_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with many rows and their number of salts (``_salts``): a bounded table, see ``hot_keys``."""
    return hot_keys(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, ROWS_PER_SALT)


def sample_by_hash(df: DataFrame, on: Column, bound: int) -> DataFrame:
    """About ``bound`` rows, all if there are fewer, the same in every run: the rows with the least hashes."""
    rows = df.count()
    if rows <= bound:
        return df
    return df.where(F.xxhash64(on, F.lit("sample")) < F.lit(least_hash(rows, bound)))


def least_hash(rows: int, bound: int) -> int:
    """The 64-bit hash below which about ``bound`` of ``rows`` hashes lie, for any number of rows."""
    return bound * 2**64 // rows - 2**63
