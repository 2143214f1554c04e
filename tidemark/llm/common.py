"""What several operators of this subpackage share: work tables, row batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``; a local session that has none gets a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Rows reach Python tasks in batches of about so many bytes: ten thousand texts have no bound of their own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class WorkTables:
    """Tables of one run in a folder of their own below the shared folder.

    Writing a table cuts its lineage: a lost executor costs no more than the tasks that ran on it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores as keep it from being a column of any of the frames, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text, null as no bytes; string columns only reach Python as bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def row_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``; a longer value makes a slice of its own."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1])
        start = 0
        ends = np.cumsum(sizes.astype(np.int64))
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def running(df: DataFrame, key: str, bucket: str, order: list, values: dict) -> DataFrame:
    """``df`` with each of ``values`` (name -> column) summed over the earlier rows of ``key``.

    Two levels: sums per bucket first (map-side), then rows within a bucket, so the rows of one key, however many, are
    spread over its buckets. Rows are ordered by ``bucket`` and then by ``order``.
    """
    totals = df.groupBy(key, bucket).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    ahead = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    skips = totals.select(
        F.col(key).alias("_k"), F.col(bucket).alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_s_{n}") for n in values]
    )
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(skips, F.col(key).eqNullSafe(F.col("_k")) & (F.col(bucket) == F.col("_b")))
    sums = [(F.col(f"_s_{n}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(n) for n, v in values.items()]
    return joined.select(*df.columns, *sums)


class WordHashes(dict):
    """XXH64 of words, remembered up to a bounded number of words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RangeHashes:
    """Hashes of word ranges by prefix sums: sum of h[i] * base**(i - start) modulo 2**64, then mixed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64, out=sums[1:])
        return sums

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((prefix[end] - prefix[start]) * self.down[start] + length * np.uint64(0x9E3779B97F4A7C15))


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
