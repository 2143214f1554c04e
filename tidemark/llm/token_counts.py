"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Texts are encoded where they are read; only (length, documents) leaves a task. From there on all work is on
distinct lengths: suffix sums give, for every limit, the documents and tokens at or above it, the tokens left when
every document is cut to it, and any quantile. Suffix sums are taken per bucket of lengths and then within it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import WorkTables, bound_batches, row_slices, text_bytes

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the public vocabulary splits texts before merging, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space of this length makes the encoder's own splitting exhaust its stack.
LONG_BLANKS = re.compile(r"\s{1000}")
BUCKET = 1024


@lru_cache(maxsize=2)
def _encoder(ranks_file: str):
    import regex
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), regex.compile(SPLIT), frozenset(ranks)


def count_tokens(text: str, ranks_file: str = RANKS_FILE) -> int:
    """Exact number of tokens; texts with very long white space are split here and encoded piece by piece."""
    encoder, split, ranks = _encoder(ranks_file)
    if LONG_BLANKS.search(text) is None:
        return len(encoder.encode_ordinary(text))
    total = 0
    for piece in split.finditer(text):
        data = piece[0].encode()
        total += 1 if data in ranks else len(encoder._encode_single_piece(data))
    return total


def lengths(docs: DataFrame, ranks_file: str = RANKS_FILE, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, length) per row of ``docs``; null and empty texts have length 0. ``ranks_file`` must be on every worker."""
    bound_batches(docs.sparkSession)
    keys = [f"_by_{i}" for i in range(len(by))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "t"):
            found = np.fromiter((count_tokens(t.decode("utf-8", "replace"), ranks_file) for t in rows.column("t").to_pylist()), np.int64, rows.num_rows)
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), pa.array(found)], [*keys, "length"])

    picked = docs.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], text_bytes().alias("t"))
    schema = ", ".join([*(f"{k} {t}" for k, (_, t) in zip(keys, picked.dtypes)), "length long"])
    return picked.mapInArrow(run, schema).select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "length")


def histogram(docs: DataFrame, ranks_file: str = RANKS_FILE, by: tuple[str, ...] = ()) -> DataFrame:
    """Per (*by, length): n_docs, n_tokens, docs_at_least, tokens_at_least, total_docs, total_tokens, truncated_tokens.

    ``truncated_tokens`` is the sum of all lengths cut to ``length``; for a limit between two rows take the next
    longer row: its ``docs_at_least`` times the limit plus the tokens of all shorter documents. No rows: no rows. Columns
    named in ``by`` may hold nulls, which form one group; other columns are not read.
    """
    counts = lengths(docs, ranks_file, by).groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n_docs"))
    # Bucket sums and suffix sums both read it; the texts are encoded once.
    counts = WorkTables(docs.sparkSession, "lengths").write("counts", counts)
    counts = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("bucket", F.floor(F.col("length") / BUCKET))
    return suffix_sums(counts, by)


def suffix_sums(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    totals = counts.groupBy(*by, "bucket").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    longer = Window.partitionBy(*by).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    above = totals.select(
        *[F.col(b).alias(f"_{b}") for b in by],
        F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum("_docs").over(longer), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("_tokens").over(longer), F.lit(0)).alias("tokens_above"),
        F.sum("_docs").over(whole).alias("total_docs"),
        F.sum("_tokens").over(whole).alias("total_tokens"),
    )
    same = F.col("bucket") == F.col("_bucket")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    own = Window.partitionBy(*by, "bucket").orderBy(F.col("length").desc())
    joined = counts.join(above, same).select(
        *by,
        "length",
        "n_docs",
        "n_tokens",
        (F.col("docs_above") + F.sum("n_docs").over(own)).alias("docs_at_least"),
        (F.col("tokens_above") + F.sum("n_tokens").over(own)).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    return joined.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens of all documents cut to ``limit``, from one histogram without ``by``; 0 without documents."""
    row = hist.agg(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs"))).first()
    return row[0] or 0


def quantile(hist: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share ``q`` of documents does not exceed; None without documents."""
    at_most = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return hist.where((at_most >= F.lit(q) * F.col("total_docs"))).agg(F.min("length")).first()[0]
