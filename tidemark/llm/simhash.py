"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight (position, byte)
entries. A list for a single entry holds 1/256 of all fingerprints, so lists are kept for the combined entries of
two of four byte pairs: a qualifying pair leaves at least two byte pairs whole and so meets in at least one of the six
lists. For each pair met in a list the shared positional bytes are tallied; pairs that reach the guaranteed number are
verified by their bit distance. Lists longer than ``LIST_ROWS`` (large groups of copies with slightly different
fingerprints) never make pairs: their fingerprints meet at every value within half the distance, which is exact too and
grows with the number of fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, row_slices, text_bytes, WorkTables
from tidemark.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Longest list of which pairs are made.
LIST_ROWS = 64
# A-Z to a-z, other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: a bit is set if it is set in more than half of the shingles' hashes; no words: 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    size = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "t"):
            found = np.fromiter((fingerprint(t, shingle_words) for t in rows.column("t").to_pylist()), np.uint64, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _index(prints: DataFrame) -> DataFrame:
    """Posting rows (list, key, fp): six lists, each keyed by the bytes of two of the four byte pairs."""
    part = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    entries = F.array(*[F.struct(F.lit(n).alias("list"), (part[i] * 65536 + part[j]).alias("key")) for n, (i, j) in enumerate(pairs)])
    return prints.select("fp", F.explode(entries).alias("e")).select("e.list", "e.key", "fp")


def links(prints: DataFrame, tables: WorkTables, max_bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all pairs within ``max_bits`` bits.

    Pairs from short lists are edges themselves. Fingerprints of long lists are linked through the smallest
    fingerprint within one bit of a common value: any two of those differ by at most two bits, and any two that differ
    by at most two bits have such a value in common, so components are exactly those of all pairs.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the lists guarantee a shared entry for at most two differing bits")
    index = tables.write("index", _index(prints))
    sizes = index.groupBy("list", "key").count().where(F.col("count") > 1)
    posted = tables.write("posted", index.join(sizes, ["list", "key"]))
    short = posted.where(F.col("count") <= list_rows).drop("count")
    other = short.withColumnRenamed("fp", "fp2")
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    tally = sum((F.shiftrightunsigned(differ, 8 * i).bitwiseAND(0xFF) == 0).cast("int") for i in range(8))
    pairs = (
        short.join(other, ["list", "key"])
        .where((F.col("fp") < F.col("fp2")) & (tally >= 8 - max_bits) & (F.bit_count(differ) <= max_bits))
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    long = posted.where(F.col("count") > list_rows).select("fp").distinct()
    if max_bits == 0:
        return pairs.distinct()
    near = long.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("centre"))
    if max_bits == 1:
        # Fingerprints with a centre in common may differ by two bits; here the centre itself must be a fingerprint.
        ends = near.join(long.select(F.col("fp").alias("end")), F.col("centre") == F.col("end")).where(F.col("fp") < F.col("end"))
        return pairs.unionByName(ends.select(F.col("fp").alias("a"), F.col("end").alias("b"))).distinct()
    hubs = near.groupBy("centre").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where(F.col("hub") < F.col("top"))
    stars = near.join(hubs, "centre").where(F.col("fp") != F.col("hub")).select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: the smallest doc_id reachable over links, itself included.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal ids and texts come out as
    often as they came in; a null id keeps its fingerprint and gets its component's smallest id (null if it
    has none). Other columns, whatever their names, are not read. No rows: no rows.
    """
    tables = WorkTables(docs.sparkSession, "simhash")
    prints = tables.write("prints", fingerprints(docs, shingle_words, id_col, text_col))
    distinct = tables.write("distinct", prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = _roots(distinct, tables, max_bits)
    ids = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = roots.join(ids, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _roots(distinct: DataFrame, tables: WorkTables, max_bits: int) -> DataFrame:
    """Distinct fingerprints (fp, least) with their component."""
    grouped = components(links(distinct.select("fp"), tables, max_bits), tables)
    roots = distinct.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    return tables.write("roots", roots)


def one_per_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, all columns kept: that with the smallest doc_id.

    Rows of one id are judged row by row: unlike texts are in groups of their own and all stay. Of a group's rows with one id, that with
    the smallest fingerprint and then the smallest hash of all columns stays, whatever the order of rows; rows equal in every column are
    one. Rows without an id cannot be named as anyone's copy and stay. Null, empty and blank texts are one group, texts of any
    length have one fingerprint; columns may have any names; no rows: no rows.
    """
    tables = WorkTables(docs.sparkSession, "simhash")
    row = free_name("_row", docs)
    marked = docs.where("doc_id is not null").withColumn(row, F.xxhash64(*[docs[c] for c in docs.columns]))
    prints = tables.write("prints", fingerprints(marked, shingle_words, row, "text").distinct().withColumnRenamed("doc_id", "row"))
    ids = marked.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).distinct()
    distinct = prints.join(ids, "row").groupBy("fp").agg(F.min(F.struct("id", "row")).alias("least"))
    roots = _roots(tables.write("distinct", distinct), tables, max_bits)
    first = roots.groupBy("component").agg(F.min(F.struct("least.id", "fp", "least.row")).alias("first"))
    chosen = marked.join(first.select(F.col("first.row").alias(row)), row, "left_semi").dropDuplicates([row])
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id is null"))
