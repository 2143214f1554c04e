"""Substring dedup by a compacted De Bruijn graph of words.

An edge is a window of ``WINDOW`` words, its nodes are the first and the last ``WINDOW`` - 1 of them. Its multiplicity is the
range of documents it stands in, its source the first place of the smallest of these.

Edges are counted as the assemblers of long sequences do: consecutive edges of a text with one minimiser form a stretch,
which is a row, so a text of n words gives about n / 21 rows. Equal edges have equal minimisers. Where all stretches of a
minimiser are the same words, the stretch has no branch inside and stays one unit; where they differ, the stretches of each kind's
source are taken apart into their edges, which are counted one by one. The units that stand in two documents are the graph. A
join with the nodes that have one way in and one way out lays units that follow each other at their source end to end,
a path. Every place of a unit in a later document is joined to its path, and places that run parallel to the source, word by
word, make up a span.

Stretches and edges are equal if the 128-bit cryptographic digests of their words, taken from the text and not from word
hashes, are equal; that and the parallel coordinates are the check of a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WorkTables, row_slices
from tidemark.llm.passages import ANCHOR, WINDOW, Windows, keyed, without_spans

STRETCH = "anchor long, h1 long, h2 long, tail long, head long, doc_id long, text_key long, start int, n int"
EDGE = "h1 long, h2 long, tail long, head long, doc_id long, text_key long, last long, start int"


class Graph(Windows):
    """Windows that know their words; places count over all texts end to end."""

    def load(self, texts: list[bytes]) -> None:
        super().load(texts)
        self.flat = [word for t in texts for word in t.split()]

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the digests of word ranges; words hold no blank, so a joined text has one reading."""
        flat = self.flat
        found = b"".join(blake2b(b" ".join(flat[a:b]), digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist()))
        halves = np.frombuffer(found, np.int64).reshape(-1, 2)
        return halves[:, 0].copy(), halves[:, 1].copy()

    def node(self, at: np.ndarray) -> np.ndarray:
        return self.hashes(1, at, at + self.window - 1).view(np.int64)

    def columns(self, at: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        """h1, h2, tail and head of ``count`` edges from each place on."""
        return [pa.array(c) for c in (*self.digests(at, at + count - 1 + self.window), self.node(at), self.node(at + count))]


def stretches(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The texts of keyed rows as stretches of edges with one minimiser: its hash, digest, nodes, place, edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(window, anchor)
        for part in row_slices(batches, "t"):
            graph.load(part.column("t").to_pylist())
            doc, at, count, owner, _ = graph.segments()
            own, at, count = pa.array(doc), at.astype(np.int64), count.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner.view(np.int64)),
                    *graph.columns(at, count),
                    part.column("doc_id").take(own),
                    part.column("text_key").take(own),
                    pa.array((at - graph.starts[doc]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                ["anchor", "h1", "h2", "tail", "head", "doc_id", "text_key", "start", "n"],
            )

    return rows.mapInArrow(run, STRETCH)


def edges(rows: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """The single edges of the stretches named by ``wanted`` (doc_id, text_key, start, n, last); ``last`` goes along.

    The list of a text is no longer than the text.
    """
    lists = wanted.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "n", "last"))).alias("parts"))
    joined = rows.join(lists, ["doc_id", "text_key"]).select(
        "doc_id", "text_key", "t", *[F.col(f"parts.{name}").alias(f"{name}s") for name in ("start", "n", "last")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(window)
        for part in row_slices(batches, "t"):
            graph.load(part.column("t").to_pylist())
            starts, counts = part.column("starts"), part.column("ns").flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(part.num_rows), np.diff(starts.offsets.to_numpy()))
            first = starts.flatten().to_numpy().astype(np.int64) + graph.starts[doc]
            at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            doc = np.repeat(doc, counts)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    *graph.columns(at, np.ones(len(at), np.int64)),
                    part.column("doc_id").take(own),
                    part.column("text_key").take(own),
                    pa.array(np.repeat(part.column("lasts").flatten().to_numpy(), counts)),
                    pa.array((at - graph.starts[doc]).astype(np.int32)),
                ],
                ["h1", "h2", "tail", "head", "doc_id", "text_key", "last", "start"],
            )

    return joined.mapInArrow(run, EDGE)


def through_nodes(units: DataFrame) -> DataFrame:
    """(node) of the nodes with one way in and one way out among ``units`` (tail, head)."""
    ways = units.select(F.col("tail").alias("node"), F.lit(1).alias("outs"), F.lit(0).alias("ins")).unionByName(
        units.select(F.col("head").alias("node"), F.lit(0).alias("outs"), F.lit(1).alias("ins"))
    )
    return ways.groupBy("node").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins")).where("outs = 1 and ins = 1").select("node")


def compacted(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s_doc, s_key, s_start, path) of every unit: ``path`` is the word at which its path starts in the source.

    ``units`` are (s_doc, s_key, s_start, n, tail, head), ``nodes`` their through nodes. A path goes on over a through node as
    long as the next unit follows in the same source; the units of a source are no more than its words.
    """
    joined = units.join(nodes.select(F.col("node").alias("head"), F.lit(True).alias("through")), "head", "left")
    along = Window.partitionBy("s_doc", "s_key").orderBy("s_start")
    follows = F.lag("through").over(along) & (F.lag(F.col("s_start") + F.col("n")).over(along) == F.col("s_start"))
    opens = joined.withColumn("opens", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("s_start")))
    return opens.select("s_doc", "s_key", "s_start", F.max("opens").over(along).alias("path"))


def parallel_spans(met: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, end) of the words whose windows follow a path side by side with its source.

    ``met`` holds the places of units in later documents (doc_id, text_key, start, n) with source and path.
    """
    keys = ["doc_id", "text_key", "s_doc", "s_key", "path", "shift"]
    rows = met.withColumn("shift", F.col("start") - F.col("s_start"))
    order = Window.partitionBy(*keys).orderBy("start")
    ahead = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = rows.withColumn("opens", F.when(F.coalesce(F.col("start") > ahead, F.lit(True)), F.col("start")))
    islands = apart.withColumn("start_of", F.max("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*keys, "start_of").agg((F.max(F.col("start") + F.col("n")) - 1 + window).cast("int").alias("end"))
    return spans.select("doc_id", "text_key", F.col("start_of").alias("start"), "end")


def repeated_spans(rows: DataFrame, tables: WorkTables, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, end) of words in windows that also start in a document with a smaller id.

    All tables are written before they are joined, so joins read plain shuffles and a minimiser, a stretch or a unit that
    is met very often is split over several tasks.
    """
    place = F.struct("doc_id", "text_key", "start").alias("source")
    found = tables.write("stretches", stretches(rows, window))
    # Most minimisers stand in one document: their stretches go before anything wide is grouped.
    met_twice = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    found = tables.write("shared", found.join(tables.write("anchors", met_twice.select("anchor")), "anchor", "left_semi"))
    facts = [F.min(place).alias("source"), F.min("tail").alias("tail"), F.min("head").alias("head")]
    kinds = tables.write("kinds", found.groupBy("anchor", "h1", "h2").agg(*facts, F.max("doc_id").alias("last"), F.min("n").alias("n")))
    digest = F.struct("h1", "h2")
    branches = kinds.groupBy("anchor").agg((F.min(digest) < F.max(digest)).alias("branches"))
    kinds = tables.write("sorted_out", kinds.join(tables.write("branches", branches), "anchor"))
    source = [F.col("source.doc_id").alias("s_doc"), F.col("source.text_key").alias("s_key"), F.col("source.start").alias("s_start")]
    kind = kinds.select("anchor", "h1", "h2", *source, "last", "branches")
    places = tables.write("places", found.join(kind, ["anchor", "h1", "h2"]).drop("anchor", "h1", "h2", "tail", "head"))

    # A document may hold the stretch it is the source of more than once.
    wanted = places.where("branches and s_doc = doc_id")
    single = tables.write("edges", edges(rows, wanted, window))
    counted = tables.write(
        "repeated", single.groupBy("h1", "h2").agg(*facts, F.max("last").alias("last")).where("source.doc_id < last").withColumn("n", F.lit(1))
    )

    whole = kinds.where("not branches and source.doc_id < last")
    units = tables.write("units", whole.select(*source, "n", "tail", "head").unionByName(counted.select(*source, "n", "tail", "head")))
    paths = tables.write("paths", compacted(units, tables.write("nodes", through_nodes(units))))

    # Copies of a stretch with branches inside are places of the stretch as a whole, a path of its own.
    copies = places.where("s_doc < doc_id")
    later = single.join(counted.select("h1", "h2", *source), ["h1", "h2"]).where("s_doc < doc_id").withColumn("n", F.lit(1))
    columns = ["doc_id", "text_key", "start", "n", "s_doc", "s_key", "s_start"]
    met = tables.write("met", copies.select(*columns).unionByName(later.select(*columns)))
    placed = met.join(paths, ["s_doc", "s_key", "s_start"], "left").withColumn("path", F.coalesce("path", "s_start"))
    return parallel_spans(placed, window)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with each passage of ``window`` words or more left only in the document with the smallest id.

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller doc_id; windows
    are judged on the input. Columns n_words and removed_spans (word numbers) are added. Texts that are null, empty or
    shorter than a window, and rows without an id, stay as they are; repeats within one id do not count. A very long text is
    read by one task, its words held once.
    Repeated rows come out as often as they came in. No rows: no rows.
    """
    tables = WorkTables(docs.sparkSession, "debruijn")
    return without_spans(docs, repeated_spans(keyed(docs), tables, window))
