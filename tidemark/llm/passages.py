"""Long passages that stand in several documents: what the two substring operators share.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``WINDOW`` consecutive words of one document. Its owner is the
minimiser among its runs of ``ANCHOR`` words: the run with the smallest hash, the leftmost of equals. The owner
depends on the window's words alone, so equal windows have equal owners wherever they stand, and consecutive windows with
one owner form a segment, the longest stretch that one content-selected position stands for. A text of n words gives
about n / 21 segments instead of n windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, RangeHashes, row_slices, text_bytes, WordHashes

WINDOW = 50
ANCHOR = 8
# Two independent bases: runs and segments by one or the other, single windows by both together.
BASES = (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4D)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = "[\\x20\\x09-\\x0D]+"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, t) of rows with an id; ``text_key`` tells rows that repeat an id with another text."""
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), text_bytes(text_col).alias("t")
    )


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in three passes whatever the width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


class Windows:
    """Word hashes of a few documents end to end, and what is asked of their windows."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, anchor
        self.words = WordHashes()
        self.ranges = [RangeHashes(b) for b in BASES]

    def load(self, texts: list[bytes]) -> None:
        split = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        hashes = np.concatenate([self.words.of(w) for w in split]) if split else np.empty(0, np.uint64)
        self.prefix = [r.prefix(hashes) for r in self.ranges]

    def hashes(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.ranges[which].ranges(self.prefix[which], start, end)

    def segments(self):
        """(document, first window, number of windows, anchor, content) of every segment; places count over all."""
        total, width = int(self.sizes.sum()), self.window - self.anchor + 1
        self.owners = np.empty(0, np.int64)  # the places of the segments' owners
        if total < self.window:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        places = np.arange(total - self.anchor + 1)
        runs = self.hashes(0, places, places + self.anchor)
        # As many bits for the place whatever the batch: which runs tie depends on their words alone.
        low = np.uint64((1 << 32) - 1)
        owner = (_sliding_min((runs & ~low) | places.astype(np.uint64), width) & low).astype(np.int64)
        doc = np.repeat(np.arange(len(self.sizes)), np.maximum(self.sizes - self.window + 1, 0))
        first = np.maximum(self.sizes - self.window + 1, 0)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(first) - first, first) + self.starts[doc]
        if not len(start):
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        own = owner[start]
        opens = np.nonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))))[0]
        count = np.diff(np.concatenate((opens, [len(start)])))
        at, self.owners = start[opens], own[opens]
        return doc[opens], at, count, runs[self.owners], self.hashes(1, at, at + count - 1 + self.window)


def single_windows(rows: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h1, h2, doc_id, text_key, start) of the windows named by ``wanted`` (doc_id, text_key, start, n)."""
    lists = wanted.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("parts"))
    joined = rows.join(lists, ["doc_id", "text_key"]).select(
        "doc_id", "text_key", "t", F.col("parts.start").alias("starts"), F.col("parts.n").alias("ns")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Windows(window)
        for part in row_slices(batches, "t"):
            state.load(part.column("t").to_pylist())
            starts, ns = part.column("starts"), part.column("ns")
            counts = ns.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(part.num_rows), np.diff(starts.offsets.to_numpy()))
            head = starts.flatten().to_numpy().astype(np.int64) + state.starts[doc]
            at = np.repeat(head, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            doc = np.repeat(doc, counts)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(state.hashes(0, at, at + window).view(np.int64)),
                    pa.array(state.hashes(1, at, at + window).view(np.int64)),
                    part.column("doc_id").take(own),
                    part.column("text_key").take(own),
                    pa.array((at - state.starts[doc]).astype(np.int32)),
                ],
                ["h1", "h2", "doc_id", "text_key", "start"],
            )

    return joined.mapInArrow(run, "h1 long, h2 long, doc_id long, text_key long, start int")


def united(spans: DataFrame) -> DataFrame:
    """(doc_id, text_key, removed_spans): disjoint ascending spans per document; at most one span per window goes in."""
    lists = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))

    def unite(starts: pa.Array, ends: pa.Array) -> pa.Array:
        found = []
        for a, b in zip(starts, ends):
            a, reach = a.values.to_numpy(), np.maximum.accumulate(b.values.to_numpy())
            opens = np.nonzero(np.concatenate(([True], a[1:] > reach[:-1])))[0]
            closes = reach[np.concatenate((opens[1:], [len(a)])) - 1]
            found.append([{"start": int(x), "end": int(y)} for x, y in zip(a[opens], closes)])
        return pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    udf = F.arrow_udf(unite, "array<struct<start int, end int>>")
    return lists.select("doc_id", "text_key", udf(F.col("s.start"), F.col("s.end")).alias("removed_spans"))


def cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans; what stays keeps its own white space, cuts become line ends."""
    places = [m.span() for m in WORD.finditer(text)]
    edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(places)]
    return b"\n".join(text[places[a][0] : places[b - 1][1]] for a, b in zip(edges[::2], edges[1::2]) if a < b)


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the spans cut from the text, and the columns n_words (before) and removed_spans.

    Input columns of these two names are replaced.
    """

    def cut_all(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else t if s is None else cut(t.encode(), s).decode() for t, s in zip(texts.to_pylist(), spans.to_pylist())],
            pa.string(),
        )

    plain = docs.drop("n_words", "removed_spans")
    doc, key, cuts = (free_name(name, plain) for name in ("_d", "_k", "_spans"))
    side = united(spans).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("removed_spans").alias(cuts))
    joined = plain.join(side, (plain[id_col] == F.col(doc)) & (F.xxhash64(plain[text_col]) == F.col(key)), "left")
    udf = F.arrow_udf(cut_all, "string")
    return joined.select(
        *[udf(plain[text_col], F.col(cuts)).alias(text_col) if c == text_col else plain[c] for c in plain.columns],
        F.coalesce(F.regexp_count(plain[text_col], F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("n_words"),
        F.col(cuts).alias("removed_spans"),
    )
