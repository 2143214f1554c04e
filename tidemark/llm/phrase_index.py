"""Benchmark decontamination: a distributed positional inverted index, searched from the rarest test terms.

The index is split by document: each row is a block of whole documents with the posting lists of that block
(term -> ascending word positions), so a term that stands in every document is spread over all blocks. Test windows
(``WINDOW_WORDS`` consecutive item words) are looked up in every block: the list of a window's rarest term gives
candidate starts, and each further list, adjusted by its offset and taken from rarest to most frequent, is intersected
with them. With ``slop`` 0 the matches are exact phrases; with ``slop`` s they are proximity matches: every term within
s words of its place relative to the rarest one.

Windows go out in query blocks of about ``QUERY_WINDOWS`` distinct windows, which bounds what the driver and each
task hold of the tests however many there are; each query block is searched against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, list_column, row_slices, text_bytes, WorkTables

WINDOW_WORDS = 10
QUERY_WINDOWS = 20_000
# Words after which a block of the index is closed; a longer document makes a block of its own.
BLOCK_WORDS = 1_000_000
# Candidate starts held at a time while lists are intersected.
CANDIDATES = 1_000_000
# Lower case of A-Z; what is neither letter, digit nor beyond ASCII becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "doc_ids array<long>, text_keys array<long>, doc_words array<int>, terms array<int>, counts array<int>, positions array<int>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_windows(items: DataFrame, window_words: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window): distinct windows of every item, words joined by spaces; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "t"):
            ids, found = [], []
            for item, text in zip(rows.column("item_id").to_pylist(), rows.column("t").to_pylist()):
                words = words_of(text)
                size = min(window_words, len(words))
                own = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else ()
                ids += [item] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["item_id", "window"])

    return items.select(F.col(id_col).alias("item_id"), text_bytes(text_col).alias("t")).mapInArrow(run, "item_id long, window binary")


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the index with the postings of the terms in ``vocabulary``; ``doc_words`` counts all words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def block(ids: list, keys: list, sizes: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
        at = np.nonzero(tokens >= 0)[0].astype(np.int32)
        order = np.argsort(tokens[at], kind="stable")
        terms, counts = np.unique(tokens[at], return_counts=True)
        columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(terms, pa.int32()), pa.array(counts, pa.int32()), pa.array(at[order])]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays(lists, ["doc_ids", "text_keys", "doc_words", "terms", "counts", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_of = shared.value.get
        ids, keys, sizes, parts, held = [], [], [], [], 0
        for rows in row_slices(batches, "t"):
            for doc, key, text in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text_key", "t"))):
                words = words_of(text)
                ids.append(doc)
                keys.append(key)
                sizes.append(len(words))
                parts.append(np.fromiter(map(term_of, words, repeat(-1)), np.int32, len(words)))
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield block(ids, keys, sizes, parts)
                    ids, keys, sizes, parts, held = [], [], [], [], 0
        if ids:
            yield block(ids, keys, sizes, parts)

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), text_bytes(text_col).alias("t"))
    return keyed.mapInArrow(run, INDEX)


class Query:
    """Windows as term numbers and offsets, rarest term of the corpus first (ties: the earlier word)."""

    def __init__(self, windows: list[bytes], vocabulary: dict[bytes, int], frequency: np.ndarray):
        split = [w.split() for w in windows]
        self.windows = windows
        self.length = np.array([len(w) for w in split], np.int64)
        width = int(self.length.max(initial=0))
        self.terms = np.full((len(split), width), -1, np.int64)
        for i, words in enumerate(split):
            self.terms[i, : len(words)] = [vocabulary[w] for w in words]
        cost = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        self.offsets = np.argsort(cost, axis=1, kind="stable")
        self.terms = np.take_along_axis(self.terms, self.offsets, axis=1)

    def matches(self, keys: np.ndarray, doc_starts: np.ndarray, slop: int):
        """(document, first word, word after the last, window) of all matches in one block.

        ``keys`` holds the postings as term << 32 | position, ascending.
        """
        none = np.empty(0, np.int64)
        if not len(keys) or not len(self.windows):
            return none, none, none, none
        first = self.terms[:, 0] << 32
        low, high = np.searchsorted(keys, first), np.searchsorted(keys, first + (1 << 32))
        lists = high - low
        found = []
        at, ends = 0, np.cumsum(lists)
        while at < len(lists):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + CANDIDATES, side="right")))
            window = np.repeat(np.arange(at, stop), lists[at:stop])
            place = np.arange(len(window)) - np.repeat(ends[at:stop] - lists[at:stop] - base, lists[at:stop]) + np.repeat(low[at:stop], lists[at:stop])
            found.append(self._extend(window, keys[place] & 0xFFFFFFFF, keys, doc_starts, slop))
            at = stop
        return tuple(np.concatenate(c) for c in zip(*found))

    def _extend(self, window, position, keys, doc_starts, slop):
        doc = np.searchsorted(doc_starts, position, side="right") - 1
        start, least, most = position - self.offsets[window, 0], position, position
        for j in range(1, self.terms.shape[1]):
            term = self.terms[window, j]
            used = term >= 0
            target = start + self.offsets[window, j]
            low = np.maximum(target - slop, doc_starts[doc])
            high = np.minimum(target + slop, doc_starts[doc + 1] - 1)
            place = np.minimum(np.searchsorted(keys, (term << 32) + low), len(keys) - 1)
            got = keys[place]
            good = ~used | ((got >> 32 == term) & ((got & 0xFFFFFFFF) >= low) & ((got & 0xFFFFFFFF) <= high))
            got = np.where(used, got & 0xFFFFFFFF, position)[good]
            window, position, doc, start = window[good], position[good], doc[good], start[good]
            least, most = np.minimum(least[good], got), np.maximum(most[good], got)
        return doc, least, most + 1, window


def search(index: DataFrame, query: Query, slop: int = 0) -> DataFrame:
    """Documents with matches: (doc_id, text_key, starts, ends, windows).

    ``starts`` and ``ends`` are the united spans of all matches in word numbers of the document, ``windows`` the
    distinct windows that matched.
    """
    shared = index.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, text_keys, sizes, terms, counts, positions = (batch.column(c)[i].values for c in range(6))
                sizes = sizes.to_numpy().astype(np.int64)
                doc_starts = np.concatenate(([0], np.cumsum(sizes)))
                keys = (np.repeat(terms.to_numpy().astype(np.int64), counts.to_numpy()) << 32) + positions.to_numpy()
                # Documents without words share their start with the next one and never own a position.
                doc, start, end, window = shared.value.matches(keys, doc_starts, slop)
                if not len(doc):
                    continue
                order = np.lexsort((start, doc))
                doc, start, end, window = doc[order], start[order], end[order], window[order]
                reach = np.maximum.accumulate(end)  # documents ascend, so no end of an earlier one reaches in
                fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
                own, at = np.unique(doc, return_index=True)
                opens = np.nonzero(fresh)[0]
                closes = reach[np.concatenate((opens[1:], [len(doc)])) - 1]
                spans = np.unique(doc[opens], return_counts=True)[1]
                named = [[shared.value.windows[w] for w in np.unique(window[a:b])] for a, b in zip(at, [*at[1:], len(doc)])]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(own)),
                        text_keys.take(pa.array(own)),
                        list_column(start[opens] - doc_starts[doc[opens]], spans),
                        list_column(closes - doc_starts[doc[opens]], spans),
                        pa.array(named, pa.list_(pa.binary())),
                    ],
                    ["doc_id", "text_key", "starts", "ends", "windows"],
                )

    return index.mapInArrow(run, "doc_id long, text_key long, starts array<long>, ends array<long>, windows array<binary>")


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, slop: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_words, n_hit (words inside matches), spans (start, end) and items.

    ``items`` are the distinct ids, as sorted strings, of items with a matching window; items without an id mark
    words but are not named. Null and empty texts have no words; an item without words has no window. Rows that
    repeat come out as often as they came in. No documents: no rows; no items: nothing is hit. Further columns of both
    tables, whatever their names, are not read.
    """
    spark = docs.sparkSession
    tables = WorkTables(spark, "phrases")
    windows = tables.write("windows", item_windows(items, window_words))
    distinct = windows.select("window").distinct()
    blocks = max(1, -(-distinct.count() // QUERY_WINDOWS))
    base, hits = None, []
    for k in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        texts = sorted(bytes(r.window) for r in own.toLocalIterator())  # about QUERY_WINDOWS of them
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}
        index = tables.write(f"index-{k}", build_index(docs, vocabulary))
        frequency = np.zeros(len(vocabulary) + 1, np.int64)
        totals = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
        for row in totals.toLocalIterator():  # no more than the terms of the query block
            frequency[row.terms] = row.n
        hits.append(search(index, Query(texts, vocabulary, frequency), slop))
        if base is None:
            base = index.select(F.explode(F.arrays_zip("doc_ids", "text_keys", "doc_words")).alias("d")).select(
                F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.doc_words").cast("long").alias("n_words")
            )
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    found = tables.write("found", found)
    key = ["doc_id", "text_key"]
    spans = found.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"))
    named = (
        found.select(*key, F.explode("windows").alias("window"))
        .join(windows, "window")
        .select(*key, F.col("item_id").cast("string").alias("item"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    joined = base
    for side in (spans, named):
        side = side.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), side.columns[2])
        joined = joined.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")
    state = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["ends"] - F.greatest(x["starts"], s["reach"]), F.lit(0).cast("long"))).alias("n"),
            F.greatest(s["reach"], x["ends"]).alias("reach"),
        ),
    )
    return joined.select(
        *key, "n_words", F.coalesce(state["n"], F.lit(0).cast("long")).alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, all columns kept (null texts stay)."""
    doc, key = free_name("hit_id", docs), free_name("hit_key", docs)
    hit = contamination(docs, items, window_words).where("n_hit > 0").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")
