"""Substring dedup by a sparse suffix array.

Suffixes are kept only where a window's minimiser stands, so that any two equal windows keep suffixes at the same word of
both. The kept suffixes are sorted over the whole cluster by their leading words; a suffix whose sorted neighbours start with
other words stands in no other document and is dropped. Suffixes with the same words all around are whole matches
with the smallest document that has them, and only its own go on where others start alike but differ further on.

These are extended. Sorted by all their words, a suffix shares no more words with any other than with one of its
two neighbours; sorted by the words before them, read backwards, the same holds to the left. The longest common prefixes
of neighbours thus bound how far a match can reach to the right and to the left, and only windows between
these bounds are compared, which finds the smallest document of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WorkTables, row_slices
from tidemark.llm.passages import ANCHOR, WINDOW, Windows, keyed, single_windows, without_spans

SUFFIX = "lead binary, content long, doc_id long, text_key long, start int, n int, at int"
# low..high: how many words before the suffix its windows start.
SIDES = "doc_id long, text_key long, at int, low int, high int, left binary"


def suffixes(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The suffixes of keyed rows: leading words, hash of all words of its windows, word number ``at``.

    ``start`` and ``n`` name the consecutive windows that a suffix stands for. Words end with a blank, so that texts sort by words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Windows(window, anchor)
        for part in row_slices(batches, "t"):
            texts = part.column("t").to_pylist()
            state.load(texts)
            doc, at, count, _, content = state.segments()
            words = [w for t in texts for w in t.split()]
            leads = [b" ".join(words[p : p + anchor]) + b" " for p in state.owners.tolist()]
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(leads, pa.binary()),
                    pa.array(content.view(np.int64)),
                    part.column("doc_id").take(own),
                    part.column("text_key").take(own),
                    pa.array((at - state.starts[doc]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array((state.owners - state.starts[doc]).astype(np.int32)),
                ],
                ["lead", "content", "doc_id", "text_key", "start", "n", "at"],
            )

    return rows.mapInArrow(run, SUFFIX)


def neighbours(rows: DataFrame) -> DataFrame:
    """Suffixes that start with the words of a sorted neighbour; the outermost of each sorted part are kept too.

    The sort key ends with the document, so suffixes that start alike, however many, spread over many parts. A group
    that a part border cuts to a single suffix is not lost as border suffixes stay in any case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None
        leads = False  # whether the first row of ``before`` starts like the row ahead of it, or is the first of all

        def settled(rows: pa.RecordBatch, head: bool, tail: bool) -> pa.RecordBatch:
            lead = rows.column("lead")
            like = pc.equal(lead[1:], lead[:-1]).to_numpy(zero_copy_only=False)
            keep = np.concatenate(([head], like)) | np.concatenate((like, [tail]))
            return rows.filter(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            head = True
            if before is not None:
                head = before.column("lead")[-1] == batch.column("lead")[0]
                yield settled(before, leads, head)
            before, leads = batch, head
        if before is not None:
            yield settled(before, leads, True)

    return rows.sort("lead", "content", "doc_id", "text_key", "start").mapInArrow(run, SUFFIX)


def sides(rows: DataFrame, wanted: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The words of the wanted suffixes: ``right`` from the suffix to the end of its last window, ``left`` its leading words
    and then those before it, backwards, to the start of its first window."""
    lists = wanted.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "n", "at"))).alias("parts"))
    joined = rows.join(lists, ["doc_id", "text_key"]).select(
        "doc_id", "text_key", "t", *[F.col(f"parts.{c}").alias(c) for c in ("start", "n", "at")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "t"):
            lists = [part.column(c) for c in ("start", "n", "at")]
            start, n, at = (c.flatten().to_numpy().astype(np.int64) for c in lists)
            counts = np.diff(lists[0].offsets.to_numpy())
            own, right, left = np.repeat(np.arange(part.num_rows), counts), [], []
            texts, text, words = part.column("t").to_pylist(), -1, []
            for doc, first, place, end in zip(own.tolist(), start.tolist(), at.tolist(), (start + n - 1 + window).tolist()):
                if doc != text:
                    text, words = doc, texts[doc].split()
                right.append(b" ".join(words[place:end]) + b" ")
                left.append(b" ".join(words[place : place + anchor] + words[first:place][::-1]) + b" ")
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(own),
                    part.column("text_key").take(own),
                    pa.array(at.astype(np.int32)),
                    pa.array((at - start - n + 1).astype(np.int32)),
                    pa.array((at - start).astype(np.int32)),
                    pa.array(left, pa.binary()),
                    pa.array(right, pa.binary()),
                ],
                ["doc_id", "text_key", "at", "low", "high", "left", "right"],
            )

    return joined.mapInArrow(run, SIDES + ", right binary")


def common_words(a: bytes, b: bytes) -> int:
    """How many leading words two texts share; each word ends with a blank."""
    if a == b:
        return a.count(b" ")
    shared = 0
    for x, y in zip(a.split(b" "), b.split(b" ")):
        if x != y:
            break
        shared += 1
    return shared


def extended(rows: DataFrame, side: str, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``rows`` sorted by the words of one side, their windows cut to what the longer of the two common prefixes with the
    sorted neighbours allows; rows without a window left go. The outermost rows of a sorted part have a neighbour elsewhere and stay uncut."""
    names = ["doc_id", "text_key", "at", "low", "high", "left"]

    def settled(part: pa.RecordBatch, reach: np.ndarray) -> pa.RecordBatch:
        low, high = part.column("low").to_numpy(), part.column("high").to_numpy()
        if side == "right":
            low = np.maximum(low, window - reach)
        else:
            high = np.minimum(high, reach - anchor)
        columns = [part.column(c) for c in names]
        columns[3], columns[4] = pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(low <= high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = window + anchor
        held, reach = None, whole  # the last row so far, and what it shares with the row ahead of it
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            texts = part.column(side).to_pylist()
            shared = [common_words(a, b) for a, b in zip(texts, texts[1:])]
            most = np.maximum([reach, *shared], [*shared, 0])
            yield settled(part.slice(0, part.num_rows - 1), most[:-1])
            held, reach = part.slice(part.num_rows - 1), int(most[-1])
        if held is not None:
            yield settled(held, np.array([whole]))

    return rows.sort(side, "doc_id", "text_key", "at").mapInArrow(run, SIDES)


def repeated_spans(rows: DataFrame, tables: WorkTables, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, end) of words in windows that also start in a document with a smaller id.

    A suffix with the words of one in a smaller document is covered whole. Of suffixes with the same words all around the first
    document stands for all, and only where suffixes that start alike go on differently are those first ones extended.
    """
    # Written first, so that texts are split once and the sort's sampling reads the table; the same for the tables
    # below: the joins read plain shuffles, and an owner or a stretch that is met very often is split over several tasks.
    kept = tables.write("suffixes", suffixes(rows, window))
    shared = tables.write("shared", neighbours(kept).withColumn("anchor", F.xxhash64("lead")).drop("lead"))
    whole = tables.write("whole", shared.groupBy("anchor", "content").agg(F.min("doc_id").alias("first")))
    contents = whole.groupBy("anchor").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    branching = tables.write("branching", contents.where("low < high").select("anchor", F.lit(True).alias("branches")))
    classes = tables.write("classes", whole.join(branching, "anchor", "left"))
    judged = tables.write("judged", shared.join(classes, ["anchor", "content"]).drop("anchor", "content"))
    copies = judged.where(F.col("first") < F.col("doc_id"))
    wanted = judged.where((F.col("first") == F.col("doc_id")) & F.col("branches"))
    around = tables.write("around", sides(rows, wanted, window))
    to_right = tables.write("to_right", extended(around, "right", window))
    both = extended(to_right, "left", window)
    matched = both.select("doc_id", "text_key", (F.col("at") - F.col("high")).alias("start"), (F.col("high") - F.col("low") + 1).alias("n"))
    single = tables.write("single", single_windows(rows, matched, window))
    classes = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeated = single.join(classes, ["h1", "h2"]).where(F.col("first") < F.col("doc_id"))
    return copies.select("doc_id", "text_key", "start", (F.col("start") + F.col("n") - 1 + window).alias("end")).unionByName(
        repeated.select("doc_id", "text_key", "start", (F.col("start") + window).alias("end"))
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with each passage of ``window`` words or more left only in the document with the smallest id.

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller doc_id; windows
    are judged on the input. Columns n_words and removed_spans (word numbers) are added. Texts that are null, empty or
    shorter than a window, and rows without an id, stay as they are; repeats within one id do not count. A very long text
    is one row of a task: its words are held at once, its suffixes go out in one batch.
    Repeated rows come out as often as they came in. No rows: no rows.
    """
    tables = WorkTables(docs.sparkSession, "suffixes")
    return without_spans(docs, repeated_spans(keyed(docs), tables, window))
