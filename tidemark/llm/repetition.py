"""Quality rules: repeated passages inside a document by a suffix array of its words.

The suffixes of a few documents at a time are sorted by prefix doubling, documents first, so none is compared with
another's. The longest common prefix of sorted neighbours follows from the doubled ranks. A suffix lies in the
nested LCP intervals up to the larger of its two neighbouring prefixes, so that length is the longest repeated
substring starting there and the spans of all of them unite to those of the maximal repeats. A document is kept if
repeats of ``MIN_WORDS`` words or more cover at most ``MAX_COVERED`` percent of its words and none is
longer than ``MAX_REPEAT`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, row_slices, text_bytes

MIN_WORDS = 10
MAX_COVERED = 20
MAX_REPEAT = 50
FEWEST_WORDS = 50
# Base rule: repeated three-word windows may hold at most so many percent of the words.
MAX_WINDOWED = 50
SHORT_WINDOW = 3
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
# Bytes that do not start a character of a word.
NO_CHARACTER = BLANKS + bytes(range(0x80, 0xC0))


def repeat_lengths(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word sequence that starts there and again elsewhere in its document.

    ``words`` are word numbers of documents end to end, ``sizes`` the documents' word counts.
    """
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order of ``key`` and, in that order, the place of the first equal key."""
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        return order, np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))

    order, place = ranked(doc * (int(words.max()) + 1) + words)
    rank = np.empty(n, np.int64)
    rank[order] = place
    levels, step = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.nonzero(size[rank] > 1)[0]
        if not len(open_):
            break
        ahead = open_ + step
        second = np.where(ahead < end[open_], rank[np.minimum(ahead, n - 1)], -1)
        order, place = ranked(rank[open_] * (n + 1) + second + 1)
        # Ranks are places in the whole order: the group's first place, plus the place within the group.
        old = rank[open_][order]
        head = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), np.arange(len(old)), 0))
        rank = rank.copy()
        rank[open_[order]] = old + place - head
        levels.append(rank)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    same = np.nonzero(levels[0][a] == levels[0][b])[0]
    a, b, common = a[same], b[same], np.zeros(len(same), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        equal = inside & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        common += equal * (1 << level)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeat of at least ``least`` words."""
    at = np.nonzero(longest >= least)[0]
    marks = np.zeros(len(longest) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + longest[at], -1)
    return np.cumsum(marks[:-1]) > 0


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def measure(texts: list[bytes], min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for doc in split for w in doc), np.int64, int(sizes.sum()))
    longest = repeat_lengths(words, sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner, longest)
    total = lambda marks: np.bincount(owner, weights=marks, minlength=len(texts)).astype(np.int64)
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t.translate(None, NO_CHARACTER)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": total(covered(longest, SHORT_WINDOW)),
        "n_covered": total(covered(longest, min_words)),
        "longest_repeat": most,
    }


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, the measures, base_failed and kept, a row per row of ``docs``.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike; other columns are not
    read; no rows: no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "t"):
            found = measure(rows.column("t").to_pylist(), min_words)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(found[m]) for m in MEASURES)], ["doc_id", *MEASURES])

    schema = ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)])
    found = docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, schema)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MAX_WINDOWED * F.col("n_words"))
    calm = (100 * F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & calm)
