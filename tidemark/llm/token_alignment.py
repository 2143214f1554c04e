"""Cross-tokenizer alignment by products of sparse matrices, rows in compressed form (CSR).

Each encoding of a text is a matrix of tokens by bytes. Gustavson's row products of one with the transpose of the other give
the overlap links: (A token, B token, shared bytes). Bytes where tokens of both end cut the text into groups; tokens by
groups are two more matrices, whose product gives the shared-group links and whose transposes list each group's
tokens. Texts are encoded in chunks cut at a single blank between two other characters, where both vocabularies always cut, so
matrices stay small however long a text is, and the parts put together are the encoding of the whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bound_batches, row_slices, text_bytes

CHUNK_CHARS = 16_000
PASS_CHARS = 500_000
CUT = re.compile(r"(?<=\S) (?=\S)")
# How the file's vocabulary splits texts before merging, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANKS = re.compile(r"\s{1000}")
PAIR = "struct<a: int, b: int, n: bigint>"


class Rows(NamedTuple):
    """A sparse matrix by rows: the entries of row i are ``columns`` and ``values`` from ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> "Rows":
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return Rows(starts, rows[order], self.values[order], len(self.starts) - 1)


def by_bytes(ends: np.ndarray) -> Rows:
    """Tokens by bytes: a token holds the bytes after its predecessor's end up to its own."""
    n = int(ends[-1]) if len(ends) else 0
    return Rows(np.concatenate(([0], ends)), np.arange(n), np.ones(n, np.int64), n)


def by_groups(ends: np.ndarray, cuts: np.ndarray) -> Rows:
    """Tokens by groups: a token lies in the group that ends at the first of ``cuts`` not before its own end."""
    n = len(ends)
    return Rows(np.arange(n + 1), np.searchsorted(cuts, ends), np.ones(n, np.int64), len(cuts))


def product(a: Rows, b: Rows, limit: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the product's entries, in blocks of whole rows of about ``limit`` terms.

    Row i is the sum of the rows of ``b`` that the entries of row i of ``a`` name, each times its entry.
    """
    terms = np.diff(b.starts)[a.columns]
    ahead = np.concatenate(([0], np.cumsum(terms)))[a.starts]  # terms before each row
    row, last = 0, len(a.starts) - 1
    while row < last:
        stop = max(row + 1, int(np.searchsorted(ahead, ahead[row] + limit, side="right")) - 1)
        low, high = a.starts[row], a.starts[stop]
        count = terms[low:high]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(b.starts[a.columns[low:high]] - ends + count, count)
        rows = np.repeat(np.repeat(np.arange(row, stop), np.diff(a.starts[row : stop + 1])), count)
        key = rows * b.width + b.columns[at]
        values = np.repeat(a.values[low:high], count) * b.values[at]
        if len(key):
            if (np.diff(key) < 0).any():
                order = np.argsort(key, kind="stable")
                key, values = key[order], values[order]
            first = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
            yield key[first] // b.width, key[first] % b.width, np.add.reduceat(values, first)
        row = stop


class Encoders:
    """Both vocabularies: A from the vocabulary and merges of a tokenizer file, by bytes; B from a piece model."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken

        self.a_file, self.a_slow = a_file, None
        with open(a_file, encoding="utf-8") as file:
            parts = json.load(file)
        vocabulary, merges = parts["model"]["vocab"], parts["model"]["merges"]
        # Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        byte_of = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        byte_of.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(byte_of.values())))})
        special = {t["content"] for t in parts["added_tokens"]}
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
        joined = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if joined != sorted(joined):
            raise ValueError("ids do not follow the order of the merges")
        ranks = {self.a_bytes[i]: i for token, i in vocabulary.items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on after a blank, texts cannot be cut there")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in ts], np.int64) for ts in (self.a_bytes, self.b_bytes))
        # Texts of ids with what follows them: "," within a group's side, "|" after side A, ";" after side B.
        self.texts = np.array([f"{i}{c}" for ts, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for c in ends for i in range(len(ts))], object)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [self.a.encode_ordinary(" " + c) if LONG_BLANKS.search(c) is None else self.with_blanks(" " + c) for c in chunks]
        return a, self.b.encode(chunks, num_threads=1) if chunks else []

    def with_blanks(self, chunk: str) -> list[int]:
        """The same ids by the library of the file itself: slower, but it takes a million blanks in a row."""
        if self.a_slow is None:
            from tokenizers import Tokenizer

            self.a_slow = Tokenizer.from_file(self.a_file)
            self.a_slow.encode_special_tokens = True
        return self.a_slow.encode(chunk, add_special_tokens=False).ids

    def whole(self, chunk: str, a: list[int], b: list[int]) -> bool:
        data = b" " + chunk.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))


@lru_cache(maxsize=2)
def _encoders(a_file: str, b_file: str) -> Encoders:
    return Encoders(a_file, b_file)


def cut_text(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Chunks of about ``size`` characters; the blank between two goes, as both encodings put one before each chunk."""
    chunks, start = [], 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size - 1)
        if cut is None:
            break
        chunks.append(text[start : cut.start()])
        start = cut.end()
    return [*chunks, text[start:]]


class Measures:
    """What the alignments of some documents add up to, pass by pass."""

    NAMES = ["n_a", "n_b", "n_groups", "n_overlaps", "n_shared"]

    def __init__(self, n_docs: int):
        self.counts = {name: np.zeros(n_docs, np.int64) for name in self.NAMES}
        self.whole = np.ones(n_docs, bool)
        self.texts: list[list[str]] = [[] for _ in range(n_docs)]
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, name: str, doc: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.counts[name] += np.bincount(doc, weights, len(self.whole)).astype(np.int64)

    def take(self, encoders: Encoders, owners: list[int], chunks: list[str]) -> None:
        """Align chunks of the documents ``owners``, which are in order."""
        a_ids, b_ids = encoders.encode(chunks)
        good = [encoders.whole(*x) for x in zip(chunks, a_ids, b_ids)]
        self.whole[[o for o, fine in zip(owners, good) if not fine]] = False
        owners, a_ids, b_ids = ([x for x, fine in zip(xs, good) if fine] for xs in (owners, a_ids, b_ids))
        a_doc, b_doc = (np.repeat(np.array(owners, np.int64), [len(x) for x in ids]) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, len(doc)) for ids, doc in ((a_ids, a_doc), (b_ids, b_doc)))
        if not len(a):
            return
        a_ends, b_ends = np.cumsum(encoders.a_sizes[a]), np.cumsum(encoders.b_sizes[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_groups, b_groups = by_groups(a_ends, cuts), by_groups(b_ends, cuts)
        a_lists, b_lists = a_groups.transposed(), b_groups.transposed()
        group_doc = a_doc[a_lists.columns[a_lists.starts[:-1]]]
        self.add("n_a", a_doc)
        self.add("n_b", b_doc)
        self.add("n_groups", group_doc)
        # A token lies in one group, so the terms of a row of the groups' product are its entries.
        self.add("n_shared", a_doc, np.diff(b_lists.starts)[a_groups.columns])
        for i, j, _ in product(by_bytes(a_ends), by_bytes(b_ends).transposed()):
            self.add("n_overlaps", a_doc[i])
            together = a_ends[i] == b_ends[j]
            i, j = i[together], j[together]
            self.links.append((a_doc[i], a[i], b[j]))
        self._lists(encoders, a, b, a_lists, b_lists, group_doc)

    def _lists(self, encoders: Encoders, a: np.ndarray, b: np.ndarray, a_lists: Rows, b_lists: Rows, group_doc: np.ndarray) -> None:
        """Texts of the groups' lists: side A of a group, side B, the next group."""
        a_count, b_count = np.diff(a_lists.starts), np.diff(b_lists.starts)
        a_at = np.arange(len(a)) + np.repeat(b_lists.starts[:-1], a_count)
        b_at = np.arange(len(b)) + np.repeat(a_lists.starts[1:], b_count)
        names = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = len(encoders.a_bytes), len(encoders.b_bytes)
        names[a_at], names[b_at] = a[a_lists.columns], 2 * n_a + b[b_lists.columns]
        names[a_at[a_lists.starts[1:] - 1]] += n_a
        names[b_at[b_lists.starts[1:] - 1]] += n_b
        words = encoders.texts[names]
        ends = (a_lists.starts + b_lists.starts)[np.nonzero(np.concatenate((group_doc[1:] != group_doc[:-1], [True])))[0] + 1]
        start = 0
        for end, doc in zip(ends.tolist(), group_doc[np.concatenate(([True], group_doc[1:] != group_doc[:-1]))].tolist()):
            self.texts[doc].append("".join(words[start:end].tolist()))
            start = end

    def columns(self, encoders: Encoders) -> list[pa.Array]:
        for counts in self.counts.values():
            counts[~self.whole] = 0
        n_docs, n_b = len(self.whole), len(encoders.b_bytes)
        doc, a, b = (np.concatenate([link[c] for link in self.links] or [np.empty(0, np.int64)]) for c in range(3))
        fine = self.whole[doc]
        key, n = np.unique((doc[fine] * len(encoders.a_bytes) + a[fine]) * n_b + b[fine], return_counts=True)
        pair = key // n_b
        bounds = np.searchsorted(pair // len(encoders.a_bytes), np.arange(n_docs + 1)).astype(np.int32)
        parts = [pa.array((pair % len(encoders.a_bytes)).astype(np.int32)), pa.array((key % n_b).astype(np.int32)), pa.array(n.astype(np.int64))]
        pairs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, ["a", "b", "n"]))
        texts = ["".join(t)[:-1] if fine else "" for t, fine in zip(self.texts, self.whole)]
        return [*(pa.array(self.counts[name]) for name in self.NAMES), pa.array(texts, pa.string()), pairs]


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_overlaps, n_shared, groups, pairs: a row per row of ``docs``.

    ``groups`` lists the ids of each group, ``a1,a2|b1;a3|b2,b3``; ``n_overlaps`` and ``n_shared`` count the links by a
    shared byte and by a shared group; ``pairs`` holds the id pairs of links whose tokens end together, with their number. Texts
    are encoded with a blank before them. Null and empty texts, and those whose joined token bytes are not the blank and the text (B
    has no way to write U+2581), have no tokens: zeros, an empty text, no pairs. Rows are aligned one by one, repeated or not; other
    columns are not read; no rows: no rows. A long text is worked on in chunks; a stretch without a single blank is one chunk.
    """
    bound_batches(docs.sparkSession)
    names = ["doc_id", *Measures.NAMES, "groups", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(a_file, b_file)
        for rows in row_slices(batches, "t"):
            measures, owners, chunks, size = Measures(rows.num_rows), [], [], 0
            for doc, data in enumerate(rows.column("t").to_pylist()):
                for chunk in cut_text(data.decode("utf-8", "replace")) if data else []:
                    owners.append(doc)
                    chunks.append(chunk)
                    size += len(chunk)
                    if size > PASS_CHARS:
                        measures.take(encoders, owners, chunks)
                        owners, chunks, size = [], [], 0
            measures.take(encoders, owners, chunks)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *measures.columns(encoders)], names)

    picked = docs.select("doc_id", text_bytes().alias("t"))
    counts = ", ".join(f"{name} bigint" for name in Measures.NAMES)
    return picked.mapInArrow(run, f"doc_id {picked.dtypes[0][1]}, {counts}, groups string, pairs array<{PAIR}>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best): how many links of all rows hold the pair, and whether no other pair of its B id is in more.

    Tokens that end together end in the same bytes, so the shorter is an ending of the longer: there are no more pairs than
    the tokens of both vocabularies have bytes, however many rows there are.
    """
    pairs = aligned.select(F.explode("pairs").alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.sum("p.n").alias("links"))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def scored(aligned: DataFrame) -> DataFrame:
    """The columns of ``aligned`` but ``pairs``, and n_links, n_best, count_sum over the row's links. ``aligned`` is read twice: write it first.

    Rows are told apart by a number of their own, so equal rows stay apart. Only the counts are broadcast, see ``pair_counts``.
    """
    own = [c for c in aligned.columns if c != "pairs"]
    rows = aligned.withColumn("_row", F.monotonically_increasing_id())
    links = rows.select("_row", *own, F.explode_outer("pairs").alias("_pair"))
    counts = pair_counts(aligned).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "links", "best")
    joined = links.join(F.broadcast(counts), (F.col("_pair.a") == F.col("_a")) & (F.col("_pair.b") == F.col("_b")), "left")
    n, none = F.col("_pair.n"), F.lit(0).cast("bigint")
    sums = {"n_links": n, "n_best": F.when(F.col("best"), n), "count_sum": n * F.col("links")}
    return joined.groupBy("_row", *own).agg(*[F.coalesce(F.sum(v), none).alias(k) for k, v in sums.items()]).drop("_row")
