"""Byte-level BPE as a finite-state transducer, and streaming decoding by a UTF-8 state machine.

A token sequence is the encoding of its bytes if every two neighbours are the encoding of their own bytes, as long as every
token is the encoding of its own (checked when the merges are compiled). So a deterministic machine over bytes need only
remember the ways in which the last bytes may be split: a state holds, for every place where a token may begin, the tokens
not yet put out before it and the bytes read since. Tokens that all ways share are put out. No way stays open longer than the
longest token, which bounds the lookahead. States and moves are made when a text first needs them and kept up to a bound, and so
are the moves over whole pieces: what the machine puts out from its start to the end of a piece.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, list_column, row_slices, text_bytes

START = -1  # the token before the first one


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file: base64 and number per line, lower numbers merge first."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """The merges of ``ranks`` as a lazily determinised machine.

    It holds ``max_states`` states and the moves over ``max_pieces`` pieces of up to ``long_piece`` characters at a time,
    and as many of the pieces met before those.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 350_000, max_pieces: int = 160_000, long_piece: int = 100):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {i: token for token, i in ranks.items()}
        # Prefix -> itself, so that states share their bytes.
        self.prefixes: dict[bytes, bytes] = {}
        for token in ranks:
            for n in range(1, len(token)):
                self.prefixes.setdefault(token[:n], token[:n])
        self.neighbours: dict[tuple[int, int], bool] = {}
        for b in range(256):
            if bytes([b]) not in ranks:
                raise ValueError(f"no token for byte {b}")
        odd = [token for token, i in ranks.items() if self.merged(token) != [i]]
        if odd:
            raise ValueError(f"{len(odd)} tokens that no merges reach, {odd[0]!r} among them")
        self.pieces = Pieces(self, max_pieces, long_piece)
        self.restart()

    def restart(self) -> None:
        self.states: dict[tuple, int] = {}
        self.ways: list[tuple] = []  # by state: (last token, tokens held back, bytes read since) of each way
        self.ends: list[tuple] = []  # by state: what comes out if the piece ends here
        self.moves: dict[int, tuple] = {}  # 256 * state + byte -> (256 * next state, tokens put out)
        self.state(((START, (), b""),))

    def state(self, ways: tuple) -> int:
        """The number of a state, the first one is the start."""
        found = self.states.get(ways)
        if found is None:
            found = self.states[ways] = len(self.ways)
            self.ways.append(ways)
            # The way without further bytes is the encoding of what has been read.
            self.ends.append(next(held for _, held, rest in ways if not rest))
        return found

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; only ever asked for one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            pairs = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]
            lowest = min(pairs)
            if lowest == len(ranks):
                break
            at = pairs.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their own bytes; any token may come first."""
        if len(self.neighbours) >= 2 * self.max_states:
            self.neighbours.clear()
        fits = self.neighbours[a, b] = a == START or self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return fits

    def move(self, at: int, byte: int) -> tuple[int, tuple]:
        """The move on ``byte`` from the state of ``at``, 256 times its number; worked out once and kept."""
        read, ways = bytes([byte]), []
        longer, ranks, known = self.prefixes.get, self.ranks.get, self.neighbours.get
        for last, held, rest in self.ways[at >> 8]:
            rest += read
            prefix = longer(rest)
            if prefix is not None:
                ways.append((last, held, prefix))
            token = ranks(rest)
            if token is not None:
                fits = known((last, token))
                if self.may_follow(last, token) if fits is None else fits:
                    ways.append((token, (*held, token), b""))
        out = ways[0][1]
        for _, held, _ in ways[1:]:
            n = 0
            while n < min(len(out), len(held)) and out[n] == held[n]:
                n += 1
            out = out[:n]
        if out:
            ways = [(last, held[len(out) :], rest) for last, held, rest in ways]
        ways = tuple(ways)
        if len(self.ways) >= self.max_states and ways not in self.states:
            self.restart()
            return 256 * self.state(ways), out
        self.moves[at + byte] = step = (256 * self.state(ways), out)
        return step

    def run(self, piece: bytes) -> tuple:
        """Token ids of one piece, in one pass over its bytes."""
        ids: list[int] = []
        at, moves = 0, self.moves
        for byte in piece:
            step = moves.get(at + byte)
            if step is None:
                step = self.move(at, byte)
                moves = self.moves  # new after a restart
            at, out = step
            if out:
                ids += out
        return (*ids, *self.ends[at >> 8])

    def encode(self, pieces: Iterable[str]) -> np.ndarray:
        """Token ids of the pieces, each on its own."""
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, pieces)), np.int32)


class Pieces(dict):
    """piece -> its token ids, as the machine gives them.

    A full table becomes the older one, whose pieces come over when they are met again; long pieces are not kept.
    """

    def __init__(self, machine: Transducer, most: int, longest: int):
        super().__init__()
        self.machine, self.most, self.longest, self.older = machine, most, longest, {}

    def __missing__(self, piece: str) -> tuple:
        found = self.older.get(piece) or self.machine.run(piece.encode())
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


# The well-formed byte sequences of UTF-8 as (first byte from, to, second byte from, to, bytes in all).
UTF8 = [
    (0x00, 0x7F, 0, 0, 1),
    (0xC2, 0xDF, 0x80, 0xBF, 2),
    (0xE0, 0xE0, 0xA0, 0xBF, 3),
    (0xE1, 0xEC, 0x80, 0xBF, 3),
    (0xED, 0xED, 0x80, 0x9F, 3),
    (0xEE, 0xEF, 0x80, 0xBF, 3),
    (0xF0, 0xF0, 0x90, 0xBF, 4),
    (0xF1, 0xF3, 0x80, 0xBF, 4),
    (0xF4, 0xF4, 0x80, 0x8F, 4),
]


def utf8_move(held: bytes, byte: int) -> tuple[bytes, str]:
    """One step of the UTF-8 machine: its state is the unfinished character ``held``; returns the next state and text.

    What cannot go on to a character comes out as one U+FFFD, and the byte that stopped it starts anew.
    """
    if not held:
        for low, high, _, _, size in UTF8:
            if low <= byte <= high:
                return (b"", chr(byte)) if size == 1 else (bytes([byte]), "")
        return b"", "�"
    _, _, low, high, size = next(row for row in UTF8 if row[0] <= held[0] <= row[1])
    if len(held) > 1:
        low, high = 0x80, 0xBF
    if not low <= byte <= high:
        held, text = utf8_move(b"", byte)
        return held, "�" + text
    held += bytes([byte])
    return (b"", held.decode()) if len(held) == size else (held, "")


class Held(dict):
    """token id -> (next state, text) for one unfinished character, filled as tokens are met."""

    __slots__ = ("decoder", "held")

    def __init__(self, decoder: "StreamDecoder", held: bytes):
        self.decoder, self.held = decoder, held

    def __missing__(self, token: int) -> tuple["Held", str]:
        held, parts = self.held, []
        for byte in self.decoder.tokens[token]:
            held, text = utf8_move(held, byte)
            parts.append(text)
        self[token] = step = (self.decoder.state(held), "".join(parts))
        return step


class StreamDecoder:
    """Token ids in, text out as soon as its characters are whole; unfinished bytes wait for the next tokens."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.states = tokens, {}
        self.now = self.state(b"")

    def state(self, held: bytes) -> Held:
        return self.states.setdefault(held, Held(self, held))

    def feed(self, ids: Iterable[int]) -> str:
        state, parts = self.now, []
        for token in ids:
            state, text = state[token]
            parts.append(text)
        self.now = state
        return "".join(parts)

    def close(self) -> str:
        """The end of the text: an unfinished character comes out as U+FFFD; the decoder may then be used anew."""
        rest = "�" if self.now.held else ""
        self.now = self.state(b"")
        return rest


@lru_cache(maxsize=2)
def _transducer(ranks_file: str) -> Transducer:
    return Transducer(read_ranks(ranks_file))


@lru_cache(maxsize=2)
def _decoder(ranks_file: str) -> StreamDecoder:
    return StreamDecoder({i: token for token, i in read_ranks(ranks_file).items()})


@lru_cache(maxsize=2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def encode_text(text: str, ranks_file: str, pattern: str, at_once: int = 1_000_000) -> np.ndarray:
    """Token ids of the matches of ``pattern``; those of a text over ``at_once`` characters are taken one by one."""
    split = _pattern(pattern)
    pieces = split.findall(text) if len(text) <= at_once else (m[0] for m in split.finditer(text))
    return _transducer(ranks_file).encode(pieces)


@contextmanager
def no_collection() -> Iterator[None]:
    """Without searches for reference cycles: the tables are large, always growing, and hold none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _decoded(ids: np.ndarray, decoder: StreamDecoder, piece: int = 100_000) -> str:
    return "".join(decoder.feed(ids[i : i + piece].tolist()) for i in range(0, len(ids), piece)) + decoder.close()


def encode(docs: DataFrame, ranks_file: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, a row per row of ``docs``; ``decoded`` adds the text decoded from them.

    Each match of ``pattern`` is encoded on its own, without special tokens. Null and empty texts have no ids; repeated rows and ids
    come out as often as they go in; other columns are not read; no rows: no rows. A text of any length takes one pass and
    memory for its bytes and ids. ``ranks_file`` must be readable on every worker.
    """
    bound_batches(docs.sparkSession)
    names = ["doc_id", "ids", *(["text"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "t"):
            with no_collection():
                found = [encode_text(t.decode("utf-8", "replace"), ranks_file, pattern) for t in rows.column("t").to_pylist()]
            columns = [rows.column("doc_id"), list_column(np.concatenate(found), np.array([len(f) for f in found]))]
            if decoded:
                columns.append(pa.array([_decoded(f, _decoder(ranks_file)) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    picked = docs.select("doc_id", text_bytes().alias("t"))
    return picked.mapInArrow(run, f"doc_id {picked.dtypes[0][1]}, ids array<int>" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """The columns of ``encoded`` (doc_id, ids) and the decoded ``text``; ids stream through in pieces.

    Bytes that are no UTF-8 come out as U+FFFD. A null list of ids gives an empty text. An unknown id stops the job.
    """
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(ranks_file)
        for rows in batches:
            texts = []
            for ids in rows.column("ids"):
                ids = ids.values.to_numpy() if ids.is_valid else np.empty(0, np.int32)
                texts.append(_decoded(ids, decoder))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    picked = encoded.select("doc_id", "ids")
    return picked.mapInArrow(run, f"doc_id {picked.dtypes[0][1]}, ids array<int>, text string")
