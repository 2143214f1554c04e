"""Alignment, byte-level BPE and periodic runs against brute-force versions; their queries on a whole small table."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe_transducer, periodic_runs, token_alignment
from tidemark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "the ", "ing", "é", "ñ", "漢", " ", "  ", "\n", "\t", "'s", "1", "23", "!", "́", "😀", "tion ", "\r\n", "▁", "<s>", "<|endoftext|>", "<0x41>", "　", "\x00", "=="]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 11 alignment


@pytest.fixture(scope="module")
def encoders():
    return token_alignment.Encoders(A_FILE, B_FILE)


@lru_cache
def a_library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(A_FILE)
    found.encode_special_tokens = True
    return found


def plain_alignment(encoders, text):
    """(a ids, b ids, groups, overlaps, shared, end links) by comparing everything with everything."""
    none = [], [], [], 0, 0, []
    if not text:
        return none
    a = a_library().encode(" " + text, add_special_tokens=False).ids
    b = encoders.b.encode(text)
    data = (" " + text).encode()
    spelled = [encoders.b.id_to_piece(i) for i in b]
    b_data = [bytes([int(p[3:5], 16)]) if encoders.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, spelled)]
    if b"".join(b_data) != data or b"".join(encoders.a_bytes[i] for i in a) != data:
        return none
    a_ends, b_ends = (np.cumsum([len(x) for x in xs]).tolist() for xs in ([encoders.a_bytes[i] for i in a], b_data))
    groups = []
    i = j = 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        to_i, to_j = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
        groups.append((a[i:to_i], b[j:to_j]))
        i, j = to_i, to_j
    owners = [[i for i, (p, e) in enumerate(zip([0, *ends], ends)) for _ in range(e - p)] for ends in (a_ends, b_ends)]
    overlaps = len(set(zip(*owners)))  # byte by byte
    ending = dict(zip(b_ends, b))
    links = [(x, ending[e]) for x, e in zip(a, a_ends) if e in ending]
    return a, b, groups, overlaps, sum(len(x) * len(y) for x, y in groups), links


def group_text(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)


def check_alignment(encoders, rows, got):
    plain = [(doc, *plain_alignment(encoders, text)) for doc, text in rows]
    counts = Counter(link for *_, links in plain for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    want = []
    for doc, a, b, groups, overlaps, shared, links in plain:
        text = group_text(groups)
        n_best = sum(counts[link] == best[link[1]] for link in links)
        want.append((doc, len(a), len(b), len(groups), overlaps, shared, sha(text) if text else "", len(links), n_best, sum(counts[x] for x in links)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_shared", "groups_sha256", "n_links", "n_best", "count_sum"]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want, key=repr)


def test_alignment_query_by_brute_force(spark, encoders):
    check_alignment(encoders, documents(spark)[:], QUERIES["op11_alignment"](spark, SF_DIR))


def test_alignment_of_odd_rows(spark, corpus, nothing, encoders):
    from pyspark.sql import functions as F
    from tidemark.llm.common import WorkTables

    rows = [r for r in corpus.collect() if len(r.text or "") < 20_000]
    few = spark.createDataFrame(rows, corpus.schema)
    aligned = token_alignment.align(few, A_FILE, B_FILE)
    kept = aligned.withColumn("groups_sha256", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")).drop("groups")
    check_alignment(encoders, [(r.doc_id, r.text) for r in rows], token_alignment.scored(WorkTables(spark, "t").write("a", kept)))
    assert token_alignment.align(nothing, A_FILE, B_FILE).count() == 0
    long = token_alignment.align(corpus.where("length(text) >= 20000"), A_FILE, B_FILE).collect()
    assert len(long) == 3 and all(r.n_groups > 0 and r.groups.count(";") == r.n_groups - 1 for r in long)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=40).map("".join), max_size=5), st.integers(1, 30))
def test_chunks_change_nothing(texts, size):
    encoders = token_alignment._encoders(A_FILE, B_FILE)
    found = token_alignment.Measures(len(texts))
    for doc, text in enumerate(texts):  # a pass per document
        chunks = token_alignment.cut_text(text, size) if text else []
        assert not chunks or " ".join(chunks) == text
        found.take(encoders, [doc] * len(chunks), chunks)
    columns = [c.to_pylist() for c in found.columns(encoders)]
    for doc, text in enumerate(texts):
        a, b, groups, overlaps, shared, links = plain_alignment(encoders, text)
        assert [c[doc] for c in columns[:6]] == [len(a), len(b), len(groups), overlaps, shared, group_text(groups)]
        assert Counter({(p["a"], p["b"]): p["n"] for p in columns[6][doc]}) == Counter(links)


def test_long_blanks_take_the_other_library(encoders):
    for n in (998, 999, 1000, 1001, 3000):
        for text in ("a" + " " * n + "b", "\n" * n, " \t" * (n // 2) + "c"):
            assert encoders.encode([text])[0] == [encoders.with_blanks(" " + text)] == [encoders.a.encode_ordinary(" " + text)]
    assert len(encoders.encode([" " * 1_500_000 + "x"])[0][0]) == 1_500_001


def test_products_against_dense_matrices():
    rng = np.random.default_rng(3)
    for _ in range(30):
        dense = [rng.integers(0, 3, shape) * (rng.random(shape) < 0.4) for shape in ((7, 5), (5, 9))]
        a, b = (token_alignment.Rows(np.concatenate(([0], np.cumsum((m != 0).sum(1)))), m.nonzero()[1], m[m.nonzero()], m.shape[1]) for m in dense)
        for limit in (1, 4, 1000):
            out = np.zeros((7, 9), int)
            for i, j, v in token_alignment.product(a, b, limit):
                assert (out[i, j] == 0).all()
                out[i, j] = v
            assert (out == dense[0] @ dense[1]).all()
        t = a.transposed()
        back = np.zeros((5, 7), int)
        back[np.repeat(np.arange(5), np.diff(t.starts)), t.columns] = t.values
        assert (back == dense[0].T).all()


# 12 byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = bpe_transducer.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_against_another_library(spark, reference):
    want = []
    for doc, text in documents(spark):
        ids = reference.encode_ordinary(text or "")
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(reference.decode_bytes(ids))))
    got = QUERIES["op12_byte_bpe"](spark, SF_DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_bpe_of_odd_rows(spark, corpus, nothing, reference):
    rows = corpus.where("length(text) < 40000 or text is null")  # the other library's own split fails on very long blanks
    back = bpe_transducer.decode(bpe_transducer.encode(rows, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    key = lambda r: (str(r[0]), r[2])
    want = [(doc, reference.encode_ordinary(text or ""), text or "") for doc, text in texts_of(rows)]
    assert sorted(((r.doc_id, r.ids, r.text) for r in back), key=key) == sorted(want, key=key)
    long = bpe_transducer.decode(bpe_transducer.encode(corpus, RANKS, public_tokenizers.PATTERN), RANKS).where("length(text) > 40000").collect()
    assert [r.text for r in long] == ["x" * 50_000]
    assert bpe_transducer.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [220, 158, 220])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe_transducer.decode(ids, RANKS).orderBy("doc_id").collect()] == ["", "", " � "]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(BITS), max_size=40).map("".join), st.text(alphabet="ab-= ", max_size=200)))
def test_transducer_equals_merging(text):
    import tiktoken

    machine = bpe_transducer._transducer(RANKS)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=machine.ranks, special_tokens={}) if not hasattr(machine, "other") else machine.other
    machine.other = other
    for at_once in (0, 1_000_000):
        assert bpe_transducer.encode_text(text, RANKS, public_tokenizers.PATTERN, at_once).tolist() == other.encode_ordinary(text)


def test_few_states_and_bounded_lookahead(spark):
    ranks = bpe_transducer.read_ranks(RANKS)
    small, large = bpe_transducer.Transducer(ranks, max_states=50, max_pieces=20), bpe_transducer._transducer(RANKS)
    longest = max(map(len, ranks))
    for _, text in documents(spark)[:40]:
        pieces = [m[0] for m in bpe_transducer._pattern(public_tokenizers.PATTERN).finditer(text or "")]
        assert small.encode(pieces).tolist() == large.encode(pieces).tolist()
        assert len(small.ways) <= 51 and max(len(small.pieces), len(small.pieces.older)) <= 20
        assert [i for p in pieces for i in large.run(p.encode())] == large.encode(pieces).tolist()
    at = 0
    for byte in b"abracadabra" * 200:
        at, _ = large.move(at, byte)
        assert all(len(rest) < longest and sum(len(large.tokens[t]) for t in held) <= longest for _, held, rest in large.ways[at >> 8])


def test_a_vocabulary_the_method_does_not_fit_is_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300}  # no merge leads to it
    with pytest.raises(ValueError, match="no merges reach"):
        bpe_transducer.Transducer(ranks)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 50255)), max_size=30), st.integers(1, 5))
def test_stream_decoding(ids, piece):
    decoder = bpe_transducer._decoder(RANKS)
    parts = [decoder.feed(ids[i : i + piece]) for i in range(0, len(ids), piece)]
    assert "".join(parts) + decoder.close() == b"".join(decoder.tokens[i] for i in ids).decode("utf-8", "replace")


# 13 periodic runs


def smallest_period(words):
    return next((p for p in range(1, len(words)) if words[p:] == words[:-p]), len(words))


def plain_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(12, 2 * q) and smallest_period(words[start : start + length]) == q:
                found.append((start, length, q))
            i = max(i, start + 1) if i > start else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


blocks = st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(1, 7), st.integers(0, 5)), max_size=5)
docs_of_words = st.lists(blocks.map(lambda bs: [w for block, times, cut in bs for w in (block * times)[cut:]]), min_size=1, max_size=3)


@settings(max_examples=400, deadline=None)
@given(st.one_of(docs_of_words, st.lists(st.lists(st.integers(0, 1), max_size=60), min_size=1, max_size=3)))
def test_runs_by_brute_force(docs):
    found = periodic_runs.runs_of(np.array([w for d in docs for w in d], np.int64), np.array([len(d) for d in docs], np.int64))
    assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, d in enumerate(docs) for r in plain_runs(d)]


def test_diagonals_stay_few_where_everything_repeats():
    for words in ([0] * 20_000, list(range(10)) * 2_000, ([0, 1] * 9 + [2]) * 1_000):
        places, lags = periodic_runs.diagonals(np.array(words), np.array([len(words)]))
        assert len(places) <= 2 * len(words)
    assert periodic_runs.runs_of(np.zeros(20_000, np.int64), np.array([20_000])).tolist() == [[0, 0, 20_000, 1]]


def planted(doc, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_query_by_brute_force(spark):
    got = {r.doc_id: r.asDict() for r in QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    rows = documents(spark)
    assert len(got) == len(rows)
    some = 0
    for doc, text in rows:
        words = planted(doc, text)
        if len(words) > 1500 and zlib.crc32(str(doc).encode()) % 10:
            continue  # the plain version takes the square of a text's length
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        want = {
            "doc_id": doc,
            "n_runs": len(runs),
            "start": best[0],
            "length": best[1],
            "period": best[2],
            "exponent_milli": best[1] and 1000 * best[1] // best[2],
            "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            "collapsed_sha256": sha(collapsed(words, runs)),
        }
        assert got[doc] == want
        some += bool(runs)
    assert some > 10


def test_runs_of_odd_rows(corpus, nothing):
    got = [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(corpus).collect()]
    want = []
    for doc, text in texts_of(corpus):
        words = WORD.findall(text or "")
        runs = plain_runs(words) if len(words) < 1000 else []
        want.append((doc, len(words), runs, collapsed(words, runs)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert (14, 400, [(0, 400, 1)], "same") in got
    assert periodic_runs.find_runs(nothing).count() == 0
