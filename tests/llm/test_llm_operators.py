"""Each operator against a brute-force version on rows with nulls, long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F
from tidemark.llm import chat_windows, debruijn, line_crf, mixing, phrase_index, repetition, simhash, sparse_suffix, token_counts, url_rules
from tidemark.llm.common import WorkTables
from tidemark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1 token counts


def test_token_counts_match_plain_encoding(corpus, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    lengths = [len(other.encode(t or "", add_special_tokens=False).ids) for _, t in rows_of(corpus)]
    hist = {r.length: r for r in token_counts.histogram(corpus).collect()}
    assert {n: r.n_docs for n, r in hist.items()} == Counter(lengths)
    for limit, r in hist.items():
        assert r.docs_at_least == sum(n >= limit for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    frame = token_counts.histogram(corpus)
    assert token_counts.truncated_total(frame, 77) == sum(min(n, 77) for n in lengths)
    assert token_counts.quantile(frame, 0.5) == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.histogram(nothing).count() == 0
    assert token_counts.quantile(token_counts.histogram(nothing), 0.5) is None


def test_token_counts_by_group(corpus):
    found = token_counts.histogram(corpus, by=("source",)).groupBy("source").agg(F.sum("n_docs").alias("n"), F.max("total_docs").alias("t")).collect()
    assert {r.source: r.n for r in found} == {r.source: r.t for r in found} == Counter(r.source for r in corpus.collect())


# 2 decontamination


def fold(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination_by_brute_force(spark, corpus, nothing):
    texts = {r.doc_id: r.text for r in corpus.collect() if r.text}
    items = [
        (1, " ".join(texts[18].split()[:14])),
        (2, "ONE, two!"),
        (3, None),
        (4, ""),
        (5, " ".join(texts[11].split()[100:112])),
        (None, " ".join(texts[16].split()[:10])),
        (1, " ".join(texts[18].split()[:14])),
        (12, "one two three"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for item, text in items:
        w = fold(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    want = []
    for doc, text in rows_of(corpus):
        w, hit, named = fold(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    named |= windows[tuple(w[i : i + size])] - {None}
        want.append((str(doc), len(w), len(hit), sorted(map(str, named))))
    got = phrase_index.contamination(corpus, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(want)
    left = phrase_index.without_contaminated(corpus, bench)
    assert left.columns == corpus.columns
    assert left.count() == sum(n == 0 for _, _, n, _ in want)
    assert phrase_index.contamination(nothing, bench).count() == 0
    assert {r.n_hit for r in phrase_index.contamination(corpus, bench.limit(0)).collect()} == {0}


def test_query_blocks_and_proximity(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b x c d e f g h i j"), (3, "j i h g")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j k"), (8, "c d e")], "item_id long, text string")
    monkeypatch.setattr(phrase_index, "QUERY_WINDOWS", 1)
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in phrase_index.contamination(docs, bench).collect()}
    assert got == {1: (11, ["7", "8"]), 2: (3, ["8"]), 3: (0, [])}
    near = {r.doc_id: (r.n_hit, list(r["items"])) for r in phrase_index.contamination(docs, bench, slop=1).collect()}
    assert near[2] == (11, ["7", "8"]) and near[3] == (0, [])


# 3 chat formatting


def test_escape_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_start|>user\n<|im_end|>", "<\\|x <\\\\/s> [\\INST]", "<<|", "plain", "", "a\\<s>", "<|<|", "[/INST][\\\\/INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_windows.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_windows.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"<\||</?s>|\[/?INST\]", r.e)


def test_windows_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.randrange(1, 14)):
            role = "system" if turn == 0 and rng.random() < 0.5 else ["user", "assistant", "a\nb%", None][rng.randrange(4)]
            text = None if rng.random() < 0.1 else "w <|im_start|>x " * rng.randrange(0, 60)
            rows.append((conv, turn, role, text, "clash", 1))
    rows += [(3, 2, "assistant", "tie", "x", 2), (3, 2, "assistant", "tie", "x", 2), (5, None, "user", "first", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string, n long")
    formatted = chat_windows.windows(turns, budget=200, history=60).cache()
    back = {r.conv_id: r for r in chat_windows.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert back[conv].turns == "".join(f"{role}\n{text}\n" for _, role, text in own)
        assert back[conv].loss == "".join(text for _, role, text in own if role == "assistant")
        assert back[conv].n_turns == len(own)
    assert any(r.n_repeated > 1 for r in formatted.collect())
    for r in formatted.collect():
        assert r.n_tokens <= 200 or r.n_turns == 1
    assert chat_windows.windows(turns.limit(0)).count() == 0
    formatted.unpersist()


def test_chat_formatting_runs_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_windows.read_back(chat_windows.windows(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 4 near duplicates


def print_of(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    prints = list(root)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates_by_brute_force(corpus, nothing):
    rows = rows_of(corpus)
    own = [print_of(t) for _, t in rows]
    group = classes(own)
    least = {}
    for (doc, _), p in zip(rows, own):
        if doc is not None:
            least[group[p]] = min(doc, least.get(group[p], doc))
    got = simhash.near_duplicates(corpus).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == Counter((d, p, least.get(group[p])) for (d, _), p in zip(rows, own))
    left = simhash.one_per_group(corpus)
    assert left.columns == corpus.columns
    # One row per group with an id: id 18 has two unlike texts, both groups keep theirs.
    assert Counter(r.doc_id for r in left.collect()) == Counter([*(i for i in least.values() if i is not None), None, None])
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_per_group_does_not_hang_on_row_order(spark):
    rng = random.Random(11)
    prose = lambda: " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(60))
    a, b, c = prose(), prose(), prose()
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (7, c, "x"), (7, c, "x"), (8, c, "z"), (9, None, "n"), (9, "", "n"), (3, a + " ", "w")]
    want = [(1, a, "x"), (5, b, "y"), (7, c, "x")]
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
        got = [tuple(r) for r in simhash.one_per_group(df).collect()]
        assert sorted(r for r in got if r[0] < 9) == want
        assert len(got) == 4  # and one of the two texts without words


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("longest", [0, 64])
def test_links_of_few_bits_by_brute_force(spark, max_bits, longest):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    prints = sorted({int(c) ^ (1 << int(i)) ^ (1 << int(j)) for c in centres for i, j in rng.integers(0, 9, (25, 2))})
    df = spark.createDataFrame([(p - (1 << 64) * (p >> 63),) for p in prints], "fp long")
    tables = WorkTables(spark, "test")
    found = {r.node: r.component for r in components(simhash.links(df, tables, max_bits, longest), tables).collect()}
    group = {p: p for p in prints}
    for p in prints:
        for q in prints:
            if p < q and (p ^ q).bit_count() <= max_bits:
                old, new = group[q], group[p]
                group = {k: new if g == old else g for k, g in group.items()}
    sides = defaultdict(set)
    for p, g in group.items():
        sides[g].add(p - (1 << 64) * (p >> 63))
    got = defaultdict(set)
    for p in prints:
        signed = p - (1 << 64) * (p >> 63)
        got[found.get(signed, signed)].add(signed)
    assert sorted(map(sorted, sides.values())) == sorted(map(sorted, got.values()))


def test_columns_named_like_the_operators_own(spark):
    words = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, words, "a", 1, 2, 3, 4), (2, "x " + words, "b", 1, 2, 3, 4)], "doc_id long, text string, _d string, _k int, _spans int, hit_id int, hit_key int")
    for module in (debruijn, sparse_suffix):
        got = {r.doc_id: (r.text, r._d, r._spans) for r in module.without_repeats(docs).collect()}
        assert got == {1: (words, "a", 2), 2: ("x", "b", 2)}
    bench = spark.createDataFrame([(1, "x w0 w1 w2 w3 w4 w5 w6 w7 w8")], "item_id long, text string")
    left = phrase_index.without_contaminated(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [1]


def test_fitting_does_not_hang_on_row_order(spark):
    rng = random.Random(3)
    rows = [(i % 30, f"line {i}.\n" + " ".join(rng.choice("abc") * 3 for _ in range(20))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    probe = spark.createDataFrame(rows[:20], "doc_id long, text string")
    scores = []
    for _ in range(2):
        rng.shuffle(rows)
        model = line_crf.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels)
        scores.append([r.score for r in line_crf.score(probe.coalesce(1), model).collect()])
    assert scores[0] == scores[1]


@pytest.mark.parametrize("longest", [0, 5, 64])
def test_long_lists_give_the_same_components(spark, longest):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = {int(c) ^ (1 << int(i)) ^ (1 << int(j)) for c in centres for i, j in rng.integers(0, 64, (30, 2))}
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    tables = WorkTables(spark, "test")
    found = {r.node: r.component for r in components(simhash.links(df, tables, list_rows=longest), tables).collect()}
    want = classes(prints)
    groups = defaultdict(set)
    for p in prints:
        s = p - (1 << 64) * (p >> 63)
        groups[want[p]].add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(df, WorkTables(spark, "test")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 5 mixing


def test_mixing(spark, corpus, nothing):
    got = mixing.taken(corpus, block_tokens=64)
    again = mixing.taken(corpus, block_tokens=64)
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.target, r.taken)
    rows = got.collect()
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    assert len(rows) == corpus.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 0.5
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert mixing.taken(nothing).count() == 0


def test_schedule_is_near_the_weights_everywhere(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    _, plan, pieces = mixing.mix(docs, block_tokens=20)
    rows = sorted(plan.collect())
    share = {"s0": 1 / 7, "s1": 2 / 7, "s2": 3 / 7, "s3": 1 / 7}
    for n in (50, 200, len(rows)):
        seen = Counter(r.source for r in rows[:n])
        assert all(abs(seen[s] - n * w) <= 4 for s, w in share.items())
    assert pieces.agg(F.sum("tokens")).first()[0] == sum(r.take for r in rows)


# 6 repetition


def test_repetition_by_brute_force(corpus, nothing):
    def windowed(words, n):
        where = defaultdict(list)
        for i in range(len(words) - n + 1):
            where[tuple(words[i : i + n])].append(i)
        return {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + n)}

    want = []
    for doc, text in rows_of(corpus):
        text = text or ""
        w = WORD.findall(text)
        longest = 0
        while len(w) < 1000 and windowed(w, longest + 1):
            longest += 1
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n3, n10 = len(windowed(w, 3)), len(windowed(w, 10))
        failed = len(w) < 50 or 100 * n3 > 50 * len(w)
        want.append((str(doc), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n3, n10, longest, failed))
    got = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered, r.longest_repeat if r.n_words < 1000 else 0, r.base_failed) for r in repetition.judge(corpus).collect()]
    assert sorted(got) == sorted(want)
    assert repetition.judge(nothing).count() == 0


# 7, 8 long passages


def passages_by_brute_force(rows, size=50):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - size + 1 if d is not None else 0):
            key = tuple(w[i : i + size])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = {p for i in range(len(w) - size + 1 if d is not None else 0) if first[tuple(w[i : i + size])] < d for p in range(i, i + size)}
        out.append((str(d), len(w), [x for p, x in enumerate(w) if p not in gone]))
    return sorted(out)


@pytest.mark.parametrize("module", [debruijn, sparse_suffix])
def test_passages_by_brute_force(corpus, nothing, module):
    cut = module.without_repeats(corpus)
    assert set(corpus.columns) <= set(cut.columns)
    got = sorted((str(r.doc_id), r.n_words, WORD.findall(r.text or "")) for r in cut.collect())
    assert got == passages_by_brute_force(rows_of(corpus))
    assert cut.where("text is null").count() == 1
    assert module.without_repeats(nothing).count() == 0


def test_paths_end_at_branches_and_gaps(spark):
    # Source 1: a chain of four units, of which the node "12" has two ways out; source 2 starts there. Unit 9 stands apart.
    rows = [(1, 0, 0, 3, 10, 11), (1, 0, 3, 1, 11, 12), (1, 0, 4, 2, 12, 13), (1, 0, 6, 1, 13, 14), (1, 0, 9, 1, 14, 15), (2, 0, 5, 1, 12, 20)]
    units = spark.createDataFrame(rows, "s_doc long, s_key long, s_start int, n int, tail long, head long")
    nodes = debruijn.through_nodes(units)
    assert sorted(r.node for r in nodes.collect()) == [11, 13, 14]
    got = {(r.s_doc, r.s_start): r.path for r in debruijn.compacted(units, nodes).collect()}
    assert got == {(1, 0): 0, (1, 3): 0, (1, 4): 4, (1, 6): 4, (1, 9): 9, (2, 5): 5}
    # Document 7 has units 0 to 5 twice over, once with a gap; the places at another shift are a span of their own.
    met = [(7, 0, 100, 3, 0), (7, 0, 103, 1, 3), (7, 0, 103, 1, 3), (7, 0, 200, 3, 0), (7, 0, 300, 2, 4), (7, 0, 304, 1, 8)]
    met = spark.createDataFrame([(*m, 1, 0, 0 if m[4] < 4 else 4) for m in met], "doc_id long, text_key long, start int, n int, s_start int, s_doc long, s_key long, path int")
    spans = sorted((r.start, r.end) for r in debruijn.parallel_spans(met, 12).collect())
    assert spans == [(100, 115), (200, 214), (300, 313), (304, 316)]


def test_graph_of_texts_that_part_and_meet(spark):
    """Common stretches with changed, left out and moved words, in many documents: the graph has branches of all kinds."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(40)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for doc in range(1, 40):
        words = list(base[rng.randrange(200) : rng.randrange(200, 400)])
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(3)] = [f"x{doc}"] * rng.randrange(2)
        rows.append((doc // 2 if doc % 9 == 0 else doc, "\n".join(words * (1 + doc % 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = debruijn.without_repeats(docs, 12)
    got = sorted((str(r.doc_id), r.n_words, WORD.findall(r.text)) for r in out.collect())
    assert got == passages_by_brute_force(rows, 12)


def test_common_words_of_sorted_neighbours(spark):
    """Texts that sort by bytes keep what starts with the same words together, also where a word holds a byte below a blank."""
    common = sparse_suffix.common_words
    assert common(b"a b ", b"a b ") == 2 and common(b"a b ", b"a bc ") == 1 and common(b"a ", b"a b ") == 1
    assert common(b"a b ", b"a b c ") == 2 and common(b"a\x01 ", b"a ") == 0
    rng = random.Random(5)
    texts = [b"".join(rng.choice([b"a ", b"b ", b"a\x01 ", b"ab "]) for _ in range(6)) for _ in range(300)]
    ordered = sorted(texts)
    for i, a in enumerate(ordered):
        near = max(common(a, ordered[j]) for j in (i - 1, i + 1) if 0 <= j < len(ordered))
        assert near == max(common(a, b) for j, b in enumerate(ordered) if j != i)


def test_windows_are_cut_to_what_neighbours_share(spark):
    """A suffix with two words before it and windows of four words; the sorted part's outermost rows stay uncut."""
    rows = [
        (1, 0, 2, 0, 2, b"s t b a ", b"s t x y "),
        (2, 0, 2, 0, 2, b"s t b c ", b"s t x z "),  # right: three words with row 1, so no window that starts at the suffix
        (3, 0, 2, 0, 2, b"s t q a ", b"s t y y "),  # right: two words, so only the window two words before it
        (0, 0, 2, 0, 2, b"a a ", b"a a a a "),
        (4, 0, 2, 0, 2, b"z z ", b"z z z z "),
    ]
    frame = spark.createDataFrame(rows, sparse_suffix.SIDES + ", right binary").coalesce(1)
    cut = lambda df, side: {r.doc_id: (r.low, r.high) for r in sparse_suffix.extended(df, side, window=4, anchor=2).collect()}
    assert cut(frame, "right") == {0: (0, 2), 1: (1, 2), 2: (1, 2), 3: (2, 2), 4: (0, 2)}
    assert cut(frame, "left") == {0: (0, 2), 1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 2)}


@pytest.mark.parametrize("module", [debruijn, sparse_suffix])
def test_passages_of_few_words(spark, module):
    """Random texts of three words: windows of 12 words meet with many different surroundings."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        if i and rng.random() < 0.7:
            other = rng.choice(rows)[1].split()
            at = rng.randrange(len(other) + 1)
            words[5:5] = other[at : at + rng.randrange(30)]
        rows.append((i // 2 * 2 if i % 7 == 0 else i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, WORD.findall(r.text)) for r in module.without_repeats(docs, 12).collect())
    assert got == passages_by_brute_force(rows, 12)


# 9 classifier


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 4])
    emission, transition = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, log_z = line_crf.Chains(lengths).marginals(emission, transition)
    want, pairs, z_sum, at = [], np.zeros((2, 2)), 0.0, 0
    for n in lengths:
        total, ones, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in np.ndindex(*[2] * n):
            p = np.exp(sum(emission[at + i] * v for i, v in enumerate(y)) + sum(transition[a, b] for a, b in zip(y, y[1:])))
            total += p
            ones += p * np.array(y)
            for a, b in zip(y, y[1:]):
                own[a, b] += p
        want += list(ones / total)
        pairs += own / total
        z_sum += np.log(total)
        at += n
    assert np.allclose(good, want) and np.allclose(pair, pairs) and np.isclose(log_z, z_sum)


def test_classifier_on_held_out_rows(spark, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.fit(docs, labels)
    rows = line_crf.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (3, "a", "z"), (3, "a", "z"), (4, "word " * 20000, "z")], "doc_id long, text string, score string")
    found = line_crf.score(odd, model).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (1, None)} == {model.base}
    assert line_crf.score(nothing, model).count() == 0
    unfitted = line_crf.fit(docs, labels.limit(0))
    assert {r.score for r in line_crf.score(odd, unfitted).collect()} == {0.5}
    kept = line_crf.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in found)


# 10 url rules


def test_url_rules(spark):
    urls = [
        "http://net/x", "http://a.NET/x?q", "http://xnet/", "https://example.net/en/1", "https://www.example.net/EN/1", "http://a.example.com/de/1",
        "http://b.org/fr/", "http://b.org/fr", "http://b.net", None, "", "nonsense", "://", "http://x.dev/cart/1", "http://x.dev/en/login?x", "http://x.casino-win.dev/",
        "http://old.casino-history.dev/", "http://x.dev/wp-admin/", "http://net/x", "http://pokers.dev/", "http://poker.dev/",
    ]
    pages = spark.createDataFrame([(i if i != 5 else None, u, "h", "b") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rules = [url_rules.host_rule(*r) for r in url_rules.HOST_RULES] + [url_rules.pattern_rule(*r) for r in url_rules.PATTERN_RULES]
    table = url_rules.rules_table(spark, rules)

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        own = [r for r in rules if r.by_host and url is not None and re.search(r.regex, host + path)]
        if own:
            best = max(own, key=lambda r: len(r.text))
            return host, path, best.text, best.action
        other = {r.action for r in rules if not r.by_host and url is not None and re.search(r.regex, url.lower())}
        return host, path, None, "allow" if "allow" in other or not other else "block"

    got = url_rules.judge(pages, table)
    assert Counter((r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter(map(brute, urls))
    assert url_rules.judge(pages, table.limit(0)).where("verdict = 'block'").count() == 0
    assert url_rules.judge(pages.limit(0), table).count() == 0
    bare = url_rules.rules_table(spark, [url_rules.pattern_rule("block", "*dev*")])
    assert url_rules.judge(pages, bare).where("verdict = 'block'").count() == sum("dev" in (u or "") for u in urls)


def test_every_literal_token_is_needed_whole():
    assert url_rules.host_rule("block", "example.com/de").tokens == ["example", "com"]
    assert url_rules.pattern_rule("block", "*ads^banner*").tokens == []
    assert url_rules.pattern_rule("block", "*^ads^banner/*").tokens == ["ads", "banner"]


def test_digests_of_the_passage_query_are_those_of_words(spark):
    from tidemark.llm.queries import _kept_words

    docs = spark.createDataFrame([(1, " a\tb  c\n"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.kept_sha256 for r in _kept_words(debruijn.without_repeats(docs)).collect()}
    assert got == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest(), 3: hashlib.sha256(b"").hexdigest()}
