import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, n_words string, size string, t string, fp string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with nulls, empty and very long texts, ties, repeated rows, shared passages, and clashing column names."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "ba do mi ka su re".split() for b in "n r l st nd x".split()] + ["Été", "ñandú", "|", "a,b"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    base = prose(120)
    texts = [
        (1, base),
        (2, base),
        (3, base.replace(" ", "\n", 9)),
        (4, prose(30) + " " + passage + "\n" + prose(40)),
        (5, passage + " " + prose(60)),
        (6, prose(20) + "\n" + passage),
        (7, None),
        (8, ""),
        (9, " \n\t\x0b "),
        (10, "one two"),
        (11, prose(3000) + " " + passage + " " + prose(3000)),
        (12, "x" * 50_000),
        (13, " " * 20_000 + "end"),
        (14, "same " * 400),
        (15, prose(49)),
        (16, prose(50)),
        (17, "\n".join([prose(12), "Line again.", "Line again.", prose(30), "Line again."])),
        (None, base),
        (None, prose(60)),
        (2, base),
        (18, passage),
        (18, prose(80)),
        (19, passage.upper()),
    ]
    rows = [(i, t, None, f"s{n % 3}" if n % 5 else None, None, "x", "y", "z", "t", "f") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
