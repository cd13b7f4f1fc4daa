"""Small documents that hold what operators stumble over."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(seed=3, n=120):
    """Rows with copies, near copies, shared lines, odd white space, personal data, nulls and empty texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéñß") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k)) + "."
    shared = [prose(12) for _ in range(3)]
    rows, texts = [], []
    for i in range(n):
        text = "\n".join(prose(rng.randint(3, 40)) for _ in range(rng.randint(1, 5)))
        kind = i % 12
        if kind == 1 and texts:
            text = rng.choice(texts)
        elif kind == 2 and texts:
            ws = rng.choice(texts).split(" ")
            ws[rng.randrange(len(ws))] = "changed"
            text = " ".join(ws)
        elif kind == 3:
            text = rng.choice(shared) + "\n  " + rng.choice(shared).upper() + "\t\n" + text
        elif kind == 4:
            text = text.replace(" ", rng.choice(["  ", "\t", " \x0b", "\xa0", "\x1c", "  "]))
        elif kind == 5:
            text += " mail a.b7@mail3.example.com or +1 (415) 555-0132, card 4111 1111 1111 1111, 10.20.30.40 on 2021-02-28"
        elif kind == 6:
            text = rng.choice(["", " \n\t", "one", "two words", "<|endoftext|> in <|startoftext|>a text", "𝔘nicode ﬁ é Å"])
        elif kind == 7:
            text = "### menu | home | about | contact\n" + text + "\n" + text
        texts.append(text)
        rows.append((i, text, "en", f"src{0 if i % 3 else i % 5}", len(text)))
    rows.append((n, None, None, None, None))
    rows.append((n + 1, "x" * 30_000, "en", "src1", 30_000))
    rows.append((n + 2, " ".join(rng.choice(words) for _ in range(20_000)), "de", "src1", 0))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, a repeated row, a repeated id, and columns named like those that operators add."""
    rows = [
        (None, None, None, None, None, "a", True, 1),
        (None, "no id but a text that is long enough to be a line", None, "s", 3, "b", None, None),
        (7, "repeated row of ten words that stand in one line here", "en", "s", 9, "c", False, 2),
        (7, "repeated row of ten words that stand in one line here", "en", "s", 9, "c", False, 2),
        (8, "same id, first text of two, with some words to spare", "en", None, 9, "d", True, 3),
        (8, "same id, another text altogether", "en", "s", 9, "e", True, 4),
        (9, "", "", "", 0, "", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA + ", word string, _kept boolean, _copy int")
