"""Small tables with the cases that every operator has to handle."""

import random

import pytest

VOCABULARY = ["the", "of", "and", "stone", "river", "garden", "winter", "letter", "song", "Été", "naïve", "don't", "x1", "42", "über", "café", "list", "run", "keep", "ends"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp int, bucket string, blob string, row string, words int, key int, rest string, place string, component string"


def prose(rng, n):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", " ", ", ", ".\n", "  ", "\t"]) for _ in range(n))


def corpus(seed=5, n=60):
    """(doc_id, text) with copies, near copies, shared passages and lines, long and odd texts."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    line = "Subscribe to our letter today"
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows:
            base = (rng.choice(rows)[1] or "").split(" ")
            base[rng.randrange(len(base))] = "changed"
            text = " ".join(base)
        elif kind == 2:
            text = prose(rng, 20) + passage + prose(rng, 20)
        elif kind == 3:
            text = f"{prose(rng, 15)}\n  {line.upper() if i % 2 else line} \n{prose(rng, 15)}\n{line}"
        else:
            text = prose(rng, rng.choice([1, 3, 30, 200]))
        rows.append((i * 3, text))
    rows += [(1001, None), (1002, ""), (1003, " \n\t "), (1004, "a" * 5000), (1005, "é" * 3000), (1006, "same words " * 400), (1007, "<|endoftext|> x<|startoftext|>y"), (1008, "\x00\x00\x0b|#*"), (1009, prose(rng, 6000)), (1010, "one two three"), (1011, "One  two\nthree"), (1012, "..!?"), (1013, "日本語 текст עברית")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def make(spark):
    def build(pairs, langs=None):
        data = [(i, t, (langs or {}).get(i, "en"), "src0", None if t is None else len(t), 1, "b", "c", "d", 2, 3, "e", "f", "g") for i, t in pairs]
        return spark.createDataFrame(data, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd(rows):
    """Rows that repeat an id or one another, and rows without an id."""
    return [*rows, rows[2], rows[2], (rows[3][0], rows[8][1]), (None, rows[2][1]), (None, None), (None, "no id here but some words to keep it company")]
