import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, component_id long"
SYLLABLES = "the an er on re th nd in ti es or he at en is".split()


def prose(rng, words):
    """Invented prose: random words of syllables, in sentences."""
    out = []
    for i in range(words):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(w + (". " if i % 11 == 10 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def texts():
    """Clean prose with copies, near copies, shared passages, and every odd case."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(60)]
    passage = prose(rng, 110)
    out = list(base)
    out += [base[0]] * 3 + [base[1]] * 2  # exact copies
    for i in (2, 2, 2, 3, 4, 5):  # near copies
        w = base[i].split(" ")
        w[len(w) // 2] = "changed"
        w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        out.append(" ".join(w))
    out += [f"{b[:200]} {passage} {b[200:400]}" for b in base[10:16]]  # a passage that repeats across documents
    out += [None, "", " \n\t ", "one", "one two three four", "one two three four", "ONE two three four", "x", "42 !!", "a b " * 400, "tick tock\n" * 90, base[7] + "\n" + base[7]]
    out.append(" ".join(base[20:50]) * 3)  # very long
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with nulls in every other column, a repeated row and columns whose names the operators use."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", None, "s1"][i % 3], None, 1.0, 3, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8]], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
