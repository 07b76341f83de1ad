import random

import pytest

LONG = "ab cd\n" * 5000


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    rows = [(1, "hello world, password: abcdefghijkl1234"), (2, None), (3, ""), (4, " \t\n"), (None, "hello world"),
            (5, LONG), (6, LONG), (7, "é ñ 漢字 👍🏽 <|endoftext|> ▁x"), (8, "0123456789abcdef0123"), (8, "0123456789abcdef0123"),
            (9, "!!! 123 ---"), (None, None)]
    return spark.createDataFrame(
        [(i, t, "en" if t else None, "s", 1, 2, 0.5, ["z"]) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, items array<string>")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus():
    """Made texts with copies, near copies, shared lines and shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line, passage = "This Very line is shared by many documents", text(70)
    out = []
    for i in range(120):
        kind = i % 6
        body = text(rng.randint(1, 150))
        if kind == 1 and i > 6:
            body = out[rng.randrange(len(out))][1]
        if kind == 2 and i > 6:
            own = out[rng.randrange(len(out))][1].split(" ")
            own[rng.randrange(len(own))] = "changed"
            body = " ".join(own)
        if kind == 3:
            body += "\n" + line + " \n" + text(5)
        if kind == 4:
            body = body + " " + passage + " " + text(3)
        out.append((i * 3 + 1, body))
    return out
