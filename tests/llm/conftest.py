import os
import random
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
if HERE not in sys.path:
    sys.path.insert(0, HERE)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, "
          "out string, doc string, key string, h string, c string, s string, z string, found string, "
          "score double, ids string, label string")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus() -> list[tuple[int, str | None]]:
    """Texts with every awkward case, and planted copies, passages and phrases."""
    rng = random.Random(5)
    base = " ".join(words(rng, 300))
    passage = " ".join(words(rng, 60))
    long = " ".join(words(rng, 30_000))
    rows: list[str | None] = [
        None, "", " \t\n\r\x0b\x0c ", "one", "a b c d", "a b c d", base, base, base + " x",
        base.replace(base.split()[150], "changed"), base.upper(), long, long + "\nand more",
        " ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 50)),
        passage + "\n\n" + passage, " ".join(words(rng, 30)) + "\n" + passage,
        "For " * 900, "aaaa" * 700, "x\ny\n" * 60, "%%% ### $$$ " * 40, "SHOUT LOUD " * 30,
        "<|endoftext|> odd  spaces \n here<|endoftext|>", "日本語 テキスト 😀 " * 30,
        "Released under the MIT License.", "foo\nLICENSED under the Apache License, Version 2.0!\nbar",
        " ".join(words(rng, 25)) + "\x00 nul \x85 next",
    ]
    for _ in range(25):
        rows.append(" ".join(words(rng, rng.randint(5, 200))))
    family = words(rng, 120)
    for _ in range(30):  # near copies of one another, some only through others
        w = list(family)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(9)
        rows.append(" ".join(w))
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "src", -1 if t is None else len(t), *["x"] * 0, 7, "o", "d", "k", "h", "c", "s",
          "z", "f", 0.5, "i", "l") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    from fxledger.llm.shipping import ship

    return frame(ship(spark), rows).repartition(3).cache()


@pytest.fixture(scope="session")
def repeated(spark, rows):
    """The same with every row twice, and rows of a null id."""
    return frame(spark, rows + rows + [(None, "lost id"), (None, None)]).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
