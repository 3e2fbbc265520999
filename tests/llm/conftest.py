from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, unit int"


def prose(seed: int, words: int, letters: str = "aeiorstn") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, ties, repeated rows, nulls, empty and very long texts."""
    base, passage = [prose(k, 40 + 3 * k) for k in range(12)], prose(99, 60)
    out: list[tuple[int | None, str | None]] = [(k, t) for k, t in enumerate(base)]
    out += [(20 + k, base[k]) for k in range(4)]
    out += [(30 + k, base[k + 4].replace(base[k + 4].split()[5], "changed", 1)) for k in range(4)]
    out += [(40 + k, f"{prose(200 + k, 30)}\n{passage} {prose(300 + k, 10)}") for k in range(6)]
    out += [(50, "é" * 60 + "aaaa" * 40), (51, "x" + "é" * 60 + "aaaa" * 50), (52, "A" * 49), (53, "A" * 50), (54, "A" * 51), (55, "b"), (56, ""), (57, None), (58, "   \n\t "), (59, "日本語 テキスト 🎉🎉 <|endoftext|> don't  stop")]
    out += [(60, " ".join(prose(7, 4000).split() + passage.split())), (61, passage), (61, passage), (None, passage), (None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents, with further columns whose names operators might use for themselves."""
    rows = [(i, t, ("en", "de", None, "xx-long")[k % 4], f"src{k % 3}" if k % 5 else None, len(t or ""), 7, "k", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
