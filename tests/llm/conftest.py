from __future__ import annotations

import random

import pytest

# Columns that operators use inside, put into the input under the same names.
CLASHING = ("key", "fp", "n_words", "score", "slot", "block", "blob", "count", "component_id", "kept", "runs", "_words", "part", "label")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(rng: random.Random, n: int) -> str:
    syllables = ["ka", "lo", "mi", "ren", "tu", "sol", "é", "ß", "Va", "ni"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", ",", ".\n"]) for w in words)


def messy_rows() -> list[tuple]:
    """Nulls, empty and blank texts, one long text, copies, near copies, ties and repeated passages."""
    rng = random.Random(5)
    passage = prose(rng, 45)
    copied = prose(rng, 120)
    texts: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two"), (5, prose(rng, 9))]
    texts += [(10 + i, prose(rng, rng.randint(15, 150))) for i in range(20)]
    texts += [(40 + i, copied) for i in range(6)]
    texts += [(50 + i, copied + f" extra{i}") for i in range(4)]
    texts += [(60 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 20)) for i in range(5)]
    texts += [(70, " ".join(["same"] * 60)), (71, prose(rng, 20_000)), (72, "x" * 70_000), (73, "line a b\nline a b\nline a b\n" * 4)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 3}", None, *["?"] * len(CLASHING)) for i, t in texts]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def with_null_key(spark):
    """The same with rows without a key and rows repeated."""
    rows = messy_rows()
    return spark.createDataFrame([*rows, *rows[5:8], (None, *rows[8][1:]), (None, "no key " * 9, *rows[8][2:])], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df) -> dict[int, str]:
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
