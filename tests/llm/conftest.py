import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def docs(spark):
    """A builder of documents with all columns, from (doc_id, text) or (doc_id, text, lang) rows."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if not extra:
            return df
        # Columns whose names the operators use inside.
        for name in ("fp", "node", "component_id", "score", "keep", "piece", "length", "ids", "media", "payload", "bucket"):
            df = df.selectExpr("*", f"'own' as {name}")
        return df

    return build


@pytest.fixture
def prose():
    def make(n, seed=0):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."

    return make


AWKWARD = [(1, None), (2, ""), (3, " "), (4, "\n\t  \n"), (5, "x"), (6, "Ω é 日本 🎉​\xa0\x85 z"), (7, "a" * 20000), (8, "word " * 5000), (9, "same text twice, a copy."), (10, "same text twice, a copy."), (11, "<|endoftext|> <s> ▁ \x00 nul"), (None, "no id here."), (12, "12345 67890 !!! ###")]


@pytest.fixture
def awkward():
    return AWKWARD
