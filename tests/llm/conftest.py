import pytest

#: Names that operators use inside, as columns of the user's.
CLASHES = (
    "key score id component ids value node _text _digit _found _pii _spans _rules _rules_key _rules_salt _hash _key _id _gone spans secrets pii rules grams low trigram f least root "
    "old new n m t s g a b c part y r rank held label long fp _c toxic quality predicted held_out item_id start end edits fingerprint component_id"
).split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names operators use inside."""

    def make(texts):
        rows = [(d, t, "en", "s", None if t is None else len(t), *CLASHES) for d, t in texts]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    """Invented prose from a seed."""
    import random

    def make(seed, n):
        rng = random.Random(seed)
        parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
        return [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))) for _ in range(n)]

    return make
