import pytest

WORDS = "the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(n, seed=0):
    """n words without much repetition."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) * (rng.random() < 0.5) for _ in range(n))


ODD = [None, "", "   \n\t", "a", "x" * 5000, prose(20_000), "Ünïcödé 日本 😀 <|endoftext|> a&b", prose(60), prose(60), "\x00 \x1c", "l1\nl1\nl1\n\n"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd text, null id and source, repeated rows and columns that clash with outputs."""
    rows = [(i, t, "en", "s0" if i % 2 else None, 7, "c") for i, t in enumerate(ODD)]
    rows += [rows[7], rows[7], (None, "some text", None, "s1", 7, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, kept string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
