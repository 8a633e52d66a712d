import pytest

LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(60))


@pytest.fixture(scope="session")
def messy(spark):
    """Null, empty, very long, repeated, tied and odd rows, with extra columns that operators use inside."""
    texts = [
        (1, None), (2, ""), (3, "   \t\n"), (4, LONG), (5, LONG), (6, BASE), (7, BASE.upper()), (8, BASE + " tail"), (8, BASE + " tail"), (9, "one"), (10, "One"),
        (11, "naïve CAFÉ ÉTÉ été 日本語 🎉"), (12, "<|endoftext|> a <|endoftext|>"), (None, "no id"), (None, None), (13, "x" * 5000), (14, "É"), (15, "é"),
    ]
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None, k, k, "v", b"s", k, "t", True) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint, value bigint, row string, sig binary, rep_id bigint, shard string, kept boolean")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")
