import pytest

#: Columns whose names the operators use inside, to clash with theirs.
EXTRA = "shard string, score string, node string, token string, range string, size string, rank string, difference string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
PAGES = "page_id long, url string, html string, text string, n_chars string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _row(i, text):
    return (i, text, "en", "src0", 1, *["x"] * 8)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([_row(i, t) for i, t in zip(ids, texts, strict=True)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated, very long and unusual texts."""
    base = " ".join(WORDS * 3)
    return [
        None, "", " \n\t ", "one", "one two", base, base, base + " end", "\n".join([base, "", "short line", base + " x", "short line"]), "wörd ☃ " * 40,
        " ".join(f"w{i % 977}" for i in range(60_000)), "x" * 70_000, "<|endoftext|> 'S İΣ\x00\x1c end", base.upper(),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_texts):
    n = len(odd_texts)
    # A null id, and one row given twice.
    return make_docs([*odd_texts, "row without id and some words", odd_texts[8]], [*range(n), None, 8])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")

    return make
