import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from posefarm.llm.store import prepared

    return prepared(spark)


LONG = " ".join(f"word{k % 977} and{k}" for k in range(12_000)) + ". The end of it!"
SHARED = "this passage of more than fifty bytes is shared by several documents of the table"
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen.", "en"),
    (2, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen.", "en"),
    (3, None, "en"), (4, "", None), (5, " \t\n ", "en"), (6, "short text", "en"),
    (7, "Mail bob.smith@mail.example.com or +1 (555) 555-1234, card 4539578763621486, host 10.20.30.40 now.", "en"),
    (8, "a@b@c.de x@y.z.@w.q 300.1.1.1 1.2.3.4.5.6.7.8 4539578763621487 12-34-56", "en"),
    (9, "spam ### $$$ spam ### $$$ spam ### $$$ spam ### $$$ spam ### $$$ spam ### $$$", "en"),
    (10, LONG, "en"), (11, LONG + " more", "en"),
    (12, SHARED + ". And then something else follows here.", "en"), (13, "Before it: " + SHARED, "en"), (13, "Before it: " + SHARED, "en"),
    (14, "é" * 40 + " ünïcödé 日本語 \u00a0 nbsp\u2003em \x1c odd", "fr"), (None, "A row without a name: " + SHARED, "en"), (None, None, None),
    (15, "aaaa " * 40, "en"), (16, "same line\nsame line\nsame line\nother line", "en"), (17, SHARED.upper(), "en"),
]


@pytest.fixture(scope="session")
def messy(llm):
    """Documents of every awkward kind, with columns named like the operators' own."""
    names = "n_words votes kept posterior id key part n label score start length spans item_id __id words h".split()
    rows = [(d, t, lang, f"src{k % 3}", len(t) if t is not None else None, *[k] * len(names)) for k, (d, t, lang) in enumerate(ROWS)]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def texts():
    return [(d, t) for d, t, _ in ROWS]
