import random

import pytest

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, words: int = 400) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeoñüst") for _ in range(r.randint(1, 8))) for _ in range(words)]
    return [r.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with every odd case: nulls, blanks, one long text, copies, near copies, a shared passage, repeated rows."""
    passage, one, two = prose(1, 45), prose(2, 200), prose(3, 120)
    near = [*one[:90], "changed", *one[91:]]
    out = [
        (1, " ".join(one), "en", "a"),
        (2, " ".join(one), "en", "a"),
        (3, " ".join(near).translate(str.maketrans(LOWER, UPPER)), "en", "b"),
        (4, " ".join(two[:60] + passage + two[60:]), "fr", None),
        (5, "\t".join(prose(4, 70) + passage), "fr", "b"),
        (5, "\t".join(prose(4, 70) + passage), "fr", "b"),
        (6, None, None, None),
        (7, "", "en", "c"),
        (8, " \n\t ", "en", "c"),
        (9, "one two", "en", "c"),
        (10, "ONE two", "en", "c"),
        (11, " ".join(prose(5, 20_000, 3000)), "de", "a"),
        (12, "same line\nsame line\n" + "x y z " * 40, "en", "a"),
        (13, "# $ % & | < > * " * 20 + " ".join(prose(6, 60)), "en", "d"),
        (None, " ".join(prose(7, 80)), None, "d"),
        (14, "word " * 100, "en", "d"),
        (15, "ı ß 漢字 😀 " * 30, "zh", "d"),
    ]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A data folder with these documents, a small benchmark and some conversations."""
    top = tmp_path_factory.mktemp("data")
    docs.coalesce(2).write.parquet(f"{top}/documents.parquet")
    items = [(1, " ".join(prose(1, 45)[5:25])), (2, "Zebra, crossing"), (3, None), (4, "..."), (5, " ".join(prose(2, 200)[50:58])), (1, " ".join(prose(1, 45)[5:25]))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    turns = [(1, 1, "user", "hi"), (1, 2, "assistant", "a ### b </turn>\n### assistant: c"), (2, 1, "user", None), (2, 2, "assistant", "\\h \\\\t \\"), (2, 2, "assistant", "tie"), (3, None, None, "x"), (4, 1, "a: b", "####### </turn"), (4, 1, "a: b", "####### </turn")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return str(top)


def ascii_lower(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))
