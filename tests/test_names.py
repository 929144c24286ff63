"""List classification against plain scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from abacusflow.functions import similarity
from abacusflow.operators import names


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1]


def parts(a, b):
    """The best ratio of the shorter with every part of the longer, by trying them all."""
    if not a or not b:
        return 0.0
    out = 0.0
    for x, y in ((a, b), (b, a)) if len(a) == len(b) else [(min(a, b, key=len), max(a, b, key=len))]:
        m, n = len(x), len(y)
        windows = [y[k : k + m] for k in range(n)] + [y[:k] for k in range(1, m)]
        out = max(out, *(200.0 * common(x, w) / (m + len(w)) for w in windows))
    return out


def score(text, name, with_parts):
    if name in text or text in name:
        return 100.0
    return max(similarity.token_set(text, name), parts(text, name) if with_parts else 0.0)


def phrase(r, words, n):
    out = " ".join(r.choice(words) for _ in range(r.randint(1, n)))
    if out and r.random() < 0.5:  # a slip
        k = r.randrange(len(out))
        out = out[:k] + r.choice("ABC") + out[k + r.randrange(2) :]
    return " ".join(out.split())


WORDS = ["TORNILLO", "ACERO", "DE", "FLETE", "A", "PLANTA", "CAJA", "SERV", "MANT", "B2", "ARO"]


def test_partial_equals_all_parts():
    r = random.Random(1)
    for _ in range(600):
        a, b = phrase(r, WORDS, 4), phrase(r, WORDS, 3)
        wanted = parts(a, b)
        assert similarity.partial(a, b) == pytest.approx(wanted) and similarity.partial(b, a) == pytest.approx(wanted)
        floor = r.random() * 100
        assert similarity.partial(a, b, floor) == pytest.approx(wanted if wanted > floor else 0.0)


@pytest.mark.parametrize("with_parts", [True, False])
def test_best_of_block_skips_nothing(with_parts):
    r = random.Random(2)
    texts, listed = [phrase(r, WORDS, 5) for _ in range(60)], [phrase(r, WORDS, 3) for _ in range(40)]
    texts.append("AB AB AB AB")
    listed.append("ABCDEFGHIJKL")
    wanted = [max(score(t, n, with_parts) for n in listed) for t in texts]
    assert names.best_of_block(texts, listed, with_parts) == pytest.approx(wanted)


@pytest.mark.parametrize("blocks", [False, True])
def test_scores_of_lists_equal_all_pairs(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(names, "NAMES", 7)
        monkeypatch.setattr(names, "TEXTS", 11)
    r = random.Random(3)
    texts = sorted({phrase(r, WORDS, 5) for _ in range(70)})
    lists = sorted({(r.choice(["Mercadería", "Servicio", "Otro"]), phrase(r, WORDS, 3)) for _ in range(40)})
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    found = {(q["t"], q["kind"]): q["score"] for q in names.list_scores(rows, "t", spark.createDataFrame(lists, "kind string, name string")).collect()}
    assert len(found) == 3 * len(texts)
    for (t, kind), value in found.items():
        assert value == pytest.approx(max(score(t, n, True) for k, n in lists if k == kind)), (t, kind)


def test_full_scores_are_complete(spark):
    r = random.Random(4)
    texts, listed = sorted({phrase(r, WORDS, 6) for _ in range(80)}), sorted({phrase(r, WORDS, 2) for _ in range(40)} | {"A", "AC"})
    found = {(q["t"], q["name"]) for q in names.full_scores(spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in listed], "name string")).collect()}
    held = {(t, n) for t in texts for n in listed if (min(len(t), len(n)) >= 3 and (n in t or t in n)) or set(n.split()) <= set(t.split()) or set(t.split()) <= set(n.split())}
    assert found == held


def test_words_where_no_list_tells(spark):
    lists = spark.createDataFrame([("Mercadería", "tornillo de acero"), ("Servicio", "flete a planta")], "kind string, name string")
    rows = spark.createDataFrame([(1, "Flete planta"), (2, "acero tornillo [12]"), (3, "Honorários mensuales"), (4, "repuesto xx"), (5, "qqq"), (6, None), (7, "")], "k int, t string")
    found = {r["k"]: r["label"] for r in names.by_lists_or_words(rows, "t", lists).collect()}
    assert found == {1: "Servicio", 2: "Mercadería", 3: "Servicio", 4: "Mercadería", 5: "Sin clasificar", 6: "Sin clasificar", 7: "Sin clasificar"}
    pending = {r["k"]: r["label"] for r in names.by_lists(rows, "t", lists).collect()}
    assert pending[6] == pending[7] == "PENDIENTE" and pending[2] == "Mercadería"


def test_empty_lists_and_texts(spark):
    rows = spark.createDataFrame([(1, "x")], "k int, t string")
    none = spark.createDataFrame([], "kind string, name string")
    assert [r["label"] for r in names.by_lists(rows, "t", none).collect()] == ["PENDIENTE"]
    assert names.by_lists(rows.limit(0), "t", none).count() == 0
    assert rows.withColumn("x", F.lit(1)).count() == 1
