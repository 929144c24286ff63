"""Folders with archives in archives."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from abacusflow.sources import folders


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_", "."), data)
    return out.getvalue()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("buzon")
    inner = packed(c_pdf=b"same", d_pdf=b"other")
    for name, data in {
        "a.pdf": b"same",
        "sub/b.PDF": b"bee",
        "sub/more/deep/x.pdf": b"deep",
        "sub/all.zip": packed(dir__e_pdf=b"same", f_txt=b"text", inner_zip=inner),
        "sub/broken.zip": b"this is no archive",
        "Banco Galicia 2024/Ganancias 2024.xlsx": b"1",
        "Banco Galicia 2024/~$Ganancias 2024.xlsx": b"2",
        "ganancias control.xlsx": b"3",
        "Otros/libro.xlsm": b"4",
        "Otros/resumen VISA.pdf": b"5",
        "Otros/Tenencias.pdf": b"6",
    }.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    return str(top)


def test_walk_to_a_depth_reads_no_contents(spark, tree):
    found = {r["relative"]: (r["name"], r["extension"], r["level"], r["size"]) for r in folders.walk(spark, tree, 3).collect()}
    assert found["sub/b.PDF"] == ("b.PDF", ".pdf", 2, 3) and found["a.pdf"] == ("a.pdf", ".pdf", 1, 4)
    assert "sub/more/deep/x.pdf" not in found and len(found) == 10
    assert {r["relative"] for r in folders.walk(spark, tree, 9, "*.pdf").collect()} == {"a.pdf", "sub/more/deep/x.pdf", "Otros/resumen VISA.pdf", "Otros/Tenencias.pdf"}
    plan = folders.walk(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_archives_and_repeats(spark, tree):
    files = folders.opened(folders.walk(spark, tree, 9, "*", content=True).where("extension in ('.pdf', '.zip')"), (".pdf",)).cache()
    told = {(r["relative"], r["member"]): (r["name"], r["content"] and bytes(r["content"]), r["problem"] is not None) for r in files.collect()}
    assert told[("sub/all.zip", "dir/e.pdf")] == ("e.pdf", b"same", False)
    assert told[("sub/all.zip", "inner.zip::c.pdf")] == ("c.pdf", b"same", False)
    assert told[("sub/broken.zip", None)] == ("broken.zip", None, True)
    assert ("sub/all.zip", "f.txt") not in told and len(told) == 5 + 3 + 1
    same = [r for r in folders.repeats(files).collect() if r["sha1"] == "d0941e68da8f38151ff86a61fc59f7c5cf9fcaa2" or True]
    groups = {}
    for r in same:
        groups.setdefault(r["sha1"], []).append((r["first"], r["path"].rsplit("/", 1)[-1], r["member"]))
    repeated = next(g for g in groups.values() if len(g) > 1)
    assert sorted(repeated, key=str) == sorted([(True, "a.pdf", None), (False, "all.zip", "dir/e.pdf"), (False, "all.zip", "inner.zip::c.pdf")], key=str)
    assert all(sum(first for first, *_ in g) == 1 for g in groups.values())
    flat = folders.opened(folders.walk(spark, tree, 9, "all.zip", content=True), deeper=0)
    assert {r["member"] for r in flat.collect()} == {"dir/e.pdf", "f.txt", "inner.zip"}


def test_likeliest_files(spark, tree):
    found = {r["relative"]: (r["kind"], r["suggested"]) for r in folders.suggested(folders.walk(spark, tree), 2024).collect()}
    assert found == {
        "a.pdf": ("extracto", True),
        "sub/b.PDF": ("extracto", True),
        "sub/more/deep/x.pdf": ("extracto", True),
        "Otros/resumen VISA.pdf": ("extracto", False),
        "Banco Galicia 2024/Ganancias 2024.xlsx": ("libro", True),
        "Otros/libro.xlsm": ("libro", False),
    }
    scores = {r["relative"]: r["score"] for r in folders.suggested(folders.walk(spark, tree), 2024).where("kind = 'libro'").collect()}
    assert scores["Banco Galicia 2024/Ganancias 2024.xlsx"] - scores["Otros/libro.xlsm"] == 80
    none = folders.suggested(folders.walk(spark, tree, 9, "*.pdf"))
    assert none.where(F.col("kind") == "libro").count() == 0 and none.count() == 4 - 1
