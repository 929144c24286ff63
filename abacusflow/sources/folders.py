"""Folders of files as tables: walked to a depth, with archives opened, repeats told and the likeliest files named.

A walk reads no contents: they are a column of the scan that is only read where it
is asked for. Archives are opened in the tasks that read them, member by member.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_words

MEMBER = "path string, relative string, member string, name string, extension string, size long, content binary, problem string"


def walk(spark: SparkSession, folder: str, depth: int = 6, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, relative, name, extension, level, size, modified), and ``content`` if asked, of all files at most ``depth`` levels below the folder whose names fit the pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    # a listed path may write its scheme with one slash or three
    bare = lambda c: F.regexp_replace(c, r"^([a-z0-9+.-]+):/+", "$1:/")
    relative = F.expr("substring(_at, length(_root) + 2)")
    out = files.withColumn("_at", bare(F.col("path"))).withColumn("_root", bare(F.lit(root))).withColumn("relative", relative)
    name = F.element_at(F.split("relative", "/"), -1)
    told = ["path", "relative", name.alias("name"), extension(name).alias("extension"), F.size(F.split("relative", "/")).alias("level"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else [])]
    return out.select(*told).where(F.col("level") <= depth)


def extension(name: Column) -> Column:
    """The last dot and what follows, lower case; "" without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def _members(data: bytes, inside: str, deeper: int) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name in the archive, content, problem) of every file in a zip archive and in archives in it."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        yield inside, None, str(e)
        return
    for info in archive.infolist():
        if info.is_dir():
            continue
        at = f"{inside}::{info.filename}" if inside else info.filename
        try:
            own = archive.read(info)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, zlib.error) as e:  # damaged, encrypted or packed by unknown means
            yield at, None, str(e)
            continue
        if at.lower().endswith(".zip") and deeper:
            yield from _members(own, at, deeper - 1)
        else:
            yield at, own, None


def opened(files: DataFrame, wanted: tuple[str, ...] = (), deeper: int = 2) -> DataFrame:
    """Files with content as they are, and zip archives as their members (``member``: the name within, "::" between archives), of the wanted extensions (all if none).

    What cannot be opened is a row with ``problem`` and no content. Members leave a
    task one by one, so it holds an archive and one member.
    """

    def row(path: str, relative: str, member: str | None, data: bytes | None, problem: str | None) -> pa.RecordBatch:
        name = PurePosixPath((member or relative).split("::")[-1]).name
        values = [path, relative, member, name, PurePosixPath(name).suffix.lower(), None if data is None else len(data), data, problem]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in MEMBER.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, relative, data = (batch.column(c)[k].as_py() for c in ("path", "relative", "content"))
                found = _members(data, "", deeper) if relative.lower().endswith(".zip") else [(None, data, None)]
                for member, content, problem in found:
                    one = row(path, relative, member or None, content, problem)
                    if problem or not wanted or one.column("extension")[0].as_py() in wanted:
                        yield one

    return files.select("path", "relative", "content").mapInArrow(task, MEMBER)


def repeats(files: DataFrame) -> DataFrame:
    """(path, member, sha1, first) of files with content: ``first`` is true for one of those with equal content, by path and member. Contents are hashed where they are and do not move."""
    slim = files.where("content is not null").select("path", "member", F.sha1("content").alias("sha1"))
    place = F.struct("path", F.coalesce("member", F.lit("")).alias("member"))
    firsts = slim.groupBy("sha1").agg(F.min(place).alias("_first"))
    return slim.join(firsts, "sha1").select("path", "member", "sha1", (place == F.col("_first")).alias("first"))


# What names of books and statements tell, folded; and what each is worth.
BOOKS, STATEMENTS = (".xlsx", ".xlsm"), (".pdf",)
NOT_BOOKS = ("CONTROL", "PRUEBA", "TRABAJO", "PLANTILLA", "TENENCIA", "TEMP", "TMP")
NOT_STATEMENTS = ("TENENCIA", "THUMBS")
UNLIKELY = ("TARJETA", "VISA", "MASTERCARD", "AMEX", "COMPRAS", "VENTAS", "FACTURA", "CONSTANCIA", "RECIBO", "DDJJ", "F731", "F931")
BANKS = ("BANCO", "GALICIA", "PROVINCIA", "BBVA", "SANTANDER")
WORTH = {"name": 40, "parents": 15, "bank": 10, "year in name": 20, "year in parents": 10}
NEAREST, SHALLOW = 4, 8


def suggested(files: DataFrame, year: int | None = None, words: tuple[str, ...] = ("GANANCIA",)) -> DataFrame:
    """Books and statements of a walk with ``kind`` ("libro" or "extracto"), ``score`` (of books) and ``suggested``: the one best book, and statements that are likely ones.

    A book scores by words in its name and in the nearest folders, by a bank's name
    and by the year, less a point for each level below the eighth. Of equal scores
    the first by name.
    """
    has = lambda text, told: F.coalesce(text.rlike("|".join(told)), F.lit(False))
    name = fold_words(F.col("name"))
    parts = F.split(F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/"), "/")
    above = F.filter(F.slice(F.reverse(parts), 2, NEAREST), lambda p: p != "")
    parents = fold_words(F.array_join(F.reverse(above), " "))
    points = lambda holds, n: F.when(holds, n).otherwise(0)
    score = points(has(name, words), WORTH["name"]) + points(has(parents, words), WORTH["parents"]) + points(has(parents, BANKS) | has(name, BANKS), WORTH["bank"])
    if year:
        score = score + points(name.contains(str(year)), WORTH["year in name"]) + points(parents.contains(str(year)), WORTH["year in parents"])
    score = score - F.greatest(F.lit(0), F.size(parts) - SHALLOW)
    is_book = F.col("extension").isin(*BOOKS) & ~has(name, NOT_BOOKS) & ~F.col("name").startswith("~$")
    is_statement = F.col("extension").isin(*STATEMENTS) & ~has(name, NOT_STATEMENTS)
    rows = files.withColumn("kind", F.when(is_book, "libro").when(is_statement, "extracto")).where("kind is not null").withColumn("score", F.when(F.col("kind") == "libro", score))
    order = F.struct((-F.col("score")).alias("s"), F.lower("relative").alias("r"), F.col("path"))
    best = rows.where("kind = 'libro'").agg(F.min(order).alias("_best"))  # one row
    likely = ~has(fold_words(F.col("relative")), UNLIKELY)
    return rows.join(F.broadcast(best), F.lit(True), "left").withColumn("suggested", F.when(F.col("kind") == "libro", order == F.col("_best")).otherwise(likely)).drop("_best")
