"""Token ids in fixed-width packed blocks.

Every id takes the fewest bits that hold the vocabulary (16 for 49,408 ids). A
file is a Parquet part written by Spark; its rows are blocks of whole documents
in key order, each with the packed ids, the ids before it in its part, its least
and greatest key and the lengths of its documents, so a reader can skip to any
block, and unpack one with a few numpy operations. A small index (a row per
part) gives the ids before each part. Parts come from a range partitioning by
key, so ids run in key order across parts. ``read_ids`` and ``read_keys`` read
single places and documents; the bounds of blocks prune the scan.

Every text is encoded whole, once, before the sort; what moves is packed ids.
Composing (NFC) is left out for a text that is composed. The library merges a
text as one sequence instead of a piece for each word: the suffix that marks a
word's last byte in the vocabulary is a character of its own in ``unsplit_at``, no
merge goes on from a last byte, so none reaches into the next word, and the ids
are those of the file. Texts with a special token, and files of other steps, take
the tokenizer as it is.

Defined cases: a null or empty text has just the end id; repeated rows are
written one by one (ties by their ids); a null key sorts first; an empty table
gives no blocks; a document of any length is one entry of one block; the key and
text columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, run_folder, table

VOCABULARY = 49_408
END_ID = 2
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
#: Documents that the tokenizer is given at once, and characters after which it is given fewer.
SLICE = 128
SLICE_CHARS = 1 << 20

#: The steps before the merges for which fewer do. No piece holds white space, so runs of it need not become one blank.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same pieces as by that pattern: only an apostrophe can begin two of its alternatives, and these keep their order.
LETTERS_FIRST = r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\p{L}\p{N}]+"
#: ASCII bytes that the byte level maps to others, white space aside.
UNPRINTABLE = re.compile(r"[^\t\n\r\x20-\x7e]")
#: Up to here all is composed, and Python's lower case is the library's.
BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
#: A spelled text of over LONG characters is given with a blank behind the first whole word after every 4,096, which keeps the queue of its merges short.
LONG = 1 << 16
STRETCH = re.compile("(?s).{4096}[\x00-\xff]*[\u0100-\u01ff]")
SUFFIX = "</w>"
#: What a model says besides its vocabulary and merges.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": SUFFIX, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: The byte level's bytes that stand for themselves; the others are the characters from 256 on.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*PLAIN}))}
#: The kinds of characters that the split knows.
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids (unsigned, each below 2**width) as one little-endian bit string."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from place ``first`` on; only the bytes that hold them are touched."""
    if width == 16:
        return np.frombuffer(data, "<u2", count, 2 * first).astype(np.uint32)
    low, high = first * width // 8, -(-(first + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, high - low, low), bitorder="little")
    skip = first * width - low * 8
    bits = bits[skip : skip + count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


@cache
def said_by(path: str) -> dict:
    with open(path, "rb") as file:
        return json.load(file)


@cache
def tokenizer_at(path: str, steps: str = "all"):
    """The tokenizer of a file, or the fewer steps before its merges alone; one for each Python worker, tasks that follow each other share it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    if steps == "all":
        return Tokenizer.from_file(path)
    light = Tokenizer(BPE())
    light.normalizer = Lowercase()
    light.pre_tokenizer = Split(Regex(LETTERS_FIRST), "removed", invert=True)
    return light


@cache
def unsplit_at(path: str):
    """The merges of a file for ``respelled`` texts, which need no split; None if its steps or merges are of another kind."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    said, model = said_by(path), said_by(path)["model"]
    if (said["normalizer"], said["pre_tokenizer"]) != (NORMALIZER, PRE_TOKENIZER) or any(t["normalized"] for t in said["added_tokens"]):
        return None
    if {k: v for k, v in model.items() if k not in ("vocab", "merges")} != MODEL:
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    spelled = {}
    for token in model["vocab"]:
        own = token.removesuffix(SUFFIX)
        if not own or not BYTES.keys() >= set(own):
            return None
        units = [BYTES[c] for c in own]
        units[-1] += 256 * (len(own) < len(token))
        spelled[token] = "".join(map(chr, units))
    if any(a.endswith(SUFFIX) for a, _ in merges):
        return None
    return Tokenizer(BPE({spelled[t]: i for t, i in model["vocab"].items()}, [(spelled[a], spelled[b]) for a, b in merges]))


@cache
def stretches_at(path: str):
    """``unsplit_at`` for long texts: merges stay within the stretches between blanks."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    stretches = Tokenizer(unsplit_at(path).model)
    stretches.pre_tokenizer = CharDelimiterSplit(" ")
    return stretches


def steps_for(text: str) -> str:
    """Which steps a text needs: ``printable`` ones have nothing to compose nor bytes to map, ``composed`` ones nothing to compose."""
    if text.isascii():
        return "composed" if UNPRINTABLE.search(text) else "printable"
    return "composed" if unicodedata.is_normalized("NFC", text) else "all"


def normalized(text: str, path: str) -> str:
    """A text after the file's normalizer, its white space aside."""
    if not BEYOND_LATIN.search(text):
        return text.lower()
    return tokenizer_at(path, "all" if steps_for(text) == "all" else "printable").normalizer.normalize_str(text)


@cache
def kind_table(path: str) -> np.ndarray:
    """A kind for each code point, unknown until one is met."""
    return np.full(0x110000, UNKNOWN, np.uint8)


def kinds_of(points: np.ndarray, path: str) -> np.ndarray:
    """The kinds of code points, each asked of the library's own split once."""
    table = kind_table(path)
    kinds = table[points]
    if (kinds == UNKNOWN).any():
        for c in np.unique(points[kinds == UNKNOWN]).tolist():
            pieces = [p for p, _ in tokenizer_at(path, "printable").pre_tokenizer.pre_tokenize_str("a" + 2 * chr(c))]
            table[c] = {1: SPACE if pieces == ["a"] else LETTER, 2: OTHER, 3: NUMBER}[len(pieces)]
        kinds = table[points]
    return kinds


def respelled(texts: list[str], path: str) -> list[str]:
    """Each text's UTF-8 bytes as characters, without white space, 256 more for the last byte of a piece."""
    joined = "\n" + "\n".join(texts) + "\n\n\n"  # every apostrophe has one character before it and two behind
    units = np.frombuffer(joined.encode("utf-8"), np.uint8)
    points = units if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = kinds_of(points, path)
    ends = kinds == NUMBER
    ends[:-1] |= kinds[1:] != kinds[:-1]
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[kinds[quotes - 1] != OTHER]  # one inside a run of marks begins nothing
    a, b = points[quotes + 1], points[quotes + 2]
    short = quotes[np.isin(a, [ord(c) for c in "stmd"])]
    long = quotes[(np.isin(a, [ord(c) for c in "rv"]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
    ends[short], ends[long] = False, False
    ends[short + 1], ends[long + 2] = True, True
    kept = kinds != SPACE
    units = units.astype("<u2")
    if points.dtype == np.uint8:
        units[ends] += 256
        places, units = np.cumsum(kept), units[kept]
    else:
        widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        units[np.cumsum(widths)[ends] - 1] += 256
        places, units = np.cumsum(widths * kept), units[np.repeat(kept, widths)]
    spelled = units.tobytes().decode("utf-16-le")
    stops = places[np.cumsum([len(t) + 1 for t in texts])].tolist()  # up to the blank behind each text
    return [spelled[start:stop] for start, stop in zip([0, *stops], stops, strict=False)]


def ids_of(texts: list[str | None], tokenizer_path: str) -> list[list[int]]:
    """The ids of whole texts, without an end id."""
    unsplit = unsplit_at(tokenizer_path)
    special = [t["content"] for t in said_by(tokenizer_path)["added_tokens"]]
    found: list[list[int]] = [[] for _ in texts]

    def encode(tokenizer, places: list[int], own: list[str]) -> None:
        for k, e in zip(places, tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
            found[k] = e.ids

    light: list[int] = []
    as_is: list[int] = []
    chars = 0
    for k, t in enumerate(texts):
        (as_is if unsplit is None or any(x in (t or "") for x in special) else light).append(k)
        chars += len(t or "")
        if k == len(texts) - 1 or chars >= SLICE_CHARS:
            plain = {j: normalized(texts[j] or "", tokenizer_path) for j in light}
            for own in ([j for j, x in plain.items() if x.isascii()], [j for j, x in plain.items() if not x.isascii()]):
                if own:
                    spelled = dict(zip(own, respelled([plain[j] for j in own], tokenizer_path), strict=True))
                    long = [j for j in own if len(spelled[j]) > LONG]
                    if long:
                        encode(stretches_at(tokenizer_path), long, [STRETCH.sub(r"\g<0> ", spelled.pop(j)) for j in long])
                    encode(unsplit, list(spelled), list(spelled.values()))
            if as_is:
                encode(tokenizer_at(tokenizer_path), as_is, [texts[j] or "" for j in as_is])
            light, as_is, chars = [], [], 0
    return found


def encoded(docs: DataFrame, key: str, text: str, tokenizer_path: str, vocabulary: int = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(_key, _n long, _packed binary): each document's ids with the end id, packed."""
    width = width_of(vocabulary)
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = source.select("_key").withColumns({"_n": F.lit(0).cast("long"), "_packed": F.lit(b"")}).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = ids_of(part.column("_text").to_pylist(), tokenizer_path)
                packed = [pack(np.frombuffer(array("I", [*x, end_id]), np.uintc), width) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array([len(x) + 1 for x in found], pa.int64()), pa.array(packed, pa.binary())], names=["_key", "_n", "_packed"])

    return source.mapInArrow(task, schema)


def write_blocks(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, vocabulary: int = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write blocks to ``folder``/blocks and the index of parts to ``folder``/index.

    A block: part, block (its number there), first (ids before it in the part),
    ids (how many), width, low and high (least and greatest key), keys, lengths
    and packed.
    """
    width = width_of(vocabulary)
    spark = docs.sparkSession
    rows = cut(encoded(docs, key, text, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), vocabulary, end_id))
    order = [F.col("_key").asc_nulls_first(), F.col("_n"), F.crc32("_packed")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"part int, block int, first bigint, ids bigint, width int, low {kind}, high {kind}, keys array<{kind}>, lengths array<bigint>, packed binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state = {"block": 0, "first": 0}

        def closed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths = rows["_n"].to_numpy()
            pieces = rows["_packed"].to_pylist()
            packed = b"".join(pieces) if width % 8 == 0 else pack(np.concatenate([unpack(p, width, n) for p, n in zip(pieces, lengths.tolist(), strict=True)]), width)
            ids = int(lengths.sum())
            keys = rows["_key"].to_pylist()
            out = {"part": rows["_part"][0].as_py(), "block": state["block"], "first": state["first"], "ids": ids, "width": width, "low": keys[0], "high": keys[-1], "keys": keys, "lengths": lengths.tolist(), "packed": packed}
            state["block"] += 1
            state["first"] += ids
            held.clear()
            return pa.RecordBatch.from_pylist([out], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("ids", pa.int64()), ("width", pa.int32()), ("low", key_type), ("high", key_type), ("keys", pa.list_(key_type)), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary())])
        n = 0
        for batch in batches:
            start = 0
            lengths = batch.column("_n").to_numpy()
            for k in range(batch.num_rows):
                n += int(lengths[k])
                if n >= block_ids:
                    held.append(batch.slice(start, k + 1 - start))
                    yield closed()
                    start, n = k + 1, 0
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield closed()

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(rows.schema["_key"].dataType)
    dealt.mapInArrow(task, schema).write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("ids").alias("ids"))  # a row per part
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("before"), "ids").write.parquet(f"{folder}/index")


def read_documents(spark: SparkSession, folder: str, digest: bool = False, where: Column | None = None) -> DataFrame:
    """(key, start, n_tokens, ids or ids_crc32) from the files alone; ``where``: which blocks."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    blocks = (blocks if where is None else blocks.where(where)).join(F.broadcast(spark.read.parquet(f"{folder}/index").select("part", "before")), "part")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    last = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lengths = row.column("lengths").combine_chunks() if isinstance(row.column("lengths"), pa.ChunkedArray) else row.column("lengths")
                lengths = lengths.flatten().to_numpy()
                ends = np.cumsum(lengths)
                data = row.column("packed")[0].as_py()
                ids = unpack(data, row.column("width")[0].as_py(), int(row.column("ids")[0].as_py()))
                start = row.column("before")[0].as_py() + row.column("first")[0].as_py() + ends - lengths
                bounds = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                view = memoryview(ids.astype("<u4").tobytes())
                values = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in bounds], pa.int64()) if digest else pa.array([ids[a:b].tolist() for a, b in bounds], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([row.column("keys").flatten(), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), values], names=["key", "start", "n_tokens", last.split()[0]])

    return blocks.mapInArrow(task, f"key {kind}, start bigint, n_tokens bigint, {last}")


def read_ids(spark: SparkSession, folder: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of the whole corpus on, fewer at its end. Only the blocks that hold them are read."""
    stop = start + count
    parts = [r for r in spark.read.parquet(f"{folder}/index").where((F.col("before") < stop) & (F.col("before") + F.col("ids") > start)).orderBy("before").collect()]
    pieces = [np.zeros(0, np.uint32)]
    for part in parts:
        low, high = max(0, start - part["before"]), min(part["ids"], stop - part["before"])
        own = spark.read.parquet(f"{folder}/blocks").where((F.col("part") == part["part"]) & (F.col("first") < high) & (F.col("first") + F.col("ids") > low))
        for block in own.orderBy("first").select("first", "ids", "width", "packed").collect():
            a, b = max(0, low - block["first"]), min(block["ids"], high - block["first"])
            pieces.append(unpack(block["packed"], block["width"], b - a, a))
    return np.concatenate(pieces)


def read_keys(spark: SparkSession, folder: str, keys: list) -> DataFrame:
    """(key, start, n_tokens, ids) of the documents with these keys (not null); blocks that cannot hold one are skipped by their bounds."""
    inside = F.lit(False)
    for k in keys:
        inside = inside | ((F.col("low").isNull() | (F.col("low") <= k)) & (F.col("high") >= k))
    return read_documents(spark, folder, where=inside).where(F.col("key").isin(keys))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document, and say from the files where its ids stand."""
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    write_blocks(table(spark, sf_dir, "documents", "doc_id", "text"), folder)
    return read_documents(spark, folder, digest=True).withColumnRenamed("key", "doc_id")
