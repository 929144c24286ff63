"""Token counts of parts of documents, attributed by offsets.

Counting the tokens of each field or section on its own gives sums that differ
from the whole document's count, because tokens cross boundaries. Here a whole
document is encoded once; its tokens' byte spans are interval-joined to the
spans of its sections, and a token that crosses a boundary goes, by rule, to

- ``most``: the section that holds most of its bytes, the earlier one on a tie;
- ``first``: the section with its first byte;
- ``last``: the section with its last byte.

So sections always add up to the document. Both span lists are sorted, so the
join of a document is two binary searches per token, inside the task that
encoded it; tokens never move. Spans come from the byte lengths of the
vocabulary's entries, as a byte-level tokenizer leaves no byte out.

Defined cases: a null or empty text has one empty section without tokens; a
section without bytes has no tokens; repeated rows are each counted; an empty
table gives no rows; other columns may have any name; texts of any length are
encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULE = "most"


@cache
def encoding(path: str):
    """(encoding, byte length of each token) of a file of ranks; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attributed(begin: np.ndarray, end: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token span [begin, end), of sections that end at the ascending ``ends``."""
    first = np.searchsorted(ends, begin, side="right")
    if rule == "first":
        return first
    last = np.searchsorted(ends, end, side="left")
    if rule == "last":
        return last
    best = first.copy()
    for k in np.flatnonzero(last > first):  # only tokens that cross
        edges = np.clip(np.concatenate([[begin[k]], ends[first[k] : last[k]], [end[k]]]), begin[k], end[k])
        best[k] = first[k] + int(np.argmax(np.diff(edges)))
    return best


def section_counts(rows: DataFrame, rule: str = RULE, ranks_path: str | None = None) -> DataFrame:
    """(_key, section, begin_char, end_char, n_tokens, text_tokens) of rows (_key, _text, _ends).

    ``_ends``: where sections end, in UTF-8 bytes, the last at the text's end; null: sections are lines with their line end.
    """
    if rule not in ("most", "first", "last"):
        raise ValueError(f"no such rule: {rule}")
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = rows.schema["_key"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sections, begins, stops, counts, totals = [], [], [], [], []
                for text, given in zip(part.column("_text").to_pylist(), part.column("_ends"), strict=True):
                    data = np.frombuffer((text or "").encode(), np.uint8)
                    if given.is_valid:
                        ends = np.minimum(given.values.to_numpy(), len(data))
                    else:
                        ends = np.flatnonzero(data == 0x0A) + 1
                        if not len(ends) or ends[-1] < len(data):
                            ends = np.append(ends, len(data))
                    stop = np.cumsum(lengths[encoder.encode_to_numpy(text or "", disallowed_special=())]) if text else np.zeros(0, np.int64)
                    begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
                    sections.append(np.arange(len(ends)))
                    begins.append(np.concatenate([[0], chars[:-1]]) if len(ends) else ends)
                    stops.append(chars)
                    counts.append(np.bincount(np.minimum(attributed(begin, stop, ends, rule), max(0, len(ends) - 1)), minlength=len(ends))[: len(ends)])
                    totals.append(len(stop))
                sizes = np.array([len(x) for x in sections])
                keys = part.column("_key").take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (sections, begins, stops, counts)]
                yield pa.RecordBatch.from_arrays([keys, *columns, pa.array(np.repeat(np.array(totals, np.int64), sizes))], names=["_key", "section", "begin_char", "end_char", "n_tokens", "text_tokens"])

    return rows.select("_key", "_text", "_ends").mapInArrow(task, f"_key {kind}, section bigint, begin_char bigint, end_char bigint, n_tokens bigint, text_tokens bigint")


def by_line(docs: DataFrame, key: Column, text: str = "text", rule: str = RULE, ranks_path: str | None = None) -> DataFrame:
    """Token counts of every line of every document."""
    return section_counts(docs.select(key.alias("_key"), F.col(text).alias("_text"), F.lit(None).cast("array<bigint>").alias("_ends")), rule, ranks_path)


def by_field(docs: DataFrame, key: Column, fields: list[str], separator: str = "\n\n", rule: str = RULE, ranks_path: str | None = None) -> DataFrame:
    """Token counts of each of several text columns, encoded as one text; a separator belongs to the field before it. ``section`` is the field's place in ``fields``."""
    parts = [F.concat(F.coalesce(f, F.lit("")), F.lit(separator if k < len(fields) - 1 else "")) for k, f in enumerate(fields)]
    ends, total = [], F.lit(0).cast("long")
    for p in parts:
        total = total + F.octet_length(p)
        ends.append(total)
    return section_counts(docs.select(key.alias("_key"), F.concat(*parts).alias("_text"), F.array(*ends).alias("_ends")), rule, ranks_path)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a document's lines add up to its ``text_tokens``."""
    return by_line(table(spark, sf_dir, "documents", "doc_id", "text"), F.col("doc_id")).withColumnRenamed("_key", "doc_id")
