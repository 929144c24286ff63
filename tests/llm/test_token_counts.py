import base64
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from abacusflow.llm import token_counts as T


def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(text, encoding):
    """Tokens per line: each token to the line with most of its bytes, the earlier on a tie."""
    data, counts, at = (text or "").encode(), defaultdict(int), 0
    line = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) == 10)])[:-1] if data else []
    tokens = encoding.encode_ordinary(text or "")
    for t in tokens:
        n = len(encoding.decode_single_token_bytes(t))
        lines, times = np.unique(line[at : at + n], return_counts=True)
        counts[int(lines[np.argmax(times)])] += 1
        at += n
    return counts, len(tokens)


def test_lines_equal_brute_force(spark, folder, rows):
    encoding = encoder()
    found = defaultdict(list)
    for r in T.op8_token_counts(spark, folder).collect():
        found[r["doc_id"]].append(r)
    for i, text, *_ in rows:
        counts, total = brute(text, encoding)
        own = found[i]
        assert {r["text_tokens"] for r in own} == {total}
        times = sum(x[0] == i for x in rows)
        assert sum(r["n_tokens"] for r in own) == total * times
        for r in own:
            assert r["n_tokens"] == counts.get(r["section"], 0)
        if text:
            assert max(r["end_char"] for r in own) == len(text)


def test_rules_on_crossing_tokens():
    begin, end, ends = np.array([0, 3, 5, 5]), np.array([3, 8, 6, 9]), np.array([4, 6, 9])
    assert T.attributed(begin, end, ends, "first").tolist() == [0, 0, 1, 1]
    assert T.attributed(begin, end, ends, "last").tolist() == [0, 2, 1, 2]
    assert T.attributed(begin, end, ends, "most").tolist() == [0, 1, 1, 2]


def test_fields_add_up(spark):
    rows = spark.createDataFrame([(1, "A title", "the body, two lines\n\nhere"), (2, None, "x"), (3, "", "")], "k int, title string, body string")
    encoding = encoder()
    found = T.by_field(rows, F.col("k"), ["title", "body"]).collect()
    total = defaultdict(int)
    for r in found:
        total[r["_key"]] += r["n_tokens"]
        assert r["text_tokens"] >= r["n_tokens"]
    assert total[1] == len(encoding.encode_ordinary("A title\n\nthe body, two lines\n\nhere"))
    assert total[2] == len(encoding.encode_ordinary("\n\nx")) and total[3] == len(encoding.encode_ordinary("\n\n"))


def test_odd_tables(empty):
    assert T.by_line(empty, F.col("doc_id")).count() == 0


def test_a_word_of_a_million_letters(spark):
    letters = "".join(chr(97 + k * k % 23) for k in range(1_000_000))
    found = T.by_line(spark.createDataFrame([(1, f"{letters}\nend")], "k int, text string"), F.col("k")).collect()
    counts, total = brute(f"{letters}\nend", encoder())
    assert {r["section"]: r["n_tokens"] for r in found} == counts and found[0]["text_tokens"] == total
