import json
import random
import time
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from abacusflow.llm import token_files as T


@pytest.mark.parametrize("width", [1, 5, 11, 16, 17, 20])
def test_packing_round_trip_and_random_access(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 997).astype(np.uint32)
    data = T.pack(ids, width)
    assert len(data) == -(-997 * width // 8)
    assert (T.unpack(data, width, 997) == ids).all()
    assert (T.unpack(data, width, 100, 333) == ids[333:433]).all()
    assert len(T.unpack(T.pack(ids[:0], width), width, 0)) == 0


def whole(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows]


def test_files_hold_what_the_tokenizer_says(spark, folder, rows):
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    found = sorted((tuple(r) for r in T.op7_token_files(spark, folder).collect()), key=lambda r: r[1])
    ids = sorted(((i is not None, i or 0), len(x), crc(x)) for (i, *_), x in zip(rows, whole(rows), strict=True))
    assert sorted(((r[0] is not None, r[0] or 0), r[2], r[3]) for r in found) == ids
    assert [(r[0] is not None, r[0] or 0) for r in found] == [k for k, *_ in ids]
    start = 0
    for r in found:
        assert r[1] == start
        start += r[2]


def test_ids_are_read_back(spark, docs, rows, tmp_path):
    T.write_blocks(docs, f"{tmp_path}/{uuid.uuid4().hex}")
    folder = f"{tmp_path}/files"
    T.write_blocks(docs.repartition(3), folder)
    got = sorted(tuple(r["ids"]) for r in T.read_documents(spark, folder).collect())
    assert got == sorted(map(tuple, whole(rows)))
    block = spark.read.parquet(f"{folder}/blocks").first()
    assert len(block["packed"]) == 2 * block["ids"]


def test_odd_tables(spark, empty, tmp_path):
    T.write_blocks(empty, f"{tmp_path}/none")
    assert T.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_special_strings_are_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    half = "a"
    for _ in range(10):  # a Thue-Morse word and its complement
        half += half.translate(str.maketrans("ab", "ba"))
    texts = ["Don't STOP\u00a0now\u2003it's 42nd", "e\u0301 n\u0303 \u0301x", "ΣΊΣΥΦΟΣ İstanbul", "a\x0bb\x0cc\x85d\u2028e", "...!!! ?? 100%", "\x00 \x1f", "😀👩‍👩‍👧 ﬁ", half, half.translate(str.maketrans("ab", "ba"))]
    for x, t in zip(T.ids_of(texts, path), texts, strict=True):
        assert x == tokenizer.encode(t, add_special_tokens=False).ids
    assert T.ids_of([None], path) == [[]]


@pytest.mark.parametrize("vocabulary", [49_408, 1 << 17])
def test_places_and_documents_are_read_alone(spark, docs, rows, tmp_path, vocabulary):
    T.write_blocks(docs, f"{tmp_path}/files", vocabulary=vocabulary, block_ids=700)
    assert spark.read.parquet(f"{tmp_path}/files/blocks").count() > 3
    assert {r["width"] for r in spark.read.parquet(f"{tmp_path}/files/blocks").select("width").collect()} == {T.width_of(vocabulary)}
    order = [r["ids"] for r in T.read_documents(spark, f"{tmp_path}/files").orderBy("start").collect()]
    everything = np.concatenate([np.array(x, np.uint32) for x in order])
    assert sorted(map(tuple, order)) == sorted(map(tuple, whole(rows)))
    for start, count in ((0, 5), (690, 2000), (len(everything) - 3, 10), (3, 0), (0, len(everything))):
        assert (T.read_ids(spark, f"{tmp_path}/files", start, count) == everything[start : start + count]).all()
    found = T.read_keys(spark, f"{tmp_path}/files", [11, 5, 999]).collect()
    wanted = [x for (i, *_), x in zip(rows, whole(rows), strict=True) if i in (5, 11)]
    assert sorted(r["ids"] for r in found) == sorted(wanted)
    assert all((everything[r["start"] : r["start"] + r["n_tokens"]] == r["ids"]).all() for r in found)


def test_key_may_have_any_name(spark, tmp_path):
    for k, name in enumerate(("_n", "_packed", "_part", "_key", "_text")):
        T.write_blocks(spark.createDataFrame([(1, "a b"), (2, None)], f"`{name}` long, text string"), f"{tmp_path}/{k}", key=name)
        assert [r["key"] for r in T.read_documents(spark, f"{tmp_path}/{k}").orderBy("start").collect()] == [1, 2]


def test_a_word_of_a_million_letters(spark, tmp_path):
    word = "".join(chr(97 + k * k % 23) for k in range(1_000_000))
    T.write_blocks(spark.createDataFrame([(1, word), (2, "end")], "doc_id long, text string"), f"{tmp_path}/files")
    order = [r["ids"] for r in T.read_documents(spark, f"{tmp_path}/files").orderBy("start").collect()]
    assert order == whole([(1, word), (2, "end")])


def test_steps_that_change_nothing_are_left_out():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = {
        "printable": ["", "It's I'LL 'sting !'s ''re a'b'd don't'", "a\tB\r\n\n c_1 22 ~`^", "<|startoftext|> x<|ENDOFTEXT|><|endoftext|>"],
        "composed": ["\x00a\x0bb\x0cc \x1c\x1f\x7f", "\u00c9t\u00e9 \u00e0'S\u00a0\x85 \u0130\u03a3 \u2028\u3000", "\u6f22\u5b57 \uac00 \u0661\u00b2\u216b \U0001f600\u0301 \ufb01", "e<|startoftext|>\u00e9"],
        "all": ["e\u0301 E\u0301", "\u212a \u2000a \u1fef", "\u1100\u1161"],
    }
    for steps, own in texts.items():
        for text, ids in zip(own, T.ids_of(own, path), strict=True):
            assert T.steps_for(text) == steps
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert T.tokenizer_at(path, "printable").normalizer.normalize_str("A  e\u0301") == "a  e\u0301"  # neither blanks nor marks are looked for
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    mixed = ["".join(points[at : at + 64]) for at in range(0, 0x30000, 64)] + [f"a{x}B'{x}s{x}{x} 1" for x in points[:0x3400]]
    assert T.ids_of(mixed, path) == [e.ids for e in tokenizer.encode_batch(mixed, add_special_tokens=False)]


def test_other_files_take_all_their_steps(tmp_path):
    said = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    said["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(said))
    texts = ["Some Capitals", "\u00c9t\u00e9"]
    tokenizer = Tokenizer.from_file(f"{tmp_path}/cased.json")
    assert T.ids_of(texts, f"{tmp_path}/cased.json") == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_text_is_merged_as_one_sequence():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    assert T.unsplit_at(path).pre_tokenizer is None
    assert T.respelled(["Th\u00e9 t", "", "'re''s 12!?"], path) == ["Th\u00c3\u01a9\u0174", "", "'r\u0165'\u0127\u0173\u0131\u0132!\u013f"]
    letters = ["'", "s", "t", "re", "ve", "l", "d", "M", "E", "e", " ", "\n", "7", "!", "\u00e9", "\u0301", "\u00a0", "\u85e4", "\U0001f600", "\u0130", "\x1c", "</w>", "<|"]
    r = random.Random(1)
    texts = ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(20_000)]
    texts[7], texts[300] = "it's<|startoftext|> A", "<|endoftext|>"
    assert T.ids_of(texts, path) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_slices_end_after_so_many_characters(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    sizes, inner = [], T.respelled
    monkeypatch.setattr(T, "SLICE_CHARS", 10)
    monkeypatch.setattr(T, "respelled", lambda texts, path: sizes.append(len(texts)) or inner(texts, path))
    texts = ["one", None, "two three", "a long, long text", "<|endoftext|> and more", "four", ""]
    assert T.ids_of(texts, path) == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes == [3, 1, 2]


def test_long_texts_are_merged_in_stretches(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdeo\u00e9stn'7") for _ in range(r.randint(1, 9))) for _ in range(30_000)), "x" * 70_000 + " end", "short", "a" * 70_000]
    sizes, inner = [], T.stretches_at
    monkeypatch.setattr(T, "stretches_at", lambda path: sizes.append(path) or inner(path))
    assert T.ids_of(texts, path) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes
    assert T.STRETCH.sub(r"\g<0> ", "a" * 4099 + "\u0161b\u0162") == "a" * 4099 + "\u0161 b\u0162"


def test_lower_case_of_latin_letters_is_the_library_s():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path).normalizer
    for c in range(0x250):
        text = f"A{chr(c)}A"
        assert T.normalized(text, path).split() == library.normalize_str(text).split()


def test_encoding_takes_half_the_time_of_the_file_as_it_is():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = T.tokenizer_at(path)
    r = random.Random(2)
    words = ["".join(r.choice("abcdeo\u00e9\u00f1stn") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(r.choices(words, k=500)) for _ in range(100)]
    assert T.ids_of(texts, path) == [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def seconds(encode):
        start = time.process_time()
        encode()
        return time.process_time() - start

    own = min(seconds(lambda: T.ids_of(texts, path)) for _ in range(3))
    assert own < 0.5 * min(seconds(lambda: tokenizer.encode_batch_fast(texts, add_special_tokens=False)) for _ in range(3))


@pytest.mark.parametrize("change", [{"end_of_word_suffix": None}, {"dropout": 0.0}, {"ignore_merges": True}])
def test_models_of_another_kind_are_taken_as_they_are(tmp_path, change):
    said = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    said["model"] |= change
    path = f"{tmp_path}/other.json"
    (tmp_path / "other.json").write_text(json.dumps(said))
    texts = ["It's the other 12 \u00e9t\u00e9s", ""]
    assert T.unsplit_at(path) is None
    assert T.ids_of(texts, path) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
