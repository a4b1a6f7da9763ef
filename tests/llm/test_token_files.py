from __future__ import annotations

import functools
import glob
import random
import zlib

import numpy as np
import pytest

from slimlake.llm import queries, token_files
from tests.llm import shared


def test_packing_gives_back_any_ids_and_any_range():
    draw = np.random.default_rng(0)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000, token_files.STEP + 3):
        for largest in (1, 2, 100, 5000, 50_257, 1 << 20, 1 << 33, 1 << 61, (1 << 64) - 1):
            ids = draw.integers(0, largest, n, dtype=np.uint64, endpoint=True)
            ids[n // 3 : n // 2] = 0
            ids[n // 2 : n // 2 + 9] = largest
            words, firsts, escapes = token_files.pack(ids)
            assert len(escapes) == (ids >= 1 << 60).sum() and len(firsts) == -(-n // token_files.BLOCK)
            assert (token_files.unpack(words, firsts, escapes, n) == ids).all()
            for _ in range(4):
                low, high = sorted(draw.integers(0, n + 1, 2).tolist())
                assert (token_files.unpack(words, firsts, escapes, n, low, high) == ids[low:high]).all()


def test_each_word_takes_as_many_ids_as_fit():
    """Against a plain loop over the same rule."""
    draw = random.Random(1)
    ids = [draw.choice([0, 1, draw.randrange(1 << draw.randrange(1, 63))]) for _ in range(3000)]
    want, at = [], 0
    while at < len(ids):
        stop = min(at - at % token_files.BLOCK + token_files.BLOCK, len(ids))
        for selector, (count, width) in list(enumerate(token_files.LANES))[1:]:
            # Spare lanes behind the block hold zeros.
            if all(x < 1 << width for x in ids[at : min(at + count, stop)]):
                break
        else:
            selector, count = 0, 1
        want.append(selector)
        at = min(at + count, stop)
    words, _, _ = token_files.pack(np.array(ids, dtype=np.uint64))
    assert (words >> np.uint64(60)).tolist() == want


def test_texts_cut_into_pieces_have_the_ids_of_the_whole():
    with open(token_files.TOKENIZER, encoding="utf-8") as file:
        encode = token_files.TextEncoder(file.read())
    assert encode.by_piece
    draw = random.Random(2)
    parts = [*" \n\t\r\x0b\x1c\x85 　ab1,.'é漢!śż​", "<|endoftext|>", "'s", " \n", "  ", "word", " Wort", " ", "😀"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(6000)]
    texts += [t or "" for _, t, _, _ in shared.odd_rows()]
    for k in range(0, len(texts), 500):
        for text, ids in zip(texts[k : k + 500], encode(texts[k : k + 500]), strict=True):
            assert np.array_equal(ids, encode.whole(text)), text


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.TOKENIZER)


def encoded(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def test_files_hold_all_documents_in_order(spark, place, monkeypatch):
    # Small chunks and files, so that tasks write several.
    monkeypatch.setattr(token_files, "CHUNKS_IN_FILE", 1)
    token_files.write_ids(shared.odd_documents(spark), f"{place}/ids")
    got = token_files.read_ids(spark, f"{place}/ids").orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert all(r.n_tokens == len(r.ids) for r in got)
    want = sorted(((i, encoded(t)) for i, t, _, _ in shared.odd_rows()), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == want
    sums = token_files.read_ids(spark, f"{place}/ids", "crc32").orderBy("start").collect()
    assert [r.crc32 for r in sums] == [zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in got]


def test_no_documents_no_rows(spark, place):
    token_files.write_ids(shared.no_documents(spark), f"{place}/ids")
    assert token_files.read_ids(spark, f"{place}/ids").count() == 0


def test_a_damaged_file_is_an_error(spark, place):
    token_files.write_ids(shared.odd_documents(spark).limit(3), f"{place}/ids")
    name = glob.glob(f"{place}/ids/part-*")[0]
    with open(name, "rb") as file:
        content = bytearray(file.read())
    content[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.chunks(bytes(content)))


def test_the_query_equals_plain_encoding(spark):
    documents = spark.read.parquet(f"{shared.SF}/documents.parquet").orderBy("doc_id").collect()
    want, start = [], 0
    for row in documents:
        ids = encoded(row.text)
        want.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = queries.op11_token_files(spark, shared.SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in got.collect()) == want
