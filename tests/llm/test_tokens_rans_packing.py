"""op8 and op10: the tokenizers' own ids, round trips through the files, windows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import documents, long_text
from tickforge.llm import packing, rans, tokens as tokens_module
from tickforge.llm.common import fresh_path
from tickforge.llm.queries import queries
from tickforge.llm.tokens import Memo, PackedMemo, TextTokens, even_parts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ROWS = [(4, "b"), (2, "Hello, world."), (2, "Hello, world."), (None, "no id"), (7, None), (9, ""), (11, long_text(1, 30_000)), (3, "İ 日本 <|endoftext|>"), (12, "a<|endoftext|>b <|startoftext|>")]


def own_ids(path, texts, end):
    """By an untouched tokenizer."""
    tokenizer = Tokenizer.from_file(path)
    return [e.ids + [end] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_the_whole_text(path, spark, sf_dir):
    draw = random.Random(3)
    signs = [*" \n\t.,'sa tESTdLl²\x1c\xa0éİ́J̌ 12!?ñß  日本<|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(30))) for _ in range(5000)]
    texts += ["".join(draw.choice("a b,") for _ in range(draw.randrange(12))) for _ in range(500)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    tokens = TextTokens(path)
    tokens.words, tokens.pieces = Memo(tokens.words.make, 500), Memo(tokens.pieces.make, 500)
    found = [np.frombuffer(x, tokens.dtype).tolist() + [0] for x in tokens.encode(texts)]
    assert found == own_ids(path, texts, 0)


def test_rans_round_trip_and_damage():
    draw = np.random.default_rng(1)
    for n in (1, 5, rans.LANES, rans.LANES * rans.CHECKPOINT_ROWS + 7, 700_000):
        ids = draw.zipf(1.3, n).clip(max=40_000).astype(np.uint16)
        table = rans.Table.of(np.bincount(ids))
        assert table.frequencies.sum() == 1 << rans.PRECISION and (table.frequencies[np.unique(ids)] > 0).all()
        words, states, places = rans.encode(ids, table)
        block = {
            "start": 0, "n_ids": n, "words": words.tobytes(), "states": states.tobytes(), "places": places.tolist(),
            "checksums": [rans.checksum(ids[a : a + k]) for a, k in rans.segments(n)],
        }
        assert (rans.decode_block(block, table) == ids).all()
        last, (at, k) = len(places) - 1, rans.segments(n)[-1]
        assert (rans.decode_segment(words, states[last], places[last], k, table) == ids[at:]).all()
    block["words"] = bytes(len(block["words"]))
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(block, table)
    assert len(words) * 4 < n * 2


def test_written_ids_come_back(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    ids = own_ids(BYTES, [r.text for r in rows], 0)
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    expected = {r.doc_id: (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(rows, starts, ids)}
    found = queries()["op8_rans"](spark, sf_dir).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected


def test_written_odd_rows(spark):
    for rows in (ROWS, []):
        path = fresh_path(spark, "rans")
        rans.write_ids(documents(spark, rows), path, BYTES)
        found = sorted(rans.read_ids(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
        expected = Counter((k, tuple(x)) for (k, _), x in zip(rows, own_ids(BYTES, [t or "" for _, t in rows], 0)))
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == expected
        assert [r.start for r in found] == np.cumsum([0, *(len(r.ids) // 4 for r in found)]).tolist()[:-1]


def check_pieces(pieces, texts, window):
    """Every id in one piece; windows without gaps, all but the last one full."""
    ids = dict(zip(texts, own_ids(WORDS, list(texts.values()), 2)))
    for r in pieces:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    covered = sorted((r.doc_id, r.start, r.length) for r in pieces)
    assert {k: sum(n for d, _, n in covered if d == k) for k in ids} == {k: len(x) for k, x in ids.items()}
    last = max(r.sequence_id for r in pieces)
    for k in range(last + 1):
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == k)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)]).tolist()[:-1]
        assert sum(n for _, n in own) == window or k == last


def test_packed_pieces(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_pieces(queries()["op10_packing"](spark, sf_dir).collect(), texts, 4096)


def test_packed_sequences_over_partition_borders(spark):
    texts = {i: long_text(i, 40 + i) for i in range(60)}
    docs = documents(spark, list(texts.items())).repartition(7)
    found = packing.sequences(packing.windows(docs, WORDS, window=64), window=64, pad_id=1).orderBy("sequence_id").collect()
    pieces = [p for r in found for p in r.pieces]
    ids = dict(zip(texts, own_ids(WORDS, list(texts.values()), 2)))
    for r in found:
        row = np.frombuffer(r.ids, "<u4").tolist()
        expected = [x for p in sorted(r.pieces, key=lambda p: p.offset) for x in ids[p.doc_id][p.start : p.start + p.length]]
        assert len(row) == 64 and row == expected + [1] * (64 - len(expected)) and r.n_ids == len(expected)
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert [r.n_ids for r in found[:-1]] == [64] * (len(found) - 1)


def test_packed_odd_rows(spark):
    found = packing.windows(documents(spark, ROWS), WORDS).selectExpr("inline(pieces)").collect()
    expected = Counter()
    for (k, _), x in zip(ROWS, own_ids(WORDS, [t or "" for _, t in ROWS], 2)):
        expected[k] += len(x)
    assert Counter({k: sum(r.length for r in found if r.doc_id == k) for k in expected}) == expected
    assert packing.sequences(packing.windows(documents(spark, []), WORDS)).count() == 0


def test_long_pieces_are_not_remembered():
    made = []
    memo = Memo(lambda key: made.append(key) or key.encode(), 500)
    for _ in range(3):
        assert memo["x" * 5000] == b"x" * 5000 and memo["word"] == b"word"
    assert made.count("word") == 1 and made.count("x" * 5000) == 3
    assert sum(map(len, [*memo, *memo.old])) == 4


def test_a_word_is_made_once_whatever_stands_around_it():
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    texts = ["x " + " ".join(w + sign + v for w, v in zip(words, words[k:])) for k, sign in enumerate([". ", ", ", "!! ", "\n", ".\n", " (", "12 ", ")-"])]
    tokens, made = TextTokens(BYTES), []
    make = tokens.pieces.make
    tokens.pieces.make = lambda piece: made.append(piece) or make(piece)
    found = [np.frombuffer(x, tokens.dtype).tolist() + [0] for _ in range(3) for x in tokens.encode(texts)]
    assert found == own_ids(BYTES, texts, 0) * 3
    assert len(made) <= 2 * len(words) + 20


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_where_kinds_of_characters_meet(path, monkeypatch):
    monkeypatch.setattr(tokens_module, "PART_BYTES", 2000)
    draw = random.Random(5)
    signs = ["don't", "'s", "'", "''ll", "é", "×", "a", "Zq", "ª", "12", "7", ".", "..", "(", "#'", "\n", "\n\n", " ", " ", " ", "<|", "word" * 30]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(1, 12))) for _ in range(4000)] + ["", " ", "\n", " a", "a\n", "\na"]
    tokens = TextTokens(path)
    tokens.pieces.size = 100
    assert [np.frombuffer(x, tokens.dtype).tolist() + [0] for x in tokens.encode(texts)] == own_ids(path, texts, 0)
    assert tokens.encode([]) == [] and tokens.encode([""]) == [b""]
    tokens.apart = False
    assert [np.frombuffer(x, tokens.dtype).tolist() + [0] for x in tokens.encode(texts)] == own_ids(path, texts, 0)


def test_packed_memo_keeps_what_was_used_last():
    made = []
    memo = PackedMemo(lambda key: made.append(key) or key * 2, 10)
    for k in range(30):
        keys = [b"often", b"%d" % k, b"x" * 5000, b"often"]
        assert memo.many(pa.array(keys, pa.large_binary())).to_pylist() == [key * 2 for key in keys]
        assert len(memo.keys) == len(memo.values) == len(memo.used) <= 10
    assert made.count(b"often") == 1 and made.count(b"x" * 5000) == 30 and len(made) == 61
    memo.forget()
    assert len(memo.many(pa.array([], pa.large_binary()))) == 0


def test_parts_of_batches_are_even(monkeypatch):
    monkeypatch.setattr(tokens_module, "PART_BYTES", 100)
    monkeypatch.setattr(tokens_module, "PART_ROWS", 20)
    texts = ["", "é" * 300, *["ab" * k for k in range(12)], *[""] * 50, "end"]
    batches = [pa.record_batch([pa.array(texts[a:b], pa.string()), pa.array(range(a, b), pa.int64())], ["text", "k"]) for a, b in ((0, 3), (3, 3), (3, 40), (40, len(texts)))]
    parts = list(even_parts(batches, 0))
    assert [k for p in parts for k in p.column(1).to_pylist()] == list(range(len(texts)))
    sizes = [[len(t.encode()) for t in p.column(0).to_pylist()] for p in parts]
    assert all(0 < len(x) <= 20 and sum(x[:-1]) < 100 for x in sizes)
    assert all(sum(x) >= 100 or len(x) == 20 for x in sizes[:-1])
    assert list(even_parts([], 0)) == []
