"""op12 against a plain alignment, and the perfect hash function alone."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import documents, long_text
from tickforge.llm import alignment
from tickforge.llm.perfect_hash import PerfectHash
from tickforge.llm.queries import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 31, n, replace=False).astype("<u4")
    found = PerfectHash.of(keys)
    assert sorted(found.index(keys)) == list(range(n))
    others = np.setdiff1d(np.arange(5000, dtype="<u4"), keys)
    assert (found.index(others) == -1).all()
    assert (PerfectHash(found.sizes, found.bits, found.keys).index(keys) == found.index(keys)).all()


def byte_level():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    return lambda piece: bytes(signs[c] for c in piece)


def plain(texts):
    """Per text: (n_a, n_b, groups, links) with links as pairs of ids."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    from_signs = byte_level()
    out = []
    for text in texts:
        whole = b" " + (text or "").encode()
        spans = []
        for ids, piece in (
            (a.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: from_signs(a.id_to_token(i))),
            (b.encode(text or ""), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
        ):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(piece(i))))
                at += len(piece(i))
            spans.append((side, b"".join(map(piece, ids))))
        (x, bytes_a), (y, bytes_b) = spans
        if not text or bytes_a != whole or bytes_b != whole:
            out.append((0, 0, [], []))
            continue
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups = [([i for i, _, e in x if lo < e <= hi], [i for i, _, e in y if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        links, j = [], 0
        for i, lo, hi in x:
            while y[j][2] <= lo:
                j += 1
            k = j
            while k < len(y) and y[k][1] < hi:
                links.append((i, y[k][0]))
                k += 1
        out.append((len(x), len(y), groups, links))
    return out


def expected_rows(keys, texts):
    found = plain(texts)
    counts = Counter(link for *_, links in found for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    rows = []
    for key, (n_a, n_b, groups, links) in zip(keys, found):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((key, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), shown))
    return rows, counts


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = [r for r in rows if len(r.text or "") < 30_000]  # the plain version takes groups times tokens
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("short_texts")
    counts = alignment.PairCounts(alignment.bundles(spark.table("short_texts"), A, B), A, B)
    expected, pairs = expected_rows([r.doc_id for r in rows], [r.text for r in rows])
    assert sorted(tuple(r) for r in alignment.aligned(counts).collect()) == sorted(expected)
    assert {(r.a_id, r.b_id): r.n for r in counts.pairs().collect()} == pairs


ODD = ["", None, " ", "a", "  two  spaces ", "<|endoftext|> and </s><s>", "▁ low line", "é 中文 \U0001f600", "tab\tnew\nline\r\n", "x" * 500, "a\x00b", "½ ① ﬁ", "same same same", "same same same"]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:  # a bundle per text and many levels of trees
        monkeypatch.setattr(alignment, "FAN_IN", 2)
    keys = [*range(len(ODD) - 1), None]
    docs = documents(spark, list(zip(keys, ODD)))
    bundles = alignment.bundles(docs, A, B, bundle_bytes=1 if small else alignment.BUNDLE_BYTES)
    found = alignment.aligned(alignment.PairCounts(bundles, A, B)).collect()
    expected, _ = expected_rows(keys, ODD)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_long_text_and_empty_table(spark):
    docs = documents(spark, [(1, long_text())])
    (row,) = alignment.aligned(alignment.PairCounts(alignment.bundles(docs, A, B), A, B)).collect()
    assert row.n_groups > 100_000 and row.n_links == row.n_a + row.n_b - row.n_groups
    empty = alignment.aligned(alignment.PairCounts(alignment.bundles(documents(spark, []), A, B), A, B))
    assert empty.count() == 0


def test_query_gives_digests(spark, sf_dir):
    found = {r.doc_id: r for r in queries()["op12_alignment"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert len(found) == docs.count()
    rows = alignment.aligned(alignment.PairCounts(alignment.bundles(docs, A, B), A, B)).collect()
    for r in rows:
        assert tuple(found[r.id])[:-1] == tuple(r)[:-1]
        assert found[r.id].groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
