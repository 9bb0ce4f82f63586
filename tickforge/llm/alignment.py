"""How the tokens of two tokenizers lie over the same texts, and how often which pair meets.

Both tokenizers cut a text, read as a space and the text, into spans of bytes. Where both end a
token the spans fall into groups; two tokens are linked if their spans overlap. A pair of ids
counts as many links as the whole corpus has of it.

1. Texts become ids in bundles of about BUNDLE_BYTES of text; a bundle gives its distinct pairs and their
   numbers, dealt into blocks by a hash of the pair.
2. The distinct pairs of a block are united in a tree and get a minimal perfect hash function, with
   the pairs by index, so that a strange pair is found out (see perfect_hash).
3. Dense vectors of counts, indexed by it, are added up: each group of bundles makes one per block,
   and these are summed in a tree.
4. Each bundle is sent the counts of its own pairs, is aligned once more and looks them up.

No task holds more than a bundle or a block: there are up to MOST_BLOCKS of these, which share out
at most all pairs of two vocabularies. Groups of bundles are chosen so large that all dense vectors
together are no larger than the counts they sum up, and nothing is broadcast but the largest count
per id of the second vocabulary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tickforge.llm.common import stored
from tickforge.llm.perfect_hash import PerfectHash, mixed
from tickforge.llm.tokens import BYTE_CHARACTERS, Memo, text_tokens

BUNDLE_BYTES = 1 << 20
FAN_IN = 32
MOST_BLOCKS = 4096
BLOCK_SEED = 0
REMEMBERED = 250_000
"""Words that each side remembers in each of two generations, some 200 bytes each."""


class ByteLevelSide:
    """Ids of a byte-level vocabulary; strings of special tokens in a text are plain text."""

    def __init__(self, path: str):
        self.tokens = text_tokens(path, special=False)
        self.tokens.pieces.size, self.tokens.words.size = REMEMBERED, REMEMBERED // 5
        bytes_of = {chr(sign): byte for byte, sign in BYTE_CHARACTERS.items()}
        rules = json.loads(self.tokens.tokenizer.to_str())
        added = {x["id"] for x in rules["added_tokens"]}
        vocabulary = rules["model"]["vocab"]
        self.pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for sign, id in vocabulary.items():
            self.pieces[id] = sign.encode() if id in added else bytes(bytes_of[c] for c in sign)
        self.lossless = rules["normalizer"] is None and vocabulary.keys() >= bytes_of.keys()

    def forget(self) -> None:
        self.tokens.words.forget()
        self.tokens.pieces.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.tokens.dtype) for x in self.tokens.encode([" " + t for t in texts])]


class PieceSide:
    """Ids of a sentencepiece model, which puts the space before the text itself.

    If no piece goes on over a space and the model changes nothing in a text, a text whose spaces
    stand alone between other characters has the ids of its words, which are remembered.
    """

    lossless = False  # U+2581 in a text becomes a space

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        signs = [self.model.id_to_piece(i) for i in ids]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, signs)]
        probe = " A  ﬁ①é\tx\n "
        by_words = all("▁" not in p.lstrip("▁") and not (p[:2] == "▁▁" and p.strip("▁")) for p in signs)
        self.by_words = by_words and self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.dtype = np.dtype("<u2" if len(signs) <= 1 << 16 else "<u4")
        self.words = Memo(lambda word: self._packed(self.model.encode(word)), REMEMBERED)

    def forget(self) -> None:
        self.words.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._words(t) for t in texts]
        new = self.words.new({word for words in cut for word in words or ()})
        self.words.learn(new, (self._packed(ids) for ids in self.model.encode(new, num_threads=1)))
        known = self.words.__getitem__
        whole = lambda text: self._packed(self.model.encode(text))
        return [np.frombuffer(whole(t) if words is None else b"".join(map(known, words)), self.dtype) for t, words in zip(texts, cut)]

    def _words(self, text: str) -> list[str] | None:
        alone = text and self.by_words and "  " not in text and text[0] != " " and text[-1] != " "
        return text.split(" ") if alone else None

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()


class Sides:
    """Both tokenizers of a worker, and the lengths of their tokens in bytes."""

    def __init__(self, a: str, b: str):
        self.a, self.b = (PieceSide(p) if p.endswith(".model") else ByteLevelSide(p) for p in (a, b))
        self.lengths_a, self.lengths_b = (np.fromiter(map(len, s.pieces), np.int64, len(s.pieces)) for s in (self.a, self.b))
        self.width = len(self.b.pieces)
        self.key = np.dtype("<u4" if len(self.a.pieces) * self.width <= 1 << 32 else "<u8")

    @cached_property
    def group_table(self) -> list[bytes]:
        """How each id is written within a group of its side and at its end; see Bundle.grouped."""
        a, b = range(len(self.a.pieces)), range(len(self.b.pieces))
        return [b"%d%s" % (i, end) for ids, ends in ((a, (b",", b"|")), (b, (b",", b";"))) for end in ends for i in ids]

    def forget(self) -> None:
        """Words are not remembered beyond the stage that cuts texts."""
        self.a.forget()
        self.b.forget()

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; none where the text is empty or one side's bytes are not the text's."""
        none = np.zeros(0, np.uint32)
        out = []
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            whole = b" " + text.encode()
            fits = text and all(side.lossless or _bytes(side.pieces, ids) == whole for side, ids in ((self.a, a), (self.b, b)))
            out.append((a, b) if fits else (none, none))
        return out


def _bytes(pieces: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(pieces.__getitem__, ids.tolist()))


_loaded: dict[tuple[str, str], Sides] = {}


def sides(a: str, b: str) -> Sides:
    if (a, b) not in _loaded:
        _loaded[a, b] = Sides(a, b)
    return _loaded[a, b]


class Bundle:
    """Texts one after another: their ids, and where tokens, groups and links begin and end."""

    def __init__(self, known: Sides, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.ids_a, self.ids_b, self.n_a, self.n_b = ids_a.astype(np.int64), ids_b.astype(np.int64), n_a, n_b
        ends_a, ends_b = np.cumsum(known.lengths_a[self.ids_a]), np.cumsum(known.lengths_b[self.ids_b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        marks = np.zeros(size, np.uint8)
        marks[ends_a] |= 1
        marks[ends_b] |= 2
        self.common_a, self.common_b = marks[ends_a] == 3, marks[ends_b] == 3
        at = np.flatnonzero(marks)
        kinds = marks[at]
        self.link_a = np.cumsum(kinds & 1, dtype=np.int64) - (kinds & 1)
        self.link_b = np.cumsum(kinds >> 1, dtype=np.int64) - (kinds >> 1)
        text_ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        self.links_until = np.concatenate([[0], np.searchsorted(at, text_ends, "right")])
        self.groups_until = np.concatenate([[0], np.cumsum(kinds == 3)])[self.links_until]
        self.keys = (self.ids_a[self.link_a] * known.width + self.ids_b[self.link_b]).astype(known.key)

    def grouped(self, table: list[bytes], vocabulary: tuple[int, int]) -> list[bytes]:
        """Per text `a1,a2|b1;a3|b2,b3`: the ids of each group."""
        after_a, after_b = np.flatnonzero(self.common_a) + 1, np.flatnonzero(self.common_b) + 1
        group_a = np.cumsum(self.common_a) - self.common_a
        group_b = np.cumsum(self.common_b) - self.common_b
        codes = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        codes[np.arange(len(self.ids_a)) + np.concatenate([[0], after_b])[group_a]] = self.ids_a + vocabulary[0] * self.common_a
        codes[np.arange(len(self.ids_b)) + after_a[group_b]] = 2 * vocabulary[0] + self.ids_b + vocabulary[1] * self.common_b
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(map(table.__getitem__, codes[lo:hi].tolist()))[:-1] for lo, hi in zip([0, *ends], ends)]


BUNDLE_SCHEMA = "bundle long, ids array<long>, n_a binary, n_b binary, ids_a binary, ids_b binary"


def bundles(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The texts' ids, many texts in a row. Ids and lengths are compressed little-endian numbers."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = sides(a, b), TaskContext.get().partitionId() << 32
        ids, held, size = [], [], 0

        def row() -> pa.RecordBatch:
            parts = [
                np.array([len(x) for x, _ in held], "<i8"), np.array([len(y) for _, y in held], "<i8"),
                np.concatenate([x for x, _ in held]).astype("<u4"), np.concatenate([y for _, y in held]).astype("<u4"),
            ]
            packed = [pa.array([_packed(x)], pa.binary()) for x in parts]
            return pa.record_batch([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), *packed], ["bundle", "ids", "n_a", "n_b", "ids_a", "ids_b"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                texts = part.column(1).to_pylist()
                for key, body, found in zip(part.column(0).to_pylist(), texts, known.tokens(texts)):
                    ids.append(key)
                    held.append(found)
                    size += len(body)
                    if size >= bundle_bytes:
                        yield row()
                        ids, held, size, number = [], [], 0, number + 1
        if ids:
            yield row()

    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(tokenize, BUNDLE_SCHEMA), "bundles", "none")


def _packed(values: np.ndarray) -> bytes:
    """Size in bytes of a value, number of values, the values compressed."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + len(values).to_bytes(8, "little") + _codec().compress(values.astype(f"<u{width}").tobytes(), asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:9], "little")
    return np.frombuffer(_codec().decompress(packed[9:], width * n), f"<u{width}").astype(np.int64)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=5)


def _bundle(known: Sides, row: dict) -> Bundle:
    return Bundle(known, *(_unpacked(row[c]) for c in ("ids_a", "ids_b", "n_a", "n_b")))


def _dealt(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys in the order of their blocks, the bounds of the blocks in them, and that order."""
    own = (mixed(keys, BLOCK_SEED) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return keys[order], np.searchsorted(own[order], np.arange(blocks + 1)), order


def requests(rows: DataFrame, a: str, b: str, blocks: int) -> DataFrame:
    """(bundle, block, keys, counts, n): the distinct pairs of each bundle and how often it has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sides(a, b)
        known.forget()
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.unique(_bundle(known, row).keys, return_counts=True)
                keys, bounds, order = _dealt(keys, blocks)
                counts = counts[order].astype("<u4")
                used = np.flatnonzero(np.diff(bounds))
                spans = [slice(bounds[i], bounds[i + 1]) for i in used]
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(used), row["bundle"])), pa.array(used.astype(np.int32)), pa.array([keys[s].tobytes() for s in spans], pa.binary()),
                        pa.array([counts[s].tobytes() for s in spans], pa.binary()), pa.array(np.diff(bounds)[used].astype(np.int64)),
                    ],
                    ["bundle", "block", "keys", "counts", "n"],
                )

    return stored(rows.select("bundle", "ids_a", "ids_b", "n_a", "n_b").mapInArrow(count, "bundle long, block int, keys binary, counts binary, n long"), "requests")


def _column(table: pa.Table, name: str, dtype: str | np.dtype) -> np.ndarray:
    """The numbers of all binary values of a column, one after another."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _tree(rows: DataFrame, nodes: int, combine: Callable[[pa.Table], bytes], name: str) -> DataFrame:
    """(block, data): the rows (block, node, data) of each block combined, FAN_IN of its nodes at a time."""

    def joined(table: pa.Table) -> pa.Table:
        columns = [table.column(c)[:1].combine_chunks() for c in ("block", "node")]
        return pa.table([*columns, pa.array([combine(table)], pa.binary())], ["block", "node", "data"])

    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        above = rows.withColumn("node", F.expr(f"cast(node div {FAN_IN} as int)"))
        rows = above.groupBy("block", "node").applyInArrow(joined, "block int, node int, data binary")
    return stored(rows.select("block", "data"), name)


class PairCounts:
    """Counts of all pairs of a corpus, in blocks: `functions` and `vectors` (see the module), by block."""

    def __init__(self, rows: DataFrame, a: str, b: str):
        self.bundles, self.a, self.b = rows, a, b
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("ids_a") + F.octet_length("ids_b")).alias("bytes")).first()
        self.blocks = min(MOST_BLOCKS, max(8, int((size.bytes or 0) ** 0.5 / 500)))
        self.requests = requests(rows, a, b, self.blocks)
        asked = self.requests.agg(F.sum("n").alias("n")).first().n or 0
        leaves = max(1, -(-size.n // FAN_IN))
        keys = _united(self.requests, leaves, a, b)
        distinct = keys.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        self.distinct = distinct // sides(a, b).key.itemsize
        self.leaves = max(1, min(leaves, asked // max(1, self.distinct)))
        self.functions = _functions(keys, a, b)
        self.vectors = self._vectors()
        self.best = self._best()

    def _at_leaves(self) -> DataFrame:
        return self.requests.withColumn("node", _leaf(self.leaves))

    def _vectors(self) -> DataFrame:
        """(block, data): for each index the number of links of its pair, as 64-bit numbers."""
        key = sides(self.a, self.b).key

        def dense(asked: pa.Table, functions: pa.Table) -> pa.Table:
            if not asked.num_rows:
                return asked.select([]).append_column("block", pa.array([], pa.int32())).append_column("node", pa.array([], pa.int32())).append_column("data", pa.array([], pa.binary()))
            known = _function(functions, key)
            at = known.index(_column(asked, "keys", key))
            if (at < 0).any():
                raise ValueError("a pair is not in the table of its block")
            sums = np.bincount(at, _column(asked, "counts", "<u4"), len(known.keys)).astype("<i8")
            return pa.table([asked.column("block")[:1].combine_chunks(), asked.column("node")[:1].combine_chunks(), pa.array([sums.tobytes()], pa.binary())], ["block", "node", "data"])

        at_leaves = self._at_leaves().select("block", "node", "keys", "counts")
        rows = at_leaves.groupBy("block", "node").cogroup(self._to_leaves(self.functions).groupBy("block", "node"))
        return _tree(rows.applyInArrow(dense, "block int, node int, data binary"), self.leaves, _summed, "vectors")

    def _to_leaves(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(self.leaves - 1))))

    def pairs(self) -> DataFrame:
        """(a_id, b_id, n): every pair that is linked anywhere and its number of links."""
        known = sides(self.a, self.b)
        width, key = known.width, known.key

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    keys = np.frombuffer(row["keys"], key).astype(np.int64)
                    yield pa.record_batch([pa.array(keys // width), pa.array(keys % width), pa.array(np.frombuffer(row["data"], "<i8"))], ["a_id", "b_id", "n"])

        return self.functions.select("block", "keys").join(self.vectors, "block").mapInArrow(rows, "a_id long, b_id long, n long")

    def _best(self) -> np.ndarray:
        """Per id of the second vocabulary the highest count of its pairs: as many numbers as it has ids."""
        best = np.zeros(sides(self.a, self.b).width, np.int64)
        for row in self.pairs().groupBy("b_id").agg(F.max("n").alias("n")).toLocalIterator():
            best[row.b_id] = row.n
        return best

    def replies(self) -> DataFrame:
        """(bundle, block, counts): the counts of each bundle's pairs, in the order in which it asked."""
        key = sides(self.a, self.b).key

        def look_up(asked: pa.Table, functions: pa.Table) -> pa.Table:
            if not asked.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bundle", "block", "counts"])
            at = _function(functions, key).index(_column(asked, "keys", key))
            counts = _column(functions, "data", "<i8")[at]
            ends = np.cumsum(asked.column("n").to_numpy())
            found = [x.astype("<i8").tobytes() for x in np.split(counts, ends[:-1])]
            return pa.table([asked.column("bundle"), asked.column("block"), pa.array(found, pa.binary())], ["bundle", "block", "counts"])

        known = self._to_leaves(self.functions.join(self.vectors, "block"))
        at_leaves = self._at_leaves().select("bundle", "block", "node", "keys", "n")
        return at_leaves.groupBy("block", "node").cogroup(known.groupBy("block", "node")).applyInArrow(look_up, "bundle long, block int, counts binary")


def _leaf(leaves: int) -> Column:
    return F.pmod(F.xxhash64("bundle"), F.lit(leaves)).cast("int")


def _united(asked: DataFrame, leaves: int, a: str, b: str) -> DataFrame:
    """(block, data): the distinct keys of each block."""
    key = sides(a, b).key
    rows = asked.select("block", F.pmod(F.xxhash64("bundle"), F.lit(leaves * FAN_IN)).cast("int").alias("node"), F.col("keys").alias("data"))
    return _tree(rows, leaves * FAN_IN, lambda table: np.unique(_column(table, "data", key)).tobytes(), "distinct-pairs")


def _summed(table: pa.Table) -> bytes:
    data = table.column("data").to_pylist()
    return _column(table, "data", "<i8").reshape(len(data), -1).sum(axis=0).astype("<i8").tobytes()


def _functions(keys: DataFrame, a: str, b: str) -> DataFrame:
    """(block, sizes, bits, keys): the minimal perfect hash function of each block."""
    key = sides(a, b).key

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = PerfectHash.of(np.frombuffer(row["data"], key))
                yield pa.record_batch(
                    [pa.array([row["block"]], pa.int32()), pa.array([found.sizes.tolist()], pa.list_(pa.int64())), pa.array([found.bits], pa.binary()), pa.array([found.keys.tobytes()], pa.binary())],
                    ["block", "sizes", "bits", "keys"],
                )

    return stored(keys.mapInArrow(build, "block int, sizes array<long>, bits binary, keys binary"), "perfect-hashes")


def _function(table: pa.Table, key: np.dtype) -> PerfectHash:
    row = table.select(["sizes", "bits", "keys"]).slice(0, 1).to_pylist()[0]
    return PerfectHash(np.array(row["sizes"], np.int64), row["bits"], np.frombuffer(row["keys"], key))


ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups "


def aligned(counts: PairCounts, digest: bool = False) -> DataFrame:
    """One row per text: its numbers of tokens, groups and links, of links whose count is the highest
    of their id of the second side, the sum of its links' counts, and its groups as text.

    Texts that are null, empty, or not given back byte by byte by one of the tokenizers have no
    tokens, zeros and an empty `groups`. With `digest`, `groups` is its SHA-256 instead. Rows with
    equal or null ids are texts of their own; an empty table gives no row.
    """
    a, b, best, blocks = counts.a, counts.b, counts.best, counts.blocks
    names = [x.split()[0] for x in ALIGNED.split(",")]

    def align(rows: pa.Table, replies: pa.Table) -> pa.Table:
        known = sides(a, b)
        vocabulary = len(known.a.pieces), len(known.b.pieces)
        row = rows.to_pylist()[0]
        bundle = _bundle(known, row)
        keys, inverse = np.unique(bundle.keys, return_inverse=True)
        _, _, order = _dealt(keys, blocks)
        by_key = np.empty(len(keys), np.int64)
        by_key[order] = _column(replies.sort_by("block"), "counts", "<i8")
        link_counts = by_key[inverse]
        at_best = link_counts == best[bundle.ids_b[bundle.link_b]]

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bundle.links_until])

        groups = bundle.grouped(known.group_table, vocabulary)
        shown = [hashlib.sha256(g).hexdigest() if g and digest else g.decode() for g in groups]
        numbers = [bundle.n_a, bundle.n_b, np.diff(bundle.groups_until), np.diff(bundle.links_until), per_text(at_best), per_text(link_counts)]
        return pa.table([pa.array(row["ids"], pa.int64()), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(shown, pa.string())], names)

    return counts.bundles.groupBy("bundle").cogroup(counts.replies().groupBy("bundle")).applyInArrow(align, ALIGNED + "string")
