"""Token ids in a compact file format: static range asymmetric numeral system (rANS).

Layout of a folder: `table` (one row: the shared frequency table), `blocks` (independent
blocks of whole documents in id order, in parts), `places` (how many ids come before each part). A block's ids are dealt over LANES coder states in
turn, which NumPy advances together. Every CHECKPOINT_ROWS steps the block keeps the states,
the place in its words and a checksum of the ids up to the next checkpoint, so that a reader
can start at any of them and decode the segments of one block in parallel.

States are 64-bit numbers in [2^31, 2^63); they give off 32-bit words. Frequencies add up to
2^PRECISION, and every id that occurs has at least one of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge.llm.common import drop_path, fresh_path, offsets_before, small_side, stored_at
from tickforge.llm.tokens import even_parts, text_tokens

PRECISION = 18
LANES = 8192
CHECKPOINT_ROWS = 64
BLOCK_IDS = 1 << 20
END_ID = 0
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


class Table:
    """Frequencies that add up to 2^PRECISION, in proportion to counts of ids."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.uint64)
        self.before = np.cumsum(self.frequencies) - self.frequencies
        self.most = self.frequencies << np.uint64(63 - PRECISION)
        self.symbols = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Each id with a count gets 1, the rest is shared in proportion, largest remainders first."""
        used = counts > 0
        spare = (1 << PRECISION) - int(used.sum())
        if spare < 0:
            raise ValueError("more distinct ids than the table has room for")
        exact = counts * (spare / max(1, counts.sum()))
        frequencies = used + np.floor(exact).astype(np.int64)
        if used.any():
            missing = (1 << PRECISION) - int(frequencies.sum())
            order = np.argsort(np.where(used, np.floor(exact) - exact, 1), kind="stable")[: int(used.sum())]
            np.add.at(frequencies, order[np.arange(missing) % len(order)], 1)
        return cls(frequencies)


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, states, places): row i of states is where decoding of segment i starts, at words[places[i]]."""
    rows = -(-len(ids) // LANES)
    states = np.full(LANES, _LOW, np.uint64)
    words, kept, counts = [], [], []
    mask, shift = np.uint64(0xFFFFFFFF), np.uint64(PRECISION)
    for row in range(rows - 1, -1, -1):
        symbols = ids[row * LANES : (row + 1) * LANES]
        x, f = states[: len(symbols)], table.frequencies[symbols]
        full = x >= table.most[symbols]
        words.append((x[full] & mask).astype(np.uint32))
        x = np.where(full, x >> _32, x)
        whole = x // f
        states[: len(symbols)] = (whole << shift) + (x - whole * f) + table.before[symbols]
        counts.append(len(words[-1]))
        if row % CHECKPOINT_ROWS == 0:
            kept.append(states.copy())
    places = np.concatenate([[0], np.cumsum(counts[::-1])])[:rows:CHECKPOINT_ROWS] if rows else np.zeros(0)
    joined = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return joined, np.array(kept[::-1], np.uint64).reshape(-1, LANES), places.astype(np.int64)


def decode_segment(words: np.ndarray, states: np.ndarray, place: int, n: int, table: Table) -> np.ndarray:
    """The first n ids from a checkpoint on."""
    out, x = np.empty(n, np.uint32), states.copy()
    slot_mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    for begin in range(0, n, LANES):
        width = min(LANES, n - begin)
        y = x[:width]
        slots = y & slot_mask
        symbols = table.symbols[slots]
        out[begin : begin + width] = symbols
        y = table.frequencies[symbols] * (y >> shift) + slots - table.before[symbols]
        low = np.flatnonzero(y < _LOW)
        y[low] = (y[low] << _32) | words[place : place + len(low)]
        place += len(low)
        x[:width] = y
    return out


def segments(n: int) -> list[tuple[int, int]]:
    """(first id, number of ids) of each segment of a block of n ids."""
    step = CHECKPOINT_ROWS * LANES
    return [(at, min(step, n - at)) for at in range(0, n, step)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


BLOCK_SCHEMA = (
    "part int, local_start long, n_ids long, docs array<struct<doc_id: long, n: long>>, "
    "words binary, states binary, places array<long>, checksums array<long>"
)


def write_ids(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all texts, each followed by `end_id`, in ascending order of `id`.

    Null texts are empty and have the end id alone; null ids come first; rows with equal ids
    follow one another in the order of a hash of their texts; an empty table gives no block. Two
    passes over the ids: they are stored where the texts are read and counted, then put in order
    and encoded with the counts as table.
    """
    spark = docs.sparkSession
    kept = fresh_path(spark, "ids")
    ids = stored_at(_ids(docs, tokenizer, id, text, end_id), kept, "lz4")
    table = Table.of(_counts(ids))
    spark.createDataFrame([(PRECISION, table.frequencies.astype(np.int64).tolist())], "precision int, frequencies array<long>").coalesce(
        1
    ).write.parquet(f"{path}/table")
    ordered = ids.filter("n > 0").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    ordered.select("doc_id", "n", "ids").mapInArrow(_encoder(table), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets_before(totals, "part", "n").write.parquet(f"{path}/places")
    drop_path(spark, kept)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n, ids): each document's ids from the files, as little-endian unsigned 32-bit numbers.

    With `digest`, `ids` is their unsigned CRC-32 instead.
    """
    row = spark.read.parquet(f"{path}/table").first()
    if row.precision != PRECISION:
        raise ValueError("written with another precision")
    frequencies = np.array(row.frequencies, np.int64)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequencies)
        for batch in batches:
            for block in batch.to_pylist():
                ids = decode_block(block, table)
                lengths = [d["n"] for d in block["docs"]]
                ends = np.cumsum(lengths)
                raw, kind = memoryview(ids.astype("<u4").tobytes()), pa.int64() if digest else pa.binary()
                for lo in range(0, len(lengths), 1000):
                    part = slice(lo, lo + 1000)
                    begins = ends[part] - lengths[part]
                    yield pa.record_batch(
                        [
                            pa.array([d["doc_id"] for d in block["docs"][part]], pa.int64()),
                            pa.array(begins + block["start"], pa.int64()),
                            pa.array(lengths[part], pa.int64()),
                            pa.array([zlib.crc32(x) if digest else bytes(x) for x in (raw[4 * a : 4 * b] for a, b in zip(begins, ends[part]))], kind),
                        ],
                        ["doc_id", "start", "n", "ids"],
                    )

    blocks = spark.read.parquet(f"{path}/blocks").join(small_side(spark.read.parquet(f"{path}/places")), "part")
    placed = blocks.withColumn("start", F.col("before") + F.col("local_start"))
    return placed.mapInArrow(decode, f"doc_id long, start long, n long, ids {'long' if digest else 'binary'}")


def decode_block(block: dict, table: Table) -> np.ndarray:
    """A block's ids, each segment from its own checkpoint and checked."""
    words = np.frombuffer(block["words"], "<u4")
    states = np.frombuffer(block["states"], "<u8").reshape(-1, LANES)
    parts = []
    for i, (_, n) in enumerate(segments(block["n_ids"])):
        part = decode_segment(words, states[i], block["places"][i], n, table)
        if checksum(part) != block["checksums"][i]:
            raise ValueError(f"damaged segment {i} of the block at {block['start']}")
        parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _ids(docs: DataFrame, tokenizer: str, id: str, text: str, end_id: int) -> DataFrame:
    """(doc_id, tie, n, ids) of each row; `tie` puts rows with equal ids in order.

    A row with n = -1 at the end of each task holds how often it has met each id, as 64-bit numbers.
    """

    def encode_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, names = text_tokens(tokenizer), ["doc_id", "tie", "n", "ids"]
        end, sums = np.array([end_id], tokens.dtype).tobytes(), np.zeros(0, np.int64)
        for rows in even_parts(batches, 2):
            ids = [x + end for x in tokens.encode(rows.column(2).to_pylist())]
            n = np.array([len(x) for x in ids], np.int64) // tokens.dtype.itemsize
            sums = _added(sums, np.bincount(np.frombuffer(b"".join(ids), tokens.dtype)))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(n), pa.array(ids, pa.binary())], names)
        none = pa.array([None], pa.int64())
        yield pa.record_batch([none, none, pa.array([-1]), pa.array([sums.astype("<i8").tobytes()], pa.binary())], names)

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("text"))
    return rows.mapInArrow(encode_texts, "doc_id long, tie long, n long, ids binary")


def _numbers(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _added(sums: np.ndarray, more: np.ndarray) -> np.ndarray:
    if len(more) > len(sums):
        sums = np.pad(sums, (0, len(more) - len(sums)))
    sums[: len(more)] += more
    return sums


def _counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows; the driver gets one row per distinct id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                sums = _added(sums, np.frombuffer(raw, "<i8"))
        used = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(used), pa.array(sums[used])], ["id", "n"])

    found = ids.filter("n < 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"]
    return counts


def _encoder(table: Table):
    frequencies = table.frequencies.astype(np.int64)

    def block(part: int, start: int, docs: list[tuple], pieces: list[np.ndarray], table: Table) -> pa.RecordBatch:
        ids = np.concatenate(pieces)
        words, states, places = encode(ids, table)
        checks = [checksum(ids[a : a + n]) for a, n in segments(len(ids))]
        row = {
            "part": part, "local_start": start, "n_ids": len(ids), "docs": [{"doc_id": d, "n": n} for d, n in docs],
            "words": words.astype("<u4").tobytes(), "states": states.astype("<u8").tobytes(), "places": places.tolist(), "checksums": checks,
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = Table(frequencies), TaskContext.get().partitionId()
        docs, pieces, start, size = [], [], 0, 0
        for batch in batches:
            for doc, n, raw in zip(*(batch.column(i) for i in range(3))):
                if size >= BLOCK_IDS:
                    yield block(part, start, docs, pieces, table)
                    docs, pieces, start, size = [], [], start + size, 0
                n = n.as_py()
                docs.append((doc.as_py(), n))
                pieces.append(_numbers(raw.as_py(), n))
                size += n
        if docs:
            yield block(part, start, docs, pieces, table)

    return run


_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("local_start", pa.int64()),
        ("n_ids", pa.int64()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())]))),
        ("words", pa.binary()),
        ("states", pa.binary()),
        ("places", pa.list_(pa.int64())),
        ("checksums", pa.list_(pa.int64())),
    ]
)
