"""Concatenate and cut: documents' ids one after another, cut into windows of fixed length.

Two passes. The first turns texts into ids where they are read and numbers them within their
partition; one row per partition goes into a prefix sum that gives each partition its place
in the whole. The second cuts at multiples of the window length. A window that lies inside
one task is whole at once; the few that cross a border are put together from their parts.
Only the very last window is padded. The order of documents is that of the table's files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickforge.llm.common import offsets_before, small_side, stored
from tickforge.llm.tokens import even_parts, text_tokens

WINDOW = 4096
END_ID = 2
PIECE = "struct<doc_id: long, start: long, length: long, ids_crc32: long, doc_tokens: long, offset: long>"


def document_ids(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, local_start, doc_id, n, ids) of each row: its ids with `end_id` behind them.

    Null texts are empty and have the end id alone. Rows repeated or with equal or null ids
    are documents of their own.
    """

    def encode_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, at = text_tokens(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], tokens.dtype).tobytes()
        for rows in even_parts(batches, 1):
            ids = [x + end for x in tokens.encode(rows.column(1).to_pylist())]
            n = np.array([len(x) for x in ids], np.int64) // tokens.dtype.itemsize
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.record_batch(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(starts), rows.column(0), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "local_start", "doc_id", "n", "ids"],
            )

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encode_texts, "part int, local_start long, doc_id long, n long, ids binary")


def windows(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = True, **columns) -> DataFrame:
    """(sequence_id, offset, length, ids, pieces): windows, and parts of those that cross a border.

    `pieces` are the boundary records: which stretch of which document lies where. `ids`, little-
    endian unsigned 32-bit numbers, is null without `with_ids`. An empty table gives no row.
    """
    ids = stored(document_ids(docs, tokenizer, **columns), "packed-ids")
    places = offsets_before(ids.groupBy("part").agg(F.sum("n").alias("n")), "part", "n")
    placed = ids.join(small_side(places), "part").select((F.col("before") + F.col("local_start")).alias("at"), "doc_id", "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces, begin, end = [], [], 0, 0

        def window_row() -> dict:
            raw = b"".join(held) if with_ids else None
            return {"sequence_id": begin // window, "offset": begin % window, "length": end - begin, "ids": raw, "pieces": pieces}

        for batch in batches:
            rows = []
            for at, doc, n, raw in zip(*(batch.column(i) for i in range(4))):
                at, doc, n, raw = at.as_py(), doc.as_py(), n.as_py(), raw.as_py()
                own = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                if pieces and at != end:
                    rows.append(window_row())
                    held, pieces = [], []
                done = 0
                while done < n:
                    if not pieces:
                        begin = end = at + done
                    take = min(n - done, window - end % window)
                    part = own[4 * done : 4 * (done + take)]
                    pieces.append({"doc_id": doc, "start": done, "length": take, "ids_crc32": zlib.crc32(part), "doc_tokens": n, "offset": end % window})
                    if with_ids:
                        held.append(part)
                    done, end = done + take, end + take
                    if end % window == 0:
                        rows.append(window_row())
                        held, pieces = [], []
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, _WINDOW_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _WINDOW_ARROW)
        if pieces:
            yield pa.RecordBatch.from_pylist([window_row()], _WINDOW_ARROW)

    return placed.mapInArrow(cut, f"sequence_id long, offset long, length long, ids binary, pieces array<{PIECE}>")


def sequences(parts: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids, pieces): whole windows of 32-bit ids, the last one padded.

    Whole windows pass through; parts are put together by their offset, at most `window` of them.
    """
    whole = parts.filter(F.col("length") == window).select("sequence_id", "ids", F.col("length").alias("n_ids"), "pieces")
    crossing = parts.filter(F.col("length") < window).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids", "length", "pieces"))).alias("p")
    )
    joined = crossing.select(
        "sequence_id",
        F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
        F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("n_ids"),
        F.expr("flatten(transform(p, x -> x.pieces))").alias("pieces"),
    )
    padding = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({window} - n_ids as int))"))
    return whole.unionByName(joined.withColumn("ids", F.concat("ids", padding)))


_WINDOW_ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("pieces", pa.list_(pa.struct([(x.split(": ")[0].strip(), pa.int64()) for x in PIECE[7:-1].split(",")]))),
    ]
)
