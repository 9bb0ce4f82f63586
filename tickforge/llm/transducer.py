"""One pass over UTF-8 bytes that counts what simple text filters ask for.

A finite-state machine with two states, between words and inside one, reads bytes. CLASSES gives
the class of each byte and TRANSITIONS what a (state, class) does: the next state and the actions,
bits that say whether a word begins, a word ends, a code point begins, a capital or a symbol is
counted. The next state depends on the class alone, so a stretch of bytes is run at once: the state
before a byte is the state after the byte before it.

The spans of the words go into a hash table with open addressing. A slot is taken by the first
span that comes to it; a span that finds a slot taken is the same word only if document, length and
bytes are equal, else it goes on to the next slot. So the number of distinct words is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BETWEEN, INSIDE = 0, 1
SPACE, CAPITAL, SYMBOL, LETTER, CONTINUATION = range(5)
BEGINS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
NAMES = ("code_points", "capitals", "symbols", "words", "distinct_words")

SLICE_BYTES = 1 << 21
"""Texts are run together, or a long one in parts that end with a word, about so many bytes at a time."""


def byte_classes(symbols: bytes = b"#$%&*|") -> np.ndarray:
    classes = np.full(256, LETTER, np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] = SPACE
    classes[0x41:0x5B] = CAPITAL
    classes[list(symbols)] = SYMBOL
    classes[0x80:0xC0] = CONTINUATION
    return classes


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state by class; actions by (state, class)."""
    after = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
    actions = np.zeros((2, 5), np.uint8)
    for state in (BETWEEN, INSIDE):
        for kind in range(5):
            done = 0 if kind == CONTINUATION else POINT
            done |= BEGINS if state == BETWEEN and kind != SPACE else 0
            done |= ENDS if state == INSIDE and kind == SPACE else 0
            done |= {CAPITAL: IS_CAPITAL, SYMBOL: IS_SYMBOL}.get(kind, 0)
            actions[state, kind] = done
    return after, actions


CLASSES = byte_classes()
AFTER, ACTIONS = _transitions()


def run(data: np.ndarray, starts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts per text, and begin and end of each word, of texts that follow one another in `data`.

    `starts` says where each text begins; every text ends with a space of its own, which is not counted.
    """
    kinds = CLASSES[data]
    states = np.empty(len(data), np.uint8)
    states[:1] = BETWEEN
    states[1:] = AFTER[kinds[:-1]]
    done = ACTIONS[states, kinds]

    def per_text(bit: int) -> np.ndarray:
        return np.add.reduceat((done & bit) != 0, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)

    counts = {"code_points": per_text(POINT) - 1, "capitals": per_text(IS_CAPITAL), "symbols": per_text(IS_SYMBOL)}
    return counts, np.flatnonzero(done & BEGINS), np.flatnonzero(done & ENDS)


def _pieces(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; `data` has eight bytes more than it needs."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _piece(pieces: np.ndarray, begins: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    return pieces[begins + at] & _LOW_BYTES[np.minimum(lengths - at, 8)]


def _hashes(pieces: np.ndarray, begins: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    factor, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
    value = (owners.astype(np.uint64) << np.uint64(32) | lengths.astype(np.uint64)) * factor
    left, at = np.arange(len(begins)), 0
    while len(left):
        x = (value[left] ^ _piece(pieces, begins[left], lengths[left], at)) * factor
        value[left] = x ^ (x >> shift)
        at += 8
        left = left[lengths[left] > at]
    return value


def _same(pieces: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of these lengths at a and at b hold the same bytes."""
    same = np.ones(len(a), bool)
    left, at = np.arange(len(a)), 0
    while len(left):
        equal = _piece(pieces, a[left], lengths[left], at) == _piece(pieces, b[left], lengths[left], at)
        same[left[~equal]] = False
        at += 8
        left = left[equal & (lengths[left] > at)]
    return same


def first_of_their_kind(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, owners: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """For each span whether it is the one that its owner's spans of equal bytes are kept by in the hash table.

    `data` has eight bytes more than the spans need. All spans that are not placed yet come to
    their slot together; the lowest in number takes it if it is empty.
    """
    pieces = _pieces(data)
    hashes = _hashes(pieces, begins, lengths, owners) if hashes is None else hashes
    size = 1 << max(4, (2 * len(begins) - 1).bit_length())
    table = np.full(size, -1, np.int64)
    slots = (hashes >> np.uint64(3)).astype(np.int64) & (size - 1)
    first = np.zeros(len(begins), bool)
    left = np.arange(len(begins))
    while len(left):
        at = slots[left]
        empty = table[at] < 0
        table[at[empty][::-1]] = left[empty][::-1]
        holder = table[at]
        first[left[holder == left]] = True
        alike = (holder != left) & (hashes[holder] == hashes[left]) & (owners[holder] == owners[left]) & (lengths[holder] == lengths[left])
        rows = np.flatnonzero(alike)
        alike[rows] = _same(pieces, begins[holder[rows]], begins[left[rows]], lengths[left[rows]])
        left = left[(holder != left) & ~alike]
        slots[left] = (slots[left] + 1) & (size - 1)
    return first


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each with a space behind it, and where each begins; eight bytes follow."""
    data = np.frombuffer(b" ".join([*texts, b"\0" * 8]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.cumsum(sizes) - sizes


def counts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """NAMES of texts that are small enough to be run together."""
    data, starts = _joined(texts)
    found, begins, ends = run(data[: len(data) - 8], starts)
    owners = np.searchsorted(starts, begins, "right") - 1
    first = first_of_their_kind(data, begins, ends - begins, owners)
    found["words"] = np.bincount(owners, minlength=len(texts))
    found["distinct_words"] = np.bincount(owners[first], minlength=len(texts))
    return found


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end after a space, where there is one."""
    at = 0
    while at < len(text):
        end = at + SLICE_BYTES
        if end < len(text):
            near = np.flatnonzero(CLASSES[np.frombuffer(text, np.uint8, end - at, at)] == SPACE)
            while not len(near) and end < len(text):  # one word longer than a part: on to its end
                step = min(SLICE_BYTES, len(text) - end)
                near = np.flatnonzero(CLASSES[np.frombuffer(text, np.uint8, step, end)] == SPACE) + (end - at)
                end += step
            end = at + int(near[-1]) + 1 if len(near) else len(text)
        yield text[at:end]
        at = end


def counts_of_long(text: bytes) -> dict[str, int]:
    """NAMES of one text of any length: parts are run one by one, each adds its distinct words to one set."""
    sums, seen = dict.fromkeys(NAMES, 0), set()
    for part in _parts(text):
        data, starts = _joined([part])
        found, begins, ends = run(data[: len(data) - 8], starts)
        for name, values in found.items():
            sums[name] += int(values[0])
        first = first_of_their_kind(data, begins, ends - begins, np.zeros(len(begins), np.int64))
        sums["words"] += len(begins)
        seen.update(part[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist()))
    return sums | {"distinct_words": len(seen)}


def text_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", *columns: str) -> DataFrame:
    """(id, the NAMES, digest) and `columns` of each row; `digest` is the SHA-256 of the text.

    A null text counts as empty. Words are runs of anything but ASCII white space.
    """
    extra = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.col(id).cast("long").alias("id"), *(F.col(c).alias(x) for c, x in zip(columns, extra)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(0).to_pylist()
                if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
                    found = {k: [v] for k, v in counts_of_long(texts[0]).items()}
                else:
                    found = counts_of(texts)
                digests = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
                numbers = [pa.array(found[n], pa.int64()) for n in NAMES]
                yield pa.record_batch([part.column(1), *numbers, digests, *part.columns[2:]], ["id", *NAMES, "digest", *extra])

    kinds = "".join(f", {x} {rows.schema[x].dataType.simpleString()}" for x in extra)
    schema = "id long, " + ", ".join(f"{n} long" for n in NAMES) + ", digest binary" + kinds
    return rows.mapInArrow(count, schema).withColumnsRenamed(dict(zip(extra, columns)))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of rows with about SLICE_BYTES of text; a longer text is alone."""
    sizes = [len(x.as_buffer() or b"") for x in batch.column(0)]
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if batch.num_rows > begin:
        yield batch.slice(begin)
