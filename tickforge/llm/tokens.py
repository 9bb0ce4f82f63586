"""Token ids of whole texts by the tokenizers library, with a memo of words.

Words repeat, so a text is cut as the tokenizer's own pre-tokenizer cuts it, each word is
looked up, and only words not met before go through the tokenizer's model. The ids are those
of encoding the whole text, since tokenizers of this kind never join characters over a cut:

* Texts of plain Latin-1 characters are cut by Python's `re`, with the pattern's classes of
  letters and numbers written out for them. There normalization changes case alone. Where every
  space stands between two characters that are not white space, a cut comes before each of them.
  Some megabytes of such texts are cut together at those spaces and where letters, numbers and
  signs meet, each distinct piece is looked up once in Arrow arrays, and Arrow puts the ids in
  the order of the pieces.
* Other texts are cut by the pattern itself if the tokenizer does not normalize, and are
  encoded whole if it does.
* A text that holds the string of an added token is encoded whole. With `special=False` such
  strings are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: how a byte-level pre-tokenizer cuts."""

LATIN_LETTERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")
"""What is beyond Latin-1, a control character, a space of another kind or a raised or broken number."""

_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
"""How byte-level vocabularies write a byte: itself if it shows, else the next sign from 256 on."""
SPACE_SIGN = chr(BYTE_CHARACTERS[ord(" ")])

LETTER, NUMBER, SIGN, OTHER = range(4)
KINDS = np.array([LETTER if re.match(f"[{LATIN_LETTERS}]", c) else NUMBER if c in "0123456789" else OTHER if c in " \n'" else SIGN for c in map(chr, range(256))], np.uint8)
"""Kinds of the plain Latin-1 characters; an apostrophe may go with the letters behind it."""
MEET = np.array([[a != b and OTHER not in (a, b) for b in range(4)] for a in range(4)]).ravel()
PIECES, WORDS = 500_000, 150_000
"""Entries of the packed memo, about 50 bytes each, and of each generation of the other, about 200 bytes each."""
LONGEST = 100
"""Characters of the longest key that a memo remembers."""
PART_BYTES, PART_ROWS = 1 << 22, 50_000
"""What is encoded together: so many bytes or characters of texts, and so many texts."""


class Memo(dict):
    """What `make` gives for a key, remembered in two generations: what has not been used for long goes."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) > LONGEST:
            return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def many(self, keys: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        return pa.array(map(self.__getitem__, keys.to_pylist()), pa.large_binary())

    def new(self, keys: set[str]) -> list[str]:
        """Those keys that are not remembered, to be learned together."""
        return [key for key in keys - self.keys() if key not in self.old]

    def learn(self, keys: list[str], values: Iterable[bytes]) -> None:
        if len(self) + len(keys) > self.size:
            self.old = dict(self)
            self.clear()
        self.update(zip(keys, values))

    def forget(self) -> None:
        self.clear()
        self.old = {}


class PackedMemo:
    """What `make` gives for keys that are asked for in large numbers, remembered as two Arrow arrays.

    Each question goes over all that is remembered. Of more than `size` keys the half that was used last stays.
    """

    def __init__(self, make: Callable[[bytes], bytes], size: int):
        self.make, self.size = make, size
        self.forget()

    def forget(self) -> None:
        self.keys = self.values = pa.array([], pa.large_binary())
        self.used, self.turn = np.zeros(0, np.int64), 0

    def many(self, keys: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The value of each key."""
        old = len(self.keys)
        found = pa.concat_arrays([self.keys, keys]).dictionary_encode()
        every, places = found.dictionary, found.indices[old:]
        made = pa.array(map(self.make, every[old:].to_pylist()), pa.large_binary())
        values = pa.concat_arrays([self.values, made])
        out = values.take(places)
        self.turn += 1
        used = np.pad(self.used, (0, len(made)))
        used[places.to_numpy()] = self.turn
        keep = np.flatnonzero(pc.binary_length(every).to_numpy() <= LONGEST)
        if len(keep) > self.size:
            keep = np.sort(keep[np.argsort(-used[keep], kind="stable")[: self.size // 2]])
        if len(keep) < len(every):
            every, values, used = every.take(pa.array(keep)), values.take(pa.array(keep)), used[keep]
        self.keys, self.values, self.used = every, values, used
        return out


class TextTokens:
    """Ids of texts as bytes of little-endian unsigned numbers of `dtype`."""

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        rules = json.loads(self.tokenizer.to_str())
        pattern = _pattern(rules["pre_tokenizer"])
        plain = pattern.replace(r"\p{L}", LATIN_LETTERS).replace(r"\p{N}", "0-9")
        self.cut_plain = re.compile(plain).findall
        self.cut_other = None if rules["normalizer"] else regex.compile(pattern).findall
        self.lower = '"Lowercase"' in json.dumps(rules["normalizer"])
        added = [re.escape(x["content"]) for x in rules["added_tokens"]] if special else []
        self.holds_added = re.compile("|".join(added), re.IGNORECASE).search if added else lambda text: None
        self.words = Memo(self._word, WORDS)
        self.before = " " if " ?" in pattern else ""
        self.pieces = PackedMemo(self._piece, PIECES)
        parts = " ab", ".,#", "\n", "Cd", "12", "(", "3", "é"
        self.apart = self.cut_plain("".join(parts)) == [word for part in parts for word in self.cut_plain(part)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the texts are worked through about `PART_BYTES` characters at a time."""
        out, part, size = [], [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= PART_BYTES:
                out += self._encode_part(part)
                part, size = [], 0
        return out + self._encode_part(part)

    def _encode_part(self, texts: list[str]) -> list[bytes]:
        found = [self._text(text) for text in texts]
        cut = iter(self._cut_at_spaces([x for x in found if isinstance(x, str)]))
        return [next(cut) if isinstance(x, str) else x for x in found]

    def _text(self, text: str) -> bytes | str:
        """The ids of a text, or the normalized text if it is to be cut at its spaces."""
        if self.holds_added(text):
            return self._encode_whole(text)
        if NOT_PLAIN.search(text):
            return self._looked_up(self.cut_other(text)) if self.cut_other else self._encode_whole(text)
        if self.lower:
            text = text.lower()
        return text if _spaces_stand_alone(text) else self._cut_ids(text)

    def _cut_at_spaces(self, texts: list[str]) -> list[bytes]:
        starts = np.cumsum([0, *map(len, texts)])
        data = "".join(texts).encode("latin-1")
        cuts = self._cuts(np.frombuffer(data, np.uint8), starts)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        ids = self.pieces.many(pieces.dictionary).take(pieces.indices)
        _, ends, joined = ids.buffers()
        places = np.frombuffer(ends, np.int64)[np.searchsorted(cuts, starts)].tolist() if len(ids) else [0] * len(starts)
        joined = memoryview(joined or b"")
        return [bytes(joined[lo:hi]) for lo, hi in zip(places, places[1:])]

    def _cuts(self, signs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the end: at texts, at spaces, where kinds meet, and around a line feed that has no other beside it."""
        begins = np.zeros(len(signs) + 1, bool)
        begins[:-1] = signs == ord(" ")
        begins[starts] = True
        if self.apart:
            kinds = KINDS[signs]
            begins[1:-1] |= MEET[kinds[:-1] * np.uint8(4) + kinds[1:]]
            feeds = np.flatnonzero(signs == ord("\n"))
            alone = np.diff(feeds) > 1
            feeds = feeds[np.append(True, alone) & np.append(alone, True)] if len(feeds) else feeds
            begins[feeds] = begins[feeds + 1] = True
        return np.flatnonzero(begins)

    def _encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a piece in Latin-1; most often a space and a word."""
        text = piece.decode("latin-1")
        if text[:1] == " " and text[1:].isalpha():
            return self._word(self.before + text[1:])
        return self._cut_ids(text)

    def _cut_ids(self, text: str) -> bytes:
        words = self.cut_plain(text)
        return self._word(words[0]) if len(words) == 1 else self._looked_up(words)

    def _looked_up(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            signs = word.replace(" ", SPACE_SIGN)
        else:
            signs = word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        ids = array(self.code, [t.id for t in self.tokenizer.model.tokenize(signs)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def _spaces_stand_alone(text: str) -> bool:
    """Whether every space has a character before or, at the begin, behind it that is not white space."""
    if text.endswith(" ") or "  " in text or "\t" in text or "\r" in text:
        return False
    return " \n" not in text and "\n " not in text


def _pattern(rule: dict) -> str:
    """The pattern whose matches a pre-tokenizer gives."""
    for part in rule.get("pretokenizers", [rule]):
        if part["type"] == "Split" and part["invert"] and "Regex" in part["pattern"]:
            return part["pattern"]["Regex"]
        if part["type"] == "ByteLevel" and part.get("use_regex", True) and not part["add_prefix_space"]:
            return BYTE_LEVEL_PATTERN
    raise ValueError("a pre-tokenizer with a pattern is needed")


def even_parts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, with about `PART_BYTES` of the texts in `column` and at most `PART_ROWS` in each but the last."""
    held, rows, size = [], 0, 0
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, before + PART_BYTES - size)) + 1, at + PART_ROWS - rows, batch.num_rows)
            held.append(batch.slice(at, to - at))
            rows, size, at = rows + to - at, size + int(ends[to - 1]) - before, to
            if size >= PART_BYTES or rows >= PART_ROWS:
                yield pa.concat_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


_loaded: dict[tuple[str, bool], TextTokens] = {}


def text_tokens(path: str, special: bool = True) -> TextTokens:
    """The tokenizer of a file, loaded once per Python worker."""
    if (path, special) not in _loaded:
        _loaded[path, special] = TextTokens(path, special)
    return _loaded[path, special]
