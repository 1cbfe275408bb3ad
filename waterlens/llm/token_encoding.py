"""Encoding of Arrow text columns with a tokenizers file, by distinct units rather than text by text.

Both vocabularies split a text before the white space that precedes a word and between a letter and a punctuation mark,
so a text's ids are those of its units in order. Units are cut from the bytes of a whole column, their dictionary is
built by Arrow, only units that a worker has not met are encoded by the library, and the ids are gathered by numpy. A
vocabulary that lower-cases also drops white space, so there units are told apart without case and the blank before.
Texts that hold a special string are encoded whole by the library.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once, at least one text; and bytes of units and ids that a worker's cache holds.
SLICE_BYTES = 4 << 20
CACHE_BYTES = 128 << 20
#: Memory that an entry of the cache takes beside its text and ids, and the longest unit that is kept.
_ENTRY = 200
_LONGEST = 1000
#: ASCII punctuation but the apostrophe, which begins contractions.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What a byte is, as bits: a blank or line feed; a byte that can begin white space, in any reading of it; an ASCII letter;
#: ASCII punctuation.
_CUT, _SPACE, _LETTER, _MARK = 1, 2, 4, 8
_KIND = np.zeros(256, dtype=np.uint8)
for _bytes, _kind in (
    (b" \n", _CUT), (bytes([*range(9, 14), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]), _SPACE),
    (bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]), _LETTER), (_PUNCTUATION.encode(), _MARK),
):
    _KIND[list(_bytes)] |= _kind
_KINDS = _KIND.tobytes()
#: Units that are one word or run of marks to both vocabularies, after white space.
_SIMPLE = re.compile(rf"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+|[{re.escape(_PUNCTUATION)}]+)")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The printable character that stands for each byte in byte-level vocabularies: the others follow from 256 on.
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


#: Writers of up to 15 ids as little-endian 32-bit integers.
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]
#: What the white space before a unit adds to the piece: a blank joins the word, a line feed is a piece of its own.
_FRONT = {"": "", " ": _BYTE_CHARS[32], "\n": ""}


def _byte_level(piece: str) -> str:
    return piece.encode("utf-8").decode("latin-1").translate(_BYTE_CHARS)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and where each text ends in them, with a leading zero."""
    width = "<i8" if pa.types.is_large_string(texts.type) else "<i4"
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return held, offsets - offsets[0]


class Encoder:
    """Ids of texts, those of `Tokenizer.encode(text, add_special_tokens=False)`.

    special_as_text takes special strings in a text as ordinary text (the library's encode_special_tokens).
    """

    def __init__(self, path: str, special_as_text: bool = False, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model, self.lower = self.tokenizer.model, self.tokenizer.normalizer is not None
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache_bytes, self.held = cache_bytes, 0
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _unit(self, unit: str) -> bytes:
        if self.lower and unit.isascii() and unit.isalpha():  # lower-cased as bytes
            ids = [t.id for t in self.model.tokenize(unit)]
            return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)
        found = _SIMPLE.fullmatch(unit)
        if found is None:
            return self.whole(unit).tobytes()
        space, word = found.groups()
        if self.lower:
            word = word.lower()
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else _byte_level(word))]
        else:
            ids = [t.id for t in self.model.tokenize(_FRONT[space] + (word if word.isascii() else _byte_level(word)))]
            if space == "\n":
                ids = [t.id for t in self.model.tokenize(_BYTE_CHARS[10])] + ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units, as little-endian 32-bit integers."""
        if self.held > self.cache_bytes:
            self.known, self.held = {}, 0
        known, found = self.known, []
        for unit in units:
            ids = known.get(unit)
            if ids is None:
                ids = self._unit(unit)
                if len(unit) <= _LONGEST:
                    known[unit] = ids
                    self.held += _ENTRY + len(unit) + len(ids)
            found.append(ids)
        return found

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, rows = _bytes_of(texts)
        if not len(data):
            return np.empty(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        cut = np.empty(len(data), dtype=bool)
        cut[-1] = False
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(_KINDS), dtype=np.uint8)
        if self.lower:
            data = np.frombuffer(raw.lower(), dtype=np.uint8)
        cut[:-1] = (kind[:-1] & _CUT != 0) & (kind[1:] & _SPACE == 0)
        cut[1:] |= (kind[:-1] & _LETTER != 0) & (kind[1:] & _MARK != 0)
        filled = rows[1:] > rows[:-1]
        cut[rows[1:][filled] - 1] = False  # what follows is another text's
        cut[rows[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        left = starts
        if self.lower:  # case and the blank before a unit tell no units apart: fewer are met and encoded
            after = np.minimum(starts + 1, len(data) - 1)
            bare = (kind[starts] & _CUT != 0) & (kind[after] & _SPACE == 0) & ~cut[after]
            left = starts - (np.cumsum(bare) - bare)
            kept = np.ones(len(data), dtype=bool)
            kept[starts[bare]] = False
            data = data[kept]
        ends = pa.py_buffer(np.append(left, len(data)).astype(np.int32))
        units = pa.StringArray.from_buffers(len(starts), ends, pa.py_buffer(data)).dictionary_encode()
        blobs = self._ids_of(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(blobs), dtype="<u4")
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        firsts = np.cumsum(sizes) - sizes
        at = units.indices.to_numpy()
        size = sizes[at]
        upto = np.cumsum(size)
        ids = flat[np.repeat(firsts[at] - (upto - size), size) + np.arange(upto[-1])]
        row_ends = np.concatenate(([0], upto))[np.searchsorted(starts, rows)]
        return ids, np.diff(row_ends)

    def slices(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ids of a column's texts, slice by slice of bounded bytes: the first row of the slice, all its ids one after
        the other, and how many each row has; with `end_id` after each text if given. Null texts count as empty."""
        texts = texts.fill_null("")
        _, ends = _bytes_of(texts)
        first = 0
        while first < len(texts):
            last = max(int(np.searchsorted(ends, ends[first] + SLICE_BYTES, side="right")) - 1, first + 1)
            some = texts.slice(first, last - first)
            ids, sizes = self._slice(some)
            odd = np.zeros(len(some), dtype=bool)
            for mark in self.special:
                odd |= pc.match_substring(some, mark).to_numpy(zero_copy_only=False)
            if odd.any():
                each = np.split(ids, np.cumsum(sizes)[:-1])
                for k in np.flatnonzero(odd):
                    each[k] = self.whole(some[int(k)].as_py())
                ids, sizes = np.concatenate(each), np.array([len(e) for e in each], dtype=np.int64)
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
            yield first, ids, sizes
            first = last

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text, by the way of `slices`."""
        return next(self.slices(pa.array([text], type=pa.string())))[1]


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of this Python worker; it lives as long as the worker."""
    return Encoder(path, special_as_text)


def default_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
