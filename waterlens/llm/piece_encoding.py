"""SentencePiece encoding and decoding of Arrow text columns by a score-ordered agenda, checked against the library.

A merge-type vocabulary starts from characters. An agenda holds the adjacent pairs of symbols whose joint text is a piece,
best score first and leftmost first among equals; the first pair is merged and its new neighbours join the agenda, until no
pair is left. Symbols that are no piece become the pieces of their UTF-8 bytes. No merge can cross two neighbouring
characters that stand side by side in no piece, so a column's normalised texts are cut there, Arrow finds the distinct
units, and only units that a worker has not met run through the agenda. Each of those is encoded and decoded by the
sentencepiece library as well, batch by batch: a difference is an error, never a silent result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .token_encoding import default_path

#: Bytes of text that are encoded at once, at least one text; and bytes of units and ids that a worker's cache holds.
SLICE_BYTES = 2 << 20
CACHE_BYTES = 128 << 20
_ENTRY, _LONGEST = 300, 1000
SPACE = "▁"
#: Characters that begin the private use area; the first that no piece holds stands before a unit in the check.
_PRIVATE = range(0xE000, 0xF8FF)


class PieceModel:
    """A sentencepiece model file of merge type with byte fallback."""

    def __init__(self, path: str, check: bool = True, cache_bytes: int = CACHE_BYTES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, size = self.library, self.library.get_piece_size()
        self.check, self.cache_bytes, self.held = check, cache_bytes, 0
        self.known: dict[str, tuple[bytes, bytes]] = {}
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError(f"{path}: unused pieces are not supported")
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError(f"{path}: the model has no byte fallback")
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.end_id = sp.eos_id()
        self.surface = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        characters = sorted({c for piece in self.ids for c in piece})
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.joins = np.zeros((len(characters) + 1, len(characters) + 1), dtype=bool)
        for piece in self.ids:
            at = self.classes[[ord(c) for c in piece]]
            self.joins[at[:-1], at[1:]] = True
        self.apart = next(chr(c) for c in _PRIVATE if not self.classes[c])
        self.before = sp.encode(self.apart)

    def agenda(self, unit: str) -> list[int]:
        """The ids of a normalised text, by merges in order of score."""
        n, rank, symbols = len(unit), self.rank, list(unit)
        agenda = [(r, k, k + 1, 2) for k in range(n - 1) if (r := rank.get(unit[k : k + 2])) is not None]
        heapq.heapify(agenda)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue  # one of the two has been merged with another since
            symbols[a] += symbols[b]
            symbols[b] = ""
            after = right[a] = right[b]
            if after < n:
                left[after] = a
                if (r := rank.get(symbols[a] + symbols[after])) is not None:
                    heapq.heappush(agenda, (r, a, after, len(symbols[a]) + len(symbols[after])))
            before = left[a]
            if before >= 0 and (r := rank.get(symbols[before] + symbols[a])) is not None:
                heapq.heappush(agenda, (r, before, a, len(symbols[before]) + len(symbols[a])))
        ids: list[int] = []
        for symbol in filter(None, symbols):
            known = self.ids.get(symbol)
            ids += [known] if known is not None else [self.byte_ids[b] for b in symbol.encode()]
        return ids

    def decode_unit(self, ids: list[int]) -> bytes:
        """The text of ids that follow others, in UTF-8; runs of byte pieces are decoded together."""
        found, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                found.append(run.decode("utf-8", "replace").encode())
                run = bytearray()
            found.append(self.surface.get(i, b""))  # control pieces have no text
        return b"".join(found) + run.decode("utf-8", "replace").encode()

    def _checked(self, units: list[str], ids: list[list[int]], texts: list[bytes]) -> None:
        """Holds the agenda's ids and the decoded texts against the library's, after a character that joins nothing."""
        apart = [self.apart + u for u in units]
        same = [k for k, (a, n) in enumerate(zip(apart, self.library.normalize(apart), strict=True)) if n == SPACE + a]
        found = self.library.encode([apart[k] for k in same], num_threads=1)
        back = self.library.decode(found, num_threads=1)
        for k, theirs, text in zip(same, found, back, strict=True):
            if theirs != self.before + ids[k] or text.encode() != self.apart.encode() + texts[k]:
                raise RuntimeError(f"the agenda's ids of {units[k]!r} are not the library's")

    def _of(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian 32-bit) and decoded text of distinct units."""
        if self.held > self.cache_bytes:
            self.known, self.held = {}, 0
        fresh = [u for u in units if u not in self.known]
        ids = list(map(self.agenda, fresh))
        texts = list(map(self.decode_unit, ids))
        if self.check and fresh:
            self._checked(fresh, ids, texts)
        made = {u: (np.array(i, dtype="<i4").tobytes(), t) for u, i, t in zip(fresh, ids, texts, strict=True)}
        kept = {u: v for u, v in made.items() if len(u) <= _LONGEST}
        self.known.update(kept)
        self.held += sum(_ENTRY + 2 * len(u) + len(v[0]) for u, v in kept.items())
        every = self.known if len(kept) == len(made) else self.known | made
        return list(map(every.__getitem__, units))

    def _slice(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        normal = self.library.normalize(texts)
        points = np.frombuffer("".join(normal).encode("utf-32-le"), dtype="<u4")
        if not len(points):
            return [np.empty(0, dtype="<i4")] * len(texts), [b""] * len(texts)
        kind = self.classes[points]
        cut = np.ones(len(points), dtype=bool)
        cut[1:] = ~self.joins[kind[:-1], kind[1:]]
        ends = np.cumsum([len(t) for t in normal])
        cut[ends[ends < len(points)]] = True  # what follows is another text's
        starts = np.flatnonzero(cut)
        places = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000))))
        offsets = np.append(places[starts], places[-1]).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer("".join(normal).encode())).dictionary_encode()
        found = self._of(units.dictionary.to_pylist())
        at = units.indices.to_numpy().tolist()
        bounds = np.searchsorted(starts, np.concatenate(([0], ends))).tolist()
        blobs, surfaces = [f[0] for f in found], [f[1] for f in found]
        ids, decoded = [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            some = at[a:b]
            ids.append(np.frombuffer(b"".join([blobs[k] for k in some]), dtype="<i4"))
            text = b"".join([surfaces[k] for k in some])
            decoded.append(text[1:] if text.startswith(b" ") else text)  # the blank that encoding puts before a text
        return ids, decoded

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
        """Slice by slice of bounded bytes: its first row, and the ids and the decoded UTF-8 text of each of its texts. The
        end id is not among the ids. Null texts count as empty."""
        texts = texts.fill_null("")
        upto = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))))
        first = 0
        while first < len(texts):
            last = max(int(np.searchsorted(upto, upto[first] + SLICE_BYTES, side="right")) - 1, first + 1)
            yield first, *self._slice(texts.slice(first, last - first).to_pylist())
            first = last


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of this Python worker; it lives as long as the worker."""
    return PieceModel(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id) and decoded (the text that the ids give) of every row of `docs`.

    Ids equal those of the library's encode(text) with the end id after them, decoded its decode(ids). A null text counts as
    empty: the end id alone and an empty text. doc_id may be null or repeat, other columns are ignored, and an empty table
    gives no rows. Each text is encoded whole; texts are independent, so nothing is shuffled.
    """
    file = path or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(file)
        for batch in batches:
            for first, ids, decoded in known.batches(batch.column(1)):
                ends = np.cumsum([0] + [len(i) + 1 for i in ids])
                flat = np.concatenate([part for i in ids for part in (i, [known.end_id])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(ids)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                    pa.array([d.decode() for d in decoded], type=pa.string()),
                ], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What `encode` gives as digests, made where the texts are, so no id leaves its task: doc_id, n_tokens (with the end
    id), ids_sha256 (of the decimal ids joined by one blank), decoded_sha256 (of the decoded text in UTF-8)."""
    file = path or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(file)
        names = list(map(str, range(known.library.get_piece_size())))
        for batch in batches:
            for first, ids, decoded in known.batches(batch.column(1)):
                every = [[*i.tolist(), known.end_id] for i in ids]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(ids)).cast(pa.int64()), pa.array([len(i) for i in every], type=pa.int64()),
                    pa.array([hashlib.sha256(" ".join([names[k] for k in i]).encode()).hexdigest() for i in every], type=pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], type=pa.string()),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
