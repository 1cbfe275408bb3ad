"""Benchmark decontamination: document word windows against a hash set of normalised benchmark windows.

The set is broadcast while the benchmark is under a checked size; past it hashes of the same windows meet in a shuffled
join. Both ways verify a hit word by word and give the same rows. By broadcast each document is scanned alone, so one hot
source or group of copies costs what its rows cost and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW = 10
#: Largest benchmark, in characters, whose windows are broadcast.
BROADCAST_CHARS = 4_000_000
#: A word: ASCII letters (lower-cased), digits and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_UPPER = {c: c + 32 for c in range(65, 91)}
RESULT = "n_words long, n_hit long, item_ids array<long>, spans array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: one byte-table pass that lower-cases A-Z and blanks what separates words."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WindowIndex:
    """Hash set of the windows of a benchmark, by window length; a hit is verified word by word."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[k : k + size]), set()).update([] if item is None else [item])
        self.by_size = {}
        for size, windows in found.items():
            keys = np.array(list(windows), dtype=np.uint64)
            factor = np.uint64(0x9E3779B97F4A7C15)
            while len(np.unique(hashes := self._hash(keys.T, factor))) < len(keys):
                factor += np.uint64(2)
            order = np.argsort(hashes)
            items_of = [sorted(x) for x in windows.values()]
            self.by_size[size] = factor, hashes[order], keys[order], [items_of[k] for k in order]

    @staticmethod
    def _hash(columns, factor: np.uint64) -> np.ndarray:
        total = np.zeros(len(columns[0]), dtype=np.uint64)
        for column in columns:
            total = total * factor + column
        return total

    def hits(self, text: str | None) -> tuple[int, np.ndarray | None, list[int]]:
        """Number of words, which of them are inside a benchmark window (None: none), and the items hit."""
        tokens = words(text)
        n = len(tokens)
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), dtype=np.uint64, count=n)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        edges, items = None, set()
        for size, (factor, hashes, keys, items_of) in self.by_size.items():
            if n < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[: n - size + 1])
            if not len(at):
                continue
            got = self._hash([ids[at + k] for k in range(size)], factor)
            where = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            same = hashes[where] == got
            at, where = at[same], where[same]
            for k in range(size):
                equal = keys[where, k] == ids[at + k]
                at, where = at[equal], where[equal]
            if len(at):
                edges = np.zeros(n + 1, dtype=np.int64) if edges is None else edges
                np.add.at(edges, at, 1)
                np.add.at(edges, at + size, -1)
                for k in np.unique(where):
                    items.update(items_of[k])
        return n, None if edges is None else np.cumsum(edges[:-1]) > 0, sorted(items)


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the runs of hit words, end exclusive."""
    out: list[tuple[int, int]] = []
    last = False
    for match, now in zip(WORD.finditer(text.translate(_UPPER)), hit.tolist(), strict=True):
        if now:
            out.append((out.pop()[0] if last else match.start(), match.end()))
        last = now
    return out


def _leak(text: str | None, n: int, hit: np.ndarray | None, items: list[int]) -> tuple:
    if hit is None:
        return n, 0, items, []
    return n, int(hit.sum()), items, [{"start": a, "end": b} for a, b in spans(text, hit)]


def _by_broadcast(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """`rows` (_kept, _text) with the column leak, from a broadcast window set."""
    items = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]
    index = rows.sparkSession.sparkContext.broadcast(WindowIndex(items, window))

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = index.value
        for texts in batches:
            yield pd.DataFrame([_leak(text, *known.hits(text)) for text in texts], columns=["n_words", "n_hit", "item_ids", "spans"])

    return rows.withColumn("leak", scan.asNondeterministic()("_text"))


def _by_join(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """`rows` (_kept, _text) with the column leak, for a benchmark too large to broadcast.

    Of each document window only (row, position, size, hash) is shuffled; what meets a benchmark window of that hash is
    verified on the words of the text. A window that very many documents share is a skewed key of an inner join, which
    adaptive execution splits.
    """

    def tokens(column):
        lower = F.translate(F.coalesce(column, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")

    def windows(df, size):
        places = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("w", i, size)).alias("hash")))
        return df.where(F.size("w") >= size).withColumn("_p", F.explode(places)).select("*", "_p.at", "_p.hash").drop("_p")

    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    item = benchmark.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    grams = windows(item, F.col("size")).select("size", "hash", F.slice("w", F.col("at"), F.col("size")).alias("gram"), "item_id")
    grams = cut(grams.groupBy("size", "hash", "gram").agg(F.collect_set("item_id").alias("items")))
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # at most `window`
    words_of = rows.select("_row", tokens(F.col("_text")).alias("w"))
    asked = windows(words_of.withColumn("size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))), F.col("size")).select("_row", "at", "size", "hash")
    hits = asked.join(grams, ["size", "hash"]).join(words_of, "_row").where(F.slice("w", F.col("at"), F.col("size")) == F.col("gram"))
    hits = cut(hits.select("_row", "at", "size", "items"))
    places = hits.groupBy("_row").agg(F.collect_set(F.struct("at", "size")).alias("_places"))
    items = hits.select("_row", F.explode_outer("items").alias("item")).groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("_items"))

    @F.pandas_udf(RESULT)
    def mark(texts: pd.Series, places: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = []
        for text, found, named in zip(texts, places, items, strict=True):
            n, hit = len(words(text)), None
            if found is not None:
                edges = np.zeros(n + 1, dtype=np.int64)
                for place in found:
                    edges[place["at"] - 1] += 1
                    edges[place["at"] - 1 + place["size"]] -= 1
                hit = np.cumsum(edges[:-1]) > 0
            out.append(_leak(text, n, hit, [] if named is None else list(named)))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "item_ids", "spans"])

    found = rows.join(places, "_row", "left").join(items, "_row", "left")
    return found.withColumn("leak", mark.asNondeterministic()("_text", "_places", "_items")).select("_kept", "_text", "leak")


def _fits(benchmark: DataFrame, limit: int) -> bool:
    size = benchmark.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + F.lit(16)).alias("n")).first()["n"]
    return (size or 0) <= limit


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_chars: int) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept"), F.col("text").alias("_text"))
    return (_by_broadcast if _fits(benchmark, broadcast_chars) else _by_join)(rows, benchmark, window)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """`docs` with a struct column `leak` (n_words, n_hit, item_ids, spans); a column of that name is replaced."""
    found = _marked(docs, benchmark, window, broadcast_chars)
    return found.select(*[F.col(f"_kept.`{c}`") for c in docs.columns if c.lower() != "leak"], "leak")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit and item_ids of the benchmark items with a window in the text.

    A window is `window` consecutive words of an item, or all of a shorter one. Null and empty texts have no words and
    no hits, items without words have no windows, and an item with a null id marks words but is not listed. Repeated
    rows and items count as they come (ids once). An empty benchmark leaves every document clean.
    """
    found = annotate(docs.select("doc_id", "text"), benchmark, window, broadcast_chars)
    return found.select("doc_id", "leak.n_words", "leak.n_hit", "leak.item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """`docs` without leaked passages: action "documents" drops every row with a hit, "spans" cuts the hit words.

    All columns stay as they are. Rows without a hit, null texts among them, are returned unchanged; each row is judged
    by its own text, whatever its doc_id.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    marked = _marked(docs, benchmark, window, broadcast_chars)
    if action == "documents":
        return marked.where("leak.n_hit = 0").select("_kept.*")

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(text, found):
            for cut in reversed(list(found if found is not None else [])):
                text = text[: cut["start"]] + text[cut["end"] :]
            return text

        return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    marked = marked.select("_kept", without("_text", "leak.spans").alias("_text"))
    return marked.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_kept.`{c}`") for c in docs.columns])


def items_sha256(items) -> str:
    """Digest of the ids, sorted as strings and comma-joined."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
