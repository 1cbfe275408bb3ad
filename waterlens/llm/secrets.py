"""Secret scan: base patterns plus assignment-aware lexing with constant propagation and name scoring."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assignments import Value, literals, pairs

KINDS = ("assign", "access", "hex", "named")
#: The base patterns; the last two hold their least length, which leaves the same matches as dropping shorter ones.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN = 8

#: Weights of the words of a name: how strongly they say that its value is a secret (positive) or not.
NAME_WEIGHTS = {
    "password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "pass": 2, "secret": 4, "token": 3, "credential": 4,
    "credentials": 4, "apikey": 4, "private": 2, "auth": 2, "bearer": 3, "access": 1, "api": 1, "client": 1,
    "signing": 2, "encryption": 2, "key": 2, "salt": 2, "webhook": 1, "session": 1,
    "public": -3, "name": -3, "url": -3, "path": -3, "file": -3, "id": -1, "type": -3, "length": -3, "count": -3,
    "hint": -3, "policy": -3, "field": -3, "label": -3, "version": -3, "keyboard": -4,
}
LEAST_NAME = 3.0
LEAST_LITERAL = 8
LEAST_BITS = 2.5
_HEADED = re.compile(r"""[:=]|</|\([ \t]*["']""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def name_score(name: str) -> float:
    """Sum of the weights of a name's words or their singulars, split at case changes, digits and punctuation."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return float(sum(NAME_WEIGHTS.get(w, NAME_WEIGHTS.get(w.removesuffix("s"), 0)) for w in words))


def _looks_secret(value: Value) -> bool:
    """Long enough, no blanks, of several kinds of characters, no placeholder, of enough bits a character."""
    counts = value.counts
    n = counts.total()
    if n < LEAST_LITERAL or " " in counts or value.placeholder:
        return False
    upper, lower = any(c.isupper() for c in counts), any(c.islower() for c in counts)
    mixed = (upper and lower) or any(c.isdigit() or not c.isalnum() for c in counts)
    return mixed and -sum(c / n * math.log2(c / n) for c in counts.values()) >= LEAST_BITS


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind: the base spans, and named literals that are not wholly
    inside one of them."""
    if not text:
        return []
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if ":" in text or "=" in text else []
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if _HEADED.search(text):
        base = sorted(out)
        starts, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))  # the furthest end of all up to one
        inside = lambda start, end: (k := bisect_right(starts, start)) > 0 and end <= reach[k - 1]
        seen: set[int] = set()
        values = [value for name, value in pairs(text) if name_score(name) >= LEAST_NAME and _looks_secret(value)]
        named = {(p.start, p.end) for value in values for p in literals(value, seen)}
        out += [(start, end, "named") for start, end in named if start < end and not inside(start, end)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def report(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_assign, n_access, n_hex, n_named, base_sha256, spans.

    Offsets are code points. Null and empty texts have no spans. Repeated rows each give a row; an empty table none.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                found = find(text)
                counts = Counter(s[2] for s in found)
                base = joined([s for s in found if s[2] != "named"])
                rows.append((*(counts[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(found)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_named", "base_sha256", "spans"])

    return docs.select("doc_id", scan.asNondeterministic()("text").alias("_found")).select("doc_id", "_found.*")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """`text` with the union of its spans replaced by a mark each."""
    found = find(text)
    if not found:
        return text
    runs: list[list[int]] = []
    for start, end, _ in found:
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    for start, end in reversed(runs):
        text = text[:start] + mark + text[end:]
    return text


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with the secrets of `text` replaced by `mark`, and n_chars, if there, counted anew. Nulls stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, mark) for t in texts], dtype=object)

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept")
    rows = docs.select(kept, clean.asNondeterministic()("text").alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"_kept.`{c}`").alias(c) for c in docs.columns])
