"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words to weighted symbols (insult, threat, intent, target, negation, report); its insult
entries and weights are learned from labels, the other word lists are given. Small transducers weigh insults that follow
each other and threats that follow an intent, mark what negation and reported speech govern, and what a target makes
direct. They are composed into one machine that reads a clause once and emits matches; a match weighs what its word and
the arcs on its way weigh. A document's score is a logistic function of its clause matches, fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_crc

# Closed word lists of the grammar, in the languages it reads.
TARGETS = frozenset("you your yours yourself he she they them him her these those people everyone tú usted ustedes vosotros du dich dir ihr euch sie tu toi vous eux".split())
NEGATIONS = frozenset("not no never none without isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun sans nunca jamás sin ni".split())
REPORTS = frozenset("said says saying told claimed claims quoted wrote reported called alleged dijo dice sagte sagt behauptete dit disait prétend".split())
THREATS = frozenset("kill hurt destroy shoot stab burn beat hang murder matar morir töten sterben umbringen tuer mourir détruire".split())

INTENTS = frozenset("will gonna going i'll we'll shall must should wants want werde werden muss voy vamos quiero vais va vais je vais".split())

#: Weights of arcs: an insult soon after another, a threat after an intent, a match that is directed, negated or reported.
AGAIN, INTENDED, DIRECTED, NEGATED, REPORTED = 0.5, 3.0, 3.2, -1.5, -1.0
#: Bounds of the fit: labelled documents in expectation, entries of the learned lexicon.
TRAINING_DOCS = 12_000
LEXICON = 20_000
LEAST_DOCS = 3
STEMS = (3, 4, 5, 6, 7, 8)
#: Least weight of a learned entry, weight of a given threat, and from which score a clause counts as strong.
LEAST_WEIGHT = 2.0
THREAT_WEIGHT = 3.5
STRONG = 3.0
THRESHOLD = 0.7
_DRAWS = 1 << 40
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”«»]")
_STOPS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")
#: What the grammar emits for a loaded word, by what governs it.
OUTPUTS = ("plain", "directed", "negated", "reported")


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: (state, symbol) to (next state, output symbol, weight). Missing arcs copy the
    symbol and weigh nothing; weights add up along a path."""

    arcs: dict[tuple[str, str], tuple[str, str, float]]
    start: str = "0"

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def compose(self, after: Transducer, alphabet: set[str]) -> Transducer:
        """The transducer that feeds this one's output to `after`; its states are the reachable pairs."""
        arcs, begin = {}, f"{self.start}|{after.start}"
        queue, seen = [(self.start, after.start)], {begin}
        while queue:
            a, b = queue.pop()
            for symbol in alphabet:
                to, middle, first = self.step(a, symbol)
                then, out, second = after.step(b, middle)
                arcs[f"{a}|{b}", symbol] = f"{to}|{then}", out, first + second
                if f"{to}|{then}" not in seen:
                    seen.add(f"{to}|{then}")
                    queue.append((to, then))
        return Transducer(arcs, begin)


#: Symbols: I insult, H threat, M intent, N negation, R report verb, Q quote, T target, W other word. A loaded symbol is
#: followed by what governs it: n negated, r reported, d directed, p none of them.
SYMBOLS = frozenset("IHMNRQTW")
_LOADED = "IH"
_OTHER = "MNRQTW"


def insult() -> Transducer:
    """An insult within two symbols of another weighs more."""
    arcs = {(s, "I"): ("2", "I", AGAIN if s != "0" else 0.0) for s in "012"}
    arcs |= {(s, x): (str(int(s) - 1), x, 0.0) for s in "12" for x in "H" + _OTHER}
    return Transducer(arcs)


def threat() -> Transducer:
    """A threat within three symbols of an intent weighs more; an intent is a plain word to what follows."""
    arcs = {(s, "M"): ("3", "W", 0.0) for s in "0123"}
    arcs |= {(s, "H"): ("0", "H", INTENDED) for s in "123"}
    arcs |= {(s, x): (str(int(s) - 1), x, 0.0) for s in "123" for x in "INRQTW"}
    return Transducer(arcs)


def negation() -> Transducer:
    """A negation governs the next loaded word within two words."""
    arcs = {(s, "N"): ("2", "W", 0.0) for s in "012"}
    arcs |= {(s, x): (str(int(s) - 1), x, 0.0) for s in "12" for x in "WT"}
    return Transducer(arcs | {(s, x): ("0", x + "n", NEGATED) for s in "12" for x in _LOADED})


def reported_speech() -> Transducer:
    """A report verb governs the next loaded word within six words; a quote after it opens and closes its speech."""
    arcs = {("q", "Q"): ("0", "W", 0.0)} | {("q", x + n): ("q", x + "r", REPORTED) for x in _LOADED for n in ("", "n")}
    for s in "0123456":
        arcs |= {(s, "R"): ("6", "W", 0.0), (s, "Q"): ("q" if s != "0" else "0", "W", 0.0)}
        if s != "0":
            arcs |= {(s, x): (str(int(s) - 1), x, 0.0) for x in "WT"}
            arcs |= {(s, x + n): ("0", x + "r", REPORTED) for x in _LOADED for n in ("", "n")}
    return Transducer(arcs)


def target() -> Transducer:
    """What stands within three words after a target is directed at it, and so is what a target follows within three words: then
    the target itself gives the weight (Td)."""
    arcs = {(s, "T"): ("3", "W", 0.0) for s in "0123"} | {(s, "W"): (str(int(s) - 1), "W", 0.0) for s in "123"}
    arcs |= {(s, x): ("0", x + "d", DIRECTED) for s in "123" for x in _LOADED}
    arcs |= {(s, x): ("c", x + "p", 0.0) for s in "0abc" for x in _LOADED}
    arcs |= {("c", "W"): ("b", "W", 0.0), ("b", "W"): ("a", "W", 0.0), ("a", "W"): ("0", "W", 0.0)}
    return Transducer(arcs | {(s, "T"): ("3", "Td", DIRECTED) for s in "abc"})


def grammar() -> Transducer:
    """Insult, threat, negation, reported speech and target, composed in this order."""
    machine = insult()
    for after in (threat(), negation(), reported_speech(), target()):
        machine = machine.compose(after, set(SYMBOLS))
    return machine


_NAMES = {"p": 0, "d": 1, "n": 2, "r": 3}


@dataclass
class Model:
    """Learned entries (word or stem to weight), and the document model over clause features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: np.ndarray | None = None
    prior: float = 0.0

    def __post_init__(self):
        self._memo: dict[str, tuple[str, float]] = {}
        machine = grammar()
        self._start, self._arcs = machine.start, machine.arcs

    def symbol(self, word: str) -> tuple[str, float]:
        got = self._memo.get(word)
        if got is None:
            weight = max([self.words.get(word, 0.0), *[self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n]])
            if word in THREATS:
                got = "H", max(weight, THREAT_WEIGHT)
            elif weight:
                got = "I", weight
            elif word in INTENTS:
                got = "M", 0.0
            elif word in NEGATIONS:
                got = "N", 0.0
            elif word in TARGETS:
                got = "T", 0.0
            else:
                got = ("R" if word in REPORTS else "Q" if word in _QUOTES else "W"), 0.0
            if len(self._memo) > 200_000:
                self._memo = {}
            self._memo[word] = got
        return got

    def clauses(self, text: str | None) -> Iterator[list[tuple[str, int, float]]]:
        """Each clause's matches: (insult or threat, what governs the word, its weight, at least zero)."""
        state, found = self._start, []
        for token in _TOKEN.findall(text.lower() if text else ""):
            if token in _STOPS:
                if found:
                    yield found
                state, found = self._start, []
                continue
            symbol, weight = self.symbol(token)
            state, out, more = self._arcs[state, symbol]
            if symbol in _LOADED:
                found.append((symbol, _NAMES[out[1]], max(weight + more, 0.0)))
            elif out == "Td":
                found[-1] = found[-1][0], _NAMES["d"], found[-1][2] + more
        if found:
            yield found

    def features(self, text: str | None) -> np.ndarray:
        """Of the clause scores (sums of weights): the two largest, log(1 + sum), log(1 + number of strong ones); and
        log(1 + sum of weights) of threats, and of directed, negated and reported matches."""
        scores, kinds, threats = [], [0.0] * len(OUTPUTS), 0.0
        for clause in self.clauses(text):
            scores.append(sum(weight for _, _, weight in clause))
            for symbol, kind, weight in clause:
                kinds[kind] += weight
                threats += weight if symbol == "H" else 0.0
        first, second = (sorted(scores, reverse=True) + [0.0, 0.0])[:2]
        strong = sum(x >= STRONG for x in scores)
        return np.array([first, second, math.log1p(sum(scores)), math.log1p(strong), math.log1p(threats), *map(math.log1p, kinds[1:])])

    def score(self, text: str | None) -> float:
        if self.coefficients is None:
            return self.prior
        z = float(self.coefficients[0] + self.features(text) @ self.coefficients[1:])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 200) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until they help. What raises a score by its nature (all but
    the last two features) keeps a weight >= 0: a weight at that bound moves only when the slope leads inside."""
    x = np.column_stack((np.ones(len(x)), x))
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    held = np.arange(x.shape[1])
    held = (held > 0) & (held < x.shape[1] - 2)

    def loss(w):
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        free = ~(held & (w <= 0) & (slope <= 0))
        h = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(ridge[free])
        step, size, then = np.zeros(len(w)), 1.0, now
        step[free] = np.linalg.solve(h, slope[free])
        while size > 1e-8:
            trial = w + size * step
            trial[held] = np.maximum(trial[held], 0.0)
            if (then := loss(trial)) < now:
                break
            size /= 2
        if now - then < 1e-9 * (1 + now):
            break
        w, now = trial, then
    return w


def _training(docs: DataFrame, labels: DataFrame, training_docs: int) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled training rows, half of it toxic where there are enough.

    A document's label is the largest of its non-null labels; crc32(doc_id as text) mod 3 = 1 is held out. Of several
    rows of one doc_id that of the least hash of its text takes part, so the sample holds `training_docs` rows in
    expectation, whatever the tables hold; its ids are broadcast.
    """
    known = labels.where(F.col("toxic").isNotNull() & (id_crc("doc_id") % 3 != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0).cast("long")
    for value, n in counts.items():
        share = F.when(F.col("toxic") == value, F.lit(int(min(1.0, training_docs / 2 / n) * _DRAWS)).cast("long")).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("_id", F.lit("toxic")), F.lit(_DRAWS)) < share)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS, lexicon: int = LEXICON) -> Model:
    """Learns the lexicon and the document model from labelled rows whose crc32 mod 3 is not 1."""
    sample = cut(_training(docs, labels, training_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad, docs_of = Counter(), Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {t for t in _TOKEN.findall(text.lower() if text else "") if len(t) > 1}
                entries = {f"w{t}" for t in found} | {f"s{t[:k]}" for t in found for k in STEMS if len(t) > k}
                n.update(entries)
                docs_of[toxic] += 1
                if toxic:
                    bad.update(entries)
        entries = [*n, "#"]
        n["#"], bad["#"] = docs_of.total(), docs_of[1]
        yield pa.RecordBatch.from_pydict({"entry": entries, "n": [n[e] for e in entries], "bad": [bad[e] for e in entries]})

    counted = sample.mapInArrow(count, "entry string, n long, bad long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = {r["entry"]: r for r in counted.where("entry = '#'").collect()}.get("#")
    if total is None or not total["bad"] or total["bad"] == total["n"]:
        return Model(prior=0.0 if total is None or not total["bad"] else 1.0)
    base = total["bad"] / total["n"]
    bad, good = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    odds = F.log(bad / good) - math.log(base / (1 - base)) - F.sqrt(1 / bad + 1 / good)  # less one standard error
    ranked = counted.where((F.col("entry") != "#") & (F.col("bad") >= LEAST_DOCS)).withColumn("weight", odds).where(F.col("weight") >= LEAST_WEIGHT)
    model = Model()
    for r in ranked.orderBy(F.desc("weight"), "entry").limit(lexicon).collect():
        (model.words if r["entry"][0] == "w" else model.stems)[r["entry"][1:]] = r["weight"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if batch.num_rows:
                rows = [known.features(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, type=pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = sample.mapInArrow(measure, "x array<double>, toxic int").collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64)
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    model.coefficients = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column toxicity (0 to 1); a column of that name is replaced. Null and empty texts have no clauses and
    get the model's intercept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            yield pd.Series([known.score(t) for t in texts], dtype="float64")

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept")
    found = docs.select(kept, of.asNondeterministic()("text").alias("_score"))
    return found.select(*[F.col(f"_kept.`{c}`") for c in docs.columns if c.lower() != "toxicity"], F.col("_score").alias("toxicity"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out (crc32 mod 3 is 1; null for a null id), score, predicted (score >= 0.7).

    The score reads the text alone. Without training rows of both labels it is 0 (1 if all were toxic) everywhere.
    Repeated rows each give a row; an empty table gives none.
    """
    found = score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
