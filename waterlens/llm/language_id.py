"""Language identification by rank-order profiles: out-of-place distance between ranked character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc

UNDETERMINED = "und"
#: n-grams kept of a language profile, and of a document.
PROFILE = 400
TOP = 400
#: Bounds of the fit: training documents in expectation, dealt to the languages evenly, and the least share of one.
TRAINING_DOCS = 12_000
LANGUAGE_DOCS = 500
#: Score under which `keep_known` says that no profile fits: a distance of more than 98 % of the largest possible.
LEAST_SCORE = 0.02


def ranked(text: str | None, top: int = TOP) -> np.ndarray:
    """Keys of the most frequent 1- to 3-grams of the letters of a text, most frequent first, ties to the smaller key.

    Words are runs of letters, lower-cased, with a blank on each side; a gram's code points fill 21 bits each. Empty if
    the text is null or has no letter.
    """
    grams, counts = _counted(text)
    order = np.lexsort((grams, -counts))[:top]
    return grams[order]


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, inverse = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)[inverse]
    if not letter.any():
        return none
    points = np.where(letter, points, 32)
    points = np.concatenate(([32], points, [32]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))].astype(np.uint64)
    blank = points == 32
    one = points[~blank]
    two = (points[:-1] << np.uint64(21)) | points[1:]
    inner = ~blank[1:-1]
    three = ((points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:])[inner]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


class Profiles:
    """Ranked profiles by language; the distance of a gram that a profile lacks is the profile's length."""

    def __init__(self, grams: dict[str, list[int]], length: int = PROFILE):
        self.length = length
        self.languages = sorted(k for k, v in grams.items() if v)
        self.sorted = []
        for language in self.languages:
            keys = np.array(grams[language][:length], dtype=np.uint64)
            order = np.argsort(keys)
            self.sorted.append((keys[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranked(text)
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0
        places = np.arange(len(grams))
        best, least = 0, None
        for k, (keys, ranks) in enumerate(self.sorted):
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            off = np.where(keys[at] == grams, np.minimum(np.abs(ranks[at] - places), self.length), self.length)
            total = int(off.sum())
            if least is None or total < least:
                best, least = k, total
        return self.languages[best], 1.0 - least / (self.length * len(grams))


def fit(docs: DataFrame, training_docs: int = TRAINING_DOCS, length: int = PROFILE) -> Profiles:
    """Profiles from documents with text and a non-null lang whose crc32(doc_id as text) mod 5 is not 0.

    Of those a fixed sample takes part, chosen by a hash of doc_id: of each language about an even part of
    `training_docs`, at least LANGUAGE_DOCS, or all if it has fewer. Grams are counted in the tasks and summed by Spark;
    the driver receives a count and `length` grams of each language.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_crc("doc_id") % 5 != 0))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").collect()}
    part = max(training_docs / max(len(sizes), 1), LANGUAGE_DOCS)
    shares = [(lang, int(min(1.0, part / n) * 1_000_000) + 1) for lang, n in sizes.items()]
    shares = docs.sparkSession.createDataFrame(shares, "_lang string, _share int")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1_000_000)) < F.col("_share")
    sample = labelled.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = _counted(text)
                totals.setdefault(lang, Counter()).update(dict(zip(grams.view(np.int64).tolist(), counts.tolist(), strict=True)))
        for lang, counter in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(counter), "gram": list(counter.keys()), "n": list(counter.values())})

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranks = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= length)
    profiles = ranks.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram")))["gram"].alias("grams"))
    return Profiles({r["lang"]: r["grams"] for r in profiles.collect()}, length)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """`docs` with columns lang_pred and lang_score (0 to 1: one less the distance as a share of the largest possible).

    Columns of these names are replaced. Null and empty texts and texts without a letter get `und` and 0, as do all if
    nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            yield pd.DataFrame([known.predict(t) for t in texts], columns=["lang", "score"])

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept")
    found = docs.select(kept, of.asNondeterministic()("text").alias("_found"))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    return found.select(*[F.col(f"_kept.`{c}`") for c in kept], F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("lang_score"))


def report(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out (crc32 mod 5 is 0; null for a null id), lang_pred, score.

    The prediction reads the text alone. Repeated rows each give a row; an empty table gives none.
    """
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """`docs` without documents that no profile fits: `und`, or a score under `least`. All columns stay.

    If no profile could be learned, every document with a letter stays.
    """
    profiles = fit(docs)
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("text", "_row"), profiles)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= least)).select("_row.*")
