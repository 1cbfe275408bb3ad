"""License scan: lines, paragraphs, texts and windows of texts against licence templates by Dice over word bigrams.

Everything is a row-local expression over built-in functions: no shuffle, no join and no Python on the executors.
The templates are a literal array of bounded size, so nothing that is broadcast grows with the data.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: What separates words: all ASCII but letters and digits, after lower-casing. Comment signs are none of the words.
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
MATCHES = "array<struct<license:string,dice:double>>"
#: Letters of a word that is looked for in texts before their bigrams are made.
LEAST_WORD = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def template_bigrams(text: str) -> list[str]:
    """A template's word bigrams, repeats included, by the rule of the scan."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def anchors(grams: Sequence[str], threshold: float) -> list[tuple[int, str]]:
    """(place, bigram) of so many of a template's longest bigrams that a unit without any of them misses the threshold.

    common <= b <= a * (2 - t) / t gives common >= a * t / (2 - t) for a template of a bigrams, so that a match lacks at
    most a * (1 - t / (2 - t)) of its occurrences. Long bigrams are rarer in prose than short ones.
    """
    most_lacking = int(len(grams) * (1 - threshold / (2 - threshold)) + 1e-9)
    chosen = sorted(enumerate(grams), key=lambda g: (-len(g[1]), g[0]))[: most_lacking + 1]
    return sorted(chosen)


def cover(marks: Sequence[str]) -> tuple[list[str], list[str]]:
    """(words, bigrams) of which a text holds one if it holds any of the anchors: few words of some length that most anchors
    have, by how many they cover, and the anchors that have no such word."""
    left, words = set(marks), []
    while counts := Counter(w for g in sorted(left) for w in g.split(" ") if len(w) >= LEAST_WORD):
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        words.append(best)
        left = {g for g in left if best not in g.split(" ")}
    return words, sorted(left)


def _may_match(lowered: Column, marks: Sequence[str]) -> Column:
    """Whether a text can hold an anchor at all: one search for the beginnings of few words, sorted by their first letters,
    before any of its bigrams is made."""
    words, bigrams = cover(marks)
    starts: dict[str, list[str]] = {}
    for text in [*words, *bigrams]:
        starts.setdefault(text[0], []).append(text[1:].replace(" ", NOT_WORD))
    branches = "|".join(f"{first}(?:{'|'.join(sorted(rest))})" for first, rest in sorted(starts.items()))
    return lowered.rlike(rf"(?<![a-z0-9\x{{80}}-\x{{10FFFF}}])(?:{branches})")


def _literal(values: Sequence, of: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{of}>")


def _known(templates: Sequence[tuple[str, str]], threshold: float) -> tuple[Column, list[str], list[int]]:
    """The templates as a literal array, all their anchors and their sizes."""
    rows, marks, sizes = [], set(), []
    for name, body in templates:
        grams = template_bigrams(body)
        if not grams:
            continue
        at = anchors(grams, threshold)
        repeats = [(g, n) for g, n in Counter(grams).items() if n > 1]
        rows.append(F.struct(
            F.lit(name).alias("license"), F.lit(len(grams)).alias("size"), _literal(grams, "string").alias("grams"),
            _literal([g for g, _ in repeats], "string").alias("repeated"), _literal([n for _, n in repeats], "int").alias("times"),
            _literal([g for _, g in at], "string").alias("marks"), _literal([i for i, _ in at], "int").alias("places"),
        ))
        marks |= {g for _, g in at}
        sizes.append(len(grams))
    return F.array(*rows), sorted(marks), sizes


def _dice(known: Column, unit: Column) -> Column:
    """2 * common / (unit + template), counting a bigram as often as both hold it."""
    twice = F.zip_with(known["repeated"], known["times"], lambda g, n: F.greatest(F.least(F.size(F.filter(unit, lambda u: u == g)), n) - 1, F.lit(0)))
    common = F.size(F.array_intersect(known["grams"], unit)) + F.aggregate(twice, F.lit(0), lambda a, b: a + b)
    return F.struct(known["license"].alias("license"), (2.0 * common / (F.size(unit) + known["size"])).alias("dice"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9, text: str = "text") -> DataFrame:
    """`docs` with a column `license_matches`: array of (license, dice), the best coefficient of each licence that matches.

    Compared are units (lines, paragraphs with blank lines around them, the whole text) and windows of a text. A window
    is as long as its template and starts where the template would if one of its `anchors` stood in its place; the
    text's start and end cut it. Dice is 2 * common / (unit + template) over bigrams with repeats. Two bounds leave out
    only what cannot reach the threshold: a * t / (2 - t) <= b <= a * (2 - t) / t of the sizes, and no anchor. A text without
    a word that any anchor needs has no anchor, so it is not cut into words at all.
    Licences whose texts differ in a few words (versions, members of a family) match together; the coefficient ranks them.
    Null and empty texts and texts of fewer than two words match nothing; the array is empty then. A column of that name
    in `docs` is replaced.
    """
    known, marks, sizes = _known(templates, threshold)
    if not sizes:
        return docs.withColumn("license_matches", F.array().cast(MATCHES))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(sizes) * low, max(sizes) * high
    body = F.col("_body")
    units = F.array_distinct(F.concat(F.split(body, "\n"), F.split(body, r"\n[ \t\r]*\n"), F.array(body)))

    def fits(size: Column) -> Column:
        return (size >= least) & (size <= most)

    def compare(unit: Column) -> Column:
        near = F.filter(known, lambda k: (k["size"] >= F.size(unit) * F.lit(low)) & (k["size"] <= F.size(unit) * F.lit(high)) & F.arrays_overlap(k["marks"], unit))
        return F.transform(near, lambda k: _dice(k, unit))

    def starts(hits: Column, k: Column) -> Column:
        """Where windows of a template start, given the (place, bigram) of all anchors in a text."""
        here = F.flatten(F.transform(hits, lambda h: F.transform(
            F.filter(F.arrays_zip(k["marks"], k["places"]), lambda m: m["marks"] == h["gram"]),
            lambda m: F.greatest(h["at"] - m["places"], F.lit(0)),
        )))
        return F.array_distinct(here)

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept")
    marked = lambda grams: F.filter(F.transform(grams, lambda g, i: F.when(g.isin(marks), F.struct(i.alias("at"), g.alias("gram")))), lambda h: h.isNotNull())
    sized = F.filter(F.transform(units, _words), lambda w: fits(F.size(w) - 1))
    lowered = docs.select(kept, F.col(text).alias("_text"), F.lower(text).alias("_lowered"))  # each made once, as several expressions use it
    docs_left = lowered.select("_kept", F.when(_may_match(F.col("_lowered"), marks), F.col("_text")).otherwise("").alias("_body"))
    rows = docs_left.select("_kept", F.filter(F.transform(sized, _bigrams), lambda u: F.exists(u, lambda g: g.isin(marks))).alias("_units"), _bigrams(_words(body)).alias("_grams"))
    rows = rows.withColumn("_hits", marked(F.col("_grams")))
    of_units = F.flatten(F.transform("_units", compare))
    of_windows = F.flatten(F.transform(known, lambda k: F.transform(starts(F.col("_hits"), k), lambda s: _dice(k, F.slice(F.col("_grams"), s + 1, k["size"])))))
    found = F.concat(of_units, F.when(F.size("_hits") > 0, of_windows).otherwise(F.array().cast(MATCHES)))
    rows = rows.select("_kept", F.filter(found, lambda m: m["dice"] >= threshold).alias("_found"))
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["license"])))
    best = F.transform(names, lambda n: F.struct(n.alias("license"), F.array_max(F.transform(F.filter("_found", lambda m: m["license"] == n), lambda m: m["dice"])).alias("dice")))
    return rows.select(*[F.col(f"_kept.`{c}`").alias(c) for c in docs.columns if c != "license_matches"], best.alias("license_matches"))


def report(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """One row per row of `docs`: doc_id, n_matches, licenses (sorted, comma-joined), best_license, best_dice.

    n_matches counts licences. The best match has the highest coefficient, ties go to the first name; without a match it
    is null, licenses is empty and n_matches 0. Rows with a null doc_id stay; repeated rows each give a row; an empty
    table gives none.
    """
    found = scan(docs.select("doc_id", "text"), templates, threshold)
    best = F.array_sort(F.transform("license_matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    return found.select(
        "doc_id",
        F.size("license_matches").cast("long").alias("n_matches"),
        F.array_join(F.transform("license_matches", lambda m: m["license"]), ",").alias("licenses"),
        F.try_element_at(best, F.lit(1))["license"].alias("best_license"),
        F.round(-F.try_element_at(best, F.lit(1))["d"], 6).alias("best_dice"),
    )
