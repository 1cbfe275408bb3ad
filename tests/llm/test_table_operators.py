"""SimHash, search, chats, packing, token files and the pipeline against plain loops, with the odd cases."""

from __future__ import annotations

import functools
import hashlib
import json
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from waterlens.llm import chat_format, packing, queries, simhash, token_encoding, token_files, topk_search
from waterlens.llm.common import new_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd(spark, docs):
    rows = [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, LONG), (905, LONG + "x"), (None, "no id here"), (None, "one two"), (903, "one two")]
    return docs.select("doc_id", "text").union(spark.createDataFrame(rows, DOCS)).withColumns({c: F.lit(1) for c in ("fp", "component_id", "u", "ids", "length", "part", "_kept")})


# -- near duplicates


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        least[root(k)].append(doc)
    return [(doc, f"{fp:016x}", min((d for d in least[root(k)] if d is not None), default=None)) for k, (doc, fp) in enumerate(rows)]


def test_components_equal_a_loop(spark, docs):
    given = odd(spark, docs)
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in given.collect()]
    found = simhash.report(given).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == Counter(plain_components(rows))
    assert simhash.report(given.where("false")).count() == 0


def test_links_are_found_at_every_distance(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(6)]
    values += [values[0] ^ ((1 << k) - 1) for k in range(1, 40)]
    values = sorted(set(values))
    edges = simhash.links(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long"))
    found = {r["u"]: r["v"] for r in simhash.components(edges).collect()}
    label = {v: found.get(s, s) for v in values for s in [v - (1 << 64) if v >> 63 else v]}
    expected = plain_components(list(enumerate(values)))
    groups = lambda pairs: Counter(frozenset(g) for g in _grouped(pairs))
    assert groups((v, label[v]) for v in values) == groups((values[d], c) for d, _, c in expected)


def _grouped(pairs):
    out = defaultdict(set)
    for member, name in pairs:
        out[name].add(member)
    return out.values()


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    tree = simhash.BKTree(values.tolist())
    assert all((values[at].item() ^ values[child].item()).bit_count() == edge for at, children in enumerate(tree.children) for edge, child in children.items())
    for radius in (0, 1, 3):
        found = {(k, int(q)) for k, near in tree.within(values, radius) for q in near}
        assert found == {(k, q) for q, value in enumerate(values.tolist()) for k in tree.near(value, radius)}
        assert found == {(a, b) for a in range(len(values)) for b in range(len(values)) if int(values[a] ^ values[b]).bit_count() <= radius}


def plain_similarities(texts):
    """Jaccard similarity of five-word shingles for every pair that shares one."""
    sets = {}
    for doc, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[doc] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for k, b in enumerate(ids) for a in ids[:k]}


def test_near_copies_group_and_others_do_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 4000")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    group = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(docs).collect()}
    assert group.keys() == texts.keys()
    similar = plain_similarities(texts)
    near = [group[a] == group[b] for (a, b), j in similar.items() if j >= 0.8]
    assert len(near) > 10 and sum(near) / len(near) > 0.95
    best = defaultdict(float)
    for (a, b), j in similar.items():
        best[a], best[b] = max(best[a], j), max(best[b], j)
    sizes = Counter(group.values())
    assert all(sizes[group[d]] == 1 for d in texts if best[d] < 0.3 and texts[d].split())
    assert all(group[d] == min(k for k in texts if group[k] == group[d]) for d in list(texts)[::25])


def linked(pairs):
    """The least member of each node's component."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return find


def test_no_link_under_the_similarity_is_used(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for n in range(60):  # pairs at about 0.7, and groups of many copies at 0.9 with a rim about 0.7 from each other
        base = [word() for _ in range(200)]
        texts[100 * n], texts[100 * n + 1] = " ".join(base), " ".join(base[: 164 + n % 8] + [word() for _ in range(36 - n % 8)])
    base = [word() for _ in range(300)]
    for k in range(40):
        copy = list(base)
        for at in rng.sample(range(0, 300, 10), 1 + k % 7):
            copy[at] = word()
        texts[10_000 + k] = " ".join(copy)
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    similar = plain_similarities(texts)
    find = linked([p for p, j in similar.items() if j >= 0.8])
    assert sum(0.6 <= j < 0.8 for j in similar.values()) > 60
    expected = {d: find(d) for d in texts}
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(given, exhaustive=True).collect()} == expected
    group = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(given).collect()}
    assert all(expected[g] == expected[d] for d, g in group.items())  # never more than is similar
    assert sum(group[d] == expected[d] for d in texts) / len(texts) > 0.97


def test_a_farther_partner_links_when_closer_ones_fail(spark):
    """Each text has five partners just under the similarity that come first, and one at it: further passes get to it."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, wanted = {}, []
    for n in range(20):
        base = [word() for _ in range(220)]
        texts[100 * n] = " ".join(base)
        for k in range(1, 6):  # one run of new words: J just under 0.8
            texts[100 * n + k] = " ".join(base[: 190 + k] + [word() for _ in range(30 - k)])
        texts[100 * n + 9] = " ".join(base[:176] + [word() for _ in range(12)] + base[188:])
        wanted.append((100 * n, 100 * n + 9))
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    find = linked([p for p, j in plain_similarities(texts).items() if j >= 0.8])
    group = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(given).collect()}
    assert all(group[a] == group[b] for a, b in wanted)
    assert sum(group[d] == find(d) for d in texts) / len(texts) > 0.97


def test_case_and_blanks_tell_no_units_of_a_lower_casing_vocabulary_apart():
    encoder = token_encoding.Encoder(token_encoding.default_path("word_bpe_49k.json"))
    texts = ["Word word WORD\nword Word", " word", "word", "\n", " ", "", None, "  word", "WORD", "it's IT'S \u0301a A\u0301 \u0130 7 \u03a3\u03a3 K\u212a", " .Word", "x" * 400]
    found = [(ids, sizes) for _, ids, sizes in encoder.slices(pa.array(texts, type=pa.string()), 1)]
    assert len(found) == 1 and [len(encoder.whole(t or "")) + 1 for t in texts] == found[0][1].tolist()
    assert found[0][0].tolist() == [i for t in texts for i in [*encoder.whole(t or "").tolist(), 1]]
    assert [u for u in encoder.known if u.strip().lower() == "word"] == ["word"]


@pytest.mark.parametrize(("window", "exhaustive"), [(simhash.WINDOW, False), (5, False), (5, True)])
def test_no_partner_is_dropped_after_many_that_fail(spark, monkeypatch, window, exhaustive):
    """Forty texts just under the similarity with each other and their base; two of them are at it, at no special place in
    the order of sketches, and no pass before links any."""
    monkeypatch.setattr(simhash, "WINDOW", window)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for n in range(12):
        base = [word() for _ in range(220)]
        texts[100 * n] = " ".join(base)
        rims = [[word() for _ in range(25)] for _ in range(40)]
        rims[30][0] = rims[7][0]  # 192 of 240 shingles; all others 191 of 241
        texts |= {100 * n + 1 + k: " ".join(base[:195] + rim) for k, rim in enumerate(rims)}
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(given, exhaustive=exhaustive).collect()}
    assert group == {d: d - 23 if d % 100 == 31 else d for d in texts}


def test_parities_differ_in_no_more_places_than_sets(spark):
    rng = np.random.default_rng(15)
    for size, other in ((1, 1), (50, 45), (700, 600), (5000, 5000)):
        left = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        right = np.unique(np.concatenate((left[: size // 2], rng.integers(0, 1 << 63, other, dtype=np.uint64))))
        differ = int.from_bytes(simhash.parities(left)) ^ int.from_bytes(simhash.parities(right))
        assert differ.bit_count() <= len(np.setxor1d(left, right))


def test_groups_do_not_hang_on_windows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = sorted(map(tuple, simhash.similar_groups(docs).collect()))
    monkeypatch.setattr(simhash, "TOGETHER", 0)
    assert sorted(map(tuple, simhash.similar_groups(docs).collect())) == expected  # scans find what trees find
    monkeypatch.setattr(simhash, "WINDOW", 20)
    copies = [(5000 + k, f"{' '.join(f'w{i}' for i in range(200))} tail{k}") for k in range(300)]  # one key of 300 rows
    given = docs.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id long, text string"))
    group = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(given).collect()}
    assert {group[k] for k, _ in copies} == {5000}
    assert sorted(p for p in group.items() if p[0] < 5000) == expected


def test_a_large_shard_takes_bounded_time():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 63, (10_000, 2), dtype=np.uint64)
    words = np.concatenate((words, words ^ np.array([1, 8], dtype=np.uint64)))
    started = time.perf_counter()
    leader, far = simhash._led(words, 20)
    assert time.perf_counter() - started < 30
    assert ((leader >= 0).sum() == 10_000) and (far[leader >= 0] == 2).all()


def test_recall_of_copies_with_a_fifth_appended(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for n in range(1000):
        base = [word() for _ in range(100)]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(base + [word() for _ in range(24)]))]  # 96 of 120 shingles
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1")
    assert found.where("group_id = doc_id - 1").count() >= 985 and found.where("group_id NOT IN (doc_id, doc_id - 1)").count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    given = odd(spark, docs)
    kept = simhash.deduplicate(given)
    assert kept.columns == given.columns
    found = Counter(r["doc_id"] for r in kept.collect())
    groups = {r["group_id"] for r in simhash.similar_groups(given).collect()}
    assert {k for k in found if k is not None} == groups and all(n == 1 for k, n in found.items() if k is not None) and found[None] == 2
    assert simhash.deduplicate(given.where("false")).count() == 0
    rows = [(7, "one text of seven", 1), (7, "another text of seven here", 2), (8, "words of eight", 3)]
    picks = [simhash.deduplicate(spark.createDataFrame(some, "doc_id long, text string, n int").repartition(3)).collect() for some in (rows, rows[::-1])]
    assert sorted(picks[0]) == sorted(picks[1]) and sorted(r["doc_id"] for r in picks[0]) == [7, 8]


# -- search


def plain_search(rows, k=20, every=20):
    usable = {}
    for n, (vec, values) in enumerate(rows):
        if vec is not None and values and all(x is not None and np.isfinite(x) for x in values):
            usable[n] = vec, [int(np.floor(64 * float(x))) for x in values]
    out = []
    for vec, q in {(v, tuple(q)) for v, q in usable.values() if v % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), other) for other, c in usable.values() if other != vec and len(c) == len(q))
        out += [(vec, rank + 1, other, -score) for rank, (score, other) in enumerate(scored[:k])]
    return Counter(out)


def test_search_equals_a_loop(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    rows += [(1000, None), (1020, [None] * 64), (1040, [float("nan")] * 64), (1060, [float("inf")] + [0.0] * 63), (None, [0.1] * 64), (1080, [0.5, 0.25]), (1081, [0.5, -0.25]), (1100, []), (1120, [1e7] * 64), (1140, [0.25] * 64), (1140, [-0.25] * 64), (1140, [0.25] * 64)]
    rows += [(2000 + k, rows[1][1]) for k in range(60)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("kth", F.lit(1))
    for shard, block in ((topk_search.SHARD, topk_search.BLOCK), (97, 7)):
        found = topk_search.search(given, shard=shard, block=block).collect()
        assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == plain_search(rows)
    assert topk_search.search(given.where("false")).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-900_000, 900_000) for _ in range(8)]) for k in range(60)]
    rows += [(100, [float(1 << 21), 1.0]), (101, [1.5, 2.0]), (120, [1.0, 0.5]), (121, [-float(1 << 40), 2.0])] + [(200 + k, [k * 1e-3, 1.0]) for k in range(30)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard, block in ((topk_search.SHARD, topk_search.BLOCK), (7, 3)):
        found = topk_search.search(given, shard=shard, block=block).collect()
        assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == plain_search(rows)
    assert next(r["vec_id"] for r in found if r["query_id"] == 120 and r["rank"] == 1) == 100
    with pytest.raises(Exception, match="passes a long"):
        topk_search.search(given.union(spark.createDataFrame([(300, [1e12, 1e12])], given.schema)).where("vec_id IN (100, 300)")).collect()


# -- chats

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>x", "<\\s> [\\\\INST] \\", "<<SYS>> a <</SYS>>", "", "é🙂\n\n", "<<s>", "$1 \\$2"]


def digests(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_read_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (3, 0, "a\\n\nb<|im_end|>", "x"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (4, None, "user", "first"), (4, 0, "user", "second"), (5, 0, "assistant", LONG)]
    rows += [(6, k, "assistant", f"turn {k}") for k in range(70)] + [(7, 0, "user", "same"), (7, 0, "user", "same")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1])):
        by[conv].append((role, text))
    found = {r["conv_id"]: r for r in chat_format.report(given.withColumn("node", F.lit(1))).collect()}
    assert found.keys() == by.keys()
    for conv, turns in by.items():
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns), conv
        assert r["formatted_chars"] > sum(len(t or "") for _, t in turns)
    assert chat_format.report(given.where("false")).count() == 0


def test_chat_query_holds_every_conversation(spark):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by[r["conv_id"]].append((r["role"], r["text"]))
    by[-1] = [("user", NASTY[0]), ("assistant", NASTY[0])]
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op6_chat_format(spark, SMALL).collect()}
    assert found == {conv: digests(turns) for conv, turns in by.items()}


def test_control_strings_never_stand_inside_a_turn(spark):
    given = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(NASTY)], "conv_id long, turn long, role string, text string")
    text = chat_format.format_messages(chat_format.threads(given)).first()["formatted"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(NASTY) and "[INST]" not in text and "</s>" not in text


def test_best_branches_of_a_tree(spark):
    #      1 - 2 - 4, 1 - 3 - 5, 1 - 3 - 6; 7 and 8 answer each other; 9 answers a message that is not there
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 0.1), (1, 3, 1, "assistant", "c", 0.9), (1, 4, 2, "user", "d", 0.2), (1, 5, 3, "user", "e", 0.3), (1, 6, 3, "user", "f", 0.3), (1, 7, 8, "user", "g", 9.0), (1, 8, 7, "user", "h", 9.0), (1, 9, 77, "user", "i", 0.05)]
    messages = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    found = {r["branch"]: [t["text"] for t in r["turns"]] for r in chat_format.format_messages(messages, branches=3).withColumn("turns", chat_format.parse(F.col("formatted"))).collect()}
    assert found == {1: ["a", "c", "e"], 2: ["a", "c", "f"], 3: ["a", "b", "d"]}


# -- tokens


def test_cached_encoding_equals_the_library():
    rng, letters = random.Random(4), "abAB éÉßñ.,'\n\"!?12_-\t🙂́日 \x1c﻿İΣ"
    texts = ["", " ", "\n", " a", "a ", "a\nb", "it's they'll", "a  b", "a\n b", "a \nb", "<|endoftext|> x", "naïve Été ǅ ß ẞ", "café", "12 345 6.7", "…—“q”", "ª º µ ÿ × ÷"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for as_text in (False, True):
            encoder = token_encoding.Encoder(token_encoding.default_path(name), as_text, cache_bytes=100_000)
            first, ids, sizes = next(encoder.slices(pa.array(texts)))
            assert first == 0 and [t for t, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True) if not np.array_equal(got, encoder.whole(t))] == []
        plain = Tokenizer.from_file(token_encoding.default_path(name))  # the library untouched
        encoder = token_encoding.Encoder(token_encoding.default_path(name))
        assert [t for t in texts if encoder.encode(t).tolist() != plain.encode(t, add_special_tokens=False).ids] == []
    assert 50256 in token_encoding.Encoder(token_encoding.default_path("byte_bpe_50k.json")).encode("hello <|endoftext|> world")
    assert 50256 not in token_encoding.Encoder(token_encoding.default_path("byte_bpe_50k.json"), True).encode("hello <|endoftext|> world")


def test_slices_and_evictions_change_nothing(monkeypatch):
    rng = random.Random(9)
    texts = [None, "", *[" ".join(rng.choice(["ab", "Cd.", "e-f", "<|endoftext|>", "x" * 1500, "ü,", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]]
    path = token_encoding.default_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(token_encoding, "SLICE_BYTES", 1000)
    encoder, found, n = token_encoding.Encoder(path, cache_bytes=2000), [], 0
    for first, ids, sizes in encoder.slices(pa.array(texts, type=pa.string()).slice(1), end_id=0):
        assert first == len(found)
        found += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        n += 1
    assert n > 10 and found == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts[1:]]


@functools.lru_cache
def plain_tokenizer(name):
    return Tokenizer.from_file(token_encoding.default_path(name))


def plain_ids(name, text, end):
    return np.array([*plain_tokenizer(name).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_fullest_combination_equals_a_search():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        found = packing.fullest(counts, room)
        assert sum(a * b for a, b in found) == max(sums) and all(n <= counts[x] for x, n in found)


def test_packing_is_valid_tight_and_whole(spark, docs):
    given = odd(spark, docs).where("doc_id IS NULL OR doc_id <> 904")
    found = packing.report(given).collect()
    expected = Counter()
    for r in given.collect():
        ids = plain_ids("byte_bpe_50k.json", r["text"], 0)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected.update((r["doc_id"], n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert packing.report(given.where("false")).count() == 0


def test_packed_sequences_hold_the_ids(spark, docs):
    given = docs.limit(40)
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    found = packing.sequences(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    assert sum(r["n_tokens"] for r in found) == sum(len(plain_ids("byte_bpe_50k.json", t, 0)) for t in texts.values())
    assert all(len(r["ids"]) == r["n_tokens"] <= 2048 for r in found)


def test_token_files_read_back(spark, docs):
    given = odd(spark, docs).where("doc_id IS NULL OR doc_id < 904")
    path = new_path(spark, "test-tokens")
    token_files.write(given, path)
    at, expected = 0, []
    rows = sorted((r for r in given.collect()), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    for r in rows:
        ids = plain_ids("word_bpe_49k.json", r["text"], 1)
        expected.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digest(spark, path).where("doc_id IS NOT NULL").collect())
    assert found == sorted(e for e in expected if e[0] is not None)
    assert token_files.digest(spark, path).count() == len(rows)
    one = token_files.read(spark, path, [17]).collect()
    assert [list(r["ids"]) for r in one] == [plain_ids("word_bpe_49k.json", texts[17], 1).tolist()]
    assert "In(doc_id, [17])" in token_files.read(spark, path, [17])._jdf.queryExecution().toString() or "EqualTo(doc_id,17)" in token_files.read(spark, path, [17])._jdf.queryExecution().toString()
    empty = new_path(spark, "test-tokens")
    token_files.write(given.where("false"), empty)
    assert token_files.digest(spark, empty).count() == 0


def test_token_files_hold_stripes_runs_indexes_and_bloom_filters(spark):
    rows = spark.range(24_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of text"), "id", F.repeat(F.lit(" tail"), 40)).alias("text"))
    path = new_path(spark, "test-tokens")
    token_files.write(rows.coalesce(1), path, stripe_bytes=64 << 10, row_group=1000)
    orc, conf = spark._jvm.org.apache.orc.OrcFile, spark._jsc.hadoopConfiguration()
    files = [f for f in spark.read.orc(path).inputFiles()]
    stripes, kinds, encodings = 0, set(), set()  # the writer looks at its size every 5000 rows
    for name in files:
        reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(name), orc.readerOptions(conf))
        records = reader.rows()
        assert reader.getRowIndexStride() == 1000
        for stripe in reader.getStripes():
            footer = records.readStripeFooter(stripe)
            kinds |= {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
            encodings |= {(k, str(e.getKind())) for k, e in enumerate(footer.getColumnsList())}
            stripes += 1
    assert stripes > 1
    assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8")} <= kinds and not any(k != 1 and "BLOOM" in s for k, s in kinds)
    assert (1, "DIRECT_V2") in encodings and (6, "DIRECT_V2") in encodings  # doc_id and the ids: integer runs
    assert token_files.read(spark, path, [77]).count() == 1


# -- pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    extra = spark.createDataFrame([(900, None, "en", "s", None), (901, "12 34", None, None, 5), (902, "token = abcdefgh12345", "en", "s", 21), (903, None, None, None, None)], docs.schema)
    given = docs.union(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "secret_scan", "packing"]
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, SMALL).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        frames.append(given)
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] == {r["doc_id"] for r in docs.collect()} | {902}
    assert ids[1] == {r["group_id"] for r in simhash.similar_groups(frames[0]).collect()}
    leaked = {r["doc_id"] for r in queries.op2_decontamination(spark, SMALL).where("contaminated").collect()}
    assert ids[2] == ids[1] - leaked and ids[3] == ids[2] == ids[4]
    assert {r["doc_id"]: r["text"] for r in frames[3].collect()}[902] == "[SECRET]"
    assert frames[4].columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_pipeline_takes_an_empty_table(spark, docs, tmp_path):
    given = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, SMALL).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
    assert given.count() == 0


def test_query_names_and_columns(spark):
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 14)] and "pipeline" in names
    assert json.dumps(sorted(set(entry.oracle_sql()) - set(names))) == "[]"
