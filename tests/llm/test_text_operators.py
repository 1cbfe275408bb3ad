"""License, decontamination, secrets, language and toxicity against plain loops, with the odd cases of the contract."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waterlens.llm import decontaminate, language_id, license_scan, license_texts, queries, secrets, toxicity

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
LONG = "lorem ipsum " * 40_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd(spark, texts):
    """Given texts with nulls, an empty and a very long text, a repeated row and columns with clashing names."""
    rows = [*enumerate(texts), (900, None), (901, ""), (902, LONG), (None, "no id"), (0, texts[0])]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("leak", "license_matches", "fp", "_kept", "score", "lang_pred", "spans", "n_hit", "rank")
    return df.withColumns({c: F.lit(None).cast("int") for c in clash})


# -- licenses


def dice(a, b):
    common = sum((Counter(a) & Counter(b)).values())
    return 2 * common / (len(a) + len(b))


def plain_licenses(text, threshold=0.9):
    text = text or ""
    grams_of = license_scan.template_bigrams
    units = [grams_of(u) for u in dict.fromkeys([*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text])]
    whole = grams_of(text)
    at = {}
    for i, g in enumerate(whole):
        at.setdefault(g, []).append(i)
    best = {}
    for name, body in license_texts.TEMPLATES:
        other = grams_of(body)
        starts = {max(i - place, 0) for place, g in license_scan.anchors(other, threshold) for i in at.get(g, ())}
        for unit in units + [whole[s : s + len(other)] for s in starts]:
            if unit and dice(unit, other) >= threshold:
                best[name] = max(best.get(name, 0), dice(unit, other))
    return len(best), ",".join(sorted(best)), min((-d, n) for n, d in best.items())[1] if best else None


def commented(body, sign):
    return "\n".join(f"{sign} {line}" for line in body.split("\n"))


def test_licenses_equal_a_loop(spark, docs):
    notices = license_texts.NOTICES
    texts = ["Released under the MIT License.", "a\nreleased UNDER the mit license\nb", "Licensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, Version 2.0.", "Released under the the MIT License.", "MIT", notices["MPL-2.0"].replace("terms", "rules")]
    texts += [f"int main() {{}}\n{commented(b, '//')}\nreturn 0;" for b in license_texts.BODIES.values()]
    given = odd(spark, texts).select("doc_id", "text").union(docs.select("doc_id", "text"))
    texts = {(r["doc_id"], i): r["text"] for i, r in enumerate(given.collect())}
    found = license_scan.report(given).collect()
    assert Counter((r["doc_id"], r["n_matches"], r["licenses"], r["best_license"]) for r in found) == Counter((k[0], *plain_licenses(t)) for k, t in texts.items())
    assert license_scan.report(given.where("false")).count() == 0


def test_words_looked_for_cover_every_anchor(spark):
    marks = license_scan._known(license_texts.TEMPLATES, 0.9)[1]
    words, bigrams = license_scan.cover(marks)
    assert all(set(g.split(" ")) & set(words) or g in bigrams for g in marks) and len(words) < len(marks) / 2
    assert license_scan.cover(["ab cd"]) == ([], ["ab cd"])


def test_tags_and_sentences_name_licenses(spark):
    wanted = {
        "// SPDX-License-Identifier: Apache-2.0\nint main() {}": "Apache-2.0", "# SPDX-License-Identifier: MIT": "MIT", "/* SPDX-License-Identifier: GPL-3.0-or-later */": "GPL-3.0",
        "The MIT License (MIT)\n\nCopyright (c) 2020 Foo": "MIT", "## License\n\nThis project is licensed under the MIT license - see the file LICENSE.": "MIT",
        "It is Licensed under the Apache License 2.0, as is its documentation.": "Apache-2.0", "Copyright 2019 Bar. Licensed under the GNU GPLv3.": "GPL-3.0", "code licensed under the BSD 3-Clause license": "BSD-3-Clause",
        "The licence to drive; a license under the law.": "", "MIT is a university.": "", "identifier: apache": "",
    }
    found = license_scan.report(spark.createDataFrame(list(enumerate(wanted)), DOCS)).collect()
    got = {r["doc_id"]: (r["best_license"] or "") for r in found}
    assert got == dict(enumerate(wanted.values()))


def test_copies_with_changed_words_are_found(spark):
    """Of copies of every licence inside other text with one word in forty changed, at least 0.95 are found."""
    rng = random.Random(9)
    names = list(license_texts.BODIES)
    rows = []
    for k in range(300):
        words = license_texts.BODIES[names[k % len(names)]].split()
        for at in rng.sample(range(len(words)), len(words) // 40):  # a changed word is two changed bigrams
            words[at] = rng.choice(("colour", "sample", "herewith"))
        rows.append((k, f"Some words before it.\n{' '.join(words)}\nAnd after it."))
    found = {r["doc_id"]: r["licenses"].split(",") for r in license_scan.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(names[k % len(names)] in found[k] for k, _ in rows) >= 0.95 * len(rows)


def test_licenses_inside_files(spark):
    mit, apache = license_texts.BODIES["MIT"], license_texts.BODIES["Apache-2.0"]
    edited = mit.replace("software and associated", "library and its").replace("AUTHORS OR", "OWNERS OR")
    cases = {
        "MIT": [f"The MIT License\n\nCopyright 2020 A. Person\n{mit}", f"import os\n{commented(mit, '#')}\nx = 1", f"one line of code {' '.join(mit.split())} and more code after it", edited,
                "Copyright 2020 Foo. Released under the MIT License. All rights reserved."],
        "Apache-2.0": [f"/*\n{commented(apache, ' *')}\n */\nclass A {{}}", 'Licensed under the Apache License, Version 2.0 (the "License");'],
        "": ["The license plate was released under the bridge, and permission to use the software was granted free of charge.", mit[: len(mit) // 2], "warranties of merchantability fitness for a particular purpose " * 50],
    }
    wanted = [(name, text) for name, texts in cases.items() for text in texts]
    found = license_scan.report(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(wanted)], DOCS)).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == {i: name for i, (name, _) in enumerate(wanted)}


# -- decontamination


def plain_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = words(text)
    hit, found = set(), set()
    for item, body in items:
        tokens = words(body)
        size = min(window, len(tokens))
        for k in range(len(tokens) - size + 1 if size else 0):
            for at in range(len(own) - size + 1):
                if own[at : at + size] == tokens[k : k + size]:
                    hit.update(range(at, at + size))
                    found.update([] if item is None else [item])
    return len(own), len(hit), sorted(found)


ITEMS = [(1, "the Quick brown fox jumps over the lazy dog near a river bank"), (12, "short item"), (3, None), (None, "unnamed item of four words"), (2, "..."), (12, "short item"), (5, "Ünïcode é1")]
TEXTS = ["x the quick brown fox jumps, over the lazy dog near A RIVER bank y", "a SHORT-item short item", "quick brown fox", "unnamed item of four words ünïcode É1 ünïcode é1", "b short"]


def test_hits_equal_a_loop_by_broadcast_and_by_join(spark):
    given = odd(spark, TEXTS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = Counter((r["doc_id"], *plain_hits(r["text"], ITEMS)[:2], tuple(plain_hits(r["text"], ITEMS)[2])) for r in given.collect())
    for limit in (decontaminate.BROADCAST_CHARS, 0):
        found = decontaminate.report(given, bench, broadcast_chars=limit).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in found) == expected
    assert decontaminate.report(given, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.report(given.where("false"), bench).count() == 0


def test_decontamination_query_equals_a_loop(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"]) < 2500}
    for r in queries.op2_decontamination(spark, SMALL).collect():
        if r["doc_id"] in texts:
            n, hit, found = plain_hits(texts[r["doc_id"]], items)
            digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), digest, hit > 0)


def test_leaks_are_dropped_or_cut(spark):
    given = odd(spark, TEXTS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_CHARS, 0):
        kept = decontaminate.decontaminate(given, bench, "documents", broadcast_chars=limit)
        assert kept.columns == given.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter([2, 4, 900, 901, 902, None])
        cut = decontaminate.decontaminate(given, bench, "spans", broadcast_chars=limit)
        assert cut.columns == given.columns and cut.count() == given.count()
        texts = {r["doc_id"]: r["text"] for r in cut.collect()}
        assert texts[1] == "a  " or texts[1].replace(" ", "") == "a"
        assert texts[0] == "x  y" and texts[2] == TEXTS[2] and texts[900] is None and texts[902] == LONG
        marked = decontaminate.annotate(given, bench, broadcast_chars=limit)
        assert sorted(marked.columns) == sorted(given.columns) and marked.where("leak.n_words = 0").count() == 2


def test_rows_are_judged_one_by_one_on_both_sides_of_the_limit(spark):
    rows = [(1, "clean words only"), (1, TEXTS[0]), (None, TEXTS[0]), (None, "clean as well"), (2, None)]
    given, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_CHARS, 0):
        kept = decontaminate.decontaminate(given, bench, broadcast_chars=limit).collect()
        assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([rows[0], rows[3], rows[4]])
        assert decontaminate.report(given, bench.where("false"), broadcast_chars=-1 if limit == 0 else limit).where("n_hit = 0 AND n_words >= 0").count() == 5


# -- secrets


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


SECRETS = [
    "é password = 'abcdefgh1' and TOKEN:x and token=12345678", "ſecret=abcdefghij toKen=abcdefghij", "AKIAAKIAAKIAAKIA1 AKIA AKIA123", "f" * 31 + "g" + "0" * 32 + "F" + "a" * 40,
    'db_pwd: "Tr0ub4dor&3"', "k = 'Zx81Qw77Lm'\nauth_token_value = k\n", 'private_key = "aB3" + "dE6gH9kL2" + "x"', "password: ${VAULT}\nclient_secret_name = production1", "api__key=abcdefgh password=short token",
]


def test_secret_spans_equal_a_loop(spark, docs):
    given = odd(spark, SECRETS).select("doc_id", "text").union(docs.select("doc_id", "text"))
    found = secrets.report(given)
    joined = Counter((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in found.collect())
    expected = Counter()
    for r in given.collect():
        base = plain_secrets(r["text"])
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        expected[r["doc_id"], hashlib.sha256(base.encode()).hexdigest(), kinds["assign"], kinds["access"], kinds["hex"]] += 1
    assert joined == expected
    assert secrets.report(given.where("false")).count() == 0


def test_named_literals_are_found_through_constants():
    named = lambda t: [t[a:b] for a, b, k in secrets.find(t) if k == "named"]
    assert named(SECRETS[4]) == ["Tr0ub4dor&3"]
    assert named(SECRETS[5]) == ["Zx81Qw77Lm"]
    assert named(SECRETS[6]) == ["aB3", "dE6gH9kL2", "x"]
    assert named("primary_key = 'customer_id_1'\npassword_hint: 'first-Pet99'\nname = 'Zx81Qw77Lm'") == []
    assert named("The token: of appreciation. A key = word") == []


def test_no_tail_of_a_named_literal_stays():
    assert secrets.redact('password = "Tr0ubador!x9#Zq7" # x') == "[SECRET]\" # x"
    assert secrets.joined(secrets.find('password = "Tr0ubador!x9#Zq7"')) == "assign:0:21,named:12:28"
    long = "aB3!xQ9z" * 1000
    name = "n" * 80 + "_password"
    for text in (f'db_pwd = "{long}"', f"{name} = 'Zx81!w77Lm'", f"db_pwd{' ' * 20}={' ' * 20}'Zx81!w77Lm'", "db_pwd = " + "aB3-xQ9z" * 1000):
        assert [k for _, _, k in secrets.find(text)] == ["named"] and "Zx81" not in secrets.redact(text) and "aB3" not in secrets.redact(text)


NAMED = {  # text: the named literals in it
    'db_pwd = (\n    "aB3!"  # first\n    "dE6gH9kL2"\n)': ["aB3!", "dE6gH9kL2"],
    'db_pwd = "aB3!" +  // more\n  "dE6gH9kL2";': ["aB3!", "dE6gH9kL2"],
    'db_pwd = "aB3!\\\ndE6gH9kL2"': ["aB3!\\\ndE6gH9kL2"],
    'db_pwd = """\naB3!dE6gH9kL2\n"""': ["aB3!dE6gH9kL2"],
    "tls:\n  private_key: |\n    MIIEv!QIBADANBg\n    kqhkiG9w!0BAQE\n  name: Zx81!w77Lm": ["MIIEv!QIBADANBg", "kqhkiG9w!0BAQE"],
    "<db_pwd>Zx81!w77Lm</db_pwd>": ["Zx81!w77Lm"],
    '<add key="db_pwd" value="Zx81!w77Lm"/>': ["Zx81!w77Lm"],
    "- name: DB_PWD\n  value: 'Zx81!w77Lm'": ["Zx81!w77Lm"],
    '{"name": "db_pwd", "value": "Zx81!w77Lm"}': ["Zx81!w77Lm"],
    "db_pwd: str = 'Zx81!w77Lm'": ["Zx81!w77Lm"],
    "config['db_pwd'] = 'Zx81!w77Lm'": ["Zx81!w77Lm"],
    "run --db-pwd='Zx81!w77Lm' now": ["Zx81!w77Lm"],
    "K='Zx81!w77Lm'\nexport DB_PWD=$K": ["Zx81!w77Lm"],
    "k = 'Zx81!w77Lm'\ndb_pwd = f'{k}'": ["Zx81!w77Lm"],
    "k = 'Zx81!w77Lm'\nk = k + k\ndb_pwd = k": ["Zx81!w77Lm"],
    "# db_pwd = 'Zx81!w77Lm'": ["Zx81!w77Lm"],
    """conn = "host=h db_pwd='Zx81!w77Lm' x=1" """: ["Zx81!w77Lm"],
    "db_pwd = os.getenv('DB_NAME_1')": [],
    "db_pwd = settings.db.pwd": [],
    "db_pwd == 'Zx81!w77Lm'": [],
    "name: x\nvalue: 'Zx81!w77Lm'": [],
    "export DB_PWD=Zx81!w77Lm": ["Zx81!w77Lm"],
    "  - db_pwd: Zx8,!w;7Lm  # note": ["Zx8,!w;7Lm"],
    "db_pwd: Zx81!w77Lm,\nx: 1": ["Zx81!w77Lm"],
    "x = ['Zx81!w77Lm', 'b']; db_pwd = x[0]": ["Zx81!w77Lm"],
    "x = {'a': 'Zx81!w77Lm'}\ndb_pwd = x['a']": ["Zx81!w77Lm"],
    "db_pwds = [\n  'Zx81!w77Lm',  # one\n  'Zx82!w77Lm'\n]": ["Zx81!w77Lm", "Zx82!w77Lm"],
    "db_pwds = {'live': 'Zx81!w77Lm', 'test': 'Zx82!w77Lm'}": ["Zx81!w77Lm", "Zx82!w77Lm"],
    'cfg.set("db_pwd", "Zx81!w77Lm")': ["Zx81!w77Lm"],
    'let db_pwd = String::from("Zx81!w77Lm");': ["Zx81!w77Lm"],
    'Key dbPwd = new SecretKey("Zx81!w77Lm");': ["Zx81!w77Lm"],
    'db_pwd = cfg.lookup("Zx81!w77Lm")': [],
    'db_pwd = join("Zx81!w77Lm", "b")': [],
    "the db_pwd: Zx81!w77Lm was there": [],
    "db_pwd = rows[k!]": [],
    "db_pwd = fetch(a!b)": [],
    "db_pwd = {{vault!pw1}}": [],
    "db_pwd = ": [],
    'db_pwd = "Zx81!w77Lm': [],
    "db_pwd = (": [],
}


@pytest.mark.parametrize("text", NAMED)
def test_assignment_syntax(text):
    assert [text[a:b] for a, b, k in secrets.find(text) if k == "named"] == NAMED[text]


def test_lexer_keeps_pace_in_odd_texts():
    doubled = "k = 'Zx81!w77Lm'\n" + "k = k + k\n" * 5000 + "db_pwd = k"
    repeated = ("a=/*", "a=(", "a='''", "a-", "<a ", "a: |\n", "a=b+", "--", "db_pwd='x'+", 'a="b=\'c=`', "db_pwd = \\\n")
    for text in (doubled, 'a="' * 50_001, *(r * 50_000 for r in repeated)):
        started = time.perf_counter()
        secrets.find(text)
        assert time.perf_counter() - started < 5, text[:20]


#: Lines of files in which {} is a literal: with a sensitive name, and with another.
SYNTAX = (
    ('{n} = "{v}"', "py"), ("{n} = '{v}'  # set", "py"), ("{n}: str = '{v}'", "py"), ("config['{n}'] = '{v}'", "py"), ("x = ['{v}', 'b']\n{n} = x[0]", "py"),
    ("{n} = Secret('{v}')", "py"), ('const {n} = `{v}`;', "js"), ('  "{n}": "{v}",', "json"), ("{n}: {v}", "yaml"), ("  {n}: '{v}'", "yaml"), ("export {n}={v}", "env"),
    ("{n}={v}", "env"), ("{n} = {v} ; note", "ini"), ("<{n}>{v}</{n}>", "xml"), ('<add key="{n}" value="{v}"/>', "xml"), ('cfg.set("{n}", "{v}");', "java"),
    ('String {n} = new String("{v}");', "java"), ('let {n} = String::from("{v}");', "rs"), ('{n} := "{v}"', "go"), ("k = '{v}'\n{n} = k", "py"), ("{n} = ('{v}')", "py"),
)
SENSITIVE = ("db_password", "clientSecret", "AUTH_TOKEN", "smtp.passphrase", "signingKey", "admin_pwd")
OTHERS = ("user_name", "baseUrl", "FILE_PATH", "log.level", "primaryKey", "max_count", "password_hint", "token_type")


def test_planted_secrets_in_generated_files():
    rng = random.Random(8)
    value = lambda: "".join(rng.sample("ABCDEFGHJKMNPQRS", 4) + rng.sample("abcdefghjkmnp", 4) + rng.sample("23456789", 3) + rng.sample("!@%&^~", 2))
    planted = hits = false = 0
    for _ in range(200):
        lines, secret, plain = [], set(), set()
        for _ in range(rng.randint(1, 25)):
            form, v, sensitive = rng.choice(SYNTAX)[0], value(), rng.random() < 0.5
            lines.append(form.format(n=rng.choice(SENSITIVE if sensitive else OTHERS), v=v))
            (secret if sensitive else plain).add(v)
            lines += rng.choice(([], ["# a note: nothing here"], [""], ["return compute(value)"], ["The door was open, and the key lay there."]))
        text = "\n".join(lines)
        spans = secrets.find(text)
        covered = lambda v, text=text, spans=spans: any(a <= text.index(v) and text.index(v) + len(v) <= b for a, b, _ in spans)
        planted, hits, false = planted + len(secret), hits + sum(map(covered, secret)), false + sum(map(covered, plain))
    assert hits >= 0.99 * planted and false == 0, (planted, hits, false)


def test_time_of_a_text_is_linear():
    took = []
    for n in (20_000, 80_000):
        text = 'password = "Abc1!x9#Zq"\n' * n
        started = time.perf_counter()
        assert len(secrets.find(text)) == n
        took.append(time.perf_counter() - started)
    assert took[1] < 7 * took[0]
    started = time.perf_counter()
    secrets.find("It was said: the river = wide, and the key lay at the door. " * 500_000)  # 30 MB
    assert time.perf_counter() - started < 60


def test_redaction_leaves_clean_texts(spark, docs):
    given = odd(spark, SECRETS).withColumn("n_chars", F.length("text").cast("long"))
    clean = secrets.redacted(given)
    assert clean.columns == given.columns and clean.count() == given.count()
    assert secrets.report(clean).where("n_assign + n_access + n_hex + n_named > 0").count() == 0
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[900] == (None, None) and texts[902] == (LONG, len(LONG)) and texts[2][1] == len(texts[2][0])
    same = secrets.redacted(docs).join(secrets.report(docs).where("spans = ''"), "doc_id").join(docs.select("doc_id", F.col("text").alias("old")), "doc_id")
    assert same.where("text <> old").count() == 0


# -- language


def test_language_is_learned_and_held_out(spark):
    found = queries.op9_language_id(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100 and sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.97


def test_language_edge_cases(spark, docs):
    given = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(900, None, None), (901, "", "en"), (902, "12 .. 3", "en"), (903, "a", None), (None, "the of and", None), (904, LONG, None)], DOCS + ", lang string"))
    found = {r["doc_id"]: r for r in language_id.report(given).collect() if r["doc_id"] is None or r["doc_id"] >= 900}
    assert [found[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and found[903]["lang_pred"] != "und"
    assert found[None]["held_out"] is None and all(0 <= r["score"] <= 1 for r in found.values())
    nothing = language_id.report(given.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language_id.report(given.where("false")).count() == 0


def test_rare_languages_are_learned_and_unknown_texts_dropped(spark):
    rows = [(k, f"the quick brown fox number {chr(97 + k % 26)} of the river and the hill", "en") for k in range(20_000)]
    rows += [(20_000 + k, "ein schneller brauner fuchs und der fluss mit dem huegel", "de") for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    assert language_id.fit(docs, training_docs=1).languages == ["de", "en"]
    more = spark.createDataFrame([(30_000, "\u6c34\u4f4d\u6a21\u578b\u8d28\u91cf", None), (30_001, "the hill", None), (30_002, "12", None)], DOCS + ", lang string")
    kept = lambda df: {r["doc_id"] for r in language_id.keep_known(df).where("doc_id >= 30000").collect()}
    assert kept(docs.union(more)) == {30_001}
    assert kept(more) == {30_000, 30_001}


def test_ranks_put_frequent_grams_first_and_ties_by_key():
    keys = language_id.ranked("ab ab c")
    counts = Counter()
    for word in ("ab", "ab", "c"):
        padded = f" {word} "
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                gram = padded[k : k + n]
                if gram.strip() and (n < 3 or gram[1] != " "):
                    counts[gram] += 1
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    assert keys.tolist() == sorted(map(code, counts), key=lambda c: (-next(v for g, v in counts.items() if code(g) == c), c))


def test_language_equals_plain_loops(spark, docs):
    """Profiles and out-of-place distances of the whole query, by loops over strings."""

    def grams(text):
        counts = Counter()
        for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[k : k + 2] for k in range(len(padded) - 1))
            counts.update(padded[k : k + 3] for k in range(len(padded) - 2))
        return counts

    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    best = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:400]
    rows = docs.collect()
    learned = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            learned.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    profiles = {lang: {g: k for k, g in enumerate(best(counts))} for lang, counts in learned.items()}
    found = {r["doc_id"]: r for r in queries.op9_language_id(spark, SMALL).collect()}
    assert len(found) == len(rows)
    for r in rows:
        own, got = best(grams(r["text"])), found[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not own:
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        distance = {lang: sum(min(abs(p[g] - k), 400) if g in p else 400 for k, g in enumerate(own)) for lang, p in profiles.items()}
        lang = min(sorted(distance), key=distance.get)
        assert got["lang_pred"] == lang and abs(got["score"] - (1 - distance[lang] / (400 * len(own)))) < 1e-12


def test_clashing_columns_are_replaced(spark, docs):
    given = docs.select("doc_id", "text", "lang").withColumns({c: F.lit(1) for c in ("lang_pred", "lang_score", "toxicity", "license_matches", "leak")})
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    named = language_id.predict(given, language_id.fit(given))
    for found in (named, toxicity.score(given, toxicity.Model()), license_scan.scan(given), decontaminate.annotate(given, bench)):
        assert sorted(found.columns) == sorted(given.columns)
    assert named.where("lang_pred = '1'").count() == 0


# -- toxicity


def test_grammar_marks_what_governs_a_word():
    model = toxicity.Model(words={"idiot": 5.0})
    kinds = lambda t: [toxicity.OUTPUTS[k] for c in model.clauses(t) for _, k, _ in c]
    assert kinds("idiot") == ["plain"]
    assert kinds("you are an idiot") == ["directed"]
    assert kinds("not an idiot") == ["negated"]
    assert kinds("she said idiot. idiot") == ["reported", "plain"]
    assert kinds("he claimed you are not an idiot") == ["reported"]
    assert kinds("not. idiot") == ["plain"]
    weights = lambda t: [(s, w) for c in model.clauses(t) for s, _, w in c]
    assert weights("idiot idiot") == [("I", 5.0), ("I", 5.5)] and weights("an idiot, one more old idiot") == [("I", 5.0), ("I", 5.0)]
    assert weights("kill") == [("H", 3.5)] and weights("i will surely kill") == [("H", 6.5)] and weights("will you kill") == [("H", 9.7)]
    assert weights("never kill") == [("H", 2.0)] and weights("you idiot") == [("I", 8.2)] and weights("no idiot") == [("I", 3.5)]
    assert weights("kill you") == weights("kill all of you") == [("H", 6.7)] and weights("kill what is left of you") == [("H", 3.5)] and weights("kill. you") == [("H", 3.5)]
    assert kinds("idiot, you") == ["directed"] and kinds("no idiot you") == ["negated"]


#: Clauses of which only the first of each pair is toxic: it is directed, the other negated, reported or at nothing.
PAIRS = [
    ("you are an idiot", "you are not an idiot"), ("you moron", "you are no moron"), ("you are trash", "he told them that you are trash"), ("they are all scum", "she claimed they are scum"),
    ("I will kill you", "I will not kill you"), ("I will kill you", "the frost will kill the plants"), ("we are going to hurt them", "he said we are going to hurt them"), ("wir werden dich töten", "wir werden dich nicht töten"),
]


def test_minimal_pairs_change_sides(spark):
    model = toxicity.fit(*[spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")])
    for toxic, clean in PAIRS:
        assert model.score(toxic) >= toxicity.THRESHOLD > model.score(clean), (toxic, model.score(toxic), clean, model.score(clean))
    assert max(model.score(t) for t in ("", "a kind word to you", "the report said nothing of it", "what will they say")) < toxicity.THRESHOLD


def test_composed_machine_equals_its_parts():
    rng, symbols = random.Random(3), sorted(toxicity.SYMBOLS)
    parts = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported_speech(), toxicity.target()]
    machine = toxicity.grammar()
    for _ in range(300):
        states, state = [p.start for p in parts], machine.start
        for given in (rng.choice(symbols) for _ in range(25)):
            symbol, total = given, 0.0
            for k, part in enumerate(parts):
                states[k], symbol, weight = part.step(states[k], symbol)
                total += weight
            state, out, weight = machine.step(state, given)
            assert (out, weight) == (symbol, total)


def plain_toxicity(rows):
    """Lexicon and features of (text, toxic) rows, by plain loops over the parts of the grammar."""
    tokens = lambda t: re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”«»]", (t or "").lower())
    seen, bad = Counter(), Counter()
    for text, toxic in rows:
        words = {t for t in tokens(text) if len(t) > 1}
        entries = {("w", t) for t in words} | {("s", t[:k]) for t in words for k in (3, 4, 5, 6, 7, 8) if len(t) > k}
        seen.update(entries)
        bad.update(entries if toxic else [])
    base = sum(t for _, t in rows) / len(rows)
    odds = {}
    for e, n in seen.items():
        x, y = bad[e] + 0.5, n - bad[e] + 0.5
        odds[e] = math.log(x / y) - math.log(base / (1 - base)) - math.sqrt(1 / x + 1 / y)
    lexicon = {e: w for e, w in odds.items() if bad[e] >= 3 and w >= 2.0}
    parts = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported_speech(), toxicity.target()]

    def features(text):
        clauses, states, found = [], [p.start for p in parts], []
        for token in [*tokens(text), "."]:
            if token in ".!?;:\n":
                clauses, states, found = [*clauses, found], [p.start for p in parts], []
                continue
            weight = max([lexicon.get(("w", token), 0.0)] + [lexicon.get(("s", token[:k]), 0.0) for k in (3, 4, 5, 6, 7, 8) if len(token) > k])
            groups = ((toxicity.THREATS, "H"), (toxicity.NEGATIONS, "N"), (toxicity.TARGETS, "T"), (toxicity.REPORTS, "R"))
            symbol = "H" if token in toxicity.THREATS else "I" if weight else "M" if token in toxicity.INTENTS else next((s for g, s in groups if token in g), "Q" if token in '"“”«»' else "W")
            weight = max(weight, toxicity.THREAT_WEIGHT) if symbol == "H" else weight
            kind, first = symbol, symbol
            for k, part in enumerate(parts):
                states[k], kind, more = part.step(states[k], kind)
                weight += more
            if first in "IH":
                found.append((first, kind[1], max(weight, 0.0)))
            elif kind == "Td":
                found[-1] = (found[-1][0], "d", found[-1][2] + toxicity.DIRECTED)
        sums = sorted((sum(w for _, _, w in c) for c in clauses), reverse=True) + [0.0, 0.0]
        of = lambda test: math.log1p(sum(w for c in clauses for m in c for w in [m[2]] if test(m)))
        return [sums[0], sums[1], math.log1p(sum(sums)), math.log1p(sum(x >= 3.0 for x in sums)), of(lambda m: m[0] == "H"), *[of(lambda m, g=g: m[1] == g) for g in "dnr"]]

    return lexicon, features


def test_toxicity_equals_plain_loops(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(texts[d], t) for d, t in labels.items() if t is not None and d in texts and zlib.crc32(str(d).encode()) % 3 != 1]
    lexicon, features = plain_toxicity(rows)
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {("w", k): w for k, w in model.words.items()} | {("s", k): w for k, w in model.stems.items()}
    assert lexicon and got.keys() == lexicon.keys() and all(abs(got[e] - w) < 1e-9 for e, w in lexicon.items())
    w = model.coefficients

    def loss(w):
        z = [w[0] + sum(a * b for a, b in zip(w[1:], features(t), strict=True)) for t, _ in rows]
        ridge = 1e-3 * w[0] ** 2 + 0.05 * sum(x * x for x in w[1:])
        return sum(math.log1p(math.exp(-abs(a))) + max(a, 0.0) - y * a for a, (_, y) in zip(z, rows, strict=True)) + 0.5 * ridge

    least = loss(w)
    for k in range(len(w)):
        for step in (-1e-2, 1e-2):
            other = list(w)
            other[k] += step
            if not (0 < k < len(w) - 2 and other[k] < 0):
                assert loss(other) > least - 1e-9
    found = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SMALL).collect()}
    assert found.keys() == texts.keys()
    for doc, text in texts.items():
        score = 1 / (1 + math.exp(-max(-50.0, min(50.0, w[0] + sum(a * b for a, b in zip(w[1:], features(text), strict=True))))))
        r = found[doc]
        assert abs(r["score"] - score) < 1e-9 and r["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_is_learned_and_held_out(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    found = queries.op4_toxicity(spark, MEDIUM).join(labels, "doc_id").where("held_out").collect()
    bad = [r["predicted"] for r in found if r["toxic"]]
    good = [r["predicted"] for r in found if not r["toxic"]]
    assert sum(bad) / len(bad) > 0.7 and sum(good) / len(good) < 0.05
    assert all(0 <= r["score"] <= 1 for r in found)


def test_lexicon_does_not_depend_on_partitions(spark):
    labels, docs = spark.read.parquet(f"{MEDIUM}/labels.parquet"), spark.read.parquet(f"{MEDIUM}/documents.parquet")
    one, many = (toxicity.fit(docs.repartition(n), labels) for n in (1, 40))
    assert one.words and one.words == many.words and one.stems == many.stems


def test_toxicity_edge_cases(spark, docs):
    given = odd(spark, ["plain words"])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.report(given, none).collect()} == {0.0}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = toxicity.report(docs.select("doc_id", "text").union(given.select("doc_id", "text")), labels).collect()
    assert len(found) == docs.count() + given.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.report(docs.where("false"), labels).count() == 0
