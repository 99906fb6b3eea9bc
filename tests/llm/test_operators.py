"""Corpus operators against brute force, with missing values, ties, copies and odd columns."""

import gzip
import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scoreframe.llm import (
    licenses, mixture, nbsvm, pii, queries, simhash, suffix_dedup, templates, url_model, warc, weak_rules,
)
from scoreframe.llm.queries import QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, size int, id string, license string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", None, "k", 1, 1, "x", "l"), (2, "", "en", "a", 0, "k", 1, 1, "x", "l"),
    (3, LONG, "en", None, len(LONG), "k", 1, 1, "x", "l"), (4, "Same text here twice.", "de", "b", 21, "k", 1, 1, "x", "l"),
    (4, "Same text here twice.", "de", "b", 21, "k", 1, 1, "x", "l"), (None, "No id at all", "fr", "b", 12, None, None, None, None, None),
    (5, " \t\n\x0b ", "en", "c", 5, "k", 1, 1, "x", "l"), (6, "Ünïcode 🙂 wörds, 日本語 テキスト", "en", "c", 29, "k", 1, 1, "x", "l"),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_odd_rows_and_empty_tables_pass_every_operator(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (4, 0), (6, 7)], "doc_id long, quality int")
    none = labels.limit(0)
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x y z")], "item_id long, text string")
    jobs = {
        "rules": weak_rules.judge, "spans": pii.personal_data, "masked": pii.masked, "repeats": suffix_dedup.without_repeats,
        "near": simhash.near_duplicates, "mix": mixture.taken_words, "quality": lambda d: nbsvm.quality(d, labels),
        "untaught": lambda d: nbsvm.quality(d, none), "clean": lambda d: templates.without_leaks(d, items),
        "urls": lambda d: url_model.judge(d, URL_RULES, "doc_id", "text"),
        "licences": lambda d: licenses.scan(d.withColumn("path", F.col("source"))),
    }
    for name, job in jobs.items():
        assert job(odd).count() == len(ROWS), name
        assert job(empty).count() == 0, name
    assert templates.leaks(odd, items).count() == templates.leaks(empty, items).count() == 0
    pages = odd.select(F.col("doc_id").alias("id"), F.col("text").alias("uri"), F.lit(None).alias("date"), F.lit(None).alias("headers"), F.col("text").alias("payload"))
    assert warc.derived(pages).count() == 2 * len(ROWS) and warc.derived(pages.limit(0)).count() == 0
    kept = simhash.first_of_groups(odd)
    assert kept.columns == odd.columns
    texts = sorted((r.text or "").strip() for r in kept.collect())
    assert texts == sorted({(r[1] or "").strip() for r in ROWS})  # empty, missing and blank texts are one group


def test_rules_count_as_brute_force_and_keep_clean_text(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, FOLDER).collect()}
    for key, doc in documents.items():
        text = doc.text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[key])[1:6] == want
        assert got[key].base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_estimated_accuracies_find_the_bad_rows():
    clean, symbols, upper = (1, 1, 1), (-1, 1, 1), (1, -1, -1)
    model = weak_rules.estimate([(clean, 900), (symbols, 40), (upper, 60)], 3)
    assert model.log_odds(clean) > 0 > model.log_odds(upper)
    assert all(0 < x < 1 for x in (model.prior, *model.good, *model.bad))
    assert math.isclose(weak_rules.estimate([], 2).prior, 0.8)


def test_own_and_inherited_licences(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/b/c.py", "code only"), ("r/a/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("r/a/d.py", "x = 1\nThis work is licensed under the GNU General Public License, version 3.\ny"), ("s/e.py", "the and of in"), ("r/f.py", None), (None, "z"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.origin, r.from_directory) for r in licenses.scan(files).collect()}
    assert got == {
        "r/LICENSE": ("MIT", "own", None), "r/a/b/c.py": ("Apache-2.0", "inherited", "r/a"), "r/a/COPYING": ("Apache-2.0", "own", None),
        "r/a/d.py": ("GPL-3.0", "own", None), "s/e.py": (None, None, None), "r/f.py": ("MIT", "inherited", "r"), None: (None, None, None),
    }


def test_licences_are_found_under_their_own_version(spark):
    wrapped = lambda text: "\n".join(re.findall(r".{1,70}(?:\s|$)", text))
    texts = {
        "MIT": [wrapped("MIT License. Copyright (c) 2020 Someone\n\n" + licenses.MIT_GRANT + licenses.MIT_REST), licenses.MIT_GRANT,
                "MIT License\n\nCopyright (c) 2020 Someone"],
        "BSD-2-Clause": [wrapped("Copyright (c) 2020, Someone\n" + licenses.BSD_GRANT + licenses.BSD_REST)],
        "BSD-3-Clause": [wrapped("Copyright (c) 2020, Someone\n" + licenses.BSD_GRANT + licenses.BSD_NAMES + licenses.BSD_REST)],
        "Apache-2.0": ["                    Apache License\n              Version 2.0, January 2004\n           http://www.apache.org/licenses/",
                       'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'],
        "Apache-1.1": ["Apache License 1.1", "The Apache Software License, Version 1.1"],
        "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License, version 2",
                    "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991"],
        "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007"],
        "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999"],
        "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007"],
        "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."],
        None: ["GNU General Public License, version 9", "A general remark on public things"],
    }
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat(F.lit("corpus/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    rows = [(f"{name}/{i}/LICENSE", text) for name, own in texts.items() for i, text in enumerate(own)]
    got = {r.path: r.license for r in licenses.scan(docs.unionByName(spark.createDataFrame(rows, "path string, text string"))).collect() if not r.path.startswith("corpus")}
    assert got == {path: None if path.startswith("None") else path.split("/")[0] for path, _ in rows}


def test_cosines_equal_plain_arithmetic(spark, documents):
    import regex

    def words(text):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]

    got = {r.doc_id: r for r in QUERIES["op2_license_scans"](spark, FOLDER).collect()}
    df = Counter(w for d in documents.values() for w in set(words(d.text or "")))
    idf = lambda w: math.log((1 + len(documents)) / (1 + df[w])) + 1
    templates = [(name, Counter(words(text))) for name, text in licenses.TEMPLATES]
    length = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))
    for key, doc in documents.items():
        text = doc.text or ""
        lines = [x for x in re.split(r"\n|(?<=[.!?;])[ \t]+", text) if x.strip(" ")]
        notices = [*lines, *(f"{a} {b}" for a, b in zip(lines, lines[1:])), *([text] if key % 10 == 0 else [])]
        best = (0.0, None)
        for notice in map(Counter, map(words, notices)):
            for name, counts in templates:
                if all(notice[w] for w in counts if w.isdigit()) and notice:
                    score = sum(n * notice[w] * idf(w) ** 2 for w, n in counts.items()) / length(counts) / length(notice)
                    best = max(best, (round(score, 9), name), key=lambda x: x[0])
        if best[0] >= licenses.COSINE:
            assert got[key].origin == "own" and math.isclose(got[key].score, best[0], abs_tol=1e-8) and got[key].license == best[1]
        else:
            assert got[key].origin != "own"


def test_rows_of_often_used_keys_are_looked_up_like_others(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3_000)], "key long, row long")
    table = spark.createDataFrame([(0, 2_001, "often"), *((i, 1, "seldom") for i in range(3, 3_000, 6))], "key long, n long, value string")
    for how in ("inner", "left"):
        got = suffix_dedup._looked_up(rows, table, ["key"], 3_000, how)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" in plan and sorted(got.collect(), key=str) == sorted(rows.join(table, "key", how).collect(), key=str)


def document_windows(spark, texts, marks):
    """The function that makes the windows of Arrow batches, and a batch of these texts."""
    import pyarrow as pa

    class Rows:
        schema = spark.createDataFrame([], "id long, text string").schema

        def mapInArrow(self, function, schema):
            return function

    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    return lambda: [r for b in templates._windows(Rows(), marks, 8, 4)(iter([batch])) for r in b.to_pylist()]


def test_windows_of_texts_searched_together_are_those_of_each_alone(spark):
    texts = ["In Rome, Paris 7 km or 12.5 % of $3 and 4 days so 5 6 7 8 9 10 11 was Ann there", None, "", "one two", "x " * 7,
             "A b_C, Dora: 8 kg\x01 ΑΣ ٣ km/h €5,5 USD Émile too was here at 9min as Bob went on 1.5.6 km"] * 3
    every = {8: b"\xff" * (1 << 21)}
    together = document_windows(spark, texts, every)()
    alone = [r | {"id": i} for i, text in enumerate(texts) for r in document_windows(spark, [text], every)()]
    order = lambda r: (r["id"], r["form"], r["place"])
    assert sorted(together, key=order) == sorted(alone, key=order)
    assert len({(r["id"], r["place"]) for r in together}) == sum(max(0, n - 7) for n in (24, 0, 0, 2, 7, 24)) * 3  # tokens of each


def test_windows_cost_little_more_than_words(spark):
    """CPU seconds of the windows of many short texts, over those of cutting them into words with a number each."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text <> ''").collect()]
    windows = document_windows(spark, texts, {8: bytes(1 << 21)})

    def seconds(work):
        took = []
        for _ in range(5):
            begin = time.process_time()
            work()
            took.append(time.process_time() - begin)
        return min(took)

    plain = seconds(lambda: [list(map(zlib.crc32, re.sub(r"\W+", " ", t).lower().encode().split())) for t in texts])
    assert seconds(windows) < 2 * plain


def test_licence_words_written_do_not_follow_copies_and_common_words(spark, monkeypatch):
    """Notices of the same text are judged once, and lines that only have a template's common words not at all."""
    written, cut_lineage = [], licenses.cut_lineage

    def counted(df):
        table = cut_lineage(df)
        written.append((table.columns, table.count()))
        return table

    monkeypatch.setattr(licenses, "cut_lineage", counted)
    notice = "Released under the MIT License"
    files = [(f"a/{i}.py", f"the {i}x and of the to in this or is any" if i % 2 else notice) for i in range(2_000)]
    got = licenses.scan(spark.createDataFrame(files, "path string, text string").repartition(8)).collect()
    assert Counter((r.license, r.score, r.origin) for r in got) == {("MIT", 1.0, "own"): 1_000, (None, None, None): 1_000}
    assert max(n for columns, n in written if "w" in columns) == len(notice.split())


def test_base_spans_match_the_plain_patterns():
    import random

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    tests = {"email": lambda t, d: True, "ip": lambda t, d: all(int(x) <= 255 for x in t.split(".")),
             "card": lambda t, d: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda t, d: 9 <= len(d) <= 15}
    find, rng = pii.patterns(), random.Random(5)
    for n in range(5_000):
        text = "".join(rng.choice("0123456789 .-+()@ab@.1 " if n % 3 else "01. -+(") for _ in range(rng.randint(0, 40)))
        want = [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, text) if tests[k](m.group(), re.sub("[^0-9]", "", m.group()))]
        assert sorted(pii.base_spans(text, find)) == sorted(want)


def test_the_field_labels_what_repeats_a_span_and_nothing_else():
    find = pii.patterns()
    text = ("Call +1 (743) 555-3824 now, later (743) 555-3824. Card 4465758382889437 and 4465 7583 8288 9438; "
            "mail jane.doe@x.example.com user jane.doe wrote; 1234567 and 99887766554")
    added = [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text, find), find)[0]]
    assert added == [("phone", "(743) 555-3824"), ("card", "4465 7583 8288 9438"), ("email", "jane.doe")]
    for clean in ("Nothing here 1234567 and (743) 555-3824.", ""):
        assert pii.added_spans(clean, pii.base_spans(clean, find), find) == ([], True)


def test_one_digit_apart_and_user_names_are_linked_wherever_they_stand():
    find = pii.patterns()

    def added(text):
        return [text[a:b] for _, a, b in pii.added_spans(text, pii.base_spans(text, find), find)[0]]

    assert added("4465758382889437 then 4465758312345674 then 4465758398765019 then 4465758312346674.") == ["4465758312346674"]
    assert added("Call +1 743 555 3824 or 1 743 555 3825 today, or 99887766554.") == ["1 743 555 3825"]
    assert added("Mail janedoe@x.example.com, user janedoe; x12345678@x.org is x12345678; a@x.org is a mail") == ["janedoe", "x12345678"]


@pytest.mark.parametrize("n", [1, 80, 120, 600, 5_000])
def test_any_number_of_repeats_gets_the_label_in_linear_time(n):
    find = pii.patterns()
    for text, kind in (("Call +1 (743) 555-3824 now. " + "and (743) 555-3824 so " * n, "phone"),
                       ("Mail janedoe@x.example.com " + "user janedoe " * n, "email"),
                       ("and (743) 555-3824 so " * n + "call +1 (743) 555-3824", "phone")):
        begin = time.perf_counter()
        added, settled = pii.added_spans(text, pii.base_spans(text, find), find)
        assert len(added) == n and settled and {k for k, _, _ in added} == {kind}
        assert time.perf_counter() - begin < 5


def test_marginals_equal_enumeration_on_trees():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 6))
        potentials = rng.normal(0, 2, (n, 5)).tolist()
        edges = [(int(rng.integers(0, j)), j, float(rng.choice([0.2, 2.5, 3.0]))) for j in range(1, n)]
        labels = [int(rng.integers(0, 5)) if rng.random() < 0.3 else None for _ in range(n)]
        weights = defaultdict(float)
        for state in itertools.product(range(5), repeat=n):
            if all(k in (None, x) for k, x in zip(labels, state, strict=True)):
                weights[state] = math.exp(sum(p[x] for p, k, x in zip(potentials, labels, state, strict=True) if k is None)
                                          + sum(s for i, j, s in edges if state[i] == state[j]))
        total = sum(weights.values())
        want = [[sum(w for s, w in weights.items() if s[i] == x) / total for x in range(5)] for i in range(n)]
        got, settled = pii.marginals(potentials, edges, labels)
        assert settled and np.allclose(got, want, atol=1e-6)


def test_the_mix_does_not_depend_on_files_and_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.limit(50)).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))

    def taken(df):
        return sorted((tuple(r) for r in mixture.taken_words(df).select("doc_id", "size", "target", "taken", "n_shards").collect()), key=str)

    want = taken(docs.coalesce(1))
    for count in (4, 211):
        assert taken(docs.repartition(count)) == want
    assert len(want) == docs.count()


def test_equal_rows_are_told_apart_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixture, "COPIES", 7)
    monkeypatch.setattr(mixture, "SLICE", 3)
    rows = [(1, "one two three", "a")] * 50 + [(None, "one two", None)] * 20 + [(i, "four " * (i % 300), "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixture.sized(docs).select("key").distinct().count() == len(rows)
    got = mixture.taken_words(docs, block=16).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    total, goal = Counter(), {}
    for r in got:
        total[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(total[s] - t) <= 1 for s, t in goal.items())


def test_repeated_passages_match_brute_force(spark, documents, monkeypatch):
    k = 60
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(40)]
    passage = " ".join(rng.choice(words, 60))
    texts = [" ".join(rng.choice(words, n)) for n in (5, 40, 90, 120)]
    texts += [texts[2], texts[3][:200] + "X" + texts[3][201:], texts[1] + passage, passage + texts[2][50:], "é" * 200, None, ""]
    texts += [f"{i} {passage[20:]} {i * 7}" for i in range(12)]
    raw = [(t or "").encode() for t in texts]
    counts = Counter(t[p:p + k] for t in raw for p in range(len(t) - k + 1))
    want = {}
    for i, t in enumerate(raw):
        gone = bytearray(len(t))
        for p in range(len(t) - k + 1):
            if counts[t[p:p + k]] > 1:
                gone[p:p + k] = b"\1" * k
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        want[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for small in (64, 1):  # buckets refined inside a task, and by halves
        monkeypatch.setattr(suffix_dedup, "SMALL", small)
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.without_repeats(docs, length=k).collect()}
        assert got == want


def test_repeats_of_400_bytes_match_brute_force_beyond_one_piece(spark, documents):
    rng = np.random.default_rng(5)
    noise = "".join(rng.choice(list("abcdefgh "), suffix_dedup.PIECE + 20_000))
    edge = suffix_dedup.PIECE
    rows = [(i, r.text) for i, r in documents.items()]
    rows += [(-1, noise), (-2, "x" + noise[edge - 300:edge + 300] + "y"), (-3, noise[edge - 399:edge]), (-4, noise[9_000:9_400] + "é"), (-5, None)]
    raw = {i: (t or "").encode() for i, t in rows}
    counts = Counter(hash(t[p:p + 400]) for t in raw.values() for p in range(len(t) - 399))
    want = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 399):
            if counts[hash(t[p:p + 400])] > 1:
                gone[p:p + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want[i] = (len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    assert want[-1][1] == 1_000 and want[-2][1] == 600 and want[-3][1] == 0
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_often_used_keys_are_told_by_the_rows_they_are_joined_to(spark, monkeypatch):
    rng = np.random.default_rng(8)
    lone = ["".join(rng.choice(list("abcdef"), 3_000)) for _ in range(4)]
    passage = "".join(rng.choice(list("abcdef"), 150))
    texts = lone + [f"{i:04} {passage[i % 7:]} {i:04}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    joined, plain = [], suffix_dedup._looked_up

    def noted(rows, table, keys, total, how="inner"):
        joined.append((keys[1:], total, rows.count()))
        return plain(rows, table, keys, total, how)

    monkeypatch.setattr(suffix_dedup, "_looked_up", noted)
    monkeypatch.setattr(suffix_dedup, "SMALL", 1)
    suffix_dedup.without_repeats(docs, length=60)
    assert {k[-1] for k, *_ in joined if k} == {"context", "core", "full"}
    assert [x for x in joined if x[1] != x[2]] == []


def brute_ratio(counts, context, char):
    low = 1 / 256 if not context else brute_ratio(counts, context[1:], char)
    seen = counts.get(context)
    return (seen[char] + len(seen) * low) / (sum(seen.values()) + len(seen)) if seen else low


def test_url_scores_match_a_plain_language_model(spark):
    rows = [r for r in QUERIES["op5_url_filters"](spark, FOLDER).collect()]
    urls = {r.page_id: r.url or "" for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    texts = spark.createDataFrame([(u,) for u in set(urls.values())], "text string")
    held = {r.text: r.h for r in texts.select("text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("h")).collect()}
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for r in rows:
        url = urls[r.page_id]
        if r.rule and not held[url]:
            padded = url_model.START * 4 + url + url_model.END
            for j in range(4, len(padded)):
                for order in range(5):
                    counts[r.verdict][padded[j - order:j]][padded[j]] += 1
    for r in rows:
        padded = url_model.START * 4 + urls[r.page_id] + url_model.END
        logs = [math.log(brute_ratio(counts["block"], padded[j - 4:j], padded[j]) / brute_ratio(counts["allow"], padded[j - 4:j], padded[j]))
                for j in range(4, len(padded))]
        assert math.isclose(r.score, sum(logs) / len(logs), abs_tol=1e-9)
        if not r.rule:
            assert r.verdict == ("block" if r.score > r.cut else "allow")


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("http://A.Example.ORG/es/1?q", "a.example.org", "/es/1", "example.org/es/"), ("x://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("x://notexample.org/es/", "notexample.org", "/es/", "org/"), ("x://com/de/#a://b", "com", "/de/", "com/de/"), ("x://org", "org", "", None),
    ("no host", "", "", None), (None, "", "", None),
])
def test_hosts_paths_and_the_longest_rule(spark, url, host, path, rule):
    page = spark.createDataFrame([(1, url)], "page_id int, url string")
    u = F.coalesce("url", F.lit(""))
    h, p = url_model.host_of(u), url_model.path_of(u)
    assert tuple(page.select(h, p, url_model.by_rules(URL_RULES, h, p)["rule"]).first()) == (host, path, rule)


def test_reparameterised_questions_are_leaks_if_slots_agree(spark):
    items = spark.createDataFrame([(7, "A train leaves Denver at 45 km per hour and later travels 80 km toward Dallas before it stops 45 km away from home."), (9, "one short item")], "item_id int, text string")
    docs = spark.createDataFrame([
        (1, "So. A train leaves Boston at 60 km per hour and later travels 120 km toward Chicago before it stops 60 km away from home. End"),
        (2, "A train leaves Boston at 60 km per hour and later travels 90 km toward Chicago before it stops 75 km away from home."),
        (3, "Some other words that share nothing at all with any of the items here"), (4, "a train leaves, and stops")], "doc_id int, text string")
    assert [(r.doc_id, r.item_id, r.changed_slots) for r in templates.leaks(docs, items).collect()] == [(1, 7, 4)]
    assert sorted(r.doc_id for r in templates.without_leaks(docs, items).collect()) == [2, 3, 4]


def test_items_of_numbers_and_names_are_found_as_they_stand(spark):
    texts = ["Compute 12 + 7 * 3 - 4 / 2 + 9", "What is 12 + 7", "12 + 7", "then Anna, Ben, Carl, Dora, Emil, Fritz, Gustav, Hanna, Ida and Jakob went"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    docs = spark.createDataFrame([
        (0, "Task. Compute 12 + 7 * 3 - 4 / 2 + 9"), (1, "Task. What is 12 + 7"), (3, "And " + texts[3]),
        (4, "Task. Compute 13 + 6 * 2 - 5 / 3 + 8"), (5, "then Otto, Paul, Ruth, Sven, Tina, Uwe, Vera, Walter, Xaver and Yvonne went")],
        "doc_id int, text string")
    found = {(r.doc_id, r.item_id) for r in templates.leaks(docs, items).collect()}
    assert found == {(0, 0), (0, 2), (1, 1), (1, 2), (3, 3)}


def test_one_clashing_value_does_not_hide_the_rest_of_a_copy(spark):
    filler = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    texts = [f"she counted 45 apples here and 45 pears there then {filler}", f"she counted 5 apples here and 3 pears there then {filler}",
             f"{filler} he paid 7 coins to all the men and 7 coins to all the women and then he left the town and never came back there"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    docs = spark.createDataFrame([
        (0, texts[0].replace("45 pears", "46 pears")), (1, texts[1].replace("5 apples", "4 apples").replace("3 pears", "4 pears")),
        (2, "unlike " + texts[2].removeprefix(filler).replace("7 coins", "8 coins", 1).replace("7 coins", "9 coins", 1))], "doc_id int, text string")
    found = {(r.doc_id, r.item_id): r.changed_slots for r in templates.leaks(docs, items).collect()}
    assert {(0, 0), (1, 1), (2, 2)} <= set(found) and found[0, 0] == 1


def test_copies_are_leaks_in_any_context_case_and_length_of_names(spark):
    texts = ["What is the capital of France?", "Anna has 5 red apples. Ben has 3 green apples. Carl eats 2 of the apples.",
             "Der Hund und die Katze laufen durch den Garten zum alten Haus",
             "On the way to the town of Paris we met and ate lunch by the hill near Lyon we all walked home on foot"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    docs = spark.createDataFrame([
        (0, "Question: What is the capital of France? Paris."), (10, "so then What is the capital of France"), (20, "so what is the capital of Spain"),
        (1, "Lena has 7 red apples. Otto has 4 green apples. Ruth eats 6 of the apples."),
        (2, "so " + texts[2].lower()), (12, texts[2].upper()),
        (3, "On the way to the town of New York we met and ate lunch by the hill near Los Angeles we all walked home on foot")],
        "doc_id int, text string")
    found = {(r.doc_id, r.item_id) for r in templates.leaks(docs, items).collect()}
    assert found == {(0, 0), (10, 0), (20, 0), (1, 1), (2, 2), (12, 2), (3, 3)}


def test_leaks_match_plain_word_windows(spark, documents):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    windows = defaultdict(list)
    for i, w in items.items():
        for k in range(len(w) - 7):
            windows[tuple(w[k:k + 8])].append((i, k))
    want = set()
    for d, doc in documents.items():
        w, hits = words(doc.text), defaultdict(set)
        for k in range(len(w) - 7):
            for i, p in windows.get(tuple(w[k:k + 8]), ()):
                hits[i, k - p] |= set(range(p, p + 8))
        want |= {(d, i) for (i, _), s in hits.items() if len(s) >= 16 or 2 * len(s) >= len(items[i])}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op6_benchmark_decontamination"](spark, FOLDER).collect()} == want


def test_the_mix_meets_its_targets_and_shards_share_all_blocks(spark, documents):
    rows = QUERIES["op7_source_mixing"](spark, FOLDER).collect()
    size = {k: len(WORD.findall(d.text or "")) for k, d in documents.items()}
    of = {k: d.source for k, d in documents.items()}
    sizes = Counter()
    for k, n in size.items():
        sizes[of[k]] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full: set = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in rows:
        source = of[r.doc_id]
        taken[source] += r.taken
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source]) and 0 <= r.taken <= 3 * r.size
        assert math.isclose(r.target, 3 * sizes[source] if source in full else level * weight[source], rel_tol=1e-9)
    assert all(abs(taken[r.source] - r.target) <= 1 for r in mixture.taken_words(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect())
    _, _, laid = mixture.mix(spark.read.parquet(f"{FOLDER}/documents.parquet"), shards=4)
    per_shard = [r["count"] for r in laid.groupBy("shard").count().collect()]
    assert len(per_shard) == 4 and max(per_shard) - min(per_shard) <= 2
    assert laid.groupBy("rank", "place").count().where("count > 1").isEmpty()


def test_drawn_counts_follow_the_hypergeometric_law(spark):
    draws = spark.range(4_000).select(mixture._hypergeometric(
        F.lit(30.0), F.lit(70.0), F.lit(20.0), mixture._uniform(F.col("id"))).alias("x")).toPandas()["x"]
    chance = np.array([math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20) for k in range(21)])
    seen = np.bincount(draws.astype(int), minlength=21)
    assert np.abs(seen / 4_000 - chance).max() < 0.025 and abs(draws.mean() - 6) < 0.15


def test_records_keep_their_links_and_come_back_whole(spark):
    page = '<html><title>T &amp; U</title><script>no("</p>")</script><!-- x --><p>One<br>two</p><a href="/b">b</a></html>'
    responses = spark.createDataFrame([(1, "http://x.org/a", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX: y", page)], "id int, uri string, date string, headers string, payload string")
    records = warc.derived(responses)
    meta, text = records.orderBy("warc_type", ascending=False).collect()
    assert meta.refers_to == text.refers_to and meta.record_id != text.record_id
    assert text.block == "T & U\nOne\ntwo\nb" and "outlink: http://x.org/b\r\n" in meta.block and "source-header: X: y" in meta.block
    assert text.source_payload_digest == meta.source_payload_digest == warc.digest(page.encode())
    for row, member in zip((text, meta), [r.member for r in warc.serialized(records).orderBy("record_id").collect()], strict=True) if text.record_id < meta.record_id else zip((meta, text), [r.member for r in warc.serialized(records).orderBy("record_id").collect()], strict=True):
        headers, block = warc.parsed(member)
        assert headers["WARC-Refers-To"] == row.refers_to and block.decode() == row.block and headers["WARC-Block-Digest"] == warc.digest(block)


def test_hidden_parts_without_an_end_hide_nothing_else():
    custom = "<p>a</p><template-card>b</template-card><style-guide>c</style-guide><p>d</p>"
    for page, shown in (
            (custom, custom), ('<script>var a="<!--";</script><p>b</p><!-- c --><p>d</p>', "<p>b</p><p>d</p>"),
            ("a<!-- <script> -->b<script>c</script>d", "abd"), ("a<!-- b", "a b"), ("a<STYLE x>b<p>c", "ab<p>c"),
            ("a<script>b</scripts>c</script >d<!-->e<style/>f</style>g", "adeg"), ("a<noscript>İ</NOSCRIPT>b", "ab"),
            ("<script>a<script>b</script>c<script>d", "cd"), ('<template title="a>b">c<!-- </template> -->d</template>e', "e")):
        assert warc.visible(page) == shown
    n = 100_000
    for part in ("<script>", "<!--", "<template><!--"):
        assert warc.visible(part * n + "x") == "x"


def test_responses_of_a_file_keep_their_ids_and_digests(spark):
    def member(kind, record, block, digest="sha1:OWN"):
        head = f"WARC/1.1\r\nWARC-Type:{kind}\r\nWARC-Record-ID: {record}\r\nWARC-Target-URI: http://x.org/\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    page = "<p>Grüße</p>\r\n\r\n<p>zwei</p>"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n".encode() + page.encode("latin-1")
    members = spark.createDataFrame([(m,) for m in (
        member("response", "<urn:a>", http), member("request", "<urn:b>", b"GET / HTTP/1.1\r\n\r\n"),
        member("response", "<urn:c>", b"no http"), b"not gzip", b"", None)], "member binary")
    found = warc.responses(members)
    row, = found.collect()
    assert (row.record_id, row.payload_digest, row.payload) == ("<urn:a>", "sha1:OWN", page)
    records = warc.derived(found, "record_id", "record_id", "payload_digest").collect()
    assert {r.refers_to for r in records} == {"<urn:a>"} and {r.source_payload_digest for r in records} == {"sha1:OWN"}
    assert {r.block for r in records if r.warc_type == "conversion"} == {"Grüße\nzwei"}
    assert warc.responses(members.limit(0)).count() == 0


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(prints, bits):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], dtype=np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= bits):
            a, b = find(k), find(keys[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_fingerprints_and_components_match_brute_force(spark, documents):
    prints = {k: plain_fingerprint(d.text) for k, d in documents.items()}
    want = plain_components(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_near_dedup"](spark, FOLDER).collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


def test_the_index_finds_every_link_in_dense_buckets():
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) for c in centre]))
    values = values[np.argsort(simhash.gray_rank(values))]
    found = {(int(a), int(b)) for pairs in simhash.linked(values, np.zeros(len(values), int), 2) for a, b in pairs.T}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in found} == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = simhash.components(spark.createDataFrame(chain, "a long, b long")).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in got) == [30, 41]


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(rows[k].predicted, q) for k, q in labels.items() if rows[k].held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(80)]
    sign = np.where([0 in r or 1 in r for r in rows], 1.0, -1.0)
    values = [np.ones(len(r)) / np.sqrt(len(r)) for r in rows]
    weights, constant = nbsvm.descend(rows, values, sign, np.full(80, 1.0))

    def loss(w, b):
        return (w @ w + b * b) / 2 + sum(max(0.0, 1 - s * (w[r] @ v + b)) for r, v, s in zip(rows, values, sign, strict=True))

    best = loss(weights, constant)
    for _ in range(50):
        nudge = np.zeros(len(weights))
        nudge[:50] = rng.normal(0, 0.05, 50)
        assert loss(weights + nudge, constant + rng.normal(0, 0.05)) > best - 1e-2


def test_pipeline_keeps_one_clean_copy_of_each_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert not any("@mail" in (t or "") for t in clean.values())
    final = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert final == set(clean) and len(final) > 100


def test_stages_take_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, FOLDER).count() > 0
        assert stage(spark, empty, FOLDER).count() == 0


def test_columns_of_any_name_keep_their_values(spark, odd):
    extra = ["a.b", "_kept_key", "_leak_key", "_quality_score", "_key", "_own", "row`s", "Score"]
    docs = odd
    for name in extra:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    own = licenses.scan(docs.withColumn("path", F.col("source")))
    for out in [stage(spark, docs, FOLDER) for _, stage in corpus_pipeline.STAGES[:-1]] + [own]:
        names = [x for x in out.columns if x in extra]
        assert names == [x for x in extra if x in names] and len(names) >= len(extra) - 1
        for row in out.collect():
            for name in names:
                assert row[name] == f"{name}{'-' if row.doc_id is None else row.doc_id}"


def test_the_fit_reads_one_row_of_each_labelled_id(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"plain prose number {i}" if i % 2 else f"##{i}## $$ !!") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = nbsvm.fit(docs, labels)
    copies = nbsvm.fit(docs.union(docs.where(f"doc_id = {ids[0]}").crossJoin(spark.range(500)).drop("id")), labels)
    assert np.array_equal(once.weights, copies.weights) and once.slope == copies.slope


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))
