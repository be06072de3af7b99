"""URL models, resampling, language, neighbours and licenses against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import ann, language, licenses, resampling, url_filter
from tallymark.llm.license_texts import BASE_PHRASES, TEMPLATES
from tallymark.llm.queries import URL_RULES

from .conftest import LOWER, prose

PAGES = [
    (1, "http://A.com/x"), (2, "https://www.example.com/en/1"), (3, "https://example.com/en/2?q"),
    (4, "http://b.example.com/en/#x"), (5, "http://a.net/es/1"), (6, "http://a.net/fr/2"), (7, "http://a.net/de/2"),
    (8, None), (9, "no scheme"), (10, ""), (11, "ftp://x.org"), (12, "http://a.net/esx"), (13, "http://notexample.com/en/"),
    (14, "x://y://z.com/"), (15, "http://a.net/es/1"), (None, "http://q.org/a?b://c.com/"),
] + [(100 + i, f"http://h{i % 7}.example.{t}/{p}/{i}") for i, (t, p) in enumerate(
    [(t, p) for t in ("com", "net", "org") for p in ("en", "es", "fr", "de")] * 12)]


def url_parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def url_rule(host, path):
    best = (None, None)
    for verdict, rule in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best[1] is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return best


def url_brute(urls):
    """Score of every url without rule, before calibration."""
    import zlib

    order = url_filter.ORDER
    said = lambda u: "\2" * order + re.sub(r"(?s)^.*?://", "", u or "", count=1).translate(LOWER) + "\3"
    counts = {"allow": Counter(), "block": Counter()}
    for url, n in Counter(urls).items():
        verdict, _ = url_rule(*url_parts(url))
        if verdict and zlib.crc32((url or "").encode()) % 4:
            s = said(url)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[verdict][s[i - k : i], s[i]] += n
    total, kinds = defaultdict(Counter), defaultdict(Counter)
    for v, grams in counts.items():
        for (c, _), n in grams.items():
            total[v][c] += n
            kinds[v][c] += 1

    def log_chance(v, c, x):
        p = 1 / url_filter.ALPHABET
        for k in range(order + 1):
            ctx = c[order - k :]
            if total[v][ctx]:
                p = (counts[v][ctx, x] + kinds[v][ctx] * p) / (total[v][ctx] + kinds[v][ctx])
        return math.log(p)

    out = {}
    for url in set(urls):
        s = said(url)
        steps = [log_chance("allow", s[i - order : i], s[i]) - log_chance("block", s[i - order : i], s[i]) for i in range(order, len(s))]
        out[url] = sum(steps) / len(steps)
    return out


def test_url_judgements(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in PAGES], "page_id long, url string, host string, score int")
    got = url_filter.judge(pages, URL_RULES).collect()
    assert len(got) == len(PAGES)
    scores, seen = url_brute([u for _, u in PAGES]), {}
    for r, (i, u) in zip(sorted(got, key=lambda r: (r.page_id is None, r.page_id)), sorted(PAGES, key=lambda p: (p[0] is None, p[0]))):
        verdict, rule = url_rule(*url_parts(u))
        assert (r.page_id, r.host, r.path, r.rule) == (i, *url_parts(u), rule)
        if rule:
            assert r.verdict == verdict and r.score is None
        else:
            seen[u] = scores[u] - r.score
            assert r.verdict == ("allow" if r.score >= 0 else "block")
    assert max(seen.values()) - min(seen.values()) < 1e-9
    assert url_filter.judge(pages.where("false"), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id in (1, 7, 8)"), URL_RULES).collect()} == {"allow"}


def test_mean_ratios_and_kth(spark, messy):
    ratio = np.linspace(-1, 1, 50)
    own = messy.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    for r, t in zip(sorted(resampling.mean_ratios(own, ratio).collect(), key=lambda r: r.row), own.collect()):
        grams, _ = resampling.ngrams([t.text or ""], 50)
        assert r.log_ratio == pytest.approx(ratio[grams].mean() if len(grams) else 0.0)
    values = [float(x) for x in np.random.default_rng(0).normal(size=3000)] + [0.25] * 500
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 700, 1400, 3500):
        assert resampling.kth_largest(keys, "key", k) == sorted(values, reverse=True)[k - 1]


def test_resampling_keeps_the_good(spark, messy, no_rows):
    good = [(i, prose(i, 80)) for i in range(120)]
    bad = [(1000 + i, re.sub(r"(\S+)", r"\1%%%", prose(500 + i, 80))) for i in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i < 1000), 0) for i, _ in good + bad if i % 3] + [(1, 1, 0), (None, 1, 0), (5, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = resampling.resample(docs, labels, buckets=512).collect()
    assert {r.doc_id for r in rows if r.kept} == {i for i, _ in good}
    assert resampling.resample(messy, labels.where("false")).where("kept").count() == messy.count()
    assert resampling.accepted(messy, labels).columns == messy.columns
    assert resampling.resample(no_rows, labels).count() == 0


def test_few_wrong_labels_do_not_let_the_bad_stay(spark):
    good = [(i, prose(i, 80)) for i in range(240)]
    bad = [(1000 + i, re.sub(r"(\S+)", r"\1%%%", prose(500 + i, 80))) for i in range(120)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    wrong = {1000, 1001, 1002, 1003}
    labels = spark.createDataFrame([(i, int(i < 1000 or i in wrong)) for i, _ in good + bad], "doc_id long, quality int")
    kept = {r.doc_id for r in resampling.resample(docs, labels, buckets=512).where("kept").collect()}
    assert len([i for i in kept if i >= 1000]) <= 4
    assert len([i for i in kept if i < 1000]) >= 236


def test_languages(spark, messy, no_rows):
    words = {"xx": "lorem ipsum dolor sit amet", "yy": "kuja hevo zalti perku omma", "zz": "grün schön weiß über straße"}
    rng = np.random.default_rng(2)
    rows = []
    for i in range(360):
        lang = sorted(words)[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang].split(), rng.integers(3, 30))), lang))
    rows += [(1000, None, "xx"), (1001, "123 !", "xx"), (1002, "", None), (None, "lorem ipsum", None), (1003, "lorem", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).collect()
    truth = {i: lang for i, _, lang in rows[:360]}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == truth[r.doc_id] and r.score > 0.8 for r in got if r.doc_id in truth)
    other = {r.doc_id: (r.lang_pred, r.score > 0) for r in got if r.doc_id not in truth}
    assert other == {1000: ("und", False), 1001: ("und", False), 1002: ("und", False), None: ("xx", True), 1003: ("xx", True)}
    assert language.accepted(docs).count() == 362
    assert {r.lang_pred for r in language.identify(messy).collect()} == {"en", "und"}
    assert language.identify(no_rows).count() == 0
    import zlib

    held = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_leader_is_sparse():
    rng, model = np.random.default_rng(0), language.Ftrl(2, 50, l1=1.0)
    for _ in range(400):
        k = int(rng.integers(2))
        at = np.array([k, *rng.choice(np.arange(2, 50), 3, replace=False)])
        model.learn(at, np.ones(4) / 2, k)
    w = model.weights(slice(None))
    assert w[0, 0] > 0.5 and w[1, 1] > 0.5 and (w[:, 2:] == 0).mean() > 0.5


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 8)).astype(np.float32))]
    same = [1.0] * 8
    rows += [(1000 + i, same) for i in range(60)]
    odd = [(2000, None), (2100, [0.0] * 8), (2200, [1.0, None] + [1.0] * 6), (2300, [float("nan")] * 8),
           (2400, [float("inf")] * 8), (None, same), (2500, [1.0, 2.0]), (2501, [1.0, 2.5]), (5, rows[5][1])]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, shard int")
    got = defaultdict(list)
    for r in ann.nearest(table, shard_rows=200).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    queries = [i for i in ids if i % 100 == 0]
    assert set(got) == {*queries, 2500}
    assert [x[1] for x in got[2500]] == [2501]
    hit = 0
    for q in queries:
        d = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
        want = sorted((s, i) for s, i in zip(d, ids) if i != q)[:10]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda x: (x[2], x[1]))
        assert all(s == pytest.approx(d[ids == i][0], rel=1e-12) for _, i, s in mine)
        hit += len({i for _, i in want} & {i for _, i, _ in mine})
    assert hit >= 0.95 * 10 * len(queries)
    assert [x[1] for x in sorted(got[1000])] == list(range(1001, 1011))
    assert ann.nearest(table.where("false")).count() == 0


def test_recall_over_clustered_shards(spark):
    """Every shard is visited: recall over eight shards of clustered vectors, one cluster with a third of the rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 4, (40, 24))
    rows = centres[np.where(rng.random(4000) < 1 / 3, 0, rng.integers(0, 40, 4000))] + rng.normal(0, 1, (4000, 24))
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(docs, shard_rows=512).collect():
        got[r.query_id].append((r.score, r.vec_id))
    found = total = 0
    for q in range(0, 4000, 100):
        far = np.sqrt(((rows - rows[q]) ** 2).sum(1))
        far[q] = np.inf
        want = set(np.argsort(far, kind="stable")[:10].tolist())
        assert all(s == far[v] for s, v in got[q]) and sorted(got[q]) == got[q]
        found += len(want & {v for _, v in got[q]})
        total += 10
    assert found / total >= 0.98


def test_distances_are_those_of_the_doubles(spark):
    rows = [(100 * i, [1.0 + i * 1e-12, 1.0]) for i in range(5)] + [(7, [1e300, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(docs).collect()}
    assert len(got) == 25 and got[0, 100] == (1.0 + 1e-12) - 1.0 and got[0, 400] > got[0, 300] > 0


def test_many_short_texts_take_little_memory():
    import tracemalloc

    texts = [f"ab{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}e" for i in range(20_000)]
    tracemalloc.start()
    language.gram_counts([""] * 20_000)
    text, feature, counts, letters = language.gram_counts(texts)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    some = language.gram_counts(texts[:3] + ["longer text " * 4000])
    assert letters.all() and (counts[text < 3] == some[2][some[0] < 3]).all()
    assert (feature[text < 3] == some[1][some[0] < 3]).all()


def test_the_sample_is_the_same_for_every_layout(spark):
    from tallymark.llm.shared import table

    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    kept = lambda d: sorted(r.doc_id for r in resampling.accepted(d, labels).select("doc_id").collect())
    assert kept(docs) == kept(docs.orderBy("text").repartition(7))


def test_licenses(spark, messy, no_rows):
    texts = [
        (50, "Licensed under the Apache License, Version 2.0.\n" + prose(1, 30)),
        (51, prose(2, 9000) + " Licensed under the very Apache License, Version 2.0. cc by CC-BY"),
        (52, "All rights reserved all rights RESERVED General public license"),
        (53, "licensed under something else entirely of no license"),
        (54, "copyéright cc bye all rights"),
    ]
    docs = messy.select("doc_id", "text", "key").union(spark.createDataFrame([(i, t, "k") for i, t in texts], "a long, b string, c string"))
    got = licenses.scan(docs, BASE_PHRASES, TEMPLATES).collect()
    rows, want = docs.collect(), Counter()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        found = [(i, lab) for p, lab in BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        want[r.doc_id, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[50].labels == "apache-2.0" and by[50].score == 1
    assert by[51].labels == "apache-2.0,cc-by" and 0.8 <= by[51].score <= 1
    assert by[52].labels == "gpl,reserved" and by[53].labels == "" == by[54].labels and by[53].score == 0
    assert licenses.scan(no_rows, BASE_PHRASES, TEMPLATES).count() == 0
    with pytest.raises(ValueError):
        licenses.template_positions(spark, [("x", prose(1, 100))] * 3000, 3)


def best_in_order(words, statement, k=3, least_gap=2, slack=0.15):
    """Most words of a statement that a rising chain of k-grams covers, and the chains' places (plain search)."""
    n, gap = len(statement), max(least_gap, int(len(statement) * slack))
    hits = [
        (i, j)
        for i in range(len(words) - k + 1)
        for j in range(n - k + 1)
        if words[i : i + k] == statement[j : j + k]
    ]
    best = {}
    for i, j in hits:
        options = [(k, [j])]
        for (a, b), (got, path) in best.items():
            if a < i and b < j and abs((i - a) - (j - b)) <= gap:
                options.append((got + min(k, j - b), [*path, j]))
        best[i, j] = max(options, key=lambda o: (o[0], len(o[1])))
    return max(best.values(), key=lambda o: (o[0], len(o[1])), default=(0, []))


def test_notices_against_a_plain_search(spark):
    notices = {
        "Released under the terms of the MIT License.": "mit",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "Licensed under CC BY-SA 3.0": "cc-by,cc-by-sa",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License.": "gpl,lgpl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by,cc-by-nc-sa",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "Distributed under the GNU Affero General Public License": "agpl,gpl",
        "License MIT the under released, the license under MIT terms": "",
    }
    long = [t for _, t, *_ in TEMPLATES if len(t) > 900][0].split(" ")
    texts = [*notices, " ".join(long[:60] + ["some", "words", "here"] + long[60:]), " ".join(long[100:] + long[:100])]
    texts += [prose(i, 40) + " " + t + " " + prose(90 + i, 40) for i, t in enumerate(list(notices))] + ["all rights reserved " * 500]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BASE_PHRASES, TEMPLATES).collect()}
    for i, want in enumerate(notices.values()):
        assert got[i].labels == want, (texts[i], got[i])
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    for i, text in enumerate(texts[:-1]):
        labels, score = {lab for p, lab in BASE_PHRASES.items() if f" {p} " in f" {' '.join(cut(text))} "}, 0.0
        for label, statement, key in TEMPLATES:
            said = cut(statement)
            words, path = best_in_order(cut(text), said)
            told = not key or any(f" {key} " in f" {' '.join(said[j : j + 3])} " for j in path)
            if words >= 0.8 * len(said) and told:
                labels.add(label)
                score = max(score, words / len(said))
        assert (got[i].labels, got[i].score) == (",".join(sorted(labels)), pytest.approx(score)), text
    assert got[len(texts) - 1].labels == "reserved"
