"""Collocations, URL rules and spelling variants against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import collocations, ordered, spelling, url_rules

UP = re.compile("[A-Z]")


def lowered(t):
    return UP.sub(lambda m: m[0].lower(), t or "")


def collocations_by_hand(rows, longest, least, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    inside = set()
    for (lang, p), v in f.items():
        for i in range(len(p)):
            inside |= {(lang, p[i:j]) for j in range(i + 1, len(p) + 1) if j - i < len(p) and f[lang, p[i:j]] <= v}
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, l, x, n[lang], -s) for lang, v in found.items() for r, (s, a, p, l, x) in enumerate(sorted(v)[:first], 1))


@pytest.mark.parametrize("least,first", [(3, 50), (20, 5), (4, None)])
def test_collocations_equal_brute_force(spark, least, first):
    r = random.Random(least)
    rows = [(r.choice(["en", "de", None]), "".join(r.choice("abAé  \t.\n;") for _ in range(r.randrange(250)))) for _ in range(120)]
    rows += [("en", None), ("xx", ""), ("xx", " . "), ("fr", "a b c d e f g " * 40), ("fr", "z"), ("fr", "q"), ("en", "long " * 6000)] + [("es", "same row here")] * 9
    df = spark.createDataFrame([(i, *x, 1, "w") for i, x in enumerate(rows)], "doc_id long, lang string, text string, h int, w1 string")
    got = collocations.collocations(df, 4, least, first).collect()
    assert sorted(map(tuple, got)) == collocations_by_hand(rows, 4, least, first)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.op11_collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.op11_collocations(df).count() == 0


def test_collocation_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, x, y = 90_000_000_000_007, 900_000_000_000_000, 90_000_000_000_011, 800_000_000_000_003
    row = spark.range(1).select(F.lit(2).alias("k"), F.lit(a).alias("a"), F.lit(n).alias("n"), F.array(F.lit(x)).alias("l"), F.array(F.lit(y)).alias("r"))
    best = row.select(collocations.cut_scores(*[F.col(c) for c in "kanlr"], 2).alias("b")).first().b
    assert tuple(best) == (1000 * a * n // (x * y), 1, x, y)


def test_words_that_share_a_number_are_told_apart(spark, monkeypatch):
    calls = []
    real = collocations.count_words
    monkeypatch.setattr(collocations, "count_words", lambda docs, salt: (calls.append(salt), real(docs, salt))[1].withColumn("h", collocations.F.lit(1).cast("long") if salt == 0 else collocations.F.col("h")))
    df = spark.createDataFrame([("en", "a b " * 5)], "lang string, text string")
    assert [tuple(r) for r in collocations.collocations(df, 2, 3).collect()] == collocations_by_hand([("en", "a b " * 5)], 2, 3, None)
    assert calls == [0, 1]


def verdict_by_hand(i, url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = lowered(rest[:k]), re.split("[?#]", rest[k:])[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return i, host, path, best and best[2], best[3] if best else default


def test_url_rules_equal_brute_force(spark):
    r = random.Random(5)
    labels = ["a", "b", "com", "-", "x", "é"]
    given = [(".".join(r.choice(labels) for _ in range(r.randrange(1, 5))), r.choice(["", "/", "/a", "/a/", "/ab", "/abc/d", "x"]), r.choice(["allow", "block"])) for _ in range(80)]
    given += [(None, "/", "block"), ("", "/ab", "block"), ("a", None, "allow"), ("b", "/", None)]
    urls = ["HTTP://" + ".".join(r.choice(labels) for _ in range(r.randrange(0, 6))).upper() + r.choice(["", "/", "/a", "/a/b", "/abc/d?x", "/ab#/", "?q/a", "/\n/a"]) for _ in range(500)]
    urls += [None, "", "no url", "x://", "http://a.b.com/" + "abc/d" * 9000] * 2 + ["http://a.b.com/abc/d"] * 300
    pages = spark.createDataFrame([(i % 300 or None, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, tie int")
    rules = {}
    for h, p, v in given:
        if None not in (h, p, v) and p[:1] in ("", "/"):
            rules[h, p] = max(rules.get((h, p), ""), v)
    frame = spark.createDataFrame(given, "host string, path string, verdict string")
    want = Counter(verdict_by_hand(i % 300 or None, u, rules, "block") for i, u in enumerate(urls))
    assert Counter(tuple(x) for x in url_rules.judge(pages, frame, default="block").collect()) == want
    none = url_rules.judge(pages, frame.limit(0)).collect()
    assert len(none) == len(urls) and {(x.rule, x.verdict) for x in none} == {(None, "allow")}
    assert url_rules.op12_url_rules(pages.limit(0)).count() == 0


def test_url_rules_run_without_python_workers(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_rules.op12_url_rules(pages)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_scan_carries_values_between_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(i // 3, i, None if i % 7 else i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, t long, v long, d long").repartition(4)
    got = ordered.scan(ordered.in_ranges(df, ["k", "t"]), ["k", "t"], last={"seen": F.col("v")}, sums={"total": F.col("d")}, following={"nxt": F.col("t")}).collect()
    assert sorted((r.t, r.seen, r.total, r.nxt) for r in got) == [(i, i - i % 7, sum(j % 5 for j in range(i + 1)), i + 1 if i < 499 else None) for i in range(500)]


def variants_by_hand(rows, every=97, shortest=5, least=3):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    c = {w: n for w, n in c.items() if len(w) >= shortest and n >= least}
    near = {w: set() for w in c}
    holes = {}
    for w in c:
        for k in range(len(w)):
            holes.setdefault(w[:k] + "*" + w[k + 1 :], set()).add(w)
            short = w[:k] + w[k + 1 :]
            if short in c:
                near[w].add(short)
                near[short].add(w)
    for g in holes.values():
        for w in g:
            near[w] |= g - {w}
    form = {}
    for w, n in c.items():
        best = min(near[w], key=lambda x: (-c[x], x), default=None)
        form[w] = best if best is not None and c[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), c[w], len(near[w]), c[form[w]] if form[w] else None) for w in c)


@pytest.mark.parametrize("letters", ["abc", "abé", "thesing"])
def test_spelling_variants_equal_brute_force(spark, letters):
    r = random.Random(len(letters))
    words = ["".join(r.choice(letters) for _ in range(r.randrange(4, 8))) for _ in range(250)]
    rows = [(i, " ".join(r.choice(words[: 1 + int(250 * r.random() ** 3)]) for _ in range(60))) for i in range(150)]
    rows += [(None, "Ababab ababab, ababac×漢1"), (5, None), (6, ""), *[(7, "x" * 70_000 + " " + "é" * 200 + " ÀBCDEÿ")] * 3]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    got = sorted((x.word, x.form or "", x.root, x.n, x.n_near, x.form_n) for x in spelling.op13_spelling_variants(df).collect())
    assert got == variants_by_hand(rows) and len(got) > 20


def test_spelling_forms_lead_to_one_root(spark):
    counts = {"aaaaa": 3, "aaaab": 7, "aaabb": 15, "aabbb": 40, "abbbb": 90, "bbbbb": 90, "aaaa": 1000, "zzzzz": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.group_variants(df).collect()}
    assert got["zzzzz"] == (None, "zzzzz", 0) and got["bbbbb"] == (None, "bbbbb", 1)
    assert got["aaabb"] == ("aabbb", "abbbb", 2) and got["aaaab"] == ("aaaa", "aaaa", 3)


def test_nothing_to_group(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.op13_spelling_variants(df).count() == 0


def test_crc_of_runs_equals_zlib():
    x = np.frombuffer(bytes(random.Random(2).randrange(256) for _ in range(3000)), np.uint8)
    starts = np.array([0, 5, 5, 100, 200, 1000])
    ends = np.array([5, 5, 9, 164, 265, 3000])
    seeds = np.array([zlib.crc32(b"%d:" % i) for i in range(6)], np.uint32)
    want = [zlib.crc32(x[a:b].tobytes(), int(s)) for a, b, s in zip(starts, ends, seeds, strict=True)]
    assert spelling.crc_of_runs(x, starts, ends, seeds).tolist() == want


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a " * 100_000 + "'>", '<p x="' * 100_000 + ">", "</x>" * 100_000, "<!" * 200_000, "<a '<b \"" * 30_000 + ">", "<" + "a" * 500_000])
def test_broken_markup_is_parsed_in_linear_time(html):
    import time

    from millrace.llm import html_wrapper

    began = time.process_time()
    html_wrapper.parse(html)
    assert time.process_time() - began < 20  # a parser that starts anew at each tag takes hours


def test_deep_pages_keep_their_texts_and_regions():
    from millrace.llm import html_wrapper

    html = "<div>" * 3000 + "kept<article>" + "<div>" * 500 + "story<nav>menu</nav>" + "</div>" * 500 + "</article>"
    blocks = html_wrapper.parse(html)[1]
    assert [b.text for b in blocks] == ["kept", "story", "menu"]
    assert [html_wrapper.place_of(b.path) for b in blocks] == [("body", 2), ("article", 2), ("article", 0)] and max(len(b.path) for b in blocks) < 500


def test_tag_ends_skip_quotes():
    from millrace.llm import html_wrapper

    for html, pos, want in (("<a x='>' y=\">\">t", 2, 15), ("<a '>", 2, -1), ("<a \"b' >\" c>", 2, 12), ("<a", 2, -1)):
        assert html_wrapper.TagEnds(html).after(pos) == want
