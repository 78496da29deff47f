"""The ten operators against brute force, and their edge cases."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe_codec, decontaminate, graph, html_wrapper, jaccard_join, lattice_lm, secret_scan, token_count, tool_calls, topk_search, toxicity
from millrace.llm.queries import tokenizer_path

EDGE = [None, "", " ", "a", "a  b", "\n\t x", "x" * 3000, "é漢字 🙂 it's 12,000 <|endoftext|> y", "the end the end the end", "the end the end the end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1) for i, t in enumerate(EDGE)] + [(None, "no id", "en", 1), (3, "a", "de", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")


def fuzz(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("ab'st \n\t\u0085  é漢12.,!🙂re") for _ in range(r.randrange(60))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    counter = token_count.load_counter(path)
    assert [counter.count(t) for t in fuzz(3000)] == [len(library.encode(t, add_special_tokens=False).ids) for t in fuzz(3000)]
    got = token_count.op7_token_counts(docs, path).collect()
    want = Counter((t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for t in [*EDGE, "no id", "a"])
    assert Counter(r.n_tokens for r in got) == Counter([n for _, n in want.elements()])
    assert token_count.op7_token_counts(docs.limit(0), path).count() == 0
    assert token_count.count_tokens(docs, path).columns == ["doc_id", "text", "lang", "n_tokens"]


def test_codec_equals_tiktoken_and_round_trips(spark, docs):
    import tiktoken

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=bpe_codec.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*[t or "" for t in EDGE], *fuzz(300, 2), " ".join(fuzz(200, 3)), "z" * 500 + " end " + "q" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for stride, overlap in ((200_000, 4000), (64, 24), (50, 10)):  # whole, and in chunks with seams (some without a seam)
        got = {r.doc_id: r for r in bpe_codec.encode_decode(df, path, False, stride, overlap).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = library.encode_ordinary(t)
            assert got[i].ids == " ".join(map(str, ids)) and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == t.encode()
    one = bpe_codec.op5_encode_decode(docs, path).where("doc_id = 0").first()
    assert one.n_tokens == 0 and one.ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=8).round(2)]) for i in range(400)] + [(401, None), (500, [1.0, None]), (600, [float("nan")] * 8), (700, []), (402, [0.5] * 8), (403, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(df, F.col("vec_id") % 100 == 0, k=5, query_block=2, shard_rows=64).collect()
    live = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (x for x in live if x % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(live[q], live[c])), c) for c in live if c != q)[:5]
        want |= {(q, k, c, -s) for k, (s, c) in enumerate(scored, 1)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert topk_search.op3_topk(df.limit(0)).count() == 0


def python_spans(text):
    text, found = text or "", []
    for k, rule in enumerate(secret_scan.BASE_RULES):
        for m in re.finditer(rule.pattern, text, re.A):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, rule.kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_secret_scan(spark):
    texts = [None, "", "🙂 password = 'abcdef' x", "secret=token = abcdefgh", "token: abc", "AKIA" + "A" * 16 + " " + "0af" * 8, "Api_Key:ABCDEF0123456789abcdef0123456789", "g" * 5000, "token=abcdef", "token=abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.op6_secret_scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(python_spans(t).encode()).hexdigest(), t
    ledger = secret_scan.scan(secret_scan.blobs(df))
    assert secret_scan.scan(secret_scan.blobs(df), ledger=ledger).count() == 0  # nothing unseen
    newer = (*secret_scan.RULES[:-1], secret_scan.Rule("bearer", r"(?i)\bbearer\x20+([a-z]+)", version=2))
    assert secret_scan.scan(secret_scan.blobs(df), newer, ledger).select(F.explode("findings.kind")).distinct().collect()[0][0] == "bearer"
    named = df.withColumns({c: F.lit(1) for c in ("blob", "found", "_found", "_spans", "findings")})
    clean = {r.doc_id: r.text for r in secret_scan.redact(named, ledger).collect()}
    assert secret_scan.redact(named, ledger).columns == named.columns
    assert clean[2] == "🙂 [SECRET:assign]' x" and clean[0] is None and clean[9] == "[SECRET:assign]"


def test_ledger_is_kept_between_scans(spark, tmp_path):
    first = spark.createDataFrame([(0, "token=abcdef"), (1, "a"), (None, "token=abcdef")], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    assert secret_scan.extend_ledger(first, path, secret_scan.BASE_RULES).count() == 2
    second = first.unionByName(spark.createDataFrame([(2, "AKIA" + "B" * 20), (3, "a")], "doc_id long, text string"))
    whole = secret_scan.extend_ledger(second, path, secret_scan.BASE_RULES)
    assert whole.count() == 3  # one unseen blob
    assert secret_scan.extend_ledger(second, path, secret_scan.BASE_RULES).count() == 3
    more = secret_scan.extend_ledger(second, path)  # the further kinds alone run on all three
    assert more.count() == 6
    kinds = [tuple(r) for r in more.select("blob", F.explode("findings.kind")).collect()]
    assert len(kinds) == len(set(kinds)) == 3 * len(secret_scan.RULES)
    assert secret_scan.op6_secret_scan(second.limit(0)).count() == 0
    assert secret_scan.op6_secret_scan(second).count() == 5


def test_further_kinds_of_secrets(spark):
    texts = {
        "pem": ("-----BEGIN RSA PRIVATE KEY-----", 0), "github": ("x ghp_" + "a1" * 18, 2), "slack": ("xoxb-1234567890-a", 0), "jwt": ("eyJhbGciOiJI.eyJzdWIiOiIx.c2ln", 0),
        "url_login": ("see postgres://me:pw@host/db", 4), "bearer": ("Bearer abcdefghijklmnop==", 0)}
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id string, text string")
    got = {r.doc_id: r.spans.split(",") for r in secret_scan.op6_secret_scan(df).collect()}
    for k, (t, start) in texts.items():
        end = len(t) if k != "url_login" else t.index("host")
        assert f"{k}:{start}:{end}" in got[k], k


def test_jaccard_join_equals_brute_force(spark):
    r = random.Random(3)
    base = [[r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(r.choice([1, 3, 5, 30, 120]))] for _ in range(25)]
    texts = [None, "", "  "]
    for b in base:
        for _ in range(r.randrange(1, 9)):
            w = list(b)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(9))
            texts.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.op2_jaccard_join(df).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    kept = {x.doc_id for x in jaccard_join.keep_one(df).collect()}
    assert kept == {i for i in sets if find(i) == i}
    assert jaccard_join.op2_jaccard_join(df.limit(0)).count() == 0


def test_jaccard_join_of_repeated_rows_null_ids_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (8, ""), (8, ""), (3, "A  B c d e f"), (None, long), (None, long), (9, long + " end")]
    names = ["wins", "copies", "t", "_k", "_t", "_id", "c", "root", "n", "head"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in names})
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op2_jaccard_join(df).collect())
    assert got == Counter({(5, 3, 3): 2, (None, 3, 3): 1, (3, 3, 3): 1, (None, 0, None): 1, (8, 0, 8): 2, (None, 297, 9): 2, (9, 298, 9): 1})
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, "A  B c d e f"), (None, None), (8, ""), (8, ""), (9, long + " end")])


def test_jaccard_join_of_a_loose_family_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(12):  # neighbours of a chain link, others do not
        texts.append(" ".join([f"x{j}" if j < k else w for j, w in enumerate(base)]))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(77)} for t in texts]
    links = [(i, j) for i in range(12) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert 0 < len(links) < 66 and (11, 0) not in links
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.op2_jaccard_join(df).collect()}
    assert got == dict.fromkeys(range(12), 0)


def test_block_overlaps_and_components(spark):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 300)).astype(np.uint64) * np.uint64(2654435761)) for _ in range(60)]
    got = jaccard_join.local_links(sets, sets, 40)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            o = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * o >= 40 * (len(a) + len(b) - o))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {x.v: x.root for x in graph.components(edges).collect()}
    assert len({got[i] for i in range(41)}) == 1 == len({got[i] for i in (100, 101, 102)}) and got[0] != got[100] and len(got) == 44


def naive_tiling(item, doc, least):
    """Textbook greedy string tiling without hashes: number of covered tokens."""
    mi, md, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not mi[i + n] and not md[d + n]:
                    n += 1
                if n >= least:
                    best.append((-n, i, d))
        if not best:
            return covered
        longest = min(best)[0]
        for n, i, d in sorted(best):
            if n == longest and not any(mi[i : i - n]) and not any(md[d : d - n]):
                mi[i : i - n] = md[d : d - n] = [True] * -n
                covered -= n


def test_tiling_equals_brute_force(spark):
    r = random.Random(11)
    items = {i: [r.choice("abcdefgh") + str(r.randrange(3)) for _ in range(r.choice([1, 3, 4, 5, 9, 25]))] for i in range(12)}
    docs = {}
    for d in range(60):
        w = []
        for _ in range(r.randrange(0, 4)):
            x = items[r.randrange(12)]
            at = r.randrange(len(x))
            w += x[at:] + [r.choice("abcdefgh") + str(r.randrange(3)) for _ in range(r.randrange(4))] + x[:at]
        docs[d] = w
    want = set()
    for d, w in docs.items():
        for i, x in items.items():
            covered = naive_tiling(x, w, min(5, len(x)))
            if covered >= 0.5 * len(x):
                want.add((d, i, len(x), covered))
    left = spark.createDataFrame([(d, " ".join(w).upper()) for d, w in docs.items()], "doc_id long, text string")
    right = spark.createDataFrame([(i, ", ".join(x)) for i, x in items.items()], "item_id int, text string")  # any kind of id
    for bound in (10**9, 0):
        got = {tuple(x)[:4] for x in decontaminate.find_leaks(left, right, local_seeds=bound).collect()}
        assert got == want and len(want) > 20
    clean = {x.doc_id for x in decontaminate.clean_documents(left, right).collect()}
    assert clean == set(docs) - {d for d, *_ in want}


def test_decontamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(40))
    w = item.split()
    moved = " ".join(w[20:] + ["filler"] * 3 + w[:20])
    schema = "doc_id long, text string, x string, seeds int, _key string"
    docs = spark.createDataFrame([(k, t, "x", 1, "k") for k, t in ((1, "x y " + item + " z"), (2, moved.upper()), (3, " ".join(w[:10])), (4, None), (5, " ".join(w[::-1])), (1, item), (None, item), (6, ""), (7, "q " * 60_000 + item))], schema)
    bench = spark.createDataFrame([("7", item), ("8", None), ("9", "too short"), (None, "")], "item_id string, text string")
    for bound in (10**9, 0):
        got = sorted((tuple(x) for x in decontaminate.find_leaks(docs, bench, local_seeds=bound).collect()), key=str)
        whole = (40, 40, 1, 1.0)
        assert got == [(1, "7", *whole), (1, "7", *whole), (2, "7", 40, 40, 2, 1.0), (7, "7", *whole), (None, "7", *whole)]
        clean = decontaminate.clean_documents(docs, bench, local_seeds=bound)
        assert {x.doc_id for x in clean.collect()} == {3, 4, 5, 6} and clean.columns == docs.columns
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 == decontaminate.find_leaks(docs, bench.limit(0)).count()
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == 9


def test_lattice_in_plain_numbers_and_in_logarithms():
    """Both ways of summing give the same; words too unlikely for plain numbers are summed as logarithms."""
    r = random.Random(7)
    names = ["▁", *"abcde", "ab", "abc", "▁a", "▁ab", "cde", "é"]
    weights = lattice_lm.Weights.of(names, np.array([[r.random(), r.random()] for _ in names]), np.full((256, 2), 1e-5))
    words = ["".join(r.choice("abcdeéx") for _ in range(r.randrange(1, 9))).encode() for _ in range(300)] + ["日本語".encode() * 9, b"x" * 300, b"\xff\xfe", b"abc" * 40]
    mass = np.array([[r.randrange(3), r.randrange(3)] for _ in words], float)
    got = []
    for least in (lattice_lm.Lattice.LEAST, np.inf):
        lattice = lattice_lm.Lattice(weights)
        lattice.LEAST = least
        ways = {linear for *_, linear in lattice._parts(words)}
        assert ways == ({True, False} if least < 0 else {False})
        pieces, bytes_ = np.zeros((len(names), 2)), np.zeros((256, 2))
        lattice.expect(words, mass, pieces, bytes_)
        got.append((lattice.log_probs(words), pieces, bytes_))
    for plain, log in zip(*got, strict=True):
        assert np.isfinite(plain).all() and np.allclose(plain, log, rtol=1e-9, atol=1e-12)
    assert got[0][0][-3].max() < -745  # no plain number is that small


def test_lattice_sums_over_all_segmentations():
    weights = lattice_lm.Weights.of(["▁", "▁a", "a", "ab", "b", "▁ab"], np.array([[5.0], [3], [4], [2], [6], [1]]), np.full((256, 1), 0.01))
    lattice = lattice_lm.Lattice(weights)
    piece = dict(zip(weights.names, np.exp(weights.pieces[:, 0]), strict=True))
    byte = np.exp(weights.bytes[:, 0])
    @cache
    def total(s):  # plain recursion over prefixes
        if not s:
            return 1.0
        out = sum(p * total(s[len(x) :]) for x, p in piece.items() if s.startswith(x))
        return out + (np.prod(byte[list(s[0].encode())]) * total(s[1:]) if s[0] != "▁" else 0)
    for word in ("a", "ab", "aab", "abé", "b" * 70):
        assert lattice.log_probs([word.encode()])[0, 0] == pytest.approx(math.log(total("▁" + word)))


def test_language_model(spark, docs):
    got = lattice_lm.op1_lattice_lm(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(EDGE)}
    every = [*[(i, w) for i, w in tokens.items()], (None, [b"no", b"id", b""]), (3, [b"a", b""])]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(x for i, w in every if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in every)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_toxicity_separates_held_out_texts(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    def text(bad):
        w = [r.choice(words) for _ in range(60)]
        if bad:
            for _ in range(3):
                w[r.randrange(60)] = "vile" + r.choice("xyzuv") * r.randrange(1, 5)  # rare forms of one stem
        return " ".join(w)
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.op9_toxicity(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[900].predicted == got[901].predicted == 0 and len(got) == 602
    assert toxicity.op9_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.op9_toxicity(docs.limit(0), labels).count() == 0
    long = spark.createDataFrame([(1000 + i, " ".join(text(i % 2) for _ in range(200)), i % 2) for i in range(40)], "doc_id long, text string, toxic int")  # over 50 000 characters each
    model = toxicity.train(long, long, F.lit(False))
    assert len(model.ratio.steps) > 0


def test_kneser_ney_equals_plain_sums():
    texts = {1: ["vile cat", "vile dog", "vile cow", "viler cat"], 0: ["nice cat", "nice dog", "mild cow", "mild day", "nice day"]}
    counts = {y: Counter(s for t in ts for s in {s for w in t.split() for s in toxicity.path(w)}) for y, ts in texts.items()}
    ratio = toxicity.Ratio(counts[1], counts[0])
    below = Counter(toxicity.parent(s) for s in {*counts[0], *counts[1]})

    def probability(word, y):
        d, p, up = toxicity.discounts(counts[y].values()), 1.0, ""
        off = lambda c: c if c < toxicity.CUTOFF else d[min(c, 3) - 1]
        for s in toxicity.path(word):
            total = sum(c for k, c in counts[y].items() if toxicity.parent(k) == up)
            shared = 1 / (below[up] + 1)
            if total:
                saved = sum(off(c) for k, c in counts[y].items() if toxicity.parent(k) == up) / total
                c = counts[y][s]
                p *= (c - off(c)) / total + saved * shared
            else:
                p *= shared
            up = s
        return p

    for w in ("vile", "nice", "cat"):
        assert ratio.word(w) == pytest.approx(math.log(probability(w, 1) / probability(w, 0)))


def test_copies_of_texts_do_not_count_twice():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 30, r.integers(0, 40)).astype(np.int32) for _ in range(30)]
    texts += [t.copy() for t in texts[:10]]
    seen, want = set(), []
    for t in texts:
        grams = {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
        want.append(len(grams & seen) <= 0.3 * len(grams))
        seen |= grams
    assert toxicity.distinct_texts(texts).tolist() == want


def test_html_main_text(spark):
    page = lambda n, extra="": (
        f"<html><body><header>H</header><nav><ul><li>m</li><li>n</li></ul></nav><div class='cookie-notice'>c</div><article><h1>T{n} &amp; co</h1><p>One <b>two</b>\n three{n}<p>Four"
        f"<p>Read our terms.</p>{extra}<section class='comments'><p>first!</p></section></article><aside>s</aside><form>f</form><script>x('</p>')</script><footer>z</footer></body></html>")
    rows = [(n, f"http://h.example/{n}", page(n, "<ul><li>a</li><li>b&nbsp;&nbsp;c</li></ul>" if n % 2 else "")) for n in range(8)] + [(90, None, None), (91, "x", ""), (92, "http://k.example/", "<p>plain</p>")]
    got = {r.page_id: r for r in html_wrapper.op8_html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].text == "T2 & co\nOne two three2\nFour\nRead our terms."
    assert got[3].text.endswith("a\nb c") and "m" not in got[3].text.split("\n") and "first!" not in got[3].text
    assert got[90].text == "" == got[91].text and got[92].text == "plain" and got[92].n_chars == 5


def test_html_constant_slots_of_articles(spark):
    page = lambda n: (
        f"<body><article><h2>Story</h2><div class='lead'>Read our terms.</div><p>own {n}</p><p>shared line</p>{'<ul><li>x</li></ul>' if n % 3 == 2 else ''}"
        f"<div class='lead'>{'Read our terms.' if n == 3 else f'end {n}'}</div><div>As seen on air.</div></article></body>")
    rows = [(n, f"http://h.example/{n}", page(n)) for n in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.op8_html_extraction(df).collect()}
    # the first div.lead and the last div are constant slots; a line shared by paragraphs is not
    assert got[4] == "Story\nown 4\nshared line\nend 4" and got[5] == "Story\nown 5\nshared line\nx\nend 5"
    # the text comes through the wrappers: without slots there is none
    wrappers = html_wrapper.infer_wrappers(df.select(html_wrapper.host_of(F.col("url")).alias("host"), "html"))
    assert {r.text for r in html_wrapper.extract_pages(df, wrappers.limit(0)).collect()} == {""}
    assert {r.page_id: r.text for r in html_wrapper.extract_pages(df, wrappers.withColumn("template", F.lit("[]"))).collect()}[4].count("As seen on air.") == 1


def test_html_slots_without_articles(spark):
    """Pages of bare divs: what a slot's texts do on the host decides.  Brute
    force: a line is template if most distinct pages of the host have it."""
    r = random.Random(4)
    pages = []
    for n in range(40):
        own = [f"{r.choice('abc')} text {n} {k}" for k in range(r.randrange(1, 6))]
        lines = ["Welcome to the site", *own[:1], "Read our terms", *own[1:], "All rights reserved"]
        pages.append((n, f"https://Site.example/{n}", lines))
    pages.append((99, "https://Site.example/1", pages[1][2]))
    html = lambda lines: "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "<ul class='site-nav'><li>x</li></ul></body>"
    n = Counter(x for lines in {tuple(p[2]) for p in pages} for x in set(lines))
    want = {i: "\n".join(x for x in lines if n[x] < 20) for i, _, lines in pages}
    schema = "page_id long, url string, html string, template string, host string, row int, slots int, salt int"
    df = spark.createDataFrame([(i, u, html(x), "t", "h", 1, 2, 3) for i, u, x in pages], schema)
    out = html_wrapper.main_text(df)
    assert out.columns == [*df.columns, "text"] and {r.page_id: r.text for r in out.collect()} == want
    assert html_wrapper.main_text(df.limit(0)).count() == 0


def test_html_doubtful_places_and_long_pages(spark):
    page = lambda n: (
        f"<body><article><div class='entry-header'><h2>Title {n}</h2><p>by writer {n}</p></div><div class='search-tip'>Use the box above.</div>"
        f"<div class='share-bar'>Share {n}</div><p>story {n}</p><div role='alert'>a {n}</div></article></body>")
    long = "<article>" + "<p>one <a <a <a" * 20_000 + "</article>"
    rows = [(n, f"http://h.example/{n}", page(n)) for n in range(10)] * 2 + [(50, "http://h.example/50", long)]
    got = {r.page_id: r.text for r in html_wrapper.op8_html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nby writer 3\nstory 3" and got[50].startswith("one")


def test_html_template_counts(spark):
    copy = "<body><h1>Title</h1><p>the only story</p></body>"
    long = lambda n: f"<body>{''.join(f'<p>own {n} {k}</p><div>more {n} {k}</div>' for k in range(400))}<h4>As seen on air.</h4></body>"
    rows = [(n, f"http://h.example/{n}", copy if n < 20 else f"<body><h1>T{n}</h1><p>story {n}</p></body>") for n in range(30)]
    rows += [(100 + n, f"http://long.example/{n}", long(n)) for n in range(6)]
    got = {r.page_id: r.text for r in html_wrapper.op8_html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # copies of one page do not make its texts template; streams too long for a wrapper are counted
    assert {got[n] for n in range(20)} == {"Title\nthe only story"} and got[25] == "T25\nstory 25"
    assert len(html_wrapper.parse(long(0))[0]) > 2000 and got[103].endswith("more 3 399") and got[103].startswith("own 3 0")


def test_all_skeletons_shape_the_wrapper(spark):
    """A section of skeletons that are not among a host's forty commonest has slots of its own, also in long pages."""
    name = lambda k: f"k{chr(97 + k // 26)}{chr(97 + k % 26)}"
    page = lambda k, n, more: f"<body><article><p>story {n}</p><div class='{name(k)}'>own {n}</div>{more}</article></body>"
    section = lambda n: f"<section><div class='lead'>Read our terms.</div><p>of {n}</p><div class='lead'>end {n}</div></section>"
    rows = [(n, "http://h.example/", page(n % 41, n, "")) for n in range(82)]
    rows += [(100 + n, "http://h.example/", page(50 + n, 100 + n, section(100 + n))) for n in range(90)]
    long = "".join(f"<h5>a</h5><div class='{name(k)}'>x {k}</div>" for k in range(400))
    rows += [(300 + n, "http://long.example/", page(n, n, long + section(n))) for n in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.op8_html_extraction(df).collect()}
    assert got[0] == "story 0\nown 0" and got[150] == "story 150\nown 150\nof 150\nend 150"
    assert len(html_wrapper.folded(html_wrapper.parse(rows[-1][2])[0])[0]) > 2000
    assert got[303].startswith("story 3\nown 3\na\n") and got[303].endswith("\nof 3\nend 3") and "terms" not in got[303]
    for fan_in in (40, 3):
        wrappers = html_wrapper.infer_wrappers(df.select(html_wrapper.host_of(F.col("url")).alias("host"), "html"), fan_in=fan_in)
        items = {r.host: {w[0] for w in json.loads(r.wrapper)} for r in wrappers.collect()}
        assert {f"<div.{name(k)}" for k in [*range(41), *range(50, 140)]} <= items["h.example"]
        assert {f"<div.{name(k)}" for k in range(400)} <= items["long.example"]


def test_longest_common_subsequences():
    r = random.Random(3)
    for n in range(300):
        a, b = ([r.choice("abcdefgh"[: 1 + n % 8]) for _ in range(r.randrange(40))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for room in (1 << 25, 1):
            pairs = html_wrapper.common_pairs(a, b, room)
            assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        for first in (a, html_wrapper.Bits(a)):
            runs = html_wrapper.blocks_of(first, b, 0)
            assert runs[-1] == (len(a), len(b), 0) and sum(x[2] for x in runs) == best[-1][-1]
            assert all(a[x : x + k] == b[y : y + k] for x, y, k in runs)


def test_wrapper_inference():
    fold = html_wrapper.fold
    assert fold("<ul <li #x >li <li #x >li <li #x >li >ul".split()) == "<ul <li #x >li+ >ul".split()
    wrapper = html_wrapper.infer([fold("<a #t >a <b >b".split()), fold("<a #t >a <c >c <b >b".split()), fold("<a #t >a <b >b".split())])
    assert wrapper == [["<a", False, False], ["#t", False, False], [">a", False, False], ["<c", True, False], [">c", True, False], ["<b", False, False], [">b", False, False]]


def test_tool_calls(spark):
    schemas = {"f": {"x": ("integer", True), "y": ("string", False)}}
    calls = spark.createDataFrame([
        (1, 0, "a", "f", '{"y": "é\\"", "x": 1}', None), (1, 2, "b", "f", '{"x": "1"}', "a"), (1, 4, "c", "g", "{}", "b"), (1, 6, "d", "f", "oops", "zz"), (2, 0, "p", "f", '{"x":1,"z":2}', "q"), (2, 1, "q", "f", '{"x":1}', "p"),
        (1, 9, "a", "f", '{"x": 2}', None), (None, 0, "n", "f", '{"x": 3}', None), (3, 0, "r", "f", '{"x":1}', None)], "conv_id long, turn long, call_id string, tool string, arguments string, parent_id string")
    results = spark.createDataFrame([(1, 1, "a", "ok"), (1, 7, "a", "again"), (1, 3, "b", None), (9, 1, "a", "lost"), (2, 2, "p", "r"), (2, 2, "q", "r"), (1, 5, "c", ""), (1, 7, "d", "x")], "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert got[1, "a"].json == '{"arguments":{"x":1,"y":"é\\""},"call_id":"a","content":"ok","tool":"f"}' and got[1, "a"].n_results == 2
    assert {k: (r.depth, r.status) for k, r in got.items()} == {
        (1, "a"): (0, "ok"), (1, "b"): (1, "invalid"), (1, "c"): (2, "invalid"), (1, "d"): (0, "invalid"), (2, "p"): (None, "cycle"), (2, "q"): (None, "cycle"), (None, "n"): (0, "no_result"), (9, "a"): (None, "orphan_result"), (3, "r"): (0, "no_result")}
    assert got[1, "b"].errors == ["x is not integer"] and got[2, "p"].errors == ["unknown: z"] and got[1, "d"].errors == ["arguments are not JSON"] and got[1, "c"].errors == ["unknown tool"]
    chain = spark.createDataFrame([(1, i, f"c{i}", "f", '{"x":1}', f"c{i-1}" if i else None) for i in range(30)], calls.schema)
    assert sorted(r.depth for r in tool_calls.depths(chain).collect()) == list(range(30))
    json.loads(got[9, "a"].json)
