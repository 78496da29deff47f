"""The stages by brute force over the smallest tables."""

import base64
import re
import zlib

import corpus_pipeline
from millrace.llm import secret_scan, toxicity
from millrace.llm.pretok import PATTERN
from millrace.llm.queries import tokenizer_path
from millrace.runtime import read
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def naive_coverage(item, doc, least):
    """Share of an item's words that greedy string tiling covers, without hashes."""
    mi, md, covered = [False] * len(item), [False] * len(doc), 0
    at = {}
    for d, w in enumerate(doc):
        at.setdefault(w, []).append(d)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in at.get(item[i], ()):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not mi[i + n] and not md[d + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < least:
            return covered / len(item)
        mi[i : i + n] = md[d : d + n] = [True] * n
        covered += n


def python_redact(text):
    """Secrets of every kind by Python's own patterns."""
    found = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text, re.A):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, rule.kind, m.end()))
    out, at = "", 0
    for start, _, kind, end in sorted(found):
        if start >= at:
            out += text[at:start] + f"[SECRET:{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark):
    import tiktoken

    docs = read(spark, SF, "documents").toPandas()
    labels = dict(read(spark, SF, "labels").where("toxic is not null").select("doc_id", "toxic").toPandas().itertuples(index=False))
    spread = {}  # the trained model is data here: the stage must act on its scores
    held = toxicity.in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.train(read(spark, SF, "documents"), read(spark, SF, "labels"), held)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        spread[i] = model.score(t)
    unseen = [(spread[i] >= 0.5) == bool(y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(unseen) >= 0.9 * len(unseen)
    left = {i: t for i, t in zip(docs.doc_id, docs.text, strict=True) if spread[i] < 0.5}
    sets = {}
    for i, t in left.items():
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {i: t for i, t in left.items() if find(i) == i}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(t) for t in read(spark, SF, "benchmark").toPandas().text]
    left = {i: t for i, t in left.items() if not any(naive_coverage(x, words(t), min(5, len(x))) >= 0.5 for x in items if x)}
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(python_redact(t)) for i, t in left.items()}
    assert len(want) < len(docs)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    names = ["wins", "copies", "blob", "found", "row", "k", "key", "t", "x", "_toxicity"]
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, text), (2, None), (2, None), (3, ""), (4, "token=abcdefgh here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("v") for c in names})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == sorted([(1, text), (2, None), (2, None), (3, ""), (4, "[SECRET:assign] here"), (None, None)], key=str)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == 6 and "_toxicity" in last.columns and last.where("doc_id = 3 and n_tokens = 0").count() == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_near_copies_by_five_words(spark):
    words = [f"w{i}" for i in range(100)]
    texts = {1: words, 2: words[:82], 3: [*words[:50], "x", *words[51:]], 4: words[:78], 5: words[::-1]}
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in texts.items()}
    near = {j for j in texts for i in texts if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert near == {2, 3, 4} and got == {1, 5}
