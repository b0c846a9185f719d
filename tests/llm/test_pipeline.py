"""The corpus pipeline against plain Python, stage by stage and as a whole, and on odd rows."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from feedlab.llm import bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_quality(rows):
    """Rows are (doc_id, text, source); lines are boilerplate as the operator's docstring says."""
    lines = lambda t: [" ".join(WORD.findall(x)).lower() for x in (t or "").split("\n") if WORD.search(x)]
    sizes, texts = Counter(s for _, _, s in rows), {(s, t or "") for _, t, s in rows}

    def ends(x):
        w = x.split(" ")
        e = 3 if len(w) >= 6 else 2
        return [("first", *w[:e]), ("last", *w[-e:])] if len(w) >= 3 else []

    held = Counter((s, x) for s, t in texts for x in set(lines(t)))
    often = {k for k, n in held.items() if n > 20}
    edges = {(s, e) for s, x in often for e in ends(x)}
    kinds = {}
    for s, t in texts:
        own = {x for x in lines(t) if (s, x) not in often and not any((s, e) in edges for e in ends(x))}
        words = sum(len(x.split(" ")) for x in own)
        kind = frozenset(own) if words and 10 * words >= sum(len(x.split(" ")) for x in set(lines(t))) else None
        for x in set(lines(t)):
            kinds.setdefault((s, x), []).append(kind)
    boiler = set()
    for (s, x), found in kinds.items():
        copies = found.count(None)
        n = len(set(found) - {None}) + min(copies, 1) - copies / 10
        if (s, x) in often and n > 20 and (n > 100 or n > 0.01 * sizes[s]):
            boiler.add((s, x))
    out = []
    for key, t, s in rows:
        w = WORD.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lost = sum(len(x.split(" ")) for x in lines(t) if (s, x) in boiler)
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and lost <= 0.5 * len(w):
            out.append((key, "\n".join(x for x in t.split("\n") if not WORD.search(x) or (s, " ".join(WORD.findall(x)).lower()) not in boiler), s))
    return out


def brute_windows(rows):
    """For rows with distinct keys."""
    seen, out = set(), []
    for key, t, s in sorted(rows, key=lambda r: r[0]):
        full = [(i, x.strip(" \t\n\x0b\f\r")) for i, x in enumerate(t.split("\n")) if WORD.search(x)]
        cut = set()
        for a, b, c in zip(full, full[1:], full[2:], strict=False):
            if (w := (a[1], b[1], c[1])) in seen:
                cut |= {a[0], b[0], c[0]}
            seen.add(w)
        text = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut)
        if not cut or WORD.search(text):
            out.append((key, text, s))
    return out


def brute_near(rows, k=5):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(t.translate(ASCII))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    least = {r[0]: r[0] for r in rows}
    for _ in rows:
        before = dict(least)
        for i, a in enumerate(rows):
            for j in range(i):
                if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    least[a[0]] = least[rows[j][0]] = min(least[a[0]], least[rows[j][0]])
        if before == least:
            break
    return [r for r in rows if least[r[0]] == r[0]]


def held(text, items, run=13, identity=0.8):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    d = tokens(text)
    for item in map(tokens, items):
        need = min(len(item), run)
        for offset in range(-len(item) + 1, len(d)):
            same = [0 <= j + offset < len(d) and d[j + offset] == x for j, x in enumerate(item)]
            if need and any(sum(same[i : i + need]) >= math.ceil(identity * need) for i in range(len(same) - need + 1)):
                return True
    return False


def corpus(spark, tmp_path, seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(words(n)) for n in (20, 8, 30, 13)]

    def text(n, *ends):
        w = words(n)
        return "\n".join([*[" ".join(w[i : i + 10]) for i in range(0, n, 10)], *ends])

    texts = [text(rng.randrange(30, 120)) for _ in range(30)] + [text(60, "Share this  page", "All rights reserved by the host of these many pages and all of their friends, now and for ever, in every land.") for _ in range(26)]
    passage = "\n".join(" ".join(words(18)) for _ in range(4))
    texts += [text(60) + "\n" + passage for _ in range(5)] + [passage + "\n" + text(60)]
    for base in [text(100), text(80)]:
        for k in range(6):
            w = base.split(" ")
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [text(60) + " " + items[0], items[1] + " " + text(60), text(70) + "\n" + " ".join(x if i % 9 else "other" for i, x in enumerate(items[2].split(" "))) + "\n" + text(20), text(60) + " " + " ".join(items[3].split(" ")[:7])]
    texts += ["", " \n ", "too short", "again and again " * 40, text(5000)]
    rng.shuffle(texts)
    rows = [(3 * i + 1, t, rng.choice("ab")) for i, t in enumerate(texts)]
    spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], DOCS).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return rows, items, f"file://{tmp_path}"


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows, items, folder = corpus(spark, tmp_path)
    brutes = [brute_quality, brute_windows, brute_near, lambda r: [x for x in r if not held(x[1], items)]]
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), [len(rows)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], brutes, strict=True):
        want = brute(sorted(rows))
        out = stage(spark, docs, folder)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        got = docs.collect()
        assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in got)
        rows = want
        counts.append(len(rows))
    assert counts == sorted(counts, reverse=True) and len(set(counts)) >= 4
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {k: enc.encode_ordinary(t) for k, t, _ in rows}
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: list(r.ids) for r in final} == want and all(r.decodes and r.n_tokens == len(r.ids) for r in final)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (None, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    long = " ".join(f"v{i}" for i in range(20_000))
    rows = [(1, None, "s"), (2, "", None), (None, long, None), (4, long, "s"), (4, long, "s"), (5, " ".join(f"u{i}" for i in range(80)), None), (None, None, None)]
    df = spark.createDataFrame([(k, t, None, s, None) for k, t, s in rows], DOCS)
    extra = df.withColumns({c: F.lit("clash") for c in ("boiler", "n_words", "kept", "host", "line", "k", "t", "h", "node", "list", "size", "component_id", "item", "seed", "ids", "_words", "_starts", "n_removed", "_keep", "_bad")})
    out = stage(spark, extra, f"file://{tmp_path}")
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and "boiler" not in out.columns
    alike = {"quality_rules": {(None, long): 1, (4, long): 2, (5, rows[5][1]): 1}}
    assert got == Counter(alike.get(name) or Counter((k, t) for k, t, _ in rows))
    assert stage(spark, extra.limit(0), f"file://{tmp_path}").count() == 0
