"""Filter audit, secret scan and prefix trie against plain Python, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from feedlab.llm import audit, prefix_trie, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    fails = {}
    for n, (i, text, _) in enumerate(docs):
        t = text or ""
        w = WORD.findall(t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails[n] = {c for c, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))), ("E", smaller)) if bad}
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in docs}:
        own = [n for n, d in enumerate(docs) if (d[2] or "") == part]
        total = defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(own)
            for k, c in enumerate(order, 1):
                hit = {n for n in own if c in fails[n]}
                gone = hit & left
                total[c] += len(gone)
                left -= gone
                out[part, order, k] = [len(left), len(gone), len(hit - gone), sum(fails[n] == {c} for n in own), sum(docs[n][0] in good for n in gone), sum(docs[n][0] in toxic for n in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def test_audit_equals_plain(spark):
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long + " #", "A" * 30, None, "", "same same same same", long.upper(), " ".join(["x"] * 300), long * 3, "\x0b \t\n"]
    docs = [(i if i % 11 else None, rng.choice(texts), rng.choice(["s", None, "", "t"])) for i in range(60)]
    docs += docs[:5]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(2, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, source string, prefix string")
    got = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COUNTS] for r in got.collect()} == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    none = audit.audit(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0


PATTERNS = [("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]


def plain_base(text):
    return [(m.start(), i, m.end(), m[g]) for i, (_, p, g, least) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if len(m[g]) >= least]


LIVE = "Zq7Lw2Xv9Kt4Rb8Ny3Hd"


def test_secrets(spark):
    hexes = "0123456789abcdef" * 2
    texts = [
        "ſecret=abcdefgh toKen = 'a1b2c3' PASSWD:short", "token = token = abcdefgh", f"é😀 api_key=\"{hexes}\" AKIA{'Q7' * 9} AKIA12", f"XAKIA{'AB' * 12}AKIA", None, "", "\n \t", f"key {LIVE} end",
        "pass" * 5000 + f" secret : {LIVE}x " + "deadbeef" * 9, "api-key=abcdefghij apikey==abcdef", "Mixed0Example1Placeholder22",
    ]
    docs = [(i, t, f"o{i % 2}") for i, t in enumerate(texts)] + [(100 + i, "see QwErTy7890UiOpAsDf12 here", f"many{i}") for i in range(12)] + [(200 + i, "password=hunter2hunter2", f"many{i}") for i in range(12)]
    docs += [docs[2], (None, texts[2], None), (None, f"other {LIVE}", None)]
    got = secret_scan.scan(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, spans int"), max_owners=3).collect()
    assert len(got) == len(docs)
    by_text = {i: t for i, t, _ in docs if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == sorted(x[:3] for x in plain_base(by_text[r["doc_id"]]))
    one = {r["doc_id"]: r for r in got}
    assert [(s["start"], s["end"]) for s in one[7]["added"]] == [(4, 24)] and one[7]["n_live"] == 1
    assert one[100]["added"] == [] and one[200]["n_examples"] == 1 and one[200]["n_live"] == 0  # twelve owners: copied
    assert one[10]["added"] == []  # a dummy


def test_hot_values_are_split(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'password=hunter2hunter2' AS text", "cast(id % 15 AS string) AS source").union(spark.createDataFrame([(999, f"one {LIVE}", "me")], "doc_id long, text string, source string"))
    found = secret_scan.candidates(docs, "doc_id", "source", "text")
    told = secret_scan.verdicts(found, secret_scan.ownership(found), 2, 20, 10, hot=50, salts=7)
    assert told.count() == 301 and told.where("size(examples) = 1").count() == 300 and told.where("size(live) = 1").count() == 1


def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
            convs[c].append((t is not None, t or 0, tie, (r, x)))
    own = {c: [v[3] for v in sorted(vs)] for c, vs in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, ms in members.items():
        below, leaves, saved = [p], 0, 0
        while below:
            q = below.pop()
            below += kids[q]
            leaves += not kids[q]
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
        ends = ",".join(map(str, sorted(c for c in ms if built[c] == p)))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_equals_plain(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 40), 10**12, 10**12 + 3]:
        if c in (5, 20):  # bases that are absent
            continue
        common = rng.random() < 0.4
        for t in range(rng.choice([1, 2, 3, 9, 12]) if c != 7 else 150):
            rows.append((c, t, rng.choice(["user", "assistant"]) if not common else "user", f"turn {t}" if common else rng.choice(["hé", "ho", None, ""])))
    rows += [(3, None, None, None), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    for turns in (8192, 20):  # one shard, and many
        monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
        got = prefix_trie.trie(df).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
