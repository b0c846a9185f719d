"""The registered queries op1_.. to op10_.. with production parameters, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontam, html, jaccard, line_dedup, prefix_trie, quality, secret_scan, sharding, suffix_tree, urls, warc
from .common import COMPACT, shared_dir, stored, table

SHARDS = [f"shard-{i:03d}" for i in range(64)]
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: A host with a page whose url has one of these as a part of a label or of the path is on the block list of op5.
BLOCK_TERMS = r"(^|[/.=_-])(spam|casino|pills|bets|ads)([/.=_-]|$)"


def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boiler_words")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    raw, done = shared_dir(spark, "warc-raw"), shared_dir(spark, "warc")
    warc.write_monolithic(warc.plan_records(pages, "page_id", "url", "html"), raw)
    warc.normalise(spark, raw, done).agg(F.sum("n_records")).collect()
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    got = warc.read_records(warc.read_index(spark, done), with_payload=False)
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", suffix_tree.held_out(F.col("doc_id")))
    docs = stored(suffix_tree.symbols(docs), "lm-symbols", options=COMPACT)
    model, words = suffix_tree.fit(docs.where("NOT held_out"))
    return suffix_tree.score(docs, model, words)


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("url").rlike(BLOCK_TERMS)).select(urls.host_of(F.col("url")).alias("key")).distinct()
    out = urls.judge(pages, listed, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op7_byte_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(tokenizer))
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def op8_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs, ["source", "doc_id"], SHARDS).select("doc_id", "source", "n_chars", "slot", "shard")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op11_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    each = [of(i).alias(f"n_{k}") for i, k in enumerate(secret_scan.BASE)]
    everything = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return out.select("doc_id", *each, F.sha2(secret_scan.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(everything).alias("spans"), F.size("added").cast("long").alias("n_added"), "n_live", "n_examples")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_lines, op2_decontaminate, op3_warc, op4_suffix_tree, op5_url_cascade, op6_line_windows, op7_byte_bpe, op8_shard_table, op9_main_text, op10_ngram_jaccard, op11_secret_owners, op12_prefix_trie, op13_filter_audit)}

_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = "(" + _KEYWORDS + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Matches of a pattern, their values and what stands between them, of which the starts are the running sums.
_MATCHES = "regexp_extract_all(t, '{0}') AS m, regexp_extract_all(t, '{0}', {1}) AS v, string_split_regex(t, '{0}') AS s"


ORACLES = {
    "op1_quality_lines": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT doc_id, source, t, ls, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl FROM w),
x AS (SELECT doc_id, source, t, list_transform(fl, lambda y: trim(lower(regexp_replace(y, '[\x20\x09-\x0D]+', ' ', 'g')), ' ')) AS xs FROM b),
y AS (SELECT doc_id, source, line, len(string_split(line, ' ')) AS n FROM (SELECT doc_id, source, unnest(xs) AS line FROM x)),
tx AS (SELECT min(doc_id) AS id, source, any_value(list_distinct(xs)) AS xs FROM x GROUP BY source, t),
tl AS (SELECT id, source, line, string_split(line, ' ') AS w FROM (SELECT id, source, unnest(xs) AS line FROM tx)),
te AS (SELECT id, source, line, len(w) AS n, CASE WHEN len(w) >= 6 THEN 3 ELSE 2 END AS e, w FROM tl),
tm AS (SELECT id, source, line, n, CASE WHEN n >= 3 THEN ['first ' || array_to_string(w[1:e], ' '), 'last ' || array_to_string(w[n - e + 1:n], ' ')] ELSE [] END AS ends FROM te),
z AS (SELECT source, line, any_value(ends) AS ends FROM tm GROUP BY source, line HAVING count(*) > 20),
ze AS (SELECT DISTINCT source, unnest(ends) AS e FROM z),
near AS (SELECT DISTINCT id, line FROM (SELECT id, source, line, unnest(ends) AS e FROM tm) m JOIN ze ON ze.source IS NOT DISTINCT FROM m.source AND ze.e = m.e),
k AS (SELECT m.id, m.source, m.line, m.n, z.line IS NOT NULL AS known, z.line IS NULL AND near.id IS NULL AS own FROM tm m LEFT JOIN z ON z.source IS NOT DISTINCT FROM m.source AND z.line = m.line LEFT JOIN near ON near.id = m.id AND near.line = m.line),
kd AS (SELECT id, source, list(line) FILTER (known) AS hits, CASE WHEN sum(CASE WHEN own THEN n ELSE 0 END) > 0 AND 10 * sum(CASE WHEN own THEN n ELSE 0 END) >= sum(n) THEN list_sort(list(line) FILTER (own)) END AS kind FROM k GROUP BY id, source),
h2 AS (SELECT source, line, count(DISTINCT kind) AS kinds, count(*) FILTER (kind IS NULL) AS copies FROM (SELECT source, kind, unnest(hits) AS line FROM kd) GROUP BY source, line),
h3 AS (SELECT source, line, kinds + least(copies, 1) - copies / 10 AS docs FROM h2),
f AS (SELECT h3.source, line FROM h3 JOIN (SELECT source, count(*) AS s FROM d GROUP BY source) c ON c.source IS NOT DISTINCT FROM h3.source WHERE docs > 20 AND (docs > 100 OR docs > 0.01 * s)),
q AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_boiler_words FROM y JOIN f ON f.source IS NOT DISTINCT FROM y.source AND f.line = y.line GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(fl) - len(list_distinct(fl)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed, coalesce(n_boiler_words, 0) AS n_boiler_words,
  NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND NOT coalesce(n_boiler_words, 0) > 0.5 * n_words AS kept
FROM b LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op6_line_windows": r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, ls FROM d),
f AS (SELECT doc_id, p, trim(ls[p], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM l WHERE regexp_matches(ls[p], '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, p, lead(p) OVER o AS p2, lead(p, 2) OVER o AS p3, [s, lead(s) OVER o, lead(s, 2) OVER o] AS k FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, p2, p3, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM w WHERE p3 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest([p, p2, p3]) AS p FROM r WHERE nth > 1),
g AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
e AS (SELECT l.doc_id, string_agg(ls[l.p], chr(10) ORDER BY l.p) AS rest FROM l ANTI JOIN c ON l.doc_id = c.doc_id AND l.p = c.p GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN n_removed IS NULL THEN text ELSE coalesce(rest, '') END AS text, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN e ON d.doc_id = e.doc_id""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM r""",
    "op5_url_cascade": r"""
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
rules(rule, name, start, what) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what FROM u JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id),
b AS (SELECT DISTINCT host FROM u JOIN pages USING (page_id) WHERE regexp_matches(url, '(^|[/.=_-])(spam|casino|pills|bets|ads)([/.=_-]|$)'))
SELECT u.page_id, host, path, rule, coalesce(what, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN m USING (page_id)""",
    "op10_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
z AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT z.y, r.c FROM r JOIN z ON z.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, unnest([CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
  + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
  + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER)]) AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN s USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT p.x || q.x || r.x || u.x || v.x AS filter_order, [p.b, q.b, r.b, u.b, v.b] AS bs FROM b p, b q, b r, b u, b v WHERE p.b + q.b + r.b + u.b + v.b = 31 AND len(list_distinct([p.b, q.b, r.b, u.b, v.b])) = 5),
st AS (SELECT filter_order, step, bs[step] AS own, CAST(coalesce(list_sum(bs[1:step - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) g(step)),
k AS (SELECT part, filter_order, step, own, sum(CASE WHEN m & (before + own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & own > 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN m & own > 0 AND m & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN m & own > 0 AND m & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & own > 0 AND m & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, st GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM k""",
    "op11_secret_owners": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, owner, 0 AS kind, 6 AS least, {_MATCHES.format(_ASSIGN, 2)} FROM d UNION ALL SELECT doc_id, owner, 1, 20, {_MATCHES.format("AKIA[A-Z0-9]+", 0)} FROM d
  UNION ALL SELECT doc_id, owner, 2, 24, {_MATCHES.format("[0-9a-f]{24,}", 0)} FROM d UNION ALL SELECT doc_id, owner, 3, 20, {_MATCHES.format("[A-Za-z0-9+/_=-]{20,}", 0)} FROM d),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r WHERE len(m) > 0),
p AS (SELECT doc_id, owner, kind, least, v[i] AS value, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b, length(m[i]) AS n FROM i),
c AS (SELECT doc_id, owner, kind, value, CAST(b AS BIGINT) AS b, CAST(b + n AS BIGINT) AS e, len(list_distinct(string_split(value, ''))) AS chars,
  len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(lower(value), 'example|changeme|placeholder|your|xxxx|12345|abcdef') AS random FROM p WHERE length(value) >= least),
g AS (SELECT * FROM c WHERE kind < 3 UNION ALL SELECT * FROM c WHERE kind = 3 AND random AND chars >= 12 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM c x WHERE x.kind < 3 AND x.doc_id = c.doc_id AND x.b < c.e AND c.b < x.e)),
o AS (SELECT value, count(DISTINCT doc_id) AS repos, count(DISTINCT owner) AS owners FROM g GROUP BY value),
f AS (SELECT g.*, owners <= 2 AND repos <= 20 AND random AS live, owners >= 10 AS copied, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || b || ':' || e AS name FROM g JOIN o USING (value)),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name, ',' ORDER BY b, kind) FILTER (kind < 3) AS base,
  string_agg(name, ',' ORDER BY b, kind) FILTER (kind < 3 OR live) AS spans, count(*) FILTER (kind = 3 AND live) AS n_added, count(*) FILTER (live) AS n_live, count(*) FILTER (copied AND kind < 3) AS n_examples FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_added, 0) AS n_added, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples FROM d LEFT JOIN a USING (doc_id)""",
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(s ORDER BY p) AS l, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS UBIGINT[])), lambda u, v: CASE WHEN u % 2 = 1 THEN xor(u // 2, CAST(3988292384 AS UBIGINT)) ELSE u // 2 END)) AS z FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, CAST(xor(z, CAST(4294967295 AS UBIGINT)) % 9 AS BIGINT) AS h FROM c),
r AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 5),
m AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r),
n AS (SELECT l[1:d] AS path, d AS depth, count(*) AS n_convs, min(conv_id) AS conv_id, string_agg(CASE WHEN len(l) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM m GROUP BY l[1:d], d),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
g AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(n.path[depth].x)) ELSE 0 END AS saved FROM n LEFT JOIN k ON n.path = k.path),
u AS (SELECT path[1:i] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM g) GROUP BY path[1:i])
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN u ON g.path = u.path LEFT JOIN g p ON g.depth = p.depth + 1 AND g.path[1:g.depth - 1] = p.path""",
}
