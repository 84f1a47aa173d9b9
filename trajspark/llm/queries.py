"""The corpus operators over the stock tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    html_extract,
    multiset_hash,
    packing,
    periodic,
    resampling,
    secrets,
    sharding,
    simhash,
    substring_dedup,
    token_count,
    toxicity,
    url_filter,
)
from .common import table

SHARDS = 40
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on this machine; it's a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op9_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _repeating(text: Column, doc_id: Column) -> Column:
    """The text with its end made periodic where the id's CRC is a multiple of 10: each word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10))

    def changed(words: Column) -> Column:
        # one-element arrays bind what every word needs, so that it is computed once a text
        n = F.size(words).cast("long")
        at = F.array(F.struct(g % n, F.lit(1) + F.floor((n - g % n) / (F.lit(3) + g % 8))).cast("struct<a: bigint, p: bigint>"))
        place = lambda i, k: F.when(i < k["a"], i).otherwise(k["a"] + (i - k["a"]) % k["p"])
        each = lambda k: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i, k)))
        return F.when(n > 0, F.array_join(F.transform(at, each)[0], " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), changed)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _repeating(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.periodic_runs(docs)
    # greatest length, then smallest start, then smallest period
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    written = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), F.array_max(order).alias("r"), written.alias("written")).select(
        "doc_id", "n_runs", (-F.col("r.start")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.period")).alias("period"),
        F.expr("1000 * r.length div -r.period").alias("exponent_milli"),
        F.sha2(F.col("written").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = secrets.KINDS[:3]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(of(*base)).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def _fifth(x: str) -> str:
    p = sharding.PRIME
    return f"(((({x})*({x})%{p})*(({x})*({x})%{p})%{p})*({x})%{p})"


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"  # one bit of CRC-32
OP1 = f"""
WITH RECURSIVE bits(i, round, c) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, round + 1, {_STEP} FROM bits WHERE round < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE round = 8),
d AS (SELECT row_number() OVER () AS uid, doc_id, octet_length(encode(coalesce(text, ''))) + {sharding.ROW_OVERHEAD} AS size,
        md5(coalesce(doc_id::VARCHAR, 'null')) AS h, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
z AS (SELECT uid, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda b: ('0x' || b)::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
k AS (SELECT uid, ('0x' || substr(h, 1, 12))::BIGINT % {sharding.PRIME} AS a, ('0x' || substr(h, 13, 12))::BIGINT % {sharding.PRIME} AS b FROM d),
s AS (SELECT uid, i, (a + i * {sharding.STEP}) % {sharding.PRIME} AS x, b FROM k, range(0, {SHARDS + 1}) r(i)),
s2 AS (SELECT uid, i, ({_fifth('x')} + b) % {sharding.PRIME} AS y FROM s),
s3 AS (SELECT uid, i, {_fifth('y')} AS draw FROM s2),
best AS (SELECT uid, arg_max(i, draw * 64 - i) FILTER (i < {SHARDS})::INT AS shard, arg_max(i, draw * 64 - i)::INT AS grown_shard FROM s3 GROUP BY uid)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM d JOIN z USING (uid) JOIN best USING (uid)
"""

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
OP2 = f"""
WITH r(verdict, h, p) AS (VALUES {_RULES}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.page_id, s.host, s.path, r.h || r.p AS rule, r.verdict,
        row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS n
      FROM s LEFT JOIN r ON (s.host = r.h OR s.host LIKE '%.' || r.h) AND starts_with(s.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

_N = substring_dedup.WINDOW
OP8 = rf"""
WITH w AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT uid, doc_id, i, array_to_string(words[i : i + {_N - 1}], ' ') AS passage FROM (SELECT uid, doc_id, words, unnest(range(1, len(words) - {_N - 2})) AS i FROM w WHERE len(words) >= {_N})),
f AS (SELECT uid, i, min(doc_id) OVER (PARTITION BY passage) < doc_id AS again FROM s),
p AS (SELECT uid, doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
c AS (SELECT p.uid, p.i, p.word, coalesce(max(CASE WHEN f.again THEN p.i END) OVER (PARTITION BY p.uid ORDER BY p.i) >= p.i - {_N - 1}, false) AS gone FROM p LEFT JOIN f USING (uid, i)),
k AS (SELECT uid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY uid)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (uid)
"""

_W = f"""('0x' || substr(h, 1, 8))::BIGINT AS w0, ('0x' || substr(h, 9, 8))::BIGINT AS w1, ('0x' || substr(h, 17, 8))::BIGINT AS w2, ('0x' || substr(h, 25, 8))::BIGINT AS w3"""
_K, _S, _M, _L = multiset_hash.LANES, multiset_hash.SPARSE, multiset_hash.MODULUS, multiset_hash.STRATA
_PARAGRAPH = multiset_hash.PARAGRAPH.replace("\\n", "\n")


def _likeness(left: str, right: str) -> str:
    """Of the first stratum that isn't crowded, or the one before it where that one tells little."""
    lanes = f"list_zip({left}[s * {_K} + 1 : s * {_K} + {_K}], {right}[s * {_K} + 1 : s * {_K} + {_K}])"
    used, same = f"[len([x for x in {lanes} if x[1] <> 0 OR x[2] <> 0]) for s in range({_L})]", f"[len([x for x in {lanes} if x[1] <> 0 AND x[1] = x[2]]) for s in range({_L})]"
    return f"struct_pack(used := {used}, same := {same})"


_FIRST = f"coalesce(list_min([k for k in range({_L}) if u.used[k + 1] <= {multiset_hash.CROWDED}]), {_L - 1})"
OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id,
        coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT doc_id, next_id, text, substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM n),
t AS (SELECT doc_id, 0 AS which, text AS body FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
p AS (SELECT doc_id, which, md5(unnest(regexp_extract_all(body, '{_PARAGRAPH}'))) AS h FROM t),
w AS (SELECT doc_id, which, {_W} FROM p),
l AS (SELECT doc_id, which, s * {_K} + w0 % {_K} AS lane, (w0 * 4 + w1 % 4 + 1) % {_M - 1} + 1 AS v FROM w, range(0, {_L}) r(s) WHERE w2 % (4 ** s)::BIGINT = 0
      UNION ALL SELECT doc_id, which, {_S}, w0 FROM w UNION ALL SELECT doc_id, which, {_S} + 1, w1 FROM w
      UNION ALL SELECT doc_id, which, {_S} + 2, w2 FROM w UNION ALL SELECT doc_id, which, {_S} + 3, w3 FROM w),
g AS (SELECT doc_id, which, lane, (sum(v) % {_M})::BIGINT AS v FROM l GROUP BY ALL),
a AS (SELECT t.doc_id, t.which, i AS lane, coalesce(g.v, 0) AS v FROM t CROSS JOIN range(0, {_S + multiset_hash.DENSE}) r(i)
      LEFT JOIN g ON g.doc_id = t.doc_id AND g.which = t.which AND g.lane = i),
f AS (SELECT doc_id, which, string_agg(lpad(printf('%x', v), 8, '0'), '' ORDER BY lane) AS fp, list(v ORDER BY lane) FILTER (lane < {_S}) AS s FROM a GROUP BY ALL),
j AS (SELECT e.doc_id, e.text, e.edited, f0.fp AS fp, f1.fp AS edited_fp, f0.s AS s0, f1.s AS s1, f2.s AS s2 FROM e
      JOIN f f0 ON f0.doc_id = e.doc_id AND f0.which = 0 JOIN f f1 ON f1.doc_id = e.doc_id AND f1.which = 1
      JOIN f f2 ON f2.doc_id = e.next_id AND f2.which = 0),
c AS (SELECT doc_id, text, edited, fp, edited_fp, kind, u, {_FIRST} AS k FROM
      (SELECT *, 0 AS kind, {_likeness('s0', 's1')} AS u FROM j UNION ALL SELECT *, 1, {_likeness('s0', 's2')} FROM j)),
b AS (SELECT *, CASE WHEN k > 0 AND u.used[k + 1] < {multiset_hash.CROWDED // 4} THEN k ELSE k + 1 END AS pos FROM c),
r AS (SELECT *, CASE WHEN u.used[pos] = 0 THEN 1.0::DOUBLE ELSE u.same[pos]::DOUBLE / u.used[pos]::DOUBLE END AS near FROM b)
SELECT doc_id, any_value(length(text))::BIGINT AS n_chars, any_value(sha256(edited)) AS edited_sha256, any_value(fp) AS fingerprint, any_value(edited_fp) AS edited_fingerprint,
  max(near) FILTER (kind = 0) AS near_edited, max(near) FILTER (kind = 1) AS near_next FROM r GROUP BY doc_id
"""

_CRC = f"""WITH RECURSIVE bits(i, round, c) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, round + 1, {_STEP} FROM bits WHERE round < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE round = 8)"""


def _crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


_G, _B = resampling.GRAMS, resampling.BUCKETS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11 = rf"""
{_CRC},
d AS (SELECT 0 AS side, row_number() OVER () AS uid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
f AS (SELECT side, uid, array_to_string(words[i : i + n - 1], ' ') AS feature FROM (SELECT side, uid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, range(1, {_G + 1}) r(n))),
c AS (SELECT side, uid, feature, count(*) AS k FROM f GROUP BY ALL),
h AS (SELECT feature, {_crc32('feature')} % {_B} AS bucket FROM (SELECT DISTINCT feature FROM c), crc),
b AS (SELECT bucket, coalesce(sum(k) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 1), 0)::DOUBLE AS t FROM c JOIN h USING (feature) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + {_B}) / ((s + 1) * ((SELECT sum(t) FROM b) + {_B}))))::BIGINT AS gain FROM b),
x AS (SELECT uid, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM c JOIN h USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
y AS (SELECT uid, doc_id, len(words) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS draw FROM w LEFT JOIN x USING (uid) WHERE side = 0),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((draw + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
p AS (SELECT *, n >= {resampling.LEAST_WORDS} AS fit, row_number() OVER (PARTITION BY n >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {resampling.PERCENT} * (SELECT count(*) FROM p WHERE fit) // 100 THEN place END AS rank FROM p
"""

_Q = periodic.LEAST // 2  # any run has that many words in a row that equal those a period later
OP12 = rf"""
{_CRC},
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
h AS (SELECT uid, {_crc32('doc_id::VARCHAR')} AS h FROM d, crc WHERE doc_id IS NOT NULL),
a AS (SELECT uid, doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS changes, h // 10 % greatest(len(words), 1) AS a, h // 10 % 8 AS e FROM d LEFT JOIN h USING (uid)),
m AS (SELECT uid, doc_id, n, CASE WHEN changes THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] END) ELSE words END AS words FROM a),
w AS (SELECT uid, n, i, array_to_string(words[i + 1 : i + {_Q}], ' ') AS gram FROM (SELECT uid, n, words, unnest(range(0, n - {_Q - 1})) AS i FROM m)),
e AS (SELECT x.uid, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.uid = y.uid AND x.gram = y.gram AND y.i > x.i AND y.i - x.i <= x.n // 2),
j AS (SELECT uid, q, i, i - row_number() OVER (PARTITION BY uid, q ORDER BY i) AS island FROM e),
s AS (SELECT uid, q, min(i) AS start, count(*) + {_Q - 1} + q AS length FROM j GROUP BY uid, q, island HAVING count(*) + {_Q - 1} + q >= greatest({periodic.LEAST}, 2 * q)),
r AS (SELECT uid, start, length, min(q) AS period FROM s GROUP BY ALL),
t AS (SELECT uid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS written,
        arg_min(struct_pack(start, length, period), (-length, start, period)) AS best FROM r GROUP BY 1),
x AS (SELECT DISTINCT uid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT uid, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT uid, unnest(words) AS word, unnest(range(n)) AS i FROM m) ANTI JOIN x USING (uid, i) GROUP BY 1)
SELECT m.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(written, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM m LEFT JOIN t USING (uid) LEFT JOIN k USING (uid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_url_filter, op3_simhash, op4_html_text, op5_toxicity, op6_packing, op7_token_count,
        op8_substring_dedup, op9_multiset_fingerprint, op10_decontaminate, op11_importance_resampling, op12_periodic_runs, op13_secret_scan,
    )
}
ORACLES: dict[str, str] = {"op1_sharding": OP1, "op2_url_filter": OP2, "op8_substring_dedup": OP8, "op9_multiset_fingerprint": OP9, "op11_importance_resampling": OP11, "op12_periodic_runs": OP12}
