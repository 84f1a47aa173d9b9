"""Sharding, URL rules and multiset fingerprints against plain versions."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trajspark.llm import multiset_hash, queries, sharding, url_filter

DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def plain_shard(key, weights):
    digest = hashlib.md5(("null" if key is None else str(key)).encode()).hexdigest()
    p = sharding.PRIME
    a, b = int(digest[:12], 16) % p, int(digest[12:24], 16) % p
    costs = []
    for i, w in enumerate(weights):
        draw = pow((pow((a + i * sharding.STEP) % p, 5, p) + b) % p, 5, p)
        if w > 0:
            costs.append((-math.log((draw + 1) / float(p + 1)) / w, i))
    return min(costs)[1]


def test_shards_are_the_plain_ones(spark):
    rows = [(i, f"text {i} é") for i in range(300)] + [(None, None), (None, None), (7, "again"), (300, "")]
    weights = [1.0, 2.0, 0.0, 0.5]
    found = sharding.shard_documents(docs(spark, rows), weights).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["shard"] == plain_shard(r["doc_id"], weights)
        assert r["grown_shard"] in (r["shard"], 4)
    crcs = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in found) == crcs
    for s in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert not any(r["shard"] == 2 for r in found)


def test_shards_are_near_their_weights(spark):
    found = Counter(r["shard"] for r in sharding.shard_documents(docs(spark, [(i, "x") for i in range(8000)]), [1.0] * 8).collect())
    assert all(850 < n < 1150 for n in found.values()) and len(found) == 8


def test_slots_of_repeated_keys(spark):
    found = sharding.shard_documents(docs(spark, [(i % 50, "x") for i in range(400)]).repartition(9), [1.0, 1.0]).collect()
    for s in (0, 1):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_of_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, shard string, slot string, __bucket int")
    assert sharding.shard_documents(empty, [1.0]).count() == 0
    clash = spark.createDataFrame([(1, "a", "x", "y", 3)], empty.schema)
    assert sharding.shard_documents(clash, [1.0]).first()["slot"] == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(clash, [0.0])


URLS = [
    None, "", "no scheme", "https://www.example.com/en/1", "https://www.example.com/fr/1", "http://Blog.EXAMPLE.com/en/", "http://example.com/en", "http://a.net/es/1?x=/fr/",
    "http://net/fr/", "http://anet/fr/", "http://com", "http://com/", "x://y://com/en/", "http://a.net#/es/", "http://a.example.com:80/en/", "http://example.org/en/\nx", "HTTPS://É.NET/es/",
]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fitting = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fitting:
        return host, path, None, "allow"
    best = max(fitting, key=lambda r: len(r.text))
    return host, path, best.text, best.verdict


def test_url_verdicts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(99, URLS[3])], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    found = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()}
    assert len(found) == len(URLS) + 1
    for i, u in enumerate(URLS):
        assert found[i] == plain_verdict(u), u


def test_rules_are_filed_under_their_rarest_token(spark):
    rows = spark.createDataFrame([(i, "http://a.com/x/" if i else "http://b.com/en/") for i in range(9)], "page_id long, url string")
    host, path = url_filter.split_url(F.col("url"))
    tokens = rows.select(url_filter.url_tokens(host, path).alias("__tokens"))
    assert url_filter.rarest_tokens(tokens, [url_filter.Rule("block", "com", "/en/")]) == {"p:en": [0]}


def test_url_rules_on_hosts_with_blanks(spark):
    pages = spark.createDataFrame([(1, "http://a b.net/es/x"), (2, "http://a bnet/es/x")], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, [url_filter.Rule("block", "net", "/es/")]).collect()}
    assert found == {1: ("net/es/", "block"), 2: (None, "allow")}


def test_url_rules_of_many_maps_and_long_urls(spark, monkeypatch):
    long = "http://www.example.com/en/" + "a/" * 20_000
    pages = spark.createDataFrame(list(enumerate([*URLS, long])), "page_id long, url string")
    whole = sorted(url_filter.judge_urls(pages, queries.URL_RULES).collect())
    monkeypatch.setattr(url_filter, "MAP_TOKENS", 1)
    assert sorted(url_filter.judge_urls(pages, queries.URL_RULES).collect()) == whole
    assert [tuple(r)[1:] for r in whole] == [plain_verdict(u) for u in [*URLS, long]]


def test_url_rules_on_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty, queries.URL_RULES).count() == 0
    assert url_filter.judge_urls(empty, []).count() == 0


def plain_vector(text):
    import re

    lanes, m = [0] * (multiset_hash.SPARSE + multiset_hash.DENSE), multiset_hash.MODULUS
    for paragraph in re.findall(multiset_hash.PARAGRAPH, text):
        h = hashlib.md5(paragraph.encode()).hexdigest()
        w = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        for s in range(multiset_hash.STRATA):
            if w[2] % 4**s == 0:
                lanes[s * multiset_hash.LANES + w[0] % multiset_hash.LANES] += (w[0] * 4 + w[1] % 4 + 1) % (m - 1) + 1
        for k in range(multiset_hash.DENSE):
            lanes[multiset_hash.SPARSE + k] += w[k]
    return [x % m for x in lanes]


def plain_likeness(a, b):
    n, found = multiset_hash.LANES, []
    for s in range(multiset_hash.STRATA):
        pairs = [(x, y) for x, y in zip(a[s * n : s * n + n], b[s * n : s * n + n], strict=True) if x or y]
        found.append((len(pairs), sum(x == y for x, y in pairs)))
    at = next((s for s, (used, _) in enumerate(found) if used <= multiset_hash.CROWDED), multiset_hash.STRATA - 1)
    if at and found[at][0] < multiset_hash.CROWDED // 4:
        at -= 1
    used, same = found[at]
    return same / used if used else 1.0


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "PER_BUCKET", 3)
    texts = ["", None, "a\nb\nc", "c\nb\na", "a\nb\nc", "x" * 1000, "é😀" * 100, "one\n\n\ntwo", "q", "r\ns"]
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in multiset_hash.fingerprint_documents(docs(spark, rows).repartition(3)).collect()}
    order = sorted(rows, reverse=True)
    for n, (i, t) in enumerate(order):
        text, after = t or "", order[(n + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = found[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in plain_vector(text))
        assert r["edited_fingerprint"] == "".join(f"{x:08x}" for x in plain_vector(edited))
        assert r["near_edited"] == plain_likeness(plain_vector(text), plain_vector(edited))
        assert r["near_next"] == plain_likeness(plain_vector(text), plain_vector(after))
    assert found[20]["fingerprint"] == found[30]["fingerprint"] == found[40]["fingerprint"] and found[30]["near_next"] == 1.0


def test_likeness_holds_for_all_lengths_and_keys_far_apart(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "PER_BUCKET", 4)
    text = lambda n, seed: "\n".join(hashlib.md5(f"{seed} {i}".encode()).hexdigest() for i in range(n))
    rows = [((1 << 60) if n == 0 else n, text(k, n), "x") for n, k in enumerate([3000, 9, 30, 100, 1000, 4000, 8000, 60, 15, 20])] + [(None, "", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(4)
    found = multiset_hash.fingerprint_documents(frame).collect()
    near = {r["doc_id"]: r["near_edited"] for r in found}
    assert len(found) == 11 and all(near[i] > 0.15 for i in near if i and len(dict((a, b) for a, b, _ in rows)[i]) > 2000)
    assert all(r["near_next"] < 0.1 for r in found if r["doc_id"] is not None)


def test_fingerprints_of_one_none_and_repeats(spark):
    one = multiset_hash.fingerprint_documents(docs(spark, [(5, "abcdef")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert multiset_hash.fingerprint_documents(docs(spark, [])).count() == 0
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "z"), (2, "c")]
    assert multiset_hash.fingerprint_documents(docs(spark, rows)).count() == 5


def test_fingerprints_add_and_subtract(spark):
    df = docs(spark, [(1, "a\nb")])
    v = multiset_hash.vector(F.col("text"))
    row = df.select(
        v.alias("v"), multiset_hash.insert_paragraph(multiset_hash.vector(F.lit("a")), F.lit("b")).alias("built"),
        multiset_hash.delete_paragraph(v, F.lit("a")).alias("less"), multiset_hash.vector(F.lit("b")).alias("b"),
    ).first()
    assert row["v"] == row["built"] and row["less"] == row["b"]
