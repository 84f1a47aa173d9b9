"""Importance resampling, periodic runs and secret scans against brute force."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trajspark.llm import periodic, queries, resampling, secrets


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


# --- importance resampling


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_crcs(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(rows, target):
    source, wanted = Counter(), Counter()
    for _, t in rows:
        source.update(c % 10000 for c in plain_crcs(t))
    for t in target:
        wanted.update(c % 10000 for c in plain_crcs(t))
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000))))
    out = []
    for n, (i, text) in enumerate(rows):
        crcs = plain_crcs(text)
        weight = sum(gain(c % 10000) for c in crcs)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text)), n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def mixed_rows(seed=5, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "é", "Ñandú", "x1", "9", "delta_eps", "z" * 70, "ß" * 40, "o"])
    rows = [(i, rng.choice([" ", ", ", "\n", "--"]).join(word() for _ in range(rng.randrange(0, 90)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "...!"), (903, "one"), (904, "One TWO"), (None, rows[0][1]), (None, rows[3][1]), (7, rows[8][1]), (7, rows[8][1])]
    return rows


def test_feature_crcs():
    texts = [t or "" for _, t in mixed_rows()] + ["a" * 65 + " b " + "c" * 66 + " d", "k" * 300, "\0a\0b"]
    raw = [t.encode() for t in texts]
    words, whose, crc = resampling.features(raw, [len(t) for t in raw])
    for i, t in enumerate(texts):
        assert sorted(crc[whose == i].tolist()) == sorted(plain_crcs(t)) and words[i] == len(plain_words(t))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_chunks_own_each_feature_once(monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    for text in ["  a b, c", "word", "Alpha " * 40 + "é ñ " * 30, "x" * 200 + " y " + "z" * 90, "...", " ".join(f"w{i}" for i in range(100)) + "."]:
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text.encode()], pa.binary())], names=["uid", "doc_id", "text"])
        parts = [r for b in resampling._split(iter([batch])) for r in b.to_pylist()]
        assert [p["part"] for p in parts] == list(range(len(parts))) and sum(p["owned"] for p in parts) == len(text.encode())
        words, _, crc = resampling.features([p["text"] for p in parts], [p["owned"] for p in parts])
        assert sorted(crc.tolist()) == sorted(plain_crcs(text)) and words.sum() == len(plain_words(text))


@pytest.mark.parametrize("chunk", [50, 1 << 18])
def test_resample(spark, monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    rows = mixed_rows()
    target = ["alpha beta gamma alpha", None, "9 x1 o o", ""]
    # columns named like the operator's own, and more of them than it needs
    frame = docs(spark, rows).selectExpr("*", "1 as n_features", "2 as weight", "3 as uid", "4 as owned", "'x' as rank").repartition(3)
    found = resampling.resample(frame, docs(spark, [(i, t) for i, t in enumerate(target)]).selectExpr("doc_id as none", "text", "1 as owned"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_resample(rows, target)


def test_resample_empty(spark):
    one = docs(spark, [(1, "a b c " * 10)])
    assert resampling.resample(docs(spark, []), one).collect() == []
    assert [r["n_features"] for r in resampling.resample(one, docs(spark, [])).collect()] == [87]


def test_resample_many_equal_rows(spark):
    rows = [(None, "same words again " * 9)] * 300 + [(i, f"w{i} " * 25) for i in range(100)]
    found = resampling.resample(docs(spark, rows), docs(spark, [(1, "same words")])).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21)) and sorted(map(tuple, found), key=repr) == plain_resample(rows, ["same words"])


# --- periodic runs


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_repeating(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def run_texts(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(rng.choice([0, 1, 11, 12, 13, 40, 150]))]
        if len(words) > 20 and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randrange(3, 11)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))] + words[:3]
        texts.append(rng.choice([" ", " \n\t", "\x0b\x0c"]).join(words))
    return texts


def test_runs_against_all_periods():
    texts = run_texts(1, 200) + ["", " ", "a", "é é " * 9, "a b " * 7]
    n, runs, collapsed = periodic.collapse([t.encode() for t in texts])
    for d, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = [tuple(r[1:]) for r in runs.tolist() if r[0] == d]
        assert n[d] == len(words) and own == plain_runs(words) and collapsed[d].decode() == plain_collapse(words, own)


def test_hashes_that_agree_by_chance_are_verified(monkeypatch):
    # words whose hashes are all equal make every comparison of hashes hold: the words decide
    monkeypatch.setattr(periodic, "mix", lambda x: np.zeros_like(x))
    for t in run_texts(2, 40):
        words = t.split()
        _, runs, _ = periodic.collapse([b"other words", t.encode()])
        assert [tuple(r[1:]) for r in runs.tolist()] == plain_runs(words)


def test_pairs_in_slices(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 16)
    texts = run_texts(3, 30)
    _, runs, _ = periodic.collapse([t.encode() for t in texts])
    assert [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t.split())] == [tuple(r) for r in runs.tolist()]


def test_long_text_of_one_word():
    n, runs, collapsed = periodic.collapse([b"again " * 30_000])
    assert n.tolist() == [30_000] and runs.tolist() == [[0, 0, 30_000, 1]] and collapsed == [b"again"]


def test_periodic_runs_frame(spark):
    texts = run_texts(4, 30)
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (51, "")]
    frame = docs(spark, rows).selectExpr("*", "1 as runs", "2 as __text2", "3 as n_words").repartition(3)
    found = periodic.periodic_runs(frame).collect()
    expected = [(i, len((t or "").split()), plain_runs((t or "").split()), plain_collapse((t or "").split(), plain_runs((t or "").split()))) for i, t in rows]
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in found), key=repr) == sorted(expected, key=repr)
    assert periodic.periodic_runs(docs(spark, [])).collect() == []


def test_periodic_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 130)))) for i in range(160)] + [(None, "a b " * 20), (3, None), (4, ""), (4, "x")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    expected = set()
    for i, t in rows:
        words = plain_repeating(i, t)
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.add((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(plain_collapse(words, runs))))
    assert found == expected


# --- secret scans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda s: bytes([0x80 | len(s)]) + s)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def integer(rng, size):
    return tlv(2, bytes([rng.randrange(1, 127)]) + rng.randbytes(size - 1)) if size else tlv(2, b"\0")


def rsa(rng, size=64):
    half = size // 2
    return tlv(0x30, tlv(2, b"\0"), integer(rng, size), tlv(2, b"\1\0\1"), *[integer(rng, n) for n in (size - 1, half, half, half, half, half)])


def openssh(rng):
    field = lambda b: len(b).to_bytes(4, "big") + b
    public = field(b"ssh-ed25519") + field(rng.randbytes(32))
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(rng.randbytes(136))


def keys(rng):
    oid = tlv(6, bytes.fromhex("2a8648ce3d0201"))
    curve = tlv(0x30, tlv(2, b"\1"), tlv(4, rng.randbytes(32)), tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))))
    sealed = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")), tlv(0x30)), tlv(4, rng.randbytes(64)))
    dsa = tlv(0x30, tlv(2, b"\0"), *[integer(rng, n) for n in (64, 20, 64, 64, 20)])
    return {"rsa": rsa(rng), "large": rsa(rng, 256), "curve": curve, "wrapped": tlv(0x30, tlv(2, b"\0"), tlv(0x30, oid), tlv(4, curve)), "sealed": sealed, "dsa": dsa, "openssh": openssh(rng)}


def url64(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def token(rng, alg="HS256", size=32, payload=b'{"sub": "1"}'):
    return ".".join([url64(json.dumps({"alg": alg, "typ": "JWT"}).encode()), url64(payload), url64(rng.randbytes(size))])


def added(text):
    return [s for s in secrets.scan(text.encode()) if s[2] not in secrets.KINDS[:3]]


def test_base_patterns():
    rng = random.Random(3)
    pieces = ["password", "PassWd", "secret", "ſecret", "toKen", "api_key", "APIKEY", "AKIA", "é", "ñ", " ", "\n", ":", "=", '"', "'", "0123456789ab", "deadbeefdeadbeef", "ABCDEFGH12345678", "-", "x", "K"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert secrets.scan(text.encode()) == plain_spans(text)


@pytest.mark.parametrize("name", ["rsa", "large", "curve", "wrapped", "sealed", "dsa", "openssh"])
def test_structures(name):
    rng = random.Random(name)
    data = keys(rng)[name]
    plain, hexed = base64.b64encode(data).decode(), data.hex()
    lead = "é texte: "
    for body in (plain, url64(data), plain.rstrip("=")):
        assert added(f"{lead}{body} fin") == [(len(lead), len(lead) + len(body), "key")]
    for body in (hexed, hexed.upper()):
        assert added(f"{lead}{body} fin") == [(len(lead), len(lead) + len(body), "key")]
    # the lengths inside tell the end, whatever follows
    assert [s[:1] + s[2:] for s in added(f"{lead}{plain.rstrip('=')}AAAAAAAA")] == [(len(lead), "key")]
    lines = "\n".join(plain[i : i + 64] for i in range(0, len(plain), 64))
    assert added(f"{lead}{lines}\n\nend") == [(len(lead), len(lead) + len(lines), "key")]
    block = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    assert added(f"{lead}{block} fin") == [(len(lead), len(lead) + len(block), "block")]
    twice = base64.b64encode(block.encode()).decode()
    assert added(f"{lead}{twice} fin") == [(len(lead), len(lead) + len(twice), "key")]


def test_broken_structures_are_not_reported():
    rng = random.Random(8)
    for name, data in keys(rng).items():
        if name == "wrapped":  # the curve's key inside is whole, and rightly found
            continue
        for broken in (data[:-1], data[:1] + bytes([data[1] ^ 1]) + data[2:], rng.randbytes(len(data))):
            assert added("x " + base64.b64encode(broken).decode() + " y") == [] and added("x " + broken.hex() + " y") == []
            body = base64.b64encode(broken).decode()
            assert added(f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----") == []
    digest = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("608648016503040201")), tlv(5)), tlv(4, rng.randbytes(32)))  # a digest is no key
    public = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(5)), tlv(3, b"\0" + rsa(rng)[:90]))
    assert added(base64.b64encode(digest).decode()) == [] and added(base64.b64encode(public).decode()) == []


def test_signed_tokens():
    rng = random.Random(4)
    for alg, size in [*secrets.SIGNATURES.items(), ("RS256", 256), ("PS512", 512), ("EdDSA", 64)]:
        good = token(rng, alg, size)
        for lead in ("é Bearer ", "url/", "\n"):
            assert added(f"{lead}{good}, x") == [(len(lead), len(lead) + len(good), "signed")]
        assert added(token(rng, alg, size - 1)) == []
    assert added(token(rng, "none", 32)) == [] and added(token(rng, payload=b"[1]")) == [] and added(token(rng, payload=b'{"a"')) == []
    assert added("eyJhbGciOiJIUzI1NiJ9.eyJhIjox") == [] and added("see.every.thing, e.g. this.even.that " * 9) == []


def test_base_spans_stay():
    good = token(random.Random(5))
    text = f"token = '{good}'"
    assert secrets.scan(text.encode()) == [(0, len(text) - 1, "assign"), (9, len(text) - 1, "signed")]


def test_very_long_texts_end():
    rng = random.Random(6)
    blob = base64.b64encode(rng.randbytes(300_000)).decode()
    assert [s for s in added(blob + "MII" * 50_000 + "3082" * 50_000) if s[2] != "key"] == []
    assert secrets.scan(b"e" * 500_000 + b"." + b"30" * 200_000) == plain_spans("e" * 500_000 + "." + "30" * 200_000)


def test_secret_query(spark, tmp_path):
    rng = random.Random(7)
    key = base64.b64encode(keys(rng)["rsa"]).decode()
    rows = [(1, "é password=abcdef0123456789 x"), (1, "é password=abcdef0123456789 x"), (None, f"ñ {key} AKIA{'A' * 14}"), (2, None), (3, ""), (4, token(rng))]
    docs(spark, rows).selectExpr("*", "1 as spans", "2 as n_hex").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_secret_scan(spark, str(tmp_path)).collect()
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    expected = []
    for i, t in rows:
        base, every = plain_spans(t or ""), secrets.scan((t or "").encode())
        n = Counter(k for _, _, k in base)
        expected.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert {k for r in found for k in re.findall("[a-z]+", r["spans"])} == {"assign", "access", "hex", "key", "signed"}
    assert secrets.find_secrets(docs(spark, [])).collect() == []
