"""SimHash groups and passage removal against brute force."""

import hashlib
import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from trajspark.llm import components, simhash, substring_dedup, wordhash


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(words, limit=4):
    parent = list(range(len(words)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(words)):
        for j in range(i):
            if (words[i] ^ words[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(words))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 220))] for _ in range(25)]
    rows = [(3 * i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:15]):
        near = list(w)
        near[rng.randrange(len(near))] = "changed"
        rows += [(100 + 2 * i, " ".join(near)), (101 + 2 * i, "\t".join(w).upper())]
    return rows + [(900, ""), (901, None), (902, " \n "), (903, "One two"), (903, "One two"), (904, "É x")]


def test_near_duplicate_components(spark):
    rows = corpus(1)
    frame = docs(spark, rows).selectExpr("*", "1 as fp", "2 as component_id").repartition(5)
    found = simhash.near_duplicate_components(frame).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    expected = sorted((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted(map(tuple, found)) == expected


@pytest.mark.parametrize("seed", range(6))
def test_set_links_are_those_of_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (1, 2, 40, 60, 60, 300)]
    sets = []
    for _ in range(50):
        own = base[rng.integers(len(base))]
        own = own[rng.random(len(own)) > rng.choice([0.0, 0.05, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 62, 1 + len(own) // 12, dtype=np.uint64)])))
    fps = np.array([simhash.majority(s) for s in sets], np.uint64)
    ends = np.cumsum([0, *map(len, sets)])
    places, roots = simhash.set_links(fps, np.concatenate(sets).view(np.int64), ends, 0.8)
    parent = list(range(len(sets)))
    for i, r in zip(places.tolist(), roots.tolist(), strict=True):
        parent[i] = r
    alike = lambda a, b: len(set(a.tolist()) & set(b.tolist())) >= 0.8 * len(set(a.tolist()) | set(b.tolist()))
    plain = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]) and plain[i] != plain[j]:
                low, high = sorted((plain[i], plain[j]))
                plain = [low if x == high else x for x in plain]
    assert [[parent[i] == parent[j] for j in range(50)] for i in range(50)] == [[plain[i] == plain[j] for j in range(50)] for i in range(50)]


def test_null_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 1 << 10)
    long = " ".join(f"w{i * i % 9973}" for i in range(70_000))
    rows = [(None, "only here and nowhere else"), (None, "a b c d e f g"), (5, "A b c d e f g"), (8, long), (9, long + " end"), (10, long[: len(long) // 3])]
    found = sorted(map(tuple, simhash.near_duplicate_components(docs(spark, rows)).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in rows]
    expected = [(None, f"{prints[0]:016x}", None), (None, f"{prints[1]:016x}", 5), (5, f"{prints[2]:016x}", 5)]
    roots = plain_components(prints[3:])
    expected += [(i, f"{p:016x}", rows[3 + r][0]) for (i, _), p, r in zip(rows[3:], prints[3:], roots, strict=True)]
    assert found == sorted(expected, key=repr)


def test_groups_are_whole_over_batches():
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(200):
        keys = sorted(rng.randrange(6) for _ in range(rng.randrange(1, 40)))
        table = pa.table({"k": pa.array(keys, pa.int64()), "v": [[i] * (i % 3) for i in range(len(keys))]})
        batches = []
        at = 0
        while at < len(keys):
            n = rng.randrange(1, 8)
            batches += table.slice(at, n).to_batches()
            at += n
        out = list(simhash._runs(iter(batches), 1))
        assert pa.Table.from_batches(out).to_pydict() == table.to_pydict()
        seen = [set(b.column(0).to_pylist()) for b in out]
        assert sum(map(len, seen)) == len(set(keys))


def test_nothing_to_group(spark):
    assert simhash.near_duplicate_classes(docs(spark, [])).count() == 0
    assert simhash.near_duplicate_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("n", "limit"), [(1, 4), (5, 4), (40, 4), (3000, 4), (900, 9)])
def test_index_finds_all_links(n, limit):
    rng = np.random.default_rng(n)
    words = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flips = np.bitwise_xor(words[: n // 2], np.uint64(1) << rng.integers(0, 64, n // 2, dtype=np.uint64))
    words = np.unique(np.concatenate([words, flips, flips ^ np.uint64(7)]))
    index = simhash.GrayIndex(words)
    own = np.arange(len(words))
    found = {(int(a), int(b)) for i, j in index.pairs(limit, lambda: own) for a, b in zip(i, j, strict=True)}
    near = np.triu(np.bitwise_count(index.words[:, None] ^ index.words[None, :]) <= limit, 1)
    assert found == set(zip(*map(list, np.nonzero(near)), strict=True))
    u, v = simhash.links(words, limit)
    parent = {int(w): int(w) for w in words} | {int(a): int(b) for a, b in zip(u, v, strict=True)}
    if n <= 40:
        roots = plain_components([int(w) for w in words], limit)
        for i in range(len(words)):
            for j in range(len(words)):
                assert (parent[int(words[i])] == parent[int(words[j])]) == (roots[i] == roots[j])
    for i, j in found:
        assert parent[int(index.words[i])] == parent[int(index.words[j])]


def test_index_prunes_groups_by_summed_differences():
    rng = np.random.default_rng(7)
    words = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    index, own = simhash.GrayIndex(words), np.arange(len(words))
    assert sum(len(i) for i, _ in index.pairs(4, lambda: own)) <= 2
    assert index.pruned > 0.5 * index.looked and index.looked < 0.4 * len(words) ** 2 / 2
    # a node has only bits that none above it has, and all bits of a member are somewhere on its way down
    seen = np.zeros(1, np.uint64)
    for pattern, mask in index.levels:
        above = seen.repeat(simhash.FAN)[: len(mask)] if len(mask) > 1 else np.zeros(1, np.uint64)
        assert not (above & mask).any() and not (pattern & ~mask).any()
        seen = above | mask
    assert (seen == ~np.uint64(0)).all()


@pytest.mark.parametrize("n", [1, 4096, 4097, 300_000, 10**8, 10**10, 10**13])
def test_split_masks_lose_no_pair(n):
    rng = np.random.default_rng(3)
    masks = simhash.split_masks(n, 4)
    assert (masks == [0]) == (n <= simhash.GROUP)
    for _ in range(2000):
        apart = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(apart & m == 0 for m in masks)


def test_dense_group_is_one_tree():
    words = np.unique(np.array([0, *[1 << i for i in range(64)], *[(1 << i) | (1 << j) for i in range(40) for j in range(i)]], np.uint64))
    u, v = simhash.links(words)
    assert len(u) == len(words) - 1 and len(set(v.tolist())) == 1


def test_split_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 4)
    monkeypatch.setattr(simhash, "GROUP", 2)
    rows = [(i, f"same text with one number {i % 30} at its end and more words that stay the same for all of them here") for i in range(60)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs(spark, rows)).collect()}
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    assert [found[i] for i in range(60)] == roots


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299)]
    found = {r["vertex"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[i] == 100 for i in range(100, 160)) and found[300] == 299 and 200 not in found


def plain_removal(rows, window=50):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), kept.decode()))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopé") + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 130, 260)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [word() for _ in range(rng.randrange(70))]
            p = rng.choice(shared)
            a = rng.randrange(max(1, len(p) - 49))
            words += p if rng.random() < 0.5 else p[a:]
        rows.append((rng.randrange(50), rng.choice([" ", "\n", "  "]).join(words)))
    same = " ".join(word() for _ in range(300))
    return rows + [(60, same), (61, same), (61, same), (62, same + " tail"), (70, None), (71, ""), (72, "x " * 400), (73, "x " * 300)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passage_removal(spark, seed):
    rows = passages(seed)
    frame = docs(spark, rows).selectExpr("*", "'x' as n_words", "0 as w", "1 as `start`", "2 as starts").repartition(5)
    found = substring_dedup.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, found)) == plain_removal(rows)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(wordhash.BitFilter, "LEAST_BITS", 1 << 9)
    monkeypatch.setattr(wordhash.BitFilter, "MOST_BITS", 1 << 9)
    rows = passages(3)
    found = substring_dedup.remove_repeats(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, found)) == plain_removal(rows)


def test_no_documents(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_word_hashes_over_slices(monkeypatch):
    text = ("alpha  béta\tgamma\n" * 500).encode()
    whole = wordhash.hash_words(text)
    monkeypatch.setattr(wordhash, "SLICE", 64)
    assert (wordhash.hash_words(text) == whole).all() and len(whole) == 1500 and len(set(whole.tolist())) == 3


def test_very_long_text(spark):
    long = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(200_000))
    rows = [(1, long), (2, long[: len(long) // 2] + " end")]
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert found[1]["n_removed"] == 0 and found[2]["n_words"] - found[2]["n_removed"] <= 2
