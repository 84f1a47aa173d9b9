"""The pipeline's stages, one after another, against brute force."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup_ops import plain_components, plain_fingerprint, plain_removal  # noqa: E402
from test_text_ops import check_pieces, plain_distance, toxic_corpus  # noqa: E402

from trajspark.llm import decontaminate, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = toxic_corpus(240)
    word = lambda: "".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(3))
    passage = " ".join(word() for _ in range(70))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3)]
    rows += [(1000 + i, " ".join(word() for _ in range(90))) for i in range(20)]
    rows += [(1100 + i, " ".join(word() for _ in range(40)) + " " + passage + " " + word()) for i in range(4)]
    rows += [(1200, rows[240][1]), (1201, rows[241][1].replace(" ", "\n")), (1202, rows[242][1] + " extra"), (1300, "intro text " + items[0][1] + " more"), (1301, items[1][1][:-3]), (1400, None), (1401, ""), (1402, "")]
    full = [(i, t, "en", "s", len(t) if t else 0) for i, t in rows]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, labels, items


def test_stages(spark, tables):
    import corpus_pipeline

    at, rows, labels, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]

    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    finder = toxicity.Finder(model.lexicon)
    left = [(i, t) for i, t in rows if model.score(finder, t or "") < toxicity.THRESHOLD]
    assert 30 <= len(rows) - len(left) <= 60

    prints = [plain_fingerprint(t) for _, t in left]
    roots = plain_components(prints)
    least = {}
    for (i, _), r in zip(left, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    deduped = [(i, t) for (i, t), r in zip(left, roots, strict=True) if least[r] == i]

    texts = dict(deduped)
    cleaned = [(i, texts[i] if not removed else kept) for i, n, removed, kept in plain_removal(deduped) if not removed or removed < n]

    clean = lambda t: all(plain_distance(decontaminate.normalise(x), decontaminate.normalise(t)) > decontaminate.budget(decontaminate.normalise(x)) for _, x in items)
    final = [(i, t) for i, t in cleaned if clean(t)]

    expected = [left, deduped, cleaned, final]
    for (_, stage), want in zip(corpus_pipeline.STAGES, expected, strict=False):
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        assert got == sorted(want, key=repr)
        docs = spark.createDataFrame(out.collect(), out.schema)
    check_pieces(final, corpus_pipeline.STAGES[-1][1](spark, docs, at).collect())


def test_run(spark, tables):
    import corpus_pipeline

    at = tables[0]
    found = corpus_pipeline.run(spark, at)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 0


def test_leaks_take_no_clean_row_with_them(spark, tmp_path):
    import corpus_pipeline

    item = "which of these long questions should never be part of any training text at all"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak, clean = f"before {item} after", "a text of which nothing is asked"
    rows = [(None, leak), (None, clean), (None, None), (7, leak), (7, clean), (7, leak), (8, ""), (9, leak.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(None, clean), (None, None), (7, clean), (8, "")], key=repr)
    none = corpus_pipeline.drop_leaks(spark, docs.limit(0), str(tmp_path))
    assert none.columns == docs.columns and none.count() == 0


def jaccard_rows():
    """Texts of 100 words and near copies of them with up to 17 words changed; similarity from 0.4 to 1."""
    rng = random.Random(3)
    rows = []
    for n in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows.append((10 * n, " ".join(words)))
        for k in range(1, 6):
            near = list(words)
            at = rng.randrange(60)
            near[at : at + 3 * k + n % 3] = [f"x{rng.randrange(5000)}" for _ in range(3 * k + n % 3)]
            rows.append((10 * n + k, " ".join(near)))
    return rows


def plain_classes(rows):
    def cut(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, parent = [cut(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def test_near_dedup_takes_similar_texts(spark):
    import corpus_pipeline

    rows = jaccard_rows() + [(500, None), (501, " "), (502, "two words"), (503, "Two  WORDS")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    roots = plain_classes(rows)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    assert found == sorted(least.values()) and 20 < len(found) < 60


def test_near_dedup_keeps_rows_that_share_an_id(spark):
    import corpus_pipeline

    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, texts[0], "y"), (None, texts[1], "x"), (None, texts[1], "w"), (7, texts[2], "x"), (7, texts[3], "x"), (7, texts[3].upper(), "x"), (9, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    kept = {x for x in found if x[1].lower() != texts[3]}
    assert kept == {(None, texts[1], "w"), (7, texts[2], "x"), (9, texts[0], "x")} and len(found) == 4
