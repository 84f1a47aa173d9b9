"""Pages, toxicity, packing, token counts and leaks."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from trajspark.llm import decontaminate, html_extract, packing, piece_cache, token_count, toxicity
from trajspark.llm.queries import tokenizer_file


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy {n}</div><article><h1>Head &amp; {n}</h1>{body}</article><footer>&copy; site {n}</footer></body></html>'
)


def page(n, *paragraphs):
    return PAGE.format(n=n, body="".join(f"<p>{p}</p>" for p in paragraphs))


def extract(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as wrapper", "1 as text")
    return {r["page_id"]: r for r in html_extract.extract_pages(frame).collect()}


def test_articles_without_what_surrounds_them(spark):
    rows = [(i, "http://a.com/x", page(i, f"one  {i}\n more", "two <b>bold</b> &lt;x&gt;", *["three"] * (i % 4))) for i in range(12)]
    found = extract(spark, rows)
    for i in range(12):
        assert found[i]["text"] == "\n".join([f"Head & {i}", f"one {i} more", "two bold <x>", *["three"] * (i % 4)])
        assert found[i]["n_chars"] == len(found[i]["text"])


def test_pages_without_article_and_odd_pages(spark):
    frame = "<html><body><div class='menu'>M</div><div id='content'><p>{0}</p></div><div class='comments'><p>reader {0}</p></div><aside>S</aside><form><label>F</label></form><div>same notice</div></body></html>"
    rows = [(i, "http://b.com/x", frame.format(f"body {i}")) for i in range(8)]
    rows += [(20, None, None), (21, "none", ""), (22, "http://c.com/", "plain text"), (23, "http://c.com/", "<p>a<p>b<br>c"), (24, "http://b.com/z", "<article>lone &#233; &eacute"), (24, "http://b.com/z", "<article>lone &#233; &eacute")]
    found = extract(spark, rows)
    assert [found[i]["text"] for i in range(8)] == [f"body {i}" for i in range(8)]
    assert found[20]["text"] == "" and found[21]["text"] == "" and found[22]["text"] == "plain text"
    assert found[23]["text"] == "a\nb c" and found[24]["text"] == "lone é é"
    assert extract(spark, []) == {}


@pytest.mark.parametrize("first", range(0, 400, 40))
def test_hosts_with_two_templates(spark, first):
    bare = "<html><body><div class='top'>Site name</div><div class='content'><p>text {0}</p></div><div class='end'>Site end</div></body></html>"
    framed = "<html><body><div class='content'><p>other {0}</p></div><article><p>lead {0}</p></article></body></html>"
    rows = [(first + i, "http://d.com/x", (framed if i % 3 else bare).format(first + i)) for i in range(30)]
    found = extract(spark, rows)
    for i in range(30):
        assert found[first + i]["text"] == (f"lead {first + i}" if i % 3 else f"text {first + i}")


def test_slots_are_told_apart_by_the_match(spark):
    html = "<html><body><article><h1>Title {0}</h1><p>Read with care</p><div><span>text {0}</span></div>{1}<p>Read with care</p></article></body></html>"
    rows = [(i, "http://e.com/x", html.format(i, "<h2>Head</h2>" if i % 2 else "")) for i in range(20)]
    rows += [(50, "http://e.com/x", html.format(50, "<table><tr><td>never seen</td></tr></table>"))]
    found = extract(spark, rows)
    for i in range(20):
        assert found[i]["text"] == f"Title {i}\ntext {i}" + ("\nHead" if i % 2 else "")
    assert found[50]["text"] == "Title 50\ntext 50\nnever seen"


def test_names_inside_an_article(spark):
    html = (
        "<html><body><header><h1>Site</h1></header><div class='page has-sidebar'><div class='sidebar'>S</div><article class='post no-banner'><header class='post-header'><h1>Title {0}</h1><p>by {0}</p></header>"
        "<section class='share-price'><p>price {0}</p></section><div class='share-buttons'>send {0}</div><div class='post-header'><h2>Part {0}</h2></div><div class='menu header'><p>go {0}</p></div>"
        "<div class='comments-area'><p>reader {0}</p></div><section class='related-posts'><h2>more {0}</h2></section><div class='ad'>buy {0}</div><p>end {0}</p></article></div><footer>f</footer></body></html>"
    )
    found = extract(spark, [(i, "http://n.com/x", html.format(i)) for i in range(9)])
    for i in range(9):
        assert found[i]["text"] == f"Title {i}\nby {i}\nprice {i}\nPart {i}\nend {i}"


def test_raw_elements_hold_no_tags(spark):
    html = '<html><body><script>var c="<!--";</script><style>/* <p> */</style><article><p>real {0}</p><textarea><!-- </textarea><p>more {0}</p></article><p>after {0}</p></body></html>'
    found = extract(spark, [(i, "http://r.com/", html.format(i)) for i in range(2)])
    assert [found[i]["text"] for i in range(2)] == [f"real {i}\nmore {i}" for i in range(2)]


def test_near_copies_are_no_template(spark):
    body = "".join(f"<p>paragraph {k} with words of its own</p>" for k in range(12))
    html = "<html><body><article><h1>Head</h1>{0}<p>end {1}</p></article></body></html>"
    found = extract(spark, [(i, "http://n.com/", html.format(body, i)) for i in range(3)])
    assert all(len(found[i]["text"].split("\n")) == 14 and found[i]["text"].startswith("Head\nparagraph 0") for i in range(3))


def plain_text(pages, n):
    """What the blocks of a page say that not all pages say in the same place; all pages have the same tags."""
    import re

    texts = [re.findall(r">([^<]+)<", p) for p in pages]
    return "\n".join(t for k, t in enumerate(texts[n]) if len({x[k] for x in texts}) > 1)


@pytest.mark.parametrize("seed", range(4))
def test_slots_alone_tell_pages_without_names(spark, seed):
    rng = random.Random(seed)
    tags = rng.sample("div p section h2 h3 h4 blockquote pre figure address center dl".split(), 12)  # unlike neighbours: no repeated group
    fixed = [rng.random() < 0.4 for _ in tags]
    words = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(9))
    shared = [words() for _ in tags]
    pages = ["<html><body>" + "".join(f"<{t}>{shared[k] if fixed[k] else words()}</{t}>" for k, t in enumerate(tags)) + "</body></html>" for _ in range(6)]
    found = extract(spark, [(i, "http://plain.com/", p) for i, p in enumerate(pages)])
    assert [found[i]["text"] for i in range(6)] == [plain_text(pages, i) for i in range(6)]
    # without the wrapper the fixed slots would stay
    assert not any(fixed) or html_extract.Host([]).text(pages[0]) != found[0]["text"]


def test_one_page_of_many_makes_a_slot_variable(spark):
    # on each of ten pages of forty another paragraph differs: no six pages show all of them
    said = lambda i, k: f"said by {i}" if i == 4 * k else f"usual {k}"
    tags = "h1 h2 h3 h4 h5 h6 p pre figure address".split()
    own = lambda i: f"words of {i} " * 40 + "end"
    html = lambda i: f"<html><body><article><dl>{own(i)}</dl>{''.join(f'<{t}>{said(i, k)}</{t}>' for k, t in enumerate(tags))}<center>same on all</center></article></body></html>"
    found = extract(spark, [(i, "http://m.com/x", html(i)) for i in range(40)])
    assert [found[i]["text"].split("\n") for i in range(40)] == [[own(i), *[said(i, k) for k in range(10)]] for i in range(40)]


def test_wrappers_of_parts_are_aligned():
    import re

    streams = [html_extract.Page(f"<article><h1>t</h1>{'<h2>a</h2>' * (n % 2)}<p>x</p>{'<pre>b</pre>' * (n // 2)}</article>").stream for n in range(4)]
    whole = html_extract.align(html_extract.infer(streams[:2]), html_extract.infer(streams[2:]))
    pattern = re.compile(html_extract.expression(whole))
    assert all(pattern.fullmatch("".join(t + "\n" for t in s)) for s in streams)


def test_very_long_page(spark):
    long = "".join(f"<p>line {i} of many</p>" for i in range(60_000))
    found = extract(spark, [(1, "http://l.com/", f"<article>{long}</article>"), (2, "http://l.com/", "<article><p>short</p></article>")])
    assert found[1]["text"].count("\n") == 59_999 and found[2]["text"] == "short"


def test_long_streams_are_aligned():
    odd = lambda n, k: "<body><article><p>fixed</p>" + "".join(f"<h{1 + (i * i + i // 7 * k) % 6}>t{n}</h{1 + (i * i + i // 7 * k) % 6}>" for i in range(3000)) + "<i>x</i><div>also fixed</div></article>"
    pages = [html_extract.Page(odd(n, n + 1)) for n in range(2)]
    assert max(len(html_extract.fold(p.stream)) for p in pages) > html_extract.LONGEST
    wrapper = html_extract.Wrapper(**html_extract.Wrapper.build(pages))
    left = [s[2] for s, n in zip(pages[1].slots, wrapper.slots(pages[1]), strict=True) if n not in wrapper.fixed]
    assert "fixed" not in left and "also fixed" not in left and "t1" in left


def test_wrappers_align_into_groups():
    streams = [html_extract.Page(page(i, *["x"] * n)).stream for i, n in enumerate((1, 3, 2))]
    wrapper = html_extract.infer(streams)
    import re

    pattern = re.compile(html_extract.expression(wrapper))
    for n in (1, 2, 5):
        assert pattern.fullmatch("".join(t + "\n" for t in html_extract.Page(page(9, *["y"] * n)).stream))
    assert any(isinstance(x, list) and x[0] == "+" for x in wrapper)


def test_fuzzy_trie_finds_one_edit():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(0)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(30)]
    trie = toxicity.FuzzyTrie(terms)
    for _ in range(400):
        token = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8)))
        assert trie.match(token) == sorted((t, distance(t, token)) for t in set(terms) if distance(t, token) <= 1), token


def toxic_corpus(n=900):
    rng = random.Random(5)
    plain = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(["scoundrel", "villain", "zork" + rng.choice(plain)])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    frame = docs(spark, rows).selectExpr("*", "'z' as score")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = dict(labels)
    found = toxicity.score_documents(frame, model).collect()
    assert len(found) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert "villain" in model.lexicon.words and any(s.startswith("zork") for s in model.lexicon.stems)
    finder = toxicity.Finder(model.lexicon)
    abuse = "you are a scoundrel and a villain and a villain"
    assert model.score(finder, abuse) > 0.7
    assert model.score(finder, abuse.replace("villain", "vilain")) > model.score(finder, "you are a fine one and a good one")
    assert model.score(finder, 'they said "villain" to them') < model.score(finder, "you villain villain villain")
    again = toxicity.score_documents(docs(spark, [(1, None), (1, ""), (None, "villain"), (2, "villain " * 50_000)]), model).collect()
    assert len(again) == 4 and again[0]["score"] == again[1]["score"] and not again[2]["held_out"]


def test_toxicity_without_labels(spark):
    frame = docs(spark, [(1, "a"), (2, "b")])
    for labels in ([], [(1, 0), (2, 0)]):
        model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r["predicted"] == 0 for r in toxicity.score_documents(frame, model).collect())
    assert toxicity.score_documents(docs(spark, []), model).count() == 0


TEXTS = [None, "", "Hello, WORLD! it's 42 <|endoftext|> x", "é" * 50, "a　b\u00a0c\x1cd", "İstanbul Σας", "word " * 9000, "n o p, q.", "tail...", "émile, émile. 3,5; ''s"]


def check_pieces(rows, found):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids), text
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_packing_is_whole(spark):
    rng = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(["alpha", "beta,", "Gamma"]) for _ in range(rng.randrange(1, 3000)))) for i in range(60)]
    frame = docs(spark, rows).selectExpr("*", "1 as uid", "2 as n", "3 as start").repartition(4)
    sequences = check_pieces(rows, packing.pack_documents(frame, tokenizer_file("word_bpe_49k.json")).collect())
    assert sum(sum(p["length"] for p in own) < packing.WINDOW for own in sequences.values()) <= 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers(name):
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(tokenizer_file(name)), packing.Ids(tokenizer_file(name))
    assert ids.whole == name.startswith("byte")
    found = ids([(t or "").encode() for t in TEXTS])
    for t, own in zip(TEXTS, found, strict=True):
        assert np.frombuffer(own, ids.kind).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing_of_rows_without_ids(spark):
    found = packing.pack_documents(docs(spark, [(None, "a b"), (None, None), (3, "c")]), tokenizer_file("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] is None, r["doc_tokens"]) for r in found) == [(False, 2), (True, 1), (True, 3)]


def test_packing_of_repeats_and_nothing(spark):
    path = tokenizer_file("word_bpe_49k.json")
    assert packing.pack_documents(docs(spark, []), path).count() == 0
    found = packing.pack_documents(docs(spark, [(1, "same text"), (1, "same text")]), path).collect()
    assert len(found) == 2 and sorted(p["offset"] for p in found) == [0, found[0]["length"]]


def test_least_squares_against_random_starts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.normal(size=6)
        x = packing.non_negative_least_squares(a, b)
        assert x.min() >= 0
        best = np.linalg.norm(a @ x - b)
        gain = a.T @ (b - a @ x)
        assert gain.max() < 1e-6 and np.abs(gain[x > 1e-9]).max(initial=0) < 1e-6
        for _ in range(50):
            assert best <= np.linalg.norm(a @ np.abs(rng.normal(size=9)) - b) + 1e-9


def test_plans_never_overdraw():
    rng = random.Random(2)
    histogram = {q: rng.randrange(0, 40) for q in range(128)}
    used = defaultdict(int)
    for way, n in packing.plan(histogram):
        assert sum(way) == 128 and 2 <= len(way) <= packing.DEPTH
        for q in way:
            used[q] += n
    assert all(used[q] <= histogram[q] for q in used)
    assert packing.plan({}) == [] and packing.plan({64: 1}) == []


def plain_count(vocabulary, word):
    word = token_count.MARK + word
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        size = len(word[j - 1].encode("utf-8", "surrogatepass"))
        options = [(best[j - 1][0] + vocabulary.byte_score * size, best[j - 1][1] - size)]
        for i in range(j):
            node = vocabulary.root
            for c in word[i:j]:
                node = node.get(c)
                if node is None:
                    break
            if node is not None and token_count.SCORE in node:
                options.append((best[i][0] + node[token_count.SCORE], best[i][1] - 1))
        best[j] = max(options)
    return -best[-1][1]


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(token_count, "TRIE_WORDS", 5)
    path = tokenizer_file("piece_bpe_32k.model")
    vocabulary = token_count.Vocabulary.from_model(path)
    texts = [None, "", "the theme, then 東京 thematic\u00a0x", "inter internal international 😀", "the the", "a" * 3000]
    rows = list(enumerate(texts)) + [(1, "the"), (None, "no id")]
    frame = docs(spark, rows).selectExpr("*", "1 as n_tokens")
    found = sorted((tuple(r) for r in token_count.count_tokens(frame, path).collect()), key=repr)
    expected = sorted(((i, len((t or "").split()), sum(plain_count(vocabulary, w) for w in (t or "").split())) for i, t in rows), key=repr)
    assert found == expected
    words = sorted({w for t in texts for w in (t or "").split()}) * 2
    assert vocabulary.counts(words) == [plain_count(vocabulary, w) for w in words]
    assert token_count.count_tokens(docs(spark, []), path).count() == 0


def test_piece_cache_is_bounded():
    calls = []
    cache = piece_cache.PieceCache(lambda ps: calls.extend(ps) or [p * 2 for p in ps], 10)
    for at in range(0, 100, 5):
        wanted = set(range(at, at + 5)) | {0}
        cache.prepare(wanted)
        assert all(cache[p] == p * 2 for p in wanted)
        assert len(cache) <= 15 and len(cache.older) <= 15
    assert len(calls) < 110


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row, last = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 30)))) for i in range(12)] + [(50, ""), (51, None), (52, "ab")]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(60))]
        text = items[rng.randrange(12)][1]
        if i % 3 == 0:
            chars = list(text)
            for _ in range(rng.randrange(0, 2 + int(len(text) * 0.1))):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice([[], ["z"], [chars[k], "y"]])
                chars = chars or ["q"]
            words.insert(rng.randrange(len(words) + 1), "".join(chars).upper().replace(" ", "\n "))
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (0, rows[0][1])]
    frame = docs(spark, rows).selectExpr("*", "1 as item_id", "2 as distance").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(frame, benchmark).collect())
    expected = []
    for i, t in rows:
        text = decontaminate.normalise(t)
        for k, item in items:
            item = decontaminate.normalise(item)
            if item and text:
                d = plain_distance(item, text)
                if d <= decontaminate.budget(item):
                    expected.append((i, k, d))
    assert found == sorted(expected) and any(d > 0 for _, _, d in found)


def test_leaks_of_nameless_items_and_rows(spark):
    items = [(None, "one nameless item of the benchmark"), (None, "another nameless item of it"), (3, "an item that has a name")]
    rows = [(1, "so one nameless item of the benchmark and an item that has a name"), (None, "Another nameless item of it"), (2, "x" * 300_000 + " an item that has a name")]
    found = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == {(1, None, 0), (1, 3, 0), (None, None, 0), (2, 3, 0)} and len(found) == 4


def test_leaks_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs(spark, [(1, "x")]), empty).count() == 0
    assert decontaminate.find_leaks(docs(spark, []), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bit_parallel_distance(seed):
    rng = random.Random(seed)
    for _ in range(60):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert decontaminate.best_match(decontaminate.letter_masks(item), len(item), text)[0] == plain_distance(item, text)
