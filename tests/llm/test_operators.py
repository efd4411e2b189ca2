"""The corpus operators against brute force, and on edge cases: nulls, empty and very long texts, ties, repeated rows, empty tables, further columns."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from usage_trace.llm import ann, decontaminate, html_extract, language_id, license_scan, lm_scoring, mixing, simhash, substring_dedup, token_counts
from usage_trace.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, units long, fp string, h1 int, node string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(n=60, seed=1, size=(3, 80)):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]
    return [" ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(r.randint(*size))) for _ in range(n)]


def docs_of(spark, texts, langs=None, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), 7, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", "   \n\t", "a", "Ä ß", "a b", "x " * 30_000, "same words here now", "same words here now"]


def edge_docs(spark):
    return docs_of(spark, EDGES, ["en", None, "de", "en", "de", "fr", "es", "en", "en"], ["b", None, "a", "b", "a", None, "b", "a", "a"], [0, 1, 2, 3, None, 5, 6, 7, 7])


# --- 1 mixing


def test_mixing_against_brute_force(spark):
    texts, r = made(90), random.Random(3)
    sources = [r.choice(["a", "b", "c", "d", None]) for _ in texts]
    rows = mixing.mix(docs_of(spark, texts, sources=sources)).collect()
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len(words_of(t))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    for x in rows:
        assert x.target == pytest.approx(3 * size[x.source] if x.source in capped else weight[x.source] * level)
        assert x.source_size == size[x.source] and 0 <= x.copies <= 3
        e = x.target / x.source_size
        assert math.floor(e - 1e-6) <= x.copies <= math.ceil(e + 1e-6)
    for s in order:
        own = [x for x in rows if x.source == s]
        assert abs(sum(x.copies for x in own) - len(own) * own[0].target / size[s]) <= 1.001
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs_of(spark, texts, sources=sources).repartition(5)).collect())) if None not in sources else True
    emitted = mixing.emit(docs_of(spark, texts, sources=sources))
    assert emitted.count() == sum(x.copies for x in rows)


def test_mixing_edges(spark):
    rows = mixing.query(edge_docs(spark)).collect()
    assert len(rows) == len(EDGES) and all(x.taken <= 3 * x.size for x in rows)
    assert mixing.query(edge_docs(spark).limit(0)).count() == 0
    assert mixing.emit(edge_docs(spark)).count() == sum(x.copies for x in mixing.mix(edge_docs(spark)).collect())


# --- 2 token counts


def test_token_counts_and_cache(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = made(20) + EDGES + ["special <|endoftext|> here"]
    want = sorted((len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    cache = new_path(spark, "test-cache")
    docs = docs_of(spark, texts)
    run = lambda d: sorted((x.n_bytes, x.n_tokens) for x in token_counts.count_tokens(d, path("byte_bpe_50k.json"), cache).collect())
    assert run(docs) == want
    rows = spark.read.parquet(cache)
    assert rows.count() == len({t or "" for t in texts})
    assert run(docs) == want and spark.read.parquet(cache).count() == rows.count()  # nothing is encoded again
    run(docs_of(spark, ["one more"]))
    assert spark.read.parquet(cache).count() == rows.count() + 1
    assert run(docs.limit(0)) == []
    piece = token_counts.count_tokens(docs_of(spark, ["Hello there"]), path("piece_bpe_32k.model"), cache).first()
    assert piece.n_tokens >= 2 and not piece.over_limit


# --- 3 licences


def test_license_scan(spark):
    texts = [
        "Some prose.\nReleased under the MIT License.\nMore prose.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0.",
        "She renewed her driving license last week",
        "Er kam mit dem Zug",
        None,
        "",
    ]
    rows = {x.doc_id: x for x in license_scan.scan(docs_of(spark, texts)).collect()}
    assert [rows[i].family for i in range(4)] == ["mit", "gpl", "cc", "apache"]
    assert all(rows[i].family in ("none", "unknown") for i in range(4, 8)) and len(rows) == 8
    model = license_scan.default_model()
    for name, templates in license_scan.TEMPLATES.items():
        for t in templates:
            p = model._softmax([x / model.temperature for x in model.logits(license_scan._features(license_scan._words(t)))])
            assert model.classes[p.index(max(p))] == name, t
    others = ["Licensed under the Eclipse Public License 2.0", "Licensed under the ISC license", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Foo Bar Public License, version 7", "Licensed under the European Union Public Licence", "Released under the Unlicense", "GNU Affero General Public License, version 3"]
    got = {x.doc_id: x.family for x in license_scan.scan(docs_of(spark, others)).collect()}
    assert [got[i] for i in range(7)] == ["epl", "isc", "boost", "unknown", "eupl", "unlicense", "agpl"]
    assert license_scan.scan(docs_of(spark, texts).limit(0)).count() == 0
    plan = license_scan.scan(docs_of(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 4 LM scores


def test_lm_scores(spark):
    texts = made(80, size=(10, 60)) + EDGES
    rows = lm_scoring.query(docs_of(spark, texts)).collect()
    tokens = {i: [w.encode().lower() for w in words_of(t)] + [b""] for i, t in enumerate(texts)}
    counts = Counter(t for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in x)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for x in rows:
        own = tokens[x.doc_id]
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 10 == 0)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert x.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
        assert math.isfinite(x.score) and x.score < 0
    assert lm_scoring.query(docs_of(spark, texts).limit(0)).count() == 0


def test_lm_steps_sum_repeated_rows():
    """A step against the plain sum of each row's gradients, also of gradients that lie column by column."""
    r = np.random.default_rng(0)
    p = lm_scoring.Parameters(np.full(30, 1 / 30))
    for n in (1, 2, 7, 600):
        rows, gradient = r.integers(0, 30, n).astype(np.int16), r.standard_normal((n, 34)).astype(np.float32)
        sums = np.zeros((30, 34), np.float64)
        for row, g in zip(rows, gradient):
            sums[row] += g
        hit = np.isin(np.arange(30), rows)
        for order in ("C", "F"):
            value, squares = np.ones((30, 34), np.float32), np.full((30, 34), 1e-2, np.float32)
            p._step(value, squares, rows, np.array(gradient, order=order), 0.3)
            assert np.allclose(squares[hit], 1e-2 + sums[hit] ** 2, rtol=1e-4, atol=1e-5) and (squares[~hit] == np.float32(1e-2)).all()
            assert np.allclose(value[hit], 1 + 0.3 * sums[hit] / np.sqrt(1e-2 + sums[hit] ** 2), rtol=1e-4, atol=1e-5) and (value[~hit] == 1).all()
    for n in (1, 2, 511, 513):  # last batches of any size
        p.train(r.integers(0, 30, (n, 3)).astype(np.int16), r, 0.3)
    assert np.isfinite(p.flat()).all()


def test_lm_is_normalised():
    r = np.random.default_rng(0)
    p = lm_scoring.Parameters(np.full(30, 1 / 30))
    p.train(r.integers(0, 30, (500, 3)), r, 0.3)
    a, b, z = p.tables()
    for w1, w2 in ((0, 1), (30, 30), (7, 29)):
        assert (10.0 ** (a[w1] + b[w2] - z[w1, w2])).sum() == pytest.approx(1, abs=1e-4)


# --- 5 HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now, it is cheap.</div>
<article><h1>A title here</h1><p>First &amp; long   paragraph of
the story, with several words in it.</p><p><b>Second one<br><p>Third.</article>
<section class="comments"><p>I do not like this story at all, said a reader.</p></section><footer>&copy; example</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (4, "w", "<p>cut <a hre"), (5, "x", "no markup at all, only a line of text.")]
    got = {x.page_id: x for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A title here\nFirst & long paragraph of the story, with several words in it.\nSecond one\nThird."
    assert got[2].text == "" == got[3].text and got[1].n_chars == len(got[1].text) and len(got) == 5


def test_html_model_on_pages_not_trained_on():
    model, right, n = html_extract.default_model(), 0, 0
    for page in html_extract.labelled_pages(40, seed=99):
        nodes, labels = html_extract.parse(page, labelled=True), []
        for x in nodes:
            labels.append(x.label if x.label is not None else labels[x.parent] if x.parent >= 0 else 0)
        p, _ = html_extract.marginals(nodes, model.scores(html_extract.describe(nodes)), model.pair)
        texts = [i for i, x in enumerate(nodes) if x.tag == "#text"]
        right, n = right + sum((p[i] >= 0.5) == labels[i] for i in texts), n + len(texts)
    assert right / n > 0.97


def test_marginals_against_enumeration():
    nodes = html_extract.parse("<div><p>a</p><p>b<div>c</div></div>")
    r = random.Random(1)
    own, pair = [r.uniform(-2, 2) for _ in nodes], {k: [r.uniform(-1, 1) for _ in range(4)] for k in ("text", "block")}
    total, ones = 0.0, [0.0] * len(nodes)
    for bits in range(1 << len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        s = sum(u for u, b in zip(own, y) if b) + sum(pair["text" if x.tag == "#text" else "block"][2 * y[x.parent] + y[i]] for i, x in enumerate(nodes) if i)
        total += math.exp(s)
        ones = [o + math.exp(s) * b for o, b in zip(ones, y)]
    assert html_extract.marginals(nodes, own, pair)[0] == pytest.approx([o / total for o in ones])


# --- 6 SimHash


def test_fingerprint_against_bits():
    for text in made(10) + ["", "one", "one Two", "É x Y z"]:
        w = [x.encode().lower() for x in words_of(text)]
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
        assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(None) == 0


def _clustered(n, seed):
    r = random.Random(seed)
    centers = [r.getrandbits(64) for _ in range(max(1, n // 20))]
    out = set()
    while len(out) < n:
        x = r.choice(centers)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return np.sort(np.array(list(out), np.uint64))


def test_trie_join_against_all_pairs():
    a, b = _clustered(600, 1), _clustered(500, 1)[::2].copy()
    got = {(int(i), int(j)) for x in simhash.close_pairs(a) for i, j in zip(*x)}
    assert got == {(i, j) for i, j in combinations(range(len(a)), 2) if (int(a[i]) ^ int(a[j])).bit_count() <= 2}
    got = {(int(i), int(j)) for x in simhash.close_pairs(a, b) for i, j in zip(*x)}
    assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= 2}


@pytest.mark.parametrize("block, most", [(1 << 14, 1 << 20), (50, 120)])
def test_blocks_hold_every_link(spark, block, most):
    fps = _clustered(400, 7)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    parts = simhash.blocks(df, len(fps), block=block, most=most)
    edges = parts.groupBy("depth", "node").applyInPandas(simhash._forest(2), "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    parent = np.arange(len(fps))
    pairs = [(i, j) for i, j in combinations(range(len(fps)), 2) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2]
    simhash.unite(parent, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    signed = fps.view(np.int64)
    classes, mine = {}, {}
    for i, p in enumerate(parent):
        classes.setdefault(int(p), set()).add(int(signed[i]))
    for node, root in got.items():
        mine.setdefault(root, set()).add(node)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates(spark):
    base = made(12, size=(200, 260))
    texts = base + [base[0]] * 5 + [base[1] + " end"] + EDGES
    got = simhash.query(docs_of(spark, texts)).collect()
    fps = [simhash.fingerprint(t.encode() if t is not None else None) for t in texts]
    assert {x.doc_id: x.fingerprint for x in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(label))
    kept = simhash.keep_one(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and kept.columns == docs_of(spark, texts).columns
    assert simhash.query(edge_docs(spark)).count() == len(EDGES) and simhash.query(edge_docs(spark).limit(0)).count() == 0


# --- 7 substrings


def test_substring_dedup(spark):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) + str(r.randint(0, 999)) for _ in range(n)).capitalize() + "."
    passage = " ".join(say(12) for _ in range(5))
    texts = [say(10) + " " + passage + " " + say(9), say(8), "Intro without stop " + passage + "\n" + say(14), passage, None, "", say(30)]
    got = {x.doc_id: x for x in substring_dedup.query(docs_of(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == texts[1] and got[6].text == texts[6]
    assert got[3].text == "" and got[3].n_removed == 5
    assert got[2].n_removed == 4 and len(got[2].text.split()) == len(texts[2].split()) - 48
    assert got[4].text is None and got[5].text == ""
    first = {}
    for i, t in enumerate(texts):  # brute force: the first place of each span
        for a, _, h in substring_dedup.spans(t):
            first.setdefault(h, (i, a))
    for i, t in enumerate(texts):
        found = substring_dedup.spans(t)
        assert substring_dedup.cut(t or "", found, {a for a, _, h in found if first[h] != (i, a)})[0] == (got[i].text or "")
    kept = substring_dedup.keep_rest(docs_of(spark, texts))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 2, 4, 5, 6] and kept.columns == docs_of(spark, texts).columns
    assert substring_dedup.query(edge_docs(spark)).count() == len(EDGES) and substring_dedup.query(edge_docs(spark).limit(0)).count() == 0


def test_spans_cover_every_repeated_run(spark):
    """A short last sentence, a long single one and runs of any lengths go whole; a repeat that is no run stays."""
    r = random.Random(9)
    say = lambda n: " ".join(r.choice("abcdefghij") + str(r.randint(0, 99999)) for _ in range(n)).capitalize() + "."
    passages = [" ".join(say(n) for n in sizes) for sizes in ((25, 25, 4), (4, 25, 25, 3, 2), (60,), (3, 55), (55, 3), (30, 1, 1, 1, 30, 1), (10, 9, 30, 5))]
    passages += [" ".join(say(r.choice([1, 2, 5, 12, 25, 60])) for _ in range(r.randint(3, 9))) + " " + say(21) for _ in range(20)]
    stay = [say(30), say(9) + " " + say(9)]
    texts = [say(14) + " " + p + " " + say(16) for p in passages + stay]
    own = [(say(17), say(13)) for _ in passages + stay]
    texts += [a + " " + p + " " + b for (a, b), p in zip(own, passages + stay)]
    got = {x.doc_id: x for x in substring_dedup.query(docs_of(spark, texts)).collect()}
    for k, ((a, b), p) in enumerate(zip(own, passages + stay)):
        assert got[k].text == texts[k] and got[k].n_removed == 0
        if p in stay:
            assert got[len(own) + k].text == a + " " + p + " " + b
        else:
            assert got[len(own) + k].text == a + " " + b and got[len(own) + k].n_removed == len(substring_dedup.sentences(p))


# --- 8 language


SAMPLES = {
    "de": "der die das und nicht mit einem Haus ueber die Strasse gegangen sein wird schon immer wieder",
    "en": "the house and the street with some words that were there before this was going on again",
    "es": "la casa y la calle con unas palabras que estaban antes de esto otra vez para siempre",
    "fr": "la maison et la rue avec des mots qui etaient avant cela encore une fois pour toujours",
}


def test_language(spark):
    r, texts, langs = random.Random(2), [], []
    for i in range(160):
        lang = sorted(SAMPLES)[i % 4]
        texts.append(" ".join(r.choice(SAMPLES[lang].split()) for _ in range(r.randint(8, 40))))
        langs.append(lang)
    rows = language_id.query(docs_of(spark, texts + EDGES, langs + [None] * len(EDGES))).collect()
    assert len(rows) == len(texts) + len(EDGES)
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
    own = [x for x in rows if x.held_out and x.doc_id < len(texts)]
    assert sum(x.lang_pred == langs[x.doc_id] for x in own) >= 0.95 * len(own)
    assert [x.lang_pred for x in sorted(rows, key=lambda x: x.doc_id) if len(texts) <= x.doc_id < len(texts) + 3] == ["und"] * 3
    kept = language_id.keep_known(docs_of(spark, texts + ["123 %%"], langs + ["en"]))
    assert kept.count() == len(texts) and kept.columns == docs_of(spark, texts).columns
    assert {x.lang_pred for x in language_id.query(docs_of(spark, ["some words"], [None])).collect()} == {"und"}
    assert language_id.query(edge_docs(spark).limit(0)).count() == 0


# --- 9 decontamination


def _similar(a, b):
    m = sum((a & b).values())
    return m / (sum(a.values()) + sum(b.values()) - m)


def _bag(w):
    return Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 5 else Counter([" ".join(w)])


def test_decontamination_against_all_windows(spark):
    items = [t.lower() for t in made(8, seed=11, size=(18, 50))] + ["only three words", None, " "]
    r, texts = random.Random(4), []
    for k, t in enumerate(made(40, seed=12, size=(30, 120))):
        w, own = t.split(), (items[k % 9]).split()
        if k % 4 == 0:
            own = own[: len(own) // 2] + ["edit"] + own[len(own) // 2 + 1 :]
        if k % 4 == 1:
            own = own[1:]
        at = r.randint(0, len(w))
        texts.append(" ".join(w[:at] + own + w[at:]) if k % 5 else t)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = docs_of(spark, texts + EDGES)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.query(docs, benchmark).collect()}
    want = {}
    for i, t in enumerate(texts + EDGES):
        w = [x.lower() for x in words_of(t)]
        for j, item in enumerate(items):
            own = words_of(item)
            if own and len(w) < 1000:
                best = max((_similar(_bag(w[max(0, a) : a + len(own)]), _bag(own)) for a in range(-len(own) // 5, len(w)) if w[max(0, a) : a + len(own)]), default=0)
                if best >= 0.8:
                    want[(i, j)] = best
    assert got == pytest.approx(want) and len(want) > 10
    clean = decontaminate.keep_clean(docs, benchmark)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(set(range(len(texts + EDGES))) - {i for i, _ in want})
    assert decontaminate.query(docs, benchmark.limit(0)).count() == 0 and decontaminate.query(docs.limit(0), benchmark).count() == 0
    plan = decontaminate.query(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_of_texts_that_share_an_item_id(spark):
    r = random.Random(14)
    say = lambda least, most: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(least, most))) for _ in range(30))
    items = [(7, say(9, 12)), (7, say(2, 5)), (7, say(2, 5)), (None, say(9, 12)), (None, say(2, 5)), (None, say(2, 5))]  # of equal length; the first has the longest words
    texts = [say(3, 6) + " " + t + " " + say(3, 6) for _, t in items]
    got = decontaminate.query(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.similarity, x.start) for x in got) == [(i, k, 1.0, 30) for i, (k, _) in enumerate(items)]


def test_hamming_blocks_find_all_within_radius(spark):
    r = random.Random(6)
    items = [(i, 30, r.getrandbits(64) - (1 << 63)) for i in range(20)]
    windows = []
    for k in range(200):
        x = items[k % 20][2]
        for b in r.sample(range(64), r.randint(0, 30)):
            x ^= 1 << b if b < 63 else -(1 << 63)
        windows.append((k, 30, x))
    got = decontaminate.candidates(spark.createDataFrame(windows, "window long, n int, fp long"), spark.createDataFrame(items, "item long, n int, fp long"), 6)
    want = {(w, i) for w, _, x in windows for i, _, y in items if ((x ^ y) & (1 << 64) - 1).bit_count() <= 6}
    assert {tuple(x) for x in got.collect()} == want and want


# --- 10 nearest neighbours


VECTORS = "vec_id long, embedding array<float>, label int, node string, d double"


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 16)).astype(np.float32)
    x[700:760] = x[3]
    rows = [(i, v.tolist(), 0, "x", 0.0) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 7, [float("inf")] + [1.0] * 15]
    rows += [(1500 + i, v, 0, "x", 0.0) for i, v in enumerate(bad)]
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), every=50).collect()
    y, hit = x.astype(np.float64), 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [m.rank for m in mine] == list(range(1, 11)) and all(m.score == pytest.approx(d[m.vec_id]) for m in mine)
        assert [(m.score, m.vec_id) for m in mine] == sorted((m.score, m.vec_id) for m in mine)
        hit += len({m.vec_id for m in mine} & set(want.tolist()))
    assert hit >= 0.9 * 300
    assert {x.query_id for x in got} == set(range(0, 1500, 50))


def test_nearest_edges(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "", 0.0), (1, [0.0, 1.0], 1, "", 0.0), (2, [0.0, 1.0], 1, "", 0.0), (100, [1.0, 1.0], 1, "", 0.0)], VECTORS)
    got = sorted((x.query_id, x.rank, x.vec_id) for x in ann.nearest(few).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.nearest(few.limit(0)).count() == 0
    assert ann.nearest(few.where(F.col("vec_id") > 0).where("vec_id < 100")).count() == 0


def test_nearest_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.0, 3.0]), (5, [0.9, 0.1]), (5, [0.9, 0.1]), (7, [0.5, 0.5]), (0, [0.0, 2.0])]
    got = ann.nearest(spark.createDataFrame([(*x, 1, "", 0.0) for x in rows], VECTORS), k=3).collect()
    d = lambda a, b: math.dist(a, b)
    want = []
    for q in ([1.0, 0.0], [0.0, 2.0]):
        distinct = sorted({(round(d(np.float32(q), np.float32(v)), 6), i) for i, v in rows if i != 0})[:3]
        want += [(0, n, i, s) for n, (s, i) in enumerate(distinct, 1)]
    assert sorted((x.query_id, x.rank, x.vec_id, round(x.score, 6)) for x in got) == sorted(want)


def test_nearest_among_clusters(spark):
    """Recall of the registered search on tight clusters, where most of a graph is out of reach of any one entry."""
    r = np.random.default_rng(8)
    centers = r.standard_normal((400, 24))
    x = (centers[r.integers(0, 400, 8000)] + 0.05 * r.standard_normal((8000, 24))).astype(np.float32)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist(), 0, "", 0.0) for i, v in enumerate(x)], VECTORS), every=100).collect()
    y, hit = x.astype(np.float64), 0
    for q in range(0, 8000, 100):
        dist = ((y - y[q]) ** 2).sum(1)
        dist[q] = np.inf
        hit += len({m.vec_id for m in got if m.query_id == q} & set(np.argsort(dist)[:10].tolist()))
    assert hit >= 0.9 * 800


def test_license_scores_against_python(spark):
    """The plan's sums, choice and confirmation, worked out again from the model for each paragraph."""
    model, r = license_scan.default_model(), random.Random(12)
    table = {x["gram"]: x for x in model.table()}
    words = [w for t in license_scan.TEMPLATES.values() for x in t for w in license_scan._words(x)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(2, 14))) for _ in range(60)] + [x for t in license_scan.TEMPLATES.values() for x in t] + license_scan.PLAIN
    lines += [lines[70], "licence " * 30_000, "Licensed under the MIT License " * 4000]
    got = {(x.doc_id, x.paragraph): x for x in license_scan.classify(docs_of(spark, lines)).collect()}
    k, cue = len(model.classes), license_scan._cue
    for i, line in enumerate(lines):
        w = license_scan._words(line)
        grams, pairs = set(w) | license_scan._pairs(w), license_scan._pairs(w)
        known = [table[g] for g in grams if g in table]
        p = model._softmax([(model.bias[c] + sum(x["w"][c] for x in known)) / model.temperature for c in range(k)])
        if not known or not any(map(cue, w)) or p[-1] >= license_scan.IDLE - 1e-9:
            assert (i, 0) not in got or abs(p[-1] - license_scan.IDLE) < 1e-6
            continue
        best = max(range(k), key=lambda c: p[c])
        weight = sum(table[g]["g"] if g in table and table[g]["g"] else 1 for g in pairs)
        similar = sum(table[g]["t"][best] for g in pairs if g in table) / weight if best < k - 1 and weight else 0.0
        sure = best < k - 1 and p[best] >= model.threshold and similar >= license_scan.CONFIRM
        x = got[i, 0]
        assert x.score == pytest.approx(p[best]) and x.similarity == pytest.approx(similar) and x.family == (model.classes[best] if sure else "unknown")


def test_license_plan_is_small(spark):
    """The driver holds a plan and its text many times over, so neither the model's table nor a class's share of all classes is spelled out in it."""
    df = license_scan.scan(docs_of(spark, ["Released under the MIT License", "licensed", None]))
    plan = df._jdf.queryExecution()
    assert len(plan.optimizedPlan().toString()) < 50_000 and len(plan.executedPlan().toString()) < 50_000
