"""Operators with models, tokenizers or sketches, against brute force, round trips and held-out rows."""

from __future__ import annotations

import collections
import math
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwright.llm import html_extract, lm_scoring, near_dup, packing, toxicity
from spanwright.llm.common import checkpointed

SF = "/root/testdata/sf0.01"


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "three four five six seven eight"), (5, "x" * 300 + " é😀 ñ"), (6, "very long " * 30_000)]


# packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    docs = texts(spark, ODD).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id > 100").limit(150))
    rows = packing.pack_documents(docs, packing.default_tokenizer(), with_ids=True).collect()
    places = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 4 * packing.SEQUENCE and zlib.crc32(r.ids) == r.ids_crc32 and r.start == r.piece * packing.SEQUENCE
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        assert [o for o, _ in sorted(at)] == list(np.cumsum([0] + [n for _, n in sorted(at)])[:-1]) and sum(n for _, n in at) <= packing.SEQUENCE
    whole = collections.Counter()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.piece].append(bytes(r.ids))
    for d in docs.collect():
        ids = np.array(t.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        for k in range(math.ceil(len(ids) / 4 / packing.SEQUENCE)):
            pieces[d.doc_id, k].remove(ids[4 * packing.SEQUENCE * k : 4 * packing.SEQUENCE * (k + 1)])
        whole["tokens"] += len(ids) // 4
    assert not any(pieces.values())
    assert len(places) <= math.ceil(whole["tokens"] / packing.SEQUENCE) * 1.03 + 1
    assert packing.pack_documents(docs.limit(0), packing.default_tokenizer()).count() == 0


def test_two_replace_the_smallest():
    sequence, offset = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)  # 6 + 3 leaves 1; 6 + 2 + 2 fills it
    assert sequence[0] == sequence[2] == sequence[3] != sequence[1]
    lengths = np.random.default_rng(5).integers(1, 2049, 3000)
    sequence, _ = packing.best_two_fit(lengths)
    assert np.bincount(sequence, lengths).max() <= 2048 and sequence.max() + 1 <= 1.05 * lengths.sum() / 2048


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=/a>Menu &amp; more</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<article><h1>A&nbsp;title  &lt;x&gt;</h1><p>First <b>bold</b>
paragraph with &copy; and enough text to surge past the threshold of the window, which it does by now.<br><p>Is.</p>
<aside>Related</aside><form>Name <input></form><p>Last.</p></article>
<div id="comments"><p>I disagree with all of this and say so at length, more than once, to be sure.</p></div><footer>&copy; someone</footer>"""


def test_html():
    assert html_extract.main_text(PAGE) == "A title <x>\nFirst bold paragraph with © and enough text to surge past the threshold of the window, which it does by now.\nIs.\nLast."
    assert html_extract.main_text("<p>short</p>") == "short"
    assert html_extract.main_text("<script>x") == html_extract.main_text("<div></div>") == ""
    assert html_extract.main_text("a < b &am") == "a < b &am"


def test_html_by_distribution():
    soup = "<div><a href=x>Home</a> <a href=y>News</a></div>" * 6 + "<div>Title here</div>" + "<div>%s</div>" % ("long text of the article " * 8) + "<div><a href=x>More</a></div>" * 8
    assert html_extract.main_text(soup).split("\n")[0] == "Title here" and "Home" not in html_extract.main_text(soup)


@pytest.mark.parametrize("attribute", ['style="overflow:hidden"', 'aria-hidden="false"', 'title="a: hidden b"', "style='max-display:none'", 'data-hidden=""'])
def test_html_keeps_what_is_shown(attribute):
    assert html_extract.main_text(f"<div {attribute}><article><p>Some text.</p></article></div>") == "Some text."


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display : none"', "class='x ad'"])
def test_html_drops_what_is_hidden(attribute):
    assert html_extract.main_text(f"<article><p>Some text.</p><div {attribute}>Not shown.</div></article>") == "Some text."


def test_html_keeps_links_and_short_ends():
    assert html_extract.main_text('<article><p>See <a href="https://x.org/hidden-gems">these gems</a> now.</p></article>') == "See these gems now."
    advert = '<div class="ad">Buy now</div>'
    assert html_extract.main_text(f"<article><p>{'long text ' * 20}</p>{advert * 3}<p>The end.</p></article>").split("\n")[1:] == ["The end."]


LONG_LINE = "This sentence stands in the text of the article, which is long enough to be a surge of its own."


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<article><p>Text.</p><article class="comment"><p>I disagree.</p></article></article>', "Text."),
        ('<article><p>Text.</p></article><article class="comment user"><p>I disagree.</p></article>', "Text."),
        ('<article><h2 id="related-work">Related work</h2><section id="related-work-2"><p>A paragraph.</p></section></article>', "Related work\nA paragraph."),
        ('<article><div class="share-price">It rose.</div><p class="notice-of-motion">Moved.</p></article>', "It rose.\nMoved."),
        (f'<div><p>{LONG_LINE}</p>{"<div class=ad>Buy</div>" * 3}<p>The end.</p></div>', f"{LONG_LINE}\nThe end."),
        (f"<article><p>{LONG_LINE}</p></article><article><p>Short.</p></article>", f"{LONG_LINE}\nShort."),
        (f'<div><p>{LONG_LINE}</p><p><a href="x">A linked paragraph</a></p><p>{LONG_LINE}</p></div>', f"{LONG_LINE}\nA linked paragraph\n{LONG_LINE}"),
        ('<article><p>Text.</p><p><a href="x">Linked.</a></p></article>', "Text.\nLinked."),
        (f'<div class="site-header">Site</div><nav>Menu</nav><div>{LONG_LINE}</div><div class="comments-section"><p>{LONG_LINE}</p></div>', LONG_LINE),
        (f'<div class="sidebar"><main><p>Text.</p></main></div><div class="sidebar">{LONG_LINE}</div>', "Text."),
        (f'{"<p><a href=x>Home page</a></p>" * 5}<p>Title</p><p>{LONG_LINE}</p>{"<p><a href=x>Next page</a></p>" * 5}', f"Title\n{LONG_LINE}"),
        ("<head><title>T</title><body><p>Text.", "Text."),
        ("<p>a <b>bold</b>&nbsp;word &lt;p&gt;<br>next", "a bold word <p>\nnext"),
    ],
)
def test_html_by_hand(page, expected):
    assert html_extract.main_text(page) == expected


def test_html_surges_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(600):
        window, surge = int(rng.integers(1, 5)), int(rng.integers(1, 120))
        weights = (rng.integers(0, 60, rng.integers(0, 25)) * (rng.random() < rng.random(1))).tolist()
        weights = [w if rng.random() < 0.6 else 0 for w in weights]
        groups: list[list[int]] = []
        for i, w in enumerate(weights):
            if w and groups and i - groups[-1][-1] <= window:
                groups[-1].append(i)
            elif w:
                groups.append([i])
        peaks = [max(sum(weights[k] for k in g if t - window < k <= t) for t in g) for g in groups]
        need = min([surge, *([max(peaks)] if peaks else [])])
        high = [k for k, peak in enumerate(peaks) if peak >= need]
        expected = [(g[0], g[-1] + 1) for k, g in enumerate(groups) if high and high[0] <= k <= high[-1]]
        assert html_extract.between_surges(weights, window, surge) == expected


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\"'\"", "<!", "<script ", "<head>", "<title>", "<div class=ad>x", "</script", "<li><a href=x>y</a>", "<", "&", "<div class=ad><main></main></div>"])
def test_html_takes_long_pages_in_their_stride(part):
    began = time.time()
    html_extract.main_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 20  # a quadratic reader takes hours


def test_html_without_article_tags_by_distribution(spark):
    """The lines' distribution alone finds what the article element holds."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").filter("html IS NOT NULL").collect():
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_extract.main_text(bare) == html_extract.main_text(r.html)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", "")], "page_id long, url string, html string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id != 1} == {""}
    real = html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet"))
    assert real.filter("n_chars = 0").count() == 0


# language model


def test_probabilities_sum_to_one():
    p = lm_scoring.initial()
    at = np.array([2])
    total = 0.0
    for t in range(lm_scoring.VOCABULARY):
        total += math.exp(lm_scoring.log_probabilities(p, np.array([0, 0, t, 7, 9, 0, 0]), at)[0])
    assert abs(total - 1) < 1e-4


def test_training_descends():
    rng = np.random.default_rng(1)
    seq = np.concatenate([[0, 0], np.tile([5, 6, 7, 8], 2000), [0, 0]])
    at = np.arange(2, len(seq) - 2)
    trainer = lm_scoring.Trainer(lm_scoring.initial())
    before = lm_scoring.log_probabilities(trainer.p, seq, at).mean()
    for _ in range(60):
        trainer.step(seq, rng.choice(at, 512, replace=False))
    assert lm_scoring.log_probabilities(trainer.p, seq, at).mean() > before + 4


def test_lm_gradients():
    rng = np.random.default_rng(3)
    seq, at = np.concatenate([[0, 0], rng.integers(1, lm_scoring.VOCABULARY, 40), [0, 0]]), np.arange(2, 42)
    trainer = lm_scoring.Trainer(lm_scoring.initial())
    got = trainer.gradients(seq, at)
    for name, value in trainer.p.items():
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in value.shape)
            if name == "embedding":
                i = (int(seq[rng.integers(2, 42)]), i[1])
            old, slope = value[i], 0.0
            for sign in (1, -1):
                value[i] = old + sign * 1e-2
                slope -= sign * lm_scoring.log_probabilities(trainer.p, seq, at).astype(np.float64).mean() / 2e-2
            value[i] = old
            assert abs(slope - got[name][i]) < 1e-3 + 0.05 * abs(slope), name


def naive_score(p: dict, tokens: list[int]) -> float:
    """Token by token, with the whole softmax of both levels and no batches."""
    seq, total = [0, 0, *tokens, 0, 0], 0.0
    for i in range(2, len(seq) - 2):
        h = p["hidden"].astype(np.float64)
        for j, offset in enumerate((-2, -1, 1, 2)):
            h = h + p["embedding"][seq[i + offset]].astype(np.float64) @ p["place"][j]
        h = np.tanh(h)
        b, t = divmod(seq[i], lm_scoring.BLOCK)
        x, y = (h @ w[:-1] + w[-1] for w in (p["block"].astype(np.float64), p["token"][b].astype(np.float64)))
        total += x[b] - np.log(np.exp(x).sum()) + y[t] - np.log(np.exp(y).sum())
    return total


def test_lm_scores_against_a_naive_recomputation(spark):
    rows = [(i, t) for i, t in enumerate(["the quick brown fox", "Zürich, ###   xyzzyq-42 漢字", "", "w " * 300, "one"])]
    docs = texts(spark, rows).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id > 200").limit(15))
    frequent, path = lm_scoring.frequent_words(docs.select("text")), packing.default_tokenizer()
    p = lm_scoring.train(lm_scoring.tokenised(docs, frequent, path).coalesce(2))
    words = lm_scoring.Words(frequent, path)
    model = spark.sparkContext.broadcast(p)
    got = {r.doc_id: r for r in lm_scoring.scored(lm_scoring.tokenised(docs, frequent, path), model).collect()}
    for r in docs.collect():
        tokens = np.frombuffer(words.tokens(r.text), np.uint16).tolist()
        assert got[r.doc_id].n_tokens == len(tokens) and all(0 < t < lm_scoring.VOCABULARY for t in tokens)
        assert abs(got[r.doc_id].log_probability - naive_score(p, tokens)) < 1e-2 + 1e-4 * len(tokens)


def test_lm_average(spark):
    rng = np.random.default_rng(2)
    rows = [(task, part, float(n), [float(x) for x in rng.random(3)]) for task in range(150) for n in [rng.integers(1, 9)] for part in range(2)]
    mean = lm_scoring.average(spark.createDataFrame(rows, "task int, part int, n double, p array<float>"))
    expected = [sum(r[2] * r[3][j] for r in rows if r[1] == part) / sum(r[2] for r in rows if r[1] == part) for part in range(2) for j in range(3)]
    assert np.allclose(mean, expected, atol=1e-5)


def test_every_position_is_masked_once():
    at = np.arange(2, 1000)
    assert sorted(i for r in range(lm_scoring.ROUNDS) for i in at[at % lm_scoring.ROUNDS == r]) == at.tolist()


def test_lm_scores(spark):
    docs = texts(spark, ODD).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id > 100").limit(200))
    got = lm_scoring.score_documents(docs).collect()
    assert len(got) == docs.count()
    empty = [r for r in got if r.doc_id in (1, 2, 3)]
    assert all((r.n_tokens, r.log_probability, r.mean_log_probability) == (0, 0.0, None) for r in empty)
    assert all(r.log_probability < 0 for r in got if r.n_tokens)
    assert lm_scoring.score_documents(docs.limit(0)).count() == 0


# toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    x = rng.standard_normal((9, 2 * toxicity.WIDTH)).astype(np.float32)
    windows = rng.integers(0, 9, (4, toxicity.WINDOW))
    wanted = np.array([1, 0, 1, 0], np.float32)
    g, dx, _ = net.gradients(x, windows, wanted)

    def loss():
        p = toxicity._sigmoid(net.run(net.gates(x), windows).astype(np.float64))
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    for name in ("u0", "u1", "in0", "b1", "attend", "focus", "out"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        slope = (up - loss()) / 2e-2
        net.p[name][at] = old
        assert abs(slope - g[name][at]) < 2e-3 + 0.05 * abs(slope), name


def test_windows_cover_everything():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        w = toxicity.windows_of(np.arange(1, n + 1))
        assert set(w.ravel()) - {0} == set(range(1, n + 1))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    asked = docs.join(labels, "doc_id").filter(toxicity.held_out())
    scores = toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels)
    rows = scores.join(asked.select("doc_id", "toxic"), "doc_id").toPandas()
    assert rows["held_out"].all() and rows["score"].between(0, 1).all()
    order = rows["score"].rank()
    n1, n0 = (rows["toxic"] == 1).sum(), (rows["toxic"] == 0).sum()
    assert (order[rows["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.93


def test_toxicity_calibration():
    rng = np.random.default_rng(1)
    logit = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * logit - 1)))).astype(int)
    slope, shift = toxicity.calibration(logit, y)
    assert abs(slope - 0.5) < 0.1 and abs(shift + 1) < 0.2
    assert toxicity.calibration(logit, np.where(logit > 0, 0, 1)) == (1.0, 0.0)


def test_training_sample_keeps_long_texts_whole(spark):
    docs = texts(spark, [(i, "word " * (30_000 if i == 3 else 5)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    fold = docs.filter(~toxicity.held_out()).count()
    got = toxicity.training_sample(docs, labels)
    assert len(got) == fold and max(map(len, got["text"])) == (150_000 if docs.filter("doc_id = 3").filter(~toxicity.held_out()).count() else 25)
    small = toxicity.training_sample(docs, labels, toxicity.Sample(toxic=3, clean=4, chars=100))
    assert 0 < len(small) <= 4 and sum(map(len, small["text"])) <= 100


def test_toxicity_edges(spark):
    rows = [(i, f"you {'awful idiot' if i % 2 else 'kind friend'} of mine, number {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {(r.doc_id, r.text): r for r in toxicity.score_toxicity(texts(spark, rows + ODD), labels).join(texts(spark, rows + ODD), "doc_id").collect()}
    assert got[(41, rows[41][1])].score > got[(42, rows[42][1])].score
    none = toxicity.score_toxicity(texts(spark, rows[:3] + ODD), labels.limit(0))
    assert none.count() == 3 + len(ODD) and {r.score for r in none.collect()} == {0.0}
    assert toxicity.score_toxicity(texts(spark, []), labels).count() == 0


@pytest.mark.parametrize("text", ["x" * 25, "https://example.org/" + "a1b2" * 40, "漢字" * 500, "y" * 30 + " " + "z" * 40])
def test_toxicity_of_long_words_alone(text):
    """Chunks that all have the same number of parts, two or more."""
    net = toxicity.Network(3)
    got = toxicity.score_texts(net, toxicity.Words(net), [text, "kind friend"])
    parts = " ".join(w for c in text.split() for w in toxicity.normal(c))
    assert np.allclose(got, toxicity.score_texts(net, toxicity.Words(net), [parts, "kind friend"]))


# near duplicates


def brute_classes(spark, docs):
    rows = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    seen = collections.Counter(w for words in rows.values() for w in set(words))
    idf = {w: 1 + math.log(len(rows) / n) for w, n in seen.items()}
    code = {w: near_dup.xxhash.xxh64_intdigest(w.encode(), 42) for w in seen}
    vec = {i: near_dup.vector(np.array([code[w] for w in words], np.uint64), np.array([idf[w] for w in words], np.float32)) for i, words in rows.items() if words}
    parent = {i: i for i in vec}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(set)
    for i, (h, _) in vec.items():
        for x in h.tolist():
            holders[x].add(i)
    for a in sorted(vec):
        for b in set().union(*(holders[x] for x in vec[a][0].tolist())):
            if a < b and near_dup.weighted_jaccard(*vec[a], *vec[b]) >= near_dup.THRESHOLD:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in vec}


def varied(seed: int, n: int, edits: int) -> list[str]:
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            words[rng.integers(0, len(words))] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_against_brute_force(spark):
    rows = [t for seed in range(6) for t in varied(seed, 14, 3)] + [t for seed in range(10, 40) for t in varied(seed, 1, 0)] + varied(1, 3, 0)
    docs = texts(spark, list(enumerate(rows))).repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    expected = brute_classes(spark, docs)
    assert len(set(got.values())) == len(set(expected.values())) and got == expected


def test_frequencies_of_rare_words_are_exact(spark):
    """More documents than make all words common: pairs that a single frequency for all rare words would put on the other side of the threshold."""
    rng = np.random.default_rng(11)
    rows = [" ".join(f"w{x}" for x in rng.integers(0, 300, 30)) for _ in range(6000)]
    for i in range(150):
        own, often = [f"r{i}x{j}" for j in range(60)], [f"w{x}" for x in rng.integers(0, 300, 40)]
        share = int(rng.integers(2, 14))
        rows += [" ".join(own + often), " ".join(own + often[share:] + [f"w{x}" for x in rng.integers(0, 300, share)])]
        rows += [" ".join(own[:30] + often[:30])] * int(rng.integers(0, 2))
        rows += [f"r{i}x59 r{i}x58 r{i}x57"] * int(rng.integers(0, 4))
    docs = texts(spark, list(enumerate(rows))).repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    expected = brute_classes(spark, docs)
    linked = [i for i, c in expected.items() if i >= 6000 and c != i]
    assert 40 < len(linked) and got == expected
    known, counts = near_dup.word_idf(docs)
    seen = collections.Counter(w for t in rows for w in set(t.split()))
    h = np.array([near_dup.xxhash.xxh64_intdigest(w.encode(), 42) for w in seen], np.uint64)
    rare = {r.h: r.n for r in counts.collect()}
    assert 0 < len(rare) and len(known.hashes) <= 300
    own = np.array([rare.get(x, 1) for x in h.view(np.int64).tolist()])
    assert np.allclose(known.exact(h, h, own), [1 + math.log(len(rows) / n) for n in seen.values()])
    assert (known.of(h) <= known.exact(h, h, own) + 1e-6).all()


def test_large_spread_group_loses_no_link(spark):
    """Near copies on both sides of the threshold, far more than a small bucket holds."""
    docs = texts(spark, list(enumerate(varied(8, 160, 10)))).repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    expected = brute_classes(spark, docs)
    assert 20 < len(set(expected.values())) < 150 and got == expected


def test_pairs_that_meet_only_in_large_buckets(spark):
    """Texts that share a long passage and have a short end of their own, each with one copy edited in its end."""
    rng = np.random.default_rng(5)
    passage, rows = [f"w{x}" for x in rng.integers(0, 400, 120)], []
    for i in range(90):
        end = [f"t{i}x{x}" for x in rng.integers(0, 10**6, 5)]
        rows += [" ".join(passage + end[:3] + [f"e{i}y{j}"] + end[4:]) for j in range(2)]
    docs = texts(spark, list(enumerate(rows))).repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    expected = brute_classes(spark, docs)
    assert len(set(expected.values())) == 90 and got == expected


def test_near_duplicates_hot_group(spark):
    docs = texts(spark, [(i, t) for i, t in enumerate(["the same text over and over again today"] * 400 + varied(3, 200, 1))])
    got = near_dup.near_duplicates(docs)
    assert got.count() == 600 and got.select("class_id").distinct().count() == 2


def test_rarest_shingles_meet(spark):
    """Any two vectors at the threshold share a bucket, whatever the sketch holds; those that share a frequent passage alone do not."""
    rng = np.random.default_rng(5)
    near = 0
    for _ in range(3000):
        n = int(rng.integers(1, 40))
        ha = np.unique(rng.integers(0, 60, n).astype(np.uint64))
        hb = np.unique(np.where(rng.random(len(ha)) < 0.08, rng.integers(0, 60, len(ha)), ha).astype(np.uint64))
        wa, wb = (rng.choice([1.0, 2.0, 5.5], len(h)).astype(np.float32) for h in (ha, hb))
        wb = np.where(np.isin(hb, ha), wa[np.minimum(np.searchsorted(ha, hb), len(ha) - 1)], wb).astype(np.float32)
        counts = np.full(near_dup.CELLS, 2, np.int64)
        counts[:60] = rng.integers(2, 9, 60)
        if near_dup.weighted_jaccard(ha, wa, hb, wb) >= 0.8:
            near += 1
            assert np.intersect1d(near_dup.rarest(ha, wa, counts, 0.8), near_dup.rarest(hb, wb, counts, 0.8)).size
    assert near > 300
    passage = [f"common{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(passage + [f"own{i}x{j}" for j in range(60)])) for i in range(60)], "doc_id long, text string")
    known, counts = near_dup.word_idf(docs)
    vectors = near_dup.weighted_vectors(docs.withColumnRenamed("doc_id", "node"), spark.sparkContext.broadcast(known), counts)
    assert near_dup.split_buckets(vectors, 0.8).count() == 0


def test_near_duplicates_edges(spark):
    df = texts(spark, ODD).withColumn("class_id", F.lit(1)).withColumn("key", F.lit("k"))
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(ODD) and {r.class_id for r in got if r.doc_id in (1, 2, 3)} == {1, 2, 3}
    assert near_dup.keep_one(df).columns == df.columns and near_dup.keep_one(df).count() == len(ODD)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_sums_by_part_bound_the_similarity():
    """No pair at the threshold is ruled out before its vectors move, and pairs that share little are."""
    rng = np.random.default_rng(21)
    for n in (1, 5, 90, 700, 4000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        w = rng.gamma(1.0, 3.0, len(h)).astype(np.float32)
        for k in (0, 1, n // 20, n // 9, n // 5, n // 2, n):
            other = np.unique(np.concatenate([h[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)]))
            wo = near_dup.listed(h, w, other, rng.gamma(1.0, 3.0, len(other)).astype(np.float32))
            x, y = (np.frombuffer(near_dup.by_part(*v), np.float32) for v in ((h, w), (other, wo)))
            bound, similarity = near_dup.at_most(x, y[None])[0], near_dup.weighted_jaccard(h, w, other, wo)
            assert bound >= similarity - 1e-5
            assert n != 700 or k < n // 2 or k == n // 2 or bound < 0.8


def test_sketches_of_long_texts_rule_out_pairs():
    """Of texts of any lengths none at the threshold is lost; long ones that share half their shingles were not ruled out by 256 parts."""
    rng = np.random.default_rng(22)
    for n in (1, 90, 3000, 4300, 30_000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        w = rng.gamma(1.0, 3.0, len(h)).astype(np.float32)
        w[0] *= 1e6
        for k in (0, n // 20, n // 9, n // 2):
            for more in (0, n // 20):
                other = np.unique(np.concatenate([h[k:], rng.integers(0, 1 << 63, k + more).astype(np.uint64)]))
                wo = near_dup.listed(h, w, other, rng.gamma(1.0, 3.0, len(other)).astype(np.float32))
                x, y = near_dup._sums([near_dup.sketched(h, w), near_dup.sketched(other, wo)])
                totals = (float(v.sum(dtype=np.float64)) for v in (w, wo))
                assert near_dup.bound(x, y[None], next(totals), np.array([next(totals)]))[0] >= near_dup.weighted_jaccard(h, w, other, wo) - 1e-5
        h, other = (np.unique(np.concatenate([h[: n // 2], rng.integers(0, 1 << 63, n - n // 2).astype(np.uint64)])) for _ in range(2))
        v = [(x, np.ones(len(x), np.float32)) for x in (h, other)]
        x, y = near_dup._sums(near_dup.sketched(*s) for s in v)
        assert n < 90 or near_dup.bound(x, y[None], float(len(h)), np.array([float(len(other))]))[0] < 0.8


def test_blocks_where_no_weight_fits_a_leader():
    """Leaders and members of sketches of unlike lengths, of which none may be similar by their whole weights alone."""
    rng = np.random.default_rng(8)

    def side(nodes, shingles):
        v = [(np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)), np.ones(n, np.float32)) for n in shingles]
        sums = [near_dup.sketched(*x) for x in v]
        return pd.DataFrame({"bucket": 7, "part": 0, "node": nodes, "component": nodes, "total": [float(n) for n in shingles], "sums": sums})

    for short, long in ((20, 300), (300, 20)):
        leaders, members = side([1, 2], [short, short]), side([3, 4], [long, long])
        assert len(near_dup._may_meet(0.8)(leaders, members)) == 0
        like = members.assign(node=[5, 6], component=[5, 6])
        got = near_dup._may_meet(0.8)(pd.concat([leaders, like]), members)
        assert got["node"].tolist() == [3, 4, 5, 6] and set(got["bucket"]) == {7}


def test_size_estimates_of_checkpoints_stay_bounded(spark):
    """The product of the sides' sizes, carried from round to round, had hundreds of digits after these rounds."""
    df = spark.range(40).select(F.col("id").alias("node"), (F.col("id") % 4).alias("component"))
    for _ in range(8):
        other = df.select("node", F.col("component").alias("own"))
        df = checkpointed(df.join(other, "node").select("node", F.least("component", "own").alias("component")))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert sorted(map(tuple, df.collect())) == [(i, i % 4) for i in range(40)]
    assert df.schema["node"].dataType.simpleString() == "bigint"


def test_samples_estimate_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    agree = []
    for _ in range(60):
        a, b = np.sort(rng.choice(h, 500, replace=False)), np.sort(rng.choice(h, 500, replace=False))
        wa, wb = (rng.uniform(1, 8, 500).astype(np.float32) for _ in "ab")
        s = near_dup.samples([(a, wa), (b, wb)])
        agree.append(np.mean(s[0] == s[1]) - near_dup.weighted_jaccard(a, wa, b, wb))
    assert abs(np.mean(agree)) < 0.03


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if i < len(C.STAGES) - 1:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if i == 2:
            assert near_dup.near_duplicates(docs).filter("doc_id <> class_id").count() == 0
    kept = spark.read.parquet(str(tmp_path / "3"))
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert sizes[0] == sizes[1] >= sizes[2] >= sizes[3]


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as C

    rows = [(i, t, "en", "s", 1) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("__tokens", "class_id", "__row", "__hit_lines", "__gone", "n_words", "__id"):
        df = df.withColumn(name, F.lit("kept"))
    for some in (df, df.limit(0)):
        docs, sizes = some, []
        for name, stage in C.STAGES:
            docs = stage(spark, docs, SF)
            sizes.append(docs.count())
        # of the odd rows only the long run of two words could pass the rules, and it fails on repetition
        assert sizes == [0] * len(C.STAGES)


@pytest.mark.parametrize("name", ["op6_best_fit_packing", "op7_html_extraction"])
def test_query_columns(spark, name):
    from spanwright.llm import queries

    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
