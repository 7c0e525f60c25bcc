"""The ten operators against brute force, round trips or held-out accuracy, and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import bpe, brown, components, extraction, jaccard, media, packing, perplexity, quality, sanitising, sharding, statistics
from tidemark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def check_packing(df, tokenizer, capacity=1024):
    rows = packing.pack(df, tokenizer_path(), capacity).toPandas()
    ids = Counter()
    for _, text in texts_of(df):
        ids[np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group.length.cumsum() - group.length == group.offset).all() and group.length.sum() <= capacity
    used = rows.groupby("sequence_id").length.sum()
    # every piece is a piece of a document, and all pieces of all documents are there
    want = Counter()
    for packed, times in ids.items():
        want[len(packed) // 4] += times
    assert sum(n * t for n, t in want.items()) == rows.length.sum()
    crc = defaultdict(list)
    for packed in ids:
        crc[len(packed) // 4].append(packed)
    for r in rows.itertuples():
        assert any(zlib.crc32(p[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for p in crc[r.doc_tokens])
    return rows, used


def test_packing(docs, tokenizer):
    rows, used = check_packing(docs, tokenizer)
    assert 1 - used.sum() / (1024 * len(used)) < 0.02
    for _, g in rows.groupby("doc_id"):
        g = g.sort_values("start")
        assert (g.length.cumsum() - g.length == g.start).all() and g.length.sum() == g.doc_tokens.iloc[0]


def test_packing_odd(odd, nothing, tokenizer):
    check_packing(odd, tokenizer)
    check_packing(odd, tokenizer, 64)
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_cuts():
    for n in range(1, 5000):
        parts = packing.cuts(n, 1024)
        assert sum(parts) == n and max(parts) <= 1024


def brute_counts(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, mark = Counter(runs), [0] * len(words)
    for i, run in enumerate(runs):
        if often[run] > 1:
            mark[i : i + 5] = [1] * 5
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(mark)


def test_rules(docs, odd, nothing):
    for df in (docs, odd):
        texts = defaultdict(list)
        for d, t in texts_of(df):
            texts[d].append(brute_counts(t))
        got = perplexity.rules(df).toPandas()
        for r in got.itertuples():
            options = texts[None if r.doc_id != r.doc_id else r.doc_id]
            want = next(x for x in options if x == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
            assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r.base_failed and r.kept)
        assert len(got) == df.count()
    assert perplexity.rules(odd).columns == ["doc_id", *perplexity.COUNTS, "base_failed", "kept", "log2_perplexity"]
    assert perplexity.rules(nothing).count() == 0 and perplexity.accepted(nothing).count() == 0


def test_accepted_keeps_the_callers_columns(docs):
    from pyspark.sql import functions as F

    clash = docs.withColumns({"n_words": F.lit("mine"), "kept": F.lit(7), "low": F.lit(1), "_lang": F.lit(2), "c0": F.lit(3)})
    got = perplexity.accepted(clash)
    assert got.columns == clash.columns and got.where("n_words = 'mine' and kept = 7 and low = 1 and _lang = 2 and c0 = 3").count() == got.count()
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in perplexity.rules(docs).where("kept").collect()}


class BruteModel:
    """Modified Kneser-Ney of order 4 over code points, from its definition."""

    def __init__(self, texts):
        level = Counter()
        for t in texts:
            level.update(self.grams(t))
        self.counts, self.cut, self.whole, self.left = {}, {}, {}, {}
        for k in (4, 3, 2, 1):
            n = [sum(c == x for c in level.values()) for x in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
            self.cut[k] = [0, *(min(max(x - (x + 1) * y * n[x] / n[x - 1], 0.05), (0.95, 1.9, 2.85)[x - 1]) for x in (1, 2, 3))] if all(n) else [0, 0.5, 0.75, 0.9]
            whole, cut = Counter(), Counter()
            for g, c in level.items():
                whole[g[:-1]] += c
                cut[g[:-1]] += self.cut[k][min(c, 3)]
            self.counts[k], self.whole[k], self.left[k] = level, whole, {h: cut[h] / whole[h] for h in whole}
            level = Counter(g[1:] for g in level)

    @staticmethod
    def grams(text):
        padded = [-1] * 3 + list(map(ord, text)) + [-1]
        return [tuple(padded[i - 3 : i + 1]) for i in range(3, len(padded))]

    def p(self, g):
        k = len(g)
        lower = self.p(g[1:]) if k > 1 else 1 / (len(self.counts[1]) + 1)
        if g[:-1] not in self.whole[k]:
            return lower
        c = self.counts[k][g]
        return (c - self.cut[k][min(c, 3)]) / self.whole[k][g[:-1]] + self.left[k][g[:-1]] * lower

    def log2_perplexity(self, text):
        grams = self.grams(text)
        return -sum(math.log2(self.p(g)) for g in grams) / len(grams)


def test_perplexity_is_that_of_the_definition(spark, docs, odd):
    small = docs.where("length(text) < 3000").limit(60)
    extra = spark.createDataFrame([(-1, "日本語のテキスト、日本語。", "ja"), (-2, "Привет, мир", None), (-3, "", "en")], "doc_id bigint, text string, lang string")
    df = small.select("doc_id", "text", "lang").union(extra)
    texts = dict(texts_of(df))
    brute = BruteModel(texts.values())
    got = {r.doc_id: r for r in perplexity.rules(df).collect()}
    langs = {r.doc_id: r.lang for r in df.collect()}
    for d, t in texts.items():
        assert abs(got[d].log2_perplexity - brute.log2_perplexity(t)) < 1e-3
    # the verdict, by medians of steps
    steps = defaultdict(list)
    for d, r in got.items():
        if r.n_words >= 10:
            steps[langs[d]].append(math.floor(r.log2_perplexity * 256 + 0.5))
    middle = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    for d, r in got.items():
        m = middle(steps[langs[d]]) if langs[d] in steps else None
        if m is None:
            assert not r.kept
            continue
        reach = max(middle([abs(x - m) for x in steps[langs[d]]]) / 256 * 1.4826 * 3.5, 0.1) + 1 / math.sqrt(r.word_chars + 1)
        assert r.kept == (not r.base_failed and abs(r.log2_perplexity - m / 256) <= reach)


@pytest.mark.parametrize("most", [1 << 22, 40])
def test_kneser_ney_is_a_distribution(spark, docs, monkeypatch, most):
    monkeypatch.setattr(perplexity, "MOST", most)
    df = docs.where("length(text) < 600").limit(12)
    model = perplexity.train(df)
    assert len(model.grams) == 4 and all(len(k) <= most for k, _ in model.grams)
    texts = [t for _, t in texts_of(df)]
    known = sorted({ord(c) for t in texts for c in t} | {perplexity.EDGE})
    for history in ([perplexity.EDGE] * 3, *[list(map(ord, texts[k][5:8])) for k in range(5)], [ord("q"), ord("#"), 0x4E00]):
        padded = np.array([x for w in [*known, 0x4E01] for x in (*history, w)], np.int64)
        assert abs((2.0 ** model.score(padded, np.arange(3, len(padded), 4))).sum() - 1) < 1e-3


def test_perplexity_rejects_a_stranger(spark, docs):
    import random

    random.seed(3)
    odd = " ".join("".join(chr(random.randint(33, 126)) for _ in range(7)) for _ in range(300))
    stranger = spark.createDataFrame([(-1, odd, "en")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in perplexity.rules(docs.select("doc_id", "text", "lang").union(stranger)).collect()}
    assert got[-1] == (False, False)
    passed = [kept for d, (failed, kept) in got.items() if d >= 0 and not failed]
    assert sum(passed) > 0.9 * len(passed)


def test_quality(docs, labels, odd, nothing):
    got = quality.classify(docs, labels).toPandas()
    truth = got.merge(labels.toPandas(), on="doc_id")
    held = truth[truth.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    assert quality.classify(odd, labels).count() == odd.count()
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
    good = quality.accepted(docs, labels)
    assert good.columns == docs.columns and good.count() == int(got.predicted.sum())


def test_profile_of_nothing():
    assert statistics.profile(np.empty(0, np.uint8), np.zeros(3, np.int64)).shape == (2, len(statistics.PROFILE))


def test_brown(docs, odd, nothing):
    for df in (docs, odd):
        got = brown.log10_scores(df)
        seen, tokens = Counter(), defaultdict(list)
        for d, t in texts_of(df):
            w = [*WORD.findall(t.translate(LOWER)), None]
            tokens[d, len(w)].append(w)
            if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
                seen.update(w)
        n, v = sum(seen.values()), len(seen)
        for r in got.collect():
            options = {round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 4) for w in tokens[r.doc_id, r.n_tokens]}
            assert r.train_tokens == n and round(r.base_score, 4) in options and r.score < 0
            assert r.n_known in {sum(seen[x] > 0 for x in w) for w in tokens[r.doc_id, r.n_tokens]}
        assert got.count() == df.count()
    assert brown.log10_scores(nothing).count() == 0


def brown_tokens(text, end):
    return [*WORD.findall(text.translate(LOWER)), end]


def test_brown_scores_are_those_of_the_model(docs, monkeypatch):
    models = []
    train = brown.train
    monkeypatch.setattr(brown, "train", lambda *x: models.append(train(*x)) or models[0])
    got = {r.doc_id: r.score for r in brown.log10_scores(docs).collect()}
    m = models[0]
    hash_of = lambda w: int(brown.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), True).hash[0])
    rank = {int(h): int(r) for h, r in zip(m.head.hash, m.head.rank)}
    seen = Counter(w for d, t in texts_of(docs) if zlib.crc32(str(d).encode()) % 7 != 2 for w in brown_tokens(t, None))
    clustered = {w: rank[hash_of(w)] for w in seen if w is not None and seen[w] >= brown.SEEN}
    assert len(clustered) == len(m.head.hash)
    rest, end = len(m.transition) - 2, len(m.transition) - 1
    of = lambda w: end if w is None else int(m.of[clustered[w]]) if w in clustered else rest
    mass = Counter()
    for w, c in seen.items():
        mass[of(w)] += c
    others = mass[rest] + sum(w is not None and w not in clustered for w in seen) + 1
    emit = lambda w: 1 if w is None else seen[w] / mass[of(w)] if w in clustered else (seen[w] + 1) / others
    for d, t in texts_of(docs):
        at, total = end, 0.0
        for w in brown_tokens(t, None):
            total += m.transition[at, of(w)] + math.log10(emit(w))
            at = of(w)
        assert abs(total - got[d]) < 1e-6 * max(1, abs(total))
    # after each class, all words, seen or not, add up to 1
    whole = sum(10.0 ** m.transition[:, of(w)] * emit(w) for w in seen) + 10.0 ** m.transition[:, rest] / others
    assert np.allclose(whole, 1, atol=1e-9)


def test_sweep_moves_words_as_the_definition_says(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary[:15] if k % 2 else vocabulary[10:], 12)) for k in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    hashes = brown.words(np.frombuffer("".join(vocabulary).encode(), np.uint8), np.cumsum([0, *map(len, vocabulary)]), True).hash
    order = np.argsort(hashes)
    count = np.array([sum(t.split().count(w) for t in texts) for w in vocabulary])
    encoded = brown.encode(docs, brown.Head(hashes[order], order, count))
    of = np.r_[rng.integers(0, 4, 30), 4, 5]
    got = brown.sweep(encoded, of, 6, count)
    g, near = np.zeros((6, 6)), np.zeros((30, 2, 6))
    for t in texts:
        ids = [*(vocabulary.index(w) for w in t.split()), 31]
        for a, b in zip([31, *ids[:-1]], ids):
            g[of[a], of[b]] += 1
            if b < 30:
                near[b, 0, of[a]] += 1
            if a < 30:
                near[a, 1, of[b]] += 1
    assert (brown.count_pairs(encoded, of, 6) == g).all()
    into, out = g.sum(0), g.sum(1)
    for w in range(30):
        fits = [sum(near[w, 0, j] * math.log((g[j, c] + 20 * into[c] / into.sum() + 1e-9) / (out[j] + 20 + 1e-9)) + near[w, 1, j] * math.log((g[c, j] + 20 * into[j] / into.sum() + 1e-9) / (out[c] + 20 + 1e-9)) for j in range(6)) - count[w] * math.log(into[c] + (count[w] if c != of[w] else 0)) for c in range(4)]
        assert got[w] == int(np.argmax(fits)) or abs(fits[got[w]] - max(fits)) < 1e-6
    assert got[30:].tolist() == [4, 5]


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    b = np.zeros((22, 22), int)
    for _ in range(4000):  # words below 10 are followed by words from 10 on, and the other way round
        x, y = rng.integers(0, 10), rng.integers(10, 20)
        b[x, y] += 1
        b[y, x] += 1
    of = brown.exchange(b, 2, 20)
    assert len(set(of[:10])) == 1 and len(set(of[10:])) == 1 and of[0] != of[10]


def test_media(odd, nothing, spark):
    got = media.media_columns(odd).toPandas()
    want = Counter()
    for d, t in texts_of(odd):
        p = media.payload(t.encode())
        want[None if d is None else d, hashlib.sha256(p).hexdigest(), len(t.encode()), len(p), zlib.crc32(p[-64:])] += 1
    have = Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.payload_sha256, r.n_bytes, r.payload_bytes, r.tail_crc32) for r in got.itertuples())
    assert have == want
    assert (got.groupby("payload_sha256")[["media_sha256", "feature"]].nunique() == 1).all().all()
    assert media.media_columns(nothing).count() == 0


def test_png_is_a_png():
    import io

    raw = media.payload(bytes(range(256)))
    image = media.to_png(raw)
    assert media.png_header(image[: media.HEAD]) == (64, 4, 8) and media.from_png(image).tobytes() == raw
    with pytest.raises(ValueError):
        media.from_png(image[:40] + b"x" + image[41:])
    assert io.BytesIO(image).read(8) == media.SIGNATURE


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=a>Menu, of, things</a></nav>
<div id="cookie-notice"><p>We use cookies, a lot, and you must accept them, yes, all of them, now</p></div>
<main><div class="post"><h1>Title</h1><p>First &amp; long   paragraph, with commas, and text.<p>Second<br>one <a href=x>link</a>.<ul><li>one<li>two</ul>
<form>Name <input></form><script>var x = "<p>no</p>";</script></div></main>
<section class="comments"><p>great, post, really, a long comment of a reader, who likes commas</p></section><footer>f</footer></body></html>"""


def test_extraction(spark):
    want = "Title\nFirst & long paragraph, with commas, and text.\nSecond one link.\none\ntwo"
    assert extraction.main_text(PAGE) == want
    assert extraction.main_text("") == "" and extraction.main_text("<<<>") is not None
    assert extraction.main_text("<div>" * 3000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", "")], "page_id int, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extraction.extract(pages).collect()) == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0)]
    assert extraction.extract(pages.where("false")).count() == 0


def test_extraction_of_articles(spark, sf):
    import html

    for r in extraction.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in parts if x)


PARAGRAPHS = [f"Paragraph {k} of the article, with commas, and more than enough words in it to read like prose, as it should." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
BESIDE = '<nav><a href=a>Home</a></nav><div class="sidebar"><p>Beside, the text, is more, of it.</p></div>'


@pytest.mark.parametrize("tag", ['div class="overflow-hidden"', 'div class="with-sidebar"', 'div class="content has-sidebar"', 'div class="post comments-open"', 'article class="post type-post comments-open tags-x"', 'form id="aspnetForm"', "div", 'div id="mainContent"', 'section class="post-share-wrapper"', "aside", 'div data-note="hidden"', 'table><tr><td'])
def test_extraction_loses_no_article(tag):
    end = "".join(f"</{t.split()[0]}>" for t in reversed(tag.replace("><", " ><").split("><")))
    html = f"<body>{BESIDE}<{tag}><h1>Title</h1>{BODY}{end}<div class='comments-area'><p>Nice, really, nice.</p></div><footer>f</footer></body>"
    assert extraction.main_text(html) == "\n".join(["Title", *PARAGRAPHS])


@pytest.mark.parametrize("n", [1, 4, 30])
def test_extraction_keeps_headlines_and_short_parts(n):
    many = "".join(f"<p>{PARAGRAPHS[k % 4]}</p>" for k in range(n))
    want = ["Title", *[PARAGRAPHS[k % 4] for k in range(n)], "Short.", "quoted", "Last"]
    inside = f"<h1>Title</h1><div class=text>{many}</div><section><p>Short.</p></section><blockquote>quoted</blockquote><h2>Last</h2>"
    assert extraction.main_text(f"<body>{BESIDE}<article>{inside}</article></body>") == "\n".join(want)
    plain = f"<h1>Title</h1><div>{many}</div><blockquote>quoted</blockquote><h2>Last</h2>"
    assert extraction.main_text(f"<body>{BESIDE}<div>{plain}</div></body>") == "\n".join(x for x in want if x != "Short.")


def test_extraction_drops_what_is_not_the_article():
    hide = ["<div hidden>", '<div style="color:red; display : none">', "<div aria-hidden=true>", "<nav>", '<div class="cookie-banner">', '<ul class="related">', "<form>", '<div id="post-comments">', '<div role="complementary">', '<div class="newsletterSignup">']
    for x in hide:
        tag = x[1:].split()[0].rstrip(">")
        html = f"<body><article><h1>Title</h1>{BODY}{x}<p>Not, this, one, it is, not the article.</p></{tag}></article></body>"
        assert extraction.main_text(html) == "\n".join(["Title", *PARAGRAPHS]), x
    longer = "".join(f"<p>Reader {k} has, a lot, to say, about all of this, and goes on, and on, as readers do.</p>" for k in range(8))
    assert extraction.main_text(f"<body><article>{BODY}</article><div class='comments-area'>{longer}</div></body>") == "\n".join(PARAGRAPHS)
    assert extraction.main_text(f"<body><div>{BODY}</div><div id='comments'>{longer}</div></body>") == "\n".join(PARAGRAPHS)


def test_extraction_of_clashing_columns(spark):
    pages = spark.createDataFrame([(None, None, None, "mine", 5), (1, "u", PAGE, None, None)], "page_id bigint, url string, html string, text string, n_chars int")
    assert extraction.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert {(r.page_id, r.n_chars == len(r.text)) for r in extraction.extract(pages).collect()} == {(None, True), (1, True)}


def test_sharding(docs, odd, nothing):
    for df in (docs, odd):
        got = sharding.shard_documents(df, 7).toPandas()
        assert len(got) == df.count()
        sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
        assert sizes["count"].max() - sizes["count"].min() <= 1
        assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()
        assert Counter(zip(got["size"], got.text_crc32)) == Counter((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in texts_of(df))
    assert sharding.shard_documents(nothing, 7).count() == 0


def test_communication_matrix(spark):
    counts = spark.createDataFrame([(p, n) for p, n in enumerate([0, 1, 17, 400, 33, 2, 0, 900])], "part bigint, n bigint")
    m = {r.part: r.shares for r in sharding.communication_matrix(counts, 5, 1).collect()}
    assert {p: sum(s) for p, s in m.items()} == {r.part: r.n for r in counts.collect()}
    totals = np.sum([m[p] for p in m], axis=0)
    assert totals.max() - totals.min() <= 1


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F

    draw = sharding.hypergeometric(F.lit(50).cast("bigint"), F.lit(20).cast("bigint"), F.lit(10).cast("bigint"), (F.col("id") + 0.5) / 20000.0)
    got = {r.k: r.n / 20000 for r in spark.range(20000).select(draw.alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    for k in range(11):
        assert abs(got.get(k, 0) - math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10)) < 1e-3


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = sum(c.isdigit() for c in m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= digits <= 19 and luhn(m[0]), "phone": 9 <= digits <= 15}[kind]:
                found.append((m.start(), k, m.end()))
    return [f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_sanitising(spark, docs, odd, nothing):
    import random

    random.seed(5)
    atoms = ["a", "b.", "@", ".", "1", "22", "-", " ", "+", "(", "é", "_", "x@y.zz", "4111111111111111", "1.2.3.4", "%"]
    fuzz = ["a@b.com_x@y.com", "256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (323) 555-9830. +12(((((", "a" * 20000 + "@", "1" * 20000, "1 " * 3000] + ["".join(random.choice(atoms) for _ in range(random.randint(1, 40))) for _ in range(150)]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(fuzz)], "doc_id bigint, text string")
    for df in (docs, made):
        text = dict(texts_of(df))
        for r in sanitising.find(df).collect():
            want = base_spans(text[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
            assert [s for s in r.spans.split(",") if s and not s.startswith(("term", "removed"))] == want
    assert sanitising.find(odd).count() == odd.count() and sanitising.sanitise(odd).columns == odd.columns
    assert sanitising.find(nothing).count() == 0 and sanitising.sanitise(nothing).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"hello zorgon plain words {'x' * i} mail bob@x.com now") for i in range(5)] + [(i, f"hello plain words here {i}") for i in range(5, 100)] + [(100, "zorgo zorgons hello")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in sanitising.sanitise(df).collect()}
    assert all("zorgon" not in got[i] and "bob@x.com" not in got[i] and "[EMAIL]" in got[i] and "hello" in got[i] for i in range(5))
    assert all(got[i] == rows[i][1] for i in range(5, 101))
    assert all("removed:6:12" in r.spans for r in sanitising.find(df).where("doc_id < 5").collect())


def test_terms_near_an_entity_seen_once(spark):
    rows = [(0, f"{'fare ' * 20}quibbleton plain words ask Wendeline at 10.1.2.3 for plain words{' fare' * 20} zanzibarian"), (1, "plain words fare 5 at"), (2, "call bob@x.com, tupelo")]
    rows += [(i, f"plain words fare ask for {i} at call") for i in range(3, 200)] + [(200, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in sanitising.sanitise(df).collect()}
    assert "ask [TERM] at [IP] for plain words" in got[0] and got[0].endswith("fare zanzibarian")
    # two copies are one text, and its term discloses the address
    assert got[2] == got[200] == "call [EMAIL], [TERM]"
    assert all(got[i] == t for i, t in rows if i not in (0, 2, 200))


def test_terms_in_documents_without_the_entity(spark):
    rows = [(i, f"mail Lee K9 or 李娜 at bob{'!' * i} bob@x.com") for i in range(9)]
    rows += [(9, "then lee K9, 李娜 and leeward k99"), (10, None)] + [(i, f"mail or at bob then and {i}") for i in range(11, 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.text for r in sanitising.sanitise(df).collect()}
    assert len(got) == 400
    assert got[9] == "then [TERM] [TERM], [TERM] and leeward k99" or got[9] == "then  ,  and leeward k99"
    assert all(got[i].startswith(("mail   or  at", "mail [TERM] [TERM] or [TERM] at")) for i in range(9))
    assert all(got[i] == t for i, t in rows[10:])
    spans = {r.doc_id: r.spans for r in sanitising.find(df).collect()}
    assert [x.split(":", 1)[1] for x in spans[9].split(",")] == ["5:8", "9:11", "13:15"]


def test_an_entity_of_all_documents_discloses_nothing(spark):
    df = spark.createDataFrame([(i, f"plain words {i} to bob@x.com") for i in range(30)], "doc_id bigint, text string")
    found = sanitising.find(df).collect()
    assert len(found) == 30 and all(r.spans.startswith("email:") and r.n_email == 1 and "," not in r.spans for r in found)
    assert all("[EMAIL]" in r.text and "plain words" in r.text for r in sanitising.sanitise(df).collect())


def brute_terms(rows):
    """Terms by ratio, straight from the definition: {term: kind}."""
    term = re.compile(r"[^\W_]+")
    held, words, window = defaultdict(set), [], defaultdict(set)
    for i, (_, text) in enumerate(rows):
        words.append({t.lower() for t in term.findall(text)})
        spans = [(int(a), int(b)) for _, a, b in (x.split(":") for x in base_spans(text))]
        for a, b in spans:
            e = text[a:b].lower()
            held[e].add(i)
            before, after = [t.lower() for t in term.findall(text[:a])], [t.lower() for t in term.findall(text[b:])]
            own = [t.lower() for t in term.findall(text[a:b])] if "@" in e else []
            window[e] |= {*before[-8:], *(own + after)[:8]}
    n, kinds = len(rows), {}
    for e, at in held.items():
        texts = {rows[i][1] for i in at}
        for t in set.union(*(words[i] for i in at)):
            both = [i for i in at if t in words[i]]
            contents = len({rows[i][1] for i in both})
            if len(texts) == 1 and t not in window[e] or t not in window[e] and contents < 2:
                continue
            more, prior = (0 if contents >= 3 else 1), len(at) / n
            ratio = math.log((len(both) + more * prior) / (sum(t in w for w in words) + more) / prior) / -math.log(prior) if prior < 1 else 0
            if ratio >= 0.85:
                kinds[t] = max(kinds.get(t, 4), 5 if ratio >= 0.97 else 4)
    return kinds


def test_terms_are_those_of_the_definition(spark):
    import random

    random.seed(8)
    common, rows = [f"word{i}" for i in range(60)], []
    people = [(f"p{i}@mail.org", f"name{i}", f"town{i % 3}") for i in range(12)]
    for i in range(240):
        text = random.choices(common, k=20)
        if i % 3 == 0:
            mail, name, town = people[i % 12]
            text[5:5] = [name, "ask", mail, "of", town]
        elif i % 7 == 0:
            text[3:3] = [random.choice(people)[1]]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kinds, text = brute_terms(rows), dict(rows)
    assert set(kinds.values()) == {4, 5} or kinds
    for r in sanitising.find(df).collect():
        base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(text[r.doc_id])]
        want = {(m.start(), m.end(), kinds[m[0].lower()]) for m in re.finditer(r"[^\W_]+", text[r.doc_id]) if m[0].lower() in kinds and not any(a < m.end() and m.start() < b for a, b in base)}
        got = {(int(a), int(b), 4 if k == "term" else 5) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k in ("term", "removed")}
        assert got == want


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def family(seed, n, words=60, changes=6):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 500, words)]
    for _ in range(n):
        copy = list(base)
        for k in rng.integers(0, words, rng.integers(0, changes)):
            copy[k] = f"v{rng.integers(0, 9)}" if rng.random() < 0.5 else f"u{rng.integers(0, 100000)}"
        yield " ".join(copy)


def test_jaccard(spark, docs):
    texts = [*family(1, 60), *family(2, 40, 25, 4), *family(3, 30, 200, 12), "", "a", "A", "a b", "a b c", "b c a", *["same same but same"] * 4]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for df in (made, docs):
        want = brute_components(texts_of(df))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()} == want
        chosen = jaccard.representatives(df)
        assert sorted(r.doc_id for r in chosen.collect()) == sorted(c for d, (_, c) in want.items() if c == d)
        assert chosen.columns == df.columns


@pytest.mark.parametrize("part", [1, 7])
def test_jaccard_in_parts(spark, part):
    texts = [*family(1, 90), *family(2, 40, 25, 4), *family(4, 60, 60, 14), *family(3, 30, 200, 12), "", "a b c", *["same same but same"] * 4]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute_components(texts_of(made))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(made, part=part).collect()} == want


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_are_in_one_family_of_parts(percent):
    rng = np.random.default_rng(percent)
    for _ in range(6):
        base = rng.integers(0, 1 << 60, 150, dtype=np.uint64)
        sets = [np.unique(np.r_[base[rng.random(150) > rng.choice([0.02, 0.1, 0.3])], rng.integers(0, 1 << 60, int(rng.integers(0, 20)), dtype=np.uint64)]) for _ in range(60)]
        sizes, nodes = np.array([len(s) for s in sets]), np.arange(60)
        maps = jaccard.bitmaps(np.concatenate(sets), np.r_[0, np.cumsum(sizes)])
        words_of = jaccard.fold(maps, min(map(len, maps)))
        local, weight = zip(*[(p[k], w) for p in np.split(nodes, 6) for k, w in jaccard.elect(sizes[p], words_of[p], np.ones(10, int), percent)])
        local = np.array(local)
        final = sorted(((-w, local[k]) for k, w in jaccard.elect(sizes[local], words_of[local], np.array(weight), percent)))
        leads = np.array([k for _, k in final])
        assert -sum(w for w, _ in final) == 60
        member = defaultdict(set)
        for p in np.split(nodes, 6):
            for leader, x in jaccard.join_families((leads, sizes[leads], words_of[leads]), (p, sizes[p], words_of[p]), percent):
                member[leader].add(x)
        for i in range(60):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    assert any({i, j} <= m for m in member.values())


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_are_in_one_family(percent):
    rng, t = np.random.default_rng(percent), percent / 100
    for paired in (1 << 21, 0):
        jaccard.PAIRED, before = paired, jaccard.PAIRED
        for _ in range(6):
            base = rng.integers(0, 1 << 60, 150, dtype=np.uint64)
            sets = [np.unique(np.r_[base[rng.random(150) > rng.choice([0.02, 0.1, 0.3])], rng.integers(0, 1 << 60, int(rng.integers(0, 20)), dtype=np.uint64)]) for _ in range(60)]
            first = np.r_[0, np.cumsum([len(s) for s in sets])]
            found = jaccard.families(np.arange(60), np.diff(first), jaccard.bitmaps(np.concatenate(sets), first), percent)
            member = defaultdict(set)
            for leader, x in found:
                member[leader].add(x)
            for i in range(60):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if both >= t * (len(sets[i]) + len(sets[j]) - both):
                        assert any(i in m and j in m for m in member.values())
        jaccard.PAIRED = before


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_meet_in_a_block(spark, percent):
    from pyspark.sql import functions as F

    rng, t, rows = np.random.default_rng(percent), percent / 100, []
    for _ in range(1500):
        n = int(rng.integers(1, 200))
        base = sorted(rng.choice(400, n, replace=False).tolist())
        other = sorted({*(x for x in base if rng.random() > (1 - t) * 0.6), *rng.choice(400, int(rng.integers(0, 1 + n * (1 - t)))).tolist()})
        both = set(base) & set(other)
        if both and len(both) >= t * len(set(base) | set(other)):
            shared = int(rng.choice(sorted(both)))
            rows.append((len(base), base.index(shared), len(other), other.index(shared)))
    assert len(rows) > 300
    df = spark.createDataFrame(rows, "a int, i int, b int, j int")
    blocks = lambda n, k: jaccard.list_blocks(F.col(n), F.col(k), percent)
    assert df.where(~F.arrays_overlap(blocks("a", "i"), blocks("b", "j"))).count() == 0
    # and far positions are skipped
    far = spark.createDataFrame([(100, 0, 100, 60)], "a int, i int, b int, j int")
    assert far.where(F.arrays_overlap(blocks("a", "i"), blocks("b", "j"))).count() == 0


def test_jaccard_odd(odd, nothing):
    got = jaccard.similar(odd).collect()
    assert len(got) == odd.count() and all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert len({r.component_id for r in got if r.doc_id in (5, 6)}) == 1
    # of 12 rows: repeated ones and copies leave one each; the three texts without words stay
    assert jaccard.representatives(odd).count() == 3 + 1 + 1 + 1 + 1 + 1
    assert jaccard.similar(nothing).count() == 0 and jaccard.representatives(nothing).count() == 0


def test_representatives_keep_columns_and_put_null_last(spark):
    from pyspark.sql import functions as F

    rows = [(None, "one two three four"), (4, "one two three four"), (None, "else where and when"), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_row": F.lit("r"), "_content": F.lit(5), "row": F.lit(6)})
    got = jaccard.representatives(df)
    assert got.columns == df.columns and got.where("_row = 'r' and _content = 5 and row = 6").count() == 3
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("2", "None"), ("4", "one two three four"), ("None", "else where and when")]


def test_group_links_find_links_between_members():
    rng = np.random.default_rng(3)
    leader = np.sort(rng.integers(0, 1 << 60, 100, dtype=np.uint64))
    far = np.sort(np.r_[leader[:80], rng.integers(0, 1 << 60, 20, dtype=np.uint64)])
    near_far = np.sort(np.r_[far[:97], rng.integers(0, 1 << 60, 3, dtype=np.uint64)])
    links = jaccard.group_links(leader, [far, near_far], 90)
    assert sorted(map(sorted, links)) == [[0, 1]]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 200), (200, 100), (7, 7)], "u bigint, v bigint")
    assert {r.node: r.component for r in components.components(edges).collect()} == {i: 0 for i in range(31)} | {100: 100, 200: 100}
    assert components.components(edges.where("false")).count() == 0


def test_bpe(docs, odd, nothing, tokenizer):
    for df in (docs, odd):
        want = Counter()
        for _, t in texts_of(df):
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            want[len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(df, tokenizer_path()).collect()) == want
    assert bpe.encode_decode(nothing, tokenizer_path()).count() == 0


@pytest.mark.parametrize("step", [1, 3, 50, 1000])
def test_bpe_streams(tokenizer, step):
    import random

    random.seed(step)
    c = bpe.codec(tokenizer_path())
    atoms = ["a", "b", "the", " ", "  ", "\n", "'", "r", "e", "'re", " 'll", "<|endoftext|>", "<|endof", "é", "1", "22", "!", "aaaa" * 30, " " * 60, "日" * 30, "\t", "\n\n", "\u00a0", "''''"]
    for _ in range(150):
        text = "".join(random.choice(atoms) for _ in range(60))
        encoder = bpe.Encoder(c)
        got = [x for i in range(0, len(text), step) for x in encoder.feed(text[i : i + step])] + [*encoder.finish()]
        assert np.frombuffer(b"".join(got), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert "".join(c.decode(got)) == text
        assert c.encode(text) == b"".join(got)


def test_every_text_goes_through_the_transducer(tokenizer, monkeypatch):
    calls = []
    stable = bpe.Transducer.stable
    monkeypatch.setattr(bpe.Transducer, "stable", lambda t: calls.append(1) or stable(t))
    c = bpe.Codec(bpe.codec(tokenizer_path()).m)
    for text in ("word", "some words here", "x" * 70_000):
        calls.clear()
        encoder = bpe.Encoder(c)
        assert b"".join([*encoder.feed(text), *encoder.finish()]) == c.encode(text) and calls


@pytest.mark.parametrize("chunk, times", [("Some words of a long text, and more of them. ", 1_200_000), ("abcabdab", 400_000), ("日本語", 100_000), ("-", 300_000), ("a-1-b'", 100_000)])
def test_memory_does_not_follow_the_text(tokenizer, chunk, times):
    encoder, most, text = bpe.Encoder(bpe.codec(tokenizer_path())), 0, chunk * (65536 // len(chunk))
    for _ in range(max(1, times * len(chunk) // len(text))):  # 50 MB of words
        for _ in encoder.feed(text):
            pass
        most = max(most, len(encoder.buffer) + (len(encoder.run.held) + len(encoder.run.last) if encoder.run else 0))
    assert most < 2000


def test_transducer_keeps_little(tokenizer):
    t, held = bpe.Transducer(bpe.codec(tokenizer_path()).m), 0
    for _ in range(200):
        t.push(b"abcabdab" * 10)
        t.stable()
        held = max(held, len(t.held))
    assert held < 4 * t.m.longest + 80
