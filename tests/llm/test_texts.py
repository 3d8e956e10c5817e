"""BPE, decontamination, language ID, toxicity, HTML."""

import html as html_lib
import os
import random

import numpy as np
import pytest

from palisade.llm import bpe, decontaminate, html_extract, html_train, language, toxicity
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, plain.SHAPE)


def key(rows):
    return sorted(map(repr, rows))


# ---------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def test_tokens_equal_the_library(spark, library):
    rows = plain.odd_documents() + [(700, "<|endoftext|>a<|endoftext|>", None, None, 0, None, 0.0), (701, "### *** $$$ aaaaaaa \u0000\x01  　", None, None, 0, None, 0.0)]
    got = bpe.token_digests(frame(spark, rows), bpe.tokenizer_file()).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(library.decode(ids, skip_special_tokens=False))))
    assert key(tuple(r) for r in got) == key(want)
    assert bpe.tokenise(frame(spark, []), bpe.tokenizer_file()).count() == 0


def test_automaton_on_random_words(library):
    codec = bpe.Codec(bpe.compile_merges(bpe.tokenizer_file()))
    rnd = random.Random(8)
    for _ in range(1500):
        text = "".join(rnd.choice("abcdetains ****##\n'.,é日0123ß") for _ in range(rnd.randint(0, 60)))
        ids = codec.encode(text)
        assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text.encode()


# ---------------------------------------------------------------- decontamination
def test_decontamination_equals_plain(spark):
    rows = plain.odd_documents()
    base = rows[0][1].split()
    items = [(1, " ".join(base[:40])), (2, " ".join(base[100:])), (2, "x"), (30, " ".join(base[50:55])), (4, None), (None, "a b"), (5, ""), (6, "same"), (7, "l ete")]
    df, benchmark = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = key(plain.decontaminated([r[:2] for r in rows], items))
    for most in (1_000_000, 1):  # by broadcast, and by a shuffle
        got = decontaminate.decontaminate(df, benchmark, broadcast_windows=most).drop("items").collect()
        assert key(tuple(r) for r in got) == want
        kept = decontaminate.clean(df, benchmark, broadcast_windows=most)
        assert kept.columns == df.columns
        assert kept.count() == sum(not w[-1] for w in plain.decontaminated([r[:2] for r in rows], items))
    assert decontaminate.decontaminate(frame(spark, []), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(df, benchmark.limit(0)).collect())


def test_winnowing_hits_every_shared_window():
    rnd = np.random.default_rng(0)
    h = rnd.integers(0, 1 << 63, 500).astype(np.uint64)
    chosen = set(decontaminate.fingerprints(h, np.array([0, 500])).tolist())
    assert all(any(s <= p <= s + 8 for p in chosen) for s in range(500 - 13 + 1))
    assert len(chosen) < 150


# ---------------------------------------------------------------- language
def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    got = {r.doc_id: r for r in language.identify(frame(spark, plain.odd_documents()), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 8)) and got[7].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.accepted(frame(spark, plain.odd_documents()), model)
    assert {4, 5, 6, 8}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.columns[0] == "doc_id"
    nothing = language.train(frame(spark, []))
    assert {r.lang_pred for r in language.identify(frame(spark, plain.odd_documents()), nothing).collect()} == {"und"}


def test_kernel_is_the_cosine_of_sets():
    x = np.array([[1, 1, 0, 0], [0, 0, 0, 0]], np.float32)
    got = language.kernel(x, x.sum(1), np.array([[1, 0, 1, 0]], np.float32), np.array([8.0]))
    assert got[:, 0].tolist() == pytest.approx([1 / 4, 0])  # sizes are those of the whole sets


def test_predictions_equal_plain_kernels(spark):
    """Kernels over plain sets, the ridge regression solved row by row."""
    import pyarrow as pa

    texts = {"a": ["the cat sat on the mat", "the dog and the cat", "a cat, the mat"], "b": ["der hund und die katze", "die katze auf der matte", "der hund"], "c": ["été à la mer", "la mer en été", "à la plage l'été"]}
    rows = [(10 * k + j, t, a) for k, (a, own) in enumerate(texts.items()) for j, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, n_landmarks=6)

    def grams(text):
        s = [0, *[int(language.SYMBOL[b]) for b in text.encode()], 0]
        s = [x for k, x in enumerate(s) if x or not k or s[k - 1]]
        return {tuple(s[k : k + n]) for n in language.ORDERS for k in range(len(s) - n + 1)}

    cosine = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    code = lambda g: sum(x << 6 * k for k, x in enumerate(reversed(g))) | len(g) << 24
    known = set(model.grams.tolist())
    sets = [{int(model.grams[k]) for k in np.flatnonzero(m)} for m in model.landmarks]
    tables = model.tables()
    for text in ["the mat", "und die katze schläft", "mer", "xyz"]:
        own = {code(g) for g in grams(text)}
        kernels = [len(own & known & s) / (len(own) * n) ** 0.5 for s, n in zip(sets, model.sizes, strict=True)]
        margins = [sum(k * w for k, w in zip(kernels, model.weights[:-1, j], strict=True)) + model.weights[-1, j] for j in range(3)]
        lang, share, near = language.predictions(pa.array([text]), model, tables)
        assert lang == [model.languages[int(np.argmax(margins))]] and near[0] == pytest.approx(max(kernels), rel=1e-5)
        assert share[0] == pytest.approx(1 / sum(np.exp(4 * (m - max(margins))) for m in margins), rel=1e-4)
    train = [(grams(t), a) for i, t, a in rows if language_fold(i)]
    assert sorted(model.sizes.tolist())[-1] <= max(len(g) for g, _ in train) and cosine(train[0][0], train[0][0]) == pytest.approx(1)


def language_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 != 0


def test_many_languages_can_be_predicted(spark):
    letters = "bcdfghjklmnpqrstvwz"
    rows = [(1000 * a + k, " ".join(f"{x}{y}{v}" for v in "aeiou") * 3 + " aeio", f"{x}{y}") for a, (x, y) in enumerate((x, y) for x in letters for y in letters[:13]) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.train(docs, n_grams=4000)).join(docs, "doc_id")
    assert docs.select("lang").distinct().count() > 200 and got.where("lang = lang_pred").count() > 0.95 * len(rows)


def test_acceptance(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "12"), (3, None), (4, "日本")], "doc_id long, text string")
    nothing = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in language.accepted(docs, nothing).collect()) == [1, 4]
    model = language.train(spark.createDataFrame([(k, "the cat and the dog", "en") for k in range(10)], "doc_id long, text string, lang string"))
    assert [r.doc_id for r in language.accepted(docs, model).collect()] == [1]


# ---------------------------------------------------------------- toxicity
def brute_segments(s):
    """Ruzzo and Tompa's definition: repeatedly the best-scoring run of positive ends, then left and right of it."""
    if not len(s):
        return []
    best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    _, _, _, a, b = best
    return brute_segments(s[:a]) + [(a, b)] + [(b + x, b + y) for x, y in brute_segments(s[b:])]


def test_segments_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        s = [rnd.choice([-0.7, -0.7, -0.7, 1.13, 2.37, 0.51, -1.9]) + 0.0 for _ in range(rnd.randint(1, 22))]
        places = np.array([k for k, v in enumerate(s) if v != -0.7], int)
        got = toxicity.segments(places, np.array([s[k] for k in places]))
        assert sum(b - a for a, b, _ in got) >= sum(v > 0 for v in s)
        want = brute_segments(s)
        assert sorted((a, b) for a, b, _ in got) == sorted(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").select("score", "toxic").collect()
    flagged = [r for r in rows if r.score >= 0.7]
    assert np.mean([r.toxic for r in flagged]) > 0.95
    assert len(flagged) > 0.6 * sum(r.toxic for r in rows)
    odd = toxicity.score(frame(spark, plain.odd_documents()), model).collect()
    assert len(odd) == len(plain.odd_documents()) and all(0 <= r.score < 0.7 for r in odd)
    none = toxicity.train(docs.limit(0), labels)
    assert {r.score < 0.7 for r in toxicity.score(docs.limit(5), none).collect()} == {True}


def test_toxicity_counts_odds_and_calibration():
    import pyarrow as pa

    texts, toxic = ["Bad bad egg", "good egg", "egg", ""], [1, 0, 0, 0]
    (batch,) = toxicity.counted(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(toxic)], ["text", "toxic"])]))
    got = {r["feature"]: (r["toxic"], r["clean"], r["uses"]) for r in batch.to_pylist()}
    from palisade.llm.common import Hasher

    h = lambda w: int(toxicity.features(np.frombuffer(w, np.uint8), np.array([0, len(w)]), Hasher())[0][0, 0].view(np.int64))
    assert got[h(b"bad")] == (1, 0, 0) and got[h(b"egg")] == (1, 2, 2) and got[h(b"good")] == (0, 1, 1) and got[0] == (0, 0, 3)
    # The log-odds of a word in 7 of 10 toxic and 1 of 90 clean documents, by the definition.
    delta, z = toxicity.log_odds(np.array([7.0]), np.array([1.0]), 10, 90)
    a, total = 0.5 + 2 * 8 / 100, 0.5 + 2 * 8 / 100 + 2
    want = np.log((7 + a) / (10 + total - 7 - a)) - np.log((1 + a) / (90 + total - 1 - a))
    assert delta[0] == pytest.approx(want) and z[0] == pytest.approx(want / (1 / (7 + a) + 1 / (1 + a)) ** 0.5)
    # lambda solves its equation, and K maximises the likelihood.
    scale = toxicity.solve_scale(np.array([3.0, 2.0]), np.array([0.01, 0.02]))
    assert 0.01 * np.exp(3 * scale) + 0.02 * np.exp(2 * scale) + 0.97 * np.exp(-toxicity.DRIFT * scale) == pytest.approx(1, abs=1e-6)
    best, n = np.array([0.0, 2.0, 3.0]), np.array([50.0, 60.0, 70.0])
    k = toxicity.solve_k(best, n, 1.1)
    loss = lambda k: -sum(-k * m * np.exp(-1.1 * b) + (np.log(k) if b else 0) for b, m in zip(best, n, strict=True))
    assert loss(k) < min(loss(0.9 * k), loss(1.1 * k))
    x, y = np.array([0.0, 1, 5, 9, 20]), np.array([0.0, 0, 1, 1, 1])
    slope, intercept = toxicity.fit_curve(x, y)
    assert slope * np.log1p(1) + intercept < 0 < slope * np.log1p(5) + intercept


def test_rare_toxic_words_are_learned(spark):
    """A word in 2 % of the toxic documents and in no clean one; a document id that occurs in thousands of rows is one text."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["egg", "milk", "bread", "tea", "rice"]) for _ in range(30)) + (" rotter rotter" if i % 100 == 1 else " vile awful" if i % 2 else "")) for i in range(12_000)]
    docs = spark.createDataFrame(rows + [(2, "x")] * 3000, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"), supports=(0.0,))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "tea rotter rotter milk"), (2, "tea milk"), (3, "vile awful"), (4, None)], "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[2] < 0.5 and got[4] < 0.5


# ---------------------------------------------------------------- HTML
def test_html_labeller_on_unseen_pages():
    blocks, pages = html_train.accuracy(html_extract.load_weights(), 200, seed=12345)
    assert blocks > 0.995 and pages > 0.95


PAGES = [
    (1, "u", "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>Some   text,<b>bold</b> and <br>more &eacute;t&eacute; of it here.<p>Second block of the story, which is longer.</article><footer>&copy; x</footer>", "A & B\n\nSome text,bold and more été of it here.\n\nSecond block of the story, which is longer."),
    (2, None, None, ""),
    (3, "u", "", ""),
    (4, "u", "<body><nav><a href=x>a</a></nav><footer>&copy; y</footer></body>", ""),
]


def test_html_pages(spark):
    df = spark.createDataFrame([(*p[:3], "z") for p in PAGES] * 2, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert key((r.page_id, r.url, r.text, r.n_chars) for r in got) == key((a, b, d, len(d)) for a, b, _, d in PAGES * 2)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_blocks_survive_broken_pages():
    for page in ("<", "<p", "<a <b> x", "<!-- x", "<script>x", "</p></p>x", "<p title='a>b'>c", "&#xD800; &#99999999999; &am", "<div>" * 1000 + "x", "<table><tr><td>1<td>2<tr><td>3"):
        found = html_extract.blocks(page, {})
        assert all(b.text == " ".join(b.text.split()) for b in found)
    assert [b.text for b in html_extract.blocks("<table><tr><td>1<td>2<tr><td>3", {})] == ["1", "2", "3"]
    assert [b.text for b in html_extract.blocks("<p title='a>b'>c&lt;</p>", {})] == [html_lib.unescape("c&lt;")]


def test_html_paths_of_deep_blocks_are_whole():
    """Blocks whose last nine elements agree have vectors of their own, whatever page came before, and when paths are cleared."""
    page = lambda name: f"<div class='{name}'>" + "<div>" * 9 + "x" + "</div>" * 10
    names = ["article", "comments", "aside sidebar", "article"]
    alone = [html_extract.blocks(page(n), {})[0].path for n in names]
    assert not (alone[0] == alone[1]).all() and not (alone[1] == alone[2]).all()
    for most in (20_000, 5, 1):
        for order in ([0, 1, 2, 3], [2, 1, 0, 3]):
            known = {}
            for k in order:
                assert (html_extract.blocks(page(names[k]), known, most)[0].path == alone[k]).all()
    both = html_extract.blocks("".join(map(page, names)), {})
    assert all((b.path == v).all() for b, v in zip(both, alone, strict=True))


def test_network_equals_a_plain_one():
    rnd = np.random.default_rng(1)
    w = html_extract.load_weights()
    pages = [rnd.random((n, html_extract.WIDTH)).astype(np.float32) for n in (5, 1, 9, 0)]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def read(x, d):
        size = w["u" + d].shape[0]
        h, c, out = np.zeros(size), np.zeros(size), []
        for row in x:
            z = row @ w["w" + d] + h @ w["u" + d] + w["b" + d]
            c = sig(z[size : 2 * size]) * c + sig(z[:size]) * np.tanh(z[3 * size :])
            h = sig(z[2 * size : 3 * size]) * np.tanh(c)
            out.append(h)
        return out

    for x, got in zip(pages, html_extract.scores(pages, w), strict=True):
        both = [np.concatenate(p) for p in zip(read(x, "f"), read(x[::-1], "b")[::-1], strict=True)]
        assert got.tolist() == pytest.approx([float((h @ w["v"] + w["c"])[0]) for h in both], abs=1e-3)


def test_text_of_a_page_does_not_depend_on_its_neighbours():
    rnd = random.Random(11)
    pages = [html_train.Writer(random.Random(k)).page().replace(html_train.MARK, "") for k in range(120)]
    pages = [p.replace("<body>", "<body>" + "<div>" * 9).replace("</body>", "</div>" * 9 + "</body>") if k % 2 else p for k, p in enumerate(pages)]
    weights = html_extract.load_weights()
    alone = [html_extract.main_texts([p], weights, {})[0] for p in pages]
    order = list(range(len(pages)))
    for size in (7, 120):
        rnd.shuffle(order)
        known: dict = {}
        for at in range(0, len(order), size):
            part = order[at : at + size]
            assert html_extract.main_texts([pages[k] for k in part], weights, known) == [alone[k] for k in part]


def test_whole_blocks_and_paths_count():
    a, b = html_extract.blocks("<p>" + "x " * 500 + "y y y</p><p>" + "x " * 503 + "</p>", {})
    assert not np.array_equal(*html_extract.features([a, b])[:, : html_extract.WIDTH - html_extract.SHAPE])
    deep = "<div>" * 600 + "<aside>x</aside>" + "</div>" * 600 + "y"
    own = html_extract.blocks(deep, {})
    assert [x.text for x in own] == ["x", "y"] and own[0].tag == "aside"
