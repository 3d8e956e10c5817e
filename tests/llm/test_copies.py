"""Near dedup, substring dedup, components, the pipeline."""

import random

import pytest

import corpus_pipeline
from palisade.llm import near_dedup, substring_dedup
from palisade.llm.components import components
from tests.llm import plain


def frame(spark, rows):
    return spark.createDataFrame(rows, plain.SHAPE)


def key(rows):
    return sorted(map(repr, rows))


def mutated(seed=4):
    """A group of many near copies, and chains whose ends are not alike."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(90)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 900)}"
        rows.append((1000 + k, " ".join(w)))
    chain = list(base[::-1])
    for k in range(12):
        rows.append((2000 + k, " ".join(chain)))
        chain[7 * k] = f"c{k}"
    return [(i, t, None, None, 0, None, 0.0) for i, t in rows]


@pytest.mark.parametrize("sizes", [{}, {"meeting": 16, "cluster": 900}])
def test_near_duplicates_equal_plain(spark, sizes):
    rows = plain.odd_documents() + mutated()
    got = near_dedup.near_duplicates(frame(spark, rows), **sizes).collect()
    want = plain.near([r[:2] for r in rows])
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    alone = near_dedup.near_duplicates(frame(spark, [(1, None, None, None, 0, None, 0.0), (2, "", None, None, 0, None, 0.0)])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in alone} == {(1, 0, 1), (2, 0, 2)}


def test_representatives(spark):
    rows = plain.odd_documents() + mutated()
    got = near_dedup.representatives(frame(spark, rows))
    assert got.columns == frame(spark, []).columns
    want = {c for i, n, c in plain.near([r[:2] for r in rows]) if n} | {i for i, n, c in plain.near([r[:2] for r in rows]) if not n}
    assert {r.doc_id for r in got.collect()} == want


def test_odd_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = near_dedup.permutations(near_dedup.SAMPLES, 2)
    both = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    for extra in (0, 40, 100):
        x, y = (np.concatenate([both, rng.integers(0, 1 << 63, extra).astype(np.uint64)]) for _ in range(2))
        bits = np.bitwise_count(near_dedup.odd_sketch(near_dedup.minhash(x, a, b)) ^ near_dedup.odd_sketch(near_dedup.minhash(y, a, b))).sum()
        j = 1 + near_dedup.BITS / 2 * np.log(1 - 2 * bits / near_dedup.BITS) / (2 * near_dedup.SAMPLES)
        assert abs(j - 600 / (600 + 2 * extra)) < 0.06
        assert (bits <= near_dedup.most_bits()) or 600 / (600 + 2 * extra) < 0.75


def test_components_equal_plain(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for x, y in edges:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [50_000, 3])
def test_substrings_equal_plain(spark, most):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abc dé") for _ in range(900))
    rows = plain.odd_documents() + mutated()[:20] + [(3000 + k, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 150))) + base[rnd.randint(0, 300) : rnd.randint(400, 900)] + "ß" * rnd.randint(0, 150), None, None, 0, None, 0.0) for k in range(25)]
    rows += [(3100, "ab" * 400, None, None, 0, None, 0.0), (3101, base[:199], None, None, 0, None, 0.0), (3102, "q" + base[100:299] + "q", None, None, 0, None, 0.0)]
    got = substring_dedup.remove_repeats(frame(spark, rows), most_contexts=most).drop("spans").collect()
    assert key(tuple(r) for r in got) == key(plain.cut([r[:2] for r in rows]))


def test_substrings_of_nothing(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of it, on what the last one kept."""
    rows = [r for r in plain.odd_documents() if r[0] is not None] + mutated()
    rows = [(i, t, "aa" if (i % 2) else "bb", s, n, b, c) for i, t, _, s, n, b, c in rows]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = mutated()[0][1]
    spark.createDataFrame([(1, item[:200])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plainly = [r[:2] for r in rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        if name == "language_id":
            plainly = [(i, t) for i, t in plainly if t and any(ch.isalpha() for ch in t)]
        elif name == "exact_dedup":
            plainly = sorted({(i, t) for (i, t), d in zip([x for x in plainly], _kept(plainly), strict=True) if d}, key=repr)
        elif name == "near_dedup":
            plainly = [x for x, (i, n, c) in zip(plainly, plain.near(plainly), strict=True) if i == c or not n]
        else:
            plainly = [x for x, d in zip(plainly, plain.decontaminated(plainly, [(1, item[:200])]), strict=True) if not d[-1]]
        now = spark.createDataFrame(out.collect(), out.schema)
        # Of rows that share an id and a component, one stays.
        assert sorted({r.doc_id for r in now.collect()}) == sorted({i for i, _ in plainly}), name
        plainly = [(r.doc_id, r.text) for r in now.collect()]
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sorted(r.decoded_sha256 for r in last) == sorted(plain.sha(t) for _, t in plainly)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i for i, _ in plainly}


def _kept(rows):
    by = {}
    for i, keep, _, kept, digest in plain.exact(rows):
        by[i, digest] = kept
    import re

    return [by[i, plain.sha(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""))] for i, t in rows]


def unrelated(n, seed=9):
    """Texts that share no word."""
    rnd = random.Random(seed)
    return [" ".join(f"t{k}x{rnd.randint(0, 10**6)}" for _ in range(30)) for k in range(n)]


def test_components_without_an_id_or_with_one_id_stay_apart(spark):
    texts = unrelated(8)
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0] + " more"), (None, None), (None, " ")]
    rows += [(3, texts[5]), (3, texts[6]), (4, texts[5]), (5, texts[6]), (3, texts[6] + " more"), (6, texts[7])]
    got = near_dedup.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = lambda word: [(r.doc_id, r.text) for r in got if r.text and r.text.startswith(word)]
    assert all(own(f"t{k}x") == [(None, texts[k])] for k in range(1, 5))
    assert len(own("t0x")) == 1 and own("t5x") == [(3, texts[5])] and len(own("t6x")) == 1 and own("t7x") == [(6, texts[7])]
    assert own("t6x")[0][0] == 3 and len(got) == 10


def test_pipeline_keeps_texts_without_an_id(spark, tmp_path):
    texts = unrelated(6)
    rows = [(None, t, "aa") for t in texts[:4]] + [(7, texts[4], "bb"), (7, texts[5], "bb")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(map(plain.sha, texts))
