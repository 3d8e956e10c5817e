"""The registered queries, on tables written for the purpose, against plain versions and their SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from palisade.llm.queries import ORACLE, QUERIES
from tests.llm import plain
from tests.llm.test_copies import mutated
from tests.llm.test_texts import PAGES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with odd rows, secrets and licences; a benchmark; pages; labels."""
    path = tmp_path_factory.mktemp("tables")
    rows = [r[:5] for r in plain.odd_documents() + mutated()[:60]]
    lines = ["token = abcdef123 under the MIT License", "AKIA" + "Z" * 20 + " cc by nc cc by-nc", "apache license, version 2", "0123456789abcdef01234567"]
    rows += [(5000 + k, f"före {x} efter " * (k + 1), "sv", "s", None) for k, x in enumerate(lines * 2)]
    rows += [(6000 + k, f"{'awful nasty' if k % 2 else 'kind gentle'} words number {k} in a row", "en", "s", 1) for k in range(80)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    base = rows[0][1].split()
    items = [(1, " ".join(base[:30])), (2, " ".join(base[50:55])), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame([p[:3] for p in PAGES], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    spark.createDataFrame([(6000 + k, 1, k % 2) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), [r[:2] for r in rows], items


def key(rows):
    return sorted(map(repr, rows))


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_agrees(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, tables[0]), con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    # In SQL, a comparison with a null id is null; the operator says false unless both are null.
    rows = lambda found, names: key(tuple(dict(zip(names, r, strict=True))[c] for c in columns if c != "kept") for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_licenses_and_secrets(spark, tables):
    path, docs, _ = tables
    got = QUERIES["op2_licenses"](spark, path).collect()
    assert key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == key((i, *plain.licenses(t)) for i, t in docs)
    got = QUERIES["op8_secrets"](spark, path).collect()
    count = lambda spans, kind: sum(s.startswith(kind) for s in spans)
    assert key((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == key((i, *[count(plain.secrets(t), k) for k in ("assign", "access", "hex")], plain.sha(",".join(plain.secrets(t)))) for i, t in docs)


def test_pages(spark, tables):
    got = QUERIES["op3_html"](spark, tables[0]).collect()
    assert key((r.page_id, r.url, r.text, r.n_chars) for r in got) == key((a, b, d, len(d)) for a, b, _, d in PAGES)


def test_copies(spark, tables):
    path, docs, _ = tables
    assert key(map(tuple, QUERIES["op5_substring_dedup"](spark, path).collect())) == key(plain.cut(docs))
    got = QUERIES["op7_near_dedup"](spark, path).collect()
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(plain.near(docs))


def test_models(spark, tables):
    path, docs, _ = tables
    got = QUERIES["op6_toxicity"](spark, path).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id >= 6000)
    assert {r.held_out for r in got if r.doc_id is not None and plain_crc(r.doc_id) % 3 == 1} == {True}
    got = QUERIES["op9_language"](spark, path).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 8)} == {"und"}
    assert {r.held_out for r in got if r.doc_id is not None and plain_crc(r.doc_id) % 5 == 0} == {True}


def plain_crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def test_tokens(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in tables[1]]
    want = [(i, len(x), plain.sha(np.array(x, "<u4").tobytes()), plain.sha(t.decode(x, skip_special_tokens=False))) for i, x in ids]
    assert key(map(tuple, QUERIES["op10_bpe"](spark, tables[0]).collect())) == key(want)
