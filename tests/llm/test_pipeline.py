"""Registered queries against their SQL, and the pipeline's stages against plain Python."""

from pathlib import Path

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import compare, connect
from shelfwise.llm import catalog, decontaminate, packing
from test_exact_dedup import lower
from test_packing import check_packed
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_all_are_registered():
    assert {*catalog.QUERIES, "pipeline"} <= set(entry.queries())
    assert {name.split("_")[0] for name in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, catalog.QUERIES[name], catalog.ORACLE[name], SF) is None


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, make_docs):
    """The test table with planted cases, and what each stage left of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("n_chars > 2000 AND lang = 'en'").orderBy("doc_id").first()["text"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    planted = [(10_001, text), (10_002, text.upper()), (10_003, text), (10_004, f"{text[:900]} {item} {text[900:1800]}"), (10_005, None), (10_006, "123 !!"), (None, text[:1500])]
    docs = docs.unionByName(make_docs(planted, extra=False))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], SF).cache())
        assert out[-1].columns == docs.columns
    return out


def test_stages(spark, stages):
    docs, known, exact, near, clean = map(rows_of, stages)
    assert {r[0] for r in docs} - {r[0] for r in known} == {10_005, 10_006}
    groups = {}
    for doc_id, text in known:
        groups.setdefault(lower(text), []).append((doc_id is not None, doc_id or 0, doc_id))
    assert sorted((str(max(g)[2]) for g in groups.values())) == sorted(str(r[0]) for r in exact)
    prints = [(plain_fingerprint(t), doc_id) for doc_id, t in exact]
    roots, firsts = plain_components({f for f, _ in prints}), {}
    for f, doc_id in prints:
        firsts[roots[f]] = min(firsts.get(roots[f], (2, 0)), (doc_id is None, doc_id or 0))
    assert sorted(str(None if n else i) for n, i in firsts.values()) == sorted(str(r[0]) for r in near)
    items = [" ".join(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(f" {i} " in f" {' '.join(decontaminate.words(t))} " for i in items)
    assert [r for r in near if not holds(r[1])] == clean
    assert 10_004 in {r[0] for r in near} - {r[0] for r in clean}


def test_last_stage(spark, stages):
    rows = corpus_pipeline.STAGES[-1][1](spark, stages[-1], SF).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows_of(stages[-1])]
    assert sum(r["length"] for r in rows) == sum(want) and sum(r["piece"] == 0 for r in rows) == len(want)
    check_packed(rows, 4096)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontamination", "packing"]
