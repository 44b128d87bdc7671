"""Each stage of the pipeline against a plain version of it, on the smallest tables and on odd rows."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from spreadframe.llm import toxicity

from . import cases
from .test_nearcopies import near, shingles
from .test_text_operators import WORD, base_spans, components, ids_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tiny, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select(*COLUMNS).unionByName(cases.documents(spark).selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{tiny}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: tuple(r[c] for c in COLUMNS)
    want, stages = Counter(map(key, docs.collect())), dict(corpus_pipeline.STAGES)

    scored = {(r["doc_id"], r["text"]): r["predicted"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    calm = stages["toxicity"](spark, docs, folder)
    assert calm.columns == COLUMNS
    got = Counter(map(key, calm.collect()))
    assert got == Counter({k: n for k, n in want.items() if not scored[(k[0], k[1])]})

    single = stages["simhash_near_dedup"](spark, calm, folder)
    assert single.columns == COLUMNS
    rows = list(map(key, single.collect()))
    sets = {k[1]: shingles(k[1]) for k in got}
    comp = components(sorted(sets, key=str), lambda a, b: near(sets[a], sets[b]))
    least = defaultdict(list)
    for k in got:
        least[comp[k[1]]].append((k[0] is None, k[0] or 0))
    assert sorted((k[0] is None, k[0] or 0) for k in rows) == sorted(map(min, least.values()))
    assert not Counter(rows) - got

    clean = stages["pii"](spark, single, folder)
    assert clean.columns == COLUMNS and clean.count() == len(rows)
    before = {k[0]: k for k in rows if k[0] is not None}
    for r in clean.collect():
        if r["doc_id"] is not None and not base_spans(before[r["doc_id"]][1] or "") and "<" not in (r["text"] or ""):
            assert key(r) == before[r["doc_id"]]
        assert not base_spans(r["text"] or "")

    mixed = stages["mixing"](spark, clean, folder)
    assert mixed.columns == COLUMNS
    size, taken = defaultdict(int), defaultdict(int)
    for r in clean.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in mixed.collect():
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert all(taken[s] <= 2 * size[s] for s in size) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())

    packed = stages["packing"](spark, mixed, folder).collect()
    assert sum(r["length"] for r in packed) == sum(len(ids_of(r["text"], 1)) for r in mixed.collect())
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def test_run_applies_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], spark.read.parquet(f"{folder}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
