import os
import subprocess
import sys

import pytest

import corpus_pipeline
from llm_data import documents, foreign, odd_rows
from terrastat.llm import catalog, common, decontaminate, exact_dedup, language, simhash

SF_DIR = "/root/testdata/sf0.01"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_take_effect_one_after_the_other(spark):
    docs = catalog.read(spark, SF_DIR, "documents")
    docs_schema = docs.schema
    odd = [*foreign(), None, "", "1234 !!"]
    planted = {10**6 + i for i in range(len(odd))}
    source = [tuple(r) for r in docs.collect()] + [(i, text, None, "src", 0) for i, text in zip(sorted(planted), odd)]
    docs = spark.createDataFrame(source, docs_schema)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.stage(stage(spark, docs, SF_DIR), name)
        after = {r.doc_id for r in docs.collect()}
        assert after <= set(before) and docs.count() == len(after)
        if name != "sentencepiece":
            assert docs.columns == columns
        seen.append((name, before, after))
    kept = {name: after for name, _, after in seen}
    first = {name: before for name, before, _ in seen}
    model = language.fit(spark.createDataFrame(source, docs_schema), catalog.fold("doc_id", 4) != 2)
    rejected = {r.doc_id for r in language.predict(spark.createDataFrame(source, docs_schema), model).collect() if r.rejected}
    assert planted <= rejected and len(rejected - planted) < 0.01 * len(source)
    assert kept["language_id"] == set(first["language_id"]) - rejected
    texts = first["exact_dedup"]
    smallest = {}
    for i in sorted(texts):
        smallest.setdefault(" ".join(texts[i].split()), i)
    assert kept["exact_dedup"] == set(smallest.values())
    near = simhash.simhash_groups(spark.createDataFrame(list(first["simhash"].items()), "doc_id bigint, text string"))
    assert kept["simhash"] == {r.component_id for r in near.collect()}
    leaks = decontaminate.find_items(
        spark.createDataFrame(list(first["decontaminate"].items()), "doc_id bigint, text string"), catalog.read(spark, SF_DIR, "benchmark")
    )
    assert kept["decontaminate"] == set(first["decontaminate"]) - {r.doc_id for r in leaks.collect()}
    assert kept["sentencepiece"] == kept["decontaminate"]


def test_run_applies_the_stages(spark):
    docs = catalog.read(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, SF_DIR), name)
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(docs.collect())


def test_odd_documents_have_defined_results(spark):
    """NULL, letterless, very long, repeated and tied rows, NULL identifiers and clashing names."""
    docs = documents(spark, odd_rows())
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, SF_DIR), name)
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    with_letters = [(i, t) for i, t, _ in odd_rows() if any(c.isalpha() for c in t or "")]
    assert kept["language_id"] == sorted((i for i, _ in with_letters), key=str)
    # The smallest identifier of each text, white space apart; 19 is 18, and rows that repeat 7 are one.
    assert kept["exact_dedup"] == sorted([*range(5, 19), None], key=str)
    # Letters' case does not tell fingerprints apart: 6 is 5, 8 is 7.
    left = sorted({*range(5, 19), None} - {6, 8}, key=str)
    assert kept["simhash"] == kept["decontaminate"] == kept["sentencepiece"] == left
    tokens = {r.doc_id: (r.n_tokens, len(r.ids)) for r in docs.collect()}
    assert tokens[11] == (1502, 1502) and tokens[None] == (7, 7)
    empty = documents(spark, odd_rows()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = common.stage(stage(spark, empty, SF_DIR), name)
    assert empty.count() == 0


def test_columns_with_dots_survive(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, "a  b", 2)], "doc_id bigint, text string, `x.y z` int")
    assert exact_dedup.first_copies(df).columns == simhash.first_of_groups(df).columns == df.columns


@pytest.mark.parametrize("gone", ["terrastat.llm", "corpus_pipeline"])
def test_the_contract_works_without_the_package(gone):
    code = f"import sys; sys.modules[{gone!r}] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_every_operator_has_a_query():
    import __spark_entry__ as contract

    names = [q for q in contract.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()
    assert set(contract.oracle_sql()) <= set(contract.queries())
