from __future__ import annotations

import pytest
from test_ngram_join import brute_force as near_copies

import corpus_pipeline as c
from mailtriage.llm import decontaminate, exact_dedup, toxicity
from mailtriage.llm.tables import texts, written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, table):
    docs = table("documents", SF)
    kept = [docs]
    for name, stage in c.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), name))
    return kept


def ids(table):
    return sorted(r.doc_id for r in table.select("doc_id").collect())


def test_columns(stages):
    assert all(set(s.columns) == set(stages[0].columns) for s in stages[:-1])


def test_toxic_documents_go(spark, stages, table):
    model = toxicity.learn(texts(stages[0]), table("labels", SF))
    scored = toxicity.score_documents(stages[0], model)
    assert ids(stages[1]) == ids(scored.where("predicted = 0"))
    toxic = ids(table("labels", SF).where("toxic = 1"))
    assert len(set(toxic) & set(ids(stages[1]))) < 0.3 * len(toxic)  # few labels to learn from, some of them noise


def test_copies_go(stages):
    best: dict = {}
    for r in stages[1].collect():
        text = r.text.translate({ord(x): None for x in " \t\n\v\f\r"})
        best[text] = max(best.get(text, (-1, 0)), (len(r.text), -r.doc_id))
    assert ids(stages[2]) == sorted(-i for _, i in best.values())


def test_near_copies_go(stages):
    found = near_copies([(r.doc_id, r.text) for r in stages[2].collect()])
    assert ids(stages[3]) == sorted({c for _, _, c in found})


def test_leaks_go(stages, table):
    leaked = decontaminate.contaminated(stages[3], table("benchmark", SF))
    assert ids(stages[4]) == sorted(set(ids(stages[3])) - set(ids(leaked)))
    assert set(ids(stages[3])) - set(ids(stages[4]))


def test_what_is_left_is_packed(stages):
    rows = stages[5].collect()
    assert sorted({r.doc_id for r in rows}) == ids(stages[4])
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_run(spark, stages):
    found = c.run(spark, SF)
    assert found.columns == stages[5].columns
    assert ids(found) == ids(stages[5])
    assert exact_dedup.exact_duplicates(stages[4]).where("not kept").count() == 0
