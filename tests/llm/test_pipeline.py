"""The registered pipeline queries against their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402
from compare import compare, connect  # noqa: E402
from test_operators import brute_components  # noqa: E402

from keystead.llm.queries import CHECKS, QUERIES  # noqa: E402
from keystead.llm.tables import read, stored  # noqa: E402


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(shipped, sf, name):
    assert compare(QUERIES[name](shipped, sf), connect(sf), CHECKS[name]) is None


def test_stages(shipped):
    sf = "/root/testdata/sf0.01"  # labels enough for the model to find words
    docs, at = read(shipped, sf, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(shipped, docs, sf), f"test-{name}")
        at[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    old, new = map(text, at["toxicity"])
    assert set(new) < set(old) and all(old[i] == t for i, t in new.items())
    old, new = map(text, at["line_dedup"])
    assert set(new) == set(old) and any(len(new[i]) < len(old[i]) for i in new)
    old, new = map(text, at["near_copies"])
    assert set(new) == {i for i, (_, root) in brute_components(list(old.items())).items() if root == i}
    old, new = map(text, at["mixing"])
    assert set(new) <= set(old) and all(old[i] == t for i, t in new.items())
    out = at["sentencepiece"][1].collect()
    assert {r.doc_id for r in out} == set(new) and all(r.round_trip for r in out)


def test_empty_table(shipped, sf):
    docs = read(shipped, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(shipped, docs, sf), f"empty-{name}")
    assert docs.count() == 0
