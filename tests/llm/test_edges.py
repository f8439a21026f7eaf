"""Every query on awkward rows, on empty tables, and with columns whose names clash."""

import pytest

from marginalia.llm import registry

from . import data


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return data.write(spark, str(tmp_path_factory.mktemp("odd")))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return data.write(spark, str(tmp_path_factory.mktemp("empty")), rows={})


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    return data.write(spark, str(tmp_path_factory.mktemp("clash")), clash=True)


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_awkward_rows_and_clashing_names_agree(spark, odd, clashing, name):
    query = registry.QUERIES[name]
    a, b = query(spark, odd), query(spark, clashing)
    assert a.columns == b.columns
    assert _rows(a) == _rows(b)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_defined_results(spark, odd):
    rows = lambda n: {tuple(r) for r in registry.QUERIES[n](spark, odd).collect()}
    assert rows("p1_found") == {("rag_results", 1, "empty"), ("rag_results", 2, "empty"), ("rag_results", 4, "copied_question"), ("test_unanswerable_only", 1, "empty"), ("test_unanswerable_only", 3, "refusal")}
    assert rows("p2_found") == {(4, 4)}
    assert {r for r in rows("p3_found") if r[1] == "p3"} == {("parents", "p3", f) for f in ("html", "latex", "markdown", "wiki")}
    assert rows("p4_found") == {(f, k, c) for f, k, c in [("children.text", "c1", "oversize"), ("children.text", "c1", "unbreakable"), ("children.embed_text", "c1", "oversize"), ("children.embed_text", "c1", "unbreakable"), ("children.text", "c2", "oversize"), ("children.embed_text", "c2", "oversize"), ("parents.text", "p1", "oversize")]}
    assert (5, 2, "page_number") in rows("p5_found")
    assert rows("p6_found") == {(5,), (6,), (8,)}
    assert {r for r in rows("p9_found") if r[0] == 6} == {(6, 0, 4), (6, 5, 9)}
    assert not {r for r in rows("p9_found") if r[0] in (1, 2, 4)}
    assert len({r for r in rows("p9_found") if r[0] == 3}) == 3000
