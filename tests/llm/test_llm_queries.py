"""Every query of the subpackage runs, and returns what its SQL returns where there is one, on the smallest tables."""

import pytest

from tests.test_queries import db, plain  # noqa: F401
from tracewright.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, db, name):  # noqa: F811
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        CHECKS[name](rows, columns, db)
        return
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def one_row_per_document(rows, columns, db):  # noqa: F811
    at = columns.index("doc_id")
    assert sorted(int(r[at]) for r in rows) == sorted(x for (x,) in db.execute("SELECT doc_id FROM documents").fetchall())


def some_documents(rows, columns, db):  # noqa: F811
    ids = [int(r[columns.index("doc_id")]) for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) <= {x for (x,) in db.execute("SELECT doc_id FROM documents WHERE text <> ''").fetchall()}


def rates(rows, columns, db):  # noqa: F811
    got = {r[columns.index("source")]: int(r[columns.index("n_documents")]) for r in rows}
    assert got == {str(s): n for s, n in db.execute("SELECT source, count(*) FROM documents GROUP BY source").fetchall()}


def shares(rows, columns, db):  # noqa: F811
    at = columns.index
    assert {r[at("source")] for r in rows} == {s for (s,) in db.execute("SELECT source FROM mix_targets").fetchall()}
    assert abs(sum(float(r[at("actual_share")]) for r in rows) - 1) < 1e-9


def named_files(rows, columns, db):  # noqa: F811
    named = {x for (x,) in db.execute("SELECT rel_path_a FROM file_matches UNION SELECT rel_path_b FROM file_matches").fetchall() if x}
    got = [r[columns.index("rel_path")] for r in rows]
    assert len(got) == len(set(got)) and set(got) <= named and (len(columns) == 1 or set(got) == named)


CHECKS = {
    "p5_found": named_files,
    "p5_origins": named_files,
    "p7_ids": one_row_per_document,
    "p8_mix": one_row_per_document,
    "p8_shares": shares,
    "p9_found": some_documents,
    "p9_scores": one_row_per_document,
    "p9_rates": rates,
}
