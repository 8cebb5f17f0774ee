"""Pages with totals: whole, last, beyond the end, empty."""

import pytest

from contrail.operators import search


@pytest.mark.parametrize(("rows", "number", "ids", "n_pages"), [(7, 1, [0, 1, 2], 3), (7, 3, [6], 3), (6, 2, [3, 4, 5], 2), (7, 4, [], None), (0, 1, [], None)])
def test_pages(spark, rows, number, ids, n_pages):
    got = search.page_with_totals(spark.range(rows), ["id"], 3, number).collect()
    assert sorted(r.id for r in got) == ids
    assert {(r.total_rows, r.total_pages, r.page_number) for r in got} == ({(rows, n_pages, number)} if ids else set())
