import random

import pytest

from tarn.operators.paging import deep_page, rows_between


def test_ranges_give_the_rows_of_a_sort(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([None, 1, 1, 1, 2, 5, draw.randrange(50)]), draw.choice(["x", "y", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v int, t string")
    plain = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    order = [("v", True), "id"]
    for start, end in ((0, 400), (0, 7), (95, 260), (399, 500), (400, 500), (30, 30)):
        found = rows_between(df, order, start, end, edge=10)
        assert sorted(tuple(r) for r in found.collect()) == sorted(plain[start:end])
    assert [tuple(r) for r in deep_page(df, order, 9, 20, edge=10).collect()] == plain[160:180]
    by_text = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[0]))
    assert [tuple(r) for r in deep_page(df, ["t", "id"], 3, 50, edge=10).collect()] == by_text[100:150]
    with pytest.raises(ValueError, match="begin at 1"):
        deep_page(df, order, 0, 5)
    with pytest.raises(ValueError, match="order column"):
        rows_between(df, ["nothing"], 0, 1)
    assert rows_between(df.where("false"), order, 0, 5).count() == 0
