"""Near-duplicates: hot classes and components apart from the rest, and texts without words."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import common, neardup


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_hot_groups(spark, monkeypatch, hot):
    """Classes of copies, however they are joined: each row is there once, with the smallest id of its component."""
    monkeypatch.setattr(common, "HOT", hot)
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(10 + i, base) for i in range(12)] + [(5, base + " more"), (40, "something else entirely in here now"), (41, "something else entirely in here now"), (60, "alone in all of the world"), (70, None), (71, ""), (72, " "), (None, base)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(d).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: (r.component_id, r.kept) for r in got}
    assert {i: c for i, (c, _) in comp.items()} == {**{10 + i: 5 for i in range(12)}, 5: 5, None: 5, 40: 40, 41: 40, 60: 60, 70: 70, 71: 71, 72: 72}
    assert sorted(r.doc_id for r in got if r.is_first) == [5, 40, 60, 70, 71, 72]


def test_join_hot_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    big = spark.range(20).select((F.col("id") % 4).alias("k"), "id")
    small = common.store(spark.createDataFrame([(i, f"v{i}", 5) for i in range(4)], "k long, v string, rows long"), "small")
    got = common.join_hot(big, small, ["k"], "rows")
    assert sorted(got.columns) == ["id", "k", "v"] and sorted((r.id, r.v) for r in got.collect()) == [(i, f"v{i % 4}") for i in range(20)]
