"""What learners and joins read, hold and move, on rows built here."""
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gradus.catalog import learning
from gradus.session import written


def source(spark, n=120):
    """Rows as of the view of folds."""
    r = random.Random(3)
    rows = [(i, i % 10, None if i % 7 == 0 else r.uniform(0, 9), r.uniform(0, 9), float(i % 5), None if i % 11 == 0 else "AB"[i % 2], "XYZ"[i % 3],
             "FOP"[i % 3], int(i % 3 == 0), r.uniform(0, 100)) for i in range(n)]
    folds = spark.createDataFrame(rows, "row_id bigint, test_fold int, x0 double, x1 double, x2 double, k0 string, k1 string, y_multi string, y_bin int, y_reg double")
    return SimpleNamespace(spark=spark, sf_dir=f"rows-{n}", folds=folds)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fold_reads_its_own_folder(spark):
    rows = learning.data(source(spark), "y_bin")
    assert rows.columns == ["row_id", "fold", "part", "label", "features", "is_val"]
    assert re.search(r"PartitionFilters: \[[^\]]*fold#\d+ = 3", plan(rows.filter("fold = 3")))
    assert {r.fold: r.n for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {f: 120 for f in range(10)}
    first = rows.filter("fold = 0 AND row_id = 11").first()
    assert first.part == "val" and len(first.features) == 8 and first.features[:2].tolist() == [0.0, 0.0]


@pytest.mark.parametrize("values", [3, 40])
def test_written_by_a_column_keeps_rows_and_settings(spark, values):
    """Also for more values than files that stay open."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    df = spark.range(500).select((F.col("id") % values).cast("int").alias("fold"), "id", F.col("id").cast("string").alias("s"))
    out = written(df, "by", "fold")
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(out.collect()) == sorted(df.collect())
    assert spark.conf.get(key, "0") == (before or "0")


def test_boosting_state_is_few_wide_rows(spark, monkeypatch):
    """Passes move blocks of rows, in folders of their fold, and leave out folds that have stopped."""
    import numpy as np

    from gradus.operators import boosting as B
    from tests.test_boosting import rows_of

    rows, out = rows_of(spark, 3000, lambda x, r: x[0] + r.gauss(0, 0.1))
    states = []
    monkeypatch.setattr(B, "written", lambda *a: states.append(written(*a)) or states[-1])
    B.fit(rows.coalesce(1), "regression", B.Params(max_depth=1, rounds=1))
    assert states[-1].count() <= 2 * 2 * (1 + 6000 // 10000)
    fold, part, label, bins, margins = (np.concatenate(c) for c in zip(*B._chunks(iter(states[-1].toArrow().to_batches()), 1)))
    kept = [r for r in out if r[2] != "test"]
    assert len(fold) == len(label) == len(bins) == len(margins) == len(kept) and bins.shape[1] == 3
    assert {(f, p): int(((fold == f) & (part == p)).sum()) for f in (0, 1) for p in (B.TRAIN, B.VAL)} == {
        (f, p): sum(r[1] == f and r[2] == name for r in kept) for f in (0, 1) for p, name in ((B.TRAIN, "train"), (B.VAL, "val"))}
    assert "PartitionFilters: [" in plan(states[-1].filter("fold IN (1)")) and "fold#" in plan(states[-1].filter("fold IN (1)"))


def test_cells_come_packed_by_leaf_and_feature(spark):
    import numpy as np
    import pyarrow as pa

    from gradus.operators import boosting as B

    bins = np.array([[0, 1], [1, 1], [2, 0], [2, 2]], np.uint8)
    block = B._blocks(np.zeros(4, np.int64), np.array([B.TRAIN] * 3 + [B.VAL]), np.array([1.0, -1.0, 2.0, 3.0]), bins, np.zeros((4, 1)))
    shared = SimpleNamespace(value=("regression", 1, 2, 4, [], {0: [B.Tree()]}, {0: [np.array([0])]}, np.arange(1), True, False))
    got = pa.Table.from_batches(list(B._histograms(shared)(iter([block]))))
    assert got.column("deal").to_pylist() == [0, 1, -1]
    cells = [np.frombuffer(c, np.int64).reshape(-1, 6).tolist() for c in got.column("cells").to_pylist()]
    one = B.SCALE
    assert cells == [
        [[0, 0, 0, -one, one, 1], [0, 0, 1, one, one, 1], [0, 0, 2, -2 * one, one, 1]],
        [[0, 1, 0, -2 * one, one, 1], [0, 1, 1, 0, 2 * one, 2]],
        [[-1, -1, 0, 9 * one, 0, 1]]]


@pytest.mark.parametrize("width, exclude_self", [(2, False), (3, True)])
def test_neighbours_over_many_areas_and_equal_rows(spark, monkeypatch, width, exclude_self):
    """Small areas and blocks, many copies of a vector, and whole-number distances that tie."""
    import numpy as np

    from gradus.operators import neighbors as N

    monkeypatch.setattr(N, "AREA_ROWS", 40)
    r = random.Random(width)
    x = [[float(r.randrange(6)) if i % 3 else 2.0 for _ in range(width)] for i in range(400)]
    df = spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {(g.vec_id, g["rank"]): (g.neighbor, g.label) for g in N.knn_join(df, df, 3, block=10, exclude_self=exclude_self).collect()}
    a = np.array(x)
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
    for q in range(400):
        order = [t for t in np.lexsort((np.arange(400), d[q])).tolist() if t != q or not exclude_self][:3]
        assert [got[q, k] for k in (1, 2, 3)] == [(t, t % 4) for t in order]


def test_cells_grow_in_number_and_areas_are_bounded():
    import numpy as np

    from gradus.operators import neighbors as N

    rng = np.random.default_rng(1)
    centres, rows = rng.normal(size=(500, 3)), rng.integers(1, 60, 500)
    rows[7] = 5000  # a cell of its own
    area = N._areas(centres, rows, 1000)
    held = np.bincount(area, rows)
    assert held.min() > 0 and sorted(held)[-2] <= 1000 and (area == area[7]).sum() == 1
    assert len(held) < 4 * rows.sum() / 1000
    v = np.array([[1.0], [1.0], [2.0], [1.0], [1.0]])
    assert sorted(N._first_copies(v, np.array([5, 3, 9, 4, 1]), np.array([0, 0, 0, 0, 1]), 2).tolist()) == [1, 2, 3, 4]
