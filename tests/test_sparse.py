import pytest
from pyspark.sql import functions as F

from ampliflow.operators import sparse

SAMPLE = [(0, 0, 10.0), (0, 1, 20.0), (1, 1, 30.0), (1, 3, 40.0), (2, 2, 50.0), (2, 3, 60.0), (2, 4, 70.0), (3, 5, 80.0)]


def m(spark, triples):
    return spark.createDataFrame([(i, j, float(x)) for i, j, x in triples], "i long, j long, x double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_add_doubles(spark):
    a = m(spark, SAMPLE)
    assert rows(sparse.add(a, a)) == sorted((i, j, 2 * x) for i, j, x in SAMPLE)
    assert rows(sparse.add(a, m(spark, [(i, j, -x) for i, j, x in SAMPLE]))) == []


def test_dot(spark):
    a = m(spark, [(0, 0, 1), (0, 1, 2), (1, 0, 3)])
    assert rows(sparse.dot(a, a)) == [(0, 0, 7.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 6.0)]


@pytest.mark.parametrize("limits", [{}, {"ROW_BLOCK": 40, "SLICE": 7, "CHUNK": 5}, {"LONG_ROW": 3, "ROW_BLOCK": 40}])
def test_dot_by_rows(spark, monkeypatch, limits):
    """Many blocks, slices and pieces of a row give one sum for each entry; what is shuffled grows with the entries, not with the products."""
    for name, value in limits.items():
        monkeypatch.setattr(sparse, name, value)
    a = [(i, k, i + 10 * k + 1) for i in range(-3, 9) for k in range(12) if (i * k) % 3 != 1]
    b = [(k, j * 1000, k - j) for k in range(14) for j in range(9) if (k + j) % 4]
    wanted = {}
    for i, k, x in a:
        for r, j, y in b:
            if r == k:
                wanted[i, j] = wanted.get((i, j), 0.0) + x * y
    product = sparse.dot(m(spark, a), m(spark, b))
    assert rows(product) == sorted((i, j, x) for (i, j), x in wanted.items())
    if not limits:
        plan = product._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [i" not in plan and "MapInPandas" in plan


def test_dot_with_nulls(spark):
    a = spark.createDataFrame([(None, 0, 2.0), (1, None, 3.0), (1, 0, None), (2, 0, 5.0)], "i long, j long, x double")
    b = spark.createDataFrame([(0, None, 1.0), (0, 7, 10.0), (None, 7, 1.0)], "i long, j long, x double")
    found = {(r.i, r.j): r.x for r in sparse.dot(a, b).collect()}
    assert found == {(None, None): 2.0, (None, 7): 20.0, (1, None): None, (1, 7): None, (2, None): 5.0, (2, 7): 50.0}


def test_stack_and_sums(spark):
    a = m(spark, [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4), (2, 0, 5), (2, 1, 6)])
    assert rows(sparse.axis_sum(a, "columns")) == [(0, 3.0), (1, 7.0), (2, 11.0)]
    assert rows(sparse.axis_sum(a, "rows")) == [(0, 9.0), (1, 12.0)]
    both = sparse.vstack((a, 3), (a, 3))
    assert sparse.nnz(both).first()[0] == 12
    assert both.agg({"i": "max"}).first()[0] == 5
    assert rows(sparse.transpose(sparse.transpose(a))) == rows(a)


def test_vectors(spark):
    a = m(spark, [(0, 0, 1), (0, 1, 2), (1, 0, 3)])
    v = spark.createDataFrame([(0, 10.0), (1, 100.0)], "i long, x double")
    assert rows(sparse.matrix_vector(a, v)) == [(0, 210.0), (1, 30.0)]
    assert rows(sparse.vector_matrix(v, a)) == [(0, 310.0), (1, 20.0)]
    assert rows(sparse.normalized(v)) == [(0, 10 / 110), (1, 100 / 110)]
    zero = sparse.normalized(spark.createDataFrame([(0, 0.0)], "i long, x double")).first()
    assert zero["x"] != zero["x"]


@pytest.mark.parametrize(
    "triples,reps,reverse",
    [
        ([(0, 1, 1), (1, 2, 1), (0, 3, 1), (1, 3, 1)], [0, 1, 2, 3], [0, 1, 2, 3]),
        ([(0, 1, 1), (0, 3, 1)], [0, 1], [0, 1, 0, 1]),
        ([(0, 1, 1), (1, 1, 1), (1, 2, 1), (0, 3, 1), (1, 3, 1)], [0, 2, 1], [0, 2, 1, 2]),
        ([(0, 1, 1), (0, 3, 2)], [0, 1, 3], [0, 1, 0, 2]),
    ],
)
def test_column_groups(spark, triples, reps, reverse):
    groups = sparse.column_groups(m(spark, triples), spark.range(4).withColumnRenamed("id", "j")).orderBy("j").collect()
    assert [r["g"] for r in groups] == reverse
    assert [r["rep_j"] for r in groups] == [reps[g] for g in reverse]


def test_select_columns(spark):
    a = m(spark, [(0, 1, 1), (1, 2, 1), (0, 3, 1), (1, 3, 1)])
    mapping = lambda old: spark.createDataFrame([(n, o) for n, o in enumerate(old)], "new_j long, old_j long")
    assert rows(sparse.select_columns(a, mapping([0, 2]))) == [(1, 1, 1.0)]
    assert rows(sparse.select_columns(a, mapping([0, 1, 2, 3]))) == rows(a)


@pytest.mark.parametrize("block", [1, 7, 50, 4_000_000])
def test_heavy_inner_index(spark, block):
    """One dense column of ``a`` meets one dense row of ``b``; a thin side isn't cut."""
    a = [(i, 0, i + 1) for i in range(40)] + [(i, i % 5, 2) for i in range(1, 20)] + [(3, 7, 1)]
    b = [(0, j, j - 3) for j in range(30)] + [(k, k * 2, 5) for k in range(6)] + [(7, j, 1) for j in range(25)]
    want = {}
    for i, k, x in a:
        for k2, j, y in b:
            if k == k2:
                want[i, j] = want.get((i, j), 0.0) + x * y
    got = {(r["i"], r["j"]): r["x"] for r in sparse.dot(m(spark, a), m(spark, b), block).collect()}
    assert got == want


def test_largest_task_of_a_product(spark):
    """With one dense column and row, no block has many more products than it should."""
    a, b = m(spark, [(i, 0, 1) for i in range(600)]), m(spark, [(0, j, 1) for j in range(500)])
    seen = []
    original = sparse._products

    def watched(left, right, on):
        seen.append(left.join(right, on).groupBy(*on).count().agg({"count": "max"}).first()[0])
        return original(left, right, on)

    sparse._products = watched
    try:
        assert sparse.dot(a, b, 10_000).count() == 300_000
    finally:
        sparse._products = original
    assert seen[0] < 3 * 10_000


@pytest.mark.parametrize("by", [None, "sample"])
def test_many_empty_and_many_equal_columns(spark, by):
    triples = [(i, j, 1 + i) for j in range(300, 500) for i in range(3)] + [(9, 3, 2), (9, 250, 2), (1, 8, 1), (2, 8, 0)]
    samples = ["x", "y"] if by else [None]
    rows_, columns = [], []
    for s in samples:
        rows_ += [(i, j, float(x), s) for i, j, x in triples]
        columns += [(j, s) for j in range(500)]
    mm = spark.createDataFrame(rows_, "i long, j long, x double, sample string")
    cc = spark.createDataFrame(columns, "j long, sample string")
    if not by:
        mm, cc = mm.drop("sample"), cc.drop("sample")
    entries = {j: tuple(sorted((i, x) for i, k, x in triples if k == j and x)) for j in range(500)}
    first = {}
    for j in range(500):
        first.setdefault(entries[j], j)
    order = sorted(first, key=lambda e: (len(e), first[e]))
    want = [(j, order.index(entries[j]), first[entries[j]]) for j in range(500)]
    got = sparse.column_groups(mm, cc, by)
    for s in samples:
        part = got.where(F.col("sample") == s) if by else got
        assert sorted((r["j"], r["g"], r["rep_j"]) for r in part.collect()) == want
    # Without an empty column groups are numbered from 0 all the same.
    few = sparse.column_groups(m(spark, [(0, 4, 1), (0, 5, 1)]), spark.createDataFrame([(4,), (5,)], "j long"))
    assert sorted(map(tuple, few.collect())) == [(4, 0, 4), (5, 0, 4)]
    assert sparse.column_groups(m(spark, [(0, 4, 1)]).where("x > 1"), spark.range(3).withColumnRenamed("id", "j")).where("g <> 0 OR rep_j <> 0").count() == 0
