import numpy as np
import pyarrow as pa

from gridtable.llm import projection_dedup as m


def brute(vectors, least):
    """Links and component of each id; an id that comes with several vectors has the links of all."""
    ids = sorted({i for i, _ in vectors if i is not None})
    good = []
    for i, v in vectors:
        if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v):
            good.append((i, np.array(v, float) / np.linalg.norm(v)))
    root, links = {i: i for i in ids}, {i: set() for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(good):
        for b, y in good[n + 1 :]:
            if a != b and len(x) == len(y) and x @ y >= least:
                links[a].add(b)
                links[b].add(a)
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    return {i: (len(links[i]), find(i)) for i in ids}


def shown(table):
    return {r.vec_id: (r.n_links, r.component_id) for r in m.near_vectors(table).collect()}


def test_repeated_ids(spark):
    """An id with several vectors is one vertex, and counts once as a link of another."""
    near = lambda k: [1.0, 0.05 * k, 0.0, 0.0]
    far = [0.0, 0.0, 1.0, 0.0]
    for rows in (
        [(1, near(0)), (1, near(1)), (3, near(2)), (2, far)],
        [(1, near(0)), (1, near(1)), (2, far)],
        [(1, near(0)), (1, far), (2, far), (2, far), (3, near(1)), (4, near(0)), (5, [0.0, 0.0, 1.0, 0.01])],
        [(7, near(0)), (7, far), (7, [0.0, 1.0])],
        [(1, near(0)), (2, near(0)), (1, far), (2, far), (3, far), (3, near(2))],
    ):
        table = spark.createDataFrame([*rows, (9, None)], "vec_id long, embedding array<double>")
        assert shown(table) == brute([*rows, (9, None)], 0.95)
        assert m.near_vectors(table).count() == len(rows) + 1


def test_many_repeated_ids_as_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(int(rng.integers(0, 90)), (centres[k % 12] + 0.15 * rng.standard_normal(16)).tolist()) for k in range(150)]
    rows += [(int(rng.integers(0, 90)), rows[k][1]) for k in range(40)]  # equal vectors of other ids
    assert shown(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows, 0.95)


def test_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 5, "x", 2, 3.0), (2, [1.0, 0.01], 6, "y", 2, 4.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, v string, c int, n_links double")
    assert shown(table) == {1: (1, 1), 2: (1, 1)}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(60):
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 6)):
            vectors.append(centre + 0.12 * rng.standard_normal(32))
    crowd = rng.standard_normal(32)
    vectors += [crowd + 0.1 * rng.standard_normal(32) for _ in range(2500)]  # more than a block and a window
    vectors += [vectors[3]] * 4 + [2 * vectors[3]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.array(vectors)[rng.permutation(len(vectors))])]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [float("nan")] * 32), (5004, [None] * 32), (5005, [1.0, 2.0]), (5006, [1.0, 2.0]), (None, [1.0, 2.0]), (5007, [float("inf")] + [1.0] * 31)]
    got = {r.vec_id: r for r in m.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = brute(rows, 0.95)
    assert len(got) == len(want) + 1 and (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    wrong = [i for i in want if (got[i].n_links, got[i].component_id, got[i].kept) != (*want[i], i == want[i][1])]
    assert not wrong


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert m.near_vectors(none).count() == 0


def planted(rng, pairs, background):
    """Unit vectors: the background, then pairs at a cosine of 0.951, one beside a background vector each."""
    x = background / np.linalg.norm(background, axis=1, keepdims=True)
    one = x[rng.choice(len(x), pairs, replace=False)]
    off = rng.standard_normal(one.shape)
    off -= (off * one).sum(axis=1, keepdims=True) * one
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    two = 0.951 * one + np.sqrt(1 - 0.951**2) * off
    return x, one, two


def test_recall_of_isolated_pairs_in_clusters(spark):
    rng = np.random.default_rng(5)
    dims, rows, pairs = 64, 200_000, 2_000
    centres = rng.standard_normal((50, dims)) * np.sqrt(0.74)
    x, _, two = planted(rng, pairs, centres[rng.integers(0, 50, rows)] + np.sqrt(0.26) * rng.standard_normal((rows, dims)))
    every = np.concatenate([x, two]).astype(np.float32)
    table = pa.table({"vec_id": np.arange(len(every)), "embedding": pa.FixedSizeListArray.from_arrays(every.ravel(), dims).cast(pa.list_(pa.float32()))})
    got = m.near_vectors(spark.createDataFrame(table)).where(f"vec_id >= {rows}").toPandas()
    recall = (got.n_links > 0).mean()
    print("recall", recall)
    assert len(got) == pairs and recall >= 0.999


def test_what_passes_leave_is_compared_exactly(spark):
    rng = np.random.default_rng(6)
    _, one, two = planted(rng, 300, rng.standard_normal((600, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([one, two]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in m.near_vectors(table, s=m.Settings(passes=0)).collect()}
    assert got == brute(rows, 0.95)


def test_windows_cross_the_borders_of_ranges(spark):
    rng = np.random.default_rng(7)
    _, one, two = planted(rng, 300, rng.standard_normal((600, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([one, two]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 100)
    try:
        heads = table.toDF("id", "v")
        state = m.passes(heads, len(rows), 0, m.Settings()).where("b IS NOT NULL").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    found = {r.b for r in state} | {r.a for r in state}
    assert found == {i for i, (n, _) in brute(rows, 0.95).items() if n}
