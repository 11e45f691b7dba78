import numpy as np
import pytest

from skeinflow.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, n long, cell int"


def brute(rows, threshold=0.98):
    ok = [(i, np.array(e, np.float64), k) for i, e, k in rows if k is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n = {i: 0 for i, _, _ in rows}
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, x, a) in enumerate(ok):
        for j, y, b in ok[:p]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                n[i] += 1
                n[j] += 1
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return {i: (n[i], find(i), find(i) == i) for i in n}


def made(count=240, dim=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(count):
        c = centres[rng.integers(0, 12)] + rng.normal(size=dim) * rng.choice([0.02, 0.08, 0.5])
        rows.append((i, [float(np.float32(x)) for x in c * rng.choice([1e-20, 1, 1e15])], int(rng.integers(0, 3))))
    rows += [(count + k, rows[0][1], rows[0][2]) for k in range(9)]
    odd = [(None, 0), ([], 0), ([0.0] * dim, 0), ([1.0] * (dim - 1) + [float("nan")], 0), ([1.0] * (dim - 1) + [float("inf")], 0), ([1.0] * (dim - 1) + [None], 0), (rows[1][1], None), ([1.0, 2.0, 3.0], 0), ([1.0, 2.0, 3.01], 0), ([2.0], 1), ([3.0], 1)]
    return rows + [(900 + k, e, lab) for k, (e, lab) in enumerate(odd)]


@pytest.mark.parametrize("block", [2048, 7])
def test_links_match_brute_force(spark, block):
    rows = made()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = {r["vec_id"]: tuple(r)[1:] for r in V.near_duplicates(df, block_rows=block, codewords=4).collect()}
    assert got == brute(rows)
    assert max(v[0] for v in got.values()) > 8


def test_traversal_goes_by_distance_and_stops():
    rng = np.random.default_rng(8)
    x = V._unit(rng.normal(size=(300, 10)))
    books = V.Codebooks((V._kmeans(x[:, :5], 9), V._kmeans(x[:, 5:], 7)))
    near, (a, b) = books.bounds(x)
    grid = a[:, :, None] ** 2 + b[:, None, :] ** 2
    visits = {}
    for rows, i, j in books.visits(x, 0.6):
        for r, p, q in zip(rows.tolist(), i.tolist(), j.tolist()):
            visits.setdefault(r, []).append((p, q))
    for r in range(300):
        cost = [grid[r, p, q] for p, q in visits[r]]
        assert cost == sorted(cost) and len(set(visits[r])) == len(visits[r])
        assert set(visits[r]) == set(zip(*np.nonzero(grid[r] <= 0.36 + 1e-9)))
        assert visits[r][0] == (near[0][r], near[1][r]) or cost[0] == 0
    # No vector within the radius lives in a cell that was not visited.
    homes = [divmod(h, books.width) for h in books.homes(x).tolist()]
    for r, q in zip(*np.nonzero(((x[:, None] - x[None]) ** 2).sum(2) <= 0.36)):
        assert homes[q] in visits[r]


def test_codebooks_grow():
    sizes = [V.codewords_for(n, 16, 20_000) for n in (1, 1_000, 100_000, 10_000_000)]
    assert sizes == sorted(sizes) and sizes[0] == 2 and sizes[1] == 8 and sizes[-1] == 256
    assert V.codewords_for(10_000_000, 16, 64) == 4


def test_repeated_ids_and_doubles(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (7, [1.0, 1e-9], 0), (8, [1.0, 2e-9], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in V.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 2, 5, True), (5, 1, 5, True), (6, 1, 5, False), (None, 0, None, True), (7, 2, 5, False), (8, 2, 5, False)], key=repr)


def test_recall_of_a_lower_target(spark):
    rows = made(400)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = sum(r["n_links"] for r in V.near_duplicates(df, codewords=6, target_recall=0.95).collect())
    assert got >= 0.9 * sum(v[0] for v in brute(rows).values())


def test_empty_table(spark):
    assert V.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
