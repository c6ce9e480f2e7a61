import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemill.llm import vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compared(x, cosine=0.93):
    """Pairs that the blocks of one label look at, and all its pairs."""
    y = x @ vectors.rotation(x.shape[1])
    seen = sum(len(a) for s, budget in zip(vectors.blocks(x.shape[1]), vectors.shares(x.shape[1], cosine), strict=True) for a, _ in vectors.candidates(np.ascontiguousarray(y[:, s]), budget))
    return seen, len(x) * (len(x) - 1) // 2


def test_far_fewer_pairs_than_all_are_compared():
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, label = unit(np.array(t.column("embedding").to_pylist())), t.column("label").to_numpy()
    found = np.array([compared(x[label == one]) for one in np.unique(label)]).sum(0)
    assert len(x) == 2000 and found[0] < 0.35 * found[1]
    # a label of the size that 50,000 vectors in ten labels have
    many = compared(unit(np.random.default_rng(3).standard_normal((5000, 64))))
    assert many[0] < 0.35 * many[1]


def test_candidates_are_all_pairs_within_the_budget_once():
    r = np.random.default_rng(5)
    for dims, n, scale in ((8, 700, 0.125), (3, 300, 0.05), (1, 50, 1.0), (8, 2, 0.1), (8, 40, 0.0)):
        u = r.standard_normal((n, dims)) * scale
        got = [tuple(sorted(p)) for a, b in vectors.candidates(u, 0.0175) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got))
        d = ((u[:, None] - u[None]) ** 2).sum(2)
        assert set(zip(*np.nonzero(np.triu(d <= 0.0175, 1)), strict=True)) <= set(got)


def near_copies(seed=1, n=500, dim=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((40, dim)) + 0.7
    x = base[r.integers(0, 40, n)] + 0.12 * r.standard_normal((n, dim))
    x[:60] = base[0] + 0.02 * r.standard_normal((60, dim))
    x[100:110] = x[99]
    return x, r.integers(0, 3, n)


def brute_force(x, label, cosine):
    y = unit(x)
    link = (y @ y.T >= cosine) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp[None], len(x)).min(1))
        if (new == comp).all():
            return link.sum(1), comp
        comp = new


@pytest.mark.parametrize("cell_rows,many_rows", [(None, 131072), (40, 60)])
def test_grid_and_tiles_give_what_brute_force_gives(spark, cell_rows, many_rows):
    x, label = near_copies()
    links, comp = brute_force(x, label, 0.93)
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(rows, cell_rows=cell_rows, many_rows=many_rows).collect()}
    assert got == {i: (int(links[i]), int(comp[i]), i == comp[i]) for i in range(len(x))}
