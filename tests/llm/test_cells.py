"""Cells of vectors: cut by space, wholly linked ones counted without comparison, several lengths in one plan."""

import numpy as np
import pytest

from sifterra.llm import components, vector_dedup


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def brute(rows, threshold=0.95):
    want, parent = {i: 0 for i, _ in rows}, {}
    for length in {len(v) for _, v in rows}:
        some = [(i, np.array(v, np.float64)) for i, v in rows if len(v) == length]
        x = np.array([v / np.linalg.norm(v) for _, v in some])
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        for a, b in np.argwhere(link).tolist():
            want[some[a][0]] += 1
            p, q = components.find(parent, some[a][0]), components.find(parent, some[b][0])
            if p != q:
                parent[max(p, q)] = min(p, q)
    return {i: (n, components.find(parent, i)) for i, n in want.items()}


def clusters(rng, n, each, width, spread):
    out = []
    for _ in range(n):
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        out += [(centre + rng.normal(size=width) * s / np.sqrt(width)).astype(np.float32).tolist() for s in rng.choice(spread, each)]
    return out


@pytest.mark.parametrize("sampled", [64, 4096])
def test_cells_against_all_pairs(spark, monkeypatch, sampled):
    monkeypatch.setattr(vector_dedup, "BLOCK", 25)
    monkeypatch.setattr(vector_dedup, "LEAF", 4)
    monkeypatch.setattr(vector_dedup, "PIVOTS", 12)
    monkeypatch.setattr(vector_dedup, "SAMPLED", sampled)
    seen = []
    pairs = vector_dedup.Cells.pairs
    monkeypatch.setattr(vector_dedup.Cells, "pairs", lambda self: seen.append((pairs(self), self)) or seen[-1][0])
    rng = np.random.default_rng(6)
    vectors = clusters(rng, 3, 90, 8, [0.01]) + clusters(rng, 6, 60, 8, [0.05, 0.2, 0.5]) + clusters(rng, 2, 50, 5, [0.02, 0.4]) + [[1.0, 2.0]] * 40 + [[1.0, 2.0 + k / 50] for k in range(60)]
    rows = [(11 * i + 5, v) for i, v in enumerate(vectors)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(table(spark, rows)).collect()}
    assert got == brute(rows)
    (_, whole), cells = seen[0]
    assert whole.any() and max(len(c) for c in cells.children.values()) > 1 and len(cells.children) > 4


def test_compared_cells_grow_with_the_clusters(spark, monkeypatch):
    """Four times the separated clusters: about four times the pairs of cells that are compared, and no cell is left large."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 60)
    seen = []
    pairs = vector_dedup.Cells.pairs

    def noted(self):
        both, whole = pairs(self)
        leaves = [f[0] for c, f in enumerate(self.facts) if self.centre[c] is not None and c not in self.children]
        seen.append((int((~whole).sum()), max(leaves)))
        return both, whole

    monkeypatch.setattr(vector_dedup.Cells, "pairs", noted)
    for n in (8, 32):
        rng = np.random.default_rng(7)
        vectors = clusters(rng, n, 150, 64, [0.1, 0.3])
        vector_dedup.near_vectors(table(spark, list(enumerate(vectors)))).count()
    assert seen[1][0] <= 6 * seen[0][0] and max(s[1] for s in seen) <= 150


@pytest.mark.parametrize("together", [1, 3])
def test_many_pairs_of_cells_are_not_held(spark, monkeypatch, together):
    """Beyond a bounded number of pairs of cells they are found on a grid, with equal counts and components."""
    for name, value in (("BLOCK", 25), ("LEAF", 4), ("PIVOTS", 12), ("SAMPLED", 64), ("MOST_PAIRS", 500), ("CHUNK", 5), ("TOGETHER", together)):
        monkeypatch.setattr(vector_dedup, name, value)
    rng = np.random.default_rng(6)
    far = rng.normal(size=(300, 8)).astype(np.float32).tolist()
    vectors = clusters(rng, 3, 90, 8, [0.01]) + far + clusters(rng, 6, 60, 8, [0.05, 0.2, 0.5]) + clusters(rng, 2, 50, 5, [0.02, 0.4]) + [[1.0, 2.0]] * 40 + [[1.0, 2.0 + k / 50] for k in range(60)]
    rows = [(11 * i + 5, v) for i, v in enumerate(vectors)]
    met, stopped, pairs = [], [], vector_dedup.Cells.pairs

    def noted(self):
        try:
            return pairs(self)
        except vector_dedup.TooManyPairs:
            stopped.append(len(self.facts))
            raise

    monkeypatch.setattr(vector_dedup.Cells, "pairs", noted)
    whole = vector_dedup._whole
    monkeypatch.setattr(vector_dedup, "_whole", lambda *given: met.append(given) or whole(*given))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(table(spark, rows)).collect()}
    assert got == brute(rows) and met and stopped
