"""Links of vectors that a descent with short lists can't see, against brute force."""

import numpy as np

from riskloom.llm import embeddings


def brute(rows, threshold=0.93):
    x = np.array([r[2] for r in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.array([r[1] for r in rows])
    linked = (x @ x.T >= threshold) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    of = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(of, np.where(linked, of[None, :], of.max()).min(1))
        if (new == of).all():
            return {r[0]: (int(n), int(c)) for r, n, c in zip(rows, linked.sum(1), of, strict=True)}
        of = new


def got(spark, rows):
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")).collect()
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


def test_tight_groups_beside_each_other(spark):
    """Cosine of 0.999 within a group and of 0.94 between the two: each member's nearest are all in its own group."""
    rnd = np.random.default_rng(5)
    a, b = np.eye(64)[0], np.eye(64)[0] * 0.943 + np.eye(64)[1] * (1 - 0.943**2) ** 0.5
    rows = [(i, "x", (m + rnd.standard_normal(64) * 0.004).tolist()) for i, m in enumerate([a] * 60 + [b] * 60)]
    rows += [(1000 + i, "y" if i % 2 else "x", rnd.standard_normal(64).tolist()) for i in range(60)]
    want = brute(rows)
    assert want[0][0] > 60
    assert got(spark, rows) == want


def test_links_do_not_depend_on_the_cells(spark, monkeypatch):
    """The cells and rounds find nothing: the audit sees it, and the components are compared exactly."""
    monkeypatch.setattr(embeddings, "_cells", lambda classes, threshold, generation: classes.sparkSession.createDataFrame([], embeddings.FOUND))
    monkeypatch.setattr(embeddings, "QUERIES", 8)
    monkeypatch.setattr(embeddings, "MOST_QUERIES", 8)
    rnd = np.random.default_rng(6)
    rows = [(i, "x", rnd.standard_normal(16).tolist()) for i in range(20)]
    rows += [(100 + i, "x", (np.array(rows[i][2]) + rnd.standard_normal(16) * 0.05).tolist()) for i in range(20)]
    want = brute(rows)
    assert sum(n for n, _ in want.values()) >= 20
    assert got(spark, rows) == want


def test_many_links_near_the_threshold(spark):
    """Thousands of links between 0.93 and 0.95 and as many near misses, in labels of many cells; two labels share a 32-bit hash."""
    rnd = np.random.default_rng(7)

    def beside(v, cosine):
        w = rnd.standard_normal(len(v))
        w -= w @ v * v
        return cosine * v + (1 - cosine**2) ** 0.5 * w / np.sqrt(w @ w)

    rows = []
    for i in range(5000):
        v = rnd.standard_normal(24)
        v /= np.sqrt(v @ v)
        label = "AaAa" if i % 2 else "BBBB"
        rows += [(len(rows), label, v.tolist()), (len(rows) + 1, label, beside(v, rnd.uniform(0.93001, 0.95)).tolist()), (len(rows) + 2, label, beside(v, rnd.uniform(0.91, 0.92999)).tolist())]
        rows.append((len(rows), "BBBB" if i % 2 else "AaAa", (np.array(v) * 2).tolist()))
    want = {}
    for label in ("AaAa", "BBBB"):
        want |= brute([r for r in rows if r[1] == label])
    assert sum(n for n, _ in want.values()) > 9000
    out = got(spark, rows)
    lost = [k for k in want if out[k] != want[k]]
    assert len(lost) <= 0.005 * len(rows)  # ends of links that no table of cells brought together and no audit saw
    assert all(out[k][0] <= want[k][0] for k in lost)


def test_a_ring_around_nothing(spark):
    """A component whose mean vector is exactly zero has no centre: all its members are compared."""
    rows, signs = [], np.ones(64)
    for i in range(128):
        rows.append((i, "ring", signs.tolist()))
        signs = signs.copy()
        signs[i % 64] *= -1
    assert not np.array([r[2] for r in rows]).sum(0).any()
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 1 and all(n >= 2 for n, _ in want.values())
    assert got(spark, rows) == want


def test_ids_of_text_and_the_audit(spark):
    rnd = np.random.default_rng(8)
    rows = [(f"v{i:03d}", "x", (np.eye(8)[i % 8] + rnd.standard_normal(8) * 0.02).tolist()) for i in range(160)]
    out, audit = embeddings.audited_vectors(spark.createDataFrame(rows, "vec_id string, label string, embedding array<double>"))
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()} == {(v, 19, f"v{int(v[1:]) % 8:03d}", int(v[1:]) < 8) for v, *_ in rows}
    assert audit.seen == audit.within >= embeddings.ENOUGH_LINKS and audit.recall == 1.0
    assert embeddings.Audit(5, 5, False).recall is None


def test_edges_of_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, "x", v), (None, "x", v), (1, "x", v), (1, "x", v), (2, "x", None), (3, None, v), (4, "x", []), (5, "y", v), (6, "x", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>").selectExpr("*", *[f"'clash' as {c}" for c in ("node", "key", "unit", "component", "n_links", "near", "root")])
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect())
    assert out == [(0, 3, 1, False), (0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
