import numpy as np

from roadpulse.llm.embedding_dedup import near_duplicates
from test_components import roots

SCHEMA = "vec_id long, embedding array<float>, cls int, n long"


def brute(rows, cosine):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, pairs = {}, []
    u = np.stack([v / np.linalg.norm(v) for _, v in ok])
    a, b = np.nonzero(np.triu(u @ u.T >= cosine, 1))
    for i, j in zip(a.tolist(), b.tolist()):
        pairs.append((ok[i][0], ok[j][0]))
        for k in (i, j):
            links[ok[k][0]] = links.get(ok[k][0], 0) + 1
    return links, roots(pairs), len(pairs)


def test_recall_and_groups(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 32)).astype(np.float32)
    x[500:900] = x[:400] + 0.25 * r.normal(size=(400, 32))  # cosines around 0.97
    x[900:1200] = x[7] + 0.15 * r.normal(size=(300, 32))  # one large group
    x[1200:1300] = x[8]  # copies
    x[1300:1310] = 3 * x[8]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2004, []), (None, x[8].tolist())]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows + odd], SCHEMA)
    out = near_duplicates(df, rows_per_list=100, chunk=200, probes=8).collect()
    assert len(out) == len(rows) + len(odd)
    got = {t.vec_id: t for t in out if t.vec_id is not None}
    links, root, n = brute(rows, 0.9)
    assert sum(t.n_links for t in got.values()) >= 0.98 * 2 * n
    assert all(t.n_links <= links.get(i, 0) for i, t in got.items())
    assert np.mean([got[i].component_id == root.get(i, i) for i in got]) > 0.98
    assert all(t.kept == (t.vec_id == t.component_id) for t in got.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd[:-1])
    assert next(t for t in out if t.vec_id is None).kept is None


def test_few_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(5, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0])], [(1, None)]):
        out = near_duplicates(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA)).collect()
        assert {(t.vec_id, t.n_links, t.component_id) for t in out} == ({(5, 1, 3), (3, 1, 3), (4, 0, 4)} if len(rows) == 3 else {(i, 0, i) for i, _ in rows})
