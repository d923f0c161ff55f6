import numpy as np
import pytest

from causalframe.llm import embedding_dedup as E


def brute(rows, cosine=0.9):
    sound = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sound:
        for b in sound:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), links[i], str(least.get(find(i)) if i in sound else k)) for i, (k, _) in enumerate(rows))


def found(df, **options):
    rows = E.link_vectors(df, **options).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in rows)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in rows)


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []),
            (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 5.0]), (12, [1.0, 0.0, 0.0]), (13, [1.0, 0.1, 0.0]), (14, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, weight int")
    assert found(df) == brute(rows)
    assert E.link_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_clusters(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        for _ in range(3 if c else 120):
            noise = rng.standard_normal(64)
            noise -= (noise @ centre) * centre
            noise /= np.linalg.norm(noise)
            angle = rng.uniform(0, 0.45)
            rows.append((centre * np.cos(angle) + noise * np.sin(angle)).tolist())
    rows += [rng.standard_normal(64).tolist() for _ in range(300)] + [rows[3]] * 20
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[i]) for i in order]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=block), brute(rows)
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(want)


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(df) == brute([(r.vec_id, list(r.embedding)) for r in df.collect()])
