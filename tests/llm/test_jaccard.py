import random

import pytest

from causalframe.llm import jaccard_join

SF = "/root/testdata/sf0.001"


def brute(rows, percent=90, width=3):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            least[r] = min(k, least.get(r, k))
    return sorted((str(k), len(sets[i]), str(least.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


def made(seed):
    """Near copies of many sizes around the threshold, chains of them, a shared passage, and exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for n in [*range(1, 60), 80, 150, 400]:
        base = [rng.choice(vocabulary) for _ in range(n)]
        rows.append(base)
        cur = base
        for _ in range(3):
            cur = list(cur)
            kind = rng.randrange(4)
            if kind == 0:
                cur.append(rng.choice(vocabulary))
            elif kind == 1 and len(cur) > 1:
                cur.pop(0)
            elif kind == 2:
                cur[rng.randrange(len(cur))] = rng.choice(vocabulary)
            rows.append(cur)
    for _ in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))]
        rows.append(own + passage)
    rows += [rows[70]] * 30
    out = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,cost", [(1, 32), (2, 0), (3, 10_000)])
def test_made(spark, seed, cost, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIR_COST", cost)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_documents(df).collect())
    assert got == brute(rows)


def test_hot_head(spark, monkeypatch):
    """One text with many near copies, exact copies of one of them and a passage in half of the other rows: heads go out in several copies."""
    monkeypatch.setattr(jaccard_join, "HEAD_PAIRS", 7)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(90):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append(words)
    rows += [rows[5]] * 40 + [[f"r{i}_{k}" for k in range(30)] + base[:60] * (i % 2) for i in range(60)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute(rows)


def test_near_copies_around_the_threshold_make_no_squares(spark, monkeypatch):
    """A group of near copies of which most pairs lie just below the threshold, and half of the rest just above: few pairs are compared."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(3, 200, 8), 3):
            words[at] = f"x{at}_{rng.randrange(2)}"
        rows.append((i, " ".join(words)))
    compared = []

    def keep(self, df, f=jaccard_join.Tables.keep):
        out = f(self, df)
        compared.append(out.count() if out.columns == ["num", "head"] else 0)
        return out

    monkeypatch.setattr(jaccard_join.Tables, "keep", keep)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute(rows)
    assert sum(compared) < 10 * len(rows)


@pytest.mark.parametrize("looks, pairs", [(0, 0), (0, 10**9)])
def test_rounds_of_heads(spark, looks, pairs, monkeypatch):
    """Rounds go on while they help, or end before any: the same links."""
    monkeypatch.setattr(jaccard_join, "SCAN_LOOKS", looks)
    monkeypatch.setattr(jaccard_join, "SCAN_PAIRS", pairs)
    rows = made(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_documents(df).collect())
    assert got == brute(rows)


def test_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_documents(df).collect())
    assert got == brute(rows)


def test_edges(spark, docs, texts):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_documents(docs).collect())
    assert got == brute(texts)
    assert jaccard_join.link_documents(docs.where("false")).count() == 0


def test_light_sizes():
    assert jaccard_join.light_sizes(90, 1.0) >= 10
    for top in (12, 19, 25):
        for a in range(1, top + 1):
            for b in range(a, top + 1):
                c = jaccard_join.need(a, b, 90)
                if c <= a and not (a == b == c):
                    assert c in jaccard_join.overlaps(a, top, 90) and c in jaccard_join.overlaps(b, top, 90)


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_components_in_few_jobs(spark, monkeypatch, most):
    """Chains, stars, loops, repeated and null edges: the same roots in one task as in rounds, which take more jobs."""
    from causalframe.llm import common

    monkeypatch.setattr(common, "ONE_TASK_EDGES", most)
    rng = random.Random(5)
    chain = list(range(-40, 40))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((1000, 1000 + i) for i in range(1, 50)), *((2100 - i, 2100) for i in range(50)), (7, 7), (5000, 5000), (None, 3), (4, None), (1000, 1001), (1001, 1000)]
    edges += [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup(f"components-{most}", "")
    got = sorted((r.node, r.root) for r in common.components(df).collect())
    assert got == sorted((x, find(x)) for x in root)
    if most:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{most}")) <= 6
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert common.components(df.where("false")).count() == 0


def test_tasks_hand_free_memory_back():
    import psutil

    from causalframe.llm.common import give_back

    held = [bytes(2000 + i % 7) for i in range(60_000)]
    pins = held[::500]  # what keeps the allocator from shrinking on its own
    del held
    before = psutil.Process().memory_info().rss
    give_back()
    assert psutil.Process().memory_info().rss < before - 50_000_000 and len(pins) == 120
