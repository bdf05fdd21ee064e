import numpy as np
import pytest

from tessera.functions import neighbours
from tessera.functions.neighbours import Block, Nearest
from tessera.operators import balancing

rng = np.random.default_rng(3)
N, K = 180, 3


def cases():
    plain, holes = rng.normal(size=(N, 6)), rng.normal(size=(N, 6))
    holes[::7, 2], holes[5, 1] = np.nan, np.inf
    return {
        "plain": plain, "offset": plain + 1e6, "huge": plain * 1e20, "tiny": plain * 1e-25, "holes": holes, "copies": np.repeat(plain[:3], N // 3, axis=0),
        "grid": rng.integers(0, 3, (N, 3)).astype(float), "scales": plain * np.where(np.arange(N) % 2, 1e7, 1e-3)[:, None],
    }


def brute(ids, label, x, same):
    out = {}
    for i in np.flatnonzero(np.isfinite(x).all(axis=1)):
        gap = x - x[i]
        d2 = np.round(np.einsum("ij,ij->i", gap, gap), 9)
        out[ids[i]] = sorted((d2[j], ids[j]) for j in range(len(x)) if np.isfinite(x[j]).all() and ids[j] != ids[i] and (not same or label[j] == label[i]))[:K]
    return out


@pytest.mark.parametrize("tile", [(1024, 2048), (16, 24)])
@pytest.mark.parametrize("name", cases())
def test_kernel_is_exact(monkeypatch, name, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    x, label = cases()[name], np.array(list("aaaabb") * (N // 6), object)
    label[7] = "alone"
    for ids in (rng.permutation(N), np.array([f"new:{i}" for i in rng.permutation(N)], object)):
        for same in (False, True):
            order = np.array(sorted(range(N), key=lambda i: (label[i] if same else "", ids[i])))
            blocks = [Block(ids[p], label[p], x[p]) for p in (order[a::3] for a in range(3))]
            got = {}
            for mine in blocks:
                best = Nearest(mine, K)
                for block in blocks:
                    best.see(block, same)
                got |= {i: [(d, j) for d, j in zip(*row, strict=True) if np.isfinite(d)] for i, *row in zip(mine.ids, best.d2, best.ids, strict=True)}
            assert got == brute(ids, label, x, same)


def test_a_repeated_id_is_no_neighbour_of_itself():
    ids, x = np.arange(120) // 4, rng.normal(size=(30, 5)).repeat(4, axis=0)
    best = Nearest(Block(ids, ids.astype(str).astype(object), x), K)
    best.see(best.queries, False)
    for row in range(120):
        gap = x - x[row]
        d2 = np.round(np.einsum("ij,ij->i", gap, gap), 9)
        want = sorted((d2[j], ids[j]) for j in range(120) if ids[j] != ids[row])[:K]
        assert list(zip(best.d2[row], best.ids[row], strict=True)) == want


def test_far_from_the_origin(spark):
    """Squares of such numbers have no digits left for the distances."""
    x = rng.normal(size=(60, 4)) + 1e7
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, label string, features array<double>").repartition(3)
    want = brute(np.arange(60), np.full(60, "a"), x, False)
    for same, block in ((True, 7), (False, 16), (False, 1000)):
        got = {}
        for r in balancing.nearest(df, K, same, block).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["d2"], r["nn_id"]))
        assert got == want
    few = balancing.nearest(df, K, False, 16, df.where("id % 10 = 3")).orderBy("id", "rank").collect()
    assert [(r["id"], r["nn_id"]) for r in few] == [(i, j) for i in range(3, 60, 10) for _, j in want[i]]


def test_rows_are_made_once(spark):
    """Oversampling and cleaning pass over the rows many times, which are made once."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    x = rng.normal(size=(70, 4))
    rows = [(i, "a" if i < 40 else "bc"[i % 2], x[i].tolist()) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>").repartition(3)
    both = balancing.balance(df.mapInArrow(count, df.schema), "smoteenn")
    kept = sorted((r["id"], r["label"]) for r in both.select("id", "label").collect())
    assert made.value == 70
    balancing.release(both)
    whole = balancing.balance(df, "smote")
    assert kept == sorted((r["id"], r["label"]) for r in balancing.vote_keeps(whole).where("keep").collect())
    assert whole.count() == 120
    balancing.release(whole)
    assert not whole.storageLevel.useMemory and not df.sparkSession._jsparkSession.sharedState().cacheManager().numCachedEntries()


def test_ragged_features_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0, 2.0])], "id long, label string, features array<double>").repartition(1)
    with pytest.raises(Exception, match="one length"):
        balancing.nearest(df, 1).collect()
