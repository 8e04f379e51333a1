import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalog as cat
from gridloom.errors import AlreadyExists, AmbiguousStore, CatalogError, InvalidArtifact, NotFound, NotInitialized, OutOfBounds, SchemaMismatch, TooLarge, UnknownKey
from gridloom.operators import dense, sparse, vectors
from gridloom.operators.cliques import gaussian_cliques, sizes
from gridloom.store import Store


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path), "t")
    s.seed(150, 300)
    return s


def test_fixture_counts():
    g = gaussian_cliques()
    assert sizes(150, 5) == ([29, 29, 28, 28, 28], 8)
    assert int(g.adjacency.sum()) == 3892 and int((g.adjacency.sum(1) == 0).sum()) == 8 and (g.adjacency == g.adjacency.T).all()


def test_dense_round_trip(spark, store):
    g = gaussian_cliques()
    store.save_dense("matrix", dense.from_numpy(spark, g.rows).repartition(7))
    assert (dense.to_numpy(store.load_dense("matrix")) == g.rows).all()
    entry = store.catalog().files["matrix"]
    assert (entry.rows, entry.cols) == (150, 300) and entry.size_bytes > 0


def test_odd_values_survive(spark, store):
    m = np.array([[math.nan, -0.0, math.inf], [5e-324, -math.inf, 1.0]])
    store.save_dense("odd", dense.from_numpy(spark, m))
    got = dense.to_numpy(store.load_dense("odd"))
    assert np.array_equal(got, m, equal_nan=True) and np.signbit(got[0, 1])


def test_many_rows_in_an_order(spark, store):
    df = spark.range(100_000).select((F.col("id") * -1).alias("k"), F.array((F.col("id") * 2).cast("double")).alias("v")).repartition(9)
    store.save_dense("long", df, "k", vector="v")
    got = store.load_dense("long")
    assert got.count() == 100_000 and got.where(F.col("vector")[0] != (99_999 - F.col("pos")) * 2).count() == 0


def test_column_major_and_transpose(spark):
    m = dense.from_numpy(spark, np.array([[1.0, 2, 3], [4, 5, 6]]))
    assert [r.value for r in dense.column_major(m, 2).orderBy("idx").collect()] == [1, 4, 2, 5, 3, 6]
    assert dense.to_numpy(dense.transpose(m)).tolist() == [[1, 4], [2, 5], [3, 6]]
    assert dense.to_numpy(m).flags.f_contiguous


@pytest.mark.parametrize(
    "rows, error",
    [
        ([], InvalidArtifact),
        ([([], 0)], InvalidArtifact),
        ([([1.0], 0), ([1.0, 2.0], 1)], InvalidArtifact),
        ([(None, 0)], InvalidArtifact),
        ([([1.0, None], 0)], InvalidArtifact),
        ([([1.0], 0), ([1.0], 0)], InvalidArtifact),
        ([([1.0], 1)], InvalidArtifact),
        ([([1.0], None)], InvalidArtifact),
    ],
)
def test_bad_dense(spark, store, rows, error):
    with pytest.raises(error):
        store.save_dense("bad", spark.createDataFrame(rows, "vector array<double>, pos bigint"))
    assert "bad" not in store.catalog().files


def test_local_limit_is_inclusive():
    dense.check_local(536_870_912, 1)
    with pytest.raises(TooLarge):
        dense.check_local(536_870_913, 1)


def test_sparse_round_trip(spark, store):
    g = gaussian_cliques()
    r, c = np.nonzero(g.adjacency)
    df = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(r, c)], "row bigint, col bigint, value double").repartition(5)
    store.save_sparse("adjacency", df, 150, 150)
    got = store.load_sparse("adjacency")
    starts, indices, data = sparse.to_csr(got, 150)
    assert store.catalog().files["adjacency"].nnz == len(data) == 3892
    assert (starts == np.concatenate([[0], np.cumsum(g.adjacency.sum(1))])).all() and (indices == c).all() and (data == 1).all()
    assert [x.indptr for x in sparse.indptr(got, 150).orderBy("row").collect()] == starts.tolist()


def test_duplicates_are_summed_as_a_dictionary_would(spark, store):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b), float(v)) for a, b, v in zip(rng.integers(0, 20, 500), rng.integers(0, 20, 500), rng.integers(-5, 5, 500))] + [(25, 25, -0.0), (26, 26, 0.0)]
    want = {}
    for a, b, v in rows:
        want[a, b] = want.get((a, b), -0.0) + v
    store.save_sparse("signals", spark.createDataFrame(rows, "row bigint, col bigint, value double"), 30, 30)
    got = {(r.row, r.col): r.value for r in store.load_sparse("signals").collect()}
    assert got == want and math.copysign(1, got[25, 25]) == -1
    assert store.load_sparse("signals", consolidated=False).count() == len(rows)


def test_empty_sparse(spark, store):
    store.save_sparse("laplacian", spark.createDataFrame([], "row bigint, col bigint, value double"), 4, 5)
    got = store.load_sparse("laplacian")
    assert got.count() == 0 and [r.indptr for r in sparse.indptr(got, 4).collect()] == [0] * 5


def test_sparse_blocks(spark, store):
    rows = [([0, 1, 2], [0, 1, 2], 1.0), ([0, 0], [3, 0, 2], 0.5), ([], [1], 2.0), ([4], [4], 3.0)]
    store.save_sparse_blocks("adjacency", spark.createDataFrame(rows, "rows array<int>, cols array<bigint>, value double"), 5, 5)
    want = [(i, j, v) for a, b, v in rows for i in a for j in b if i != j]
    got = store.load_sparse("adjacency", consolidated=False)
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.dtypes == [("row", "bigint"), ("col", "bigint"), ("value", "double")]
    assert {(r.row, r.col): r.value for r in store.load_sparse("adjacency").collect()}[0, 2] == 2.0
    entry = store.catalog().files["adjacency"]
    assert (entry.filetype, entry.storage_format, entry.rows, entry.cols, entry.nnz) == ("sparse", cat.BLOCKS, 5, 5, len(want))
    assert [r.storage_format for r in store.listing().where("key = 'adjacency'").collect()] == [cat.BLOCKS]


def test_bad_sparse_blocks(spark, store):
    make = lambda *rows: spark.createDataFrame(list(rows), "rows array<bigint>, cols array<bigint>, value double")
    for row, error in ((([0, 5], [1], 1.0), OutOfBounds), (([0], [-1], 1.0), OutOfBounds), (([0, None], [1], 1.0), InvalidArtifact), ((None, [1], 1.0), InvalidArtifact), (([0], [1], None), InvalidArtifact)):
        with pytest.raises(error):
            store.save_sparse_blocks("adjacency", make(([1], [2], 1.0), row), 5, 5)
    with pytest.raises(OutOfBounds):
        store.save_sparse_blocks("adjacency", make(), 2**32 + 1, 5)
    with pytest.raises(SchemaMismatch):
        store.save_sparse_blocks("adjacency", make().withColumn("rows", F.array(F.lit("a"))), 5, 5)
    with pytest.raises(UnknownKey):
        store.save_sparse_blocks("rawinput", make(), 5, 5)
    store.save_sparse_blocks("adjacency", make(([0], [4], 1.0)), 5, 5)
    with pytest.raises(AlreadyExists):
        store.save_sparse_blocks("adjacency", make(([0], [4], 1.0)), 5, 5)
    make(([0], [5], 1.0)).write.mode("overwrite").parquet(store.path("adjacency"))
    with pytest.raises(Exception, match="entry outside 5 x 5"):
        store.load_sparse("adjacency").collect()


def test_bad_sparse(spark, store):
    make = lambda *rows: spark.createDataFrame(list(rows), "row bigint, col bigint, value double")
    for rows in ([(4, 0, 1.0)], [(0, 4, 1.0)], [(-1, 0, 1.0)]):
        with pytest.raises(OutOfBounds):
            store.save_sparse("signals", make(*rows), 4, 4)
    with pytest.raises(OutOfBounds):
        store.save_sparse("signals", make(), 2**32 + 1, 4)
    with pytest.raises(InvalidArtifact):
        store.save_sparse("signals", make((0, 0, None)), 4, 4)
    with pytest.raises(SchemaMismatch):
        store.save_sparse("signals", make().withColumn("row", F.lit("a")), 4, 4)
    for key in ("rawinput", "lambdas", "elsewhere"):
        with pytest.raises(UnknownKey):
            store.save_sparse(key, make(), 4, 4)
    with pytest.raises(UnknownKey):
        store.load_sparse("signals")
    store.save_sparse("signals", make((3, 3, 1.0)), 4, 4)
    entry = store.catalog().files["signals"]
    store.save_catalog(store.catalog().with_entry("signals", cat.Entry.of("t", "signals", "sparse", 3, 3, 1)))
    with pytest.raises(SchemaMismatch):
        store.load_sparse("signals")
    store.save_catalog(store.catalog().with_entry("signals", entry))
    spark.createDataFrame([(9, 0, 1.0)], "row bigint, col bigint, value double").write.mode("overwrite").parquet(store.path("signals"))
    with pytest.raises(Exception, match="outside 4 x 4"):
        store.load_sparse("signals").collect()


@pytest.mark.parametrize("kind", list(vectors.KINDS))
def test_vectors_round_trip(spark, store, kind):
    spec = vectors.KINDS[kind]
    values = [5, 0, 4294967295, 7] if spec.ids else [0.1, -0.0, math.inf, 3.0]
    if spec.optional:
        values = [3, None, 0, None]
    key = None if spec.key else "mine"
    for name, rows in (("full", values), ("empty", [])):
        df = spark.createDataFrame([(v, k) for k, v in enumerate(rows)], f"v {'bigint' if spec.ids else 'double'}, pos bigint").repartition(3)
        store.save_vector(kind, df, "v", key=key, overwrite=True)
        assert vectors.to_list(store.load_vector(kind, key=key)) == rows, name
    assert store.catalog().files[key or spec.key].rows == 0


def test_assignments_on_disk(spark, store):
    store.save_vector("cluster_assignments", spark.createDataFrame([(None, 0), (4, 1), (-7, 2)], "c int, pos bigint"), "c")
    assert [r[0] for r in spark.read.parquet(store.path("cluster_assignments")).orderBy("pos").collect()] == [-1, 4, -7]
    assert vectors.to_list(store.load_vector("cluster_assignments")) == [None, 4, None]


def test_bad_vectors(spark, store):
    make = lambda kind, *v: spark.createDataFrame([(x, k) for k, x in enumerate(v)], f"v {kind}, pos bigint")
    for value in (-1, 2**32):
        with pytest.raises(OutOfBounds):
            store.save_vector("index", make("bigint", value), "v", key="i")
    store.save_vector("index", make("bigint", 2**32 + 5), "v", key="i", wrap=True)
    assert vectors.to_list(store.load_vector("index", key="i")) == [5]
    assert vectors.to_list(store.load_vector("centroid_map", key="i")) == [5]  # same type
    with pytest.raises(SchemaMismatch):
        store.load_vector("lambdas", key="i")
    with pytest.raises(InvalidArtifact):
        store.save_vector("lambdas", make("double", None), "v")
    with pytest.raises(SchemaMismatch):
        store.save_vector("lambdas", make("string", "a"), "v")
    with pytest.raises(UnknownKey):
        store.save_vector("vector", make("double", 1.0), "v")
    with pytest.raises(UnknownKey):
        store.save_vector("nothing", make("double", 1.0), "v")
    with pytest.raises(UnknownKey):
        store.save_vector("vector", make("double", 1.0), "v", key="adjacency")
    with pytest.raises(NotFound):
        store.load_vector("item_norms")


def test_writing_needs_a_catalog_and_a_free_place(spark, tmp_path):
    m = dense.from_numpy(spark, np.eye(2))
    bare = Store(spark, str(tmp_path), "bare")
    with pytest.raises(NotInitialized):
        bare.save_dense("m", m)
    bare.seed(2, 2)
    bare.save_dense("m", m)
    with pytest.raises(AlreadyExists):
        bare.save_dense("m", m)
    bare.save_dense("m", dense.from_numpy(spark, np.ones((3, 1))), overwrite=True)
    assert dense.to_numpy(bare.load_dense("m")).shape == (3, 1)
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name or p.name.endswith(".new")]


def test_stores_side_by_side_and_open(spark, tmp_path):
    a, b = Store(spark, str(tmp_path), "a"), Store(spark, str(tmp_path), "b")
    with pytest.raises(NotInitialized):
        Store.open(spark, str(tmp_path))
    with pytest.raises(NotInitialized):
        Store.open(spark, str(tmp_path / "nowhere"))
    a.seed(2, 2)
    assert Store.open(spark, str(tmp_path)).name == "a"
    b.seed(2, 2)
    a.save_dense("m", dense.from_numpy(spark, np.array([[1.0, 3], [2, 4]])))
    b.save_dense("m", dense.from_numpy(spark, np.array([[5.0, 7], [6, 8]])))
    assert dense.to_rows(a.load_dense("m")) == [[1, 3], [2, 4]] and dense.to_rows(b.load_dense("m")) == [[5, 7], [6, 8]]
    with pytest.raises(AmbiguousStore):
        Store.open(spark, str(tmp_path))
    assert Store.open(spark, str(tmp_path), "b").catalog().name_id == "b"
    with pytest.raises(CatalogError):
        a.save_catalog(cat.Catalog("b"))


def test_names(spark, tmp_path):
    for name in ("", "a/b", "..", ".a", "a[1]", "a b"):
        with pytest.raises(CatalogError):
            Store(spark, str(tmp_path), name)
        with pytest.raises(UnknownKey):
            Store(spark, str(tmp_path), "ok").path(name)
    store = Store(spark, str(tmp_path), "ok")
    assert store.base_uri.startswith("file:/") and store.uri("k").endswith("ok_k.parquet")


def test_subcentroids(spark, store):
    store.save_subcentroids(dense.from_numpy(spark, np.array([[1.0, 2], [3, 4]])))
    assert store.load_subcentroids() == [[1, 2], [3, 4]]


def test_saves_at_the_same_time_all_reach_the_catalog(spark, store):
    import threading

    errors = []

    def save(k):
        try:
            Store(spark, store.base, "t").save_vector("vector", spark.range(5).select("id", F.lit(float(k)).alias("x")), "x", "id", key=f"k{k}")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=save, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and set(store.catalog().files) == {"rawinput", "k0", "k1", "k2"}
    assert not [n for n in store._files.names(store.base) if n.startswith("_") or n.endswith(".lock")]


def test_a_failed_replacement_leaves_the_old_artifact(spark, store, monkeypatch):
    old, new = (spark.range(n).select("id", F.col("id").cast("double").alias("x")) for n in (4, 9))
    store.save_vector("lambdas", old, "x", "id")
    monkeypatch.setattr(store, "save_catalog", lambda catalog: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError):
        store.save_vector("lambdas", new, "x", "id", overwrite=True)
    monkeypatch.undo()
    assert store.load_vector("lambdas").count() == 4 == store.catalog().files["lambdas"].rows
    store.save_vector("lambdas", new, "x", "id", overwrite=True)
    assert store.load_vector("lambdas").count() == 9 == store.catalog().files["lambdas"].rows
    assert not [n for n in store._files.names(store.base) if n.startswith("_")]


def test_a_dead_writers_lock_is_taken_over(store):
    lock = f"{store.base}/x.lock"
    store._files.write_text(lock, "")
    with store._files.locked(lock, patience=0.2):
        assert store._files.exists(lock)
    assert not store._files.exists(lock)


def test_the_store_is_a_backend(store):
    from gridloom.backend import StorageBackend

    assert isinstance(store, StorageBackend) and not isinstance(object(), StorageBackend)
