"""The store's queries and their SQL.

Each goes through the engine where it is about reading and writing: save to a store (or a
file) under the shared scratch folder, load, and answer from what was loaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import Catalog, storage_format
from gridloom.errors import StoreError
from gridloom.operators import dense, graph, sparse
from gridloom.sources.files import scratch_folder
from gridloom.sources.layout import read_dense_file, write_dense_file
from gridloom.store import Store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store(spark: SparkSession, name: str = "bench", rows: int = 0, cols: int = 0) -> Store:
    store = Store(spark, scratch_folder(spark), name)
    store.seed(rows, cols)
    return store


def _embeddings(spark, sf_dir, *, exact: bool = True) -> DataFrame:
    """The embeddings, stored and loaded; positions are 0, 1, ... in order of ``vec_id``."""
    store = _store(spark)
    store.save_dense("rawinput", _table(spark, sf_dir, "embeddings"), "vec_id", vector="embedding")
    return store.load_dense("rawinput")


def dense_roundtrip(spark, sf_dir):
    return dense.long_form(_embeddings(spark, sf_dir))


def dense_column_major(spark, sf_dir):
    m = _embeddings(spark, sf_dir)
    return dense.column_major(m, m.count())


def dense_shape(spark, sf_dir):
    return dense.shape(_embeddings(spark, sf_dir))


def dense_transpose(spark, sf_dir):
    return dense.long_form(dense.transpose(_embeddings(spark, sf_dir)))


def dense_wide_import(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding")).alias("n")).first().n or 0
    wide = vectors.orderBy("vec_id").select(*[F.get("embedding", F.lit(c)).cast("double").alias(f"col_{c}") for c in range(width)])
    path = f"{scratch_folder(spark)}/wide.parquet"
    wide.write.parquet(path)
    return dense.long_form(read_dense_file(spark, path))


def dense_file_export(spark, sf_dir):
    path = f"{scratch_folder(spark)}/dense.parquet"
    write_dense_file(dense.encode(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id"), path)
    return dense.long_form(read_dense_file(spark, path))


def row_norms(spark, sf_dir):
    return graph.row_norms(_embeddings(spark, sf_dir))


def _centroids(spark, sf_dir) -> DataFrame:
    means = graph.centroids(_table(spark, sf_dir, "embeddings").where("label IS NOT NULL"), "label", "embedding")
    return dense.from_long(means.select(F.col("label").alias("row"), "col", F.round("mean", 6).alias("value")))


def pairwise_l2(spark, sf_dir):
    store = _store(spark)
    store.save_subcentroids(_centroids(spark, sf_dir).withColumnRenamed("pos", "label"), "label")
    m = store.load_dense("sub_centroids")
    return graph.pairwise_distances(m, m.count()).select("i", "j", F.round("distance", 9).alias("distance"))


def subcentroids(spark, sf_dir):
    store = _store(spark)
    store.save_subcentroids(_centroids(spark, sf_dir).withColumnRenamed("pos", "label"), "label")
    return dense.long_form(store.load_dense("sub_centroids"))


def clique_adjacency(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    n = (vectors.agg(F.max("vec_id").alias("m")).first().m or 0) + 1
    store = _store(spark)
    store.save_sparse_blocks("adjacency", graph.clique_blocks(vectors, "vec_id", "label"), n, n)
    return store.load_sparse("adjacency", consolidated=False)


def _supplies(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("value"))


def _stored_supplies(spark, sf_dir, key: str, entries: DataFrame) -> tuple[Store, int]:
    top = entries.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    store = _store(spark)
    store.save_sparse(key, entries, (top.r or 0) + 1, (top.c or 0) + 1)
    return store, (top.r or 0) + 1


def sparse_roundtrip(spark, sf_dir):
    store, _ = _stored_supplies(spark, sf_dir, "signals", sparse.consolidate(_supplies(spark, sf_dir)))
    return store.load_sparse("signals", consolidated=False)


def sparse_consolidate(spark, sf_dir):
    store, _ = _stored_supplies(spark, sf_dir, "signals", _supplies(spark, sf_dir))
    return store.load_sparse("signals")


def sparse_nnz(spark, sf_dir):
    store, _ = _stored_supplies(spark, sf_dir, "signals", _supplies(spark, sf_dir))
    return sparse.nnz(store.load_sparse("signals"))


def csr_indptr(spark, sf_dir):
    store, rows = _stored_supplies(spark, sf_dir, "signals", _supplies(spark, sf_dir))
    return sparse.indptr(store.load_sparse("signals"), rows)


def csr_entries(spark, sf_dir):
    store, _ = _stored_supplies(spark, sf_dir, "signals", _supplies(spark, sf_dir))
    return sparse.csr_entries(store.load_sparse("signals"))


def _vector(kind, table, column, *order, key=None, wrap=False, prepare=None):
    def query(spark, sf_dir):
        store = _store(spark)
        df = _table(spark, sf_dir, table)
        store.save_vector(kind, prepare(spark, sf_dir, df) if prepare else df, column, *order, key=key, wrap=wrap)
        return store.load_vector(kind, key=key)

    return query


def item_norms(spark, sf_dir):
    store = _store(spark)
    store.save_vector("item_norms", row_norms(spark, sf_dir), "norm")
    return store.load_vector("item_norms")


def _qualities(spark, sf_dir, docs):
    return docs.select("doc_id").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


def cluster_assignments_raw(spark, sf_dir):
    store = _store(spark)
    store.save_vector("cluster_assignments", _qualities(spark, sf_dir, _table(spark, sf_dir, "documents")), "quality", "doc_id")
    return spark.read.parquet(store.path("cluster_assignments"))


def catalog_listing(spark, sf_dir):
    """A store of each kind, and what its catalog says."""
    vectors, supplies = _table(spark, sf_dir, "embeddings"), _supplies(spark, sf_dir)
    top = supplies.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    store = _store(spark)
    store.save_dense("rawinput", vectors, "vec_id", vector="embedding")
    store.save_sparse("signals", supplies, (top.r or 0) + 1, (top.c or 0) + 1)
    store.save_vector("lambdas", _table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey")
    return store.listing().select("key", F.col("filetype").alias("kind"), "storage_format", "rows", "cols", "nnz", (F.col("size_bytes") > 0).alias("has_size"))


def lance_file_roundtrip(spark, sf_dir):
    path = f"{scratch_folder(spark)}/dense.lance"
    write_dense_file(dense.encode(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id"), path)
    return dense.long_form(read_dense_file(spark, path))


def subcentroids_as_rows(spark, sf_dir):
    """The local form: a list of rows, of which there are as many as sub-centroids."""
    store = _store(spark)
    store.save_subcentroids(_centroids(spark, sf_dir).withColumnRenamed("pos", "label"), "label")
    rows = [(i, j, x) for i, row in enumerate(store.load_subcentroids()) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "row bigint, col int, value double")


def sparse_empty(spark, sf_dir):
    store = _store(spark)
    store.save_sparse("laplacian", _supplies(spark, sf_dir).limit(0), 5, 7)
    entry = store.catalog().files["laplacian"]
    return store.load_sparse("laplacian").agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(entry.rows).cast("bigint").alias("rows"), F.lit(entry.cols).cast("bigint").alias("cols"), F.lit(entry.nnz).cast("bigint").alias("nnz"))


def store_lifecycle(spark, sf_dir):
    """What can be seen of a store before it is seeded, after, and when it is opened again."""
    base = scratch_folder(spark)
    seen = [("exists before", str(Store.exists(spark, base)))]
    store = Store(spark, base, "one")
    store.seed(3, 2)
    seen += [("exists after", str(Store.exists(spark, base))), ("found", ",".join(Store.find(spark, base)))]
    store.save_vector("lambdas", spark.range(3).select("id", F.col("id").cast("double").alias("x")), "x", "id")
    again = Store.open(spark, base)
    seen += [("opened", again.name), ("dimensions", f"{again.catalog().nrows} x {again.catalog().ncols}"), ("keys", ",".join(sorted(again.catalog().files))), ("elements", str(again.load_vector("lambdas").count()))]
    seen += [("path", again.path("lambdas").removeprefix(base)), ("uri", again.uri("lambdas").rpartition("/")[2]), ("uri is of base", str(again.uri("lambdas").startswith(again.base_uri))), ("scheme", str("://" in again.uri("lambdas") or again.uri("lambdas").startswith("file:")))]
    return spark.createDataFrame(seen, "step string, value string")


def store_errors(spark, sf_dir):
    """Each way to go wrong, and the error that it ends in."""
    base, store = scratch_folder(spark), _store(spark)
    vectors = _table(spark, sf_dir, "embeddings")
    entries = spark.createDataFrame([(0, 9, 1.0)], "row bigint, col bigint, value double")
    ragged = spark.createDataFrame([([1.0], 0), ([1.0, 2.0], 1)], "vector array<double>, pos bigint")
    twice = spark.createDataFrame([([1.0], 0), ([2.0], 0)], "vector array<double>, pos bigint")
    store.save_vector("lambdas", spark.range(2).select("id", F.col("id").cast("double").alias("x")), "x", "id")
    two = scratch_folder(spark)
    for name in ("a", "b"):
        Store(spark, two, name).seed(1, 1)
    cases = {
        "open nothing": lambda: Store.open(spark, base),
        "open one of two": lambda: Store.open(spark, two),
        "save before seeding": lambda: Store(spark, base, "x").save_dense("rawinput", vectors, "vec_id", vector="embedding"),
        "load what is not there": lambda: store.load_dense("rawinput"),
        "save again": lambda: store.save_vector("lambdas", spark.range(1).select("id", F.lit(0.5).alias("x")), "x", "id"),
        "dense under a key of vectors": lambda: store.save_dense("lambdas", vectors, "vec_id", vector="embedding"),
        "sparse under an unknown key": lambda: store.save_sparse("other", entries, 10, 10),
        "kind without a key": lambda: store.load_vector("index"),
        "a key that is a path": lambda: store.path("../x"),
        "entries outside": lambda: store.save_sparse("adjacency", entries, 1, 9),
        "floats as coordinates": lambda: store.save_sparse("adjacency", entries.withColumn("row", F.col("row").cast("double")), 1, 10),
        "rows of unequal length": lambda: store.save_dense("matrix", ragged),
        "a position twice": lambda: store.save_dense("matrix", twice),
        "no rows": lambda: store.save_dense("matrix", ragged.limit(0)),
        "no order": lambda: store.save_dense("matrix", vectors, vector="embedding"),
        "a matrix beyond local memory": lambda: dense.check_local(536_870_913, 1),
        "a file of another format": lambda: write_dense_file(dense.encode(vectors, "embedding", "vec_id"), f"{base}/x.csv"),
        "a file that is not there": lambda: read_dense_file(spark, f"{base}/x.parquet"),
        "not a catalog": lambda: Catalog.from_json("[]"),
    }
    seen = []
    for case, act in cases.items():
        try:
            act()
            seen.append((case, "none"))
        except StoreError as e:
            seen.append((case, type(e).__name__))
    return spark.createDataFrame(seen, "case_name string, error string")


QUERIES = {
    "dense_roundtrip": dense_roundtrip,
    "dense_column_major": dense_column_major,
    "dense_shape": dense_shape,
    "dense_transpose": dense_transpose,
    "dense_wide_import": dense_wide_import,
    "dense_file_export": dense_file_export,
    "row_norms": row_norms,
    "pairwise_l2": pairwise_l2,
    "subcentroids": subcentroids,
    "clique_adjacency": clique_adjacency,
    "sparse_roundtrip": sparse_roundtrip,
    "sparse_consolidate": sparse_consolidate,
    "sparse_nnz": sparse_nnz,
    "csr_indptr": csr_indptr,
    "csr_entries": csr_entries,
    "lambdas_roundtrip": _vector("lambdas", "customer", "c_acctbal", "c_custkey"),
    "vector_roundtrip": _vector("vector", "supplier", "s_acctbal", "s_suppkey", key="balances"),
    "index_roundtrip": _vector("index", "orders", "o_custkey", "o_orderkey", key="customers"),
    "index_wrap": _vector("index", "events", "wide", "event_id", key="wrapped", wrap=True, prepare=lambda s, d, df: df.withColumn("wide", F.col("event_id") * 4294967)),
    "centroid_map": _vector("centroid_map", "embeddings", "label", "vec_id"),
    "subcentroid_lambdas": _vector("subcentroid_lambdas", "part", "p_retailprice", "p_partkey"),
    "item_norms": item_norms,
    "cluster_assignments": _vector("cluster_assignments", "documents", "quality", "doc_id", prepare=_qualities),
    "cluster_assignments_raw": cluster_assignments_raw,
    "catalog_listing": catalog_listing,
    "lance_file_roundtrip": lance_file_roundtrip,
    "subcentroids_as_rows": subcentroids_as_rows,
    "sparse_empty": sparse_empty,
    "store_lifecycle": store_lifecycle,
    "store_errors": store_errors,
}

_CELLS = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, unnest(range(len(embedding)))::int AS col, unnest(embedding)::double AS value FROM embeddings"
_NORMS = "SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) AS norm, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings"
_MEANS = """
WITH cells AS (SELECT label, unnest(range(len(embedding)))::int AS col, unnest(embedding)::double AS x FROM embeddings WHERE label IS NOT NULL),
means AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS row, col, round(avg(x), 6) AS value FROM cells GROUP BY label, col)
"""
_LIFECYCLE = {
    "exists before": "False", "exists after": "True", "found": "one", "opened": "one", "dimensions": "3 x 2", "keys": "lambdas,rawinput", "elements": "3",
    "path": "/one_lambdas.parquet", "uri": "one_lambdas.parquet", "uri is of base": "True", "scheme": "True",
}
_ERRORS = {
    "open nothing": "NotInitialized", "open one of two": "AmbiguousStore", "save before seeding": "NotInitialized", "load what is not there": "NotFound",
    "save again": "AlreadyExists", "dense under a key of vectors": "UnknownKey", "sparse under an unknown key": "UnknownKey", "kind without a key": "UnknownKey",
    "a key that is a path": "UnknownKey", "entries outside": "OutOfBounds", "floats as coordinates": "SchemaMismatch", "rows of unequal length": "InvalidArtifact",
    "a position twice": "InvalidArtifact", "no rows": "InvalidArtifact", "no order": "InvalidArtifact", "a matrix beyond local memory": "TooLarge",
    "a file of another format": "UnsupportedFormat", "a file that is not there": "NotFound", "not a catalog": "CatalogError",
}


def _pairs(rows: dict, one: str, two: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + f") AS t({one}, {two})"


_SUPPLIES = "SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


def _ordered(column: str, table: str, order: str, name: str) -> str:
    return f'SELECT {column} AS "{name}", row_number() OVER (ORDER BY {order}) - 1 AS pos FROM {table}'


SQL = {
    "lance_file_roundtrip": _CELLS,
    "subcentroids_as_rows": _MEANS + "SELECT row, col, value FROM means",
    "sparse_empty": "SELECT 0::bigint AS n, 5::bigint AS rows, 7::bigint AS cols, 0::bigint AS nnz",
    "store_lifecycle": _pairs(_LIFECYCLE, "step", "value"),
    "store_errors": _pairs(_ERRORS, "case_name", "error"),
    "dense_roundtrip": _CELLS,
    "dense_column_major": f"SELECT col::bigint * (SELECT count(*) FROM embeddings) + row AS idx, value FROM ({_CELLS})",
    "dense_shape": "SELECT count(*) AS n_rows, max(len(embedding))::bigint AS n_cols, (count(*) * max(len(embedding)) * 8)::bigint AS n_bytes FROM embeddings",
    "dense_transpose": f"SELECT col::bigint AS row, row::int AS col, value FROM ({_CELLS})",
    "dense_wide_import": _CELLS,
    "dense_file_export": _CELLS,
    "row_norms": _NORMS,
    "pairwise_l2": _MEANS
    + "SELECT a.row AS i, b.row AS j, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 9) AS distance FROM means a JOIN means b ON a.col = b.col AND a.row < b.row GROUP BY ALL",
    "subcentroids": _MEANS + "SELECT row, col, value FROM means",
    "clique_adjacency": "SELECT a.vec_id AS row, b.vec_id AS col, 1.0::double AS value FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id",
    "sparse_roundtrip": _SUPPLIES,
    "sparse_consolidate": _SUPPLIES,
    "sparse_nnz": f"SELECT count(*) AS nnz FROM ({_SUPPLIES})",
    "csr_indptr": f"""
WITH entries AS ({_SUPPLIES}),
counts AS (SELECT row, count(*) AS n FROM entries GROUP BY row),
every AS (SELECT unnest(range((SELECT max(row) + 2 FROM entries))) AS row)
SELECT e.row, coalesce(sum(n) OVER (ORDER BY e.row), 0)::bigint AS indptr FROM every e LEFT JOIN counts c ON c.row = e.row - 1
""",
    "csr_entries": f"SELECT row, (row_number() OVER (PARTITION BY row ORDER BY col) - 1)::int AS nth, col, value FROM ({_SUPPLIES})",
    "lambdas_roundtrip": _ordered("c_acctbal", "customer", "c_custkey", "lambda"),
    "vector_roundtrip": _ordered("s_acctbal", "supplier", "s_suppkey", "element"),
    "index_roundtrip": _ordered("o_custkey", "orders", "o_orderkey", "id"),
    "index_wrap": _ordered("(event_id * 4294967) & 4294967295", "events", "event_id", "id"),
    "centroid_map": _ordered("label::bigint", "embeddings", "vec_id", "centroid_id"),
    "subcentroid_lambdas": _ordered("p_retailprice", "part", "p_partkey", "subcentroid_lambda"),
    "item_norms": _NORMS,
    "cluster_assignments": _ordered("quality::bigint", "documents LEFT JOIN labels USING (doc_id)", "doc_id", "cluster_id"),
    "cluster_assignments_raw": _ordered("coalesce(quality, -1)::bigint", "documents LEFT JOIN labels USING (doc_id)", "doc_id", "cluster_id"),
    "catalog_listing": f"""
SELECT 'rawinput' AS key, 'dense' AS kind, '{storage_format("dense")}' AS storage_format, (SELECT count(*) FROM embeddings) AS rows, (SELECT max(len(embedding))::bigint FROM embeddings) AS cols, NULL::bigint AS nnz, true AS has_size
UNION ALL SELECT 'signals', 'sparse', '{storage_format("sparse")}', (SELECT max(l_partkey) + 1 FROM lineitem), (SELECT max(l_suppkey) + 1 FROM lineitem), (SELECT count(*) FROM lineitem), true
UNION ALL SELECT 'lambdas', 'vector', '{storage_format("vector")}', (SELECT count(*) FROM customer), 1, NULL, true
""",
}
