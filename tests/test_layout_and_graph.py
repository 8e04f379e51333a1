import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.errors import AlreadyExists, InvalidArtifact, NotFound, SchemaMismatch, UnsupportedFormat
from gridloom.operators import dense, graph
from gridloom.operators.cliques import gaussian_cliques
from gridloom.plans import queries as plans
from gridloom.sources.layout import read_dense_file, write_dense_file


@pytest.mark.parametrize("extension", ["parquet", "lance"])
def test_write_and_read(spark, tmp_path, extension):
    path, m = str(tmp_path / f"m.{extension}"), np.arange(12.0).reshape(4, 3)
    write_dense_file(dense.from_numpy(spark, m).repartition(3), path)
    assert (dense.to_numpy(read_dense_file(spark, path)) == m).all()
    again = dense.from_numpy(spark, m + 1)
    if extension == "lance":
        with pytest.raises(AlreadyExists):
            write_dense_file(again, path)
    else:
        write_dense_file(again, path)
        assert (dense.to_numpy(read_dense_file(spark, path)) == m + 1).all()


def test_one_file_with_fixed_size_lists(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"anything": pa.FixedSizeListArray.from_arrays(pa.array(np.arange(6000.0)), 3)}), path, row_group_size=100)
    assert (dense.to_numpy(read_dense_file(spark, path)) == np.arange(6000.0).reshape(-1, 3)).all()


def test_wide_goes_by_schema_order(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    pq.write_table(pa.table({"col_10": [1.0, 4], "other": [2.0, 5], "col_2": [3.0, 6]}), path)
    assert dense.to_numpy(read_dense_file(spark, path)).tolist() == [[1, 2, 3], [4, 5, 6]]


@pytest.mark.parametrize("columns", [{"a": [1.0], "b": [2.0]}, {"col_0": [1.0], "n": [1]}, {"v": [["x"]]}, {"v": [[1.0]], "w": [[1.0]]}])
def test_other_layouts_are_refused(spark, tmp_path, columns):
    path = str(tmp_path / "bad.parquet")
    pq.write_table(pa.table(columns), path)
    with pytest.raises(SchemaMismatch):
        read_dense_file(spark, path)


def test_bad_files(spark, tmp_path):
    for name, error in (("none.parquet", NotFound), ("x.csv", UnsupportedFormat), ("plain", UnsupportedFormat)):
        if error is UnsupportedFormat:
            (tmp_path / name).write_text("a")
        with pytest.raises(error):
            read_dense_file(spark, str(tmp_path / name))
    pq.write_table(pa.table({"col_0": pa.array([], pa.float64())}), tmp_path / "empty.parquet")
    with pytest.raises(InvalidArtifact):
        read_dense_file(spark, str(tmp_path / "empty.parquet"))
    pq.write_table(pa.table({"v": pa.array([[1.0], [1.0, 2.0]])}), tmp_path / "ragged.parquet")
    with pytest.raises(InvalidArtifact):
        read_dense_file(spark, str(tmp_path / "ragged.parquet"))
    with pytest.raises(UnsupportedFormat):
        write_dense_file(dense.from_numpy(spark, np.eye(1)), str(tmp_path / "x.csv"))


def test_norms_and_distances(spark):
    g = gaussian_cliques(n=40, dims=6)
    m = dense.from_numpy(spark, g.rows)
    norms = [r.norm for r in graph.row_norms(m).orderBy("pos").collect()]
    assert np.allclose(norms, g.norms, rtol=1e-12)
    got = {(r.i, r.j): r.distance for r in graph.pairwise_distances(m, 40).collect()}
    assert len(got) == 780 and all(abs(d - np.linalg.norm(g.rows[i] - g.rows[j])) < 1e-9 for (i, j), d in got.items())
    far = sum(any(np.linalg.norm(g.rows[i] - g.rows[j]) > 10 for j in range(i + 1, 40)) for i in range(40))
    assert graph.count_far(graph.pairwise_distances(m, 40), 10.0).first().n == far


def test_distances_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    m = dense.from_numpy(spark, np.arange(20.0)[:, None])
    got = graph.pairwise_distances(m, 20).collect()
    assert len(got) == 190 and all(r.distance == r.j - r.i for r in got)


def test_adjacency(spark):
    g = gaussian_cliques()
    members = spark.createDataFrame([(k, int(c) if c >= 0 else None) for k, c in enumerate(g.clique)], "node int, clique int")
    pairs = {(r.row, r.col) for r in graph.clique_adjacency(members, "node", "clique").collect()}
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(g.adjacency))))


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_adjacency_of_odd_members(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    rows = [(k, "ab"[k % 7 > 2]) for k in range(60)] + [(5, "a"), (6, "b"), (6, "b"), (6, "a"), (None, "a"), (70, None), (None, None), (80, "alone")]
    got = [(r.row, r.col) for r in graph.clique_adjacency(spark.createDataFrame(rows, "node bigint, clique string"), "node", "clique").collect()]
    assert sorted(got) == sorted((i, j) for i, a in rows for j, b in rows if None not in (i, j, a, b) and a == b and i != j)


def test_adjacency_is_stored_in_blocks(spark, tmp_path):
    """What the query stores grows with the blocks of a clique, not with its pairs."""
    n = 3000
    spark.range(n).selectExpr("id AS vec_id", "array(1f) AS embedding", "int(id % 3000 >= 2990) AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = plans.clique_adjacency(spark, str(tmp_path))
    assert got.dtypes == [("row", "bigint"), ("col", "bigint"), ("value", "double")]
    stored = spark.read.parquet(*got.inputFiles())
    assert stored.count() <= 16
    row = got.where("value = 1.0").selectExpr("count(*) AS n", "count(DISTINCT row, col) AS pairs", "count_if(row = col) AS loops", "count_if((row >= 2990) <> (col >= 2990)) AS strange").first()
    assert tuple(row) == (2990 * 2989 + 90, 2990 * 2989 + 90, 0, 0)


def test_adjacency_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert plans.clique_adjacency(spark, str(tmp_path)).collect() == []


def test_no_python_and_pruned_columns(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0], 0, "x")], "vector array<double>, pos bigint, more string")
    df.write.parquet(str(tmp_path / "t"))
    plan = graph.row_norms(spark.read.parquet(str(tmp_path / "t")).where(F.col("pos") < 5))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "more" not in plan and "PushedFilters: [IsNotNull(pos), LessThan(pos,5)]" in plan
