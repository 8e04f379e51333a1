"""A store: a folder with a catalog and one Parquet table for each artifact."""

from __future__ import annotations

import logging
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom import catalog as cat
from gridloom.errors import AlreadyExists, AmbiguousStore, CatalogError, NotFound, NotInitialized, SchemaMismatch, UnknownKey
from gridloom.functions.checks import check_dense, check_sparse, check_sparse_blocks, check_vector
from gridloom.operators import dense, sparse, vectors
from gridloom.sources.files import Files

_NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]*")
_SUFFIX = "_metadata.json"
log = logging.getLogger(__name__)


class Store:
    """Artifacts under ``base``; several stores of different names can share a folder.

    Data is written beside its place, moved there, and only then catalogued, so a failed
    write leaves neither half an artifact nor an entry without one; what it was to replace is
    put back. The move and the catalog's change are made under a lock file, so saves at the
    same time all end up in the catalog.
    """

    def __init__(self, spark: SparkSession, base: str, name: str):
        if not _NAME.fullmatch(name):
            raise CatalogError(f"a store's name is letters, digits, '.', '_' and '-': {name!r}")
        self.spark, self.base, self.name = spark, str(base).rstrip("/") or "/", name
        self._files = Files(spark, self.base)

    # --- lifecycle and paths

    @classmethod
    def find(cls, spark: SparkSession, base: str) -> list[str]:
        """Names of the stores in a folder."""
        files = Files(spark, str(base))
        return [n[: -len(_SUFFIX)] for n in files.names(str(base)) if n.endswith(_SUFFIX)] if files.is_folder(str(base)) else []

    @classmethod
    def exists(cls, spark: SparkSession, base: str) -> bool:
        return bool(cls.find(spark, base))

    @classmethod
    def open(cls, spark: SparkSession, base: str, name: str | None = None) -> Store:
        found = cls.find(spark, base)
        if not found or name is not None and name not in found:
            raise NotInitialized(f"no catalog {'of ' + name if name else ''} in {base}")
        if name is None and len(found) > 1:
            raise AmbiguousStore(f"{base} holds {', '.join(found)}")
        store = cls(spark, base, name or found[0])
        store.catalog()
        return store

    def seed(self, nrows: int, ncols: int) -> cat.Catalog:
        """Write a new catalog with the raw input's dimensions; an old one is replaced."""
        fresh = cat.Catalog(self.name).with_base(self.base).with_dimensions(nrows, ncols).with_entry("rawinput", cat.Entry.of(self.name, "rawinput", "dense", nrows, ncols))
        self.save_catalog(fresh)
        return fresh

    @property
    def catalog_path(self) -> str:
        return f"{self.base}/{self.name}{_SUFFIX}"

    @property
    def base_uri(self) -> str:
        return self._files.qualified(self.base)

    def path(self, key: str) -> str:
        if not _NAME.fullmatch(key):
            raise UnknownKey(f"a key is letters, digits, '.', '_' and '-': {key!r}")
        return f"{self.base}/{cat.artifact_name(self.name, key)}"

    def uri(self, key: str) -> str:
        return self._files.qualified(self.path(key))

    def save_catalog(self, catalog: cat.Catalog) -> str:
        if catalog.name_id != self.name:
            raise CatalogError(f"a catalog of {catalog.name_id!r} in a store of {self.name!r}")
        self._files.make_folder(self.base)
        self._files.write_text(self.catalog_path, catalog.to_json())
        return self.catalog_path

    def catalog(self) -> cat.Catalog:
        if not self._files.exists(self.catalog_path):
            raise NotInitialized(f"no catalog at {self.catalog_path}")
        found = read_catalog(self.spark, self.catalog_path)
        if found.name_id != self.name:
            raise CatalogError(f"{self.catalog_path} is of {found.name_id!r}")
        return found

    def listing(self) -> DataFrame:
        self.catalog()
        return cat.listing(self.spark, self.catalog_path)

    # --- writing and reading

    def _write(self, key: str, df: DataFrame, kind: str, rows: int, cols: int, nnz: int | None, overwrite: bool, form: str | None = None) -> None:
        path, mark = self.path(key), uuid.uuid4().hex
        staged, aside = f"{self.base}/_staged-{mark}", f"{self.base}/_replaced-{mark}"
        try:
            df.write.parquet(staged)
            size = self._files.size(staged)
            with self._files.locked(f"{self.catalog_path}.lock"):
                known = self.catalog()  # as it is now: others may have saved meanwhile
                if self._files.exists(path):
                    if not overwrite:
                        raise AlreadyExists(path)
                    self._files.move(path, aside)
                try:
                    self._files.move(staged, path)
                    self.save_catalog(known.with_entry(key, cat.Entry.of(self.name, key, kind, rows, cols, nnz, size, form)))
                except BaseException:
                    self._files.delete(path)
                    if self._files.exists(aside):
                        self._files.move(aside, path)
                    raise
        finally:
            self._files.delete(staged)
        self._files.delete(aside)
        log.info("saved %s: %s, %d x %d, %d bytes", path, kind, rows, cols, size)

    def _may_write(self, key: str, kind: str, overwrite: bool) -> None:
        self.catalog()
        bound = cat.KIND_OF_KEY.get(key)
        if bound not in (None, kind):
            raise UnknownKey(f"{key!r} is {bound}, not {kind}")
        if not overwrite and self._files.exists(self.path(key)):
            raise AlreadyExists(self.path(key))

    def _read(self, key: str) -> DataFrame:
        if not self._files.exists(self.path(key)):
            raise NotFound(self.path(key))
        return self.spark.read.parquet(self.path(key))

    def _entry(self, key: str) -> cat.Entry:
        try:
            return self.catalog().files[key]
        except KeyError:
            raise UnknownKey(f"{key!r} is not in the catalog") from None

    def save_dense(self, key: str, df: DataFrame, *order: str, vector: str = "vector", overwrite: bool = False) -> None:
        self._may_write(key, "dense", overwrite)
        encoded = dense.encode(df, vector, *order)
        shape = check_dense(encoded)
        self._write(key, encoded, "dense", shape.rows, shape.cols, None, overwrite)

    def load_dense(self, key: str) -> DataFrame:
        """``vector, pos``. The number of rows (from file footers) must be the catalog's."""
        found, entry = dense.decode(self._read(key)), self.catalog().files.get(key)
        if entry is not None and entry.rows != (n := found.count()):
            raise SchemaMismatch(f"{key}: {n} rows, catalogued as {entry.rows}")
        return found

    def save_sparse(self, key: str, df: DataFrame, rows: int, cols: int, *, overwrite: bool = False) -> None:
        self._may_write_sparse(key, overwrite)
        n = check_sparse(df, rows, cols)
        self._write(key, sparse.encode(df, rows, cols, n), "sparse", rows, cols, n, overwrite)

    def save_sparse_blocks(self, key: str, df: DataFrame, rows: int, cols: int, *, overwrite: bool = False) -> None:
        """Save a sparse matrix given as blocks (see ``operators.sparse``) in that form; ``load_sparse`` returns its entries."""
        self._may_write_sparse(key, overwrite)
        n = check_sparse_blocks(df, rows, cols)
        self._write(key, sparse.encode_blocks(df, rows, cols, n), "sparse", rows, cols, n, overwrite, cat.BLOCKS)

    def _may_write_sparse(self, key: str, overwrite: bool) -> None:
        if cat.kind_of(key) != "sparse":
            raise UnknownKey(f"{key!r} is {cat.kind_of(key)}, not sparse")
        self._may_write(key, "sparse", overwrite)

    def load_sparse(self, key: str, *, consolidated: bool = True) -> DataFrame:
        """``row, col, value``; duplicates summed unless told otherwise."""
        if cat.kind_of(key) != "sparse":
            raise UnknownKey(f"{key!r} is {cat.kind_of(key)}, not sparse")
        entry = self._entry(key)
        if entry.storage_format == cat.BLOCKS:
            return sparse.decode_blocks(self._read(key), entry.rows, entry.cols, entry.nnz, consolidated=consolidated)
        return sparse.decode(self._read(key), entry.rows, entry.cols, consolidated=consolidated)

    def save_subcentroids(self, df: DataFrame, *order: str, vector: str = "vector", overwrite: bool = False) -> None:
        self.save_dense("sub_centroids", df, *order, vector=vector, overwrite=overwrite)

    def load_subcentroids(self) -> list[list[float]]:
        return dense.to_rows(self.load_dense("sub_centroids"))

    def save_vector(self, kind: str, df: DataFrame, column: str, *order: str, key: str | None = None, wrap: bool = False, overwrite: bool = False) -> None:
        """Save a vector of one of ``vectors.KINDS``; ``key`` is for those kinds that have none of their own."""
        spec = vectors.kind(kind)
        key = self._vector_key(kind, spec, key)
        self._may_write(key, "vector", overwrite)
        encoded = vectors.encode(df, spec, column, *order, wrap=wrap)
        n = check_vector(encoded, spec.column, ids=spec.ids, nullable=spec.optional)
        self._write(key, encoded, "vector", n, 1, None, overwrite)

    def load_vector(self, kind: str, *, key: str | None = None) -> DataFrame:
        """``<column of the kind>, pos``. Any stored vector of the same type can be read as any kind."""
        spec = vectors.kind(kind)
        return vectors.decode(self._read(self._vector_key(kind, spec, key)), spec)

    @staticmethod
    def _vector_key(kind: str, spec: vectors.VectorKind, key: str | None) -> str:
        if key is None and spec.key is None:
            raise UnknownKey(f"a {kind} vector needs a key")
        return key or spec.key


def read_catalog(spark: SparkSession, path: str) -> cat.Catalog:
    """A catalog by path."""
    files = Files(spark, path)
    if not files.exists(path):
        raise NotFound(path)
    return cat.Catalog.from_json(files.read_text(path))
