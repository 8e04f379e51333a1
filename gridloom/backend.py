"""What a store of any format offers; ``store.Store`` is the one of Parquet folders."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from gridloom.catalog import Catalog


@runtime_checkable
class StorageBackend(Protocol):
    """Code that takes one of these works with every format that has these methods."""

    base: str
    name: str

    def seed(self, nrows: int, ncols: int) -> Catalog: ...

    def catalog(self) -> Catalog: ...

    def save_catalog(self, catalog: Catalog) -> str: ...

    def path(self, key: str) -> str: ...

    def uri(self, key: str) -> str: ...

    def save_dense(self, key: str, df: DataFrame, *order: str, vector: str = "vector", overwrite: bool = False) -> None: ...

    def load_dense(self, key: str) -> DataFrame: ...

    def save_sparse(self, key: str, df: DataFrame, rows: int, cols: int, *, overwrite: bool = False) -> None: ...

    def load_sparse(self, key: str, *, consolidated: bool = True) -> DataFrame: ...

    def save_vector(self, kind: str, df: DataFrame, column: str, *order: str, key: str | None = None, wrap: bool = False, overwrite: bool = False) -> None: ...

    def load_vector(self, kind: str, *, key: str | None = None) -> DataFrame: ...
