"""The catalog: one JSON document that says what a store holds."""

from __future__ import annotations

import dataclasses
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import CatalogError, UnknownKey

# Kinds of artifacts with their storage form, and the keys bound to a kind.
STORAGE_FORMAT = {"dense": "parquet rows", "sparse": "parquet triplets", "vector": "parquet column"}
BLOCKS = "parquet blocks"  # the other form of a sparse matrix
KIND_OF_KEY = {
    "rawinput": "dense",
    "sub_centroids": "dense",
    "adjacency": "sparse",
    "laplacian": "sparse",
    "signals": "sparse",
    "lambdas": "vector",
    "item_norms": "vector",
    "norms": "vector",
}

SCHEMA = (
    "name_id string, nrows bigint, ncols bigint, base string, "
    "files map<string, struct<filename string, filetype string, storage_format string, rows bigint, cols bigint, nnz bigint, size_bytes bigint>>, "
    "created_at string"
)


def storage_format(kind: str) -> str:
    try:
        return STORAGE_FORMAT[kind]
    except KeyError:
        raise UnknownKey(f"no kind {kind!r}; there are {', '.join(STORAGE_FORMAT)}") from None


def kind_of(key: str) -> str:
    try:
        return KIND_OF_KEY[key]
    except KeyError:
        raise UnknownKey(f"key {key!r} has no kind; those that have: {', '.join(KIND_OF_KEY)}") from None


def artifact_name(store: str, key: str) -> str:
    return f"{store}_{key}.parquet"


@dataclasses.dataclass(frozen=True)
class Entry:
    """What the catalog says about one artifact."""

    filename: str
    filetype: str
    storage_format: str
    rows: int
    cols: int
    nnz: int | None = None
    size_bytes: int | None = None

    @classmethod
    def of(cls, store: str, key: str, kind: str, rows: int, cols: int, nnz: int | None = None, size_bytes: int | None = None, form: str | None = None) -> Entry:
        return cls(artifact_name(store, key), kind, form or storage_format(kind), rows, cols, nnz, size_bytes)


@dataclasses.dataclass(frozen=True)
class Catalog:
    name_id: str
    nrows: int = 0
    ncols: int = 0
    base: str = ""
    files: dict[str, Entry] = dataclasses.field(default_factory=dict)
    created_at: str = dataclasses.field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def with_base(self, base: str) -> Catalog:
        return dataclasses.replace(self, base=base)

    def with_dimensions(self, nrows: int, ncols: int) -> Catalog:
        return dataclasses.replace(self, nrows=nrows, ncols=ncols)

    def with_entry(self, key: str, entry: Entry) -> Catalog:
        return dataclasses.replace(self, files={**self.files, key: entry})

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        """Unknown fields are passed over; absent optional ones are None."""
        try:
            data = json.loads(text)
            pick = lambda kind, d: {f.name: d[f.name] for f in dataclasses.fields(kind) if f.name in d}
            files = {k: Entry(**pick(Entry, v)) for k, v in data["files"].items()}
            return cls(**pick(cls, data) | {"files": files})
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise CatalogError(f"not a catalog: {e}") from e


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a catalog file as rows ``key, filename, filetype, ...``."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.explode("files").alias("key", "entry")).select("key", "entry.*")
