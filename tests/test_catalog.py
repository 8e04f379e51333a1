import json

import pytest

from gridloom import catalog as cat
from gridloom.errors import CatalogError, UnknownKey
from gridloom.store import Store, read_catalog


def full():
    return (
        cat.Catalog("run", 500, 128, "/base", created_at="2024-01-01T00:00:00+00:00")
        .with_entry("rawinput", cat.Entry.of("run", "rawinput", "dense", 500, 128))
        .with_entry("lambdas", cat.Entry.of("run", "lambdas", "vector", 500, 1, size_bytes=65536))
    )


def test_round_trip_by_store_and_by_path(spark, tmp_path):
    store = Store(spark, str(tmp_path), "run")
    path = store.save_catalog(full())
    assert store.catalog() == read_catalog(spark, path) == full()
    assert "\n" in (tmp_path / "run_metadata.json").read_text()  # readable


def test_empty_and_sparse_entries(spark, tmp_path):
    store = Store(spark, str(tmp_path), "e")
    store.save_catalog(cat.Catalog("e"))
    assert store.catalog().files == {} and store.catalog().nrows == 0
    store.save_catalog(cat.Catalog("e", 1000, 1000).with_entry("laplacian", cat.Entry.of("e", "laplacian", "sparse", 1000, 1000, 5000, 120000)))
    entry = store.catalog().files["laplacian"]
    assert (entry.nnz, entry.size_bytes, entry.filetype) == (5000, 120000, "sparse")
    assert store.listing().select("key", "nnz").collect() == [("laplacian", 5000)]


def test_seed_writes_dimensions_and_rawinput(spark, tmp_path):
    store = Store(spark, str(tmp_path / "new" / "deep"), "s")
    store.seed(1000, 256)
    found = store.catalog()
    assert (found.nrows, found.ncols, found.files["rawinput"].rows, found.files["rawinput"].cols) == (1000, 256, 1000, 256)
    store.seed(5, 6)
    assert store.catalog().nrows == 5


def test_unknown_fields_pass_and_optional_ones_may_be_absent():
    data = json.loads(full().to_json())
    data["later"] = 1
    data["files"]["rawinput"]["later"] = 2
    del data["files"]["rawinput"]["nnz"]
    assert cat.Catalog.from_json(json.dumps(data)) == full()


@pytest.mark.parametrize("text", ["", "{", "[]", "{}", '{"files": {"a": {}}, "name_id": "x"}', '{"files": 3, "name_id": "x"}'])
def test_bad_catalogs(text):
    with pytest.raises(CatalogError):
        cat.Catalog.from_json(text)


def test_registries():
    assert cat.kind_of("sub_centroids") == "dense" and cat.kind_of("signals") == "sparse" and cat.kind_of("norms") == "vector"
    for f in (cat.kind_of, cat.storage_format):
        with pytest.raises(UnknownKey):
            f("nothing")
