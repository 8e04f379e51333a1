"""Logging set-up, and what the entry does without the corpus operators."""

import logging
import os
import subprocess
import sys

import pytest

from gridloom import logs
from gridloom.operators import sparse

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_logging_starts_once(monkeypatch):
    log = logging.getLogger("gridloom")
    before, level = list(log.handlers), log.level
    try:
        log.setLevel(logging.NOTSET)
        monkeypatch.setattr(log, "propagate", False)
        monkeypatch.setenv(logs.LEVEL, "warning")
        assert logs.start() is log and log.level == logging.WARNING
        assert logs.start("info").level == logging.INFO and logs.start().level == logging.INFO
        assert len(log.handlers) == max(1, len(before))
    finally:
        log.handlers[:] = before
        log.setLevel(level)


@pytest.mark.parametrize("fault, works", [("raise ModuleNotFoundError('gone', name='corpus_pipeline')", True), ("raise ImportError('gone', name='gridloom.llm')", True), ("import no_such_module", False), ("raise ImportError('broken')", False)])
def test_entry_hides_only_what_is_not_there(tmp_path, fault, works):
    code = (
        f"import sys, importlib.abc\nsys.path.insert(0, {ROOT!r})\n"
        "class Fault(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == 'corpus_pipeline':\n            {fault}\n"
        "sys.meta_path.insert(0, Fault())\n"
        "import __spark_entry__ as e\nq = e.queries()\nassert 'dense_roundtrip' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert (done.returncode == 0) == works, done.stderr


def test_csr_entries_of_a_popular_row(spark):
    rows = [(5, c, float(c)) for c in range(3000, 0, -1)] + [(2, 9, 1.0), (7, 1, 2.0), (7, 0, 3.0)]
    got = {(r.row, r.nth): (r.col, r.value) for r in sparse.csr_entries(spark.createDataFrame(rows, "row long, col long, value double").repartition(5)).collect()}
    want, seen = {}, {}
    for r, c, v in sorted(rows):
        want[r, seen.setdefault(r, 0)] = (c, v)
        seen[r] += 1
    assert got == want
    assert sparse.csr_entries(spark.createDataFrame([], "row long, col long, value double")).count() == 0
