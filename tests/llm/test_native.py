"""Mixing and line dedup against plain Python, with odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import line_dedup, mixing

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, source string, size string, rank string, key string, keep string"


def rows_of(n, seed, texts):
    rng = random.Random(seed)
    return [(i, rng.choice(texts), rng.choice(["a", "a", "a", "b", None, "é"]), "x", "x", "x", "x") for i in range(n)]


TEXTS = ["", None, " \t ", "one", "one two\x0bthree", "w " * 400, "a b c d e f g", "zwölf ½ words"]


def test_mixing_counts_words_and_meets_targets(spark):
    rows = rows_of(3000, 1, TEXTS + ["w " * k for k in range(1, 120)])
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for i, text, source, *_ in rows:
        n = len([w for w in "".join(" " if c in BLANK else c for c in text or "").split(" ") if w])
        assert got[i].size == n and got[i].taken in (0, n, 2 * n, 3 * n)
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + got[i].taken
    targets = water_fill(sizes)
    for r in got.values():
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.02 * sizes[s] + 400, s


def water_fill(sizes, weights=(5, 2, 1)):
    """The rule as it is stated: share, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1}, {"a": 0, "b": 5}, {"a": 1, "b": 1, "c": 1000, "d": 0, None: 3}, {"a": 0}, {"a": 7}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_mixing_is_the_same_again_and_elsewhere(spark):
    df = spark.createDataFrame(rows_of(500, 2, TEXTS), SCHEMA)
    a, b = ({(r.doc_id, r.taken, r.target) for r in mixing.mix(d).collect()} for d in (df, df.repartition(7)))
    assert a == b
    drawn = mixing.emit(df, mixing.mix(df))
    assert drawn.columns == df.columns and drawn.count() == mixing.mix(df).agg(F.sum("copies")).first()[0]


def test_mixing_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    rows = [(1, "a b", "s", *"xxxx")] * 5 + [(None, "a", None, *"xxxx")]
    assert mixing.mix(spark.createDataFrame(rows, SCHEMA)).count() == 6


LINES = ["", "short", "  A Longer LINE \t", "a longer line", "Ä longer LINE", "ä longer line", "x" * 5000, "tenletters", "nineletrs", "\x0bA longer line\x0c", "a longer line two"]


def test_line_dedup_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(LINES + [f"line number {rng.randrange(99)} here"]) for _ in range(rng.randrange(0, 90))) if rng.random() > 0.1 else rng.choice([None, "", "\n", "\n\n"]), "s", *"xxxx") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANK).translate(lower)
    first = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), i), i)
    got = {r.doc_id: r for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_line_dedup_hot_line_and_empty(spark):
    rows = [(i, "the very same line\nown line number %d" % i, "s", *"xxxx") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.keep_bitmaps(df).collect()
    assert len(got) == 2999 and all(r.n_dropped == 1 and r.doc_id > 0 for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_no_python_and_no_second_exchange_for_the_stream(spark):
    df = spark.createDataFrame([(1, "a line that counts", "s", *"xxxx")], SCHEMA)
    plan = line_dedup.keep_bitmaps(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange rangepartitioning") == 1
    assert hashlib.sha256(b"").hexdigest() == df.select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


def test_null_ids(spark):
    rows = [(None, "the very same line", "s", *"xxxx"), (4, "the very same line", "s", *"xxxx"), (2, "the very same line", None, *"xxxx")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect()}
    assert got == {None: (0, rows[0][1]), 2: (0, rows[0][1]), 4: (1, "")}
    assert mixing.emit(df, mixing.mix(df)).count() > 0


def test_bitmaps_of_long_documents(spark):
    """Words of the bitmap that lose nothing lie between, before and after those that do."""
    rng = random.Random(5)
    common = [f"a common line {k}" for k in range(40)]
    own = lambda d, n: [f"line {k} of document {d}" for k in range(n)]
    rows = [(0, "\n".join(common))]
    for d, n in ((1, 700), (2, 64), (3, 65), (4, 3000), (5, 63)):
        lines = own(d, n)
        for k in rng.sample(range(n), 9) + [n - 1]:
            lines[k] = rng.choice(common)
        rows.append((d, "\n".join(lines)))
    rows.append((6, "\n".join(common)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    for d, text in rows:
        left = [x for x in text.split("\n") if d == 0 or x not in common]
        assert got[d].text == "\n".join(left) and got[d].n_lines == text.count("\n") + 1 and got[d].n_dropped == text.count("\n") + 1 - len(left)
    words = {r.doc_id: len(r.keep) for r in line_dedup.keep_bitmaps(docs).collect()}
    assert words[4] == 47 and words[2] == 1 and words[3] == 2


def test_line_counts_beside_columns_of_their_name(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one long line here", 7, "x"), (2, "one long line here\nb", 8, "y")], "doc_id long, text string, n_lines int, n_dropped string")
    for limit in (0, 1 << 20):  # joined by id and by broadcast
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
        out = line_dedup.deduplicated(docs)
        assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "n_lines_", "n_dropped_"]
        assert sorted(map(tuple, out.collect())) == [(1, "one long line here", 7, "x", 1, 0), (2, "b", 8, "y", 2, 1)]


def test_mixing_segments_do_not_follow_the_ids(spark):
    rows = [(64 * k, f"w {k}", "s", *"xxxx") for k in range(600)] + [(None, f"v {k}", "s", *"xxxx") for k in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 1200 and got.agg(F.sum("taken")).first()[0] == 2400
