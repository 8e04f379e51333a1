"""The learned operators: odd rows, invented languages and labels, agreement with slow plain versions."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, lm_score, quality, toxicity
from gridloom.llm.textcodes import word_batches

SCHEMA = "doc_id long, text string, lang string, score string, label string, n int, __quality string"
ODD = ["", None, "   \n ", "1234 !!", "x" * 200_000, "a", "ÀÉ ж 漢字 🙂"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "l", 1, "q") for i, t, lang in rows], SCHEMA)


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues():
    return {"xx": ["ka", "lo", "mi", "tu"], "yy": ["ber", "schö", "ung", "ich"], "zz": ["eau", "oui", "çon", "ré"]}


def test_languages(spark, tongues):
    rng = np.random.default_rng(0)
    rows = [(i, speech(rng, tongues[lang], 60), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    langs, logp = langid.train(frame(spark, [*rows, (900, None, "xx"), (901, "who knows", None), (902, "", "yy")]).select("text", "lang"))
    assert langs == ["xx", "yy", "zz"] and np.isfinite(logp).all()
    new = [(i, speech(rng, tongues[lang], 30), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 20)]
    mixed = [(1000, speech(rng, tongues["xx"], 120) + " " + speech(rng, tongues["zz"], 60), None)]
    odd = [(2000 + k, t, "xx") for k, t in enumerate(ODD)] + [(2001, None, None)]
    got = langid.identify(frame(spark, new + mixed + odd), langs, logp).collect()
    assert len(got) == len(new) + 1 + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang and 0.5 < by[i].score <= 1 for i, _, lang in new)
    assert by[1000].lang_pred == "xx" and set(by[1000].langs) == {"xx", "zz"} and abs(dict(zip(by[1000].langs, by[1000].shares))["xx"] - 2 / 3) < 0.1
    assert [by[2000 + k].lang_pred for k in (0, 1, 2, 3)] == ["und"] * 4 and by[2000].score == 0
    assert by[2004].lang_pred != "und" and by[2006].lang_pred != "und"


def test_a_text_can_have_all_languages():
    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.full(1 << langid.BITS, 0.02), 5) + 1e-12).astype(np.float32)
    (words,) = word_batches([" ".join(f"{k}{chr(97 + k % 26)}x" for k in range(1000)), "one", ""])
    pick, _, _ = langid._distinct(words)
    bucket, begin = langid._grams(words, pick)
    for k, (x, y) in enumerate(zip(begin, np.append(begin[1:], len(bucket)))):
        logp[:, bucket[x:y]] = -20
    for k, (x, y) in enumerate(zip(begin, np.append(begin[1:], len(bucket)))):
        logp[k % 5, bucket[x:y]] = -2
    theta = langid.infer(words, logp)
    assert (theta[0] > 0.05).all() and abs(theta[0].sum() - 1) < 1e-3
    assert (theta[1] > 0.001).sum() == 1 and not theta[2].any()


def test_em_matches_a_plain_version():
    rng = np.random.default_rng(1)
    like, weight = rng.random((7, 3)).astype(np.float32), np.array([1, 2, 1, 5, 1, 1, 3], np.float32)
    doc, begin = np.array([0, 0, 0, 1, 1, 1, 1]), np.array([0, 3])
    got, _ = langid._em(like, weight, doc, begin, np.full((2, 3), 1 / 3, np.float32), 5)
    for d, rows in ((0, range(3)), (1, range(3, 7))):
        theta = np.full(3, 1 / 3)
        for _ in range(5):
            theta = sum(weight[r] * like[r] * theta / (like[r] @ theta) for r in rows) / sum(weight[r] for r in rows)
        assert np.allclose(got[d], theta, atol=1e-5)


def plain_words(text):
    return re.findall(rb"[^ \t-\r]+", (text or "").encode().lower())


def plain_buckets(word):
    padded = b" " + word + b" "
    grams = [padded[k : k + 4].ljust(4) for k in range(max(len(word) - 1, 1))]
    return [(int.from_bytes(g, "little") * 0x9E3779B1 % 2**32) >> (32 - langid.BITS) for g in grams]


def plain_mixture(text, logp):
    counts = collections.Counter(plain_words(text))
    like, total, k = {}, sum(counts.values()), len(logp)
    for w in counts:
        v = sum(logp[:, b].astype(float) for b in plain_buckets(w))
        like[w] = np.exp(np.maximum(v - v.max(), -30))

    def em(theta, rounds):
        for _ in range(rounds):
            theta = sum(n * like[w] * theta / (like[w] @ theta) for w, n in counts.items()) / total
        return theta, sum(n * np.log(like[w] @ theta) for w, n in counts.items())

    order = np.argsort(-em(np.full(k, 1 / k), langid.ROUNDS)[0], kind="stable")
    fits = []
    for size in range(1, k + 1):
        start = np.zeros(k)
        start[order[:size]] = 1 / size
        theta, fit = em(start, langid.SET_ROUNDS)
        fits.append((fit - langid.PENALTY * size, -size, theta))
    return max(fits, key=lambda f: f[:2])[2]


def test_languages_against_a_plain_version(spark, tongues):
    """Counts of grams, likelihoods, proportions and the choice of the set, for any split of the table."""
    rng = np.random.default_rng(9)
    text = lambda lang, n: " ".join(w if rng.random() < 0.8 else str(rng.choice(["a", "o", "é", "I", "7"])) for w in speech(rng, tongues[lang], n).split(" "))
    known = [(i, text(lang, 40), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 15)] + [(99, None, "xx"), (98, "", "zz"), (97, "left out", None)]
    new = [(100 + i, text(lang, 9), None) for i, lang in enumerate(["xx", "yy", "zz"] * 6)]
    new += [(200 + i, text("xx", 30) + " " + text("zz", 4 * i) + "\n" + text("yy", i), None) for i in range(9)]
    new += [(250, text("xx", 30) + " " + text("zz", 25), None), (251, text("yy", 9) + " " + text("zz", 30), None)]
    new += [(300 + k, t, None) for k, t in enumerate(ODD)] + [(100, new[0][1], None), (None, "ka lo", None)]
    counts = np.zeros((3, 1 << langid.BITS))
    for _, t, lang in known:
        for w in plain_words(t) if lang else []:
            for b in plain_buckets(w):
                counts[["xx", "yy", "zz"].index(lang), b] += 1
    want = np.log((counts + langid.SMOOTH) / (counts.sum(1, keepdims=True) + langid.SMOOTH * counts.shape[1]))
    sizes = set()
    for n in (1, 5):
        langs, logp = langid.train(frame(spark, known).repartition(n).select("text", "lang"))
        assert langs == ["xx", "yy", "zz"] and np.allclose(logp, want, atol=1e-5)
        got = langid.identify(frame(spark, new).repartition(n), langs, logp).collect()
        texts = {i: t for i, t, _ in new}
        assert len(got) == len(new) and {r.doc_id for r in got} == set(texts)
        for r in got:
            t = texts[r.doc_id]
            if not re.search(r"[^\W\d_]", t or ""):
                assert (r.lang_pred, r.score, r.langs) == ("und", 0.0, [])
                continue
            theta = plain_mixture(t, want)
            assert abs(r.score - theta.max()) < 1e-3 and (theta.max() < 0.51 or r.lang_pred == langs[theta.argmax()])
            assert np.allclose([dict(zip(r.langs, r.shares)).get(x, 0) for x in langs], theta, atol=2e-3)
            sizes.add(len(r.langs))
    assert sizes == {1, 2, 3}


def test_toxicity_against_a_plain_version(spark):
    """Features by name instead of by hash, one document after the other."""
    rng = np.random.default_rng(10)
    vocabulary = [f"w{k}" for k in range(12)]
    rows = [(i, ", ".join(rng.choice(vocabulary, rng.integers(1, 15))).replace("w3", "W3!"), None) for i in range(250)]
    labels = [(i, int("w3" in t.lower().split(", ")[0] or "w5, w6" in t)) for i, t, _ in rows if i % 3] + [(1, None), (None, 1), (5000, 1)]
    rows += [(5000 + k, t, None) for k, t in enumerate(ODD)] + [(4, rows[4][1], None), (None, "w3 w5", None)]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")

    def features(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return {(None, w) for w in words} | {(g, a, b) for g in toxicity.GAPS for a, b in zip(words, words[g + 1 :])}

    of = {i: y for i, y in labels if i is not None and y is not None}
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in of], "doc_id long").orderBy(F.xxhash64(F.lit("order"), "doc_id")).collect()]
    texts = {i: t for i, t, _ in rows}
    z, n, bias, bias_n = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    weight = lambda f: 0.0 if abs(z[f]) <= toxicity.L1 else -(z[f] - np.sign(z[f]) * toxicity.L1) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for i in order * toxicity.EPOCHS:
        w = {f: weight(f) for f in features(texts[i])}
        g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - of[i]
        for f in w:
            z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / toxicity.ALPHA * w[f]
            n[f] += g * g
        bias_n += g * g
        bias -= toxicity.ALPHA / (toxicity.BETA + bias_n**0.5) * g
    want = {i: 1 / (1 + np.exp(-(sum(map(weight, features(t))) + bias))) for i, t in texts.items()}
    got = toxicity.score(docs.repartition(3), toxicity.train(toxicity.labelled_sample(docs, known, "toxic", 1000))).collect()
    assert len(got) == len(rows) and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-4
    assert max(want.values()) - min(want.values()) > 0.5


def test_quality_against_a_plain_version(spark):
    """Terms by name, an exact decomposition, and a vote over all labelled documents."""
    rng = np.random.default_rng(11)
    vocabulary = [f"{w}{k}{m}" for k, (w, m) in enumerate(zip(["run", "Tree", "BIG", "x"] * 15, ["", ",", "!!", "%$", "-"] * 12))]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 60))), None) for i in range(75)]
    labels = [(i, int(rng.random() < 0.6)) for i in range(75)] + [(7, None), (None, 1)]
    rows += [(900 + k, t, None) for k, t in enumerate(ODD)] + [(4, rows[4][1], None), (None, "run BIG", None)]
    docs = frame(spark, rows)

    def kinds(word):
        name = lambda b: "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
        return re.sub(r"(.)\1+", r"\1", "".join(map(name, word)))

    def terms(text):
        out = np.zeros(quality.DIMS)
        words = re.findall(rb"[^ \t-\r]+", (text or "").encode())
        for w in words:
            (own,), (shape,) = word_batches([w.decode()]), word_batches([kinds(w)])
            out[int(own.hashes[0] % np.uint64(quality.WORD_DIMS))] += 1
            out[quality.WORD_DIMS + int(quality._shapes(shape)[0] % np.uint64(quality.SHAPE_DIMS))] += 1
        if words:
            tally, n = quality.WORD_DIMS + quality.SHAPE_DIMS, len(words)
            out[tally + min(int(len({w.lower() for w in words}) / n * 16), 15)] = n**0.5
            out[tally + 16 + min(int(np.log2(n)), 15)] = 1
        return out

    every = [(i, terms(t)) for i, t, _ in rows]
    idf = np.log((len(rows) + 1) / (sum(c > 0 for _, c in every) + 1)) + 0.1
    idf[quality.WORD_DIMS :] *= quality.SHAPE_WEIGHT
    unit = lambda x: x / max(np.sqrt((x * x).sum()), 1e-12)
    weighed = [(i, unit(np.log1p(c) * idf)) for i, c in every]
    of = {i: y for i, y in labels if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5}
    assert quality.NEIGHBOURS < len(of) <= quality.RANK
    known = {i: x for i, x in weighed if i in of}
    _, _, v = np.linalg.svd(np.stack([*known.values()]), full_matrices=False)
    vectors = {i: unit(v @ x) for i, x in known.items()}
    want = {}
    for i, x in weighed:
        near = sorted(((unit(v @ x) @ y, of[j]) for j, y in vectors.items()), reverse=True)[: quality.NEIGHBOURS]
        total = sum(max(s, 0) for s, _ in near)
        want[i] = sum(max(s, 0) * y for s, y in near) / total if total > 1e-9 else np.mean([*of.values()])
    got = quality.train_and_score(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 2e-3, r


@pytest.mark.parametrize("operator", ["languages", "toxicity", "quality"])
def test_empty_tables(spark, operator):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    if operator == "languages":
        assert langid.identify(none, *langid.train(none)).count() == 0
    elif operator == "toxicity":
        assert toxicity.score(none, toxicity.train(toxicity.labelled_sample(none, labels, "toxic", 10))).count() == 0
    else:
        assert quality.train_and_score(none, labels).count() == 0 and quality.accepted(none, labels).count() == 0


def test_without_anything_to_learn(spark):
    docs = frame(spark, [(k, t, None) for k, t in enumerate(ODD)])
    langs, logp = langid.train(docs.select("text", "lang"))
    assert {r.lang_pred for r in langid.identify(docs, langs, logp).collect()} == {"und"}
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.train(toxicity.labelled_sample(docs, labels, "toxic", 10)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert {r.score for r in quality.train_and_score(docs, labels).collect()} == {0.0}
    assert quality.accepted(docs, labels).count() == len(ODD)


@pytest.mark.parametrize("operator", ["toxicity", "quality"])
def test_classifiers_learn_and_take_odd_rows(spark, operator):
    rng = np.random.default_rng(2)
    common = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(common, 60))
        bad = i % 4 == 0
        if bad and operator == "toxicity":
            words[rng.integers(60)] = "grumph,"
            words[rng.integers(60)] = "SNORK!"
        if bad and operator == "quality":
            words = [w.upper() + "!!$" for w in words]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(bad if operator == "toxicity" else not bad)))
    odd = [(5000 + k, t, None) for k, t in enumerate(ODD)] + [(None, "no id", None), (3, rows[3][1], None)]
    docs = frame(spark, rows + odd)
    name = {"toxicity": "toxic", "quality": "quality"}[operator]
    known = spark.createDataFrame(labels + [(0, None)], f"doc_id long, {name} int")
    if operator == "toxicity":
        scored = toxicity.score(docs, toxicity.train(toxicity.labelled_sample(docs, known.where("doc_id % 5 != 0"), "toxic", 1000)))
    else:
        scored = quality.train_and_score(docs, known)
    got = scored.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [i for i in range(600) if i % 5 == 0]
    right = np.mean([(by[i] >= 0.5) == bool(labels[i][1]) for i in held])
    assert right > 0.95
    assert scored.where("doc_id = 3").select("score").distinct().count() == 1


def test_labelled_sample_is_bounded_by_rows_and_bytes(spark):
    rows = [(i, "x" * (1000 if i % 3 else 10), None) for i in range(60)] + [(7, "another text of 7", None), (61, None, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(62)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    every = toxicity.labelled_sample(docs, labels, "toxic", 100).collect()
    assert sorted(r.doc_id for r in every) == [*range(60), 61]
    assert len(toxicity.labelled_sample(docs, labels, "toxic", 20).collect()) == 20
    seen = set()
    for n in (1, 5):
        some = toxicity.labelled_sample(docs.repartition(n), labels, "toxic", 100, most_bytes=15_000).collect()
        assert 10_000 < sum(len(r.text or "") for r in some) <= 15_000
        seen.add(tuple(sorted((r.doc_id, r.text) for r in some if r.text)))
    assert len(seen) == 1


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(4)
    model = toxicity.FTRL(50, alpha=0.5, l1=0.1)
    z, n, bias, bias_n = np.zeros(50), np.zeros(50), 0.0, 0.0
    for _ in range(200):
        at, y = np.unique(rng.integers(0, 50, 5)), int(rng.random() < 0.3)
        w = [0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1 + n[i] ** 0.5) / 0.5 + 1) for i in at]
        g = 1 / (1 + np.exp(-(sum(w) + bias))) - y
        for i, wi in zip(at, w):
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * wi
            n[i] += g * g
        bias_n += g * g
        bias -= 0.5 / (1 + bias_n**0.5) * g
        model.learn(at, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and abs(model.bias - bias) < 1e-9


def test_vote_is_exact():
    rng = np.random.default_rng(5)
    known, x, labels = (quality._unit(rng.standard_normal(s)) for s in ((200, 8), (30, 8), (1, 1)))
    labels = (rng.random(200) < 0.7).astype(float)
    got = quality.vote(x, known, labels, 9)
    for row, p in zip(x, got):
        near = sorted(range(200), key=lambda k: -(row @ known[k]))[:9]
        w = [max(row @ known[k], 0) for k in near]
        assert abs(p - np.dot(w, labels[near]) / sum(w)) < 1e-6


def test_document_frequency_covers_all(spark):
    docs = frame(spark, [(k, t, None) for k, t in enumerate(["a b", "a", "a a a", None])])
    df, n = quality.document_frequency(docs)
    (words,) = word_batches(["a"])
    assert n == 4 and df[int(words.hashes[0] % np.uint64(quality.WORD_DIMS))] == 3


def plain_log_probability(net, tree, seq, at):
    """By walking the tree, one product a node."""
    places = [p for p in range(at - lm_score.SIDE, at + lm_score.SIDE + 1) if p != at]
    x = np.concatenate([net["context"][seq[p]] for p in places] + [[1.0]])
    h = np.append(np.tanh(x @ net["mix"]), 1.0)
    code, total = int(seq[at]), 0.0
    path = [(k, s) for k, s in enumerate(tree.sign[code].tolist()) if s]
    path += [(int(tree.node[k]), int(tree.side[k])) for k in range(tree.begin[code], tree.begin[code] + tree.count[code])]
    for node, side in path:
        total -= np.log1p(np.exp(-side * float(net["node"][node] @ h)))
    return total


@pytest.fixture(scope="module")
def small_net():
    rng = np.random.default_rng(3)
    tree = lm_score.Tree(np.append(rng.integers(0, 500, 60), [1, 10**6]))
    net = {k: v.astype(np.float64) for k, v in lm_score.start(tree).items()}
    net["node"][:, :-1] *= 8
    gap = [62] * lm_score.SIDE
    seq = np.array([*gap, *rng.integers(0, 62, 40), *gap, *rng.integers(0, 62, 7), *gap], np.uint16)
    return net, tree, seq


def test_lm_probabilities_against_a_plain_loop(small_net):
    net, tree, seq = small_net
    got = lm_score.predict(net, tree, seq)
    side = lm_score.SIDE
    for k in range(len(got)):
        want = plain_log_probability(net, tree, seq, k + side) if seq[k + side] != 62 else 0.0
        assert abs(got[k] - want) < 1e-9
    every = []
    for code in range(62):  # all codes at one place are a distribution
        other = seq.copy()
        other[10] = code
        every.append(lm_score.predict(net, tree, other)[10 - side])
    assert abs(np.exp(every).sum() - 1) < 1e-9


def test_lm_gradients_against_finite_differences(small_net):
    net, tree, seq = small_net
    total = {k: np.zeros_like(v) for k, v in net.items()}
    for name, rows, g in lm_score.predict(net, tree, seq, gradients=True):
        assert len(set(rows.tolist())) == len(rows)
        total[name][rows] += g
    rng = np.random.default_rng(4)
    for name, v in net.items():
        for _ in range(40):
            at = (int(rng.choice(seq)) if name == "context" else int(rng.integers(len(v))), int(rng.integers(v.shape[1])))
            old, both = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = old + step
                both.append(lm_score.predict(net, tree, seq).sum())
            v[at] = old
            assert abs((both[0] - both[1]) / 2e-5 - total[name][at]) < 1e-5


def test_lm_network_starts_from_the_counts_and_learns():
    rng = np.random.default_rng(5)
    counts = np.array([800, 400, 200, 100, 50, 25])
    tree = lm_score.Tree(counts)
    codes = np.tile(np.array([0, 1, 0, 2, 3, 0, 4, 1], np.uint16), 400)
    net = lm_score.start(tree)
    net["node"][:, :-1] = 0
    flat = np.exp([lm_score.predict(net, tree, np.array([6, 6, c, 6, 6], np.uint16))[0] for c in range(6)])
    assert np.allclose(flat, counts / counts.sum(), atol=1e-3)
    learner = lm_score.Learner(net, {k: np.zeros(len(v), np.float32) for k, v in net.items()}, tree)
    gap = learner.gap
    for _ in range(30):
        learner.step(np.concatenate([gap, codes, gap]))
    seq = np.concatenate([gap, codes, gap])
    assert lm_score.predict(learner.net, tree, seq).mean() > lm_score.predict(net, tree, seq).mean() + 0.5
    parts = [rng.integers(0, 6, n).astype(np.uint16) for n in (9000, 3, 70_000, 1, 500)]
    one, other = (lm_score.Learner(net, {k: np.zeros(len(v), np.float32) for k, v in net.items()}, tree) for _ in range(2))
    for p in parts:
        one.add(p)
    other.held += [x for p in parts for x in (p, gap)]  # the cuts do not depend on how rows arrive
    one.end(), other.end()
    assert all(np.array_equal(one.net[k], other.net[k]) for k in net)


def lm_rows():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choice(words, 80, p=np.arange(400, 0, -1) / 80_200)), "en") for i in range(150)]
    rows += [(200, "plain words in a plain order again and again", "en")] * 2 + [(300, rows[7][1], None)]
    return rows + [(600 + k, t, None) for k, t in enumerate(ODD)] + [(None, "no id", None)]


def test_lm_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 3)
    monkeypatch.setattr(lm_score, "FAN", 2)
    got = []
    for n in (1, 2, 9):
        docs = frame(spark, lm_rows()).repartition(n, F.xxhash64("doc_id", F.lit(n)))
        got.append(sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.log_likelihood) for r in lm_score.train_and_score(docs).collect())))
    assert len(got[0]) == len(lm_rows())
    for other in got[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in got[0]]
        assert max(abs(a[2] - b[2]) / max(1, a[1]) for a, b in zip(got[0], other)) < 1e-6


def test_lm_over_tables(spark):
    rows = lm_rows()
    docs = frame(spark, rows).repartition(3)
    model, encoded = lm_score.train(docs)
    out = lm_score.score_rows(encoded, model, model.counts, leave_out=True)
    assert out.columns == ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"]
    by = {r.doc_id: r for r in out.collect()}
    assert (by[600].n_words, by[600].log_likelihood, by[600].mean_log_likelihood) == (0, 0.0, None)
    assert abs(by[7].log_likelihood - by[300].log_likelihood) < 1e-6
    # against plain counts: what each word out of the vocabulary adds
    texts = [re.findall(r"[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for _, t, _ in rows]
    counts = collections.Counter(w for t in texts for w in t)
    top = sorted((w for w in counts if counts[w] >= lm_score.LEAST), key=lambda w: (-counts[w], w.encode()))[: lm_score.VOCAB]
    assert len(model.vocab.hashes) == len(top) and model.vocab.counts.tolist() == [counts[w] for w in top]
    others = {w: n for w, n in counts.items() if w not in set(top)}
    size = lambda w: min(len(w.encode()), lm_score.OTHER)
    net = {r.doc_id: r.net for r in lm_score.network_scores(encoded, model).collect()}
    for (i, _, _), text in zip(rows, texts):
        want = 0.0
        for w in text:
            if w in others:
                mine = [x for x in others if size(x) == size(w)]
                data = w.encode() + b" "
                spelled = model.vocab.spelled(data, np.array([0]), np.array([len(data) - 1]))[0]
                share = max(counts[w] - text.count(w) - lm_score.DISCOUNT, 0) + lm_score.DISCOUNT * len(mine) * np.exp(spelled)
                want += np.log(share / sum(others[x] for x in mine))
        if i != 200:
            assert abs(by[i].log_likelihood - net[i] - want) < 1e-6, i
    new = frame(spark, [(0, "w1 w2 quite new", None), (1, "w1 w2 q#zx~7 w3", None), (2, None, None)])
    scored = {r.doc_id: r for r in lm_score.score(new, model).collect()}
    assert scored[0].log_likelihood < 0 and np.isfinite(scored[1].log_likelihood) and scored[2].n_words == 0
    empty = docs.limit(0)
    assert lm_score.train_and_score(empty).count() == 0
    assert docs.count() == len(rows)


def test_lm_spellings_are_a_distribution(spark):
    docs = frame(spark, [(100 + i, f"w1 stone{i} w3 stane{i}", None) for i in range(40)])
    vocab = lm_score.vocabulary(lm_score.count_words(docs.select("text")))
    assert len(vocab.hashes) == 2
    (two,) = word_batches(["w1 " + " ".join(chr(c) for c in range(33, 127) if not 65 <= c <= 90)])
    codes, out = lm_score.Coder(vocab.hashes)(two.hashes, two.end - two.begin)
    assert not out[0] and out[1:].all() and set(codes[1:].tolist()) == {2}
    free = np.exp(vocab.spelling[:256].astype(np.float64))
    assert abs(free.sum() - 1) < 1e-4
    assert (vocab.spelled(two.data, two.begin[1:], two.end[1:]) <= 1e-6).all()


def test_lm_vocabulary_follows_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SCALE", 40)
    docs = frame(spark, [(i, " ".join(f"v{k}" for k in range(1200)), None) for i in range(6)])
    vocab = lm_score.vocabulary(lm_score.count_words(docs.select("text")))
    assert len(vocab.hashes) == 1200 and vocab.codes == 1200 + lm_score.OTHER
