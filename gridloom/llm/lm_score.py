"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word of a text is predicted from the ``SIDE`` words on either side of it: their
vectors go through one matrix and a squashing function, and the result walks down a Huffman
tree of the vocabulary, so that the probabilities of all codes sum to 1 and a word costs
about as many products as its code has bits. A text's score is the sum of these conditional
log-probabilities, and their mean a word.

1. Words are counted over the whole corpus. Those counted ``LEAST`` times or more get codes
   of their own, the most frequent ``SCALE * sqrt(tokens)`` of them (``VOCAB`` at least,
   ``MOST`` at most: what executors get is bounded). Every other word has the code of its
   length, and under it a probability of its own: its count in the *other* texts, discounted,
   and for the rest a byte model (each byte given the two before it). Those counts are
   joined, not broadcast. So no word is only a class, and a text does not vouch for itself.
2. Texts become rows of codes, written once; training and scoring read those.
3. Rows are dealt to shards of about ``SHARD`` tokens a vocabulary word by a hash of the
   row, and inside a shard sorted by it. Every token is a target once: in each of ``TURNS``
   rounds all shards start from one network, train it on their part of that round (numpy,
   Adagrad), and the networks are averaged, each row by how much the shards had to say about
   it; sums go up a tree of groups of ``FAN``. Shards depend on the rows alone, and sums are
   made in order, so the same table gives the same scores however it is split.

Cases: null texts and texts without a word have 0 words, score 0 and a null mean; places
before and after a text are an own code. Repeated rows are scored each, and count for each
other. Null ids are ids. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import settle, table
from gridloom.llm.textcodes import _BLANK, _LOWER, word_batches

#: Codes of words out of the vocabulary: one for each length in bytes, the last for all from ``OTHER`` on.
OTHER = 64
VOCAB, MOST = 960, 65_000
LEAST = 5
SCALE = 2
#: What is taken off each count for words not seen elsewhere.
DISCOUNT = 0.75
#: Spelling contexts: the byte before, and the one before that by its last bits.
BEFORE = 16
SIDE = 2
WIDTH = 16
#: The heaviest nodes of the tree are compared with every word in one product, the others one by one.
TOP = 24
RATE = 0.15
STEP = 8192
SHARD = 400
TURNS = 4
FAN = 64
#: Rows of the network in a message.
CHUNK = 1 << 10


def _cells(data: np.ndarray) -> np.ndarray:
    """Cell of the spelling table of each byte: its context (words begin after a blank), then the byte."""
    b = np.where(_BLANK[data], 0, _LOWER[data]).astype(np.int32)
    one = np.concatenate([[0], b[:-1]]).astype(np.int32)
    two = np.concatenate([[0], one[:-1]]).astype(np.int32)
    two[one == 0] = 0
    return (one * BEFORE + two % BEFORE) * 256 + b


def length_class(size: np.ndarray) -> np.ndarray:
    return np.minimum(size, OTHER) - 1


@dataclass
class Vocabulary:
    """Hashes and counts of the words with codes, most frequent first, and the spelling of all others."""

    hashes: np.ndarray
    counts: np.ndarray
    spelling: np.ndarray  # log-probability of each cell
    rest: np.ndarray  # for each length, log of what vocabulary words leave of its spellings
    longer: float  # chance that a word of ``OTHER`` bytes or more has another
    others: np.ndarray = field(default_factory=lambda: np.zeros(OTHER, np.int64))  # tokens of each length out of the vocabulary
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(OTHER, np.int64))  # and different words

    @property
    def codes(self) -> int:
        return len(self.hashes) + OTHER

    def code_counts(self) -> np.ndarray:
        return np.concatenate([self.counts, self.others])

    def _spelled(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.empty(0)
        total = np.add.reduceat(np.append(self.spelling[_cells(np.frombuffer(data, np.uint8))].astype(np.float64), 0.0), np.stack([begin, end], 1).ravel())[::2]
        beyond = end - begin - OTHER
        return total + np.where(beyond >= 0, beyond * math.log(self.longer) + math.log1p(-self.longer), 0.0)

    def spelled(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-probability of the spelling of words out of the vocabulary, given their length's code."""
        return self._spelled(data, begin, end) - self.rest[length_class(end - begin)]

    def back_off(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words out of the vocabulary: what spelling adds to a discounted count, and the log of what their sum is a share of."""
        at = length_class(end - begin)
        seen = self.others[at] > 0
        add = np.where(seen, DISCOUNT * self.kinds[at], 1.0) * np.exp(self.spelled(data, begin, end))
        return np.maximum(add, 1e-300), np.log(np.where(seen, self.others[at], 1.0))


def _joined(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    data, n = b" ".join(words) + b" ", np.array([len(w) for w in words], np.int64)
    end = np.cumsum(n + 1) - 1
    return data, end - n, end


def spell_model(rows, excess: int, longer: int, words: list[bytes], hashes: np.ndarray, counts: np.ndarray | None = None) -> Vocabulary:
    """``rows``: cells and counts over all words but ``words``; ``longer`` of them have ``OTHER`` bytes or more, ``excess`` bytes beyond that together."""
    cells = np.zeros(256 * BEFORE * 256)
    cells[rows[0]] = rows[1]
    cells = cells.reshape(256, BEFORE, 256)
    base = np.array([not _BLANK[c] and _LOWER[c] == c for c in range(256)], float)
    base /= base.sum()
    pair = cells.sum(1)
    pair = (pair + 4 * base) / (pair.sum(1, keepdims=True) + 4)
    p = (cells + 4 * pair[:, None, :]) / (cells.sum(2, keepdims=True) + 4)
    out = Vocabulary(hashes, np.ones(len(hashes), np.int64) if counts is None else counts, np.log(np.maximum(p, 1e-300)).astype(np.float32).ravel(), np.zeros(OTHER), (excess + 1) / (excess + longer + 2))
    data, begin, end = _joined(words)
    taken = np.bincount(length_class(end - begin), np.exp(out._spelled(data, begin, end)), OTHER) if words else np.zeros(OTHER)
    out.rest = np.log(np.maximum(1 - taken, 1e-9))
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """``(text)`` to ``(word binary, n)``, written."""

    def count(batches):
        for batch in batches:
            for words in word_batches(batch.column(0).to_pylist(), limit=1 << 22):
                if len(words.hashes):
                    _, pick, n = np.unique(words.hashes, return_index=True, return_counts=True)
                    low = words.data.lower()  # A-Z only
                    own = [low[x:y] for x, y in zip(words.begin[pick].tolist(), words.end[pick].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(n)], ["word", "n"])

    return settle(texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _listed(batch: pa.RecordBatch):
    """Slices of rows ``(word, ...)``: ``(from, to, text, begin, end, hashes)``."""
    own = batch.column(0).to_pylist()
    for k in range(0, len(own), 1 << 16):
        data, begin, end = _joined(own[k : k + (1 << 16)])
        (words,) = word_batches([data.decode("utf-8", "surrogatepass")], limit=1 << 62)
        yield k, k + len(begin), data, begin, end, words.hashes


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words with codes (ties by word), and the spelling of the others, from ``(word, n)``."""
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = min(MOST, max(VOCAB, math.ceil(SCALE * math.sqrt(tokens))))
    top = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(most).collect()
    words, hashes = [bytes(r.word) for r in top], np.empty(0, np.uint64)
    if top:
        (own,) = word_batches([(b" ".join(words)).decode("utf-8", "surrogatepass")], limit=1 << 62)
        hashes = own.hashes
    shared = counts.sparkSession.sparkContext.broadcast(np.sort(hashes))

    def spell(batches):
        total, excess, longer = np.zeros(256 * BEFORE * 256), 0, 0
        others, kinds = np.zeros(OTHER, np.int64), np.zeros(OTHER, np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            for x, y, data, begin, end, own in _listed(batch):
                free = ~np.isin(own, shared.value)
                weight, size = n[x:y] * free, end - begin
                inside = np.ones(len(data), bool)
                inside[end] = False
                total += np.bincount(_cells(np.frombuffer(data, np.uint8))[inside], np.repeat(weight, size), len(total))
                excess += int((np.maximum(size - OTHER, 0) * weight).sum())
                longer += int(weight[size >= OTHER].sum())
                others += np.bincount(length_class(size), weight, OTHER).astype(np.int64)
                kinds += np.bincount(length_class(size), free, OTHER).astype(np.int64)
        at = np.flatnonzero(total)
        more = np.concatenate([[-1, -2], -3 - np.arange(2 * OTHER)])  # single counts have cells below 0
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, more)), pa.array(np.concatenate([total[at], [excess, longer], others, kinds]).astype(np.int64))], ["cell", "n"])

    rows = counts.mapInArrow(spell, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most a row a cell
    cell, n = rows.cell.to_numpy(np.int64), rows.n.to_numpy(np.int64)
    single = np.zeros(2 + 2 * OTHER, np.int64)
    single[-1 - cell[cell < 0]] = n[cell < 0]
    out = spell_model((cell[cell >= 0], n[cell >= 0]), int(single[0]), int(single[1]), words, hashes, np.array([r.n for r in top], np.int64))
    out.others, out.kinds = single[2 : 2 + OTHER], single[2 + OTHER :]
    return out


class Coder:
    """Words to codes: rank in the vocabulary, then the codes of lengths."""

    def __init__(self, hashes: np.ndarray):
        self.rank = np.argsort(hashes)
        self.keys = hashes[self.rank]

    def __call__(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and which words are out of the vocabulary."""
        code, out = len(self.keys) + length_class(sizes), np.ones(len(hashes), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            out = self.keys[at] != hashes
            code = np.where(out, code, self.rank[at])
        return code.astype(np.uint16), out


def encode(docs: DataFrame, vocab: Vocabulary, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``row, doc_id, n_words, codes binary``, and each text's different words out of the vocabulary with ``times``; written."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab.hashes)

    def answer(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for words in word_batches(batch.column(1).to_pylist()):
                codes, out = coder(words.hashes, words.end - words.begin)
                doc, other = words.doc_of()[out], words.hashes[out]
                order = np.lexsort((other, doc))
                doc, other = doc[order], other[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])])) if len(doc) else np.empty(0, np.int64)
                offsets = pa.array(np.searchsorted(doc[new], np.arange(len(words) + 1)).astype(np.int32))
                rows = [codes[a:b].tobytes() for a, b in zip(words.start[:-1].tolist(), words.start[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, len(words)), pa.array(np.diff(words.start)), pa.array(rows, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(other[new].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(new, append=len(doc)).astype(np.int32)))],
                    ["doc_id", "n_words", "codes", "others", "times"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(answer, f"doc_id {kind}, n_words long, codes binary, others array<long>, times array<int>")
    return settle(rows.withColumn("row", F.monotonically_increasing_id()))


class Tree:
    """Huffman tree over the counts of codes; nodes are numbered by falling weight."""

    def __init__(self, counts: np.ndarray):
        weight = np.maximum(counts, 1).astype(np.int64)
        n = len(weight)
        order = np.argsort(weight, kind="stable")
        leaves, inner = weight[order].tolist(), []
        parent, turn = np.empty(2 * n - 1, np.int64), np.empty(2 * n - 1, np.int8)
        i = j = 0
        for k in range(n - 1):
            total = 0
            for side in (-1, 1):  # the lighter of the least leaf and the least node
                if i < n and (j >= k or leaves[i] <= inner[j]):
                    child, total, i = order[i], total + leaves[i], i + 1
                else:
                    child, total, j = n + j, total + inner[j], j + 1
                parent[child], turn[child] = n + k, side
            inner.append(total)
        heavy = np.argsort(-np.array(inner, np.int64), kind="stable")
        name = np.empty(n - 1, np.int64)
        name[heavy] = np.arange(n - 1)
        leaf, node, side = [], [], []
        live, at = np.arange(n), np.arange(n)
        while n > 1 and len(live):
            leaf.append(live)
            side.append(turn[at])
            at = parent[at]
            node.append(name[at - n])
            live, at = live[at != 2 * n - 2], at[at != 2 * n - 2]
        leaf, node, side = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (leaf, node, side))
        right = np.bincount(node[side > 0], weight[leaf[side > 0]], n - 1)
        self.log_odds = np.log((right + 0.5) / (np.array(inner, float)[heavy] - right + 0.5))
        top = node < TOP
        self.sign = np.zeros((n, min(TOP, n - 1)), np.int8)  # of each code at the top nodes; 0 off its path
        self.sign[leaf[top], node[top]] = side[top]
        leaf, node, side = leaf[~top], node[~top], side[~top]
        order = np.argsort(leaf, kind="stable")
        self.node, self.side = node[order].astype(np.uint16), side[order].astype(np.int8)
        self.count = np.bincount(leaf, minlength=n)
        self.begin = np.cumsum(self.count) - self.count


def start(tree: Tree) -> dict[str, np.ndarray]:
    """The first network: the nodes' own weights say what the counts say."""
    rng, codes = np.random.default_rng(11), len(tree.count)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    node = draw(codes - 1, WIDTH + 1, by=0.05)
    node[:, -1] = tree.log_odds
    mix = draw(2 * SIDE * WIDTH + 1, WIDTH, by=0.25)
    mix[-1] = 0
    return {"context": draw(codes + 1, WIDTH, by=0.3), "mix": mix, "node": node}


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sum of the rows of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


_PLACES = [*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]


def predict(net: dict, tree: Tree, seq: np.ndarray, gradients: bool = False):
    """Log-probability of each code of ``seq`` but the ``SIDE`` at either end, 0 where it is the place beside a text.

    With ``gradients``, those of the sum instead: for each part of the network rows and what their derivatives add up to.
    """
    beside, m, mix = len(tree.count), len(seq) - 2 * SIDE, net["mix"]
    seen = net["context"].take(seq, axis=0)
    x = sum(seen[p : p + m] @ mix[k * WIDTH : (k + 1) * WIDTH] for k, p in enumerate(_PLACES))
    x += mix[-1]
    np.tanh(x, out=x)
    places = np.flatnonzero(seq[SIDE : SIDE + m] != beside)
    depth = tree.count[seq[SIDE : SIDE + m][places]]
    order = np.argsort(-depth, kind="stable")  # deepest first, so that each level of the tree concerns the first so many
    places, depth = places[order], depth[order]
    code = seq[SIDE : SIDE + m][places]
    h = np.ones((len(places), WIDTH + 1), x.dtype)
    h[:, :-1] = x.take(places, axis=0)
    sign = tree.sign.take(code, axis=0).astype(h.dtype)
    heavy = net["node"][: sign.shape[1]]
    wide = _exp_minus((h @ heavy.T) * sign)
    if gradients:
        wide = sign * (wide / (1 + wide))
        dh = wide @ heavy
        found, nodes, parts = [("node", np.arange(len(heavy)), wide.T @ h)], [], []
    else:
        lp = -(np.log(1 + wide) * (sign != 0)).sum(1, dtype=np.float64)
    begin, most = tree.begin[code], int(depth[0]) if len(depth) else 0
    for d, n in enumerate(np.searchsorted(-depth, -np.arange(most)).tolist()):
        node, side = tree.node.take(begin[:n] + d), tree.side.take(begin[:n] + d).astype(h.dtype)
        node_of = net["node"].take(node, axis=0)
        deep = _exp_minus(np.einsum("ij,ij->i", h[:n], node_of) * side)
        if gradients:
            deep = (side * (deep / (1 + deep)))[:, None]
            parts.append(deep * h[:n])
            nodes.append(node)
            node_of *= deep
            dh[:n] += node_of
        else:
            lp[:n] -= np.log(1 + deep)
    if not gradients:
        out = np.zeros(m, np.float64)
        out[places] = lp
        return out
    if nodes:
        found.append(("node", *_sums(np.concatenate(nodes), np.concatenate(parts))))
    dx = np.zeros((m, WIDTH), h.dtype)
    dx[places] = dh[:, :-1] * (1 - h[:, :-1] ** 2)
    into = np.zeros((len(seq), WIDTH), h.dtype)
    for k, p in enumerate(_PLACES):
        into[p : p + m] += dx @ mix[k * WIDTH : (k + 1) * WIDTH].T
    found.append(("mix", np.arange(len(mix)), np.concatenate([*(seen[p : p + m].T @ dx for p in _PLACES), dx.sum(0, keepdims=True)])))
    found.append(("context", *_sums(seq, into)))
    return found


def _exp_minus(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.clip(x, -30, 30))


class Learner:
    """Adagrad with a rate a row, over a stream of texts cut into steps of ``STEP`` places."""

    def __init__(self, net: dict, steady: dict, tree: Tree):
        self.net, self.steady, self.tree = {k: v.copy() for k, v in net.items()}, {k: v.copy() for k, v in steady.items()}, tree
        self.gap = np.full(SIDE, len(tree.count), np.uint16)
        self.held, self.size = [self.gap], SIDE

    def step(self, seq: np.ndarray) -> None:
        for name, rows, g in predict(self.net, self.tree, seq, gradients=True):
            steady = self.steady[name].take(rows) + np.einsum("ij,ij->i", g, g) / g.shape[1]
            self.steady[name][rows] = steady
            g *= (RATE / np.sqrt(steady + 1e-6))[:, None]
            self.net[name][rows] = self.net[name].take(rows, axis=0) + g

    def add(self, codes: np.ndarray) -> None:
        self.held += [codes, self.gap]
        self.size += len(codes) + SIDE
        if self.size >= 16 * STEP:
            self._work(False)

    def end(self) -> None:
        self._work(True)

    def _work(self, all_of_it: bool) -> None:
        seq = np.concatenate(self.held)
        k = SIDE
        while k + STEP + SIDE <= len(seq):
            self.step(seq[k - SIDE : k + STEP + SIDE])
            k += STEP
        if all_of_it and k + SIDE < len(seq):
            self.step(seq[k - SIDE :])
        self.held, self.size = [seq[k - SIDE :]], len(seq) - k + SIDE


def _table(net: dict, steady: dict) -> np.ndarray:
    """All rows of a network one under another, the sums of their squares last."""
    return np.concatenate([np.pad(np.column_stack([v, np.zeros((len(v), WIDTH + 1 - v.shape[1]), v.dtype)]), ((0, 0), (0, 1))) + np.outer(steady[k], np.eye(WIDTH + 2)[-1]) for k, v in net.items()]).astype(np.float32)


def _untable(rows: np.ndarray, like: dict) -> tuple[dict, dict]:
    net, steady, at = {}, {}, 0
    for k, v in like.items():
        net[k], steady[k] = rows[at : at + len(v), : v.shape[1]].astype(np.float32), rows[at : at + len(v), -1].astype(np.float32)
        at += len(v)
    return net, steady


def train_turn(dealt: DataFrame, tree: Tree, net: dict, steady: dict, shards: int) -> tuple[dict, dict]:
    """The networks that shards ``(shard, nth, codes)`` make of ``net``, averaged."""
    shared = dealt.sparkSession.sparkContext.broadcast((tree, net, steady))

    def told(shard: int, learner: Learner):
        learner.end()
        _, net, steady = shared.value
        old = _table(net, steady)
        new = _table(learner.net, learner.steady) - old
        weight = new[:, -1:].astype(np.float64)
        sums = np.concatenate([new[:, :-1] * weight, weight, weight * weight], 1).astype(np.float32)
        for k in range(0, len(sums), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([shard]), pa.array([sums[k : k + CHUNK].astype("<f4").tobytes()], pa.binary())], ["at", "shard", "part"])

    def learn(batches):
        tree, net, steady = shared.value
        now, learner = None, None
        for batch in batches:
            for shard, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    if learner is not None:
                        yield from told(now, learner)
                    now, learner = shard, Learner(net, steady, tree)
                learner.add(np.frombuffer(codes, np.uint16))
        if learner is not None:
            yield from told(now, learner)

    def add_up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        total = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) for x in rows.column("part")).astype("<f4")
        return pa.table({"at": rows.column("at").slice(0, 1), "shard": pa.array([rows.column("shard")[0].as_py() // FAN]), "part": pa.array([total.tobytes()], pa.binary())})

    sorted_rows = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("nth", "codes")
    parts = sorted_rows.select("shard", "codes").mapInArrow(learn, "at long, shard long, part binary")
    while shards > 1:
        parts = parts.groupBy("at", F.floor(F.col("shard") / FAN).alias("up")).applyInArrow(add_up, "at long, shard long, part binary")
        shards = -(-shards // FAN)
    total = np.zeros((sum(map(len, net.values())), WIDTH + 3))
    for row in parts.collect():  # the size of one network
        total[row.at : row.at + CHUNK] = np.frombuffer(row.part, "<f4").reshape(-1, WIDTH + 3)
    weight = np.maximum(total[:, -2], 1e-300)
    rows = _table(net, steady).astype(np.float64)
    rows[:, :-1] += total[:, :-2] / weight[:, None]
    rows[:, -1] += total[:, -1] / weight
    return _untable(rows, net)


@dataclass
class Model:
    vocab: Vocabulary
    tree: Tree
    net: dict
    counts: DataFrame  # (word, n) of the corpus


def train(docs: DataFrame, *, id_col="doc_id", text_col="text") -> tuple[Model, DataFrame]:
    """The model, and the encoded rows it was trained on."""
    counts = count_words(docs.select(F.col(text_col).alias("text")))
    vocab = vocabulary(counts)
    rows = encode(docs, vocab, id_col=id_col, text_col=text_col)
    tree = Tree(vocab.code_counts())
    net = start(tree)
    steady = {k: np.zeros(len(v), np.float32) for k, v in net.items()}
    shards = max(1, round(int(vocab.code_counts().sum()) / (SHARD * vocab.codes)))
    by = F.xxhash64("doc_id", "codes")
    dealt = rows.where("n_words > 0").select(F.pmod(by, F.lit(shards)).alias("shard"), F.xxhash64(F.lit("order"), by).alias("nth"), F.pmod(F.xxhash64(F.lit("turn"), by), F.lit(TURNS)).alias("turn"), "codes")
    for turn in range(TURNS):
        net, steady = train_turn(dealt.where(F.col("turn") == turn).drop("turn"), tree, net, steady, shards)
    return Model(vocab, tree, net, counts), rows


def network_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``row, doc_id, n_words, codes_log_likelihood`` of encoded rows."""
    shared = rows.sparkSession.sparkContext.broadcast((model.tree, model.net))

    def answer(batches):
        tree, net = shared.value
        gap = np.full(SIDE, len(tree.count), np.uint16)
        for batch in batches:
            codes = [np.frombuffer(c, np.uint16) for c in batch.column(3).to_pylist()]
            first = 0
            while first < len(codes):  # texts of about 16 steps at a time; a long one by itself
                last, size = first, 0
                while last < len(codes) and size < 16 * STEP:
                    size, last = size + len(codes[last]), last + 1
                seq = np.concatenate([gap, *(x for c in codes[first:last] for x in (c, gap))])
                lp = np.concatenate([predict(net, tree, seq[k : k + STEP + 2 * SIDE]) for k in range(0, len(seq) - 2 * SIDE, STEP)] or [np.zeros(0)])
                bounds = np.cumsum([0, *(len(c) + SIDE for c in codes[first:last])])
                upto = np.concatenate([[0.0], np.cumsum(np.append(lp, np.zeros(SIDE)))])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(3)), pa.array(upto[bounds[1:]] - upto[bounds[:-1]])], ["row", "doc_id", "n_words", "net"])
                first = last

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "n_words", "codes").mapInArrow(answer, f"row long, doc_id {kind}, n_words long, net double")


def lexicon(counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(word, n)`` to ``hash, n, add, log_of`` of the words out of the vocabulary."""
    shared = counts.sparkSession.sparkContext.broadcast(vocab)

    def answer(batches):
        vocab = shared.value
        known = np.sort(vocab.hashes)
        for batch in batches:
            n = batch.column(1).to_numpy()
            for x, y, data, begin, end, own in _listed(batch):
                free = ~np.isin(own, known)
                add, log_of = vocab.back_off(data, begin[free], end[free])
                yield pa.RecordBatch.from_arrays([pa.array(own[free].view(np.int64)), pa.array(n[x:y][free]), pa.array(add), pa.array(log_of)], ["hash", "n", "add", "log_of"])

    return counts.select("word", "n").mapInArrow(answer, "hash long, n long, add double, log_of double")


def score_rows(rows: DataFrame, model: Model, counts: DataFrame, leave_out: bool) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_likelihood`` of encoded rows; ``counts`` has all of their words."""
    others = rows.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select("row", F.col("o.others").alias("hash"), F.col("o.times").alias("times"))
    elsewhere = F.greatest(F.col("n") - (F.col("times") if leave_out else F.lit(0)) - DISCOUNT, F.lit(0.0))
    own = others.join(lexicon(counts, model.vocab), "hash").groupBy("row").agg(F.sum(F.col("times") * (F.log(elsewhere + F.col("add")) - F.col("log_of"))).alias("words"))
    total = F.col("net") + F.coalesce("words", F.lit(0.0))
    scored = network_scores(rows, model).join(own, "row", "left")
    return scored.select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"))


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Scores of any texts; words that the corpus never had are spelled."""
    rows = encode(docs, model.vocab, id_col=id_col, text_col=text_col)
    words = count_words(docs.select(F.col(text_col).alias("text"))).select("word").join(model.counts, "word", "left")
    return score_rows(rows, model, words.select("word", F.coalesce("n", F.lit(0)).alias("n")), leave_out=False)


def train_and_score(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Scores of the corpus itself; a word counts for a text as often as it occurs in the others."""
    model, rows = train(docs, id_col=id_col, text_col=text_col)
    return score_rows(rows, model, model.counts, leave_out=True)


def op4_pseudo_likelihood(spark, sf_dir):
    return train_and_score(table(spark, sf_dir, "documents"))
