"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every word from
the WINDOW words on both sides; the summed conditional log-probabilities score a document.

Words are counted over all documents. The most common (FREQUENT, and more by the cube root of the number of
distinct words) get a symbol each, all others one of RARE symbols by their hash, and one symbol stands outside the
text. The network adds up one embedding per neighbour and place, squashes the sum, and gives a distribution over all
symbols. A rare word's probability is that of its symbol times its own share of the symbol's count, so words are scored,
not symbols. Counts of the KNOWN most common words go to all workers, the counts from 2 of all others are joined; a
word that wasn't counted scores as one counted once.

Training passes over every document once: each partition predicts every word in turn, steps through its own words from the same start, and the partitions' weights are averaged, weighted
by their words, in a DataFrame aggregation. Counts and weights that are shuffled grow with the corpus; the driver
gets the KNOWN words, and the averaged weights, whose size grows with the frequent words.

Defined results: a null or wordless text has no words and a score of 0; a text of one word is predicted from
the outside symbols; long texts are scored in blocks, whole; rows that repeat are all scored; an empty table
gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, texthash

FREQUENT, RARE, WINDOW, WIDTH = 191, 64, 2, 16
KNOWN = 1 << 18
_OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
BATCH, RATE, BLOCK = 256, 0.1, 2048
DENSE = 2048


def n_frequent(distinct: int) -> int:
    return max(FREQUENT, int(2 * distinct ** (1 / 3)) - RARE)


def _padded(symbols: np.ndarray) -> np.ndarray:
    outside = np.zeros(WINDOW, symbols.dtype)
    return np.concatenate((outside, symbols, outside))


def shapes(symbols: int) -> dict[str, tuple[int, ...]]:
    return {"near": (len(_OFFSETS), symbols, WIDTH), "out": (WIDTH, symbols), "bias": (symbols,)}


@dataclass
class Network:
    frequent: np.ndarray  # sorted hashes
    symbol: np.ndarray  # symbol of each
    near: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    rare: np.ndarray  # counts of the rare symbols
    known: np.ndarray  # sorted hashes
    known_log: np.ndarray  # logarithms of their counts
    tail: DataFrame | None = None  # word, n of the others, from 2

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        rare = (len(self.bias) - RARE + (hashes % np.uint64(RARE)).astype(np.int32)).astype(np.int32)
        if not len(self.frequent) or not len(hashes):
            return rare
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, self.symbol[at], rare)

    def hidden(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """padded: symbols with WINDOW outside symbols before and after; at: places of words in it."""
        h = self.near[0][padded[at + _OFFSETS[0]]]
        for k, o in enumerate(_OFFSETS[1:], 1):
            h += self.near[k][padded[at + o]]
        return np.tanh(h)

    def log_prob(self, symbols: np.ndarray) -> float:
        """The sum over all words of a text."""
        padded = _padded(symbols)
        weights, ones = np.append(self.out, self.bias[None], 0), np.ones(len(self.bias), np.float32)
        total = 0.0
        for s in range(0, len(symbols), BLOCK):
            at = np.arange(s, min(len(symbols), s + BLOCK)) + WINDOW
            h = self.hidden(padded, at)
            z = np.append(h, np.ones((len(at), 1), np.float32), 1) @ weights
            own = z[np.arange(len(at)), padded[at]]
            np.exp(z, out=z)
            total += float(own.sum(dtype=np.float64) - np.log(z @ ones).sum(dtype=np.float64))
        return total

    def within(self, hashes: np.ndarray, symbols: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of log-probabilities of rare words given their symbols, as if words that aren't known had been
        counted once; and those words."""
        first = len(self.bias) - RARE
        own = symbols >= first
        words = hashes[own]
        total = -float(np.log(np.maximum(self.rare[symbols[own] - first], 1)).sum())
        if not len(self.known) or not len(words):
            return total, words
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        found = self.known[at] == words
        return total + float(self.known_log[at[found]].sum()), words[~found]


def started(frequent: list[tuple[int, int]], rare: np.ndarray, slots: int, known: list[np.ndarray]) -> Network:
    """frequent: (hash, count), the most frequent first; rare: counts of the rare symbols; slots: symbols for frequent
    words; known: hashes and counts."""
    rng = np.random.default_rng(6)
    hashes = np.array([h for h, _ in frequent], np.uint64)
    order = np.argsort(hashes)
    counts = np.ones(1 + slots + RARE)
    counts[1 : 1 + len(frequent)] += [c for _, c in frequent]
    counts[1 + slots :] += rare
    bias = np.log(counts / counts.sum()).astype(np.float32)
    near, out = (0.1 * rng.standard_normal(shapes(len(bias))[k]).astype(np.float32) for k in ("near", "out"))
    sort = np.argsort(known[0])
    return Network(hashes[order], (1 + order).astype(np.int32), near, out, bias, rare, known[0][sort], np.log(known[1][sort]))


class Trainer:
    """AdaGrad over batches of words; each is masked once, and none sees itself."""

    def __init__(self, net: Network):
        self.net = replace(net, near=net.near.copy(), out=net.out.copy(), bias=net.bias.copy())
        self.squares = {k: np.full(v, 1e-3, np.float32) for k, v in shapes(len(net.bias)).items()}
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = self.seen = 0

    def add(self, symbols: np.ndarray) -> None:
        self.seen += len(symbols)
        padded = _padded(symbols)
        for s in range(0, len(symbols), BLOCK):
            end = min(len(symbols), s + BLOCK)
            self.waiting.append((np.stack([padded[s + WINDOW + o : end + WINDOW + o] for o in _OFFSETS], 1), padded[s + WINDOW : end + WINDOW]))
            self.n += end - s
            if self.n >= BATCH:  # what doesn't fill a batch waits on
                rest, (near, right) = self.n % BATCH, self.waiting[-1]
                cut = len(right) - rest
                self.waiting[-1] = near[:cut], right[:cut]
                self.step()
                self.waiting, self.n = [(near[cut:], right[cut:])], rest

    def _move(self, name: str, grad: np.ndarray) -> None:
        s = self.squares[name]
        s += grad * grad
        getattr(self.net, name)[...] -= RATE * grad / np.sqrt(s)

    def step(self) -> None:
        if not self.n:
            return
        near, right = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n = [], 0
        net = self.net
        places = (np.arange(len(_OFFSETS), dtype=near.dtype) * len(net.bias))[:, None]
        ones = np.ones(len(net.bias), np.float32)
        for s in range(0, len(right), BATCH):
            x, y = near[s : s + BATCH], right[s : s + BATCH]
            at = (x.T + places).ravel()
            h = np.tanh(net.near.reshape(-1, WIDTH)[at].reshape(-1, len(y), WIDTH).sum(0))
            wide = np.append(h, np.ones((len(y), 1), np.float32), 1)  # the last column stands for the bias
            z = wide @ np.append(net.out, net.bias[None], 0)
            np.exp(z, out=z)
            total = z @ ones
            z[np.arange(len(y)), y] -= total
            scale = (1 / (len(y) * total))[:, None]  # z times scale is the gradient of the scores
            back = (z @ net.out.T) * (scale * (1 - h * h))
            near_flat, squares = (v.reshape(-1, WIDTH) for v in (net.near, self.squares["near"]))
            if len(near_flat) <= DENSE:  # sums of all embeddings cost less than finding those that the batch holds
                held, place, n = slice(None), at, len(near_flat)
            else:
                held, place = np.unique(at, return_inverse=True)
                n = len(held)
            cells = (place[:, None] * WIDTH + np.arange(WIDTH)).ravel()
            grad = np.bincount(cells, np.tile(back, (len(_OFFSETS), 1)).ravel(), n * WIDTH).astype(np.float32).reshape(n, WIDTH)
            squares[held] += grad * grad
            near_flat[held] -= RATE * grad / np.sqrt(squares[held])
            grad = (wide * scale).T @ z
            self._move("out", grad[:-1])
            self._move("bias", grad[-1])


def _words(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    yield from texthash.words(((t or "").lower().encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts; flushed whenever a million words are held."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "n"])

    held, size = [], 0
    for b in batches:
        for w in _words(b, 0):
            held.append(w)
            size += len(w)
            if size >= 1 << 20:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def _trained(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(net)
        for b in batches:
            for w in _words(b, 0):
                trainer.add(trainer.net.symbols(w))
        trainer.step()
        if trainer.seen:
            names = list(shapes(0))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([trainer.seen] * 3, pa.int64()), pa.array([getattr(trainer.net, k).ravel() for k in names], pa.list_(pa.float32()))], ["name", "n", "weights"])

    return run


def train(docs: DataFrame, *, text_col: str = "text") -> Network:
    texts = docs.select(F.col(text_col).alias("text"))
    counts = common.stored(texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    slots = n_frequent(counts.count())
    top = [(r[0] % 2**64, r[1]) for r in counts.orderBy(F.col("n").desc(), "word").limit(slots).collect()]
    unsigned = F.col("word").bitwiseAND(F.lit(RARE - 1))
    rare = np.zeros(RARE)
    for r in counts.groupBy(unsigned.alias("s")).agg(F.sum("n").alias("n")).collect():  # RARE rows at most
        rare[r[0]] = r[1]
    for h, c in top:
        rare[h % RARE] -= c
    steps = F.floor(8 * F.log2("n"))  # eighths of a doubling: few, whatever the input
    least, size = 0, 0
    for r in sorted(counts.groupBy(steps.alias("s")).count().collect(), reverse=True):
        size += r[1]
        if size > KNOWN:
            least = r[0] + 1
            break
    known = counts.where(steps >= least).select("word", "n").toArrow()
    net = started(top, rare, slots, [known.column(0).to_numpy().view(np.uint64), known.column(1).to_numpy()])
    moved = texts.mapInArrow(_trained(replace(net, known=net.known[:0], known_log=net.known_log[:0])), "name string, n long, weights array<float>")
    mean = moved.select("name", "n", F.posexplode("weights").alias("at", "w")).groupBy("name", "at").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w"))
    for r in mean.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("w")).collect():  # the weights, of fixed size
        setattr(net, r[0], np.array(r[1], np.float32).reshape(getattr(net, r[0]).shape))
    net.tail = counts.where((steps < least) & (F.col("n") > 1))
    return net


def scored(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (sum over words), mean_log_prob (0 without words)."""

    local = replace(net, tail=None)
    names = ["row", "doc_id", "n_words", "log_prob", "word", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text one row with its figures (times 0, word at random), and one for each distinct word that isn't known."""
        for b in batches:
            rows = b.column(0).to_numpy()
            n, total, tails = [], [], []
            for w in _words(b, 2):
                symbols = local.symbols(w)
                inside, others = local.within(w, symbols)
                n.append(len(w))
                total.append(local.log_prob(symbols) + inside)
                tails.append(np.unique(others, return_counts=True))
            figures = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(texthash.mix(rows.astype(np.uint64), 16).view(np.int64)), pa.array(np.zeros(len(n), np.int64))]
            yield pa.RecordBatch.from_arrays(figures, names)
            size = [len(t[0]) for t in tails]
            if sum(size):
                m = sum(size)
                words, times = (np.concatenate(x) for x in zip(*tails, strict=True))
                more = [pa.array(np.repeat(rows, size)), pa.nulls(m, pa.int64()), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m)), pa.array(words.view(np.int64)), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(more, names)

    out = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "row long, doc_id long, n_words long, log_prob double, word long, times long")
    if net.tail is not None:
        out = out.join(net.tail, "word", "left").withColumn("log_prob", F.col("log_prob") + F.col("times") * F.log(F.coalesce("n", F.lit(1))))
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("log_prob").alias("log_prob")).drop("row")
    return out.withColumn("mean_log_prob", F.coalesce(F.try_divide("log_prob", "n_words"), F.lit(0.0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, train(docs))
