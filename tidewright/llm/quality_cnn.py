"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are covered by overlapping chunks. ``FILTERS`` learned filters of ``WIDTH`` bytes run over every position of
every chunk; a filter is one table of byte values per place. Activations are max-pooled within each chunk, averaged over
the chunks of the text, and combined into one probability, so the score sees the whole text, whatever its length.

Training is on the driver, on a bounded sample: at most ``PER_CLASS`` labelled rows of each class, drawn by hash, and of
each all chunks. The driver holds ``HELD`` bytes of their texts; what is beyond is read from the sample's table in the shared
folder where it is needed, and a step of 64 rows works on ``STEP_CHUNKS`` chunks at a time. Rows are weighted by their class's share among all labelled rows, so scores stay probabilities. Scoring needs no shuffle.

Defined cases: a null or empty text is one chunk of padding; a label that is null, or of an unknown or null id, is ignored;
of several labels of one id the largest counts; if only one class has labels the score is 1 or 0 for all, and without
labels 0.5; a null id is never held out; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import blocks, lean, raw, small_batches, table, written

FILTERS, WIDTH = 12, 6
CHUNK, STRIDE = 256, 224
PER_CLASS = 2000
EPOCHS = 12
THRESHOLD = 0.3
#: Positions convolved at once; chunks convolved at once when training.
_SPAN = 1 << 17
_CHUNKS = 512
#: Chunks of one group of a training step, and bytes of training texts that the driver holds.
STEP_CHUNKS, HELD = 65_536, 128 << 20


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks per text, and the begin of each chunk within its text."""
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // STRIDE))
    begin = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return n, begin


def padded(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with zeros after each, and where each begins."""
    at = ends[:-1] + np.arange(len(ends) - 1) * WIDTH
    out = np.zeros(len(body) + (len(ends) - 1) * WIDTH + WIDTH, np.uint8)
    for a, b, p in zip(ends[:-1].tolist(), ends[1:].tolist(), at.tolist(), strict=True):
        out[p : p + b - a] = body[a:b]
    return out, at


class Texts:
    """Training texts. The first ``HELD`` bytes of them stay in memory; of others, chunks are read where they are needed by ``far``,
    a function of a text's number, a place and a number of bytes."""

    def __init__(self, texts: Iterable[bytes], far: Callable[[int, int, int], bytes] | None = None):
        self.texts, self.far, sizes, held = [], far, [], 0
        for text in texts:
            sizes.append(len(text))
            held += len(text)
            self.texts.append(text if far is None or held <= HELD else None)
        self.sizes = np.array(sizes, np.int64)
        self.counts = windows(self.sizes)[0]

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, i: int) -> np.ndarray:
        """All chunks of a text, with ``WIDTH`` bytes of what follows behind each."""
        return self.part(i, 0, int(self.counts[i]))

    def part(self, i: int, first: int, stop: int) -> np.ndarray:
        out = np.zeros((stop - first - 1) * STRIDE + CHUNK + WIDTH, np.uint8)
        at = first * STRIDE
        n = max(0, min(int(self.sizes[i]) - at, len(out)))
        text = self.texts[i]
        out[:n] = np.frombuffer(text[at : at + n] if text is not None else self.far(i, at, n), np.uint8)
        return np.lib.stride_tricks.sliding_window_view(out, CHUNK + WIDTH)[::STRIDE]


def _groups(chunks: Texts, rows: np.ndarray) -> Iterator[Callable]:
    """Functions that read a group of the rows' chunks each, as (places of rows, how many chunks of each, the chunks); a row of more
    than ``STEP_CHUNKS`` chunks is in several."""

    def made(parts: list) -> Callable:
        return lambda: (np.array([p[0] for p in parts]), np.array([p[2] - p[1] for p in parts]), np.concatenate([chunks.part(int(rows[i]), a, b) for i, a, b in parts]))

    parts, room = [], STEP_CHUNKS
    for i, total in enumerate(chunks.counts[rows].tolist()):
        at = 0
        while at < total:
            if not room:
                yield made(parts)
                parts, room = [], STEP_CHUNKS
            take = min(room, total - at)
            parts.append((i, at, at + take))
            at, room = at + take, room - take
    if parts:
        yield made(parts)


class Model:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.full(FILTERS, 0.1, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        self.constant: float | None = None

    def pairs(self) -> list[np.ndarray]:
        """Tables of two neighbouring bytes, which halve the look-ups when scoring."""
        f = self.filters
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) + (self.bias if j == 0 else 0) for j in range(0, WIDTH, 2)]

    def score(self, body: np.ndarray, ends: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        sizes = np.diff(ends)
        if self.constant is not None:
            return np.full(len(sizes), self.constant)
        data, at = padded(body, ends)
        n, begin = windows(sizes)
        start = begin + np.repeat(at, n)
        stop = np.minimum(begin + CHUNK, np.repeat(np.maximum(sizes, 1), n)) + np.repeat(at, n)
        pooled = np.empty((len(start), FILTERS), np.float32)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + _SPAN)))
            lo, hi = int(start[i]), int(stop[i:j].max())
            part = data[lo : hi + WIDTH].astype(np.int32)
            two = part[:-1] * 256 + part[1:]
            m = hi - lo
            act = np.take(tables[0], two[:m], axis=0)
            for k in range(1, len(tables)):
                act += np.take(tables[k], two[2 * k : 2 * k + m], axis=0)
            act = np.concatenate([act, act[-1:]])
            where = np.stack([start[i:j] - lo, stop[i:j] - lo], axis=1).ravel()
            pooled[i:j] = np.maximum.reduceat(act, where, axis=0)[::2]
            i = j
        np.maximum(pooled, 0, out=pooled)
        first = np.cumsum(n) - n
        mean = np.add.reduceat(pooled.astype(np.float64), first, axis=0) / n[:, None]
        return 1 / (1 + np.exp(-(mean @ self.out.astype(np.float64) + float(self.shift))))

    @staticmethod
    def _pooled(filters: np.ndarray, bias: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk, where each filter answers most, and how much."""
        best, top = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
        for a in range(0, len(x), _CHUNKS):
            part = x[a : a + _CHUNKS]
            act = np.take(filters[0], part[:, :CHUNK], axis=0)
            for j in range(1, WIDTH):
                act += np.take(filters[j], part[:, j : j + CHUNK], axis=0)
            best[a : a + _CHUNKS] = act.argmax(axis=1)
            top[a : a + _CHUNKS] = np.take_along_axis(act, best[a : a + _CHUNKS, None, :], axis=1)[:, 0, :] + bias
        return best, top

    def _gradients(self, params: list[np.ndarray], chunks: Texts, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of one step. Chunks go by groups of ``STEP_CHUNKS`` at most; where a step has one group, its answers are kept between the
        two passes, and where it has more, as texts are very long, they are worked out again."""
        filters, bias, out, shift = params
        n = chunks.counts[rows]
        groups = list(_groups(chunks, rows))
        mean, kept = np.zeros((len(rows), FILTERS), np.float32), None
        for group in groups:
            own, counts, x = group()
            best, top = self._pooled(filters, bias, x)
            kept = (own, counts, x, best, top) if len(groups) == 1 else None
            mean[own] += np.add.reduceat(np.maximum(top, 0), np.cumsum(counts) - counts, axis=0)
        mean = mean / n[:, None]
        z = mean @ out + shift[0]
        w = weights[rows] / weights[rows].sum()
        dz = ((1 / (1 + np.exp(-z)) - labels[rows]) * w).astype(np.float32)
        dfilters, dbias = np.zeros_like(filters), np.zeros_like(bias)
        for group in groups:
            if kept is None:
                own, counts, x = group()
                best, top = self._pooled(filters, bias, x)
            else:
                own, counts, x, best, top = kept
            dtop = np.repeat(dz[own, None] * out[None, :] / n[own, None], counts, axis=0) * (top > 0)
            cols, line = np.broadcast_to(np.arange(FILTERS), best.shape), np.arange(len(x))[:, None]
            for j in range(WIDTH):
                np.add.at(dfilters[j], (x[line, best + j], cols), dtop)
            dbias = dbias + dtop.sum(axis=0)
        return [dfilters + 1e-6 * filters, dbias, mean.T @ dz + 1e-4 * out, np.array([dz.sum()], np.float32)]

    def fit(self, chunks: Texts, labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Model:
        """Adam on the weighted log loss; ``chunks``: per row, a matrix of its chunks' bytes with ``WIDTH`` zeros behind."""
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels[0]) if len(labels) else 0.5
            return self
        rng = np.random.default_rng(seed)
        params = [self.filters, self.bias, self.out, np.zeros(1, np.float32)]
        params[3][0] = 0.5
        m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(chunks))
            rate = 0.02 * (1 - 0.9 * epoch / epochs)
            for k in range(0, len(order), 64):
                rows = order[k : k + 64]
                grads = self._gradients(params, chunks, rows, labels, weights)
                step += 1
                for p, g, a, b in zip(params, grads, m1, m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.shift = params[3][0]
        return self


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from ``labels`` (key, label) of documents that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(key).cast("long").alias("d"), F.col(label).cast("int").alias("y")).filter("d is not null and y is not null")
    known = known.filter(~held_out("d")).groupBy("d").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(key).cast("long").alias("e")), F.col("d") == F.col("e"), "left_semi")
    counts = {r["y"]: r["n"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for y in counts:
        picked += [(r["d"], y) for r in known.filter((F.col("y") > 0).cast("int") == y).orderBy(F.xxhash64("d"), "d").limit(per_class).collect()]
    sample = docs.sparkSession.createDataFrame(picked, "d long, y int") if picked else known.limit(0)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("d")).select("doc_id", "text", "y")
    rows = written(rows.orderBy("doc_id", "text").withColumn("n", F.monotonically_increasing_id()), "sample")
    y, numbers = [], []

    def texts() -> Iterator[bytes]:
        # one partition at a time, so that the driver never holds all texts
        for r in rows.orderBy("n").toLocalIterator():
            y.append(r["y"])
            numbers.append(r["n"])
            yield (r["text"] or "").encode()

    def far(i: int, at: int, n: int) -> bytes:
        return bytes(rows.filter(F.col("n") == numbers[i]).select(F.substring(F.col("text").cast("binary"), at + 1, n)).first()[0])

    chunks = Texts(texts(), far)
    y = np.array(y, np.float32)
    share = {k: counts[k] / max(1, (y == k).sum()) for k in counts}
    return Model().fit(chunks, y, np.array([share[int(k)] for k in y], np.float32))


def _scored(model: Model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pairs()
        for block in blocks(batches):
            s = model.score(*raw(block.column(block.num_columns - 1)), tables)
            yield pa.record_batch([*block.columns[:-1], pa.array(s)], names=[*block.schema.names[:-1], "score"])

    return run


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double")


def _passing(model: Model, at: int, threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pairs()
        for batch in batches:
            for block in blocks(iter([batch]), batch.schema.names[at]):
                s = model.score(*raw(block.column(at)), tables)
                yield block.filter(pa.array(s >= threshold))

    return run


def good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_passing(model, docs.columns.index(text), threshold), docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
