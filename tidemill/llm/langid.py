"""Language identification by a convolutional network over bytes, trained here in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows, each filter keeps its largest value in
the window (max pooling), and a softmax layer gives a probability for each language. A text's probabilities are the
mean over all its windows, weighted by their bytes. Windows overlap by the widest filter less one byte, so every
position of the whole text is seen, and equal texts get equal results.

Training reads a bounded sample of labelled rows: at most ``SAMPLE`` rows of each language, fewer where there are so
many languages that these would be more than ``SAMPLE_ROWS``, but one at least. Rows are taken in the order of a
digest of id and text, so the sample is the same in every run. Their whole texts are read, and every language found
is learned. Only text and label are used. Rows whose crc32(id) mod ``FOLDS`` is 0 are held out. The network (a few
thousand numbers) goes to the tasks, which classify batches of windows.

Defined results: a null text, or one without a letter, gets ``und`` with score 0; without labelled rows every text is
``und``; repeated rows each get a row; an empty table gives no rows; a label that is blank is one like others; other
columns of the input pass through, ``lang_pred`` and ``score`` are replaced where the input has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemill.llm.names import unused, without
from tidemill.session import stage

FOLDS = 5
#: Rows of a language in the training sample, and rows of all languages; with more languages than that each still gives one row.
SAMPLE, SAMPLE_ROWS = 500, 50_000
WINDOW, WIDTHS, FILTERS, DIMS = 512, (2, 3, 4, 5), 8, 8
BATCH, RATE, SEED = 32, 0.004, 11
#: Training steps, a batch of windows each, whatever the number of windows.
STEPS = 1250
#: Languages whose shares are sent to every task.
BROADCAST_LANGUAGES = 100_000
#: Windows that are classified together.
CHUNK = 32
UNKNOWN = "und"
WIDEST = max(WIDTHS)
PAD = 256

_LETTER = regex.compile(r"\p{L}")


class Net:
    """Embedding, filters, max pooling, softmax."""

    def __init__(self, languages: list[str], rng: np.random.Generator):
        self.languages = languages
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((WIDEST, DIMS, n), dtype=np.float32)
        for k, width in enumerate(WIDTHS):  # a narrow filter has zeros beyond its width
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(WIDEST * DIMS, n)
        self.embedding = rng.normal(0, 0.5, (PAD + 1, DIMS)).astype(np.float32)
        self.embedding[PAD] = 0
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, dtype=np.float32)
        self.out = rng.normal(0, 0.3, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, WIDEST * DIMS): the embedded bytes under a filter at each position."""
        e = self.embedding[windows]
        shape = (e.shape[0], e.shape[1] - WIDEST + 1, WIDEST * DIMS)
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, shape, (e.strides[0], e.strides[1], e.strides[2])))

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.patches(windows)
        z = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(x.shape[0], x.shape[1], -1)
        return x, z, np.maximum(z.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.pooled(windows)[2] @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        x, z, a = self.pooled(windows)
        logits = a @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = p
        d[np.arange(len(labels)), labels] -= 1
        d /= len(labels)
        da = (d @ self.out.T) * (a > 0)
        best = z.argmax(axis=1)
        under = np.take_along_axis(x, best[:, :, None], axis=1)  # patches where each filter was largest
        df = np.einsum("bfk,bf->kf", under, da) * self.mask
        dx = (da[:, :, None] * self.filters.T[None]).reshape(-1, DIMS)
        at = np.take_along_axis(windows, (best[:, :, None] + np.arange(WIDEST)).reshape(len(windows), -1), axis=1).ravel()
        de = np.stack([np.bincount(at, dx[:, k], PAD + 1) for k in range(DIMS)], axis=1).astype(np.float32)
        de[PAD] = 0
        return [de, df.astype(np.float32), da.sum(axis=0), a.T @ d, d.sum(axis=0)]


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the number of its bytes in each."""
    step = WINDOW - WIDEST + 1
    n = max(1, -(-(len(data) - WIDEST + 1) // step))
    flat = np.full((n - 1) * step + WINDOW, PAD, dtype=np.int16)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    starts = np.arange(n) * step
    return flat[starts[:, None] + np.arange(WINDOW)], np.minimum(len(data) - starts, WINDOW)


def fit(texts: list[str], labels: list[str], seed: int = SEED) -> Net | None:
    """Train on labelled texts with Adam. Windows are cut to random lengths, so that short texts are learned too."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    net, number = Net(languages, rng), {lang: k for k, lang in enumerate(languages)}
    parts, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        w, _ = windows_of(text.encode("utf-8"))
        parts.append(w)
        ys.append(np.full(len(w), number[label]))
    x, y = np.concatenate(parts), np.concatenate(ys)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, STEPS + 1):
        while len(order) < BATCH:  # all windows in random order, again and again
            order = np.concatenate([order, rng.permutation(len(x))])
        rows, order = order[:BATCH], order[BATCH:]
        batch = x[rows].astype(np.int64)
        keep = np.where(rng.random(len(rows)) < 0.5, WINDOW, rng.integers(16, WINDOW, len(rows)))
        batch[np.arange(WINDOW)[None, :] >= keep[:, None]] = PAD
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for p, g, (m, v) in zip(net.parameters(), net.gradients(batch, y[rows]), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def classify(net: Net | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    named, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and net is not None and _LETTER.search(t)]
    pending: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def run() -> None:
        windows = np.concatenate([w for _, w, _ in pending])
        p = np.concatenate([net.probabilities(windows[lo : lo + CHUNK]) for lo in range(0, len(windows), CHUNK)])
        at = 0
        for i, w, size in pending:
            mean = (p[at : at + len(w)] * size[:, None]).sum(axis=0) / size.sum()
            best = int(mean.argmax())
            named[i], scores[i] = net.languages[best], float(min(max(mean[best], 0.0), 1.0))
            at += len(w)

    for i in known:
        w, size = windows_of(texts[i].encode("utf-8"))
        pending.append((i, w, size))
        held += len(w)
        if held >= 1024:
            run()
            pending, held = [], 0
    if pending:
        run()
    return named, scores


def held_out(id_col: str = "doc_id") -> Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS) == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Net | None:
    """Train on a bounded sample of the labelled rows that are not held out."""
    kept = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    labelled = kept.select(F.col(label_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    counts = stage(labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")), "labels")  # a row for each language, read twice
    n = counts.count()
    if not n:
        return None
    most = max(1, min(SAMPLE, SAMPLE_ROWS // n))
    shares = counts.select("l", "first", (F.lit(2.0 * most + 50) / F.col("n")).alias("share"))
    # about twice the rows are let through, so that the ranking meets few; the first row of a language always is
    draw = F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = labelled.join(F.broadcast(shares) if n <= BROADCAST_LANGUAGES else shares, "l").where((draw < F.col("share")) | (F.col("h") == F.col("first")))
    # of equal rows one is taken
    taken = drawn.dropDuplicates(["l", "h"]).withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("place") <= most)
    # written once, and read by the driver one part after another
    rows = sorted((r["l"], r["t"]) for r in stage(taken.select("l", "t"), "training-rows").toLocalIterator())
    return fit([t for _, t in rows], [lang for lang, _ in rows])


def identify(docs: DataFrame, net: Net | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The input with ``lang_pred`` and ``score`` (replaced where the input has them), without the text where that is not wanted."""
    docs = docs.select(*without(docs, "lang_pred", "score"))
    others = [c for c in docs.columns if c != text_col or keep_text]
    given = docs.select(*others, F.col(text_col).cast("string").alias(*unused(docs, "whole_text")))
    schema = StructType([*(given.schema[c] for c in others), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, scores = classify(net, batch.column(len(others)).to_pylist())
            columns = [*batch.columns[: len(others)], pa.array(named, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "lang_pred", "score"])

    return given.mapInArrow(run, schema)
