"""Quality classifier: a small byte-level convolutional network in numpy.

Bytes are embedded, filters of `WIDTH` bytes run over the whole document at every `STEP` bytes,
and their responses are max-pooled over overlapping chunks. A document's vector holds each
filter's maximum and mean over all chunks; one logistic unit turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import flat_bytes, held_out, query, table, text_chunks

STEP, WIDTH, BLOCK = 4, 8, 128  #: a chunk is two blocks of 128 bytes and overlaps its neighbours by one
_DEPTH, _FILTERS = 8, 24
_TRAIN_BYTES = 4096


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    unit: np.ndarray
    offset: float


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents from block boundaries on, zeros between them; the first block of each document and one past the last."""
    lengths = np.diff(offsets)
    blocks = (lengths + WIDTH + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks)])
    flat = np.zeros(first[-1] * BLOCK, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], lengths)] = data
    return flat, first


def _responses(net: Network, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embedded steps, and each filter's response at each step; at a document's last step, all zeros, the caller sets it to the bias."""
    x = net.embed[flat].reshape(-1, STEP * _DEPTH)
    half = STEP * _DEPTH
    both = x @ np.concatenate([net.filters[:half], net.filters[half:]], axis=1)
    y = both[:, :_FILTERS]
    y[:-1] += both[1:, _FILTERS:]
    y += net.bias
    return x, y


def _pooled(peaks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, filters' maxima and means over its chunks; also the chunks themselves."""
    chunk = peaks.copy()
    chunk[:-1] = np.maximum(chunk[:-1], peaks[1:])
    last = first[1:] - 1
    chunk[last] = peaks[last]
    total = np.add.reduceat(chunk, first[:-1], axis=0)
    return np.concatenate([np.maximum.reduceat(peaks, first[:-1], axis=0), total / np.diff(first)[:, None]], axis=1), chunk


def predict(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each document; all bytes of it count."""
    if len(offsets) < 2:
        return np.zeros(0)
    flat, first = _padded(data, offsets)
    peaks = np.empty((len(flat) // BLOCK, _FILTERS), np.float32)
    span, per = 2048, BLOCK // STEP
    last = first[1:] * per - 1  # their windows would reach into the next document
    for at in range(0, len(peaks), span):
        to = min(len(peaks), at + span)
        _, y = _responses(net, flat[at * BLOCK : to * BLOCK + STEP * (to < len(peaks))])
        y[last[np.searchsorted(last, at * per) : np.searchsorted(last, to * per)] - at * per] = net.bias
        peaks[at:to] = y[: (to - at) * (BLOCK // STEP)].reshape(to - at, BLOCK // STEP, _FILTERS).max(1)
    vector, _ = _pooled(np.maximum(peaks, 0), first)
    return 1 / (1 + np.exp(-np.clip(vector @ net.unit + net.offset, -30, 30).astype(np.float64)))


def fit_network(texts: list[bytes], labels: np.ndarray, epochs: int = 14, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the log loss; of a long training text, each epoch takes another stretch of 4,096 bytes."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, _DEPTH)).astype(np.float32), rng.normal(0, 0.12, (WIDTH * _DEPTH, _FILTERS)).astype(np.float32), np.zeros(_FILTERS, np.float32), rng.normal(0, 0.1, 2 * _FILTERS).astype(np.float32), 0.0)
    net.embed[0] = 0
    if not texts:
        return net
    moments = {k: [0.0, 0.0] for k in ("embed", "filters", "bias", "unit", "offset")}
    step, half, size = 0, STEP * _DEPTH, 64
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            parts = []
            for i in pick:
                start = int(rng.integers(0, max(1, len(texts[i]) - _TRAIN_BYTES + 1)))
                parts.append(texts[i][start : start + _TRAIN_BYTES])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            flat, first = _padded(np.frombuffer(b"".join(parts), np.uint8), offsets)
            x, y = _responses(net, flat)
            last = np.zeros(len(x), bool)
            last[first[1:] * (BLOCK // STEP) - 1] = True
            y[last] = net.bias
            inside = y.reshape(-1, BLOCK // STEP, _FILTERS)
            where = inside.argmax(1)
            peaks = np.maximum(np.take_along_axis(inside, where[:, None], 1)[:, 0], 0)
            vector, chunk = _pooled(peaks, first)
            p = 1 / (1 + np.exp(-np.clip(vector @ net.unit + net.offset, -30, 30)))
            g = ((p - labels[pick]) / len(pick)).astype(np.float32)
            grads = {"unit": vector.T @ g + 1e-4 * net.unit, "offset": float(g.sum())}
            up = g[:, None] * net.unit
            doc = np.repeat(np.arange(len(pick)), np.diff(first))
            dmax = up[doc, :_FILTERS] * (peaks >= vector[doc, :_FILTERS])
            dmean = up[doc, _FILTERS:] / np.diff(first)[doc, None]
            own = dmean * (chunk == peaks)
            before = np.zeros_like(own)
            before[1:] = (dmean * (chunk != peaks))[:-1]
            d = (dmax + own + before) * (peaks > 0)
            row, f = np.nonzero(d)
            d = d[row, f]
            pos = row * (BLOCK // STEP) + where[row, f]
            after = np.minimum(pos + 1, len(x) - 1)
            window = np.concatenate([x[pos], np.where(last[pos, None], 0, x[after])], axis=1)
            dw = np.stack([d[f == k] @ window[f == k] for k in range(_FILTERS)])
            db = np.bincount(f, d, _FILTERS)
            dx = d[:, None] * net.filters.T[f]
            dx[last[pos], half:] = 0
            dx = dx.reshape(-1, _DEPTH)
            codes = flat.reshape(-1, STEP)
            codes = np.concatenate([codes[pos], codes[after]], axis=1).ravel()
            de = np.stack([np.bincount(codes, dx[:, k], 256) for k in range(_DEPTH)], axis=1)
            de[0] = 0
            grads |= {"filters": dw.T, "bias": db, "embed": de}
            step += 1
            speed = rate * (0.5 if epoch >= epochs // 2 else 1) * (0.3 if epoch >= epochs * 5 // 6 else 1)
            for k, gr in grads.items():
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * gr
                m[1] = 0.999 * m[1] + 0.001 * np.square(gr)
                new = getattr(net, k) - speed * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, new if k == "offset" else new.astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, longest: int = 200_000) -> Network:
    """A network from at most `per_class` labelled rows of each class, with texts of at most `longest` bytes (the documented bounds; rows by hash order of the key).

    Null texts count as empty, null labels don't count. Of a key's labels the smallest counts, of its texts the first in byte order. Its offset is moved so that the sample's class balance, which differs
    from the table's, doesn't shift the probabilities.
    """
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).alias("_y"))
    marks = marks.groupBy("_k").agg(F.min("_y").alias("_y"))
    shares = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return fit_network([], np.zeros(0))
    order = F.xxhash64(F.col("_k"))
    picked = None
    for y, n in sorted(shares.items()):
        part = marks.where((F.col("_y") == y) & (F.pmod(order, F.lit(1_000_000)) < int(min(1.0, 2.0 * per_class / n) * 1_000_000) + 1)).orderBy(order).limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    # at most two times per_class keys, so they are few enough to send to every task
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"))
    rows = rows.where(F.length("_t") <= longest).join(F.broadcast(picked), "_k").toPandas()
    rows["_t"] = [bytes(t) for t in rows["_t"]]
    rows = rows.sort_values(["_k", "_t"]).drop_duplicates("_k")
    y = rows["_y"].to_numpy().astype(np.float32)
    net = fit_network(rows["_t"].tolist(), y)
    if len(shares) == 2 and 0 < y.mean() < 1:
        net.offset += float(np.log(shares[1] / shares[0]) - np.log(y.mean() / (1 - y.mean())))
    return net


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Columns (key, score, predicted) of every row; null and empty texts get the network's score for no bytes.

    Equal texts get equal scores, whatever their keys; repeated rows come out as often. Empty tables give no rows; other columns are ignored.
    """

    def run(batches):
        for batch in text_chunks(batches, "t", 1 << 20):
            p = predict(net, *flat_bytes(batch.column("t")))
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, score double, predicted int").withColumnRenamed("k", key)


@query("op7_quality_cnn")
def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    net = fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
