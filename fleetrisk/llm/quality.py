"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of which only the whole is labelled. Every passage is encoded, a gated attention
network weighs the passages, and the weighted sum is scored: junk in a few passages of a long text is found although
no passage was ever labelled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_binary, texts, tidy

PASSAGE_BYTES = 512
TRIGRAM_BINS = 64
SET_BINS = 4096
AT_ONCE = 2048  # passages that are encoded at once
SAMPLE_ROWS = 6000  # labelled documents that the model is fitted on, the smallest by hash
SAMPLE_PASSAGES = 32  # evenly spread passages of one sampled document that training looks at; scoring reads all
KINDS = 11
FEATURES = KINDS + 3 + TRIGRAM_BINS


def kinds_of_bytes() -> np.ndarray:
    kind = np.full(256, 10)
    kind[128:] = 0
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"|/\\", b"#$%&*@^~+=<>"), 1):
        kind[list(chars)] = k
    return kind


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of all texts and the text of each row. A text without bytes is one empty passage."""
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    owner = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][owner] + place * PASSAGE_BYTES
    size = np.clip(lengths[owner] - place * PASSAGE_BYTES, 0, PASSAGE_BYTES)
    kinds, out = kinds_of_bytes().astype(np.uint8), np.zeros((len(owner), FEATURES), np.float32)
    column = np.arange(PASSAGE_BYTES)
    for at in range(0, len(owner), AT_ONCE):
        s, n = start[at : at + AT_ONCE], size[at : at + AT_ONCE]
        real = column[None, :] < n[:, None]
        chars = data[np.minimum(s[:, None] + column[None, :], max(0, len(data) - 1))] * real if len(data) else np.zeros((len(s), PASSAGE_BYTES), np.uint8)
        kind = kinds[chars]
        part, whole = out[at : at + AT_ONCE], np.maximum(n, 1)[:, None]
        for k in range(KINDS):
            part[:, k] = ((kind == k) & real).sum(axis=1)
        part[:, :KINDS] /= whole
        wide = chars.astype(np.int64)
        grams = (wide[:, :-3] * 31 + wide[:, 1:-2]) * 31 + wide[:, 2:-1]
        ok = real[:, 3:]
        row = np.broadcast_to(np.arange(len(s))[:, None], ok.shape)[ok]
        three = grams[ok] * 40503 >> 4 & TRIGRAM_BINS - 1
        bins = np.bincount(row * TRIGRAM_BINS + three, minlength=len(s) * TRIGRAM_BINS).reshape(len(s), -1)
        part[:, KINDS + 3 :] = np.sqrt(bins / whole)
        four = (grams * 31 + wide[:, 3:])[ok] * 2654435761 >> 9 & SET_BINS - 1
        seen = np.zeros((len(s), SET_BINS), bool)
        seen[row, four] = True
        part[:, KINDS] = seen.sum(axis=1) / np.maximum(ok.sum(axis=1), 1)
        part[:, KINDS + 1] = n / PASSAGE_BYTES
        part[:, KINDS + 2] = ((kind == 4) & real).sum(axis=1) / np.maximum(1, ((kind == 6) & real).sum(axis=1))
    return out, owner


class AttentionModel:
    """Encoder ``h = relu(xW + b)``, gated attention ``softmax(w . (tanh(hV) * sigmoid(hU)))`` within a bag, logistic score."""

    def __init__(self, features: int, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = {"W": (features, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "o": (hidden,), "c": ()}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]) if s else 0.0, s) if k not in "bc" else np.zeros(s) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int):
        """``x`` sorted by bag, every bag with a row at least."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        first = np.searchsorted(bag, np.arange(bags))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return y, (x, h, t, g, a, z, first)

    def fit(self, x: np.ndarray, bag: np.ndarray, labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> AttentionModel:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng, first = np.random.default_rng(seed), np.searchsorted(bag, np.arange(len(labels) + 1))
        m, v, step = {k: np.zeros_like(q) for k, q in self.p.items()}, {k: np.zeros_like(q) for k, q in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
                own = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
                grads, step = self._gradients(x[rows], own, labels[pick]), step + 1
                for k, q in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x, bag, labels, decay: float = 1e-4):
        p, n = self.p, len(labels)
        y, (x, h, t, g, a, z, first) = self.forward(x, bag, n)
        dy = (y - labels) / n
        dz = dy[:, None] * p["o"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
        out = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "o": z.T @ dy, "c": np.asarray(dy.sum())}
        return {k: q + decay * p[k] if k not in "bc" else q for k, q in out.items()}


def held_out(doc_id):
    """One quarter of the ids, by crc32 of the id as text; their labels are never read."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AttentionModel:
    """Fit on the ``sample_rows`` labelled documents smallest by hash among those that are not held out.

    Only ids are ranked; the rows chosen join by a bounded list, executors encode them, and at most
    ``SAMPLE_PASSAGES`` feature rows a document reach the driver. Labels that are null count as absent; of several
    labels of one id the lowest holds. Without any label every document scores 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, owner = encode(*arrow_binary(batch.column(1)))
            bags = [x[owner == i] for i in range(batch.num_rows)]
            bags = [b[np.unique(np.linspace(0, len(b) - 1, SAMPLE_PASSAGES).astype(int))] for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b.tobytes() for b in bags])], ["doc_id", "quality", "bag"])

    chosen = texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    rows = chosen.mapInArrow(tidy(run), "doc_id long, quality int, bag binary").collect()
    rows = sorted(((r.doc_id, r.quality, bytes(r.bag)) for r in rows))[:sample_rows]
    model = AttentionModel(FEATURES)
    if not rows:
        model.p["o"] = np.zeros_like(model.p["o"])
        return model
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
    return model.fit(np.concatenate(bags).astype(np.float64), np.repeat(np.arange(len(bags)), list(map(len, bags))), np.array([float(r[1] > 0) for r in rows]))


def score_batch(column, model: AttentionModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, numbers of passages and largest weights of an Arrow column of texts."""
    data, offsets = arrow_binary(column)
    rows = len(column)
    y, n, top, at = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows), 0
    while at < rows:  # so many rows that their passages fit in memory; a very long text goes alone
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), "right")) - 1)
        end = min(end, rows, at + 8192)
        x, owner = encode(data, offsets[at : end + 1])
        y[at:end], made = model.forward(x, owner, end - at)
        n[at:end], top[at:end] = np.bincount(owner, minlength=end - at), np.maximum.reduceat(made[4], made[6])
        at = end
    return y, n, top


def score(docs: DataFrame, model: AttentionModel, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted, n_passages, top_weight`` for every row of ``docs``; a null or empty text is one empty passage."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            y, n, top = score_batch(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y), pa.array((y >= threshold).astype(np.int32)), pa.array(n), pa.array(top)], ["doc_id", "score", "predicted", "n_passages", "top_weight"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, score double, predicted int, n_passages long, top_weight double")


def keep(docs: DataFrame, model: AttentionModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more; one pass without a shuffle."""
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            y = score_batch(batch.column(place), model)[0]
            yield batch.filter(pa.array(y >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
