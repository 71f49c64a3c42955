"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes; every one is encoded, over the whole
text. An encoder maps a passage's features to a vector; gated attention (tanh times
sigmoid) weighs the vectors; the weighted sum gives the probability of label 1. Only
documents have labels: encoder, attention and output are trained together from them,
with plain numpy on the driver, from at most ``SAMPLE_DOCS`` labelled documents of at most
``SAMPLE_BYTES`` bytes, chosen by a hash of the id: at most 180 MB of features. Rows whose crc32(doc_id) mod 4 is 2
are never learned from. Language, source, id and labels are no inputs of a score.

Features: shares of pairs of byte classes, the share of different words, the share of
words equal to the one before, word length and passage length.

Nulls: a null text is an empty one: one passage without bytes. A null id is not held out
and not learned from. Labels that are null are ignored; where a document has several, the
least holds; where a labelled id has several texts, one is learned from, the first in order. Repeated rows are scored each, alike. An empty table gives an empty result;
without any usable label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.llm.common import map_batches, small_batches, utf8

PASSAGE = 1024
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 65_536
THRESHOLD = 0.7
HIDDEN, GATES = 24, 12
CLASSES = 13


def _byte_classes() -> np.ndarray:
    out = np.full(256, 12, np.int64)
    out[128:] = 11
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"'\"-()", b"|/\\_<>[]{}=+", b"#$%&*@^~")):
        out[list(chars)] = k
    return out


BYTE_CLASS = _byte_classes()
FEATURES = CLASSES * CLASSES + 4


def passage_features(text: bytes) -> np.ndarray:
    """(passages, FEATURES) of a whole text; an empty text has one passage of zeros."""
    if not text:
        return np.zeros((1, FEATURES))
    kind = BYTE_CLASS[np.frombuffer(text, np.uint8)]
    pair = kind.copy()
    pair[1:] += CLASSES * kind[:-1]
    pair[0] += CLASSES * 4  # a text begins like a line
    n = -(-len(text) // PASSAGE)
    where = np.arange(len(text)) // PASSAGE
    size = np.minimum(PASSAGE, len(text) - PASSAGE * np.arange(n))
    out = np.empty((n, FEATURES))
    pairs = np.bincount(where * CLASSES**2 + pair, minlength=n * CLASSES**2).reshape(n, -1)
    out[:, :-4] = np.sqrt(pairs / size[:, None])
    for i in range(n):
        words = text[i * PASSAGE : (i + 1) * PASSAGE].split()
        many = max(1, len(words))
        twice = sum(map(bytes.__eq__, words, words[1:]))
        out[i, -4:] = len(set(words)) / many, twice / many, min(size[i] / many, 40) / 10, np.log1p(size[i]) / 7
    return out


class Model:
    """Gated attention over encoded passages."""

    def __init__(self, features: int = FEATURES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.p = {
            "e": rng.normal(0, features**-0.5, (features, HIDDEN)),
            "eb": np.zeros(HIDDEN),
            "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)),
            "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)),
            "w": rng.normal(0, GATES**-0.5, GATES),
            "o": np.zeros(HIDDEN),
            "ob": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (t * g) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-(z @ p["o"] + p["ob"])))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def scores(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A score for each bag, and all passages' attention weights in order."""
        sizes = np.array([len(b) for b in bags])
        f = self._forward(self._scaled(np.concatenate(bags)), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes))
        return f["y"], f["a"]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
        n, total, squares = sum(map(len, bags)), np.zeros(bags[0].shape[1]), np.zeros(bags[0].shape[1])
        for b in bags:
            total += b.sum(0, dtype=np.float64)
        self.mean = total / n
        for b in bags:
            squares += ((b - self.mean) ** 2).sum(0)
        self.scale = np.sqrt(squares / n) + 0.05
        rng = np.random.default_rng(seed)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                grads = self._gradients([self._scaled(bags[k]) for k in pick], labels[pick])
                step += 1
                now = rate * (1 - epoch / epochs) + 1e-4
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, bags: list[np.ndarray], labels: np.ndarray) -> dict:
        sizes = np.array([len(b) for b in bags])
        bag, starts, x, p = np.repeat(np.arange(len(bags)), sizes), np.cumsum(sizes) - sizes, np.concatenate(bags), self.p
        f = self._forward(x, starts, bag)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        dy = (f["y"] - labels) / len(bags)  # of the log loss, before the last sigmoid
        dz = dy[:, None] * p["o"]
        from_z = dz[bag]
        da = (from_z * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * from_z + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ ds, "o": f["z"].T @ dy, "ob": dy.sum(keepdims=True)}


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS) -> Model | None:
    """A model of the labelled documents that are not held out; None without any."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().filter(~held_out(F.col("id")))
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = found.filter(F.octet_length("text") <= SAMPLE_BYTES)
    chosen = usable.groupBy("id").agg(F.min("y").alias("y")).join(found.select("id").distinct(), "id")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded: fits a broadcast
    small_batches(docs.sparkSession)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [passage_features(t).astype("<f4").tobytes() for t in utf8(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "y", "x"])

    rows = found.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # one row an id
    bags = {r["id"]: r for r in map_batches(rows, one, "id long, y int, x binary").collect()}
    if not bags:
        return None
    order = sorted(bags)
    x = [np.frombuffer(bags[i]["x"], "<f4").reshape(-1, FEATURES) for i in order]
    return Model().fit(x, np.array([bags[i]["y"] for i in order], np.float64))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of label 1. All columns stay; one named ``out`` is replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    at = kept.index(text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            found = np.full(batch.num_rows, 0.5)
        else:
            found = np.empty(batch.num_rows)
            texts = utf8(batch.column(at))
            for i in range(0, len(texts), 32):
                found[i : i + 32] = model.scores([passage_features(t or b"") for t in texts[i : i + 32]])[0]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*kept, out])

    kinds = docs.select(*kept).schema.add(out, "double")
    return map_batches(docs.select(*kept), one, kinds)


def op9_quality_attention(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
