"""Quality classifier: attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import discard, small_batches, written

#: Bytes of a passage; folds, of which the first is held out.
PASSAGE, FOLDS = 512, 5
#: Labelled documents that the model is fitted on at most, and their passages in all: documents are taken, whole, in
#: order of a hash of their ids until the next one would exceed either.
SAMPLE, SAMPLE_PASSAGES = 4000, 60_000
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 24, 12, 30, 0.01, 1e-4
CUT = 0.3

#: Classes of bytes: white space, digits, letters by case, bytes over 127, and each sign of ASCII by itself.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CLASSES = 6 + len(_SIGNS)


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[ord("\n")] = 1
    table[48:58] = 2
    table[97:123] = 3
    table[65:91] = 4
    table[128:] = 5
    for i, c in enumerate(_SIGNS):
        table[c] = 6 + i
    return table


_TABLE = _classes()
_PAIRS = 64
FEATURES = CLASSES + _PAIRS + 8


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage, over the whole text; an empty text is one empty passage.

    Shares of character classes, of hashed pairs of neighbouring classes, of capitals and signs, and of different and
    of immediately repeated words. A pair belongs to the passage of its first character.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros((1, FEATURES), dtype=np.float32)
    n = -(-len(raw) // PASSAGE)
    kind = _TABLE[raw]
    at = np.arange(len(raw)) // PASSAGE
    size = np.bincount(at, minlength=n).astype(np.float32)[:, None]
    out = np.empty((n, FEATURES), dtype=np.float32)
    out[:, :CLASSES] = np.bincount(at * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size
    pair = (kind[:-1] * 31 + kind[1:] * 7 + (kind[:-1] * kind[1:]) % 13) % _PAIRS
    out[:, CLASSES : CLASSES + _PAIRS] = np.bincount(at[:-1] * _PAIRS + pair, minlength=n * _PAIRS).reshape(n, _PAIRS) / size
    extra = out[:, CLASSES + _PAIRS :]
    blank = out[:, 0] + out[:, 1]
    letters = out[:, 3] + out[:, 4] + out[:, 5]
    extra[:, 0] = np.minimum(1, blank * 2)
    extra[:, 1] = out[:, 4] / np.maximum(letters, 1e-3)
    extra[:, 2] = out[:, 6:CLASSES].sum(axis=1)
    extra[:, 3] = np.minimum(size[:, 0] / PASSAGE, 1)
    joint = (kind[1:] >= 6) & (kind[:-1] >= 6)
    extra[:, 4] = np.bincount(at[:-1], weights=joint, minlength=n) / size[:, 0]
    extra[:, 5] = np.log1p(n) / 8
    for i in range(n):
        words = data[i * PASSAGE : (i + 1) * PASSAGE].split()
        extra[i, 6:] = (len(set(words)) / len(words), sum(map(bytes.__eq__, words, words[1:])) / len(words)) if words else (0, 0)
    return out


class Model:
    """score = sigmoid(c . sum_k a_k h_k + b), h = tanh(W x), a = softmax(w . (tanh(V h) * sigmoid(U h)))."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": draw(FEATURES, HIDDEN), "d": np.zeros((1, HIDDEN), np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1), "c": draw(HIDDEN, 1), "b": np.zeros((1, 1), np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        """x: passages of documents end to end, standardised."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["d"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = ((v * u) @ p["w"])[:, 0]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a = (e / np.add.reduceat(e, starts)[doc])[:, None]
        z = np.add.reduceat(a * h, starts, axis=0)
        logit = np.clip((z @ p["c"])[:, 0] + p["b"][0, 0], -30, 30)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "doc": doc, "starts": starts, "s": 1 / (1 + np.exp(-logit))}

    def gradients(self, f: dict, y: np.ndarray) -> dict:
        p, doc = self.p, f["doc"]
        g = ((f["s"] - y) / len(y))[:, None].astype(np.float32)
        out = {"c": f["z"].T @ g, "b": g.sum(keepdims=True)}
        dz = (g @ p["c"].T)[doc]
        da = (dz * f["h"]).sum(axis=1, keepdims=True)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"], axis=0)[doc])
        vu = f["v"] * f["u"]
        out["w"] = vu.T @ de
        dvu = de @ p["w"].T
        dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
        out["V"], out["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (f["a"] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        out["W"], out["d"] = f["x"].T @ dh, dh.sum(axis=0, keepdims=True)
        return out

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Model:
        whole = np.concatenate(bags)
        self.mean, self.scale = whole.mean(axis=0), whole.std(axis=0) + 0.02
        bags = [(b - self.mean) / self.scale for b in bags]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, step = np.random.default_rng(seed), 0
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for i in range(0, len(order), 64):
                part = order[i : i + 64]
                sizes = np.array([len(bags[k]) for k in part])
                f = self.forward(np.concatenate([bags[k] for k in part]), np.cumsum(sizes) - sizes, sizes)
                step += 1
                for k, g in self.gradients(f, labels[part]).items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    q[k] = 0.999 * q[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, np.cumsum(sizes) - sizes, sizes)["s"]


def fold(doc_id) -> F.Column:
    """crc32 of the id's decimal text, modulo FOLDS; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [passages(t) for t in b.column(0).to_pylist()]
        yield pa.record_batch([pa.array([len(x) for x in bags], pa.int32()), pa.array([x.astype(np.float16).tobytes() for x in bags], pa.binary()), b.column(1), b.column(2)], names=["n", "bag", "label", "id"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, most: int = SAMPLE_PASSAGES) -> tuple[list[np.ndarray], np.ndarray]:
    """(bags, labels) of at most `rows` labelled documents outside the held-out fold, with all of their passages, which
    are `most` in all unless the first document alone has more. Documents come in order of a hash of their ids. Of
    texts with one id, the one with the least features counts; labels that differ count as the greater."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = known.where(fold(F.col("_id")) != 0).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # the sample's size is bounded by its parameter, so its ids can be sent to every executor
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    made = texts.select("text", "label", "_id").mapInArrow(_bags, "n int, bag binary, label int, id long")
    made = written(made.groupBy("id").agg(F.min(F.struct("n", "bag", "label")).alias("x")).select("id", "x.*"), "sample")
    sizes = made.select("id", "n").orderBy(F.xxhash64("id"), "id").toArrow()  # `rows` rows at most
    total = np.cumsum(sizes.column("n").to_numpy()) if len(sizes) else np.zeros(0, int)
    taken = sizes.column("id").to_pylist()[: max(1, int((total <= most).sum()))]
    got = made.where(F.col("id").isin(taken)).toArrow() if taken else made.toArrow()
    discard(made)
    order = sorted(zip(got.column("id").to_pylist(), got.column("bag").to_pylist(), got.column("label").to_pylist()))
    return [np.frombuffer(b, dtype=np.float16).reshape(-1, FEATURES).astype(np.float32) for _, b, _ in order], np.array([int(x > 0) for *_, x in order], dtype=np.float32)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, most: int = SAMPLE_PASSAGES) -> Model | None:
    """A model from the sample; None if no label of either kind is there. Only features of the sample reach the
    driver."""
    bags, y = sample(docs, labels, rows, most)
    return None if not len(y) or y.min() == y.max() else Model().fit(bags, y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row and column of docs, with score and predicted (score >= 0.3), from every passage of the whole text.

    Null and empty texts are one empty passage. Without a model (no labels to learn from) every score is 0.5.
    Columns named score or predicted are replaced. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            if model is not None and b.num_rows:
                texts = b.column(1).to_pylist()
                for k in range(0, len(texts), 100):
                    s[k : k + 100] = model.score([passages(t) for t in texts[k : k + 100]])
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
