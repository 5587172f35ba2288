"""Language of texts: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation in time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import discard, small_batches, written

#: Bytes of a stretch that the network reads at once: a text is cut into such stretches, each read from an empty state.
STRETCH = 128
#: Folds by a crc of the id, and the one that nothing is learnt from.
FOLDS, HELD_OUT = 3, 1
#: Documents of each language that the network is fitted on at most, in order of a hash of their ids, stretches of each
#: at most, in order of a hash of their bytes, and languages, the most frequent ones first.
SAMPLE, SAMPLE_STRETCHES, LANGUAGES = 500, 3, 256
STATE, EPOCHS, BATCH, RATE, CLIP = 8, 6, 64, 0.02, 1.0
#: Stretches that are read side by side.
WIDTH = 1024
NONE = "und"

_LETTER = regex.compile(r"\p{L}")


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by place and stretch, sizes, text of each stretch): all bytes of all texts, a short stretch filled up."""
    sizes = np.array([len(t) for t in texts], np.int64)
    per = -(-sizes // STRETCH)
    of = np.repeat(np.arange(len(texts)), per)
    starts = (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * STRETCH
    long = np.minimum(STRETCH, sizes[of] - starts)
    raw = np.frombuffer(b"".join(texts) + bytes(STRETCH), np.uint8)
    begins = (np.cumsum(sizes) - sizes)[of] + starts
    return raw[begins[None, :] + np.arange(STRETCH)[:, None]], long, of


class Network:
    """Of each byte: h = (1 - z) n + z h', z, r = sigmoid(E[x] + U h' + b), n = tanh(E[x] + r (U h' + c) + b), read in both
    directions; the two states at a place give its language's probabilities by a softmax.

    Arrays are laid out (direction, gate and unit, stretch): a step is one stacked product and whole rows of numbers.
    """

    def __init__(self, labels: list[str], seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        h, k = STATE, len(labels)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        self.labels = labels
        self.p = {"E": draw(0.3, 2, 256, 3 * h), "U": draw(1 / np.sqrt(h), 2, 3 * h, h), "c": np.zeros((2, h, 1), np.float32), "W": draw(1 / np.sqrt(2 * h), k, 2 * h), "b": np.zeros((k, 1), np.float32)}

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One byte of each stretch, in both directions: x (2, stretches)."""
        p, m = self.p, STATE
        e = np.stack([p["E"][0].take(x[0], axis=0).T, p["E"][1].take(x[1], axis=0).T])
        u = np.matmul(p["U"], h)
        gates = e[:, : 2 * m] + u[:, : 2 * m]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1.0
        gates *= 0.5
        z, r = gates[:, :m], gates[:, m:]
        u = u[:, 2 * m :] + p["c"]
        n = np.tanh(e[:, 2 * m :] + r * u)
        return n + z * (h - n), z, r, n, u

    @staticmethod
    def _reversed(raw: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Each stretch from its last byte to its first; what fills it up stays behind."""
        at = long[None, :] - 1 - np.arange(len(raw))[:, None]
        return np.take_along_axis(raw, np.where(at < 0, np.arange(len(raw))[:, None], at), axis=0)

    def states(self, raw: np.ndarray, long: np.ndarray) -> np.ndarray:
        """(place, both directions' units, stretch): the forward state after a place and the backward one before it."""
        steps, n, m, p = int(long.max()), raw.shape[1], STATE, self.p
        back = self._reversed(raw[:steps], long)
        # the same steps in place: sigmoids as tanh of halves, whose factors are in the tables, as is c, by a unit of one
        half = np.repeat(np.float32([0.5, 1.0]), [2 * m, m])[None, :, None]
        table = np.ascontiguousarray(p["E"].transpose(0, 2, 1) * half)
        turn = np.concatenate([p["U"] * np.float32(0.5), np.concatenate([np.zeros((2, 2 * m, 1), np.float32), p["c"] * np.float32(0.5)], axis=1)], axis=2)
        h, e, u, new = (np.zeros((2, k, n), np.float32) for k in (m + 1, 3 * m, 3 * m, m))
        h[:, m] = 1
        state, gates, z, r, u3 = h[:, :m], e[:, : 2 * m], e[:, :m], e[:, m : 2 * m], u[:, 2 * m :]
        out = np.empty((steps, 2, m, n), np.float32)
        for t in range(steps):
            np.take(table[0], raw[t], axis=1, out=e[0], mode="clip")
            np.take(table[1], back[t], axis=1, out=e[1], mode="clip")
            np.matmul(turn, h, out=u)
            gates += u[:, : 2 * m]
            np.tanh(gates, out=gates)
            np.multiply(r, u3, out=new)
            new += u3
            new += e[:, 2 * m :]
            np.tanh(new, out=new)
            state -= new
            z += 1
            z *= 0.5
            state *= z
            state += new
            out[t] = state
        # what was read from behind returns to its place
        at = long[None, :] - 1 - np.arange(steps)[:, None]
        at = np.where(at < 0, np.arange(steps)[:, None], at)
        out[:, 1] = np.take_along_axis(out[:, 1], at[:, None, :], axis=0)
        return out.reshape(steps, 2 * STATE, n)

    def places(self, states: np.ndarray) -> np.ndarray:
        """(place, language, stretch): probabilities of each place's languages."""
        logit = np.matmul(self.p["W"], states)
        logit += self.p["b"]
        logit -= logit.max(axis=1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=1, keepdims=True)
        return logit

    def gradients(self, raw: np.ndarray, long: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross entropy of all places, by backpropagation through time."""
        p, m = self.p, STATE
        steps, n = int(long.max()), raw.shape[1]
        x = np.stack([raw[:steps], self._reversed(raw[:steps], long)], axis=1)
        h, kept = np.zeros((2, m, n), np.float32), []
        out = np.empty((steps, 2, m, n), np.float32)
        for t in range(steps):
            new, *rest = self._step(x[t], h)
            kept.append((h, *rest))
            h = out[t] = new
        at = long[None, :] - 1 - np.arange(steps)[:, None]
        at = np.where(at < 0, np.arange(steps)[:, None], at)
        both = out.copy()
        both[:, 1] = np.take_along_axis(out[:, 1], at[:, None, :], axis=0)
        both = both.reshape(steps, 2 * m, n)
        s = self.places(both)
        valid = (np.arange(steps)[:, None] < long[None, :]).astype(np.float32)
        total = valid.sum()
        loss = -float((np.log(s[:, label, np.arange(n)] + 1e-12) * valid).sum() / total)
        s[:, label, np.arange(n)] -= 1
        s *= (valid / total)[:, None, :]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["W"] = np.einsum("tkn,thn->kh", s, both, optimize=True)
        g["b"] = s.sum(axis=(0, 2))[:, None]
        dh = np.matmul(p["W"].T, s).reshape(steps, 2, m, n)
        dh[:, 1] = np.take_along_axis(dh[:, 1], at[:, None, :], axis=0)
        dh *= valid[:, None, None, :]
        carry = np.zeros((2, m, n), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, u = kept[t]
            d = dh[t] + carry
            dn = d * (1 - z) * (1 - new * new)
            dz = d * (before - new) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            de = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            for k in range(2):
                np.add.at(g["E"][k], x[t, k], de[k].T)
            g["U"] += np.matmul(du, before.transpose(0, 2, 1))
            g["c"] += (dn * r).sum(axis=2, keepdims=True)
            carry = d * z + np.matmul(p["U"].transpose(0, 2, 1), du)
        return g, loss

    def fit(self, raw: np.ndarray, long: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam over shuffled batches, with the rate falling to nothing and the gradient's norm bounded."""
        m, q = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        r, step = np.random.default_rng(seed), 0
        whole = epochs * -(-len(label) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(label))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                g, _ = self.gradients(raw[:, part], long[part], label[part])
                norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
                step += 1
                rate = RATE * (1 - (step - 1) / whole)
                for k, x in g.items():
                    x = x * min(1.0, CLIP / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    q[k] = 0.99 * q[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): the mean of the probabilities of all places of each text; nothing for an empty one."""
        out = np.zeros((len(texts), len(self.labels)))
        raw, long, of = stretches(texts)
        # stretches of like size are read together, so that few steps are taken for what only fills up
        order = np.argsort(-long, kind="stable")
        for i in range(0, len(order), WIDTH):
            part = order[i : i + WIDTH]
            s = self.places(self.states(raw[:, part], long[part]))
            s *= (np.arange(len(s))[:, None] < long[part][None, :])[:, None, :]
            np.add.at(out, of[part], s.sum(axis=0, dtype=np.float64).T)
        return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def fold(doc_id) -> F.Column:
    """crc32 of the id's decimal text, modulo FOLDS; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def sample(docs: DataFrame, rows: int = SAMPLE, each: int = SAMPLE_STRETCHES, most: int = LANGUAGES) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(bytes, sizes, labels, languages) of at most `rows` documents of each language outside the held-out fold.

    Only `most` languages, `rows` documents and `each` stretches of 128 bytes reach the driver: about 200 KB a language. A
    language's documents are thinned by their share of a hash before they are ranked, so no task ranks them all.
    """
    from pyspark.sql import Window

    small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("id")) != HELD_OUT))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    near = known.join(F.broadcast(sizes), "lang").withColumn("u", spread).where(F.col("u") * F.col("n") <= 2 * rows + 50)
    near = written(near.select("lang", "u", "id", "text"), "near")
    ranked = near.select("lang", "u", "id", F.row_number().over(Window.partitionBy("lang").orderBy("u", "id")).alias("rank")).where(F.col("rank") <= rows)
    chosen = near.join(F.broadcast(ranked.select("lang", "u", "id").distinct()), ["lang", "u", "id"]).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            raw, long, of = stretches(texts)
            rank = np.array([hash_of(raw[:, i]) for i in range(raw.shape[1])], np.uint64)
            order = np.lexsort([rank, of])
            place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
            taken = order[place < each]
            yield pa.record_batch([b.column(0).take(pa.array(of[taken])), pa.array([raw[: long[i], i].tobytes() for i in taken], pa.binary())], names=["lang", "bytes"])

    got = chosen.mapInArrow(cut, "lang string, bytes binary").toArrow()
    discard(near)
    rows_ = sorted(set(zip(got.column(0).to_pylist(), got.column(1).to_pylist())))
    labels = sorted({lang for lang, _ in rows_})
    raw, long, _ = stretches([x for _, x in rows_]) if rows_ else (np.zeros((STRETCH, 0), np.uint8), np.zeros(0, np.int64), None)
    return raw, long, np.array([labels.index(lang) for lang, _ in rows_], np.int64), labels


def hash_of(column: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(column.tobytes())


def fit(docs: DataFrame, rows: int = SAMPLE) -> Network | None:
    """A network from the sample; None if there is nothing to learn from. Only the sample reaches the driver."""
    raw, long, label, names = sample(docs, rows)
    return Network(names).fit(raw, long, label) if names else None


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """Every row and column of docs, with lang_pred and score: the language of the highest pooled probability, from every
    byte of the whole text, and that probability.

    A text that is null, empty or without a letter is `und` with score 0, and so is all without a network. Of equal
    probabilities the first language by name counts; repeated rows are alike; columns named like the new ones are
    replaced; an empty table gives no rows. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            some = [i for i, t in enumerate(texts) if network is not None and _LETTER.search(t)]
            names, score = np.full(len(texts), NONE, dtype=object), np.zeros(len(texts))
            if some:
                p = network.pooled([texts[i].encode() for i in some])
                names[some], score[some] = np.array(network.labels, dtype=object)[p.argmax(axis=1)], p.max(axis=1)
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))], names=["row", "lang_pred", "score"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def op11_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs.drop("lang"), fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")
