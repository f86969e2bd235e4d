"""Operator 9, language identification by a bidirectional GRU over bytes.

Two gated recurrent networks read the bytes of a text, one in each direction;
a softmax over both states labels *every position*, and a text's
probabilities are the mean of its positions' log-probabilities, normalised.
White space and ASCII marks count as positions like all else.

Training runs in numpy with backpropagation through time and Adam, on a
bounded sample of labelled rows: ``sample`` texts for each language, one
snippet of ``SPAN`` bytes from each at a random place.  Rows of the held-out
fold (crc32 of the doc_id modulo ``folds`` = 2) never teach.  The model is
about ten kB and travels with the task.

Scoring reads every byte of every text.  Texts are cut into spans of
``READ`` bytes, all spans of a batch advance together, and each span runs
``WARM`` bytes into its neighbours to warm its states up, so no position is
labelled from a cold state inside a text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
Rows with a null lang teach nothing.  Without any labelled row every text is
``und``; with one language only, that one.  Ties go to the first language in
alphabetical order.  Rows are scored alone, so repeated rows and null ids
need nothing special; held_out is null for a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearlink.llm import common as C

HIDDEN = 8
SPAN = 96  # bytes of a training snippet
READ = 192  # bytes of a span that is scored at once
WARM = 8
SAMPLE = 400  # texts of a language that teach
STEPS = 240
SEED = 5
NONE = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Direction:
    """One GRU: z, r = sigmoid(W[byte] + U h), n = tanh(V[byte] + r * (Un h))."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        scale = 1 / np.sqrt(hidden)
        self.w = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.uniform(-scale, scale, (hidden, 3 * hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """States after each step of the byte columns x (steps, batch)."""
        steps, n = x.shape
        hid = self.u.shape[0]
        h = np.zeros((n, hid), np.float32)
        states = np.empty((steps, n, hid), np.float32)
        tape = []
        for t in range(steps):
            a = self.w[x[t]]
            b = h @ self.u
            g = a[:, : 2 * hid]
            g += b[:, : 2 * hid]
            _sigmoid(g)
            z, r = g[:, :hid], g[:, hid:]
            c = a[:, 2 * hid :]
            c += r * b[:, 2 * hid :]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, z, r, c, b[:, 2 * hid :]))
            h = c + z * (h - c)
            states[t] = h
        return states, tape

    def states(self, x: np.ndarray) -> np.ndarray:
        """The same states without a tape, laid out (steps, hidden, batch) so
        that every operation runs over the batch."""
        steps, n = x.shape
        hid = self.u.shape[0]
        w, u = np.ascontiguousarray(self.w.T), np.ascontiguousarray(self.u.T)
        out = np.empty((steps, hid, n), np.float32)
        h = np.zeros((hid, n), np.float32)
        a, b = np.empty((3 * hid, n), np.float32), np.empty((3 * hid, n), np.float32)
        g, c = a[: 2 * hid], a[2 * hid :]
        for t in range(steps):
            np.take(w, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=b)
            g += b[: 2 * hid]
            _sigmoid(g)
            b[2 * hid :] *= g[hid:]
            c += b[2 * hid :]
            np.tanh(c, out=c)
            h = out[t - 1] if t else h
            np.subtract(h, c, out=out[t])
            out[t] *= g[:hid]
            out[t] += c
            h = out[t]
        return out

    def back(self, x: np.ndarray, tape: list, d_states: np.ndarray):
        hid = self.u.shape[0]
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        dh = np.zeros_like(d_states[0])
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, c, b = tape[t]
            dh = dh + d_states[t]
            dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            dr = dc * b * r * (1 - r)
            da = np.concatenate((dz, dr, dc), axis=1)
            db = np.concatenate((dz, dr, dc * r), axis=1)
            np.add.at(dw, x[t], da)
            du += h.T @ db
            dh = dh * z + db @ self.u.T
        return dw, du


class Model:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Direction(hidden, rng), Direction(hidden, rng)
        self.out = rng.normal(0, 0.2, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def log_probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=-1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=-1, keepdims=True))

    def _step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray):
        """Loss gradient of byte columns x with labels y; ``real`` marks bytes
        that are no padding."""
        fs, ft = self.ahead.run(x, keep=True)
        bs, bt = self.behind.run(x[::-1], keep=True)
        states = np.concatenate((fs, bs[::-1]), axis=2)
        d = np.exp(self.log_probabilities(states))
        d[:, np.arange(len(y)), y] -= 1
        d *= real[:, :, None] / max(real.sum(), 1)
        flat = states.reshape(-1, states.shape[2])
        dd = d.reshape(-1, d.shape[2])
        ds = d @ self.out.T
        hid = fs.shape[2]
        fw, fu = self.ahead.back(x, ft, ds[:, :, :hid])
        bw, bu = self.behind.back(x[::-1], bt, ds[::-1, :, hid:])
        return [fw, fu, bw, bu, flat.T @ dd, dd.sum(axis=0)]

    def fit(self, snippets: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int, batch: int = 128) -> Model:
        rng = np.random.default_rng(SEED + 1)
        params = [self.ahead.w, self.ahead.u, self.behind.w, self.behind.u, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(labels), batch)
            x = np.ascontiguousarray(snippets[pick].T)
            real = (np.arange(len(x))[:, None] < lengths[pick][None, :]).astype(np.float32)
            rate = 0.03 * min(1.0, 2 * (1 - (t - 1) / steps))
            for p, g, m, v in zip(params, self._step(x, labels[pick], real), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        return self

    def pooled(self, data: np.ndarray, offsets: np.ndarray, many: int = 2048) -> np.ndarray:
        """Per text of a batch the sum of log-probabilities of its positions."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        spans = -(-lengths // READ)
        doc = np.repeat(np.arange(n), spans)
        start = offsets[:-1][doc] + READ * (np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans))
        end = np.minimum(start + READ, offsets[1:][doc])
        out = np.zeros((n, len(self.languages)))
        order = np.argsort(start - end, kind="stable")  # spans of like length run together
        steps = np.arange(-WARM, READ + WARM)
        hid = self.out.shape[0] // 2
        for lo in range(0, len(doc), many):
            pick = order[lo : lo + many]
            d, s, e = doc[pick], start[pick], end[pick]
            longest = int((e - s).max())
            at = s[None, :] + steps[: WARM + longest + WARM, None]
            real = (at >= offsets[:-1][d]) & (at < offsets[1:][d])
            x = np.where(real, data[np.clip(at, 0, len(data) - 1)], 0)
            inside = slice(WARM, WARM + longest)
            logits = self.out[:hid].T @ self.ahead.states(x)[inside]
            logits += self.out[hid:].T @ self.behind.states(x[::-1])[::-1][inside]
            logits += self.bias[:, None]
            logits -= logits.max(axis=1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
            logits *= (at[inside] < e)[:, None, :]
            np.add.at(out, d, logits.sum(axis=0, dtype=np.float64).T)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its probability for each text."""
        logs = self.pooled(data, offsets) / np.maximum(np.diff(offsets), 1)[:, None]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def smallest(rows: DataFrame, many: int) -> DataFrame:
    """Of ``rows`` (lang, o, t) the ``many`` with the smallest (o, t) of each
    language, as lang, o, t and how often the row counts.

    One aggregate counts the rows of a language by the leading zeros of ``o``,
    at most 64 numbers each; they give a cut-off that about ``many`` to twice
    as many rows pass, whatever the number of rows and tasks.  Only those are
    put in order, equal rows as one."""
    level = (64 - F.length(F.bin(F.col("o").bitwiseXOR(F.lit(-(1 << 63)))))).alias("level")
    sizes = rows.select("lang", level).groupBy("lang", "level").count()
    above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("level")))
    enough = F.coalesce(F.max(F.when(F.col("above") >= many, F.col("level"))), F.lit(0))
    cut = sizes.withColumn("above", above).groupBy("lang").agg(enough.alias("cut"))
    near = rows.join(F.broadcast(cut), "lang").where(level >= F.col("cut"))  # a row for each language the model has
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("o", "t")) - F.col("n")
    rest = near.groupBy("lang", "o", "t").agg(F.count("*").alias("n")).withColumn("before", before).where(F.col("before") < many)
    return rest.select("lang", "o", "t", F.least("n", many - F.col("before")).cast("int").alias("n"))


def teach(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """Fit on ``docs`` (doc_id, text, lang): for each language the ``sample``
    rows with the smallest hash, of each the bytes after a random place."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - SPAN, F.lit(0)) + 1)
    cut = F.substring(F.col("text"), place.cast("int") + 1, F.lit(SPAN))
    order = F.xxhash64("doc_id", "text", F.lit(1))
    rows = docs.where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    top = smallest(rows.select("lang", order.alias("o"), cut.alias("t")), sample).collect()
    found = sorted((r["lang"], r["o"], r["t"]) for r in top for _ in range(r["n"]))  # ``sample`` snippets for each language
    languages = sorted({lang for lang, _, _ in found})
    if not languages:
        return None
    texts = [t.encode()[:SPAN] for _, _, t in found]
    labels = [languages.index(lang) for lang, _, _ in found]
    x = np.zeros((len(texts), SPAN), np.uint8)
    for i, t in enumerate(texts):
        x[i, : len(t)] = np.frombuffer(t, np.uint8)
    model = Model(languages)
    if len(languages) > 1:
        model.fit(x, np.array([len(t) for t in texts]), np.array(labels), steps)
    return model


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2
) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    C.prepare(docs.sparkSession)
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
        (C.crc_mod(id_col, folds) == held).alias("held_out"),
    )
    model = teach(plain.where("not held_out").select("doc_id", "text", "lang"))

    def run(batches):
        for b in C.slices(batches, "text", size=2 << 20):
            known = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, score = np.full(b.num_rows, NONE, object), np.zeros(b.num_rows)
            if model is not None and known.any():
                best, p = model.predict(*C.raw_bytes(b.column(3).filter(pa.array(known))))
                names[known] = [model.languages[k] for k in best]
                score[known] = p
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(names.tolist(), pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")
    return plain.select("doc_id", "held_out", letters, "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
