"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte n-grams of 2 to 4 bytes (ASCII letters lowered, other ASCII bytes read as a
blank), hashed into buckets. Each bucket has a small vector; a text is the average over all its subwords,
whole text, and a linear softmax gives the languages. Vectors and softmax are fitted together by stochastic
gradient descent in numpy on a bounded sample: at most `per_language` training documents of each language (the first by hash of
doc_id), of at most `max_languages` languages, the most frequent first. A fifth of the sample is held back
to calibrate: a temperature by likelihood, and a rejection threshold that lets through all but
`false_rejects` of the rows that are predicted rightly there. Everything else covers all rows.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; so is every text
where there is nothing to learn from (no labelled row). A row with a null doc_id or lang is not learned from, of rows with one doc_id and
language the one with the least text is, and a null doc_id counts as not held out. Repeated rows give equal rows, one for each input row; ties between languages go to the
first by code point; texts of any length are read whole, in pieces; an empty table gives an empty table;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import resident, small_batches, sweep, trim

LETTER = regex.compile(r"\p{L}")
BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
PIECE = 1 << 20

_fold = np.full(256, 32, np.uint8)
_fold[128:] = np.arange(128, 256)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)


def buckets(data: bytes) -> np.ndarray:
    """Bucket of every subword of a text that is framed by blanks."""
    b = _fold[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    out, h = [], b
    for k in range(1, max(ORDERS)):
        if len(b) <= k:
            break
        h = h[:-1] * np.uint32(0x01000193) + b[k:]
        if k + 1 in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            out.append((x >> np.uint32(18)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    data, total = text.encode("utf-8", "replace"), np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data) or 1, PIECE):
        total += np.bincount(buckets(data[at : at + PIECE]), minlength=BUCKETS)
    return total


#: A small sample is gone over more often: after a few steps the languages with fewest rows are not learned, and their rows are rejected.
LEAST_STEPS = 500


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, text: str) -> np.ndarray:
        """Calibrated probability of each language."""
        data, total, n = text.encode("utf-8", "replace"), np.zeros(len(self.langs)), 0
        for at in range(0, len(data) or 1, PIECE):
            ids = buckets(data[at : at + PIECE])
            if len(ids) < BUCKETS:
                total += self.table[ids].sum(axis=0, dtype=np.float64)
            else:
                total += np.bincount(ids, minlength=BUCKETS) @ self.table
            n += len(ids)
        z = (total / max(n, 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        p = self.scores(text)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], dim: int = 16, epochs: int = 12, rate: float = 4.0, seed: int = 7, false_rejects: float = 0.001) -> Model:
    """Fits on rows of (bucket ids, the share of each in the text, language)."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    y = np.array([number[r[2]] for r in rows])
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 20 else order
    used = order[len(rows) // 5 :] if len(rows) >= 20 else order
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    batch, batches = 16, -(-len(used) // 16)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    steps = epochs * batches
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), batch):
            pick = used[at : at + batch]
            lr, step = rate * (1 - step / steps), step + 1
            x = np.stack([rows[i][1] @ emb[rows[i][0]] for i in pick]).astype(np.float32)
            z = x @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = p @ w.T
            w -= lr * (x.T @ p)
            bias -= 0.1 * lr * p.sum(axis=0)
            for i, g in zip(pick, back, strict=True):
                # Averaging shrinks each bucket's share of the gradient; the factor restores its scale.
                emb[rows[i][0]] -= (np.float32(lr * 50) * rows[i][1])[:, None] * g
    table = (emb @ w).astype(np.float32)
    z = np.stack([rows[i][1] @ table[rows[i][0]] + bias for i in held]).astype(np.float64)

    def soft(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    def surprise(t: float, unsure: float = 0.005) -> float:
        """Mean surprise at labels of which a small share may be wrong, so that rows without an error don't give certainty."""
        logs = np.log(soft(t) + 1e-12)
        return float(-((1 - unsure) * logs[np.arange(len(held)), y[held]] + unsure * logs.mean(axis=1)).mean())

    loss = {t: surprise(t) for t in np.geomspace(0.05, 20, 60)}
    t = float(min(loss, key=loss.get))
    p = soft(t)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    threshold = float(np.quantile(right, false_rejects)) if len(right) else 0.0
    return Model(langs, table, bias.astype(np.float64), t, threshold)


def train(docs: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, max_languages: int = 400, **how) -> Model:
    """A model from the rows of docs for which the column train_on holds; see the module for the sample's bound, which holds before anything reaches the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(train_on & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    top = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")).orderBy(F.desc("n"), "lang").limit(max_languages)
    # A few more than wanted by their hash, however large the language; then the first of them.
    h = F.xxhash64("id")
    some = rows.select("lang", "id", h.alias("h")).join(F.broadcast(top), "lang").where(F.col("h") / 2.0**64 + 0.5 < (1.5 * per_language + 50) / F.col("ids")).select("lang", "id", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h", "id")
    ids = some.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).select("lang", "id")

    def features(batches):
        import pyarrow as pa

        resident()
        for batch in batches:
            ids, shares, langs, names = [], [], [], []
            for text, lang, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if LETTER.search(text):
                    c = counts(text)
                    k = np.flatnonzero(c)
                    ids.append(k.astype(np.int16)), shares.append((c[k] / c.sum()).astype(np.float32)), langs.append(lang), names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(ids, pa.list_(pa.int16())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "id", "ids", "shares"])
        trim()

    chosen = rows.join(F.broadcast(ids), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))
    got = chosen.select("text", "lang", "id").mapInArrow(features, "lang string, id string, ids array<short>, shares array<float>").toArrow()
    got = got.sort_by([("lang", "ascending"), ("id", "ascending")]).combine_chunks()  # the order rows arrive in doesn't count
    made = []
    if len(got):
        i, n = (got[c].chunk(0) for c in ("ids", "shares"))
        at, ids_, shares = i.offsets.to_numpy(), i.values.to_numpy().astype(np.int32), n.values.to_numpy()
        made = [(ids_[a:b], shares[a:b], lang) for a, b, lang in zip(at[:-1], at[1:], got["lang"].to_pylist(), strict=True)]
    model = fit(made, **how)
    del got, made
    sweep(spark)
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected), one for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        resident()
        m = shared.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(2).to_pylist()]
            a, b, c = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Trains on the rows that are not held out and predicts all."""
    return predict(docs, train(docs, ~held_out(id_col), id_col, text_col, lang_col, **how), id_col, text_col)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of docs, all columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out(id_col), id_col, text_col, lang_col, **how))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        resident()
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not m.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
