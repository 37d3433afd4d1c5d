"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, gated attention
weighs the encodings, and their weighted sum is scored; only documents carry
labels, so what makes a passage count is learned from them. The model is
fitted with numpy on the driver from a bounded sample of labelled documents
and scores every passage of every document on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, lean

PASSAGE_WORDS = 64
#: Labelled rows to fit on at most, whole, and characters of them together.
FIT_DOCS, FIT_CHARS = 4_000, 64_000_000
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 60, 128, 0.01, 1e-4, 5
#: Bytes of text measured at a time.
BLOCK = 1 << 18

# classes of bytes: 0 space, 1 lower case, 2 capital, 3 digit, 4 symbol, 5 shout, 6 bar, 7 other, 8 beyond ASCII
_CLASS = np.full(256, 7, np.uint8)
for _c, _bytes in enumerate((b" \t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b"#*$%&<>@^~_=+\\/{}[]", b"!", b"|")):
    _CLASS[list(_bytes)] = _c
_CLASS[128:] = 8
_CLASSES = 9
#: Bins by hash that words are counted in; each has its learned embedding, a row of the encoder.
WORD_BINS = 64
_SHAPE = _CLASSES + 6
FEATURES = _SHAPE + WORD_BINS
#: Decay of the embeddings of words, so that they count only where the shape of passages leaves something unexplained.
WORD_DECAY = 1e-2
_MIX = np.random.default_rng(1).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _segments(text: bytes) -> Iterator[bytes]:
    """``text`` in blocks that end at white space, where there is any in reach."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def _passages(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage of ``parts``, and the part it is in."""
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    kind = _CLASS[buf]
    inside = kind != 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    part = np.searchsorted(ends, starts, "right")
    first = np.searchsorted(part, np.arange(len(parts)))  # the first word of each part
    order = np.arange(len(starts)) - first[part]
    new = order % PASSAGE_WORDS == 0
    passage = np.cumsum(new) - 1
    n = int(passage[-1]) + 1
    heads = starts[new]
    length = np.diff(np.append(heads, len(buf)))
    where = np.repeat(np.arange(n), length)
    counts = np.bincount(where * _CLASSES + kind[heads[0] :], minlength=n * _CLASSES).reshape(n, _CLASSES)
    span = np.diff(np.append(starts, len(buf)))
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, span)
    mixed = (buf[starts[0] :].astype(np.uint64) + np.uint64(1)) * _MIX[place & 63] * inside[starts[0] :]
    word = np.add.reduceat(mixed, starts - starts[0])
    words = np.bincount(passage, minlength=n)
    letters = np.add.reduceat(inside, starts)
    again = np.concatenate(([False], (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])))
    by = np.argsort(word, kind="stable")
    by = by[np.argsort(passage[by], kind="stable")]
    distinct = np.ones(len(word), bool)
    distinct[1:] = (word[by][1:] != word[by][:-1]) | (passage[by][1:] != passage[by][:-1])
    total = np.maximum(1, counts.sum(1))
    out = np.empty((n, FEATURES), np.float32)
    out[:, :_CLASSES] = counts / total[:, None]
    out[:, _CLASSES] = np.bincount(passage, letters, n) / words / 10
    out[:, _CLASSES + 1] = np.bincount(passage[by], distinct, n) / words
    out[:, _CLASSES + 2] = np.bincount(passage, again, n) / words
    out[:, _CLASSES + 3] = words / PASSAGE_WORDS
    out[:, _CLASSES + 4] = np.bincount(passage, letters == 1, n) / words
    out[:, _CLASSES + 5] = np.bincount(passage, letters > 20, n) / words
    bins = (word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    out[:, _SHAPE:] = np.bincount(passage * WORD_BINS + bins.astype(np.int64), minlength=n * WORD_BINS).reshape(n, WORD_BINS) / words[:, None]
    return out, part[new]


def bags(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its number and the features of all its passages; one row of zeros if it has no word."""
    held: list[tuple[int, bytes]] = []
    parts: dict[int, list[np.ndarray]] = {}
    size = 0

    def done() -> Iterator[tuple[int, np.ndarray]]:
        x, at = _passages([b for _, b in held])
        bounds = np.searchsorted(at, np.arange(len(held) + 1))
        for k, (i, _) in enumerate(held):
            parts.setdefault(i, []).append(x[bounds[k] : bounds[k + 1]])
        last = held[-1][0]
        for i in [i for i in parts if i != last]:
            yield i, _whole(parts.pop(i))

    for i, text in enumerate(texts):
        for b in _segments((text or "").encode("utf-8", "surrogatepass")) if text else [b""]:
            held.append((i, b))
            size += len(b)
            if size >= BLOCK:
                yield from done()
                held, size = [], 0
    if held:
        yield from done()
    for i in list(parts):
        yield i, _whole(parts.pop(i))


def _whole(rows: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(rows)
    return x if len(x) else np.zeros((1, FEATURES), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    """Encoder, gate and score; ``params`` None is the constant ``prior``."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray] | None
    prior: float

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: passages of bags one after another, each bag from its place in ``starts``."""
        p = self.params
        assert p is not None
        x = (x - self.mean) / self.scale
        sizes = np.diff(np.append(starts, len(x)))
        e = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(e @ p["v"]), _sigmoid(e @ p["u"])
        logit = (t * s) @ p["a"]
        logit = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), sizes))
        weight = logit / np.repeat(np.add.reduceat(logit, starts), sizes)
        z = np.add.reduceat(weight[:, None] * e, starts, axis=0)
        return {"x": x, "e": e, "t": t, "s": s, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["d"]), "sizes": sizes}

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.full(len(starts), self.prior) if self.params is None else self.forward(x, starts)["score"]


def _decay(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {k: np.full_like(x, DECAY) for k, x in p.items()}
    out["w"][_SHAPE:] = WORD_DECAY
    return out


def gradients(model: Model, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Logistic loss of bags, each times its ``share``, plus decay; and its gradient in each parameter."""
    p = model.params
    assert p is not None
    f = model.forward(x, starts)
    decay = _decay(p)
    at = np.clip(f["score"], 1e-12, 1 - 1e-12)
    loss = -(share * np.where(labels == 1, np.log(at), np.log(1 - at))).sum() + sum((decay[k] * v * v).sum() / 2 for k, v in p.items())
    g = {k: decay[k] * v for k, v in p.items()}
    out = (f["score"] - labels) * share
    g["c"] += f["z"].T @ out
    g["d"] += out.sum()
    dz = np.repeat(out[:, None] * p["c"], f["sizes"], axis=0)
    de = f["weight"][:, None] * dz
    dot = (dz * f["e"]).sum(1)
    mean_dot = np.repeat(np.add.reduceat(f["weight"] * dot, starts), f["sizes"])
    dl = f["weight"] * (dot - mean_dot)
    gate = dl[:, None] * p["a"]
    g["a"] += (f["t"] * f["s"]).T @ dl
    dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
    g["v"] += f["e"].T @ dt
    g["u"] += f["e"].T @ ds
    de = (de + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["e"] ** 2)
    g["w"] += f["x"].T @ de
    g["b"] += de.sum(0)
    return float(loss), g


def fit(data: list[np.ndarray], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Adam on the logistic loss of bags; classes weigh the same. One class or none: the constant share of 1 (0.5 for none)."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, prior)
    every = np.concatenate(data).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    shape = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    params = {k: rng.normal(0, 0.3, s) * (k not in "bd") for k, s in shape.items()}
    model = Model(mean, scale, params, prior)
    balance = np.where(labels == 1, 0.5 / prior, 0.5 / (1 - prior))
    m, v, step = {k: 0 * p for k, p in params.items()}, {k: 0 * p for k, p in params.items()}, 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        mixed = rng.permutation(len(data))
        for at in range(0, len(mixed), BATCH):
            pick = mixed[at : at + BATCH]
            starts = np.cumsum([0, *(len(data[i]) for i in pick[:-1])])
            _, g = gradients(model, np.concatenate([data[i] for i in pick]).astype(np.float64), starts, labels[pick], balance[pick] / len(pick))
            step += 1
            for k, p in params.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 1 by 3. Null ids are not held out, and have no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, seed: int = SEED) -> Model:
    """Fit on up to ``fit_docs`` labelled rows outside the held-out fold, with ``fit_chars`` characters together, those first in a seeded hash order of ids.

    Null labels and ids are left out; an id labelled more than once takes the
    majority (ties: 1); of rows that repeat an id each different text is one
    row. A row is fitted on whole or not at all, so the driver holds features
    of at most so many characters.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__label"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("text"))
    rows = named.select("__id", "__th", F.length("text").cast("long").alias("chars")).distinct().join(known, "__id")
    order = [F.xxhash64(F.lit(seed), "__id"), F.col("__id"), F.col("__th")]
    picked = rows.orderBy(*order).limit(fit_docs)
    upto = F.sum("chars").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over fit_docs rows at most
    picked = picked.withColumn("upto", upto).where(F.col("upto") <= fit_chars).select("__id", "__th", "__label")
    found = named.join(F.broadcast(picked), ["__id", "__th"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, found = (batch.column(c).to_pylist() for c in (0, 1, 3))
            out = [(ids[i], hashes[i], found[i], x.tobytes()) for i, x in bags(batch.column(2).to_pylist())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), (), ()), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["id", "th", "label", "x"])

    measured = found.select(F.col("__id").cast("long"), "__th", "text", "__label").mapInArrow(lean(measure), "id long, th long, label int, x binary")
    once = measured.groupBy("id", "th", "label").agg(F.first("x").alias("x"))  # rows equal in id and text
    held = once.toArrow().sort_by([("id", "ascending"), ("th", "ascending")])
    data = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in held.column("x").to_pylist()]
    return fit(data, np.array(held.column("label").to_pylist(), dtype=np.int64), seed)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row; null and empty texts are bags of one empty passage."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scores_of(model, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(of), "doc_id long, score double")


def scores_of(model: Model, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    for at in range(0, len(texts), 256):
        some = texts.slice(at, 256).to_pylist()
        found = list(bags(some))
        starts = np.cumsum([0, *(len(x) for _, x in found[:-1])])
        if found:
            out[[at + i for i, _ in found]] = model.scores(np.concatenate([x for _, x in found]).astype(np.float64), starts)
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``, by a model fitted on ``labels`` (see ``learn``).

    Only texts are scored. Repeated rows each come back with the same score;
    other columns are not read; empty documents give none; without labels of
    both classes the score is constant.
    """
    scored = score(docs, learn(docs, labels, id_col, text_col, **how), id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **how) -> DataFrame:
    """Rows of ``docs``, all their columns, whose text scores ``least`` or more.

    Rows stay in the JVM: workers get texts and return scores.
    """
    model = learn(docs, labels, id_col, text_col, **how)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores_of(model, texts), pa.float64())
            del texts
            give_back()

    return docs.where(F.arrow_udf(of, "double")(F.col(text_col).cast("string")) >= least)
