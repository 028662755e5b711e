"""Language identification by a byte convolutional network, trained here in numpy.

A window of WINDOW bytes (ASCII lower-cased, in 64 byte classes) passes through
filters of widths 2, 3 and 4; each filter is max-pooled over the window; a softmax
layer gives the languages.  Since a filter sees few classes, its response to
every pair of adjacent classes is tabulated once, and a width of 3 or 4 is the sum
of two table rows: inference is a few gathers a byte.  Every window of every whole
text is classified; a text's score is the mean over its windows.

The network learns every label from a bounded sample of labelled rows: at most SAMPLE_ROWS in all, shared
evenly by the languages and at most PER_LANGUAGE of each, chosen by a hash of identifier and text,
and WINDOWS_EACH windows of each.

Edge cases.  A null text, or one without a letter, gives ``und`` with score 0; so does
everything if there is nothing to learn from.  Null labels, and texts without a letter, are not learnt.  Repeated
rows and null identifiers are treated as any row; further columns are not read.  Very long texts are
classified in all their windows, GRID of them at once.  Carried columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_ROWS, PER_LANGUAGE, WINDOWS_EACH = 96_000, 1_500, 2
EPOCHS, BATCH, RATE = 8, 128, 0.015
#: Texts taken at once in a task.
TASK_BATCH = 500
#: Windows that pass through the network at once.
GRID = 256
#: For the gate: held-out documents that are looked at, in all and a language; how many it needs and what share must be right; a sure score.
HELD_ROWS, HELD_EACH, HELD_LEAST, HELD_RIGHT, SURE = 19_200, 300, 10, 0.9, 0.9
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def byte_classes() -> np.ndarray:
    """64 classes: 0 padding, 1 space, letters, digits and other ASCII in one class each, lead bytes in 5 classes, the trailing bytes by their low bits."""
    out = np.full(256, 2, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[48:58] = 3
    for k in range(26):
        out[65 + k] = out[97 + k] = 4 + k
    out[128:192] = 30 + np.arange(64) % 29  # trailing bytes
    lead = np.arange(192, 256)
    out[192:] = np.where(lead == 0xC3, 59, np.where(lead < 0xD0, 60, np.where(lead < 0xE0, 61, np.where(lead < 0xF0, 62, 63))))
    return out


CLASSES = byte_classes()


@dataclass
class ByteCNN:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 64, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> dict[str, np.ndarray]:
        """Responses to pairs of classes: 4096 rows a table."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(4096, -1).astype(np.float32)
        f2, f3, f4 = (self.filters[w] for w in WIDTHS)
        return {"2": pair(f2[0], f2[1]), "3": pair(f3[0], f3[1]), "4a": pair(f4[0], f4[1]), "4b": pair(f4[2], f4[3])}

    def pooled(self, x: np.ndarray, t: dict[str, np.ndarray], where: bool = False):
        """Max-pooled responses of windows ``x`` (rows of classes), and where each maximum is."""
        pair = x[:, :-1].astype(np.int32) * 64 + x[:, 1:]
        r2 = t["2"][pair]
        r3 = t["3"][pair[:, :-1]] + self.filters[3][2].astype(np.float32)[x[:, 2:]]
        r4 = t["4a"][pair[:, :-2]] + t["4b"][pair[:, 2:]]
        top = np.concatenate([r.max(axis=1) for r in (r2, r3, r4)], axis=1) + self.bias
        return (top, [r.argmax(axis=1) for r in (r2, r3, r4)]) if where else top

    def probabilities(self, x: np.ndarray, t: dict[str, np.ndarray] | None = None) -> np.ndarray:
        h = np.maximum(self.pooled(x, t or self.tables()), 0)
        z = h @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(data: bytes) -> np.ndarray:
    """All windows of a text; the last is padded."""
    raw = CLASSES[np.frombuffer(data, np.uint8)]
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> ByteCNN | None:
    """Adam on the cross entropy; the gradient of a maximum flows to its position only."""
    languages = sorted(set(labels))
    if not languages:
        return None
    number = {v: k for k, v in enumerate(languages)}
    rng = np.random.default_rng(seed)
    x = np.concatenate([windows(t[:WINDOW]) for t in texts])
    y = np.array([number[v] for v in labels])
    n_f = FILTERS * len(WIDTHS)
    net = ByteCNN(languages, {w: rng.normal(0, 0.3, (w, 64, FILTERS)) for w in WIDTHS}, np.zeros(n_f), rng.normal(0, 0.2, (n_f, len(languages))), np.zeros(len(languages)))
    params = [*(net.filters[w] for w in WIDTHS), net.bias, net.dense, net.dense_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for k in range(0, len(x), BATCH):
            pick = order[k : k + BATCH]
            xb, yb = x[pick], y[pick]
            top, at = net.pooled(xb, net.tables(), where=True)
            h = np.maximum(top, 0)
            z = h @ net.dense + net.dense_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            g_h = (p @ net.dense.T) * (top > 0)
            grads = []
            rows = np.arange(len(yb))[:, None]
            for j, w in enumerate(WIDTHS):
                g = np.zeros_like(net.filters[w])
                own = g_h[:, j * FILTERS : (j + 1) * FILTERS]
                for d in range(w):
                    np.add.at(g[d], (xb[rows, at[j] + d], np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [g_h.sum(axis=0), h.T @ p, p.sum(axis=0)]
            step += 1
            for i, (q, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                q -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def fold(id_col: str) -> Column:
    """crc32 of the identifier as text, modulo 4."""
    return F.crc32(common.named(id_col).cast("string")) % 4


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label): the bounded training sample.  A hash of the row thins each language before anything is ordered."""
    learnt = (fold(id_col) != 2) & common.named(label_col).isNotNull() & common.named(text_col).rlike(r"\p{L}")
    labelled = docs.where(learnt).select(common.named(id_col).alias("id"), common.named(text_col).alias("text"), common.named(label_col).alias("label"))
    thin = _thinned(labelled, "sample", SAMPLE_ROWS, PER_LANGUAGE)
    size = F.char_length("text")
    begins = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)), lambda k: F.floor((size - 1) * k / WINDOWS_EACH).cast("int"))
    pieces = F.array_distinct(F.transform(begins, lambda b: F.substring(F.col("text"), b + 1, F.lit(WINDOW))))
    first = thin.select("label", "u", "id", F.xxhash64("text").alias("t"), "most", pieces.alias("pieces"))
    kept = first.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("u", "id", "t"))).where("k <= most")
    return kept.select("label", "k", F.explode("pieces").alias("text"))


def _thinned(rows: DataFrame, salt: str, total: int, each: int) -> DataFrame:
    """``rows`` (id, text, label) with u, a hash in 0 to 1, and ``most``, how many rows of a label may be taken, so that no more than ``total`` are in all; rows whose u is far too high are left out."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    kinds = max(1, sizes.count())
    most = max(1, min(each, total // kinds))
    if kinds > total:  # more labels than sample rows: the most frequent
        sizes = sizes.orderBy(F.desc("n"), "label").limit(total)
    u = F.abs(F.xxhash64("id", "text", F.lit(salt)) % 1_000_000) / 1_000_000
    return rows.withColumns({"u": u, "most": F.lit(most)}).join(F.broadcast(sizes), "label").where(F.col("u") * F.col("n") <= 1.2 * most + 20)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteCNN | None:
    rows = sorted((r["label"], r["k"], r["text"]) for r in sample(docs, id_col, text_col, label_col).collect())  # bounded: see the module
    return train([r[2].encode("utf-8", "replace") for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: ByteCNN | None = None) -> DataFrame:
    """Per row: id, held_out, lang_pred, score."""
    common.need(docs, [id_col, text_col, label_col])
    model = model or fit(docs, id_col, text_col, label_col)
    held = docs.select(common.named(id_col).alias("id"), F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out"), common.named(text_col).alias("text"))
    return predict(held, ["id", "held_out"], model).withColumnRenamed("id", id_col)


def predict(rows: DataFrame, carried: list[str], model: ByteCNN | None, text_col: str = "text") -> DataFrame:
    """``carried`` columns, lang_pred and score of every row."""

    carried = [c for c in carried if c not in ("lang_pred", "score")]
    columns = list(dict.fromkeys([*carried, text_col]))  # a carried text travels once
    at = columns.index(text_col)
    own = [f"c{k}" for k in range(len(columns))][: len(carried)]  # names that Arrow and Spark agree on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else {}
        for whole in batches:
            for first in range(0, whole.num_rows, TASK_BATCH):
                b = whole.slice(first, TASK_BATCH)
                texts = b.column(at).to_pylist()
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [k for k, t in enumerate(texts) if model and t and _LETTER.search(t)]
                blocks = [windows(texts[k].encode("utf-8", "replace")) for k in known]
                for start, stop in _slices([len(x) for x in blocks], GRID):
                    grid = np.concatenate(blocks[start:stop])
                    p = np.concatenate([model.probabilities(grid[i : i + GRID], tables) for i in range(0, len(grid), GRID)])
                    sizes = np.array([len(x) for x in blocks[start:stop]])
                    mean = np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                    for k, row in zip(known[start:stop], mean, strict=True):
                        pred[k], score[k] = model.languages[int(row.argmax())], float(row.max())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carried))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*own, "lang_pred", "score"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{o} {types[c]}" for o, c in zip(own, carried, strict=True)), "lang_pred string", "score double"])
    narrow = rows.select(*[common.named(c).alias(f"c{k}") for k, c in enumerate(columns)])
    return narrow.mapInArrow(common.trimmed(run), schema).toDF(*carried, "lang_pred", "score")


@dataclass
class Gate:
    """Which documents a language filter takes out.  ``trusted``: languages that the network tells on held-out documents; ``floor``: halfway between chance and the least score of any of them."""

    trusted: list[str]
    floor: float

    def keeps(self, label_col: str) -> Column:
        """Over rows with lang_pred and score: False for no language, a sure contradiction of a trusted label, and a score below the floor where the label is trusted or missing."""
        label = common.named(label_col)
        trusted = F.coalesce(label.isin(self.trusted), F.lit(False))
        contradicted = trusted & (F.col("lang_pred") != label) & (F.col("score") >= SURE)
        low = (trusted | label.isNull()) & (F.col("score") < self.floor)
        return (F.col("lang_pred") != UNKNOWN) & ~contradicted & ~low


def gate(docs: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Gate:
    """The gate from at most HELD_ROWS held-out documents, HELD_EACH of each language of ``model``, chosen by a hash of identifier and text."""
    held = docs.where((fold(id_col) == 2) & common.named(label_col).isin(model.languages)).select(common.named(id_col).alias("id"), common.named(text_col).alias("text"), common.named(label_col).alias("label"))
    thin = _thinned(held, "held", HELD_ROWS, HELD_EACH)
    order = Window.partitionBy("label").orderBy("u", "id", F.xxhash64("text"))
    some = thin.withColumn("k", F.row_number().over(order)).where("k <= most")
    seen = predict(some, ["label"], model).where(F.col("lang_pred") != UNKNOWN).collect()  # bounded: HELD_ROWS
    trusted, told = [], defaultdict(list)
    for r in seen:
        told[r["label"]].append(r["lang_pred"] == r["label"])
    for label, right in sorted(told.items()):
        if len(right) >= HELD_LEAST and sum(right) >= HELD_RIGHT * len(right):
            trusted.append(label)
    scores = [r["score"] for r in seen if r["label"] in trusted]
    chance = 1 / len(model.languages)
    return Gate(trusted, chance + (min(scores) - chance) / 2 if scores else 0.0)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` windows together."""
    start, held = 0, 0
    for k, s in enumerate(sizes):
        held += s
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
