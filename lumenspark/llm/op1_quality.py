"""Quality classifier: Naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams. Each is scaled by its class log-count ratio, and a linear hinge-loss model is
fitted on the scaled indicators by dual coordinate descent; a logistic curve fitted on cross-validated margins turns
margins into scores. The n-grams run over three streams of a text: its bytes (2 to 4), the collapsed character classes
(2 to 6, so that case and punctuation habits show), and whether a word repeats the word before it (1 to 5).

Cases: a null text counts as empty; an empty text has no indicators and gets the score of the bias alone; repeated
documents get equal scores; an empty table gives no rows; without labels of both classes every score is 1.0 (nothing can
be rejected). Columns besides doc_id and text are neither read nor needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.llm.batches import map_texts
from lumenspark.plans.scratch import free_name, materialize

BITS = 18
SPACE = 1 << BITS
THRESHOLD = 0.3
MOST_POSITIONS = 40_000_000
BLOCK = 1 << 16
_CLASS = np.full(256, ord("a"), np.uint8)
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = ord("A") if _ch.isupper() else ord("a") if _ch.islower() else ord("0") if _ch.isdigit() else ord(" ") if _ch.isspace() else _c
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(grams: np.ndarray, salt: int) -> np.ndarray:
    return (((grams + np.uint64(salt << 56)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _mark(stream: np.ndarray, orders: range, salt: int, marks: np.ndarray) -> None:
    g = stream.astype(np.uint64)
    first = g
    for n in range(1, orders.stop):
        if n > 1:
            if len(first) < n:
                return
            g = (g[:-1] << np.uint64(8)) | first[n - 1 :]
        if n >= orders.start:
            marks[_hash(g, salt + n)] = True


def features(text: str, block: int = BLOCK) -> np.ndarray:
    """Distinct indicator positions of one text, ascending.

    They are marked in a map of all positions, `block` bytes at a time; each stream hands the elements that a gram may
    still begin with to the next block, where grams inside them are marked again. So a text of any length takes, besides
    itself, as much memory as one block and two maps.
    """
    data = text.encode("utf-8", "replace")
    marks, repeats = np.zeros(SPACE, bool), np.zeros(SPACE, bool)
    b, classes, same = np.frombuffer(data, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    rest, before, any_same = b"", None, False
    for begin in range(0, len(b), block):
        piece = b[max(0, begin - 3) : begin + block]
        _mark(piece, range(2, 5), 0, marks)
        kinds = _CLASS[b[max(0, begin - 1) : begin + block]]
        new = kinds[1:][kinds[1:] != kinds[:-1]] if begin else kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
        classes = np.concatenate([classes[-5:], new])
        _mark(classes, range(2, 7), 16, marks)
        chunk = rest + data[begin : begin + block]
        words = chunk.split()
        rest = b""
        if begin + block < len(b) and words and not chunk[-1:].isspace():
            rest = words.pop()
        if words:
            pairs = words if before is None else [before, *words]
            new = np.fromiter((x == y for x, y in zip(pairs, pairs[1:], strict=False)), np.uint8, len(pairs) - 1)
            any_same |= bool(new.any())
            same, before = np.concatenate([same[-4:], new]), words[-1]
            _mark(same, range(1, 6), 32, repeats)
    return np.flatnonzero(marks | repeats if any_same else marks)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weight[found].sum()) / max(1.0, np.sqrt(len(found))) + self.bias

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def _train(rows: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Log-count ratios, then L2-regularised hinge loss by dual coordinate descent; rows are scaled to unit counts."""
    pos, neg = np.ones(SPACE), np.ones(SPACE)
    for f, k in zip(rows, y, strict=True):
        (pos if k > 0 else neg)[f] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    w, bias, alpha, rng = np.zeros(SPACE), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    scaled = [ratio[f] / max(1.0, np.sqrt(len(f))) for f in rows]
    q = np.array([float(x @ x) + 1.0 for x in scaled])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ scaled[i]) + bias) - 1.0
            pg = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == cost else g
            worst = max(worst, abs(pg))
            if abs(pg) > 1e-12:
                new = min(max(alpha[i] - g / q[i], 0.0), cost)
                step, alpha[i] = (new - alpha[i]) * y[i], new
                w[rows[i]] += step * scaled[i]
                bias += step
        if worst < 1e-3:
            break
    return w * ratio, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve with his smoothed targets, by Newton steps."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (p - t))
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, epochs: int = 20, folds: int = 4, seed: int = 7) -> Model | None:
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return None
    place = np.random.default_rng(seed).permutation(len(rows)) % folds
    margins = np.zeros(len(rows))
    for k in range(folds):
        use = [i for i in range(len(rows)) if place[i] != k]
        if len(set(y[use].tolist())) < 2:
            continue
        m = Model(*_train([rows[i] for i in use], y[use], cost, epochs, seed), 1.0, 0.0)
        for i in np.flatnonzero(place == k):
            margins[i] = m.margin(rows[i])
    weight, bias = _train(rows, y, cost, epochs, seed)
    return Model(weight.astype(np.float32), bias, *_logistic(margins, y))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_positions: int = MOST_POSITIONS) -> Model | None:
    """Fit on at most `max_rows` labelled training documents, half of each class, picked by a hash of doc_id.

    Labels of documents that aren't there don't count. Of a doc_id's labels the most frequent one counts, 0 if both are as
    frequent; of its rows the first text in order. What the driver collects is bounded whatever the corpus size: one set of
    indicator positions a document, and of those at most `max_positions` a class: the documents of a class are taken in the
    order of the hash up to the first that doesn't fit any more, the first one always.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    usable = usable.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality")).join(docs.select("doc_id"), "doc_id", "left_semi")
    usable = materialize(usable, "labels")
    picked = [r for k in (0, 1) for r in usable.filter(F.col("quality") == k).orderBy(*by_hash).limit(max_rows // 2).collect()]
    label = {r["doc_id"]: r["quality"] for r in picked}
    if len(set(label.values())) < 2:
        return None
    chosen_type = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in label], chosen_type))  # max_rows ids at most
    sample = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    found = map_texts(sample, ["doc_id"], "text", [T.StructField("found", T.BinaryType())], lambda texts: [[features(t).astype(np.uint32).tobytes() for t in texts]])
    stored = materialize(found.withColumn("n", F.length("found") / 4), "features")
    place = {r["doc_id"]: i for i, r in enumerate(picked)}
    fits, held, full = set(), {0: 0, 1: 0}, set()
    for r in sorted(stored.select("doc_id", "n").collect(), key=lambda r: place[r["doc_id"]]):
        k = label[r["doc_id"]]
        if k not in full and (held[k] + r["n"] <= max_positions or not held[k]):
            fits.add(r["doc_id"])
            held[k] += int(r["n"])
        else:
            full.add(k)
    some = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in fits], chosen_type)) if len(fits) < len(place) else None
    rows = sorted((stored.join(some, "doc_id", "left_semi") if some is not None else stored).select("doc_id", "found").collect(), key=lambda r: r["doc_id"])
    return fit([np.frombuffer(r["found"], np.uint32).astype(np.int64) for r in rows], [label[r["doc_id"]] for r in rows])


def scores(docs: DataFrame, model: Model | None, keep: list[str], name: str = "score") -> DataFrame:
    """`keep` columns of docs and the score as `name`, computed from the text alone. The broadcast model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list[list]:
        m = shared.value
        if m is None:
            return [[1.0] * len(texts)]
        return [[m.score(m.margin(features(t))) for t in texts]]

    return map_texts(docs, keep, "text", [T.StructField(name, T.DoubleType())], run)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = scores(docs, train(docs, labels, max_rows), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    score = free_name(docs, "score")
    scored = scores(docs, train(docs, labels, max_rows), docs.columns, score)
    return scored.filter(F.col(score) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
