"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Each passage of ``WORDS`` words becomes a vector of writing measures. A small network encodes it, gated attention
learns from document labels alone which passages matter, and the weighted sum of the encodings is scored.
Training runs on a bounded sample of labelled documents (``Settings.docs`` per class, those with the smallest MD5
of their id); every document is scored inside Spark tasks, over its whole text.

Defined cases: a null or empty text is one passage of zeros and gets a score like any other; without labels of
both classes every score is the share of label 1 (0.5 without labels); several labels of one id count as
their smallest; repeated rows are scored alike; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.llm.language import fold, hash_bound, id_hash
from txnwatch.llm.shared import same_columns
from txnwatch.llm.words import array, mix, texts, words

WORDS = 64
CLASSES = [
    list(range(65, 91)), list(range(97, 123)), list(range(48, 58)), list(b"#*$%&<>"), list(b"|"), list(b"!"),
    list(b"?"), list(b".;:"), list(b","), [10], list(range(128, 256)),
]
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES):
    CLASS_OF[_bytes] = _k
FEATURES = len(CLASSES) + 8


@dataclass(frozen=True)
class Settings:
    docs: int = 2000  # sampled documents per class
    longest: int = 200_000  # characters of a sampled document at most
    hidden: int = 16
    rounds: int = 300
    rate: float = 0.02
    decay: float = 1e-4
    accept: float = 0.7
    seed: int = 7


def encode(text: bytes | None) -> np.ndarray:
    """One row of writing measures per passage, at least one row."""
    buf = array(text)
    starts, ends, hashes = words(buf, lower=True)
    n = len(starts)
    if n == 0:
        return np.zeros((1, FEATURES), np.float32)
    first = np.arange(0, n, WORDS)
    passage = np.arange(n) // WORDS
    size = np.diff(np.append(first, n)).astype(np.float64)
    k = len(first)
    # Bytes of each class per passage; a passage runs to the start of the next.
    cuts = starts[first]
    owner = np.repeat(np.arange(k), np.diff(np.append(cuts, len(buf))))
    grid = np.bincount(owner * (len(CLASSES) + 1) + CLASS_OF[buf[cuts[0] :]], minlength=k * (len(CLASSES) + 1))
    grid = grid.reshape(k, -1)[:, : len(CLASSES)] / size[:, None]
    length = ends - starts
    same = np.zeros(n)
    same[1:] = hashes[1:] == hashes[:-1]
    keys = mix(hashes + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(passage[np.unique(keys, return_index=True)[1]], minlength=k)
    new = np.zeros(n)
    new[np.unique(hashes, return_index=True)[1]] = 1
    letters = grid[:, 0] + grid[:, 1] + grid[:, 10] + 1e-9
    more = [
        size / WORDS,
        np.bincount(passage, length, k) / size / 8,
        np.maximum.reduceat(length, first) / 40,
        np.bincount(passage, length == 1, k) / size,
        np.bincount(passage, same, k) / size,
        distinct / size,
        np.bincount(passage, new, k) / size,
        grid[:, 0] / letters,
    ]
    return np.column_stack([np.log1p(grid), *more]).astype(np.float32)


class Network:
    """Encoder, gated attention and scorer with their gradients, in numpy."""

    def __init__(self, prior: float, mean: np.ndarray, scale: np.ndarray, settings: Settings) -> None:
        rng = np.random.default_rng(settings.seed)
        h = settings.hidden
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale, self.prior = mean, scale, prior
        self.p = {
            "E": draw(FEATURES, h), "e": np.zeros(h), "V": draw(h, h), "U": draw(h, h), "w": draw(h, 1)[:, 0],
            "c": np.zeros(h), "b": np.array(np.log(prior / (1 - prior))),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logit per bag; bags are consecutive rows beginning at ``first``."""
        p = self.p
        sizes = np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), sizes)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        code = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(code @ p["V"]), 1 / (1 + np.exp(-(code @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * code, first)
        return z @ p["c"] + p["b"], {"x": x, "code": code, "t": t, "g": g, "a": a, "z": z, "bag": bag}

    def gradients(self, d: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        p, code, bag, a = self.p, s["code"], s["bag"], s["a"]
        dz = np.outer(d, p["c"])
        da = (dz[bag] * code).sum(1)
        mean = (dz * s["z"]).sum(1)
        ds = a * (da - mean[bag])
        dt, dg = ds[:, None] * p["w"] * s["g"] * (1 - s["t"] ** 2), ds[:, None] * p["w"] * s["t"] * s["g"] * (1 - s["g"])
        dcode = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - code**2)
        return {
            "E": s["x"].T @ dcode, "e": dcode.sum(0), "V": code.T @ dt, "U": code.T @ dg, "w": (s["t"] * s["g"]).T @ ds,
            "c": s["z"].T @ d, "b": d.sum(),
        }

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        first = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return 1 / (1 + np.exp(-self.forward(np.concatenate(bags).astype(np.float64), first)[0]))


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, settings: Settings) -> Network:
    """Adam on the weighted log loss over all bags at once."""
    x = np.concatenate(bags).astype(np.float64)
    first = np.cumsum([0, *(len(b) for b in bags[:-1])])
    prior = float(np.clip((labels * weights).sum() / weights.sum(), 0.01, 0.99))
    net = Network(prior, x.mean(0), x.std(0) + 1e-3, settings)
    weights = weights / weights.sum()
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, settings.rounds + 1):
        logit, state = net.forward(x, first)
        grad = net.gradients((1 / (1 + np.exp(-logit)) - labels) * weights, state)
        for k, w in net.p.items():
            g = grad[k] + settings.decay * w
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] = w - settings.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    return net


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network | float:
    """Train on a bounded sample of the labelled documents; without both classes, the share of label 1."""
    known = (
        same_columns(labels, ["doc_id", "quality"])
        .filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    counts = {int(r["quality"]): r["count"] for r in known.groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return prior
    order = id_hash(F.col("doc_id"))
    best = W.partitionBy("quality").orderBy(order, "doc_id")
    # A hash bound per class leaves about four times the sample, so the window ranks few rows.
    bounds = [hash_bound(4 * settings.docs, counts[c]) for c in (0, 1)]
    near = known.filter(order < F.when(F.col("quality") == 0, F.lit(bounds[0])).otherwise(F.lit(bounds[1])))
    sample = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= settings.docs).drop("rank")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = [encode(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                ["doc_id", "quality", "rows"],
            )

    rows = (
        same_columns(docs, ["doc_id", "text"])
        .filter(F.coalesce(F.length("text"), F.lit(0)) <= settings.longest)
        .join(F.broadcast(sample), "doc_id")  # at most 2 * settings.docs rows
        .select("doc_id", "quality", "text")
        .mapInArrow(run, "doc_id long, quality int, rows binary")
        .orderBy("doc_id", "rows")
        .limit(4 * settings.docs)
        .collect()
    )
    y = np.array([r["quality"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return prior
    share = {c: counts[c] / max(1, int((y == c).sum())) for c in (0, 1)}
    bags = [np.frombuffer(bytes(r["rows"]), np.float32).reshape(-1, FEATURES) for r in rows]
    return train(bags, y, np.array([share[int(c)] for c in y]), settings)


def score(docs: DataFrame, model: Network | float, settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns ``keep`` (doc_id unless given), score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    # Kept columns travel under positions, so no name can clash with the two that are added.
    rows = docs.select(F.col("text").alias("t"), *[F.col(f"`{name}`").alias(f"c{k}") for k, name in enumerate(keep)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if isinstance(sent.value, float):
                    found = np.full(part.num_rows, sent.value)
                else:
                    found = sent.value.scores([encode(t) for t in texts(part.column(0))])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(found, pa.float64()), pa.array((found >= settings.accept).astype(np.int32))],
                    [*part.schema.names[1:], "score", "predicted"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    found = rows.mapInArrow(run, f"{kinds}, score double, predicted int")
    return found.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(keep)], "score", "predicted")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, settings: Settings = Settings()) -> DataFrame:
    """Learn from labels outside fold ``held`` and score every document; ``held_out`` marks that fold."""
    model = learn(docs, labels.filter(fold(F.col("doc_id"), folds) != held), settings)
    return score(docs, model, settings).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
