"""Operator 3: quality classifier - hashed word n-grams, logistic regression by
follow-the-regularised-leader (FTRL-proximal), scored as sparse dot products.

A text is read as tokens: words, and runs of other marks.  Features are hashed n-grams of
one and two tokens, and of two and three token *shapes* (case, digits, marks, a word
said again), each kind normalised to its share of the text, so long and short texts
weigh alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stage import cut
from .common import text_of

BITS = 18              # features are hashed to 2**BITS weights
TRAIN_ROWS = 20_000    # bound on the labelled rows trained on, the ones of smallest digest
SHARDS = 4             # learners that run side by side, and whose weights are averaged
ROUNDS = 6             # passes of each over its rows
PIECES = 16            # weights are averaged in so many pieces
ALPHA, BETA, L1, L2 = 8.0, 1.0, 1e-5, 1e-6
KEEP_FROM = 0.3
TRAIN_BYTES = 128 << 20  # and on the bytes of their texts
TOKENS = re.compile(r"\w+|[^\w\s]+")
SPACE = re.compile(r"\s")
CACHE_TOKENS = 150_000
_CHUNK = 1 << 20       # characters worked on at once
_BEFORE = 3            # tokens back that an n-gram's shapes look at

_cache: dict[str, int] = {}


def _token(token: str) -> int:
    """Hash of a token in the upper, its shape in the lower 8 bits."""
    c = token[0]
    if c.isalpha() or c == "_":
        shape = 1 if token.islower() else 2 if token.isupper() and len(token) > 1 else (
            3 if c.isupper() and (len(token) == 1 or token[1:].islower()) else 4)
    elif c.isdigit():
        shape = 5
    else:
        shape = 16 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % 240
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) << 8 | shape


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _grams(codes: np.ndarray, old: int = 0) -> list[np.ndarray]:
    """Feature indices of each kind from the codes of consecutive tokens, of the n-grams that
    end behind the first ``old`` tokens (0, or at least ``_BEFORE`` unless the text has fewer)."""
    word, shape = codes >> np.uint64(8), codes & np.uint64(255)
    again = np.concatenate(([False], word[1:] == word[:-1]))
    shape = np.where(again, np.uint64(6), shape)
    n = len(codes)

    def ending(kind: int, *tokens: np.ndarray) -> np.ndarray:
        """Of as many consecutive tokens as given, the n-grams that end in a new one."""
        size = len(tokens)
        first = max(0, old - size + 1)
        ends = [t[first + k:n - size + 1 + k] for k, t in enumerate(tokens)]
        return _mix(np.full(len(ends[0]), kind, np.uint64), *ends) if n >= size else np.empty(0, np.int64)

    return [ending(1, word), ending(2, word, word),
            ending(3, shape, shape) if n > 1 else ending(3, shape), ending(4, shape, shape, shape)]


def _codes(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Token codes of a text in runs, each after the last tokens of the run before it, and how
    many those are: n-grams that end in new tokens are all n-grams, once.  Runs end at white
    space, and the first has two tokens, unless the text has one only."""
    if len(_cache) > CACHE_TOKENS:
        _cache.clear()
    tail: list[str] = []
    old = at = 0
    while at < len(text):
        space = SPACE.search(text, min(len(text), at + _CHUNK))
        end = space.start() if space else len(text)
        tokens = tail + TOKENS.findall(text, at, end)
        at = end
        if len(tokens) == old or (len(tokens) < 2 and at < len(text)):
            tail = tokens
            continue
        for t in set(tokens).difference(_cache):
            _cache[t] = _token(t)
        yield np.fromiter(map(_cache.__getitem__, tokens), np.uint64, len(tokens)), old
        tail = tokens[-_BEFORE:]
        old = len(tail)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different feature indices of a text, ascending, and their values; each kind adds up
    to 1.  A text without tokens has none."""
    parts = [_grams(*c) for c in _codes(text)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    kinds = [np.concatenate(k) for k in zip(*parts)]
    index = np.concatenate(kinds)
    value = np.concatenate([np.full(len(k), 1.0 / max(1, len(k))) for k in kinds])
    index, where = np.unique(index, return_inverse=True)
    return index, np.bincount(where, value)


@dataclass
class Model:
    """Weights and bias; all zero (every score 0.5) when there was nothing to learn from."""
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        """Probability of label 1: the logistic of a sparse dot product."""
        total, kinds = self.bias, {}
        for run in _codes(text):
            for k, index in enumerate(_grams(*run)):
                s, n = kinds.get(k, (0.0, 0))
                kinds[k] = (s + float(self.weights[index].sum()), n + len(index))
        total += sum(s / n for s, n in kinds.values() if n)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal updates over (indices, values, label), in place.  The last
    place of ``z`` and ``n`` is the bias."""
    bias = len(z) - 1
    for index, value, label in rows:
        i = np.append(index, bias)
        x = np.append(value, 1.0)
        zi, ni = z[i], n[i]
        w = _weights(zi, ni)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[i] = zi + g - sigma * w
        n[i] = ni + g * g


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, rounds: int = ROUNDS,
          shards: int = SHARDS, bound_bytes: int = TRAIN_BYTES) -> Model:
    """Learn ``quality`` of ``labels`` (doc_id, quality) from the texts of ``docs``.

    Held-out ids are left out first.  Of the others the ``bound`` with the smallest digest
    of the id are learned from, so the fit costs the same at any size; several labels of
    one id count by their majority (a tie as 1), null ones not.  Of these rows, in the same
    order, those count whose texts come to ``bound_bytes`` at most together (a text above a
    sixteenth of that is passed over), so a learner's memory is bounded.  The sampled texts are
    written once; only they are shuffled, to ``shards`` learners; each passes ``rounds`` times over its fixed share in a
    fixed order, and their weights are averaged, piece by piece.  What reaches the driver
    is the average of 2**BITS numbers."""
    digest = F.md5(F.col("doc_id").cast("string"))
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
             .select(F.col("doc_id").alias("of"), digest.alias("place"), "label")
             .orderBy("place", "of").limit(bound))

    size = 1 << BITS

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        labels = t["label"].to_pylist()
        rows = [(*features(x), y) for x, y in zip(t["text"].to_pylist(), labels)]
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        for _ in range(rounds):
            ftrl(rows, z, n)
        pieces = np.array_split(_weights(z, n), PIECES)
        each = lambda v: pa.array([v] * PIECES, pa.int32())
        return pa.table({"piece": pa.array(range(PIECES), pa.int32()), "shard": each(t["shard"][0].as_py()),
                         "rows": each(len(rows)), "ones": each(sum(labels)),
                         "weights": pa.array([p.tobytes() for p in pieces], pa.binary())})

    def average(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")  # a fixed order of addition
        mean = np.mean([np.frombuffer(x) for x in t["weights"].to_pylist()], axis=0)
        count = lambda c: pa.array([sum(t[c].to_pylist())], pa.int32())
        return pa.table({"piece": t["piece"][:1], "rows": count("rows"), "ones": count("ones"),
                         "weights": pa.array([mean.tobytes()], pa.binary())})

    sample = cut(docs.select("doc_id", text_of().alias("text"))
                 .join(F.broadcast(known), F.col("doc_id") == F.col("of"))  # at most ``bound`` rows
                 .filter(F.octet_length("text") <= bound_bytes // 16)
                 # an id that several rows have counts once
                 .groupBy("place").agg(F.min_by(F.struct("label", "text"), F.md5("text")).alias("r")),
                 "quality-sample")
    # narrow, at most ``bound`` rows
    sizes = sample.select(F.col("place").alias("p"), F.octet_length("r.text").alias("bytes"))
    within = (sizes.select("p", F.sum("bytes").over(W.orderBy("p")).alias("total"))
              .filter(F.col("total") <= bound_bytes))
    means = (sample.join(F.broadcast(within), F.col("place") == F.col("p"), "left_semi")
             .select(F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard"), "place", "r.*")
             .groupBy("shard").applyInArrow(
                 learn, "piece int, shard int, rows int, ones int, weights binary")
             .groupBy("piece").applyInArrow(average, "piece int, rows int, ones int, weights binary")
             .collect())
    means.sort(key=lambda r: r["piece"])
    if not means or not 0 < means[0]["ones"] < means[0]["rows"]:
        return Model(np.zeros(size), 0.0)
    w = np.concatenate([np.frombuffer(r["weights"]) for r in means])
    return Model(w[:-1], float(w[-1]))


def score(text: Column, model: Model, session) -> Column:
    """Score of a text (not null) by the model, 0 to 1."""
    sent = session.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([sent.value.score(t) for t in a.to_pylist()], pa.float64())

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, prefix: str = "",
             **training) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``keep_from`` on), their names after
    ``prefix``, to each row of ``docs``.

    Scores come from the text alone, in one narrow pass.  A null text scores like an empty
    one, by the bias; repeated rows score alike; empty documents give no rows, and without
    labels of both kinds every score is 0.5.  Columns of the two names are replaced."""
    model = train(docs, labels, **training)
    return (docs.withColumn(f"{prefix}score", score(text_of(), model, docs.sparkSession))
            .withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= keep_from).cast("int")))
