"""Toxicity by a factorization machine over hashed terms.

A document is the set of its words (A-Z lower-cased, split at ASCII characters
that are neither letters nor digits), hashed into ``BUCKETS`` buckets.  The
machine scores it by a bias, a weight for each term, and the inner products of
the factor vectors of each pair of terms, so a pair such as an insult with the
mention of a group can weigh more than its parts.  The pair sum is taken in
linear time as ((sum v)^2 - sum v^2) / 2 and divided by the root of the number
of terms, so that long documents do not drown it.

The machine is fitted on at most ``MAX_LABELLED`` labelled rows (a documented
bound: those whose hashed id is smallest), so the driver holds a bounded number
of hashed sets.  Scoring reads every text whole, batch by batch, with the
fitted arrays (a fixed size, ``BUCKETS`` x (1 + ``FACTORS``) floats) broadcast.

Null and empty texts have no terms and score the bias.  Rows with a null label
or id teach nothing; a document labelled twice teaches twice; of rows that share an
id the least text teaches.  Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fxledger.llm import textops as tx
from fxledger.llm.memory import freed

BUCKETS = 1 << 18
FACTORS = 4
MAX_LABELLED = 20_000
MIN_ROWS = 8  # a bucket seen in fewer sampled rows is not used
EPOCHS = (12, 3)        # of the linear part, and how many without a gain end it
PAIR_EPOCHS = (32, 8)   # of the factors
START = 0.3             # spread of the first factors
CHECK_EVERY = 10        # one row of so many is kept apart to stop by
BATCH = 256

_KEEP = tx.table_of(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))
_KEEP[128:] = True
_SEPARATOR = ~_KEEP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Machine:
    bias: float
    weight: np.ndarray   # BUCKETS
    factor: np.ndarray   # BUCKETS x FACTORS; rows of unused buckets are 0
    used: np.ndarray     # BUCKETS, bool


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, concatenated, and their bounds."""
    ids, counts = [], []
    for a, b, buf, off in tx.slabs(text):
        buf = _LOWER[buf]
        w0, w1, doc = tx.words(buf, off, _SEPARATOR)
        bucket = (tx.Prefix(buf).of(w0, w1) & tx.U64(BUCKETS - 1)).astype(np.int64)
        key = np.unique(doc * BUCKETS + bucket)
        ids.append((key % BUCKETS).astype(np.int32))
        counts.append(np.bincount(key // BUCKETS, minlength=b - a))
    if not ids:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, axis=0, out=s[1:])
    return s[off[1:]] - s[off[:-1]]


def margin(m: Machine, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The machine's value for each set of buckets."""
    keep = m.used[ids]
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    ids = ids[keep]
    v = m.factor[ids].astype(np.float64)
    pairs = (_sums(v, off) ** 2 - _sums(v * v, off)).sum(axis=1) / 2
    return m.bias + _sums(m.weight[ids].astype(np.float64), off) + pairs / np.sqrt(np.maximum(1, np.diff(off)))


class _Fit:
    """Parameters of the used terms under AdaGrad, and the rows they are fitted on."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, label: np.ndarray, factors: int):
        self.rng = np.random.default_rng(7)
        self.used = np.bincount(ids, minlength=BUCKETS) >= MIN_ROWS
        keep = self.used[ids]
        self.off = np.concatenate([[0], np.cumsum(keep)])[off]
        self.own, self.term = np.unique(ids[keep], return_inverse=True)
        self.label, n = label, len(label)
        share = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
        self.weigh = np.where(label > 0, np.sqrt((1 - share) / share), 1.0)
        self.size = np.sqrt(np.maximum(1, np.diff(self.off)))
        check = np.arange(n) * 2654435761 % 2**32 % CHECK_EVERY == 0
        self.rows, self.checked = np.flatnonzero(~check), np.flatnonzero(check)
        self.bias = float(np.log(share / (1 - share)))
        self.weight = np.zeros(len(self.own))
        self.factor = self.rng.normal(0, START, (len(self.own), factors))
        self.seen = [1e-2, np.full(len(self.own), 1e-2), np.full((len(self.own), factors), 1e-2)]

    def values(self, rows: np.ndarray, pairs: bool):
        n = self.off[rows + 1] - self.off[rows]
        bound = np.concatenate([[0], np.cumsum(n)])
        x = self.term[np.repeat(self.off[rows] - bound[:-1], n) + np.arange(bound[-1])]
        v = self.factor[x]
        total = _sums(v, bound)
        value = self.bias + _sums(self.weight[x], bound)
        if pairs:
            value = value + ((total ** 2) - _sums(v * v, bound)).sum(axis=1) / 2 / self.size[rows]
        return x, np.repeat(np.arange(len(rows)), n), v, total, np.clip(value, -30, 30)

    def loss(self, pairs: bool) -> float:
        """Of the rows kept apart."""
        z, y = self.values(self.checked, pairs)[-1], self.label[self.checked]
        return float((self.weigh[self.checked] * (np.log1p(np.exp(z)) - y * z)).mean()) if len(y) else 0.0

    def epoch(self, pairs: bool, rate: float, l2: float, factor_l2: float) -> None:
        order, seen = self.rng.permutation(self.rows), self.seen
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            x, row, v, total, z = self.values(rows, pairs)
            slope = (1 / (1 + np.exp(-z)) - self.label[rows]) * self.weigh[rows]
            g = float(slope.mean())
            seen[0] += g * g
            self.bias -= rate * g / np.sqrt(seen[0])
            touched, inverse = np.unique(x, return_inverse=True)
            each = slope[row]
            gw = np.bincount(inverse, each, len(touched)) / len(rows) + l2 * self.weight[touched]
            seen[1][touched] += gw * gw
            self.weight[touched] -= rate * gw / np.sqrt(seen[1][touched])
            if pairs:
                gv = (each / self.size[rows][row])[:, None] * (total[row] - v)
                gf = np.stack([np.bincount(inverse, gv[:, k], len(touched)) for k in range(v.shape[1])], 1)
                gf = gf / len(rows) + factor_l2 * self.factor[touched]
                seen[2][touched] += gf * gf
                self.factor[touched] -= rate * gf / np.sqrt(seen[2][touched])

    def state(self) -> tuple:
        return self.bias, self.weight.copy(), self.factor.copy()


def fit(ids: np.ndarray, off: np.ndarray, label: np.ndarray, factors: int = FACTORS, rate: float = 0.3,
        l2: float = 2e-4, factor_l2: float = 1e-3) -> Machine:
    """Logistic loss by AdaGrad over small batches; deterministic.  Bias and weights are
    fitted first, then the factors with them; each part stops when the loss of a tenth
    of the rows, kept apart, has not fallen for a while, and its best state counts.  The
    factors stay only where they lower that loss: on additive data they are 0.  The
    rarer class weighs more, by the root of the classes' ratio, so that 0.5 does not
    favour the common one.  Without rows, or with one class only, only the bias is
    fitted."""
    n = len(label)
    weight, factor = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, max(1, factors)), np.float32)
    used = np.bincount(ids, minlength=BUCKETS) >= MIN_ROWS
    if not n or label.min() == label.max():
        share = min(max(float(label.mean()), 1e-3), 1 - 1e-3) if n else 0.5
        return Machine(float(np.log(share / (1 - share))), weight, factor, used)
    f = _Fit(ids, off, label, factors)

    def best_of(pairs: bool, epochs: int, patience: int) -> tuple[float, tuple]:
        found, since = (np.inf, f.state()), 0
        for _ in range(epochs):
            f.epoch(pairs, rate, l2, factor_l2)
            now = f.loss(pairs)
            found, since = ((now, f.state()), 0) if now < found[0] else (found, since + 1)
            if since >= patience:
                break
        return found

    loss, state = best_of(False, *EPOCHS)
    with_pairs = False
    if factors:
        f.bias, f.weight, _ = state[0], state[1].copy(), None
        other, paired = best_of(True, *PAIR_EPOCHS)
        if other < loss:
            state, with_pairs = paired, True
    weight[f.own] = state[1]
    if with_pairs:
        factor[f.own] = state[2]
    return Machine(state[0], weight, factor, used)


def held_out() -> Column:
    """crc32 of the id as text, modulo 5, is 0 (null ids are not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: Column,
          max_labelled: int = MAX_LABELLED, label: str = "toxic") -> Machine:
    """Fit on at most ``max_labelled`` of the labelled rows that ``rows`` allows."""
    chosen = (labels.select("doc_id", F.col(label).cast("double").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & rows)
              .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled))
    # at most max_labelled rows of two numbers: a proven bound for the broadcast
    # one text for each label, whatever copies of the row there are
    text = (docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("k", F.monotonically_increasing_id())),
                                               "doc_id")
            .groupBy("k", "doc_id", "y").agg(F.min("text").alias("text")))

    def hashed(batches):
        for batch in batches:
            ids, off = terms(batch.column("text"))
            sets = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), sets],
                                             ["doc_id", "y", "ids"])

    got = (text.select("doc_id", "y", "text")
           .mapInArrow(freed(hashed), "doc_id long, y double, ids array<int>").toArrow())
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    sets = got.column("ids").combine_chunks()
    if isinstance(sets, pa.ChunkedArray):
        sets = sets.chunk(0) if sets.num_chunks else pa.array([], pa.list_(pa.int32()))
    off = np.concatenate([[0], np.cumsum(np.asarray(sets.value_lengths().fill_null(0), np.int64))])
    return fit(np.asarray(sets.flatten(), np.int32), off, np.asarray(got.column("y"), np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(text: pa.Array) -> list[np.ndarray]:
        z = margin(shared.value, *terms(text))
        return [1 / (1 + np.exp(-np.clip(z, -30, 30)))]

    return tx.rowwise(docs.select("doc_id", "text"), run, "struct<score:double>").select("doc.doc_id", "out.score")
