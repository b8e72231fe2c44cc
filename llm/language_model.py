"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are the words ``[^\x20\x09-\x0D]+`` with A-Z in lower case, then one
end. Every token has a *slot* in one of ``CLASSES`` classes of ``SLOTS``
slots: the most frequent words and the end have one of their own, all others
share slots by a hash of their last letters. The model is

    P(token | history) = P(class | history) P(slot | class, history) P(token | slot)

Both softmaxes are log-linear in hashed features of the history: for the class a
constant, the previous slot, the previous two, and the one before the previous
(skip); within a class a constant and the previous slot, crossed with it. P(token | slot) is
(count + 1) / (slot's count + slot's words + 1) over the training counts.

Training. Counts cover all training documents. The weights are trained in
``ROUNDS`` rounds, each over its own share of all training documents: every
task starts from the shared weights, takes gradient steps over its batches,
and sends the change of each weight row with the number of tokens that
touched it; the rows' changes are averaged by these numbers, in two levels.
Weights are ``TABLE_ROWS`` x ``SLOTS`` floats whatever the corpus.

Scoring. Counts of the most frequent ``FREQUENT`` words at most are a
dictionary in every task; the rest of a document's words are summed up by a
join with the table of counts. Everything else is a numpy batch in the task.

Defined cases: a null text is empty and has the end token alone. Null ids are
in no fold and train. Repeated rows count and are scored row by row. Without
training documents every count is 0, and each token's base term is 0. An
empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import (ROW_KEY, batches, crc32_id, documents, id_and_text, stage, texts, with_row_key)

FOLDS, HELD_OUT = 7, 2
CLASSES = SLOTS = 32
OWN_SLOTS = CLASSES * SLOTS // 2
START = CLASSES * SLOTS
#: Feature rows: class softmax, then the softmax within a class.
TRIGRAMS, CROSSED = 4096, 8192
BIGRAM_AT, SKIP_AT = 1, 1 + START + 1
TRIGRAM_AT = SKIP_AT + START + 1
IN_CLASS_AT = TRIGRAM_AT + TRIGRAMS
CROSSED_AT = IN_CLASS_AT + CLASSES
TABLE_ROWS = CROSSED_AT + CROSSED
ROUNDS, STEP, BATCH = 3, 0.08, 1024
#: Sums of weight changes are made in this many groups of tasks at first.
GROUPS = 8
FREQUENT = 400_000
COUNTER_WORDS = 400_000
CACHE_WORDS = 400_000
END = b""  # no word is empty


def tokens(text: str) -> list[bytes]:
    found = text.encode().lower().split()
    found.append(END)
    return found


def held_out():
    return F.coalesce(F.pmod(crc32_id(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


class Slots(dict):
    """Slot of each token; words without one of their own are hashed."""

    def __init__(self, own: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(own))
        self.own = own

    def __reduce__(self):
        return Slots, (self.own,)

    def __missing__(self, word: bytes) -> int:
        core = word.rstrip(b".,;:!?")
        group = zlib.crc32(core[-2:]) % (CLASSES // 2)
        within = zlib.crc32(core[-4:] + (b"." if core != word else b"")) % SLOTS
        slot = OWN_SLOTS + group * SLOTS + within
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.own))
        self[word] = slot
        return slot


def history(slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all tokens of some documents, and the two before each."""
    pad = np.full(2, START, np.int64)
    flat = np.concatenate([x for s in slots for x in (pad, s)])
    here = np.concatenate([x for s in slots for x in (np.zeros(2, bool), np.ones(len(s), bool))])
    at = np.flatnonzero(here)
    return flat[at], flat[at - 1], flat[at - 2]


def features(now: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list, list]:
    """Weight rows per token, for the class and for the slot within it."""
    cls = now // SLOTS
    pair = (one * 1_000_003 + two) * 0x9E3779B1 >> 7
    crossed = (one * 1_000_003 + cls) * 0x85EBCA6B >> 7
    return ([BIGRAM_AT + one, SKIP_AT + two, TRIGRAM_AT + pair % TRIGRAMS],
            [IN_CLASS_AT + cls, CROSSED_AT + crossed % CROSSED])


_ONES = np.ones(SLOTS, np.float32)
#: Log-odds beyond this are cut before exp.
MOST = np.float32(60.0)


def exp_scores(weights: np.ndarray, rows: list[np.ndarray],
               constant: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised chances of the outcomes per token, and their sums."""
    z = weights.take(rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        z += weights.take(r, axis=0, mode="clip")
    if constant is not None:
        z += constant
    np.minimum(z, MOST, out=z)
    np.exp(z, out=z)
    return z, z @ _ONES


def log_chance(weights: np.ndarray, now: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural log of P(class) P(slot | class) per token."""
    out = np.empty(len(now))
    for a in range(0, len(now), BATCH):
        s = slice(a, a + BATCH)
        of_class, of_slot = features(now[s], one[s], two[s])
        n = np.arange(len(now[s]))
        c, c_sum = exp_scores(weights, of_class, weights[0])
        w, w_sum = exp_scores(weights, of_slot)
        out[s] = np.log(c[n, now[s] // SLOTS] / c_sum) + np.log(w[n, now[s] % SLOTS] / w_sum)
    return out


class Trainer:
    """Gradient steps from given weights; one step size per weight row."""

    def __init__(self, weights: np.ndarray):
        self.start = weights
        self.weights = weights.copy()
        self.seen = np.full(TABLE_ROWS, 1e-4, np.float32)
        self.touched = np.zeros(TABLE_ROWS, np.float32)

    def _step(self, at: np.ndarray | int, g: np.ndarray, n: np.ndarray | int) -> None:
        """One step of the weight rows ``at`` against gradients g of n tokens."""
        self.seen[at] += (g * g).sum(-1) / SLOTS
        self.weights[at] -= STEP * g / np.sqrt(self.seen[at])[..., None]
        self.touched[at] += n

    def _scatter(self, rows: np.ndarray, error: np.ndarray) -> None:
        rows = rows.astype(np.uint16)  # sorted by radix; TABLE_ROWS are fewer
        order = np.argsort(rows, kind="stable")
        held = rows[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        self._step(held[first], np.add.reduceat(error.take(order, axis=0), first, axis=0),
                   np.diff(np.append(first, len(held))))

    def train(self, now: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        of_class, of_slot = features(now, one, two)
        n = np.arange(len(now))
        for rows, goal, constant in ((of_class, now // SLOTS, self.weights[0]), (of_slot, now % SLOTS, None)):
            error, sums = exp_scores(self.weights, rows, constant)
            error /= sums[:, None]
            error[n, goal] -= 1
            for r in rows:
                self._scatter(r, error)
            if rows is of_class:
                self._step(0, error.sum(0), len(now))

    def change(self) -> np.ndarray:
        """Per row, the change times the tokens that touched it, and these."""
        return np.hstack([(self.weights - self.start) * self.touched[:, None], self.touched[:, None]])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of (text)."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]):
        counts: Counter[bytes] = Counter()
        for batch in found:
            for text in texts(batch.column(0)):
                counts.update(tokens(text))
            if len(counts) > COUNTER_WORDS:
                yield from send(counts)
                counts.clear()
        yield from send(counts)

    def send(counts: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        words, n = list(counts), list(counts.values())
        for a in range(0, len(n), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[a:a + 50_000], pa.binary()), pa.array(n[a:a + 50_000], pa.int64())], schema=schema)

    return stage(docs.select("text").mapInArrow(run, "word binary, c long")
                 .groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class Model:
    """What scoring needs; of fixed size but for ``counts``, which holds the
    ``FREQUENT`` most frequent words at most."""

    weights: np.ndarray
    own: list[bytes]
    slot_size: np.ndarray
    counts: dict[bytes, int]
    train_tokens: int
    types: int


def _frequent(vocabulary: DataFrame, most: int) -> dict[bytes, int]:
    """Counts of the words at or above the least count that at most ``most``
    words reach, by steps of an eighth of a doubling."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r.s, r.n) for r in vocabulary.groupBy(step.alias("s")).agg(F.count("*").alias("n"))
                    .collect()), reverse=True)  # at most 512 rows
    least, held = 1 << 30, 0
    for s, n in sizes:
        if held + n > most:
            break
        least, held = s, held + n
    found = vocabulary.filter(step >= least).toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True))


def _slot_sizes(vocabulary: DataFrame, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words per slot."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(slots)

    def run(found: Iterator[pa.RecordBatch]):
        place = shared.value
        total = np.zeros((2, START), np.int64)
        for batch in found:
            at = np.fromiter(map(place.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            total[0] += np.bincount(at, batch.column(1).to_numpy(), START).astype(np.int64)
            total[1] += np.bincount(at, minlength=START)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(START, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])],
            names=["slot", "n", "v"])

    rows = vocabulary.select("word", "c").mapInArrow(run, "slot int, n long, v long") \
        .groupBy("slot").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    n, v = np.zeros(START, np.int64), np.zeros(START, np.int64)
    n[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    v[rows.column("slot").to_numpy()] = rows.column("v").to_numpy()
    return n, v


def _round(docs: DataFrame, weights: np.ndarray, slots: Slots) -> np.ndarray:
    """Averaged changes of the weights after one pass over ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((weights, slots))
    parts = 16
    cut = np.linspace(0, TABLE_ROWS, parts + 1).astype(int)
    schema = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("data", pa.binary())])

    def learn(found: Iterator[pa.RecordBatch]):
        start, place = shared.value
        trainer = Trainer(start)
        held: list[np.ndarray] = []
        n = 0

        def flush():
            now, one, two = history(held)
            for a in range(0, len(now), BATCH):
                trainer.train(now[a:a + BATCH], one[a:a + BATCH], two[a:a + BATCH])

        for batch in found:
            for text in texts(batch.column(0)):
                words = tokens(text)
                held.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
                n += len(words)
                if n >= 16 * BATCH:
                    flush()
                    held, n = [], 0
        if held:
            flush()
        salt = TaskContext.get().partitionId() % GROUPS
        change = trainer.change().astype(np.float32)
        if trainer.touched.any():
            yield from batches(((i, salt, change[cut[i]:cut[i + 1]].tobytes()) for i in range(parts)), schema, 4)

    def add(found: Iterator[pa.RecordBatch]):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in found:
            for i, salt, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                x = np.frombuffer(data, np.float32)
                total[i, salt] = total[i, salt] + x if (i, salt) in total else x.astype(np.float64)
        yield from batches(((i, s, x.astype(np.float32).tobytes()) for (i, s), x in total.items()), schema, 4)

    sql = "part int, salt int, data binary"
    summed = docs.select("text").mapInArrow(learn, sql).repartition(2 * parts, "part", "salt").mapInArrow(add, sql)
    total = np.zeros((TABLE_ROWS, SLOTS + 1))
    rows = summed.toArrow()  # GROUPS sums of the weights' size at most
    for i, data in zip(rows.column("part").to_pylist(), rows.column("data").to_pylist(), strict=True):
        total[cut[i]:cut[i + 1]] += np.frombuffer(data, np.float32).reshape(-1, SLOTS + 1)
    return (total[:, :-1] / np.maximum(total[:, -1:], 1)).astype(np.float32)


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the table of counts (word, c), from training documents
    with columns doc_id and text."""
    vocabulary = count_words(docs)
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    counts = _frequent(vocabulary, FREQUENT)
    top = sorted(counts.keys() - {END}, key=lambda w: (-counts[w], w))[:OWN_SLOTS - 1]
    own = [END, *top]
    slots = Slots(own)
    n, v = _slot_sizes(vocabulary, slots)
    weights = np.zeros((TABLE_ROWS, SLOTS), np.float32)
    by_class = n.reshape(CLASSES, SLOTS)
    weights[0] = np.log((by_class.sum(1) + 1.0) / (size.n + CLASSES))
    weights[IN_CLASS_AT:IN_CLASS_AT + CLASSES] = np.log(
        (by_class + 0.5) / (by_class.sum(1, keepdims=True) + 0.5 * SLOTS))
    share = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds if size.n else 0):
        weights = weights + _round(docs.filter(F.coalesce(share, F.lit(0)) == k), weights, slots)
    return Model(weights, own, n + v + 1, counts, size.n, size.v), vocabulary


class _Places(dict):
    """Place of each frequent word in ``log`` (log10 of count + 1) and ``slot``;
    any other word gives -1 - its slot."""

    def __init__(self, m: Model):
        super().__init__((w, i) for i, w in enumerate(m.counts))
        self.slots = Slots(m.own)
        self.log = np.log10(np.fromiter(m.counts.values(), np.float64, len(self)) + 1) if self else np.zeros(1)
        self.slot = np.fromiter(map(self.slots.__getitem__, m.counts), np.int64, len(self)) if self \
            else np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        return -1 - self.slots[word]


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """One row per document: row key, doc_id, n_tokens, n_known, base_score
    and score, both log10."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("_rf", pa.int64()), ("_rr", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                        ("rare", pa.list_(pa.binary()))])

    def rows(found: Iterator[pa.RecordBatch]):
        m = shared.value
        if not hasattr(m, "places"):
            m.places = _Places(m)
        places = m.places
        base = math.log10(m.train_tokens + 1 * (m.types + 1))
        slot_base = np.log10(m.slot_size)
        for big in found:
            for a in range(0, big.num_rows, 100):
                batch = big.slice(a, 100)
                words = [tokens(t) for t in texts(batch.column(3))]
                n = np.fromiter(map(len, words), np.int64, len(words))
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                flat = [w for run in words for w in run]
                at = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
                new, known = at < 0, np.maximum(at, 0)
                slot = np.where(new, -1 - at, places.slot[known])
                logs = np.where(new, 0.0, places.log[known])
                now, one, two = history(np.split(slot, first[1:]))
                parts = log_chance(m.weights, now, one, two) / math.log(10) - slot_base[now] + logs
                left = np.add.reduceat(new.astype(np.int64), first)
                rare = pa.array([flat[i] for i in np.flatnonzero(new).tolist()], pa.binary())
                ends = np.concatenate(([0], np.cumsum(left))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(n), pa.array(n - left),
                     pa.array(np.add.reduceat(logs, first) - n * base), pa.array(np.add.reduceat(parts, first)),
                     pa.ListArray.from_arrays(pa.array(ends), rare)], schema=schema)

    scored = stage(with_row_key(docs, *id_and_text(docs)).mapInArrow(
        rows,
        "_rf long, _rr long, doc_id long, n_tokens long, n_known long, base double, score double, "
        "rare array<binary>"), "scored")
    # words beyond the frequent ones, each of bounded count: no hot key
    looked_up = (scored.select(*ROW_KEY, F.explode("rare").alias("word")).join(vocabulary, "word")
                 .groupBy(*ROW_KEY).agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs")))
    none = F.lit(0.0)
    return scored.drop("rare").join(looked_up, ROW_KEY, "left").select(
        *ROW_KEY, "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("logs", none)).alias("base_score"),
        (F.col("score") + F.coalesce("logs", none)).alias("score"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*id_and_text(documents(spark, sf_dir)))
    model, vocabulary = train(docs.filter(~held_out()))
    found = score(documents(spark, sf_dir), model, vocabulary)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
                        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
