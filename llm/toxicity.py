"""Toxicity by weak supervision.

1. *Voters.* A bounded sample of labelled training rows gives the words that
   occur in toxic documents far more often than by chance. By rank they form
   ``LEXICONS`` lexicon voters of growing size (toxic if a word of theirs
   occurs) and, dealt in turn, ``ABSENCE`` voters (clean if none of a part of
   the lexicon occurs); a few pattern voters look at the writing itself. A
   voter may abstain.
2. *Label model.* The votes on all documents that are not held out, counted
   by vote pattern, fit a generative model with one hidden class:
   expectation-maximisation estimates how each voter votes in either class,
   and the voters' correlations within a class. A voter's evidence is divided
   by how much of it others repeat, in every round from the second on, so the
   estimates of the next round rest on it; the sum is put on the scale of the
   labelled rows.
3. *Classifier.* The model's posterior labels on a bounded sample of training
   rows choose the word features of a logistic regression and train it; it
   scores every whole text.

Held-out rows (crc32 of the id modulo ``FOLDS`` is 0) give neither labels nor
votes nor training texts; id, source and language are no features.

Bounds (documented parameters): ``LABELLED_ROWS`` labelled rows, ``TRAIN_ROWS``
rows for the classifier, both by least hash of the id (ties by id), less
confirmed near copies (2-word shingles, 0.8) of another row of the sample;
``LEXICON_WORDS`` and ``FEATURES`` words. The model is a table of that many
words, so it is broadcast, and it is trained by the driver on at most
``TRAIN_ROWS`` lists of chosen words.

Defined cases: null texts count as empty and get the score of the intercept.
Very long texts vote and are scored whole. Rows with a null id are scored,
give votes, and are in no fold and no sample. Repeated rows and equal texts
are scored alike. Labels that are null or name no document are left out; of
several labels of one id toxic wins. Words of equal rank are ordered by their
bytes. Without toxic or without clean labels, no word is chosen and the score
is the smoothed share of toxic labels. Columns besides id and text are not
read by :func:`train`; :func:`with_score` keeps them, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import batches, crc32, crc32_id, documents, id_and_text, lean_worker, stage, texts
from llm.near_dedup import sample_copies

FOLDS = 5
LABELLED_ROWS = 30_000
TRAIN_ROWS = 40_000
LEXICON_WORDS = 2_000
FEATURES = 4_000
LEXICONS, ABSENCE = 24, 4
EM_ROUNDS = 4
#: Voters per doubling of a word's rank.
PER_DOUBLING = 2.2
#: A word enters when it is in this many documents, its count in one class
#: exceeds what chance expects by this many deviations, and the words before it
#: are at least this share of the different ones that chance would give (a word
#: of a copied passage follows few words).
LEAST_DOCS, LEAST_Z, LEAST_VARIETY = 4, 5.0, 0.4

#: ASCII letters and digits stay, other ASCII becomes a blank.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> set[bytes]:
    return set(_in_order(text))


def _in_order(text: str) -> list[bytes]:
    return text.lower().encode().translate(_FOLD).split()


_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")


def capitals(text: str) -> int:
    """Upper-case letters of the whole text, ASCII ones counted in bulk."""
    n = len(text.encode().translate(None, _NOT_CAPITAL))
    return n if text.isascii() else n + sum(map(str.isupper, "".join(_BEYOND_ASCII.findall(text))))


#: Pattern voters: name, vote if it holds, test on (text, number of words).
PATTERN_VOTERS = [
    ("many exclamation marks", 1, lambda t, n: t.count("!") > 0.05 * n + 1),
    ("mostly capitals", 1, lambda t, n: n > 3 and capitals(t) > 0.3 * len(t)),
    ("masked letters", 1, lambda t, n: t.count("*") > 0.02 * n + 2 and "***" not in t),
    ("questions and answers", -1, lambda t, n: t.count("?") > 0.02 * n + 1),
    ("long and calm", -1, lambda t, n: n > 200 and "!" not in t),
]
N_VOTERS = LEXICONS + ABSENCE + len(PATTERN_VOTERS)


@dataclass
class Voters:
    """Which voter each lexicon word belongs to; votes as two bit masks."""

    lexicon: dict[bytes, int]

    def votes(self, text: str) -> tuple[int, int]:
        found = words(text)
        hits = self.lexicon.keys() & found
        yes = no = 0
        absent = (1 << ABSENCE) - 1 if self.lexicon else 0
        for w in hits:
            rank = self.lexicon[w]
            yes |= 1 << min(LEXICONS - 1, int(PER_DOUBLING * math.log2(rank + 1)))
            absent &= ~(1 << rank % ABSENCE)
        no |= absent << LEXICONS
        for i, (_, vote, test) in enumerate(PATTERN_VOTERS):
            if test(text, len(found)):
                bit = 1 << LEXICONS + ABSENCE + i
                yes, no = (yes | bit, no) if vote > 0 else (yes, no | bit)
        return yes, no


def vote_array(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Votes 0 (abstain), 1 (toxic), 2 (clean) per row and voter."""
    bit = np.arange(N_VOTERS, dtype=np.int64)
    return ((yes[:, None] >> bit & 1) + 2 * (no[:, None] >> bit & 1)).astype(np.int64)


@dataclass
class LabelModel:
    """Chances of each vote by class (2 x voters x 3), the share of toxic
    documents, and how far each voter's evidence counts."""

    chance: np.ndarray
    share: float
    weight: np.ndarray = field(default_factory=lambda: np.ones(N_VOTERS))
    scale: tuple[float, float] = (1.0, 0.0)

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.chance[1]) - np.log(self.chance[0])
        return np.log(self.share / (1 - self.share)) + (
            ratio[np.arange(N_VOTERS), votes] * self.weight).sum(1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.evidence(votes) + b, -40, 40)))

    def sums(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected counts: per class its size, votes per voter, and joint
        non-abstentions per pair of voters."""
        p = self.posterior(votes)
        out = []
        for y in ((1 - p) * n, p * n):
            hot = np.eye(3)[votes]
            z = (votes == 1).astype(float) - (votes == 2)
            out.append(np.concatenate(([y.sum()], np.tensordot(y, hot, 1).ravel(),
                                       ((z * y[:, None]).T @ z).ravel())))
        return np.concatenate(out)

    @staticmethod
    def from_sums(sums: np.ndarray, weigh: bool = False) -> LabelModel:
        """The model that expected counts give; ``weigh``: with the voters'
        weights by their correlations."""
        by = sums.reshape(2, -1)
        size = by[:, 0]
        counts = by[:, 1:1 + 3 * N_VOTERS].reshape(2, N_VOTERS, 3)
        model = LabelModel((counts + 0.5) / (size[:, None, None] + 1.5),
                           float(np.clip((size[1] + 0.5) / (size.sum() + 1), 1e-4, 0.5)))
        if not weigh:
            return model
        joint = by[:, 1 + 3 * N_VOTERS:].reshape(2, N_VOTERS, N_VOTERS)
        strength = np.zeros((N_VOTERS, N_VOTERS))
        for y in range(2):
            mean = (counts[y, :, 1] - counts[y, :, 2]) / max(size[y], 1)
            cov = joint[y] / max(size[y], 1) - np.outer(mean, mean)
            dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            strength = np.maximum(strength, np.abs(cov / np.outer(dev, dev)))
        np.fill_diagonal(strength, 0)
        # what chance alone gives for this many documents is no correlation
        strength[strength < 0.1] = 0
        model.weight = 1 / (1 + np.minimum(strength, 1).sum(1))
        return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(crc32_id(F.col(doc_id)), F.lit(FOLDS)) == 0, F.lit(False))


def _sample(d: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows by least hash of the id."""
    return d.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _unlike_rows(rows: DataFrame) -> DataFrame:
    """Rows of a bounded sample without confirmed near copies of a row of
    lesser id hash (:func:`llm.near_dedup.sample_copies`): copies would make
    the words of one text look telling. Of the texts without words one stays."""
    names = rows.columns
    rows = stage(rows.withColumn("c", F.monotonically_increasing_id()), "sample")
    found = stage(sample_copies(rows.select("c", F.xxhash64("doc_id").alias("order"), "text")), "sample-copies")
    keep = found.filter(~F.col("copy")).select("c").unionByName(
        found.filter("copy is null").orderBy("order", "c").limit(1).select("c"))
    # no more keys than rows of the bounded sample
    return rows.join(F.broadcast(keep), "c").select(*names)


def _word_counts(rows: DataFrame, least: int) -> tuple[dict[bytes, tuple[float, float]], float, float]:
    """Documents per word, in toxic and in clean rows of (text, y), for words
    in at least ``least`` of them; and the sizes of the classes."""
    schema = pa.schema([("word", pa.binary()), ("one", pa.float64()), ("all", pa.float64()),
                        ("after", pa.int64())])

    def count(found: Iterator[pa.RecordBatch]):
        lean_worker()
        held: dict[bytes, list] = {}
        for batch in found:
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                run = _in_order(text)
                for w, before in dict(zip(run, [b"", *run], strict=False)).items():
                    c = held.setdefault(w, [0.0, 0.0, 0])
                    c[0] += y
                    c[1] += 1
                    c[2] |= 1 << crc32(before) % 63
        yield from batches(((w, *c) for w, c in held.items()), schema)

    size = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("one"), F.count("*").alias("all")).first()
    found = (rows.select("text", "y").mapInArrow(count, "word binary, one double, all double, after long")
             .groupBy("word").agg(F.sum("one").alias("one"), F.sum("all").alias("all"),
                                  F.bit_or("after").alias("after"))
             .filter((F.col("all") >= least)
                     & (F.bit_count("after") >= LEAST_VARIETY * 63 * (1 - F.exp(-F.col("all") / 63)))))
    share = F.lit(size.one / size["all"] if size["all"] else 0.0)
    z = (F.col("one") - F.col("all") * share) / F.sqrt(F.col("all") * share * (1 - share) + 1e-9)
    best = found.withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word") \
        .limit(max(LEXICON_WORDS, FEATURES)).collect()
    return {bytes(r.word): (r.one, r["all"]) for r in best}, float(size.one), float(size["all"])


def _with_votes(rows: DataFrame, voters: Voters, *keep: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(voters)
    kept = rows.select(*keep, "text")
    fields = kept.select(*keep).schema.fields

    def run(found: Iterator[pa.RecordBatch]):
        lean_worker()
        model = shared.value
        for batch in found:
            masks = [model.votes(t) for t in texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([m[0] for m in masks], pa.int64()),
                 pa.array([m[1] for m in masks], pa.int64())], names=[*keep, "yes", "no"])

    sql = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fields)
    return kept.mapInArrow(run, sql + "yes long, no long")


def fit_label_model(patterns: DataFrame, start: LabelModel, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over (yes, no, n): every round sums expected counts in the tasks."""
    model = start
    for k in range(rounds):
        shared = patterns.sparkSession.sparkContext.broadcast(model)

        def expect(found: Iterator[pa.RecordBatch], shared=shared):
            total = 0
            for batch in found:
                yes, no, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                total = total + shared.value.sums(vote_array(yes, no), n.astype(float))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

        found = patterns.select("yes", "no", "n").mapInArrow(expect, "i int, x double") \
            .groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # as many rows as the model has numbers
        if not found.num_rows:
            return model
        sums = np.zeros(found.num_rows)
        sums[found.column("i").to_numpy()] = found.column("x").to_numpy()
        model = LabelModel.from_sums(sums, weigh=k > 0)
    return model


@dataclass
class Classifier:
    weights: dict[bytes, float]
    intercept: float

    def score(self, text: str) -> float:
        logit = self.intercept + sum(map(self.weights.__getitem__, self.weights.keys() & words(text)))
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def _fit_logistic(rows: list[tuple[list[int], float]], n_features: int, rounds: int = 1500,
                  l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Full-batch gradient steps with per-weight step sizes (AdaGrad)."""
    w, seen = np.zeros(n_features + 1), np.full(n_features + 1, 1e-8)
    y = np.array([p for _, p in rows])
    at = np.repeat(np.arange(len(rows)), [len(f) + 1 for f, _ in rows])
    on = np.array([i for f, _ in rows for i in (*f, n_features)], np.int64)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[on], len(rows)), -40, 40)))
        g = np.bincount(on, (p - y)[at], n_features + 1) / len(rows) + l2 * np.append(w[:-1], 0)
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The three steps above, from documents (doc_id, text) and labels
    (doc_id, toxic); held-out rows are left out by id."""
    d = docs.select(*id_and_text(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("toxic").cast("int").alias("toxic")) \
        .filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()) \
        .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    chosen = stage(_sample(known, LABELLED_ROWS), "chosen")
    labelled = _unlike_rows(d.join(F.broadcast(chosen), "doc_id"))
    counts, toxic, n = _word_counts(labelled.select("text", "y"), LEAST_DOCS)
    share = (toxic + 0.5) / (n + 1)
    over = sorted((w for w, (a, b) in counts.items() if a / b > max(0.5, 2 * share)),
                  key=lambda w: (-counts[w][0], w))[:LEXICON_WORDS]
    voters = Voters({w: i for i, w in enumerate(over)})
    if not over:
        return Classifier({}, float(np.log(share / (1 - share))))

    first = _with_votes(labelled, voters, "y").groupBy("y", "yes", "no").agg(F.count("*").alias("n"))
    by_class = stage(first, "labelled-votes")
    counts = _vote_counts(by_class)
    start = LabelModel((counts + 0.5) / (counts.sum(2, keepdims=True) + 1.5), share)
    patterns = stage(_with_votes(d.filter(~held_out()), voters).groupBy("yes", "no").agg(F.count("*").alias("n")), "votes")
    model = fit_label_model(patterns, start)
    model.scale = _scale(model, by_class)

    free = d.filter("doc_id is not null").filter(~held_out())
    ids = stage(_sample(free.select("doc_id"), TRAIN_ROWS).distinct(), "train-ids")
    soft = _posterior(_unlike_rows(free.join(F.broadcast(ids), "doc_id")), voters, model)
    counts, _, _ = _word_counts(soft, LEAST_DOCS)
    features = sorted(counts)[:FEATURES]
    place = {w: i for i, w in enumerate(features)}
    held = _feature_rows(soft, place).collect()  # TRAIN_ROWS rows of chosen words at most
    weights, intercept = _fit_logistic([(r.on, r.y) for r in held], len(features))
    return Classifier(dict(zip(features, weights.tolist(), strict=True)), intercept)


def _vote_counts(by_class: DataFrame) -> np.ndarray:
    """Labelled rows by class, voter and vote."""
    def count(found: Iterator[pa.RecordBatch]):
        total = np.zeros((2, N_VOTERS, 3))
        for batch in found:
            y, yes, no, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            hot = np.eye(3)[vote_array(yes, no)] * n[:, None, None]
            for k in range(2):
                total[k] += hot[y == k].sum(0)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                         names=["i", "x"])

    found = by_class.select("y", "yes", "no", "n").mapInArrow(count, "i int, x double") \
        .groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    counts = np.zeros(2 * N_VOTERS * 3)
    counts[found.column("i").to_numpy()] = found.column("x").to_numpy()
    return counts.reshape(2, N_VOTERS, 3)


def _scale(model: LabelModel, by_class: DataFrame) -> tuple[float, float]:
    """Slope and intercept that put the evidence on the scale of the labelled
    rows (at most LABELLED_ROWS of them)."""
    rows = by_class.toArrow()
    y, yes, no, n = (rows.column(c).to_numpy() for c in ("y", "yes", "no", "n"))
    x = model.evidence(vote_array(yes, no))
    a, b, seen = 1.0, 0.0, np.full(2, 1e-8)
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([((p - y) * n * x).sum(), ((p - y) * n).sum()]) / n.sum()
        seen += g * g
        a, b = np.array([a, b]) - 0.3 * g / np.sqrt(seen)
    return float(max(a, 0.05)), float(b)


def _posterior(rows: DataFrame, voters: Voters, model: LabelModel) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((voters, model))

    def run(found: Iterator[pa.RecordBatch]):
        lean_worker()
        v, m = shared.value
        for batch in found:
            if batch.num_rows:
                masks = np.array([v.votes(t) for t in texts(batch.column(0))], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(m.posterior(vote_array(masks[:, 0], masks[:, 1])))],
                    names=["text", "y"])

    return stage(rows.select("text").mapInArrow(run, "text string, y double"), "posterior")


def _feature_rows(rows: DataFrame, place: dict[bytes, int]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(place)
    schema = pa.schema([("on", pa.list_(pa.int32())), ("y", pa.float64())])

    def run(found: Iterator[pa.RecordBatch]):
        lean_worker()
        known = shared.value
        for batch in found:
            on = [[known[w] for w in known.keys() & words(t)] for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(on, schema.field(0).type), batch.column(1)],
                                             schema=schema)

    return rows.select("text", "y").mapInArrow(run, "on array<int>, y double")


def with_score(docs: DataFrame, classifier: Classifier, text_col: str = "text",
               out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    place = docs.columns.index(text_col)
    names = [f"_{i}" for i in range(len(docs.columns))]  # names may repeat
    plain = docs.toDF(*names)
    sql = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def run(found: Iterator[pa.RecordBatch]):
        lean_worker()
        model = shared.value
        for batch in found:
            scores = [model.score(t) for t in texts(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=[*names, "score"])

    return plain.mapInArrow(run, f"{sql}, score double").toDF(*docs.columns, out)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    classifier = train(docs, documents(spark, sf_dir, "labels"))
    return with_score(docs.select(*id_and_text(docs)), classifier).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
