"""Toxicity: maximum-scoring segments over token log-odds.

Learning. Units are whole words and word beginnings of 3 to 7 letters. The log-odds of
a unit between toxic and other labelled documents use an informative Dirichlet prior,
proportional to the unit's document frequency in all documents. Copies are no evidence:
a unit counts in toxic documents as often as it has different neighbours there, which
counting in bitmaps of several sampling rates estimates at any number. Log-odds are
shrunk towards 0 by ``DEVIATIONS`` standard deviations. A unit keeps its shrunk log-odds
if they exceed ``LEAST_ODDS`` and its likelihood ratio exceeds what the best of as many
chance units would reach; those of all others are taken as 0. A word beginning goes
where a longer unit that has it scores higher, and only whole words speak against
toxicity. A word scores what its best unit scores, or its negative log-odds, or 0; in
the two last cases a small cost is taken off, so that segments end.

Scoring. One linear scan finds all maximal-scoring segments of a text. A segment of
score S in a text of n words is expected K n exp(-lambda S) times by chance (lambda is
solved from the words of documents labelled as not toxic); segments that chance hardly
explains are significant, and the sum of their evidence, calibrated by a logistic fit
on the training rows, is the document's score.

Bounds, whatever the data: at most ``TRAIN_ROWS`` labelled rows (a sample by hash of
the id) are learned from. All their units are counted and tested in Spark; only those
that pass the likelihood ratio reach the driver. The prior's counts cover all documents.
All documents are read twice: for the prior and for their scores.

Defined results: a null, empty or wordless text has no evidence and the score of that;
repeated rows score alike; several labels of one id count as toxic if any is; without
a toxic and an other training row every score is 0; an empty table gives an empty
result; other columns do not matter. Texts are scanned one at a time in linear time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

TRAIN_ROWS = 400_000
MIN_DOCUMENTS = 2
PRIOR = 0.01
DEVIATIONS = 2.0
#: The least log-odds that mark a toxic unit: twice as frequent.
LEAST_ODDS = math.log(2)
GAP = 20
CHANCE = 0.2
MODULUS = 5
UNIT_LENGTHS = range(3, 8)
#: Contexts are hashed to ``PLACES`` places of one of ``RATES`` bitmaps; each bitmap gets a
#: 32nd of what the one before it gets, so some bitmap is never full (32 ** 5 contexts).
PLACES = 60
RATES = 5
FULL = 54

_WORD = re.compile(r"[^\W\d_]+")
SCORES = "n_words bigint, evidence double, n_passages bigint, spans array<struct<first:int,last:int,score:double>>"
_BITMAP = (1 << PLACES) - 1


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a lower-cased text; what white space separates is mostly one run and needs no search."""
    out: list[str] = []
    for piece in (text or "").lower().split():
        if piece.isalpha():
            out.append(piece)
        else:
            out.extend(_WORD.findall(piece))
    return out


class Remembered(dict):
    """What ``make`` gives for a word, kept for about ``most`` words."""

    def __init__(self, make: Callable[[str], object], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> object:
        if len(self) > self.most:
            self.clear()
        out = self[word] = self.make(word)
        return out


def heads(names: Iterable[str]) -> set[str]:
    """The first three letters of units; a word with another beginning has none of them."""
    return {u.removeprefix("=")[:3] for u in names}


def units(word: str) -> list[str]:
    return ["=" + word, *[word[:k] for k in UNIT_LENGTHS if k <= len(word)]]


def surprise_column(d1: Column, d0: Column, share: float) -> Column:
    """Likelihood ratio statistic of d1 against d0 when the first's share should be ``share``."""
    parts = [F.when(d > 0, d * F.log(d / ((d1 + d0) * p))).otherwise(F.lit(0.0)) for d, p in ((d1, share), (d0, 1 - share))]
    return 2 * (parts[0] + parts[1])


def without_explained(scores: dict[str, float]) -> dict[str, float]:
    """The units less the beginnings that a longer unit of a higher score explains."""
    longer: dict[str, float] = {}
    for u, score in scores.items():
        word = u.removeprefix("=")
        for k in UNIT_LENGTHS:
            if k < len(word) or (k == len(word) and u != word):
                longer[word[:k]] = max(longer.get(word[:k], 0.0), score)
    return {u: score for u, score in scores.items() if score >= longer.get(u, 0.0)}


def context_place(before: str, after: str) -> int:
    """The bit of a context: its place in the bitmap of its rate."""
    h = xxhash.xxh64_intdigest(f"{before} {after}")
    low, rate = h >> 32, 0
    while rate < RATES - 1 and not low & 31:
        low, rate = low >> 5, rate + 1
    return 1 << (rate * PLACES + (h & 0xFFFFFFFF) % PLACES)


def word_places(words: list[str]) -> dict[str, int]:
    """For each word of a text the hashed places of its contexts (the words around it), as bits."""
    own: dict[str, int] = {}
    for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        own[w] = own.get(w, 0) | context_place(before, after)
    return own


def context_places(words: list[str]) -> dict[str, int]:
    """The same for each unit of a text."""
    out: dict[str, int] = {}
    for w, bits in word_places(words).items():
        for u in units(w):
            out[u] = out.get(u, 0) | bits
    return out


def contexts_column(used: list[Column]) -> Column:
    """Number of different contexts from the bits set in each bitmap: linear counting in the first that is not full."""
    count = lambda u, rate: -PLACES * F.log(1 - F.least(u, F.lit(PLACES - 1)) / PLACES) * (32.0**rate * 32 / 31)
    out = F.when(used[0] < FULL, count(used[0], 0))
    for rate in range(1, RATES):
        out = out.when(used[rate] < FULL, count(used[rate], rate))
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, after last, score) of a sequence, in one scan."""
    # first, after last, sum before, sum after, nearest earlier entry with a smaller sum before
    found: list[tuple[int, int, float, float, int]] = []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for i in np.flatnonzero(scores > 0).tolist():
        first, before, after = i, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((first, i + 1, before, after, j))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, y - x) for a, b, x, y, _ in found]


@dataclass
class Model:
    """Scores by unit, the cost of other words, and the extreme-value constants."""

    scores: dict[str, float]
    cost: float
    rate: float
    base: float
    intercept: float = -50.0
    slope: float = 0.0

    def known(self) -> Remembered:
        """The scores of words, made when a word is first met."""
        get, cost, there = self.scores.get, -self.cost, heads(self.scores)

        def score(word: str) -> float:
            if word[:3] not in there:
                return cost
            best = max(get(u, 0.0) for u in units(word))
            return best if best > 0 else cost + min(get("=" + word, 0.0), 0.0)

        return Remembered(score, 500_000)

    def passages(self, text: str | None, known: Remembered) -> tuple[int, float, list[tuple[int, int, float]]]:
        """Number of words, summed evidence and the significant segments of a text."""
        words = words_of(text)
        if not words or not self.scores:
            return len(words), 0.0, []
        log_space = math.log(self.base * len(words) + 1e-12)
        found = [(a, b, s) for a, b, s in maximal_segments(np.fromiter(map(known.__getitem__, words), np.float64, len(words))) if self.rate * s - log_space >= -math.log(CHANCE)]
        return len(words), sum(self.rate * s - log_space for _, _, s in found), found


def training_rows(labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and labels of the training rows: a sample by hash of at most about ``bound``."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    got = sorted((r.doc_id, r.toxic) for r in rows.collect())
    return np.array([d for d, _ in got], np.int64), np.array([t for _, t in got], np.int8)


def labelled_texts(docs: DataFrame, labels: DataFrame, work: Scratch) -> tuple[DataFrame, int, bool]:
    """toxic and text of the training rows, as a written table; their number; whether both labels occur."""
    ids, toxic = training_rows(labels)
    known = docs.sparkSession.createDataFrame(pa.table({"known_id": ids, "toxic": toxic.astype(np.int32)}))
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))  # at most TRAIN_ROWS rows of two numbers
    return work.stored(rows.select("toxic", "text"), "toxicity-labelled"), len(ids), bool(len(ids)) and toxic.min() != toxic.max()


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents (columns doc_id, text; doc_id, toxic)."""
    work = Scratch(docs.sparkSession)
    labelled, n, both = labelled_texts(docs, labels, work)
    model = _lexicon(docs, labelled, n, work) if both else Model({}, 1.0, 1.0, 1.0)
    if model.scores:
        model.rate, model.base = _chance(labelled.where("toxic = 0").select("text"), model)
        model = calibrate(model, labelled)
    work.drop(*[t for t, _ in work.paths])
    return model


def _lexicon(docs: DataFrame, labelled: DataFrame, n_rows: int, work: Scratch) -> Model:
    """Units with their shrunk log-odds, and the cost of other words."""
    spark, empty = docs.sparkSession, Model({}, 1.0, 1.0, 1.0)
    n_documents = docs.count()
    bitmaps = [f"places{k}" for k in range(RATES)]

    def labelled_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Units have numbers in the order of their first occurrence; "" has the distinct words of the documents.
        number, of_word = {"": 0}, {}
        counts, last = np.zeros((2, 1 << 16), np.int64), np.zeros(1 << 16, np.int64)  # documents by unit: not toxic, toxic
        places: dict[int, int] = {}

        def rows() -> pa.RecordBatch:
            n, at = len(number), np.fromiter(places, np.int64, len(places))
            columns = [counts[0, :n], counts[1, :n], *np.zeros((RATES, n), np.int64)]
            for k in range(RATES):
                columns[2 + k][at] = [bits >> k * PLACES & _BITMAP for bits in places.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["unit", "d0", "d1", *bitmaps])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = words_of(text.as_py())
                words = set(text)
                for w in words.difference(of_word):
                    of_word[w] = [number.setdefault(u, len(number)) for u in units(w)]
                if len(number) > len(last):
                    more = 2 * len(number) - len(last)
                    counts, last = np.pad(counts, ((0, 0), (0, more))), np.pad(last, (0, more))
                at = np.fromiter(chain.from_iterable(map(of_word.__getitem__, words)), np.int64)
                nth = np.arange(len(at))
                last[at] = nth
                counts[label, at[last[at] == nth]] += 1  # each unit once a document
                counts[label, 0] += len(words)
                if label:
                    for w, bits in word_places(text).items():
                        for i in of_word[w]:
                            places[i] = places.get(i, 0) | bits
                if len(number) > 500_000:
                    yield rows()
                    number, of_word, places = {"": 0}, {}, {}
                    counts[:] = 0
        yield rows()

    made = labelled.mapInArrow(labelled_units, "unit string, d0 bigint, d1 bigint, " + ", ".join(f"{b} bigint" for b in bitmaps))
    seen = made.groupBy("unit").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), *[F.bit_or(b).alias(b) for b in bitmaps])
    own = F.when(F.col("unit") == "", F.col("d1").cast("double")).otherwise(F.least(F.col("d1").cast("double"), contexts_column([F.bit_count(b) for b in bitmaps])))
    counted_units = work.stored(seen.select("unit", F.col("d0").cast("double").alias("d0"), own.alias("d1")).where((F.col("unit") == "") | (F.col("d1") >= MIN_DOCUMENTS) | ((F.col("d0") >= MIN_DOCUMENTS) & F.startswith("unit", F.lit("=")))), "toxicity-units")
    totals = counted_units.where("unit = ''").first()
    size = counted_units.where("unit != ''").agg(F.count("*").alias("n"), F.count_if(F.col("d1") >= MIN_DOCUMENTS).alias("n1")).first()
    if totals is None or not size.n1 or not totals.d0 or not totals.d1:
        return empty
    n0, n1 = totals.d0, totals.d1
    share = n1 / (n0 + n1)
    # The likelihood ratio needs labelled rows only, so every unit is tested where it is counted.
    surprise, more = surprise_column(F.col("d1"), F.col("d0"), share), F.col("d1") > share * (F.col("d1") + F.col("d0"))
    passes = F.when(more, (F.col("d1") >= MIN_DOCUMENTS) & (surprise > 2 * math.log(size.n1 + 1))).otherwise(F.startswith("unit", F.lit("=")) & (surprise > 2 * math.log(size.n + 1)))
    told = counted_units.where((F.col("unit") != "") & passes).orderBy("unit").collect()
    if not told:
        return empty
    names, d0, d1 = [r.unit for r in told], np.array([r.d0 for r in told]), np.array([r.d1 for r in told])
    candidates = spark.sparkContext.broadcast({u: i for i, u in enumerate(names)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = candidates.value
        counts = np.zeros(len(index) + 1, np.int64)  # last place: distinct words of the documents
        there = heads(index)
        of_word = Remembered(lambda w: [i for u in units(w) if (i := index.get(u)) is not None] if w[:3] in there else (), 300_000)
        for batch in batches:
            for x in batch.column(0):
                words = set(words_of(x.as_py()))
                own = set(chain.from_iterable(filter(None, map(of_word.__getitem__, words))))
                counts[np.fromiter(own, np.int64, len(own))] += 1
                counts[-1] += len(words)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(counts[full], pa.int64())], names=["i", "d"])

    sums = docs.select("text").mapInArrow(counted, "i bigint, d bigint").groupBy("i").agg(F.sum("d").alias("d")).toPandas()
    all_counts = np.zeros(len(names) + 1)
    all_counts[sums["i"].to_numpy()] = sums["d"].to_numpy()
    d = all_counts[:-1]
    documents = max(5.0, PRIOR * n_rows)
    prior = documents * (d + 0.5) / (n_documents + 1)
    strength = documents * all_counts[-1] / max(n_documents, 1)
    odds = np.log((d1 + prior) / (n1 + strength)) - np.log((d0 + prior) / (n0 + strength))
    spread = DEVIATIONS * np.sqrt(1 / (d1 + prior) + 1 / (d0 + prior))
    toxic = without_explained({names[i]: float(odds[i] - spread[i]) for i in np.flatnonzero(odds - spread > LEAST_ODDS)})
    if not toxic:
        return empty
    other = {names[i]: float(odds[i] + spread[i]) for i in np.flatnonzero(odds + spread < -LEAST_ODDS) if names[i].startswith("=")}
    cost = float(np.median(list(toxic.values()))) / GAP
    return Model({**other, **toxic}, cost, 1.0, 1.0)


def _chance(texts: DataFrame, model: Model) -> tuple[float, float]:
    """lambda and K from the scores of words in documents labelled as not toxic.

    lambda solves E[exp(lambda s)] = 1; K is the usual bound's share of words that
    start a positive run. Scores are rounded to hundredths, so few rows come back.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vars(model))  # plain values: a task builds the model anew

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words, counts = Model(**shared.value).known(), Counter(), Counter()

        def settle() -> None:
            scores = np.round(np.fromiter(map(known.__getitem__, words), np.float64, len(words)), 2)
            for s, n in zip(scores.tolist(), words.values(), strict=True):
                counts[s] += n
            words.clear()

        for batch in batches:
            for x in batch.column(0):
                words.update(words_of(x.as_py()))
                if len(words) > 500_000:
                    settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], names=["s", "n"])

    rows = texts.mapInArrow(histogram, "s double, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
    n = sum(r.n for r in rows) + 1.0
    typical = float(np.median([s for s in model.scores.values() if s > 0]))
    chance = [(r.s, r.n / n) for r in rows] + [(typical, 0.5 / n)]
    low, high = 1e-6, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        grows = sum(p * math.exp(min(700.0, middle * s)) for s, p in chance) > 1
        low, high = (low, middle) if grows else (middle, high)
    return low, max(sum(p for s, p in chance if s > 0), 1.0 / n)


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """The columns of ``rows`` but for the last, the text; n_words, evidence, n_passages and spans (word places) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))  # plain values: a task builds the model anew
    kept = rows.columns[:-1]
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        known = own.known()
        for batch in batches:
            made = [own.passages(x.as_py(), known) for x in batch.columns[-1]]
            spans = [[{"first": a, "last": b, "score": s} for a, b, s in r[2]] for r in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r[0] for r in made], pa.int64()), pa.array([r[1] for r in made], pa.float64()), pa.array([len(r[2]) for r in made], pa.int64()), pa.array(spans, span)], names=[*kept, "n_words", "evidence", "n_passages", "spans"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(SCORES).fields]))


def calibrate(model: Model, labelled: DataFrame) -> Model:
    """Logistic fit of the label on evidence, from its histogram over training rows."""
    x = F.round(F.log1p(F.greatest(F.col("evidence"), F.lit(0.0))), 2)
    rows = evidence(labelled, model).groupBy(x.alias("x"), "toxic").agg(F.count("*").alias("n")).collect()
    x, y, n = (np.array([r[k] for r in rows], float) for k in ("x", "toxic", "n"))
    # One observation of each kind at the ends keeps the fit finite.
    x, y, n = np.append(x, [0.0, 5.0]), np.append(y, [0.0, 1.0]), np.append(n, [1.0, 1.0])
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 1e-2])
        w = w + np.clip(np.linalg.solve(hessian, design.T @ (n * (y - p)) - np.array([1e-6, 1e-2]) * w), -2, 2)
    model.intercept, model.slope = float(w[0]), float(max(w[1], 0.0))
    return model


def score_of(model: Model) -> Column:
    return 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.log1p(F.greatest(F.col("evidence"), F.lit(0.0))))))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, n_passages and spans of every row."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = learn(own, labels)
    score = score_of(model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS == 0, F.lit(False))
    return evidence(own, model).select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_words", "n_passages", "spans")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows predicted to be toxic go, whatever their id; rows pass the scan with all their columns."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(own, table(spark, sf_dir, "labels"))
    kept = docs.select(*[F.col(c).alias(f"carried_{i}") for i, c in enumerate(docs.columns)], F.col("text").cast("string").alias("scanned"))
    return evidence(kept, model).where(score_of(model) < 0.5).select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)])
