"""Quality classifier: a weak-label model trains a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation
estimates the share of good texts and every labeller's vote rates in either class
from the counts of vote patterns alone (3 to the power of the labellers at most,
whatever the data). The posterior of a text's pattern is its weak label; a logistic
scorer on hashed word shapes and repetitions is fitted to the weak labels of a sample
of at most about ``TRAIN_ROWS`` texts and scores every text. No true label is used.

The pipeline stage carries its rows through the labelling pass into the written table of
features, so the verdict meets the row without a join or a shuffle.

Defined results: a null, empty or wordless text has score 0 and is rejected; repeated
rows score alike; if no pattern has a bad vote, nothing with words is rejected; an
empty table gives an empty result; other columns do not matter, and a text's length
matters to its own row only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

TRAIN_ROWS = 20_000
BUCKETS = 1024
ROUNDS = 200
KEEP_AT = 0.5
#: Prior vote rates (bad, good, nothing) of a labeller on bad and on good texts, and the share of
#: all texts that the priors weigh. Labellers are made to be precise, so the prior says so; the
#: data may still overrule it.
PRIOR_RATES = ((0.3, 0.5, 0.2), (0.001, 0.85, 0.149))
PRIOR_SHARE = 0.1

BAD, GOOD, ABSTAIN = 0, 1, 2
#: (name, bad above, good at most): shares of words, or of lines for the last.
LABELLERS = (
    ("symbols", 0.15, 0.02),
    ("symbol_ends", 0.15, 0.02),
    ("shouting", 0.25, 0.05),
    ("exclamations", 0.15, 0.03),
    ("separators", 0.15, 0.02),
    ("same_word_again", 0.15, 0.03),
    ("same_pair_again", 0.60, 0.30),
    ("odd_length", 0.30, 0.15),
    ("lines_again", 0.30, 0.10),
)

SYMBOL_ENDS = "#*$%&<>^~@=|"
_RUNS = re.compile(r"(.)\1+")
_SYMBOLS = re.compile(r"[#*$%&<>^~@=\\{}\[\]]")
#: The feature columns; their names are kept free of those of documents.
FEATURES = pa.schema([("n_words__", pa.int64()), ("pattern__", pa.int32()), ("buckets__", pa.list_(pa.int32())), ("shares__", pa.list_(pa.float32()))])


def shape(word: str) -> str:
    """A word with its letters and digits reduced to their kinds, runs made single."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", kinds)


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % BUCKETS


class Reader:
    """Votes and hashed features of a text; remembers the words it meets."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}
        self.again, self.pair_again, self.line_again = (_bucket(x) for x in ("\0again", "\0pair", "\0line"))

    def word(self, w: str) -> tuple[int, int]:
        """(flags, bucket): 1 symbols, 2 shouting, 4 exclamation, 8 separator, 16 odd length, 32 symbol at the end."""
        letters = sum(c.isalpha() for c in w)
        flags = (len(_SYMBOLS.findall(w)) >= 2) | 2 * (letters >= 2 and w.upper() == w and w.lower() != w) | 4 * ("!!" in w) | 8 * (w in ("|", "»", "•", "·", "/", ">", "-")) | 16 * (letters > 24 or letters == 0) | 32 * (letters > 0 and w[-1] in SYMBOL_ENDS)
        return int(flags), _bucket(shape(w))

    def __call__(self, text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Number of words, vote pattern, buckets and their shares."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return 0, sum(ABSTAIN * 3**i for i in range(len(LABELLERS))), np.empty(0, np.int32), np.empty(0, np.float32)
        if len(self.known) > 500_000:
            self.known.clear()
        counts, known = Counter(words), self.known
        flags, buckets = [0] * 6, Counter()
        for w, k in counts.items():
            if w not in known:
                known[w] = self.word(w)
            f, b = known[w]
            buckets[b] += k
            for i in range(6):
                if f >> i & 1:
                    flags[i] += k
        again = sum(map(str.__eq__, words, words[1:]))
        pairs = max(n - 1, 1)
        pair_again = n - 1 - len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        lines_again = len(lines) - len(set(lines))
        # Common pairs recur in long texts, so a fixed share of them says little there.
        shares = (flags[0] / n, flags[5] / n, flags[1] / n, flags[2] / n, flags[3] / n, again / pairs, pair_again / pairs, flags[4] / n, lines_again / max(len(lines), 1))
        votes = [BAD if s > bad else GOOD if s <= good else ABSTAIN for s, (_, bad, good) in zip(shares, LABELLERS, strict=True)]
        for b, v in ((self.again, again / pairs), (self.pair_again, pair_again / pairs), (self.line_again, lines_again / max(len(lines), 1))):
            buckets[b] += v * n
        return n, sum(v * 3**i for i, v in enumerate(votes)), np.fromiter(buckets, np.int32, len(buckets)), np.sqrt(np.fromiter(buckets.values(), np.float32, len(buckets)) / n)


def features(docs: DataFrame, kept: list[str], text: str) -> DataFrame:
    """The columns ``kept`` with the number of words, vote pattern, buckets and shares of each text."""
    rows = docs.select(*kept, F.col(text).cast("string").alias("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            columns = list(zip(*(reader(x.as_py()) for x in batch.columns[-1]), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, FEATURES.types, strict=True))], names=[*kept, *FEATURES.names])

    schema = T.StructType([*docs.select(*kept).schema.fields, *T.StructType.fromDDL("n_words__ bigint, pattern__ int, buckets__ array<int>, shares__ array<float>").fields])
    return rows.mapInArrow(run, schema)


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 for i in range(len(LABELLERS))]


def fit_labellers(patterns: list[int], counts: list[int], rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good texts, vote rates [class, labeller, vote], posterior of good by pattern."""
    votes = np.array([votes_of(p) for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))
    n = np.array(counts, float)
    seen = np.stack([votes == v for v in (BAD, GOOD, ABSTAIN)], axis=2).astype(float)
    prior, strength = np.array(PRIOR_RATES)[:, None, :], PRIOR_SHARE * n.sum() + 1.0
    good, rates = 0.85, np.repeat(prior, len(LABELLERS), axis=1)
    posterior = np.full(len(patterns), good)
    for _ in range(rounds):
        before = good
        logs = [np.log(p) + (seen * np.log(r)).sum(axis=(1, 2)) for p, r in ((1 - good, rates[0]), (good, rates[1]))]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        good = float(((n * posterior).sum() + 0.85) / (n.sum() + 1))
        for k, weight in enumerate((n * (1 - posterior), n * posterior)):
            rates[k] = (np.einsum("p,plv->lv", weight, seen) + strength * prior[k]) / (weight.sum() + strength)
        if abs(good - before) < 1e-12:
            break
    return good, rates, posterior


def fit_scorer(buckets: list[np.ndarray], shares: list[np.ndarray], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights by bucket and an intercept: logistic regression by accelerated gradient steps."""
    at = np.concatenate([np.asarray(b, np.int64) for b in buckets])
    x = np.concatenate([np.asarray(s, float) for s in shares])
    row = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    weight = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-3), 0.5 / max((target < 0.5).mean(), 1e-3))
    w, ahead, step, m = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 1.0, len(buckets)
    for k in range(rounds):
        z = np.bincount(row, x * ahead[at], m) + ahead[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        gradient = np.append(np.bincount(at, error[row] * x, BUCKETS), error.sum()) / m + 1e-5 * ahead
        new = ahead - step * gradient
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def scored(docs: DataFrame, names: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns ``names`` with n_words__, weak__ (posterior of good), score__ and kept__ of every row; ``doc_id``, where there, helps to draw the sample."""
    spark = docs.sparkSession
    read = stored(features(docs, names, text), "quality-features")
    counts = {r.pattern__: r.n for r in read.where("n_words__ > 0").groupBy("pattern__").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return read.select(*names, "n_words__", F.lit(0.0).alias("weak__"), F.lit(0.0).alias("score__"), F.lit(False).alias("kept__"))
    patterns = sorted(counts)
    _, _, posterior = fit_labellers(patterns, [counts[p] for p in patterns])
    weak = spark.createDataFrame(list(zip(patterns, map(float, posterior), strict=True)), "pattern__ int, weak__ double")
    joined = read.join(F.broadcast(weak), "pattern__", "left")  # a row for each pattern: 3 ** 9 at most
    share = min(1.0, TRAIN_ROWS / sum(counts.values()))
    drawn = F.pmod(F.xxhash64("buckets__", "shares__", *[c for c in (doc_id,) if c in names]), F.lit(1 << 30)) <= int(share * (1 << 30))
    sample = joined.where((F.col("n_words__") > 0) & drawn).select("buckets__", "shares__", "weak__").toPandas()
    target = sample["weak__"].to_numpy()
    if len(sample) and target.min() < 0.5 <= target.max():
        weights = fit_scorer(list(sample["buckets__"]), list(sample["shares__"]), target)
    else:
        weights = np.append(np.zeros(BUCKETS), 50.0 if not len(sample) or target.max() >= 0.5 else -50.0)
    by_bucket = F.lit(weights[:-1].tolist())
    z = F.aggregate(F.zip_with("buckets__", "shares__", lambda b, s: F.get(by_bucket, b) * s), F.lit(float(weights[-1])), lambda a, v: a + v)
    score = F.when(F.col("n_words__") > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))
    return joined.select(*names, "n_words__", F.coalesce("weak__", F.lit(0.0)).alias("weak__"), score.alias("score__"), (score >= KEEP_AT).alias("kept__"))


def classified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, weak (posterior of good), score and kept of every row."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return scored(own, ["doc_id"]).select("doc_id", *[F.col(f"{c}__").alias(c) for c in ("n_words", "weak", "score", "kept")])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"))


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected rows go, whatever their id."""
    carried = {c: f"carried_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(c).alias(n) for c, n in carried.items()], F.col("text").cast("string").alias("scanned"))
    kept = scored(own, list(carried.values()), "scanned", carried.get("doc_id", "doc_id")).where("kept__")
    return kept.select(*[F.col(n).alias(c) for c, n in carried.items()])
