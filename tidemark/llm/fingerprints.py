"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint is the ``k`` smallest distinct 64-bit hashes of a text's five-word
shingles, so sketches of parts merge into the sketch of the whole, and two sketches
give resemblance, containment and distinct shingle counts.

Estimates have a standard error of about 1 / (2 sqrt(k)) at most, 0.06 for k = 64.

Neighbours in doc_id order are found without gathering the table: quantiles of the
ids cut the order into ranges and each range into equal steps, so many that a bucket
has about ``ROWS_PER_BUCKET`` rows at any size; an id that fills whole quantiles (rows
without an id, say) is cut by the digest of its texts instead. A bucket's first document
is also sent to the bucket before it, so every document meets its successor inside its
own bucket.

Defined results: a null or wordless text has the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another 0; a text of one to four words is
one shingle; repeated ids follow one another by the hash of their text; a null id
sorts first; a single document is its own successor; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

K = 64
WORDS = 5
RANGES = 256
ROWS_PER_BUCKET = 1024
#: Beyond so many buckets their first rows (three numbers each) are joined by a shuffle.
BROADCAST_BUCKETS = 200_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of the text's shingles, repeats included; empty without words."""
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def hashed(w: Column) -> Column:
        spans = F.sequence(F.lit(1), F.size(w) - (words - 1))
        return F.when(F.size(w) >= words, F.transform(spans, lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(words)]))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(w), hashed), 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of a whole from the sketches of two parts."""
    return bottom_k(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: shared hashes among the k smallest of the union."""
    low = merge(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(F.array_intersect(low, a), b)) / F.size(low))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), " ")


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, sketch (array of hashes) and distinct (estimated shingle count)."""
    out = docs.select(F.col(doc_id).alias("doc_id"), bottom_k(shingle_hashes(F.col(text)), k).alias("sketch"))
    return out.withColumn("distinct", distinct_shingles(F.col("sketch"), k))


def corpus_fingerprint(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One sketch for each group of ``by``, merged from its documents' sketches.

    Each document gives at most k hashes; a group's are numbered in slices by hash
    before the k smallest meet, so no task gathers a group.
    """
    rows = sketches.select(*by, F.explode("sketch").alias("hash")).distinct().withColumn("slice", F.pmod(F.xxhash64("hash"), F.lit(64)))
    low = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by, "slice").orderBy("hash"))).where(F.col("n") <= k)
    return low.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).where(F.col("n") <= k).groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def _bucket(ids: DataFrame) -> tuple[Column, Column, int] | None:
    """Range and bucket of a row, both growing with (id, tie), and about how many buckets there are.

    257 quantiles and a count go to the driver, however many rows there are. An id
    that stands in them several times has a range of its own.
    """
    cuts = [i / RANGES for i in range(RANGES + 1)]
    got = ids.agg(F.percentile_approx("id", cuts, 10_000).alias("q"), F.count("*").alias("n")).first()
    if not got.q:
        return None
    times = Counter(got.q)
    hot = {b for b, n in times.items() if n > 2}
    bounds = sorted({*times, *(b + 1 for b in hot if b < 2**63 - 1)})
    steps = max(1, round(got.n / ROWS_PER_BUCKET / RANGES))
    lows = F.array(*[F.lit(b).cast("long") for b in bounds])
    many = F.array(*[F.lit(steps * times[b] if b in hot else steps).cast("long") for b in bounds])
    at = F.greatest(F.size(F.filter(lows, lambda b: b <= F.col("id"))), F.lit(1))
    low, high, n = F.get(lows, at - 1), F.coalesce(F.get(lows, at), F.lit(bounds[-1] + 1).cast("long")), F.get(many, at - 1)
    span = F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    share = F.when(span > 1, (F.col("id").cast("double") - low.cast("double")) / span).otherwise((F.col("tie").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64))
    step = F.least(F.greatest(F.floor(share * n), F.lit(0)), n - 1)
    widest = steps * (max(times.values()) + 1)
    return at, (at * F.lit(widest).cast("long") + step).cast("long"), got.n // ROWS_PER_BUCKET


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, doc_id, text, tie, bucket and guest; guests are successors' copies."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    found = _bucket(rows.select("id"))
    if found is None:
        return rows.withColumns({"bucket": F.lit(0).cast("long"), "guest": F.lit(False)})
    part, bucket, buckets = found
    firsts = rows.select("id", "tie", part.alias("part"), bucket.alias("bucket")).groupBy("part", "bucket").agg(F.min(F.struct("id", "tie")).alias("first"), F.count("*").alias("n"))
    # One row for each range, 513 at most: the last bucket of the range before it, or of all for the first.
    ends = firsts.groupBy("part").agg(F.max("bucket").alias("end"))
    order = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(order), F.max("end").over(Window.partitionBy())).alias("end"))
    within = Window.partitionBy("part").orderBy("bucket")
    firsts = firsts.join(F.broadcast(ends), "part").select(F.col("first.id").alias("id"), F.col("first.tie").alias("tie"), F.coalesce(F.lag("bucket").over(within), "end").alias("back"))
    # Of equal rows that come first in a bucket each is sent back; the one that is met is the same text.
    placed = rows.withColumn("home", bucket).join(F.broadcast(firsts) if buckets <= BROADCAST_BUCKETS else firsts, ["id", "tie"], "left")
    places = F.filter(F.array(F.struct(F.col("home").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("back").alias("bucket"), F.lit(True).alias("guest"))), lambda p: p["bucket"].isNotNull())
    return placed.withColumn("place", F.explode(places)).select("doc_id", "id", "text", "place.bucket", "place.guest", "tie")


def compared_to_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text ends with the first floor(n/4) characters of the next document.
    """
    follow = Window.partitionBy("bucket").orderBy("guest", "id", "tie")
    n = F.col("n_chars")
    paired = with_next(docs, doc_id, text).withColumn("n_chars", F.length("text").cast("long")).withColumn("next_text", F.lead("text").over(follow))
    quarter = F.floor(n / 4).cast("int")
    edited = paired.withColumn("edited", F.when(F.col("guest"), F.lit("")).otherwise(F.concat(F.substr(F.col("text"), F.lit(1), n.cast("int") - quarter), F.substr(F.coalesce("next_text", "text"), F.lit(1), quarter))))
    sketched = edited.select(
        "doc_id", "id", "tie", "bucket", "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), bottom_k(shingle_hashes(F.col("text")), k).alias("sketch"), bottom_k(shingle_hashes(F.col("edited")), k).alias("edited_sketch")
    )
    followed = sketched.withColumn("next_sketch", F.lead("sketch").over(follow)).where(~F.col("guest"))
    return followed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce("next_sketch", "sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_to_edits(table(spark, sf_dir, "documents"))
