"""Benchmark decontamination: a distributed positional inverted index and its phrase searches.

``postings`` stores the positions of training tokens, (term, document, position), sorted by
term inside every shard of documents; building it moves nothing between machines. Terms that
no test item has are left out by a bit table of fixed size (some pass; they join nothing).

``phrase_matches`` takes each distinct window of test words, orders its terms from the rarest
in the index to the most frequent and intersects their lists with the offsets taken off: the
rarest term's postings give the places where a window would start, the next one's keep those
that it confirms, and the rest are asked only there. So frequent terms are read where rare
ones have already met. Windows with a term that the index lacks are dropped first.

``near_matches`` finds windows whose words follow one another in order with at most ``slop``
other words between them: lists of the other terms are met in blocks of positions around the
rarest term, then followed forwards and backwards from it; the span is the least for its place.

A frequent term, passage or document is spread by the joins, whose keys hold the document and
the position; only the rarest term's join goes by term, with no grouping above it, so Spark
splits it where it is skewed. Semi-joins keep rows of equal documents from multiplying.

Defined results: a null or wordless text or item has no words; an item of fewer words than a
window is one window; rows without an id are judged like others; an item without an id marks
words but is not listed; repeated items and rows count once each, equal rows have equal
results; an empty table of documents gives none, one of items leaves all clean; other columns
do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

#: Words of a text whose A-Z count as a-z: runs of digits, a-z and all characters beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Places of a bit table: 512 KB to every executor, whatever the data.
BITS = 1 << 22
DOC = ["id", "tie"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def term(word: Column) -> Column:
    """A word's hash; lower() does no more than is asked where all is ASCII."""
    return F.xxhash64(F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word)))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and the key (id, tie): rows of one key are equal in both."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "tie": F.xxhash64("text", F.col("text").isNull(), F.col("doc_id").isNull())})


def _slot(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS))


def bit_table(rows: DataFrame, *key: str) -> DataFrame:
    """One row with an array of BITS bits in which every key's place is set."""
    by_word = rows.select(_slot(*key).alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    every = rows.sparkSession.range(BITS // 64).select(F.col("id").alias("at")).join(by_word, "at", "left")  # of fixed size
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("_table"))


def passing(rows: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """Rows whose key may be in a bit table; none of those that are is lost."""
    slot = _slot(*key)
    return rows.join(F.broadcast(bits), F.getbit(F.get("_table", F.shiftright(slot, 6).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1, "left_semi")


def postings(docs: DataFrame, terms: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: (term, id, tie, pos), of the terms in ``terms`` or of all."""
    rows = keyed(docs, doc_id, text).select(*DOC, F.posexplode(words(F.col("text"))).alias("pos", "word")).select(term(F.col("word")).alias("term"), *DOC, "pos")
    return (rows if terms is None else passing(rows, bit_table(terms, "term"), "term")).sortWithinPartitions("term")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, wid (the window's digest) and terms of every window of every item."""
    rows = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    each = rows.select("item_id", "w", starts.alias("start")).select("item_id", F.transform(F.slice("w", F.col("start"), F.lit(size)), term).alias("terms"))
    return each.select("item_id", F.sha2(F.to_json("terms"), 256).alias("wid"), "terms")


def by_rarity(found: DataFrame, index: DataFrame) -> DataFrame:
    """wid, len and order (array of (n, off, term), rarest first) of distinct windows that the index has all terms of."""
    listed = found.select("wid", "terms").dropDuplicates(["wid"])
    lists = index.groupBy("term").agg(F.count("*").alias("n"))
    each = listed.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term")).join(lists, "term")
    return each.groupBy("wid", "len").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("order")).where(F.size("order") == F.col("len"))


def phrase_matches(ranked: DataFrame, index: DataFrame, keep: Scratch) -> DataFrame:
    """(id, tie, wid, len, start): every place where a window's words stand one after another."""
    at = lambda k: F.get("order", F.lit(k))
    first = ranked.select("wid", "len", at(0)["term"].alias("term"), at(0)["off"].alias("off"))
    rarest = passing(index, bit_table(first, "term"), "term").join(first, "term").select(*DOC, "wid", "len", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    second = ranked.where("len > 1").select("wid", at(1)["term"].alias("term"), at(1)["off"].alias("off"))
    asked = rarest.where("len > 1").join(second, "wid").withColumn("pos", F.col("start") + F.col("off"))
    confirmed = asked.join(passing(index, bit_table(second, "term"), "term"), [*DOC, "pos", "term"], "left_semi").select(*DOC, "wid", "len", "start").distinct()
    two = keep.stored(confirmed, "decontamination-two")
    others = ranked.where("len > 2").select("wid", F.explode(F.slice("order", 3, F.greatest(F.col("len") - 2, F.lit(1)))).alias("o")).select("wid", "o.off", "o.term")
    open_ = two.where("len > 2").join(others, "wid").withColumn("pos", F.col("start") + F.col("off"))
    there = passing(index, bit_table(two, *DOC), *DOC)
    whole = open_.join(there, [*DOC, "pos", "term"], "left_semi").groupBy(*DOC, "wid", "len", "start").agg(F.count("*").alias("n")).where("n = len - 2").drop("n")
    return rarest.where("len = 1").distinct().unionByName(two.where("len = 2")).unionByName(whole)


def near_matches(ranked: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """(id, tie, wid, start, end): windows' words in order within ``slop`` more words; the least span around each place of the rarest term."""
    reach = F.col("len") + slop
    spots = ranked.select("wid", "len", F.get("order", F.lit(0))["off"].alias("first_off"), F.get("order", F.lit(0))["term"].alias("term"))
    anchors = index.distinct().join(spots, "term").select(*DOC, "wid", "len", "first_off", F.col("pos").alias("anchor"))
    size = F.lit(WINDOW + slop)
    others = ranked.select("wid", F.explode("order").alias("o")).select("wid", "o.off", "o.term")
    asked = anchors.join(others, "wid").where("off != first_off")
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor((F.col("anchor") - reach) / size), F.floor((F.col("anchor") + reach) / size))))
    blocked = index.distinct().withColumn("block", F.floor(F.col("pos") / size))
    met = asked.join(blocked, [*DOC, "term", "block"]).where(F.abs(F.col("pos") - F.col("anchor")) <= reach)
    lists = met.groupBy(*DOC, "wid", "len", "anchor", "first_off").agg(F.sort_array(F.collect_list(F.struct("pos", "off"))).alias("q"))
    alone = anchors.where("len = 1").select(*DOC, "wid", F.col("anchor").alias("start"), (F.col("anchor") + 1).alias("end"))

    def follow(rows: Column, step: int) -> Column:
        """(off, pos) of the last word reached from the rarest one, each next one the nearest."""
        here = F.struct(F.col("first_off").cast("int").alias("off"), F.col("anchor").cast("int").alias("pos"))
        goes = lambda a, x: F.when((x["off"] == a["off"] + step) & ((x["pos"] - a["pos"]) * step > 0), F.struct(x["off"].alias("off"), x["pos"].alias("pos"))).otherwise(a)
        return F.aggregate(rows, here, goes)

    ends = lists.withColumns({"up": follow(F.col("q"), 1), "down": follow(F.reverse("q"), -1)})
    ends = ends.where((F.col("up.off") == F.col("len") - 1) & (F.col("down.off") == 0) & (F.col("up.pos") - F.col("down.pos") <= F.col("len") - 1 + slop))
    return ends.select(*DOC, "wid", F.col("down.pos").alias("start"), (F.col("up.pos") + 1).alias("end")).unionByName(alone).distinct()


def hits(matches: DataFrame) -> DataFrame:
    """(id, tie, n_hit): words inside any match, each counted once."""
    spans = matches.groupBy(*DOC, "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    return spans.select(*DOC, fresh.alias("fresh")).groupBy(*DOC).agg(F.sum("fresh").cast("long").alias("n_hit"))


def items_found(matches: DataFrame, found: DataFrame) -> DataFrame:
    """(id, tie, n_items, items): distinct items with a match, as sorted strings."""
    of = found.where("item_id is not null").select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    each = matches.select(*DOC, "wid").distinct().join(of, "wid").select(*DOC, "item").distinct()
    return each.groupBy(*DOC).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and items (sorted ids) of every row of ``docs``."""
    keep = Scratch(docs.sparkSession)
    found = keep.stored(windows(items, item_id, "text", size), "decontamination-windows")
    index = keep.stored(postings(docs, found.select(F.explode("terms").alias("term")), doc_id, text), "decontamination-index")
    ranked = keep.stored(by_rarity(found, index), "decontamination-ranked")
    matches = keep.stored(phrase_matches(ranked, index, keep), "decontamination-matches")
    verdicts = keep.stored(hits(matches).join(items_found(matches, found), DOC, "left"), "decontamination-verdicts")
    keep.drop(*(t for t, _ in keep.paths if t is not verdicts))
    rows = keyed(docs, doc_id, text).select("doc_id", *DOC, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(verdicts, DOC, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", none).alias("items"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS t FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
m AS (SELECT rid, s, dw.k, item_id FROM dw JOIN win ON win.k = dw.k AND win.t = array_to_string(w[s:s + dw.k - 1], ' ')),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT rid, s, k FROM m)) GROUP BY 1),
it AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
