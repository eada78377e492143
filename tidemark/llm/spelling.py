"""Spelling variant grouping: Aho-Corasick automata over the halves of every word.

Two words at distance one (one code point inserted, deleted or replaced) share a half: cut
a word in the middle, and either its first half begins the other word or its second half
ends it. So each word goes, as a pattern, with each half to the shard that the half's hash
names, and, as a text, to the shards of the beginnings and ends that can be halves of words
one shorter, as long or one longer. A shard builds one automaton of its patterns' halves,
scans its words, keeps hits whose offset and length fit, and verifies the distance.

Groups. A half of many words (an ending, say) would make all pairs of them, so under a half
the patterns are filed by what is left: the rest of the word is halved again and again to
blocks of at most ``LEAF`` code points, and a pattern is looked up by everything outside one
block. At most words that agree in all but ``LEAF`` code points are compared with each other.
Halves of more than ``HEAVY`` words are spread over the shards by these finer keys, so no
task gets such a group whole. The number of shards grows with the number of words.

Counting is done before anything meets: tokens are counted where they are read, so what
is shuffled is one row a word and task. Forms are followed by doubling: each round joins
the words' targets with themselves, at most seven rounds, since n at least doubles a step.

Defined results: a null text has no words; a row without an id counts as id '' in the
digest; repeated rows count repeatedly; words are equal when their code points are; an
empty table gives none; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_CHARS = 5
LEAST_TIMES = 3
MODULUS = 97
WORDS_PER_SHARD = 4_000
HEAVY = 5_000
LEAF = 1


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, modulus: int | None = MODULUS) -> DataFrame:
    """word and n; with a modulus, runs whose digest it divides lose one code point first."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    rows = rows.where(F.length("run") >= least_chars)  # a deletion only shortens
    plain = F.octet_length("run") == F.length("run")  # of ASCII alone, where lower() does no more than is asked
    rows = rows.select("id", F.when(plain, F.lower("run")).otherwise(ascii_lower(F.col("run"))).alias("word"))
    if modulus is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr(F.col("word"), at + 2))
        rows = rows.select(F.when(h % modulus == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def leaves(start: int, end: int) -> tuple[tuple[int, int], ...]:
    """Blocks of at most LEAF code points that halving start..end gives."""
    if end - start <= LEAF:
        return ((start, end),)
    middle = (start + end) // 2
    return leaves(start, middle) + leaves(middle, end)


class Rests(dict):
    """Blocks of a word outside its first (0) or second (1) half, by (length, half)."""

    def __missing__(self, key: tuple[int, int]) -> tuple[tuple[int, int], ...]:
        length, kind = key
        self[key] = leaves(length // 2, length) if kind == 0 else leaves(0, length // 2)
        return self[key]


def half(word: str, length: int, kind: int) -> str:
    """What stands in ``word`` where a word of ``length`` has its first or second half."""
    return word[: length // 2] if kind == 0 else word[len(word) - (length - length // 2) :]


def leaf_key(word: str, length: int, kind: int, block: tuple[int, int]) -> tuple:
    """All of ``word`` outside a block of words of ``length``: equal keys may be one change apart."""
    return length, kind, block, word[: block[0]], word[len(word) - (length - block[1]) :]


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode(), 0) - (1 << 63)


def _lengths(word: str) -> range:
    return range(max(len(word) - 1, 1), len(word) + 2)


def _routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each half that a word has (own: 1 for its first, 2 for its second) or may meet (0)."""
    for batch in batches:
        out = []
        for word, n in zip(batch["word"], batch["n"], strict=True):
            own = {(kind, half(word, len(word), kind)) for kind in (0, 1)}
            meets = {(kind, half(word, m, kind)) for m in _lengths(word) for kind in (0, 1)} | own
            out += [(_hash(*key), word, n, key[0] + 1 if key in own else 0) for key in meets]
        yield pd.DataFrame(out, columns=["half", "word", "n", "own"])


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a heavy half under the finer keys of their rests, others as they are."""
    rests = Rests()
    for batch in batches:
        if not batch["heavy"].any():
            yield batch.drop(columns="heavy").rename(columns={"half": "route"})
            continue
        out = []
        for h, word, n, own, heavy in batch.itertuples(index=False, name=None):
            if not heavy:
                out.append((h, word, n, own))
                continue
            fine = {}
            for m in _lengths(word):
                for kind in (0, 1):
                    if _hash(kind, half(word, m, kind)) == h:
                        for block in rests[m, kind]:
                            key = _hash(*leaf_key(word, m, kind, block))
                            fine[key] = max(fine.get(key, 0), own if m == len(word) else 0)
            out += [(key, word, n, mine) for key, mine in fine.items()]
        yield pd.DataFrame(out, columns=["route", "word", "n", "own"])


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (word, near, near_n) of a shard's words and of the patterns whose half it holds."""
    rests, filed, automaton = Rests(), {}, ahocorasick.Automaton()
    times = dict(zip(rows["word"], rows["n"], strict=True))
    for p, own in zip(rows["word"], rows["own"], strict=True):
        for kind in (0, 1):
            if own & (kind + 1):
                piece = half(p, len(p), kind)
                automaton.add_word(piece, len(piece))
                for block in rests[len(p), kind]:
                    filed.setdefault(leaf_key(p, len(p), kind, block), []).append(p)
    words, near_words = [], []
    if filed:
        automaton.make_automaton()
        for w in times:
            size_of_w, fits = len(w), set()
            for end, size in automaton.iter(w):
                if end == size - 1:
                    fits.update((m, 0) for m in (2 * size, 2 * size + 1) if abs(m - size_of_w) <= 1)
                if end == size_of_w - 1:
                    fits.update((m, 1) for m in (2 * size, 2 * size - 1) if abs(m - size_of_w) <= 1)
            found = {p for m, kind in fits for block in rests[m, kind] for p in filed.get(leaf_key(w, m, kind, block), ())}
            met = [p for p in found if near(w, p)]
            words += [w] * len(met)
            near_words += met
    return pd.DataFrame({"word": words, "near": near_words, "near_n": [times[p] for p in near_words]})


def near_pairs(counted: DataFrame, n_words: int) -> DataFrame:
    """word, near, near_n: every pair of different words at distance one, in both directions."""
    shards = max(1, -(-n_words // WORDS_PER_SHARD))
    routed = counted.select("word", "n").mapInPandas(_routes, "half bigint, word string, n bigint, own int")
    heavy = routed.where("own > 0").groupBy("half").agg(F.count("*").alias("_n")).where(F.col("_n") > HEAVY).select("half", F.lit(True).alias("heavy"))
    spread = routed.join(heavy, "half", "left").select("half", "word", "n", "own", F.coalesce("heavy", F.lit(False)).alias("heavy")).mapInPandas(_spread, "route bigint, word string, n bigint, own int")
    dealt = spread.withColumn("shard", F.pmod("route", F.lit(shards))).groupBy("shard", "word").agg(F.max("n").alias("n"), F.bit_or("own").alias("own"))
    return dealt.groupBy("shard").applyInPandas(_shard, "word string, near string, near_n bigint").distinct()


def variants(counted: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for words and their counts.

    The form is the near word of largest n (of equal ones the first by code points) if it
    occurs at least twice as often; the root is where following forms ends.
    """
    keep = Scratch(counted.sparkSession)
    words = keep.stored(counted, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near_of = keep.stored(near_pairs(words, words.count()).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "spelling-near")
    judged = words.join(near_of, "word", "left").withColumn("form_n", -F.col("best.minus"))
    strong = F.col("form_n") >= 2 * F.col("n")
    judged = keep.stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")), "spelling-forms")
    keep.drop(words, near_of)
    roots = keep.stored(judged.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while roots.where("moved").limit(1).count():
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = keep.stored(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        keep.drop(roots)
        roots = jumped
    return judged.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))
