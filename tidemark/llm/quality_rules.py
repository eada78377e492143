"""Quality rules, line first: failing lines go, then documents that lose too much.

Every line with a word is judged on its own: long lines that do not end like a sentence,
heavy symbols, shouting, table or menu rows, navigation and boilerplate phrases (in
English, German, French and Spanish). Lines that fail are removed. A document is kept if
it is not failed by the base rules on the whole text and at least half of its words
stand on lines that pass.

Defined results: a null, empty or wordless text has no words, fails the base rules
and is dropped; repeated rows are judged alike; an empty table gives an empty
result; other columns do not matter. Rows are judged one at a time, so only the
longest text bounds a task's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
MIN_KEPT_SHARE = 0.5
MAX_SYMBOLS_PER_WORD = 0.5
MAX_SHOUTED_SHARE = 0.6
MIN_SHOUTED_WORDS = 3

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_ENDS = (b".", b"!", b"?", b'"', b"'", b":", b";", b",", b")", "”".encode(), "…".encode(), "»".encode())
#: A line of so many words is running text and must end like a sentence.
MIN_SENTENCE_WORDS = 8
#: Phrases of menus, notices and forms; a short line with one of them fails.
_BOILERPLATE = re.compile(
    rb"\b(all rights reserved|cookie policy|accept (all )?cookies|privacy policy|terms of (use|service)|javascript (is|must be) (disabled|enabled)|enable javascript|skip to (main )?content|back to top|read more|click here|sign (in|up)|log ?in|subscribe|share (this|on)|follow us|next page|previous page|site ?map"
    rb"|alle rechte vorbehalten|datenschutz(erkl\xc3\xa4rung)?|nutzungsbedingungen|impressum|cookies akzeptieren|weiterlesen|hier klicken|anmelden|n\xc3\xa4chste seite|nach oben"
    rb"|tous droits r\xc3\xa9serv\xc3\xa9s|politique de confidentialit\xc3\xa9|mentions l\xc3\xa9gales|accepter les cookies|lire la suite|cliquez ici|se connecter|page suivante|haut de page"
    rb"|todos los derechos reservados|pol\xc3\xadtica de (privacidad|cookies)|aviso legal|aceptar (las )?cookies|leer m\xc3\xa1s|haga clic|iniciar sesi\xc3\xb3n|p\xc3\xa1gina siguiente|volver arriba)\b",
    re.IGNORECASE,
)
_MENU = re.compile(rb"\s(\||\xc2\xbb|>|/|\xe2\x80\xa2|\xc2\xb7)\s")

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_bad_lines bigint, kept_words bigint, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that occur at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    # A 64-bit mix of its words' numbers stands for a window.
    mixed = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = key * np.uint64(0x94D049BB133111EB) + mixed[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def bad_line(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails a line rule."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols > MAX_SYMBOLS_PER_WORD * n and n > 1:
        return True
    if line.count(b"!") * 2 > n >= MIN_SHOUTED_WORDS or n >= MIN_SHOUTED_WORDS and sum(w.upper() == w and w.lower() != w for w in words) > MAX_SHOUTED_SHARE * n:
        return True
    if not line.rstrip(SPACE).endswith(_ENDS) and (n >= MIN_SENTENCE_WORDS or len(_MENU.findall(line)) >= 2):
        return True
    if n <= 12 and _BOILERPLATE.search(line):
        return True
    return n >= MIN_SHOUTED_WORDS and len(set(words)) == 1


def judge(text: bytes) -> tuple:
    """The columns of SCHEMA after doc_id."""
    words = text.split()
    n = len(words)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    chars = len(text.translate(None, SPACE + _CONTINUATION))
    seen: set[bytes] = set()
    repeats = lines = bad = good_words = 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        lines += 1
        if line in seen:
            repeats += 1
        else:
            seen.add(line)
        if bad_line(line, own):
            bad += 1
        else:
            good_words += len(own)
    in_repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * in_repeats > MAX_REPEATED_PERCENT * n
    return n, chars, symbols, repeats, in_repeats, lines, bad, good_words, failed, not failed and good_words >= MIN_KEPT_SHARE * n


def cleaned(text: bytes) -> bytes:
    """The text without its failing lines."""
    return b"\n".join(x for x in text.split(b"\n") if not (words := x.split()) or not bad_line(x, words))


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            columns = list(zip(*(judge(x.as_py() or b"") for x in texts), strict=True)) or [[]] * (len(names) - 1)
            types = [pa.int64()] * (len(names) - 3) + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; all columns stay."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(at).cast(pa.binary())]
            keep = [judge(x)[-1] for x in texts]
            new = pa.array([cleaned(x).decode() for x, k in zip(texts, keep, strict=True) if k], pa.string())
            left = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(left.columns)], names=names)

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, docs.withColumn(text, F.col(text).cast("string")).schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
