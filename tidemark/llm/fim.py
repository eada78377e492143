"""Fill-in-middle transformation: line units from a Split pre-tokenizer, ranked offsets as cuts.

A ``tokenizers`` Split pre-tokenizer with isolated matches of one pattern cuts a text into
units and gives their offsets in code points; nothing is trained. The offsets' number is n,
the number of units. Four 32-bit numbers from the sha256 of ``<seed>:<doc_id>`` decide: the
first two rank the offsets where the prefix and the middle end, the third whether a text is
transformed at all, the fourth its form. So a result depends on the row alone, whatever the
order or number of tasks, and a rerun after a lost executor gives the same.

Forms: ``psm`` is P prefix S suffix M middle, ``spm`` is S suffix P prefix M middle, ``plain``
the text itself. ``restored`` rebuilds the text from output and form: no marker occurs in a
transformed text, and no marker can begin inside another, so the first one found is the one
that was put there.

Defined results: a null text counts as empty and is plain with n = 0; a text with a marker in
it is plain and keeps its n; a row without an id draws from ``<seed>:``; rows of one id draw
alike; a text of one unit has empty parts; whole texts of any length are cut, in batches of
``BATCH_BYTES`` of output; an empty table gives none; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import table

UNIT = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100
SPM_SHARE = 50
BATCH_BYTES = 16 << 20

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 that the id fixes."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


class Transformer:
    """(n, form, prefix length, middle length, output) of a text."""

    def __init__(self, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE, unit: str = UNIT, markers: tuple[str, str, str] = MARKERS):
        self.seed, self.rate, self.spm_share, self.markers = seed, rate, spm_share, markers
        self.split = Split(Regex(unit), behavior="isolated")

    def offsets(self, text: str) -> list[int]:
        """Where each unit ends, in code points."""
        return [end for _, (_, end) in self.split.pre_tokenize_str(text)] if text else []

    def __call__(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        ends = self.offsets(text)
        n, (h1, h2, h3, h4) = len(ends), draws(doc_id, self.seed)
        if not text or h3 % 100 >= self.rate or any(m in text for m in self.markers):
            return n, "plain", None, None, text
        low, high = ((0, *ends)[k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:low], text[low:high], text[high:]
        p, s, m = self.markers
        if h4 % 100 < self.spm_share:
            return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row; ``settings`` are those of Transformer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transform = Transformer(**settings)
        for batch in batches:
            rows, size = [], 0
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                key, value = key.as_py(), value.as_py() or ""
                rows.append((key, *transform(key, value)))
                size += len(rows[-1][-1])
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that a form's output was made from."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.length(b) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


_h = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
e AS (SELECT *, len(u) AS n, {_h} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM g
"""
