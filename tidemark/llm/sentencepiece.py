"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

The piece table (pieces, log scores, kinds) is read from a model file on the driver,
laid out once as a double-array trie over UTF-8 bytes and broadcast: its size is that
of the vocabulary, whatever the data. Texts are cut where a piece can never reach
across (before each run of whitespace markers, which is checked against the
vocabulary); each part's best segmentation is found by Viterbi and short parts are
remembered, so frequent words cost one lookup.

The method needs logarithms of probabilities. A unigram model's scores are that and are
used as they are. A BPE model's scores are minus the merge rank; its vocabulary is used
with the probabilities that the Zipf-Mandelbrot law gives the ranks, normalised over all
pieces, since tokenizers are not trained here. Such ids are a unigram segmentation with
that vocabulary, not the model's own merges. Models that normalise text are refused.

A character without a piece becomes its bytes' pieces. A whitespace marker that
stands in the text itself is also written as bytes, so decoding gives every text back.

Defined results: a null text gives null ids and a null decoded text; an empty text
gives no ids; repeated rows are encoded alike; an empty table gives an empty result;
other columns do not matter. Texts are encoded one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types, and the shift of ranks in the Zipf-Mandelbrot law.
UNIGRAM, BPE = 1, 2
RANK_SHIFT = 2.7
UNKNOWN_PENALTY = 10.0
REMEMBERED_CHARS = 48
REMEMBERED_PARTS = 400_000
#: Slots of the double array that one look for room covers.
SEARCHED = 1024

SCHEMA = "doc_id bigint, ids array<int>, n_ids bigint, n_bytes_ids bigint, round_trip boolean"


@dataclass
class Pieces:
    """Double-array trie (base, check, value by node) and what decoding needs."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    texts: list[bytes]
    unknown_score: float
    cut: str


def load_pieces(spark: SparkSession, path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, from a model in any store that Spark reads."""
    data = bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()[0])
    return parse_model(data)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def parse_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) by id; raises ValueError for a model that this module can't follow."""
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), int(own.get(3, NORMAL))))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} has no scores to segment by")
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("the model normalises text: only identity with a leading marker and kept spaces is read")
    return pieces if kind == UNIGRAM else ranked(pieces)


def ranked(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """The pieces with logarithms of probabilities by the rank of their scores."""
    order = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: -pieces[i][1])
    logs = -np.log(np.arange(len(order)) + 1 + RANK_SHIFT)
    logs -= np.log(np.exp(logs).sum())
    scores = dict(zip(order, logs.tolist(), strict=True))
    return [(p, scores.get(i, s), kind) for i, (p, s, kind) in enumerate(pieces)]


def build(pieces: list[tuple[str, float, int]]) -> Pieces:
    """The trie of a piece table."""
    usable = sorted((p.encode(), i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p)
    byte_ids = np.full(256, -1, np.int32)
    texts = [p.replace(MARK, " ").encode() for p, _, _ in pieces]
    for i, (p, _, kind) in enumerate(pieces):
        if kind == BYTE:
            byte_ids[int(p[3:5], 16)] = i
            texts[i] = bytes([int(p[3:5], 16)])
        elif kind in (CONTROL, UNKNOWN):
            texts[i] = b""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for p, i in usable:
        node = 0
        for b in p:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                value.append(-1)
            node = children[node][b]
        value[node] = i
    size = 4 * len(children) + 1024
    base, check, slot_value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[0] = True
    free, todo = 1, [(0, 0)]
    while todo:
        node, slot = todo.pop()
        slot_value[slot] = value[node]
        kids = children[node]
        if not kids:
            continue
        codes = np.fromiter(sorted(kids), np.int64, len(kids))
        start, low = 0, free
        while not start:
            if low + SEARCHED + 512 >= len(taken):
                base, check, slot_value, taken = (np.concatenate([x, np.full(len(x), fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (slot_value, -1), (taken, False)))
            open_slots = np.flatnonzero(~taken[low : low + SEARCHED]) + low
            if low == free and len(open_slots) < SEARCHED // 16:
                free += SEARCHED // 2  # what is left open here is not worth a search
            starts = open_slots[open_slots > codes[0]] - codes[0]
            fits = starts[~taken[starts[:, None] + codes].any(axis=1)]
            if len(fits):
                start = int(fits[0])
            low += SEARCHED
        base[slot] = start
        for code in kids:
            taken[start + code] = True
            check[start + code] = slot
            todo.append((kids[code], start + code))
    end = int(np.flatnonzero(taken)[-1]) + 257
    crossing = any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER))
    lowest = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
    return Pieces(base[:end], check[:end], slot_value[:end], np.array([s for _, s, _ in pieces], np.float64), byte_ids, texts, lowest - UNKNOWN_PENALTY, f"{MARK}+[^{MARK}]*|[^{MARK}]+" if not crossing else "(?s:.+)")


class Encoder:
    """Encodes and decodes with a trie; remembers the parts it meets often."""

    def __init__(self, pieces: Pieces):
        self.base, self.check, self.value = pieces.base.tolist(), pieces.check.tolist(), pieces.value.tolist()
        self.scores, self.texts, self.unknown = pieces.scores.tolist(), pieces.texts, pieces.unknown_score
        self.byte_ids = pieces.byte_ids.tolist()
        self.is_byte = np.zeros(len(self.texts), bool)
        self.is_byte[[i for i in self.byte_ids if i >= 0]] = True
        self.parts = re.compile(pieces.cut)
        self.known: dict[str, list[int]] = {}

    def best(self, part: str) -> list[int]:
        """Ids of the segmentation of one part with the largest total score."""
        data = part.encode()
        n = len(data)
        base, check, value, scores = self.base, self.check, self.value, self.scores
        total = [float("-inf")] * (n + 1)
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        total[0] = 0.0
        for at in range(n):
            if data[at] & 0xC0 == 0x80:
                continue
            so_far, node, single = total[at], 0, False
            width = 1
            while at + width < n and data[at + width] & 0xC0 == 0x80:
                width += 1
            for end in range(at, n):
                slot = base[node] + data[end]
                if check[slot] != node or node == slot:
                    break
                node = slot
                piece = value[node]
                if piece >= 0:
                    if end + 1 == at + width:
                        single = True
                    score = so_far + scores[piece]
                    if score > total[end + 1]:
                        total[end + 1] = score
                        back[end + 1] = (at, piece)
                if base[node] == 0:
                    break
            if not single and so_far + self.unknown > total[at + width]:
                total[at + width] = so_far + self.unknown
                back[at + width] = (at, -1)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(data[start:at])]
            at = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if MARK in text:
            mark = [self.byte_ids[b] for b in MARK.encode()]
            head, *rest = text.split(MARK)
            out = self._spans(MARK + head.replace(" ", MARK))
            for span in rest:
                out += mark
                out += self._spans(span.replace(" ", MARK))
            return out
        return self._spans(MARK + text.replace(" ", MARK))

    def _spans(self, text: str) -> list[int]:
        known, out = self.known, []
        for part in self.parts.findall(text):
            ids = known.get(part)
            if ids is None:
                ids = self.best(part)
                if len(part) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED_PARTS:
                        known.clear()
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, the leading marker dropped."""
        texts = self.texts
        return b"".join([texts[i] for i in ids]).decode(errors="replace")[1:]


def encode_documents(docs: DataFrame, pieces: list[tuple[str, float, int]], doc_id: str = "doc_id", text: str = "text", more: list[str] | None = None) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes_ids (ids of single bytes) and round_trip, and the columns ``more`` after them."""
    more = more or []
    trie = docs.sparkSession.sparkContext.broadcast(vars(build(pieces)))  # plain values
    types = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("n_bytes_ids", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pieces(**trie.value))
        for batch in batches:
            step = 256
            for low in range(0, batch.num_rows, step):
                keys, texts = batch.column(0).slice(low, step), batch.column(1).slice(low, step).to_pylist()
                ids = [None if t is None else encoder.encode(t) for t in texts]
                same = [None if t is None else encoder.decode(x) == t for t, x in zip(texts, ids, strict=True)]
                flat = [None if x is None else np.array(x, np.int32) for x in ids]
                counts = [None if x is None else len(x) for x in flat]
                single = [None if x is None else int(encoder.is_byte[x].sum()) for x in flat]
                yield pa.RecordBatch.from_arrays([keys, pa.array(flat, types.field("ids").type), pa.array(counts, pa.int64()), pa.array(single, pa.int64()), pa.array(same, pa.bool_()), *(c.slice(low, step) for c in batch.columns[2:])], names=[*types.names, *more])

    kinds = dict(docs.dtypes)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more).mapInArrow(run, ", ".join([SCHEMA, *[f"{c} {kinds[c]}" for c in more]]))


def decode_documents(encoded: DataFrame, pieces: list[tuple[str, float, int]], doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the decoded text of each row's ids."""
    trie = encoded.sparkSession.sparkContext.broadcast(vars(build(pieces)))  # plain values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pieces(**trie.value))
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), load_pieces(spark))


def encode_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the token ids of every copy that is left, with its place in the training order."""
    return encode_documents(docs, load_pieces(spark), more=[c for c in ("mix_position", "mix_copy") if c in docs.columns])
