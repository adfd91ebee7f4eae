"""Packing tokenised documents into sequences by vector best fit.

Tokens are those of the public byte-level vocabulary, then an end id. The tokens of a document longer
than a sequence are cut into pieces of a whole sequence, the first of which may be shorter. Every piece
is a vector (tokens, documents, attention cost); every sequence has a capacity in each of the three.
Pieces go, longest first, into the open sequence that fits under every capacity and, after taking the
piece, has the smallest weighted residual norm (or, by option, the largest weighted dot product of
piece and residual).

Tokenising happens where the documents are read; only a row of a few numbers per piece moves. Pieces
are dealt by a hash of doc_id to groups of about ``group_rows`` pieces, so no task grows with the input,
and each group is packed by itself: at most a few sequences per group stay partly empty. Sequences of one
group are numbered with the group in the upper 32 bits.

Null text counts as empty: its document is the end id alone. An empty table gives an empty result.
Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LENGTH = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0
GROUP_ROWS = 16384
LEAST_MAX_DOCS = 64
_encoders: dict[str, object] = {}


def located(vocabulary: str, kind: str) -> str:
    """File of a vocabulary: a path without its ending, or the name of a public one."""
    if "/" in vocabulary:
        return f"{vocabulary}.{kind}"
    import public_tokenizers

    return str(public_tokenizers.path(f"{vocabulary}.{kind}"))


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids, those of ``tokenizers`` with this vocabulary (a name or a path) and add_special_tokens=False.

    Made once per Python worker. The rank file of the same vocabulary gives the same ids about five times as fast;
    the vocabulary's added tokens (``<|endoftext|>``) are tokens here as they are there. Its splitter runs out of stack on some runs
    of white space and says so; such a text goes to ``tokenizers`` itself. Tests compare both on such texts.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(located(vocabulary, "tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(located(vocabulary, "json"), encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        slow: list = []

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:
                if not slow:
                    slow.append(Tokenizer.from_file(located(vocabulary, "json")))
                return slow[0].encode(text, add_special_tokens=False).ids

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, the first piece may be shorter."""
    first = n % length or min(n, length)
    return [(0, first), *((at, length) for at in range(first, n, length))]


def _pieces(length: int, vocabulary: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                rows += [(doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), length))]
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=list(names))

    return work


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], by: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, pieces in descending length; number of bins."""
    cap = np.array(capacity, dtype=float)
    scale = np.array(weights, dtype=float) / cap
    room, n = np.zeros((1024, 3)), 0
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    names = np.zeros(1024, dtype=np.int64)  # bins that are full leave the arrays
    made = 0
    for i, size in enumerate(lengths):
        need = np.array([size, 1.0, float(size) * float(size)])
        at = -1
        if n:
            fits = (room[:n] >= need).all(axis=1).nonzero()[0]
            if len(fits):
                left = (room[fits] - need) * scale
                score = (left * left).sum(axis=1) if by == "norm" else -(room[fits] * scale * (need * scale)).sum(axis=1)
                at = int(fits[score.argmin()])
        if at < 0:
            if n == len(room):
                room, names = np.concatenate([room, np.zeros_like(room)]), np.concatenate([names, np.zeros_like(names)])
            room[n], names[n] = cap, made
            at, n, made = n, n + 1, made + 1
        bins[i], offsets[i] = names[at], cap[0] - room[at, 0]
        room[at] -= need
        if room[at, 0] <= 0 or room[at, 1] <= 0:
            n -= 1
            room[at], names[at] = room[n], names[n]
    return bins, offsets, made


def _packed(length: int, capacity: tuple[float, float, float], weights: tuple[float, float, float], by: str):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, _ = best_fit(pdf["length"].to_numpy(), capacity, weights, by)
        pdf = pdf.assign(sequence_id=pdf["group"].to_numpy() * (1 << 32) + bins, offset=offsets)
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return work


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    max_docs: float | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    by: str = "norm",
    vocabulary: str = VOCABULARY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    max_attention bounds the sum of squared piece lengths and defaults to that of one whole piece; max_docs defaults to
    ``LEAST_MAX_DOCS``, or four times what a full sequence holds on average if that is more, so that it keeps a
    sequence from filling up with hundreds of tiny documents but never makes sequences of short documents half empty.
    """
    pieces = settle(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_pieces(length, vocabulary), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
    groups = max(1, -(-n // group_rows))
    usual = max(LEAST_MAX_DOCS, math.ceil(4 * n * length / max(tokens, 1)))
    capacity = (float(length), float(max_docs or usual), float(max_attention or length * length))
    # a null id hashes like any other value
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInPandas(
        _packed(length, capacity, weights, by),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
