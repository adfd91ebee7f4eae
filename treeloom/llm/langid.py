"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter is one array whose cell p holds a bit per language: bit l is set if some
n-gram of language l hashes to p. A cell has a word for every 64 languages. Looking an n-gram up takes one cell per hash function; the AND of the
cells is the mask of all languages that (may) contain the n-gram. The set bits of each language are
counted over the n-grams of a text and corrected for the filter's false positives, and the highest
corrected share decides.

Fitting: character n-grams of lower-cased text are counted on a bounded sample of labelled rows,
about ``sample_per_language`` rows of each language, picked by a hash of doc_id (documented parameter;
 labels are the non-null lang of rows outside the held-out fifth). Language l contains an
n-gram if its relative frequency there is at least ``share`` of the highest frequency in any language.
The model, a filter of fixed size, is broadcast.

``und`` for text that is null or has no letter, with score 0. Texts without any known n-gram get the
first language by name among equals. Ties go to the first language by name. Without labelled rows every
text is ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_LANGUAGE = 1500
GRAM = 4
CELLS = 1 << 18
SHARE = 0.35
LEAST = 3
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B)
BLOCK = 1 << 20
#: A label column with more distinct values than the world has languages isn't one of languages.
MAX_LANGUAGES = 8192


@dataclass
class Model:
    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray
    gram: int


def grams(text: str, n: int = GRAM) -> np.ndarray:
    """The byte n-grams (n <= 4) of lower-cased text as integers, runs of non-letters as one space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    raw = np.where(letter, raw, np.uint8(32))
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    raw = np.concatenate([np.array([32], np.uint8), raw[keep], np.array([32], np.uint8)]).astype(np.uint32)
    if len(raw) < n:
        return np.zeros(0, dtype=np.uint32)
    out = raw[: len(raw) - n + 1].copy()
    for k in range(1, n):
        out |= raw[k : len(raw) - n + 1 + k] << np.uint32(8 * k)
    return out


def places(grams_: np.ndarray, cells: int) -> list[np.ndarray]:
    shift = np.uint32(32 - int(cells).bit_length() + 1)
    mixed = grams_ ^ (grams_ >> np.uint32(15))
    return [(mixed * np.uint32(m)) >> shift for m in MULTIPLIERS]


def build(counts: dict[str, dict[int, int]], gram: int = GRAM, cells: int = CELLS, share: float = SHARE, least: int = LEAST) -> Model:
    """The filter from the counts of n-grams by language."""
    languages = sorted(counts)
    table = np.zeros((max(1, -(-len(languages) // 64)), cells), dtype=np.uint64)
    best: dict[int, float] = {}
    totals = {x: max(1, sum(c.values())) for x, c in counts.items()}
    for x, c in counts.items():
        for g, k in c.items():
            best[g] = max(best.get(g, 0.0), k / totals[x])
    for bit, x in enumerate(languages):
        own = np.array([g for g, k in counts[x].items() if k >= least and k / totals[x] >= share * best[g]], dtype=np.uint32)
        for at in places(own, cells):
            np.bitwise_or.at(table[bit // 64], at, np.uint64(1 << bit % 64))
    filled = np.array([((table[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in range(len(languages))])
    return Model(languages, table, filled ** len(MULTIPLIERS), gram)


def decide(model: Model, text: str | None) -> tuple[str, float]:
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return "und", 0.0
    hits, total = np.zeros(len(model.languages)), 0
    step = BLOCK
    for at in range(0, len(text), step):  # blocks bound memory; all of the text is read
        g = grams(text[at : at + step + model.gram - 1] if at + step < len(text) else text[at:], model.gram)
        first, second = places(g, model.cells.shape[1])
        masks = [word[first] & word[second] for word in model.cells]
        total += len(g)
        hits += [np.count_nonzero(masks[b // 64] & np.uint64(1 << b % 64)) for b in range(len(model.languages))]
    share = np.clip((hits / max(total, 1) - model.false_rate) / np.maximum(1 - model.false_rate, 1e-9), 0, 1)
    best = int(share.argmax())
    return model.languages[best], float(share[best])


def _count(gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, dict[int, int]] = {}
        for batch in batches:
            for x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = tally.setdefault(x, {})
                for g, k in zip(*map(np.ndarray.tolist, np.unique(grams(text, gram), return_counts=True)), strict=True):
                    own[g] = own.get(g, 0) + k
        rows = [(x, g, k) for x, own in tally.items() for g, k in own.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "gram", "k"])

    return work


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, gram: int = GRAM, cells: int = CELLS, share: float = SHARE) -> Model:
    """Learn from text and lang of rows outside the held-out fifth, about sample_per_language rows of each language.

    What comes to the driver is bounded: a row count per language, then the sample's distinct (language, n-gram)
    counts. More than MAX_LANGUAGES distinct labels raise ValueError: those are no languages.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels")
    if not sizes:
        return build({}, gram, cells, share)
    rates = docs.sparkSession.createDataFrame([(x, int(min(1.0, sample_per_language / n) * (1 << 30))) for x, n in sizes.items()], "lang string, rate long")
    rank = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    chosen = labelled.join(F.broadcast(rates), "lang").filter(rank < F.col("rate"))
    rows = chosen.select("lang", "text").mapInArrow(_count(gram), "lang string, gram long, k long")
    rows = rows.groupBy("lang", "gram").agg(F.sum("k").alias("k")).filter(F.col("k") >= LEAST)
    counts: dict[str, dict[int, int]] = {x: {} for x in sizes}
    for batch in rows.toArrow().to_batches():
        for x, g, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts[x][g] = k
    return build(counts, gram, cells, share)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [decide(m, text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """docs without the rows that are ``und`` or score below ``least``; all columns stay, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [decide(m, text.as_py()) for text in batch.column(at)]
            yield batch.filter(pa.array([x != "und" and y >= least for x, y in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def crc_bucket(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
