"""Media columns with content-defined payload chunking.

A text becomes a payload (UTF-8, zero bytes up to a positive multiple of 64), the payload an 8-bit PCM
WAV. The WAV's bytes are cut where a rolling gear hash matches a mask, so equal passages give equal
chunks wherever they stand. A Spark join on chunk digests finds the chunks that several media share; the
first medium by (doc_id, digest) owns the body and all others only list its digest. Stored are, per
medium, its ordered chunk list and the bodies that it owns, compressed. Reading back fetches borrowed
bodies from their owners, puts chunks together in list order, verifies the SHA-256 of the whole, parses
the WAV and computes features of its samples.

Bodies move once to their medium's place, and shared ones once more to each borrower. A body with many
borrowers is dealt out under several salts, in proportion to their number, so no task gets all of them.

Null text counts as empty (64 zero bytes). Equal texts give equal values. Repeated rows are returned as
often as they occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

UNIT = 64
RATE = 8000
HEADER = 44
LEAST, MASK_BITS, MOST = 1024, 12, 16384
BORROWERS_PER_SALT = 100
BATCH_BYTES = 4 << 20
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, size=256, dtype=np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw + bytes(size - len(raw)), len(raw)


def wav(samples: bytes) -> bytes:
    """Mono unsigned 8-bit PCM."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of what wav() has made; ValueError for anything else."""
    size = struct.unpack_from("<I", media, 40)[0] if media[:4] == b"RIFF" and media[36:40] == b"data" else -1
    if size != len(media) - HEADER:
        raise ValueError("not a medium of this format")
    return media[HEADER:]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h[i] = sum of GEAR[data[i-k]] << k over the 32 bytes up to i, by doubling."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def cuts(media: bytes, least: int = LEAST, mask_bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """End of each chunk: the first hash match after ``least`` bytes, ``most`` bytes at the latest."""
    n = len(media)
    if n <= least:
        return [n]
    h = gear(np.frombuffer(media, dtype=np.uint8)) >> np.uint32(32 - mask_bits)
    marks = (np.flatnonzero(h == 0) + 1).tolist()
    out, at, k = [], 0, 0
    while at < n:
        while k < len(marks) and marks[k] < at + least:
            k += 1
        end = min(n, at + most, marks[k] if k < len(marks) else n)
        out.append(end)
        at = end
    return out


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def features(samples: bytes) -> str:
    """Mean, deviation, crossings of the middle per sample and entropy in bits, each with four decimals."""
    x = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    p = share[share > 0]
    above = x >= 128
    return f"mean={x.mean():.4f};std={x.std():.4f};crossings={np.count_nonzero(above[1:] != above[:-1]) / len(x):.4f};entropy={max(0.0, -(p * np.log2(p)).sum()):.4f}"


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


DIGESTS = pa.schema([("doc_id", pa.int64()), ("media_id", pa.binary()), ("digests", pa.list_(pa.binary()))])
BODIES = pa.schema([*DIGESTS, ("n_bytes", pa.int64()), ("bodies", pa.list_(pa.binary()))])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                media = wav(payload(text.as_py())[0])
                yield doc.as_py(), hashlib.sha256(media).digest(), [hashlib.sha256(x).digest() for x in chunks(media)]

    return _batches(rows(), DIGESTS, lambda r: 64 + 40 * len(r[2]))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)

    def rows():
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                data, n = payload(text.as_py())
                media = wav(data)
                parts = chunks(media)
                yield doc.as_py(), hashlib.sha256(media).digest(), [hashlib.sha256(x).digest() for x in parts], n, [squeeze.compress(x) for x in parts]

    return _batches(rows(), BODIES, lambda r: 64 + 40 * len(r[2]) + sum(map(len, r[4])))


READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def rebuild(digests: list[bytes], held: dict[bytes, bytes], media_id: bytes) -> bytes:
    """The medium from its ordered chunk list and compressed bodies; ValueError if it isn't what was stored."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    media = b"".join(expand.decompress(held[x]) for x in digests)
    if hashlib.sha256(media).digest() != media_id:
        raise ValueError("a medium differs from what was stored")
    return media


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                held: dict[bytes, bytes] = {}
                for x in ("own", "fetched"):
                    held |= {p["digest"]: p["body"] for p in at[x][i].as_py() or []}
                media = rebuild(at["digests"][i].as_py(), held, at["media_id"][i].as_py())
                data = samples_of(media)
                yield (
                    at["doc_id"][i].as_py(), at["n_bytes"][i].as_py(), len(data), hashlib.sha256(data).hexdigest(),
                    zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(data),
                )

    return _batches(rows(), READ, lambda r: 400)


def stored_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, fetched): per medium its chunk list and own bodies; per borrower the bodies that it reads from their owners."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    listed = rows.mapInArrow(_digest, "doc_id long, media_id binary, digests array<binary>")
    uses = listed.select("doc_id", "media_id", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = (
        uses.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "media_id")).alias("owner"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("digest", F.col("owner.doc_id").alias("owner_doc"), F.col("owner.media_id").alias("owner_media"), F.ceil(F.col("n") / F.lit(BORROWERS_PER_SALT)).cast("int").alias("salts"))
    )
    shared = settle(shared)
    is_owner = (F.col("owner_doc") == F.col("doc_id")) & (F.col("owner_media") == F.col("media_id"))
    borrowed = settle(
        uses.join(shared, "digest").filter(~is_owner).select("doc_id", "media_id", "digest", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    )
    notes = (
        borrowed.select("doc_id", "media_id", "digest", F.lit(None).cast("int").alias("salts"))
        .unionByName(shared.select(F.col("owner_doc").alias("doc_id"), F.col("owner_media").alias("media_id"), "digest", "salts"))
        .groupBy("doc_id", "media_id")
        .agg(
            F.collect_set(F.when(F.col("salts").isNull(), F.col("digest"))).alias("not_own"),
            F.collect_set(F.when(F.col("salts").isNotNull(), F.struct("digest", "salts"))).alias("lends"),
        )
    )
    full = rows.mapInArrow(_store, "doc_id long, media_id binary, digests array<binary>, n_bytes long, bodies array<binary>")
    at_home = full.join(notes, ["doc_id", "media_id"], "left")
    parts = F.zip_with("digests", "bodies", lambda d, b: F.struct(d.alias("digest"), b.alias("body")))
    own = F.when(F.col("not_own").isNull(), parts).otherwise(F.filter(parts, lambda p: ~F.array_contains(F.col("not_own"), p["digest"])))
    store = at_home.select("doc_id", "media_id", "digests", "n_bytes", own.alias("own"), "lends")
    n = F.coalesce("n_bytes", F.lit(0))
    # The condition also names n_bytes, so this branch keeps the outer join and all columns, and with them the same exchange of bodies.
    lent = (
        store.filter(F.coalesce(F.size("lends"), F.lit(0)) + n > n)
        .select(F.explode("lends").alias("lend"), "own")
        .select(F.col("lend.digest").alias("digest"), F.explode(F.sequence(F.lit(0), F.col("lend.salts") - 1)).alias("salt"), F.filter("own", lambda p: p["digest"] == F.col("lend.digest"))[0]["body"].alias("body"))
        .dropDuplicates(["digest", "salt"])
    )
    fetched = borrowed.join(lent, ["digest", "salt"]).groupBy("doc_id", "media_id").agg(F.collect_set(F.struct("digest", "body")).alias("fetched"))
    return store, fetched


def read_back(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row."""
    store, fetched = stored_media(docs)
    whole = store.drop("lends").join(fetched, ["doc_id", "media_id"], "left")
    return whole.select("doc_id", "media_id", "digests", "n_bytes", "own", "fetched").mapInArrow(
        _read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
