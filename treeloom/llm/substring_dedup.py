"""Substring dedup by a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document. Words covered by a window whose word sequence also
starts earlier (smaller doc_id, or same document and earlier start) are removed.

Documents go, in order of doc_id, into blocks of about ``BLOCK_BYTES``: equal id ranges, of which those that hold
more are cut at ids. A block is a shard. Building an index of all text and streaming all documents through every shard would take
work in the square of the input, so fingerprints first say where to look: each block sends the sorted, distinct,
delta-coded 64-bit hashes of its windows to hash ranges; a range tells each block which of its hashes occur in an
earlier block (the last such block is their home) and which occur in a later one. Every block sends a hash once, and is
home only to the next block that has it, so a passage that all documents share doesn't gather in a task.

Then passages, the runs of such windows, meet at their home: those that recur in a later block or inside the block are put into the
home's FM-index (backward search over a wavelet matrix); the others', and the later occurrences of the block itself, are
streamed through it as matching statistics, and stretches of at least ``WINDOW`` words that really occur there are reported. The
index decides on words, never on hashes. A window that its home doesn't have, because other words share its hash, is looked for
word by word in the blocks before that have the hash, one block back a round; windows that are still open after ``RETRIES``
rounds raise ValueError (with 64 bits that takes several collisions of one window).

Null text has no words. An empty table gives an empty result. Rows that share an id are judged in order of their text
and share a block; rows without an id come before all others, in order of a hash of their text, in blocks of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Over

from .common import settle
from .fm_index import FMIndex

WINDOW = 20
BLOCK_BYTES = 4 << 20
HASH_BITS = 64
RETRIES = 2
PIECE = 120
RANGE_WORDS = 2_000_000
QUERIES_AT_ONCE = 16384
SUB = 1024  # cuts of an id range
PLACE = np.random.default_rng(20240617).integers(1 << 63, size=WINDOW, dtype=np.uint64) | np.uint64(1)


def window_hashes(own: np.ndarray, window: int) -> np.ndarray:
    """Hash of the window at each position of an array of word hashes."""
    m = max(0, len(own) - window + 1)
    total = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        total += own[k : k + m] * PLACE[k % WINDOW]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return total ^ (total >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class Block:
    """A block's documents in one row of words, with the hash of the window that starts at each; words are cut out of the texts when asked for."""

    def __init__(self, pdf: pd.DataFrame, window: int, bits: int = HASH_BITS) -> None:
        pdf = pdf.assign(text=pdf["text"].fillna("")).sort_values(["ord", "text"], kind="stable")
        self.ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        self.texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        own = [word_hashes(t.split()) for t in self.texts]
        self.ends = np.cumsum([len(x) for x in own], dtype=np.int64)
        total = window_hashes(np.concatenate(own) if own else np.zeros(0, dtype=np.uint64), window)
        m = len(total)
        last = self.ends[np.searchsorted(self.ends, np.arange(m), "right")] if m else np.zeros(0, dtype=np.int64)
        self.starts = np.flatnonzero(np.arange(m) + window <= last)
        self.hashes = total[self.starts] >> np.uint64(64 - bits)
        self._held: tuple[int, list[bytes]] = (-1, [])

    def words(self, a: int, b: int) -> list[bytes]:
        """Words a to b of one document."""
        doc = int(np.searchsorted(self.ends, a, "right"))
        if self._held[0] != doc:
            self._held = doc, self.texts[doc].split()
        begin = int(self.ends[doc - 1]) if doc else 0
        return self._held[1][a - begin : b - begin]


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted integers as steps of 48 bits, with the upper quarters of the few larger steps aside."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    large = np.flatnonzero(steps >> np.uint64(48)).astype(np.uint32)
    middle = ((steps >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
    return b"".join((np.array([len(steps), len(large)], np.uint32).tobytes(), large.tobytes(), steps.astype(np.uint32).tobytes(), middle.tobytes(), (steps[large] >> np.uint64(48)).astype(np.uint16).tobytes()))


def unpack(data: bytes) -> np.ndarray:
    n, k = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    large, steps = np.frombuffer(data, np.uint32, k, 8), np.frombuffer(data, np.uint32, n, 8 + 4 * k).astype(np.uint64)
    steps += np.frombuffer(data, np.uint16, n, 8 + 4 * k + 4 * n).astype(np.uint64) << np.uint64(32)
    steps[large] += np.frombuffer(data, np.uint16, k, 8 + 4 * k + 6 * n).astype(np.uint64) << np.uint64(48)
    return np.cumsum(steps, dtype=np.uint64)


def _hashes(window: int, bits: int, range_bits: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        distinct = np.unique(Block(pdf, window, bits).hashes)
        at = (distinct >> np.uint64(bits - range_bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        rows = [(int(at[part[0]]), block, pack(distinct[part])) for part in np.split(np.arange(len(distinct)), cut) if len(part)]
        return pd.DataFrame(rows, columns=["range", "block", "packed"])

    return work


def _homes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per block of a hash range: its hashes that recur, the block before that has each (itself: none), whether one after has."""
    pdf = pdf.sort_values("block", kind="stable")
    parts = [unpack(x) for x in pdf["packed"]]
    sizes = [len(x) for x in parts]
    values = np.concatenate(parts)
    del parts
    block = np.repeat(pdf["block"].to_numpy(), sizes)
    order = np.argsort(values, kind="stable")  # equal hashes in order of block
    again = values[order][1:] == values[order][:-1]
    before, after = np.concatenate([[False], again]), np.concatenate([again, [False]])
    home, lends, recurs = block.copy(), np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    home[order[1:][again]] = block[order[:-1][again]]
    lends[order] = after
    recurs[order] = before | after
    rows, start = [], 0
    for b, n in zip(pdf["block"], sizes, strict=True):
        own = start + np.flatnonzero(recurs[start : start + n])
        if len(own):
            rows.append((int(b), pack(values[own]), zlib.compress(home[own].tobytes(), 1), zlib.compress(np.packbits(lends[own]).tobytes(), 1)))
        start += n
    return pd.DataFrame(rows, columns=["block", "hashes", "homes", "lends"])


def routes(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, homes, lends) of each row that _homes made."""
    for row in rows.itertuples():
        hashes = unpack(row.hashes)
        lends = np.unpackbits(np.frombuffer(zlib.decompress(row.lends), np.uint8), count=len(hashes)).astype(bool)
        yield hashes, np.frombuffer(zlib.decompress(row.homes), np.int64), lends


def runs(starts: np.ndarray, homes: np.ndarray, most: int | None) -> list[tuple[int, int, int]]:
    """(first start, last start, home) of consecutive starts with one home, of at most ``most`` starts."""
    if not len(starts):
        return []
    new = np.flatnonzero((np.diff(starts) != 1) | (np.diff(homes) != 0)) + 1
    out = []
    for a, b in zip([0, *new.tolist()], [*new.tolist(), len(starts)], strict=True):
        for x in range(a, b, most or b - a):
            y = min(b, x + most) if most else b
            out.append((int(starts[x]), int(starts[y - 1]), int(homes[a])))
    return out


PASSAGES = "home long, own boolean, block long, at long, words binary"


def _passages(window: int, bits: int):
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["home", "own", "block", "at", "words"]
        if not len(left):
            return pd.DataFrame([], columns=columns)
        name = int(left["block"].iloc[0])
        block = Block(left, window, bits)
        distinct, index, number = np.unique(block.hashes, return_index=True, return_inverse=True)
        first = index[number] == np.arange(len(number))
        recurs = np.bincount(number, minlength=len(distinct)) > 1
        home, lends = np.full(len(distinct), name, dtype=np.int64), np.zeros(len(distinct), dtype=bool)
        for hashes, homes, later in routes(right):
            at = np.searchsorted(distinct, hashes)
            home[at], lends[at] = homes, later
        lent = first & (lends | recurs)[number]
        # a later occurrence inside the block asks the block itself
        ask = np.where(first, home[number], name)
        asked = ~first | (ask != name)
        rows = [(name, True, name, a, b" ".join(block.words(a, b + window))) for a, b, _ in runs(block.starts[lent], np.zeros(lent.sum()), None)]
        rows += [(h, False, name, a, b" ".join(block.words(a, b + window))) for a, b, h in runs(block.starts[asked], ask[asked], PIECE)]
        return pd.DataFrame(rows, columns=columns)

    return work


#: A stretch of a block that occurs earlier (home is null), or windows that their home doesn't have.
FOUND = "block long not null, start long, end long, home long, words binary"


def _search(window: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "start", "end", "home", "words"]
        own, others = pdf[pdf["own"]], pdf[~pdf["own"]]
        if not len(others):
            return pd.DataFrame([], columns=columns)
        home = int(pdf["home"].iloc[0])
        names: dict[bytes, int] = {}
        text: list[int] = []
        for passage in own["words"]:
            text += [names.setdefault(w, len(names) + 2) for w in passage.split(b" ")]
            text.append(1)  # no query has this symbol
        index = FMIndex(np.array(text, dtype=np.int64), len(names) + 1)
        del text
        out: list[tuple] = []
        for k in range(0, len(others), QUERIES_AT_ONCE):
            some = others.iloc[k : k + QUERIES_AT_ONCE]
            asker, at, words = some["block"].to_numpy(), some["at"].to_numpy(), some["words"].to_numpy()
            rows = [[names.get(w, 0) for w in x.split(b" ")] for x in words]
            lengths = np.array(list(map(len, rows)))
            queries = np.zeros((len(rows), lengths.max()), dtype=np.int32)
            for i, row in enumerate(rows):
                queries[i, : len(row)] = row
            q, a, b = index.matches(queries, lengths, window)
            out += [(int(asker[i]), int(at[i] + x), int(at[i] + y), None, None) for i, x, y in zip(q.tolist(), a.tolist(), b.tolist(), strict=True)]
            slots = lengths - window + 2  # a window each, and one to end the last
            begin = np.cumsum(slots) - slots
            change = np.zeros(int(slots.sum()) + 1, dtype=np.int64)
            np.add.at(change, begin[q] + a, 1)
            np.add.at(change, begin[q] + b - window + 1, -1)
            open_ = np.cumsum(change)[:-1] == 0
            open_[begin + slots - 1] = False
            missed = np.flatnonzero(open_)
            if len(missed):
                of = np.searchsorted(begin, missed, "right") - 1
                for x, y, i in runs(missed, of, None):
                    s, e = x - int(begin[i]), y - int(begin[i])
                    out.append((int(asker[i]), int(at[i]) + s, int(at[i]) + e + window, home, b" ".join(words[i].split(b" ")[s : e + window])))
        return pd.DataFrame(out, columns=columns).astype({"home": "Int64"})

    return work


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(batch.column(3).is_valid())


def _onward(window: int, bits: int):
    """Windows that this block's index doesn't have: compared word by word with the block's own of their hash, else sent to the block before that has it."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "start", "end", "home", "words"]
        wanted = right[right["asker"].notna()]
        if not len(left) or not len(wanted):
            return pd.DataFrame([], columns=columns)
        name = int(left["block"].iloc[0])
        block = Block(left, window, bits)
        order = np.argsort(block.hashes, kind="stable")
        ordered = block.hashes[order]
        before: dict[int, int] = {}
        for hashes, homes, _ in routes(right[right["hashes"].notna()]):
            before.update(zip(hashes.tolist(), homes.tolist(), strict=True))
        out = []
        for row in wanted.itertuples():
            words = row.words.split(b" ")
            own = window_hashes(word_hashes(words), window) >> np.uint64(64 - bits)
            for k, h in enumerate(own.tolist()):
                start, sought = int(row.start) + k, words[k : k + window]
                lo, hi = np.searchsorted(ordered, np.uint64(h), "left"), np.searchsorted(ordered, np.uint64(h), "right")
                same = (s for s in block.starts[order[lo:hi]].tolist() if int(row.asker) != name or s < start)
                if any(block.words(s, s + window) == sought for s in same):
                    out.append((int(row.asker), start, start + window, None, None))
                elif before.get(h, name) != name:
                    out.append((int(row.asker), start, start + window, before[h], b" ".join(sought)))
        return pd.DataFrame(out, columns=columns).astype({"home": "Int64"})

    return work


TOLD = "block long not null, hashes binary, homes binary, lends binary, asker long, start long, words binary"


def _told(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """What a block has to know to look for the windows that it is asked for: its routes and those windows; nothing if it isn't asked."""
    columns = ["block", "hashes", "homes", "lends", "asker", "start", "words"]
    if not len(right):
        return pd.DataFrame([], columns=columns)
    return pd.concat([left.reindex(columns=columns), right.reindex(columns=columns)]).astype({"asker": "Int64", "start": "Int64"})


RESULT = "doc_id long, n_words long, n_removed long, kept binary"


def _kept(window: int):
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "kept"]
        if not len(left):
            return pd.DataFrame([], columns=columns)
        if right["home"].notna().any():
            raise ValueError("windows are still open after all rounds; allow more retries")
        pdf = left.assign(text=left["text"].fillna("")).sort_values(["ord", "text"], kind="stable")
        starts, ends = (np.sort(right[x].to_numpy(dtype=np.int64)) for x in ("start", "end"))
        rows, a = [], 0
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            b = a + len(words)
            own = slice(np.searchsorted(starts, a, "left"), np.searchsorted(starts, b, "left"))
            lost = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(lost, starts[own] - a, 1)
            np.add.at(lost, ends[slice(np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "right"))] - a, -1)
            gone = np.cumsum(lost)[:-1] > 0
            kept = words if not gone.any() else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            rows.append((None if pd.isna(doc) else int(doc), len(words), int(gone.sum()), b" ".join(kept)))
            a = b
        return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return work


def _digested(work):
    def digest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = work(left, right)
        return out.assign(kept=[hashlib.sha256(x).hexdigest() for x in out["kept"]])

    return digest


def _blocks(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, ord, block, text of every row, and the bytes of all texts; blocks are numbered in order of doc_id."""
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    said = rows.agg(F.coalesce(F.sum(length), F.lit(0)), F.min("doc_id"), F.max("doc_id"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), length)), F.lit(0))).head()
    total, low, high, loose = int(said[0]), said[1] or 0, said[2] or 0, int(said[3])
    width = (high - low + 1) * block_bytes // max(total - loose, 1)
    bits = min(62, max(0, width.bit_length() - 1, max(abs(low), abs(high)).bit_length() - 52))
    loose_bits = min(40, (loose // block_bytes).bit_length())
    no_id: Column = F.xxhash64("text")
    ordinal = F.coalesce("doc_id", no_id)
    # id ranges end above -(2 ** 52), ranges of hashes begin at -(2 ** 53)
    bucket = F.when(F.col("doc_id").isNotNull(), F.shiftright("doc_id", bits)).otherwise(F.lit(-(1 << 53)) + F.shiftrightunsigned(no_id.bitwiseXOR(F.lit(-(1 << 63))), 64 - loose_bits) if loose_bits else F.lit(-(1 << 53)))
    rows = rows.select("doc_id", ordinal.alias("ord"), bucket.alias("bucket"), "text")
    heavy = rows.groupBy("bucket").agg(F.sum(length).alias("bytes")).filter(F.col("bytes") > 2 * block_bytes)
    heavy = settle(heavy.select("bucket", F.greatest(F.lit(block_bytes), F.col("bytes") / F.lit(SUB - 24)).cast("long").alias("unit")))
    sub = F.lit(0)
    if heavy.head(1):
        upto = Over.partitionBy("bucket").orderBy("ord").rowsBetween(Over.unboundedPreceding, -1)
        sized = rows.select("bucket", "ord", length.alias("n")).join(heavy, "bucket").groupBy("bucket", "unit", "ord").agg(F.sum("n").alias("n"))
        cut = sized.withColumn("sub", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / F.col("unit"))).groupBy("bucket", "sub").agg(F.min("ord").alias("at"))
        cuts = settle(cut.filter("sub > 0").groupBy("bucket").agg(F.collect_list("at").alias("cuts")))
        rows = rows.join(cuts, "bucket", "left")
        sub = F.coalesce(F.size(F.filter("cuts", lambda x: x <= F.col("ord"))), F.lit(0))
    # Never null, and said so: joins by block then add no filter below the exchange. It isn't dealt by hand either: every step asks for
    # the same exchange by block and so shares one.
    return rows.select("doc_id", "ord", F.coalesce(F.col("bucket") * SUB + sub, F.lit(0).cast("long")).alias("block"), "text"), total


def without_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False, block_bytes: int = BLOCK_BYTES, hash_bits: int = HASH_BITS, retries: int = RETRIES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 of the kept words joined by a space, or its SHA-256) of every row of docs(doc_id, text)."""
    dealt, size = _blocks(docs.select(F.col("doc_id").cast("long"), "text"), block_bytes)
    range_bits = max(1, min(30, hash_bits, (size // 6 // RANGE_WORDS).bit_length()))
    hashed = dealt.groupBy("block").applyInPandas(_hashes(window, hash_bits, range_bits), "range long, block long, packed binary")
    homes = hashed.groupBy("range").applyInPandas(_homes, "block long not null, hashes binary, homes binary, lends binary")
    passages = dealt.groupBy("block").cogroup(homes.groupBy("block")).applyInPandas(_passages(window, hash_bits), PASSAGES)
    # Each round's results are exchanged once, by block; both the next round and the last step read that exchange.
    rounds = [passages.groupBy("home").applyInPandas(_search(window), FOUND).repartition("block")]
    found = rounds[0]
    for turn in range(retries):
        found = rounds[-1].mapInArrow(_closed, FOUND) if turn == 0 else found.unionByName(rounds[-1].mapInArrow(_closed, FOUND))
        missed = rounds[-1].mapInArrow(_open, FOUND).select(F.col("home").alias("block"), F.col("block").alias("asker"), "start", "words")
        told = homes.groupBy("block").cogroup(missed.groupBy("block")).applyInPandas(_told, TOLD)
        onward = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_onward(window, hash_bits), FOUND)
        rounds.append(onward.repartition("block"))
    if retries:
        found = found.unionByName(rounds[-1])
    last = dealt.groupBy("block").cogroup(found.groupBy("block"))
    if digest:
        return last.applyInPandas(_digested(_kept(window)), RESULT.replace("kept binary", "kept string"))
    return last.applyInPandas(_kept(window), RESULT).withColumn("kept", F.col("kept").cast("string"))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(batch.column(3).is_null())
