"""MinHash near-dedup with odd sketches.

A document's set holds its distinct shingles of five words (A-Z lower-cased); with fewer words, the whole
sequence is its one shingle. Documents with Jaccard similarity of at least 0.75 are linked.

1. Sets that are equal form a class; from here on its smallest doc_id stands for it (exact, no pairs).
2. Every class has ``BANDS`` x ``ROWS`` MinHash samples. Classes that share a band are candidates. A bucket
   gives one edge from each member to its smallest member, never pairs; connected components of these edges
   are candidate clusters. At similarity 0.75 a pair shares no band with probability 5e-6.
3. Odd sketches screen pairs of a cluster: the samples folded into ``SKETCH_BITS`` parity bits, whose XOR population
   count estimates high similarities precisely. Pairs that may reach the threshold (4 standard deviations of slack)
   and aren't yet connected are confirmed on the full sets. Only links that connect something are kept.
4. A cluster of more than ``CHUNK`` classes first meets ``PIVOTS`` of its members, one after the other: members whose
   sketch is near the pivot's are confirmed against it in tasks of at most ``CHUNK`` texts, which mostly leaves one
   connected whole. Members outside of the largest whole then meet the cluster chunk by chunk, exactly as
   in a small cluster; work grows with the members times those left over and not with their square, and no task gets an
   unbounded group.

Full sets are of 64-bit shingle hashes. Null, empty and wordless texts have the empty set and are linked with
nothing, as are rows without an id. Rows that share an id but not their set are classes of their own; all have the
smallest doc_id of what they are linked with. An empty table gives an empty result. Repeated rows are returned as often
as they occur. Ties: the smallest doc_id represents a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_mark, settle
from .components import Forest, components

WORDS = 5
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
THRESHOLD = (75, 100)
CHUNK = 512
PIVOTS = 2
_random = np.random.default_rng(20240501)
MULTIPLY = (_random.integers(0, 1 << 32, size=BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[None, :]
ADD = _random.integers(0, 1 << 32, size=BANDS * ROWS, dtype=np.uint32)[None, :]
PLACE = _random.integers(1 << 63, size=WORDS, dtype=np.uint64) | np.uint64(1)
#: XOR count above which a pair is far below 0.75: the expected count at 0.5, see the module text.
SCREEN = int(SKETCH_BITS / 2 * (1 - np.exp(-2 * 2 * BANDS * ROWS * 0.5 / SKETCH_BITS))) + 4


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh3_64_intdigest
    if n < WORDS:
        return np.array([h(b" ".join(words), seed=n)], dtype=np.uint64)
    own = np.fromiter(map(h, words), dtype=np.uint64, count=n)
    total = own[: n - WORDS + 1] * PLACE[0]
    for k in range(1, WORDS):
        total += own[k : n - WORDS + 1 + k] * PLACE[k]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash samples of a set that isn't empty."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * MULTIPLY + ADD).min(axis=0), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; keys of different bands don't meet."""
    s = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity bitmap: each (sample number, sample) flips one bit."""
    at = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimate(sketch_a: bytes, sketch_b: bytes) -> float:
    """Similarity that the XOR population count of two sketches stands for."""
    odd = int.from_bytes(sketch_a, "big") ^ int.from_bytes(sketch_b, "big")
    z = min(odd.bit_count(), SKETCH_BITS // 2 - 1)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * float(np.log(1 - 2 * z / SKETCH_BITS))


MARK = pa.struct([("a", pa.int64()), ("b", pa.int64())])
SKETCHED = pa.schema([("doc_id", pa.int64()), ("mark", MARK), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ids, keys, sketches = [], [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            sizes.append(len(found))
            if len(found):
                samples = signature(found)
                ids.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(bands(samples))
                sketches.append(odd_sketch(samples))
            else:
                ids.append(None)
                keys.append(None)
                sketches.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(MARK), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=SKETCHED)


def links(ids: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], forest: Forest) -> list[tuple[int, int]]:
    """Links that connect members of a cluster which the forest doesn't connect yet.

    A member's rivals are those whose sketch passes and that aren't connected with it; few of them are
    compared set by set, many by counting in an index of the cluster's shingles.
    """
    n = len(ids)
    out: list[tuple[int, int]] = []
    sizes = np.array([len(s) for s in sets])
    index: tuple[np.ndarray, np.ndarray] | None = None
    words = sketches.view(np.uint64) if n else sketches
    roots = np.array([forest.root(int(x)) for x in ids], dtype=np.int64)
    for i in range(n - 1):
        near = roots[i + 1 :] != roots[i]
        if not near.any():
            continue
        near &= np.bitwise_count(words[i + 1 :] ^ words[i]).sum(axis=1) <= SCREEN
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        near &= small * THRESHOLD[1] >= large * THRESHOLD[0]
        rivals = np.flatnonzero(near) + i + 1
        if not len(rivals):
            continue
        if len(rivals) > 16:
            if index is None:
                owner = np.repeat(np.arange(n), sizes)
                every = np.concatenate(sets)
                order = np.argsort(every, kind="stable")
                index = every[order], owner[order]
            lo, hi = np.searchsorted(index[0], sets[i], "left"), np.searchsorted(index[0], sets[i], "right")
            steps = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            common = np.bincount(index[1][steps], minlength=n)[rivals]
        else:
            common = np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for j in rivals])
        for j, both in zip(rivals, common, strict=True):
            if THRESHOLD[1] * both >= THRESHOLD[0] * (sizes[i] + sizes[j] - both) and forest.join(int(ids[i]), int(ids[j])):
                out.append((int(ids[i]), int(ids[j])))
                a, b = roots[i], roots[j]
                roots[roots == max(a, b)] = min(a, b)
    return out


def _cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the clusters, or of the pair of chunks, that are dealt to this group."""
    out: list[tuple[int, int]] = []
    for _, own in pdf.groupby(["cluster", "ci", "cj"], sort=False):
        own = own.drop_duplicates("vertex").sort_values("vertex")
        sets = [shingles(t) for t in own["text"]]
        sketches = np.frombuffer(b"".join(own["sketch"]), dtype=np.uint8).reshape(len(own), -1)
        forest = Forest()
        for vertex, whole in zip(own["vertex"].tolist(), own["whole"].tolist(), strict=True):
            forest.join(vertex, whole)
        out += links(own["vertex"].to_numpy(), sketches, sets, forest)
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _star(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a pivot with the members that are dealt to this group."""
    pivot = pdf[pdf["pivot"] == pdf["vertex"]]
    centre = shingles(pivot["text"].iloc[0])
    out = []
    for vertex, text in zip(pdf["vertex"], pdf["text"], strict=True):
        own = shingles(text)
        both = np.intersect1d(own, centre, assume_unique=True).size
        if THRESHOLD[1] * both >= THRESHOLD[0] * (len(own) + len(centre) - both):
            out.append((int(pivot["vertex"].iloc[0]), int(vertex)))
    return pd.DataFrame([x for x in out if x[0] != x[1]], columns=["a", "b"]).astype("int64")


def _apart(a: Column, b: Column) -> Column:
    """Population count of the XOR of two odd sketches."""
    size = SKETCH_BITS // 8
    part = lambda c, k: F.conv(F.hex(F.substring(c, 4 * k + 1, 4)), 16, 10).cast("long")
    return F.aggregate(F.array(*[F.bit_count(part(a, k).bitwiseXOR(part(b, k))) for k in range(size // 4)]), F.lit(0), lambda x, y: x + y)


def _vertices(sketched: DataFrame) -> DataFrame:
    """set_id, vertex, rep, mark, bands, sketch of every class; vertex is rep (its smallest doc_id) unless several classes have that."""
    first = F.min(F.struct("doc_id", "mark", "bands", "sketch"))
    classes = sketched.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(first.alias("f"))
    classes = settle(classes.select("set_id", F.col("f.doc_id").alias("rep"), F.col("f.mark").alias("mark"), F.col("f.bands").alias("bands"), F.col("f.sketch").alias("sketch")))
    shared = settle(classes.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep", F.lit(True).alias("shared")))
    vertex = F.when(F.col("shared"), F.xxhash64("set_id", "rep")).otherwise(F.col("rep"))
    return classes.join(shared, "rep", "left").withColumn("vertex", vertex).drop("shared")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """mark, text of the rows that the marks of wanted stand for; repeated rows count once."""
    # what is wanted grows with the texts, so it is never broadcast
    some = docs.select("mark", "text").join(wanted.select("mark").distinct().hint("merge"), "mark", "left_semi")
    return some.groupBy("mark").agg(F.first("text").alias("text"))


def _wholes(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with whole, the smallest vertex that the links found connect each with."""
    joined = components(found).select(F.col("id").alias("vertex"), F.col("component").alias("to"))
    return settle(members.drop("whole").join(joined, "vertex", "left").withColumn("whole", F.coalesce("to", "vertex")).drop("to"))


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _large_clusters(texts: DataFrame, large: DataFrame, chunk: int) -> DataFrame:
    """Links a, b that connect what belongs together in clusters of more than chunk members."""
    members = settle(large.select("cluster", "mark", "vertex", "sketch").withColumn("whole", F.col("vertex")))
    found = None
    for turn in range(PIVOTS):
        drawn = F.min_by(F.struct("vertex", "sketch", "whole", "mark"), F.xxhash64("vertex", F.lit(turn)))
        pivots = settle(members.groupBy("cluster").agg(drawn.alias("p")))
        near = members.join(pivots, "cluster").filter((F.col("whole") != F.col("p.whole")) & (_apart(F.col("sketch"), F.col("p.sketch")) <= SCREEN))
        near = settle(near.select("mark", "vertex", F.col("p.vertex").alias("pivot")))
        tasks = settle(near.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("tasks")))
        dealt = near.join(tasks, "pivot").withColumn("task", F.pmod(F.xxhash64("vertex"), F.col("tasks")).cast("int"))
        centres = pivots.select("p.mark", "p.vertex", F.col("p.vertex").alias("pivot")).join(tasks, "pivot").withColumn("task", _upto("tasks"))
        columns = ["mark", "vertex", "pivot", "task"]
        both = texts.join(settle(dealt.select(columns).unionByName(centres.select(columns))), "mark")
        new = settle(both.drop("mark").groupBy("pivot", "task").applyInPandas(_star, "a long, b long"))
        found = new if found is None else settle(found.unionByName(new))
        members = _wholes(members, found)
    wholes = members.groupBy("cluster", "whole").agg(F.count("*").alias("n"))
    main = wholes.groupBy("cluster").agg(F.max(F.struct("n", "whole")).alias("main"), F.sum("n").alias("size"))
    main = main.select("cluster", F.col("main.whole").alias("main"), F.ceil(F.col("size") / F.lit(chunk)).cast("int").alias("chunks"), (F.col("size") - F.col("main.n")).alias("others"))
    main = settle(main.filter("others > 0").withColumn("parts", F.ceil(F.col("others") / F.lit(chunk)).cast("int")))
    # Each chunk of the cluster meets each part of those outside of its largest whole.
    placed = members.join(main, "cluster").withColumn("h", F.xxhash64("vertex", F.lit(3)))
    columns = ["cluster", "mark", "vertex", "sketch", "whole", "ci", "cj"]
    every = placed.withColumn("ci", F.pmod("h", "chunks").cast("int")).withColumn("cj", _upto("parts"))
    others = placed.filter(F.col("whole") != F.col("main")).withColumn("cj", F.pmod("h", "parts").cast("int")).withColumn("ci", _upto("chunks"))
    met = texts.join(settle(every.select(columns).unionByName(others.select(columns)).distinct()), "mark")
    rest = met.drop("mark").groupBy("cluster", "ci", "cj").applyInPandas(_cluster, "a long, b long")
    return found.unionByName(rest)


def _components(docs: DataFrame, chunk: int) -> DataFrame:
    """doc_id, mark, n_shingles, component_id of every row of docs(doc_id, text, mark)."""
    made = docs.mapInArrow(_sketch, "doc_id long, mark struct<a:bigint,b:bigint>, n_shingles long, set_id binary, bands array<long>, sketch binary")
    sketched = settle(made.withColumn("set_id", F.when(F.col("doc_id").isNotNull(), F.col("set_id"))))
    classes = settle(_vertices(sketched))
    members = classes.select("vertex", F.explode("bands").alias("key"))
    pivots = settle(members.groupBy("key").agg(F.min("vertex").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot"))
    edges = members.join(pivots, "key").filter("vertex <> pivot").select(F.col("vertex").alias("a"), F.col("pivot").alias("b")).distinct()
    clusters = settle(components(edges).select(F.col("id").alias("vertex"), F.col("component").alias("cluster")))
    sizes = settle(clusters.groupBy("cluster").agg(F.count("*").alias("size")))
    placed = settle(clusters.join(sizes, "cluster").join(classes.select("mark", "vertex", "sketch"), "vertex"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    bins = max(1, total // 512)
    small = placed.filter(F.col("size") <= chunk).select("mark", "cluster", "vertex", "sketch", F.col("vertex").alias("whole"), F.lit(0).alias("ci"), F.lit(0).alias("cj"))
    texts = settle(_texts(docs, placed))  # all that is ever compared, read from the table once
    small = texts.join(small, "mark").withColumn("deal", F.pmod(F.xxhash64("cluster"), F.lit(bins))).drop("mark")
    found = settle(small.groupBy("deal").applyInPandas(_cluster, "a long, b long"))
    if sizes.filter(F.col("size") > chunk).head(1):
        found = settle(found.unionByName(_large_clusters(texts, placed.filter(F.col("size") > chunk), chunk)))
    joined = classes.select("set_id", "rep", "vertex").join(components(found).select(F.col("id").alias("vertex"), "component"), "vertex")
    joined = settle(joined)
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = joined.join(smallest, "component").select("set_id", "component_id").unionByName(
        classes.join(joined.select("vertex"), "vertex", "left_anti").select("set_id", F.col("rep").alias("component_id"))
    )
    # a set that many rows have is split by AQE: labels are written and so a plain scan
    return sketched.select("doc_id", "mark", "n_shingles", "set_id").join(settle(labels), "set_id", "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_groups(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = _components(rows.withColumn("mark", row_mark(rows)), chunk)
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; all columns stay.

    Only rows that are linked with a smaller doc_id go: rows without an id or with an empty set stay, and so do all rows
    that share the smallest id of their component.
    """
    marked = docs.withColumn("__mark", row_mark(docs))
    found = _components(marked.select(F.col("doc_id").cast("long"), "text", F.col("__mark").alias("mark")), chunk)
    goes = settle(found.filter("doc_id <> component_id").select(F.col("mark").alias("__mark")).distinct())
    return marked.join(goes, "__mark", "left_anti").select(*docs.columns)
