"""Near-duplicate documents by SimHash and a byte-position inverted index with count filtering.

Method. A document's 64-bit fingerprint is the bitwise majority of its shingles' XXH64 hashes. Two fingerprints that
differ in at most d bits (d <= 3) differ in at most d of their 8 bytes, so they share at least 8 - d positional bytes.
The inverted index posts every distinct fingerprint under positional bytes; to keep postings short it posts triples of
positions, all triples inside the first four and inside the last four positions: any five positions hold three of one
half, so every qualifying pair meets in some posting. For each pair that meets, the shared positional bytes are
tallied, pairs below the guaranteed minimum of 8 - d go, and the rest is verified by exact bit distance. A pair is
taken only at the first posting where it meets, so it is emitted once.

Texts can also be linked by Jaccard similarity of their shingles (`similar_pairs`, for the pipeline), which 3 bits of a
fingerprint do not reach. The fingerprint then has 512 bits, of the distinct shingles' hashes, and is posted under `POSTS` triples of its 64 positional
bytes. Pairs that meet are tallied: `LEAST_BYTES` shared bytes, `WIDE_BITS` differing bits at most and sizes within the similarity retain a pair,
and its whole texts are compared. A pair of similarity 0.8 meets and is retained with a probability of 0.93, one of 0.85 with 0.99 (computed from the
angle between shingle sets); groups of more than two meet in more ways. Pairs are tried so that groups get connected, not all with all.

Scale. Exact copies collapse to one fingerprint before anything is joined. Postings are shuffled on (triple, bytes);
AQE splits skewed ones. Components are found by rounds of minima on the shared checkpoint folder.

Edge cases. Null and empty texts have no words: fingerprint zero, linked like any other. Repeated rows are each
returned. Null ids never become a component_id unless a whole component has none. Empty tables give empty results.
Only the named id and text columns are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import connected_components, durable, in_batches, maybe_marked, read_table

SEED = 42
#: Triples of byte positions that are indexed.
TRIPLES = [t for half in (range(0, 4), range(4, 8)) for t in combinations(half, 3)]

#: Longs of a wide fingerprint, and the triples of positional bytes that it is posted under; the first long is left out of these.
LANES, POSTS = 8, 160
FP_COLS = [f"f{i}" for i in range(LANES)]
WIDE_TRIPLES = [tuple(sorted(np.random.default_rng([7, n]).choice(np.arange(8, 8 * LANES), 3, replace=False).tolist())) for n in range(POSTS)]
#: Of texts whose shingles have a Jaccard similarity of 0.8, 512 bits differ in 78 (deviation 8), 64 in 10 (3), and 17 (4) bytes of 64 agree.
WIDE_BITS, TAG_BITS, LEAST_BYTES = 96, 19, 8
#: Rounds in which each group of similar texts tries one pair.
ROUNDS = 2
_BIT_OF = (np.arange(256)[:, None] >> np.arange(8)) & 1


def simhash64(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size).tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, th, fp) for each row: th is a hash of the text, the long fp holds the fingerprint's 64 bits."""
    cols = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash64(t.as_py(), k) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "th", "fp"])

    return in_batches(cols).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, th long, fp long")


def _mask(triple: tuple[int, ...]) -> int:
    m = sum(255 << (8 * p) for p in triple)
    return m - (1 << 64) if m >> 63 else m


def near_pairs(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """(lo, hi): pairs of distinct fingerprints of the table (column fp, distinct) within the distance, each once."""
    if not 0 <= max_distance <= 3:
        raise ValueError("the index guarantees matches up to 3 differing bits")
    posts = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(t)).cast("long")) for t in TRIPLES])).alias("triple", "bytes")
    )
    x, y = posts.alias("x"), posts.alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    shared = sum((diff.bitwiseAND(F.lit(_mask((p,))).cast("long")) == 0).cast("int") for p in range(8))
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(_mask(t)).cast("long")) == 0, F.lit(i)) for i, t in enumerate(TRIPLES)])
    on = (
        (F.col("x.triple") == F.col("y.triple"))
        & (F.col("x.bytes") == F.col("y.bytes"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (first == F.col("x.triple"))
        & (shared >= 8 - max_distance)
        & (F.bit_count(diff) <= max_distance)
    )
    return x.join(y, on).select(F.col("x.fp").alias("lo"), F.col("y.fp").alias("hi"))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct hashes of runs of k words, ascending; all words are one run where there are fewer, and none where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts, ends = (end - size).tolist(), end[min(k, len(words)) - 1 :].tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64))


def wide_simhash(shingles: np.ndarray) -> np.ndarray:
    """`LANES` longs: bit k of a lane is 1 if over half of the shingles have it in their hash for that lane."""
    if not len(shingles):
        return np.zeros(LANES, np.int64)
    counts = np.zeros(LANES * 8 * 256, np.int64)
    place = np.arange(LANES * 8, dtype=np.int64) * 256
    for at in range(0, len(shingles), 1 << 12):
        h = np.empty((len(shingles[at : at + (1 << 12)]), LANES), np.uint64)
        x = shingles[at : at + (1 << 12)]
        for lane in range(LANES):
            h[:, lane] = x
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            x = x ^ (x >> np.uint64(32))
        # bytes by position, counted by value, then by bit
        counts += np.bincount((h.view(np.uint8).reshape(len(h), -1) + place).ravel(), minlength=len(counts))
    ones = counts.reshape(-1, 256) @ _BIT_OF
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").ravel().view(np.int64)


def wide_fingerprints(texts: DataFrame, k: int) -> DataFrame:
    """(th, n, f0, f1...) of (th, text) rows: number of distinct shingles and wide SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column(1)]
            wide = np.array([wide_simhash(x) for x in sets], np.int64).reshape(-1, LANES)
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, *(pa.array(np.ascontiguousarray(w)) for w in wide.T)], names=["th", "n", *FP_COLS])

    return in_batches(texts).mapInArrow(run, f"th long, n long, {', '.join(f'{c} long' for c in FP_COLS)}")


def wide_posts(fps: DataFrame) -> DataFrame:
    """(key, th, tag, before, dense): postings under triples of positional bytes that another text has too.

    before is the posting before it in its key, dense whether its key has more than two. The tag, the lane that no triple takes a byte of, tells most
    chance meetings.
    """
    triples = np.array(WIDE_TRIPLES).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                bytes_ = np.stack([c.to_numpy() for c in b.columns[1:]], 1).view(np.uint8).astype(np.int64)
                keys = np.arange(POSTS) << 24 | bytes_[:, triples[0]] << 16 | bytes_[:, triples[1]] << 8 | bytes_[:, triples[2]]
                th, tag = (np.repeat(b.column(i).to_numpy(), POSTS) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(th), pa.array(tag)], names=["key", "th", "tag"])

    x = fps.select("th", *FP_COLS).mapInArrow(run, "key long, th long, tag long")
    w = Window.partitionBy("key").orderBy("th")
    before, after = F.lag(F.struct("th", "tag"), 1).over(w), F.lead("th", 1).over(w).isNotNull()
    dense = F.lag("th", 2).over(w).isNotNull() | F.lead("th", 2).over(w).isNotNull() | (before.isNotNull() & after)
    return x.select("key", "th", "tag", before.alias("before"), dense.alias("dense")).where("before is not null or dense")


def _near_tags(p: str, q: str) -> Column:
    return F.bit_count(F.col(p).bitwiseXOR(F.col(q))) <= TAG_BITS


def _counted(pairs: DataFrame, fps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (lo, hi) near enough in size that share `LEAST_BYTES` positional bytes and differ in `WIDE_BITS` bits at most."""
    lo, hi = fps.select(F.col("th").alias("lo"), F.struct("n", *FP_COLS).alias("x")), fps.select(F.col("th").alias("hi"), F.struct("n", *FP_COLS).alias("y"))
    diff = [F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in FP_COLS]
    shared = sum((d.bitwiseAND(F.lit(_mask((p,))).cast("long")) == 0).cast("int") for d in diff for p in range(8))
    size = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9
    return pairs.join(lo, "lo").join(hi, "hi").where(size & (sum(map(F.bit_count, diff)) <= WIDE_BITS) & (shared >= LEAST_BYTES)).select("lo", "hi")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (lo, hi) whose texts' shingles have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3)):
                x, y = shingles(p.as_py(), k), shingles(q.as_py(), k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(texts.toDF("lo", "p"), "lo").join(texts.toDF("hi", "q"), "hi")
    return durable(in_batches(sides.select("lo", "hi", "p", "q")).mapInArrow(run, "lo long, hi long"))


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(lo, hi, root_lo, root_hi): the pairs that links do not connect."""
    root = connected_components(links, "lo", "hi")
    for end in ("lo", "hi"):
        pairs = pairs.join(root.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_lo <> root_hi")


def _settled(near: DataFrame, links: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """links and as many verified pairs of near as connect all that verified pairs of near connect.

    `ROUNDS` times each group tries one pair, with the smallest of the groups it is near to; at last all pairs that are still apart are tried. So a large group of near
    copies is connected without its texts meeting in all their pairs.
    """
    tried = None
    for last in [False] * ROUNDS + [True]:
        some = _apart(near, links)
        if tried is not None:
            some = some.join(tried, ["lo", "hi"], "left_anti")
        if not last:
            ends = some.select("lo", "hi", F.greatest("root_lo", "root_hi").alias("own"), F.least("root_lo", "root_hi").alias("other"))
            some = ends.groupBy("own").agg(F.min(F.struct("other", "lo", "hi")).alias("best")).select("best.lo", "best.hi")
        some = durable(some.select("lo", "hi"))
        more = _verified(some, texts, k, similarity)
        tried = some if tried is None else durable(tried.union(some))
        links = durable(links.union(more))
    return links


def similar_pairs(docs: DataFrame, text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(lo, hi): pairs of hashes of distinct texts, each of that Jaccard similarity or more; their components are those of all pairs found."""
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    fps = durable(wide_fingerprints(texts, k).dropDuplicates(["th"]))
    posted = durable(wide_posts(fps))
    met = posted.where("before is not null").select(F.col("before.th").alias("lo"), F.col("th").alias("hi"), F.col("before.tag").alias("p"), F.col("tag").alias("q"))
    near = durable(_counted(met.where(_near_tags("p", "q")).select("lo", "hi").distinct(), fps, similarity))
    # texts that one more round may want are those of dense keys; few others are
    wanted = near.select(F.explode(F.array("lo", "hi")).alias("th")).distinct()
    read = lambda wanted: durable(maybe_marked(texts, "th", wanted, "th").join(wanted, "th", "left_semi").dropDuplicates(["th"]))
    some = read(durable(wanted))
    links = _settled(near, docs.sparkSession.createDataFrame([], "lo long, hi long"), some, k, similarity)
    root = connected_components(links, "lo", "hi")
    x = posted.where("dense").select("key", "th", "tag").join(root, F.col("th") == F.col("node"), "left").select("key", "th", "tag", F.coalesce("root", "th").alias("root"))
    p, q = x.alias("p"), x.alias("q")
    on = (F.col("p.key") == F.col("q.key")) & (F.col("p.th") < F.col("q.th")) & (F.col("p.root") != F.col("q.root")) & _near_tags("p.tag", "q.tag")
    met = p.join(q, on).select(F.col("p.th").alias("lo"), F.col("q.th").alias("hi")).distinct()
    rest = durable(_counted(met, fps, similarity).join(near, ["lo", "hi"], "left_anti"))
    if rest.isEmpty():
        return links
    some = read(durable(rest.select(F.explode(F.array("lo", "hi")).alias("th")).distinct()))
    return _settled(rest, links, some, k, similarity)


def _groups(rows: DataFrame, pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, component_id, keep): for each distinct fingerprint its group's smallest id and the (id, text hash) that stays."""
    order = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    reps = durable(rows.groupBy("fp").agg(F.min(order).alias("keep")))
    roots = connected_components(pairs(reps.select("fp")), "lo", "hi")
    grouped = reps.join(roots, reps.fp == roots.node, "left").select("fp", "keep", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("keep").alias("keep"))
    return durable(grouped.drop("keep").join(least, "root").select("fp", F.col("keep.id").alias("component_id"), "keep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_distance: int = 3) -> DataFrame:
    """One row per input row: the id, fp (long) and component_id, the smallest id reachable over links."""
    rows = durable(fingerprints(docs, id_col, text_col, k))
    return rows.join(_groups(rows, lambda fps: near_pairs(fps, max_distance)), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_distance: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each group: one with the group's smallest id (null only where all are null).

    Texts are linked by fingerprints, or by Jaccard similarity of k-word shingles where a similarity is given.
    Of rows that share that id the one with the least text hash stays. All columns stay as they are.
    """
    if similarity is None:
        rows = durable(fingerprints(docs, id_col, text_col, k))
        groups = _groups(rows, lambda fps: near_pairs(fps, max_distance))
    else:
        th = F.xxhash64(text_col)
        rows = durable(docs.select(F.col(id_col).alias("id"), th.alias("th"), th.alias("fp")))
        groups = _groups(rows, lambda _: similar_pairs(docs, text_col, k, similarity))
    kept = groups.select("keep").distinct().select(F.col("keep.id").alias("id"), F.col("keep.th").alias("th"))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("own_th"))
    some = packed.join(kept, F.col("own").eqNullSafe(kept.id) & (F.col("own_th") == kept.th), "left_semi")
    w = Window.partitionBy("own", "own_th").orderBy(F.lit(0))
    return some.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
