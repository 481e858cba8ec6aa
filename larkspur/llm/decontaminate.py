"""Benchmark decontamination by winnowing.

Method. Items and documents are lower-cased (A-Z), cut into words and hashed word by word. Of every 13 consecutive words
the smallest hash of 5 consecutive words is kept, for items and documents alike: any shared span of 13 words keeps the
same hash on both sides. Kept hashes are joined and each hit is extended word by word, up to 8 words to either side,
which reaches the ends of every 13-word window that kept it. Runs of 13 words or more are hits. An item of fewer words
is one window: its whole hash is looked up at every place of a document.

Scale. Documents are read once, without a shuffle of their texts. A bit map of fixed size (`MAP_BITS`), gathered by
bitwise OR, holds the items' kept hashes; document hashes outside it never leave their task. Those inside it are joined
with the items' hashes by a shuffle, of which AQE splits hot keys, so the benchmark may have any size. Words are compared
by 64-bit hashes that mix in eight bytes at a time.

Edge cases. Null and empty texts have no words: n_words 0, not contaminated. An item without words has no window. Items
with a null id hit words but are not listed. Repeated rows each get a row. Texts and words may be of any length. Only the
named columns are read; clean() keeps all, whatever their names. Ties (a word in several items' windows) count once as a hit and list every item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import discard, durable, in_batches, read_table, small_side
from larkspur.llm.textbuf import pieces

WINDOW, GRAM = 13, 5
#: Words to either side that an extension may need.
REACH = WINDOW - GRAM
#: log2 of the bits in the map of kept item hashes: 512 KB.
MAP_BITS = 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
#: Masks of the first 0 to 8 bytes.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word, with one more at the end). Words are mixed in eight bytes at a time."""
    data = _FOLD[data]
    word = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    start = np.flatnonzero(word & (~before | edge[:-1]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    after = np.concatenate((word[1:], [False]))
    left = np.flatnonzero(word & (~after | edge[1:])) + 1 - start
    eight = np.ndarray(len(data), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    h = _mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), start
    while len(live):
        block = eight[at] & _LOW[np.minimum(left, 8)]
        h[live] = _mix(_mix(h[live] ^ block) + np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h, np.searchsorted(start, offsets)


def _slide(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over each n consecutive values; n - 1 fewer values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def kept_hashes(h: np.ndarray, rows: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the grams that some window of so many words keeps; windows stay inside a row."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = len(h) - gram + 1
    g = np.full(count, gram, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + count]
    g = _mix(g)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inside = row[: len(h) - window + 1] == row[window - 1 :]
    w = window - gram + 1
    least = np.where(inside, _slide(g, w, np.minimum), np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    top = _slide(np.concatenate((pad, least, pad)), w, np.maximum)
    seen = _slide(np.concatenate((pad.astype(bool), inside, pad.astype(bool))), w, np.logical_or)
    at = np.flatnonzero(seen & (top == g))
    return at, g[at]


def _around(h: np.ndarray, lo: int, hi: int, at: int, gram: int, none: int) -> list[int]:
    """Hashes of the words around a gram, of fixed length; none where the row has ended."""
    s, e = at - REACH, at + gram + REACH
    x = h[max(s, lo) : min(e, hi)].view(np.int64).tolist()
    return [none] * (max(s, lo) - s) + x + [none] * (e - min(e, hi))


HITS = "array<struct<len:int,hash:bigint,at:int,ctx:array<bigint>>>"


def _kept_rows(column: pa.Array, lengths: list[int], known: dict[int, np.ndarray] | None, short: bool) -> Iterator[tuple[int, list[dict]]]:
    """(words, kept hashes) of each row. known: a bit map for each window length, which hashes must be in."""
    none = -1 if known is None else -2
    for _, data, offsets in pieces(column):
        h, rows = word_hashes(data, offsets)
        found: list[list[dict]] = [[] for _ in range(len(rows) - 1)]
        counts = np.diff(rows)
        for n in lengths:
            gram = GRAM if n == WINDOW else n
            at, g = kept_hashes(h, rows, gram, n)
            if known is not None:
                bit = g >> np.uint64(64 - MAP_BITS)
                yes = (known[n][(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                at, g = at[yes], g[yes]
            row = np.searchsorted(rows, at, "right") - 1
            for r, i, x in zip(row.tolist(), at.tolist(), g.view(np.int64).tolist()):
                if short and n != WINDOW and counts[r] != n:
                    continue
                ctx = _around(h, rows[r], rows[r + 1], i, gram, none) if n == WINDOW else []
                found[r].append({"len": n, "hash": x, "at": i - int(rows[r]), "ctx": ctx})
        yield from zip(counts.tolist(), found)


_HIT_TYPE = pa.list_(pa.struct([("len", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("ctx", pa.list_(pa.int64()))]))


def _scan(df: DataFrame, cols: str, lengths: list[int], known: dict[int, np.ndarray] | None, short: bool) -> DataFrame:
    """df's columns but the last, a text; then n_words and hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found = zip(*_kept_rows(b.columns[-1], lengths, known, short)) if len(b) else ((), ())
            out = [*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(found, _HIT_TYPE)]
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names[:-1], "n_words", "hits"])

    return in_batches(df).mapInArrow(run, f"{cols}, n_words long, hits {HITS}")


def _item_prints(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(prints, holders): each kept hash with its context (len, hash, ctx) once, numbered by `print`, and the items that hold it (print, item).

    Items that share a passage, such as a prompt, share its prints, so a document that has it meets them once and not once an item.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    rows = _scan(items, "item string", list(range(1, WINDOW + 1)), None, True)
    rows = durable(rows.select("item", F.explode("hits").alias("y")).select("item", "y.len", "y.hash", "y.ctx").distinct())
    prints = durable(rows.select("len", "hash", "ctx").distinct().withColumn("print", F.monotonically_increasing_id()))
    x, y = rows.alias("x"), prints.alias("y")
    same = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.len") == F.col("y.len")) & (F.col("x.ctx") == F.col("y.ctx"))
    holders = durable(x.join(y, same).select("print", "item"))
    discard(rows)
    return prints, holders


def _bit_maps(prints: DataFrame) -> dict[int, np.ndarray]:
    """Bit map of hashes for each window length; its size depends on MAP_BITS and the number of lengths (13) alone."""
    bit = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    word = prints.groupBy("len", F.shiftright(bit, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int))")).alias("bits")
    )
    maps: dict[int, np.ndarray] = {}
    for row in word.toLocalIterator():
        maps.setdefault(row["len"], np.zeros(1 << (MAP_BITS - 6), np.int64))[row["word"]] = row["bits"]
    return {n: m.view(np.uint64) for n, m in sorted(maps.items())}


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, th (hash of the text), n_words, n_hit, items (sorted list of item ids as strings), longest (words of the longest window hit, 0 if none)."""
    prints, holders = _item_prints(benchmark, item_col, item_text_col)
    known = _bit_maps(prints)
    cols = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = durable(_scan(cols, f"id {kind}, th long", list(known), known, False).withColumn("row", F.monotonically_increasing_id()))
    x = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*").alias("x")
    both = x.join(prints.alias("y"), (F.col("x.len") == F.col("y.len")) & (F.col("x.hash") == F.col("y.hash")))
    same = F.array_join(F.transform(F.arrays_zip(F.col("x.ctx").alias("p"), F.col("y.ctx").alias("q")), lambda z: F.when(z["p"] == z["q"], "1").otherwise("0")), "")
    both = both.select("row", "print", F.col("x.len").alias("len"), "at", same.alias("same"))
    back = F.length(F.regexp_extract(F.substring("same", 1, REACH), "1*$", 0))
    ahead = F.length(F.regexp_extract(F.substring("same", REACH + GRAM + 1, REACH), "^1*", 0))
    long = F.col("len") == WINDOW
    span = both.select(
        "row", "print", F.when(long, F.col("at") - back).otherwise(F.col("at")).cast("long").alias("lo"),
        F.when(long, F.col("at") + GRAM + ahead).otherwise(F.col("at") + F.col("len")).cast("long").alias("hi"),
        (~long | (F.substring("same", REACH + 1, GRAM) == "1" * GRAM)).alias("ok"), "len",
    )
    span = durable(span.where("ok and hi - lo >= len").select("row", "print", "lo", "hi", "len"))
    hits = span.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.max("len").alias("longest"))
    held = span.select("row", "print").distinct().join(holders, "print").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["hi"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(a["end"], s["lo"]))).alias("n")),
    )["n"]
    hits = hits.select("row", n_hit.alias("n_hit"), "longest").join(held, "row")
    none = F.array().cast("array<string>")
    return rows.drop("hits").join(hits, "row", "left").select("id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"))


def _contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a whole window of `WINDOW` words of an item, or of which a 20th of the words, or more, lies in windows of shorter items."""
    bad = _contaminated() | (F.col("longest") >= WINDOW)
    bad = durable(contamination(docs, benchmark, id_col, text_col).where(bad).select("id", "th").distinct())
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("own_th"))
    return packed.join(small_side(bad, bad.count()), F.col("own").eqNullSafe(bad.id) & (F.col("own_th") == bad.th), "left_anti").select("doc.*")


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"),
    )
