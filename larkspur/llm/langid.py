"""Language identification by multilingual mixture inference.

Method. Each language's letter trigrams (lower case, runs of other characters as one space, hashed to `BINS` bins) give a
smoothed distribution. A document's trigrams are seen as drawn from a mixture of the languages; expectation
maximisation estimates the proportions from the trigrams' likelihoods. Languages are then added in order of their
proportion while the likelihood of the mixture, re-estimated on that set, gains more than a penalty that grows with the
logarithm of the length. The prediction is the language with the largest share of the chosen set; its share is the score.

Fit. Rows with a language whose crc32(id as text) mod 3 is not `HELD_OUT` may be learned from. Of each language about
`SAMPLE` of them are taken, by a hash of the id at a rate from the counts over all rows; that bound is the only sample.

Scale. One pass in Arrow batches, no shuffle of texts; the model is one number for each bin and language, whatever the
corpus holds. Whole texts are scored in pieces of bounded size.

Edge cases. Null texts and texts without a letter get `und` and score 0, as do all when nothing can be learned. Null
languages are not learned. A null id counts as held out of nothing (it may be learned from). Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import in_batches, read_table

BINS = 1 << 16
#: Rows of each language that a fit aims at; remainder of crc32(id) mod 3 that is held out.
SAMPLE, HELD_OUT = 2000, 1
#: Rounds of expectation maximisation; gain of log-likelihood, times log of the length, that another language must bring.
ROUNDS, PENALTY = 12, 6.0
#: Characters of a text that are worked on at a time.
PIECE = 1 << 18


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str, letters: np.ndarray) -> np.ndarray:
    """Bins of a text's letter trigrams, each letter at least once; none for a text without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[c]
    if not is_letter.any():
        return np.zeros(0, np.uint16)
    c = np.where(is_letter, c, 32).astype(np.uint32)
    c = c[is_letter | np.concatenate(([True], is_letter[:-1]))]
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.uint16)


@dataclass
class Model:
    """Log-probability of each bin (rows) in each language (columns)."""

    langs: list[str]
    logp: np.ndarray
    letters: np.ndarray

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """(language, share) of the chosen set, largest share first; empty where nothing can be said."""
        bins = trigrams(text, self.letters) if text else np.zeros(0, np.uint16)
        if not len(bins) or not self.langs:
            return []
        if len(bins) > PIECE:
            bins, times = np.unique(bins, return_counts=True)
            times = times.astype(np.float64)
        else:
            times = None
        lp = self.logp[bins]
        like = np.exp(lp - lp.max(1, keepdims=True))
        share = self._em(like, times, np.full(len(self.langs), 1 / len(self.langs)), ROUNDS)
        order = np.argsort(-share, kind="stable")
        total = len(bins) if times is None else times.sum()
        chosen, best = order[:1], self._fit(like[:, order[:1]], times, np.ones(1))
        shares = np.ones(1)
        for n in range(2, len(order) + 1):
            if share[order[n - 1]] < 0.02:
                break
            some = like[:, order[:n]]
            start = share[order[:n]] / share[order[:n]].sum()
            p = self._em(some, times, start, ROUNDS // 2)
            fit = self._fit(some, times, p)
            if fit - best <= PENALTY * np.log(total + 1):
                break
            chosen, best, shares = order[:n], fit, p
        found = sorted(zip(shares.tolist(), (-chosen).tolist()), reverse=True)
        return [(self.langs[-i], min(1.0, s)) for s, i in found]

    @staticmethod
    def _em(like: np.ndarray, times: np.ndarray | None, share: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            inverse = 1 / (like @ share + 1e-30)
            share = share * ((inverse if times is None else inverse * times) @ like)
            share = share / share.sum()
        return share

    @staticmethod
    def _fit(like: np.ndarray, times: np.ndarray | None, share: np.ndarray) -> float:
        x = np.log(like @ share + 1e-30)
        return float(x.sum() if times is None else x @ times)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Model of the labelled, not held-out rows of docs."""
    labelled = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    letters = _letters()
    if not langs:
        return Model([], np.zeros((BINS, 0)), letters)
    rate = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(sample / counts[k]))]), F.col(lang_col))
    lot = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), id_col), 11) / float(1 << 53)
    some = labelled.where(lot < rate).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = np.bincount(trigrams(text.as_py() or "", letters), minlength=BINS)
                total[lang] = total[lang] + found if lang in total else found
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bin", "n"])

    seen = in_batches(some).mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    seen = seen.groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns"))
    table = np.full((BINS, len(langs)), 0.2)
    for r in seen.collect():
        table[r["bins"], langs.index(r["lang"])] += r["ns"]
    return Model(langs, np.log(table / table.sum(0)), letters)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and langs (all languages found, with shares); columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "langs")]
    docs = docs.select(*keep)
    at = keep.index(text_col)
    spread = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp.astype(np.float32), np.packbits(model.letters)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp, letters = spread.value
        m = Model(langs, logp, np.unpackbits(letters).astype(bool))
        for b in batches:
            found = [m.mixture(t.as_py()) for t in b.column(at)]
            pred = pa.array([f[0][0] if f else "und" for f in found], pa.string())
            score = pa.array([f[0][1] if f else 0.0 for f in found], pa.float64())
            langs = pa.array([[{"lang": k, "share": s} for k, s in f] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, pred, score, langs], names=[*b.schema.names, "lang_pred", "score", "langs"])

    langs_type = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", langs_type)])
    return in_batches(docs).mapInArrow(run, schema)


def op6_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
