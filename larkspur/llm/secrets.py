"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Method. Three kinds of base findings come from patterns (assignments, access keys, long hex runs). Besides, every run of at least
`TOKEN` token characters that no base finding touches is scored by the log-likelihood ratio of two first-order character
models, one trained on labelled random strings, one on ordinary identifiers; runs above `THRESHOLD` (nats) that hold a digit or an
upper-case letter after the first are findings of kind `random`.

Training. samples() labels strings: random ones are encodings of SHA-2 digests; ordinary ones are the words of about `SAMPLE` documents
(picked by a hash of the id) that no pattern matches, and joined words as programs have them. Any table of (text, label) will do.

Scale. Only DataFrame expressions; no shuffle but that of the model's counts, which the alphabet bounds. Patterns mark their
matches with a control character, so a text is split once for each kind and offsets follow from lengths; the work grows almost
linearly with a text's length and matches.

Edge cases. Null and empty texts have no findings, empty tables no rows. Offsets count code points, end exclusive. Texts of any
length are scanned whole. Repeated rows each get a row; a score equal to the threshold is no finding. Columns named like a kind are
replaced, others carried as they are, whatever their names. Texts with a U+0001 are scanned as if it were U+0002, which no pattern matches either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import let, read_table

#: Kinds and their patterns, as listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run that is too short fails whole, so for these two the length can be part of the pattern.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Shortest token that is scored, its characters, and the log-likelihood ratio above which it counts.
TOKEN, THRESHOLD, SAMPLE = 16, 10.0, 2000
RUN = r"[A-Za-z0-9+/_=-]{16,}"
#: Words of which programs' identifiers are made.
WORDS = "get set user name value index count list map node key data file path time date size type id new old max min last first next page item total order price test main init load save read write open close start stop run view model table column row cell text line word char byte string number error message status result config default client server request response handler manager factory builder service session context buffer stream cache queue stack event action state token".split()

MARK = "\u0001"
#: Parts of a text whose lengths are summed at a time.
PIECE = 512


def _ends(lengths: Column) -> Column:
    """Running sums of an array, piece by piece, as appending to one long array would take the square of its length."""

    def running(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, v: F.struct((a["at"] + v).cast("int").alias("at"), F.concat(a["out"], F.array((a["at"] + v).cast("int"))).alias("out"))
        return F.aggregate(values, first, step)["out"]

    def whole(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(v) - 1), F.lit(PIECE)), lambda i: F.slice(v, i + 1, F.lit(PIECE)))
        sums = lambda c: running(F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, y: (a + y).cast("int"))), F.lit(0))
        return let(cut, lambda c: let(sums(c), lambda t: F.flatten(F.transform(c, lambda x, i: running(x, F.when(i > 0, F.get(t, i - 1)).otherwise(F.lit(0)))))))

    return let(lengths, whole)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit>> of a pattern's leftmost non-overlapping matches, in code points."""
    parts = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK, -1)
    both = let(parts, lambda p: F.struct(p.alias("parts"), _ends(F.transform(p, F.length)).alias("ends")))
    hit = lambda v, i: F.struct(F.get(v["ends"], i - 1).alias("start"), F.get(v["ends"], i).alias("end"), F.get(v["parts"], i).alias("hit"))
    found = let(both, lambda v: F.transform(F.sequence(F.lit(1), F.size(v["parts"]) - 2, F.lit(2)), lambda i: hit(v, i)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def _touched(m: Column, base: Column, steps: Column) -> Column:
    """Whether one of the base spans, which ascend without overlap, overlaps m: the last that starts before m ends, found by halving steps."""
    before = F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= F.size(base)) & (F.get(base, k + s - 1)["start"] < m["end"]), k + s).otherwise(k))
    return let(before, lambda k: F.when(k > 0, F.get(base, k - 1)["end"] > m["start"]).otherwise(False))


def _spans(found: Column, kind: str) -> Column:
    n = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end")))


def _written(spans: Column) -> Column:
    """kind:start:end of each span, by start and kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, random) labelled strings."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 512)
    forms = [digest, F.upper(F.sha2(F.concat(F.lit("u"), F.col("id")), 256)), *(F.base64(F.unhex(F.sha2(F.concat(F.lit(c), F.col("id")), 512))) for c in "abcd")]
    random = spark.range(1500).select(F.explode(F.array(*forms)).alias("text"), F.lit(True).alias("random"))
    n = len(WORDS)
    word = [F.get(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(n)).cast("int")) for k in range(4)]
    joined = [F.concat_ws("_", *word), F.concat(word[0], *(F.initcap(w) for w in word[1:])), F.concat(*(F.initcap(w) for w in word)), F.upper(F.concat_ws("_", *word[:3])), F.concat_ws("-", *word), F.concat_ws("/", *word)]
    made = spark.range(1500).select(F.explode(F.array(*joined)).alias("text"), F.lit(False).alias("random"))
    total = max(1, docs.count())
    some = docs.where(F.shiftrightunsigned(F.xxhash64(F.lit("secrets"), id_col), 11) / float(1 << 53) < SAMPLE / total)
    words = some.select(F.explode(F.regexp_extract_all(F.regexp_replace(text_col, f"{ASSIGN}|{ACCESS_LONG}|{HEX_LONG}", " "), F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("text"))
    return random.unionByName(made).unionByName(words.select("text", F.lit(False).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character following each, at first * 128 + second; ASCII."""
    code = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    pairs = labelled.select("random", code.alias("c")).where("size(c) > 1")
    step = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * 128 + F.get("c", i))
    counts = pairs.select("random", F.explode(step).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    seen = {(r["random"], r["pair"]): r["n"] for r in counts.where("pair between 0 and 16383").collect()}
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    table = [0.0] * 16384
    for a in alphabet:
        sums = {k: sum(seen.get((k, a * 128 + b), 0) + 0.5 for b in alphabet) for k in (True, False)}
        for b in alphabet:
            p, q = ((seen.get((k, a * 128 + b), 0) + 0.5) / sums[k] for k in (True, False))
            table[a * 128 + b] = math.log(p / q)
    return table


def _ratio(token: Column, table: Column) -> Column:
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    # pairs are summed from (previous code, sum), so a token is walked once
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, start, lambda s, c: F.struct(c.alias("before"), (s["sum"] + F.when(s["before"] < 0, 0.0).otherwise(F.get(table, s["before"] * 128 + c))).alias("sum")))["sum"]


def scan(docs: DataFrame, table: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with assign, access, hex and random: arrays of struct<start,kind,end>; columns of these names are replaced."""
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, "\u0002")
    keep = [c for c in docs.columns if c not in KINDS]
    x, t = docs.select(F.struct(*keep).alias("doc"), text.alias("t")), F.col("t")
    assign = F.filter(_matches(t, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 6)
    x = x.select("doc", _spans(assign, "assign").alias("assign"), _spans(_matches(t, ACCESS_LONG), "access").alias("access"), _spans(_matches(t, HEX_LONG), "hex").alias("hex"), _matches(t, RUN).alias("runs"))
    odd = F.filter("runs", lambda m: m["hit"].rlike("[0-9]|.[A-Z]"))
    for kind in KINDS[:3]:
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(26, -1, -1)]), lambda s: s <= F.size(kind))
        odd = let(F.struct(F.col(kind).alias("base"), steps.alias("steps"), odd.alias("odd")), lambda v: F.filter(v["odd"], lambda m: ~_touched(m, v["base"], v["steps"])))
    random = F.filter(odd, lambda m: _ratio(m["hit"], ratios) > threshold)
    return x.select("doc.*", *KINDS[:3], _spans(random, "random").alias("random"))


def op7_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(samples(docs)))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.concat(base, F.col("random"))).alias("spans")
    )
