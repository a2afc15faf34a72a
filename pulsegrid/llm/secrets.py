"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Patterns give the base findings. A candidate of the method is a run of identifier characters with letters and
digits that no base finding touches. Two first-order Markov models over characters score it, one of random
strings and one of ordinary identifiers; it is a finding if the log-likelihood ratio exceeds ``MARGIN`` nats a
character. Both are trained from labelled samples of the corpus: random are the values that the patterns found and,
for the alphabets that those lack, digests of the documents' texts in base64; ordinary are the first identifier of
each document and the candidates without digits. Training counts pairs of characters over all documents and
ends in a table of 68 x 68 ratios, which scoring carries as a literal. Only DataFrame operations are used.

Cases: null and empty texts have no findings. Long texts may have any number of findings. Repeated rows get equal
results. An empty table trains on nothing: both models are uniform, all ratios 0, and there is nothing to score.
Inner columns get names that the input doesn't have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, let, running_sums, stage

# Kinds in the order in which ties at one start are listed, and their patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# AKIA[A-Z0-9]+ of 18 or more characters and [0-9a-f]+ of 16 or more: a failing run holds no other match
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z_-]{7,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: One more place for any other character.
PLACES = len(ALPHABET) + 1
SMOOTHING = 0.5
#: How many transitions the plain frequencies of characters count as, beside those seen after a character.
BACKING = 8.0
MARGIN = 0.7


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, k, v): code points, end exclusive, the matched text."""
    none = F.array().cast("array<struct<s:bigint,e:bigint,k:int,v:string>>")

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("bigint"))
        return let(running_sums(steps), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), F.lit(kind).alias("k"), m.alias("v"))))

    return F.when(~text.rlike(pattern), none).otherwise(
        let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(
            F.split(text, pattern, -1), lambda gaps: placed(found, gaps))))


def base_spans(text: Column) -> Column:
    """The base findings by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    value = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
    assign = F.filter(_spans(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["v"], value, 1)) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def candidates(text: Column, base: Column) -> Column:
    """Runs that the models are to judge: no base finding touches them."""
    text = F.coalesce(text, F.lit(""))
    return let(base, lambda b: F.filter(_spans(text, CANDIDATE, 3), lambda c: ~F.exists(
        b, lambda x: (x["s"] < c["e"]) & (x["e"] > c["s"]))))


def _place(char: Column) -> Column:
    """0 to 66 for the alphabet's characters, 67 for others, from the character's code."""
    code = F.ascii(char)
    out = F.when(code.between(65, 90), code - 65).when(code.between(97, 122), code - 71).when(code.between(48, 57), code + 4)
    for mark in "+/_=-":
        out = out.when(code == ord(mark), ALPHABET.index(mark))
    return out.otherwise(PLACES - 1)


def _pairs(s: Column) -> Column:
    """Places of neighbouring characters as one number, first x PLACES + second; linear in the length."""
    return let(F.transform(F.split(s, ""), _place), lambda p: F.zip_with(
        F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))),
        lambda a, b: (a * PLACES + b).cast("int")))


def train(samples: DataFrame) -> list[float]:
    """Log ratios random / ordinary of the PLACES x PLACES transitions from rows (value, random); rare ones lean on
    the plain frequencies of characters."""
    pairs = samples.where(F.length("value") > 1).select("random", F.explode(_pairs(F.col("value"))).alias("pair"))
    counts = {True: [0] * PLACES ** 2, False: [0] * PLACES ** 2}
    for row in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 x 68 x 68 rows
        counts[row["random"]][row["pair"]] = row["n"]

    def log_probabilities(of: list[int]) -> list[float]:
        plain = [sum(of[b::PLACES]) + SMOOTHING for b in range(PLACES)]
        total, out = sum(plain), []
        for a in range(PLACES):
            row = of[a * PLACES:(a + 1) * PLACES]
            out += [math.log((n + BACKING * p / total) / (sum(row) + BACKING)) for n, p in zip(row, plain, strict=True)]
        return out

    return [round(r - o, 6) for r, o in zip(log_probabilities(counts[True]), log_probabilities(counts[False]), strict=True)]


def samples_of(scanned: DataFrame) -> DataFrame:
    """Labelled strings (value, random) from rows of (base, cands, first, digest)."""
    value = r"([A-Za-z0-9+/_.=-]+)$"
    label = lambda v, random: F.struct(v.alias("value"), F.lit(random).alias("random"))
    ordinary = F.filter("cands", lambda c: ~c["v"].rlike("[0-9]"))
    return scanned.select(F.explode(F.concat(
        F.transform("base", lambda b: label(F.regexp_extract(b["v"], value, 1), True)),
        F.transform(ordinary, lambda c: label(c["v"], False)),
        F.array(label(F.col("digest"), True), label(F.col("first"), False)))).alias("x")).select("x.*").where("value != ''")


def scan(docs: DataFrame, text: Column) -> list[Column]:
    """What one look at a text gives: base findings, candidates and its two samples."""
    base = base_spans(text)
    return [let(base, lambda b: F.struct(b.alias("base"), candidates(text, b).alias("cands"))).alias("found"),
            F.regexp_extract(F.coalesce(text, F.lit("")), IDENTIFIER, 0).alias("first"),
            F.base64(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))).alias("digest")]


def findings(base: Column, cands: Column, ratios: list[float]) -> Column:
    """Base findings and those that the models add, by start, then kind as listed."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")

    def score(v: Column) -> Column:
        return F.aggregate(_pairs(v), F.lit(0.0), lambda a, p: a + F.get(table, p))

    added = F.filter(cands, lambda c: c["v"].rlike("[0-9]") & c["v"].rlike("[A-Za-z]") & (
        score(c["v"]) > MARGIN * F.length(c["v"])))
    return F.array_sort(F.concat(base, added))


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def find_secrets(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, the findings as an array of (s, e, k, v); and that column's name.

    Texts are read twice: to train, and to find.
    """
    name = fresh(docs, "secrets_")
    scanned = docs.select(*scan(docs, F.col(text)))
    ratios = train(samples_of(scanned.select("found.*", "first", "digest")))
    base = base_spans(F.col(text))
    return docs.withColumn(name, let(base, lambda b: findings(b, candidates(F.col(text), b), ratios))), name


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every stretch that findings cover replaced by ``mark``; null stays null."""
    state = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, (a["end"] + 1).cast("int"), (x["s"] - a["end"]).cast("int"))
        return F.when(x["s"] < a["end"], F.struct(F.greatest(a["end"], x["e"]).alias("end"), a["parts"].alias("parts"))).otherwise(
            F.struct(x["e"].alias("end"), F.concat(a["parts"], F.array(gap)).alias("parts")))

    done = let(F.aggregate(spans, state, step), lambda a: F.array_join(F.concat(
        a["parts"], F.array(F.substring(text, (a["end"] + 1).cast("int"), F.length(text)))), mark))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the texts, and n_chars (if there) made the new length."""
    found, name = find_secrets(docs, text)
    out = found.withColumn(text, redacted(F.col(text), F.col(name))).drop(name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned = stage(docs.select("doc_id", *scan(docs, F.col("text"))).select("doc_id", "found.*", "first", "digest"), "secrets")
    ratios = train(samples_of(scanned))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                          F.sha2(listed(F.col("base")), 256).alias("base_sha256"), findings(F.col("base"), F.col("cands"), ratios).alias("all_")) \
        .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", listed(F.col("all_")).alias("spans"),
                F.size(F.filter("all_", lambda x: x["k"] == 3)).cast("long").alias("n_markov"))
