"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far each vote can be trusted.

Every rule looks at counts of one text and votes good, bad or abstains. A document has a hidden class; given
the class, votes are independent, and an abstention says nothing. EM over the counts of vote patterns estimates
the share of good documents and the accuracy of each rule in either class. The posterior of a document is the
sum of the log ratios of its votes, so the verdict is an expression with a few numbers in it. Only DataFrame operations are used; the
driver sees one row of sums per pass, and the pattern table has at most 3 ** (number of rules) rows.

Cases: a null or blank text has no words and fails the base rule (under ``MIN_WORDS``). An empty table gives an
empty result (no pass of EM is made). Repeated rows are judged alike. Other columns are passed on untouched;
inner columns get names that the input doesn't have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, let, stage, words_of

# Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A word of running text: letters, small ones after the first, and at most one mark after it.
PROSE = r"^\p{L}\p{Ll}*[.,;:?!]?$"
GOOD, ABSTAIN, BAD = 1, 0, -1
#: Where EM starts, and what it is drawn to: how often a rule that doesn't abstain votes bad, by class.
START = {"good": 0.03, "bad": 0.45}
START_SHARE = 0.85
#: The start counts as this share of the documents in every estimate.
PRIOR_WEIGHT = 0.02
#: EM ends when no estimate moves by TOLERANCE; more passes than this are an error.
PASSES = 500
TOLERANCE = 1e-4
THRESHOLD = 0.5


def _count(text: Column, chars: str) -> Column:
    """How many of these ASCII characters a text has."""
    each = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return sum(each[1:], each[0])


def _repeated_words(words: Column) -> Column:
    """Words that stand in a window of ``WINDOW`` words which the text has more than once."""
    keys = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        starts = let(placed, lambda s: F.transform(F.filter(s, lambda e, j: (
            (e["k"] == F.get(s, j - 1)["k"]) | (e["k"] == F.get(s, j + 1)["k"]))), lambda e: e["i"]))
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(F.array_sort(starts), state, lambda a, i: F.struct(
            (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(
        let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k))))


def counts(text: Column) -> Column:
    """The counts that the base rule and the voting rules use, as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words_of(text), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
        F.size(F.filter(w, lambda x: x.rlike(PROSE))).alias("n_prose"), F.size(F.filter(w, lambda x: x.rlike(f"[{SYMBOLS}]"))).alias("n_symbol_words"),
        F.size(F.array_distinct(w)).alias("n_distinct"), _repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    return let(by_words, lambda w: let(by_lines, lambda x: F.struct(*[c.cast("long").alias(n) for n, c in {
        "n_words": w["n_words"], "word_chars": w["word_chars"], "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": x["n_dup_lines"], "n_repeat_words": w["n_repeat_words"], "n_lines": x["n_lines"],
        "n_distinct": w["n_distinct"], "n_prose": w["n_prose"], "n_symbol_words": w["n_symbol_words"], "n_upper": upper, "n_exclaims": _count(text, "!"), "n_bars": _count(text, "|"),
    }.items()])))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT)


def _vote(measure: Column, good_to: float, bad_from: float) -> Column:
    return F.when(measure >= bad_from, BAD).when(measure <= good_to, GOOD).otherwise(ABSTAIN).cast("int")


def votes(c: Column) -> dict[str, Column]:
    """The voting rules over ``counts``; a measure that a text can't have (no words) abstains."""
    def share(part: str, of: str) -> Column:
        return F.when(c[of] > 0, c[part] / c[of])

    mean_length = F.when(c["n_words"] > 0, c["word_chars"] / c["n_words"])
    return {
        "symbols": _vote(share("n_symbols", "word_chars"), 0.01, 0.04),
        "upper": _vote(share("n_upper", "word_chars"), 0.15, 0.40),
        "exclaims": _vote(share("n_exclaims", "n_words"), 0.05, 0.20),
        "bars": _vote(share("n_bars", "n_words"), 0.02, 0.10),
        "symbol_words": _vote(share("n_symbol_words", "n_words"), 0.05, 0.30),
        "prose": _vote(1 - share("n_prose", "n_words"), 0.10, 0.40),
        "repeats": _vote(share("n_repeat_words", "n_words"), 0.05, 0.25),
        "lines": F.when(c["n_lines"] < 4, ABSTAIN).otherwise(_vote(share("n_dup_lines", "n_lines"), 0.10, 0.30)),
        "variety": F.when(c["n_words"] < 40, ABSTAIN).otherwise(
            _vote(1 - share("n_distinct", "n_words"), 0.75, 0.90)),
        "length": F.when(c["n_words"] < 8, BAD).when(c["n_words"] >= MIN_WORDS, GOOD).otherwise(ABSTAIN),
        "word_length": F.when(c["n_words"] == 0, ABSTAIN).when(mean_length.between(3, 9), GOOD).when(
            mean_length.between(2, 14), ABSTAIN).otherwise(BAD),
    }


def slots(of: dict[str, Column]) -> Column:
    """The votes that aren't abstentions, as 2 x rule, plus 1 for a bad one."""
    return F.filter(F.array(*[F.when(v == GOOD, 2 * j).when(v == BAD, 2 * j + 1).otherwise(-1) for j, v in enumerate(of.values())]),
                    lambda x: x >= 0)


class Model:
    """The share of good documents and, by class, how often every rule's votes are bad."""

    def __init__(self, n_rules: int):
        self.share = START_SHARE
        self.bad_vote = {k: [START[k]] * n_rules for k in START}

    def posterior(self, slots: Column) -> Column:
        ratios = [r for g, b in zip(self.bad_vote["good"], self.bad_vote["bad"], strict=True) for r in (math.log((1 - g) / (1 - b)), math.log(g / b))]
        odds = F.aggregate(slots, F.lit(math.log(self.share / (1 - self.share))), lambda a, x: a + F.get(F.lit(ratios), x))
        return 1 / (1 + F.exp(-odds))

    def update(self, patterns: DataFrame) -> float:
        """One pass of EM over patterns (slots, n); the largest change of a parameter."""
        seen = patterns.select("n", self.posterior(F.col("slots")).alias("p"), F.explode(F.concat("slots", F.array(F.lit(-1)))).alias("slot"))
        sums = {r["slot"]: r for r in seen.groupBy("slot").agg(
            F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad")).collect()}
        of = lambda slot, k: sums[slot][k] if slot in sums else 0.0
        extra, moved = PRIOR_WEIGHT * (of(-1, "good") + of(-1, "bad")), 0.0
        for k in START:
            for j, before in enumerate(self.bad_vote[k]):
                now = (of(2 * j + 1, k) + extra * START[k]) / (of(2 * j, k) + of(2 * j + 1, k) + extra)
                moved, self.bad_vote[k][j] = max(moved, abs(now - before)), now
        now = (of(-1, "good") + extra * START_SHARE) / (of(-1, "good") + of(-1, "bad") + extra)
        moved, self.share = max(moved, abs(now - self.share)), now
        return moved


def fit(voted: DataFrame, n_rules: int) -> Model:
    """EM over the vote patterns of all rows of ``voted`` (slots)."""
    model = Model(n_rules)
    patterns = stage(voted.groupBy("slots").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote_patterns")
    if patterns.isEmpty():
        return model
    for _ in range(PASSES):
        if model.update(patterns) < TOLERANCE:
            return model
    raise RuntimeError(f"EM still moves after {PASSES} passes")


def judge(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of the counts, votes, posterior and verdict; and that column's name.

    Counts are made once and staged together with the input's columns.
    """
    name = fresh(docs, "quality_")
    q = F.col(name)
    of = votes(q)
    staged = stage(docs.withColumn(name, counts(F.col(text))).withColumn(name, F.struct(
        f"{name}.*", F.struct(*[v.alias(r) for r, v in of.items()]).alias("votes"), slots(of).alias("slots"))), "quality")
    p = fit(staged.select(f"{name}.slots"), len(of)).posterior(q["slots"])
    failed = base_failed(q)
    return staged.withColumn(name, F.struct(
        f"{name}.*", p.alias("p_good"), failed.alias("base_failed"), (~failed & (p >= THRESHOLD)).alias("kept"))), name


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with the columns that came in."""
    judged, name = judge(docs, text)
    return judged.where(F.col(name)["kept"]).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = docs.select("doc_id", counts(F.col("text")).alias("q"))
    of = votes(F.col("q"))
    # the counts are staged, not the text
    staged = stage(counted.select("doc_id", "q.*", F.struct(*[v.alias(r) for r, v in of.items()]).alias("votes"), slots(of).alias("slots")), "quality")
    p = fit(staged, len(of)).posterior(F.col("slots"))
    failed = base_failed({c: F.col(c) for c in ("n_words", "n_repeat_words")})
    return staged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (p >= THRESHOLD)).alias("kept"), p.alias("p_good"), "votes")
