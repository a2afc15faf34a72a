"""Mixing sources to target weights: iterative proportional fitting over cells, then Bernoulli draws by cell.

A cell is one combination of the margins' values (source, language, topic, ...). Tokens are counted by cell, the
cells' weights are raked until every margin has its target share, and a document of a cell is drawn with
probability min(1, scale x target tokens / tokens); ``scale`` is raised so that full cells are made up for and the
expected tokens meet the budget. Draws compare a hash of the row with that probability, so that a rerun or
another partitioning draws the same rows. Documents are read twice and never shuffled by a margin: cells are
summed before the shuffle, and their probabilities are joined back (Spark broadcasts them if they are small,
and splits the hot keys of a sort-merge join otherwise).

Cases: null values of a margin are a value of their own. A text without words has no tokens; a cell without
tokens keeps its documents (they cost nothing). Repeated rows get the same draw. An empty table stays empty.
Columns of the input whose names clash with inner ones are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, let, stage, words_of

#: Defaults of the registered query: targets are the present shares to this power, rescaled; below 1 it flattens.
FLATTEN = 0.5
#: The budget, as a share of all tokens.
BUDGET = 0.5
SEED = 20240601
#: Raking ends when all margins are met to TOLERANCE, or, where cells can't meet them all, when no cell's share of the
#: weight moves by SETTLED in a pass. More passes than PASSES are an error.
PASSES = 300
TOLERANCE = 1e-3
SETTLED = 1e-6


def form_of(text: Column) -> Column:
    """What kind of text it is, from its first lines' look; stands in for a topic where no topic column is given."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(F.lower(text), F.lit("license")), "license")
            .when(F.contains(text, F.lit("!! ")), "shouting").when(F.length(text) < 1000, "short").otherwise("prose"))


def n_tokens(text: Column) -> Column:
    return let(words_of(text), lambda w: F.size(w)).cast("long")


def cells_of(rows: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Tokens and documents of every cell."""
    return rows.groupBy(*keys).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("docs"))


def flattened(cells: DataFrame, key: str, power: float = FLATTEN) -> DataFrame:
    """Target shares of a margin: the present shares to a power, rescaled to sum 1; columns key, share."""
    name = fresh(cells, "sum_")
    sums = cells.groupBy(key).agg(F.sum("tokens").alias(name)).where(F.col(name) > 0).select(key, F.pow(name, F.lit(power)).alias(name))
    total = sums.agg(F.sum(name)).first()[0] or 1.0
    return sums.select(key, (F.col(name) / total).alias("share"))


def rake(cells: DataFrame, keys: list[str], targets: list[DataFrame]) -> DataFrame:
    """``cells`` with a column weight, whose sums by every key have the target shares as nearly as cells allow.

    A target is a frame of (key, share). Values without a target get none; values without cells are left out and
    the others' shares rescaled. State is one row a cell, staged after every pass over all margins.
    """
    cells = stage(cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double")), "cells")
    present = [stage(t.join(cells.groupBy(k).agg(F.count(F.lit(1)).alias("n_")), t[k].eqNullSafe(cells[k]), "left_semi"), "margin")
               for k, t in zip(keys, targets, strict=True)]
    goals = []
    for t in present:
        total = t.agg(F.sum("share")).first()[0] or 1.0
        goals.append(t.withColumn("share", F.col("share") / total))
    for _ in range(PASSES):
        cells = cells.withColumn("was_", F.col("weight"))
        for k, goal in zip(keys, goals, strict=True):
            sums = cells.groupBy(F.col(k).alias("k_")).agg(F.sum("weight").alias("w_"))
            goal = goal.select(F.col(k).alias("g_"), "share")
            ratio = sums.join(goal, F.col("k_").eqNullSafe(F.col("g_")), "left").select(
                "k_", (F.coalesce("share", F.lit(0.0)) / F.col("w_")).alias("f_"))
            cells = cells.join(ratio, F.col(k).eqNullSafe(F.col("k_"))).withColumn("weight", F.col("weight") * F.col("f_")) \
                .withColumn(f"d_{k}", F.abs(F.col("f_") - 1)).drop("k_", "f_")
        worst = [f"d_{k}" for k in keys]
        cells = stage(cells, "cells")
        missed, moved = cells.agg(F.max(F.greatest(*worst, F.lit(0.0))), F.max(F.abs(F.col("weight") - F.col("was_")))).first()
        cells = cells.drop(*worst, "was_")
        if missed is None or missed < TOLERANCE or moved < SETTLED:
            return cells
    raise RuntimeError(f"raking still moves after {PASSES} passes")


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` with a column probability: expected tokens are ``budget`` of all, in proportion to weight where cells last."""
    total, weights = cells.agg(F.sum("tokens"), F.sum("weight")).first()
    if not total or not weights:
        return cells.withColumn("probability", F.lit(1.0))
    aim, scale = budget * total, budget * total / weights
    while True:  # each step fills at least one more cell, or ends
        full = F.col("weight") * scale >= F.col("tokens")
        spent, rest = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)),
                                F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not rest or aim <= spent:
            break
        now = (aim - spent) / rest
        if now <= scale * (1 + 1e-9):
            break
        scale = now
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * scale / F.col("tokens")))


def draw(*parts: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the values of a row only."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


def probabilities(rows: DataFrame, keys: list[str], targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """One row a cell of ``rows`` (the keys and tokens): c_<key>, cell_share, probability.

    ``targets``: for some keys a frame of (value, share); the others get their present shares, flattened.
    """
    cells = stage(cells_of(rows, keys, F.col("tokens")), "cells")
    goals = [targets[k].toDF(k, "share") if targets and k in targets else flattened(cells, k) for k in keys]
    return stage(calibrate(rake(cells, keys, goals), budget).select(
        *[F.col(k).alias(f"c_{k}") for k in keys], F.col("weight").alias("cell_share"), "probability"), "probabilities")


def mix(docs: DataFrame, margins: dict[str, Column], targets: dict[str, DataFrame] | None = None, budget: float = BUDGET,
        row_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of cell, tokens, share, probability and drawn; and that column's name."""
    name, keys = fresh(docs, "mix_"), list(margins)
    rows = docs.select(F.struct(*docs.columns).alias("row_"), F.struct(
        *[m.cast("string").alias(k) for k, m in margins.items()], n_tokens(F.col(text)).alias("tokens")).alias("cell_"))
    chosen = probabilities(rows.select("cell_.*"), keys, targets, budget)
    p = F.coalesce("probability", F.lit(1.0))
    joined = rows.join(chosen, _all([F.col("cell_")[k].eqNullSafe(F.col(f"c_{k}")) for k in keys]), "left")
    return joined.select("row_.*", F.struct(
        "cell_.*", F.coalesce("cell_share", F.lit(0.0)).alias("cell_share"), p.alias("probability"),
        (draw(F.col("row_")[row_id].cast("string")) < p).alias("drawn")).alias(name)), name


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def document_margins(text: str = "text") -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": form_of(F.col(text))}


def sample_mix(docs: DataFrame) -> DataFrame:
    """The drawn documents, with the columns that came in."""
    out, col = mix(docs, document_margins())
    return out.where(F.col(col)["drawn"]).select(*docs.columns)


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, tokens, probability and whether it is drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    narrow = docs.select("doc_id", "source", "lang", form_of(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("tokens"))
    rows = stage(narrow, "mix")
    keys = ["source", "lang", "topic"]
    chosen = probabilities(rows, keys)
    p = F.coalesce("probability", F.lit(1.0))
    return rows.join(chosen, _all([F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]), "left").select(
        "doc_id", *keys, "tokens", F.coalesce("cell_share", F.lit(0.0)).alias("cell_share"), p.alias("probability"),
        (draw(F.col("doc_id").cast("string")) < p).alias("drawn"))
