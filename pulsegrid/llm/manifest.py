"""A Merkle manifest of a table: leaves, levels of runs of eight, subroots, a root, and a recursive climb that checks leaves.

Building: a row's leaf is the SHA-256 of its fields. Leaves are numbered in groups (one tree each, in the order of the
group's value, null first) and every eight consecutive nodes become a run, level by level, until one node is left, the
subroot; the subroots are the leaves of a last tree, whose node is the root. Each level is one aggregation over an
eighth of the rows of the one below. A run is one row: the digests of its nodes on end, and the run that its own digest is a
part of. The levels together are the manifest.

Checking: a recursive query starts from a digest for every leaf and joins it with its run; the run's other digests are
appended as the step's siblings, the fold of all goes on to the parent. Runs with over a ``HOT``-th of all leaves below
(at most ``HOT`` on each level) are climbed in a second recursive query that sends them to every task; so no
join key of the first has more rows than that, and no leaf is shuffled in the second.

Cases: null fields have their own mark; null group values form a group of their own, before all others. Rows with equal
order values are ordered by leaf; equal rows have equal leaves, and each keeps its place. Null order values come first.
A single row is its own root, its proof is empty. An empty table has no rows and no root. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import numbered, sent_if_small, stage

FAN = 8
#: Runs with more than this share of the leaves below them are sent to every task.
HOT = 512
#: The number of the tree of subroots.
TOP = -1
NODE = ["tree", "level", "pos"]


@dataclass
class Manifest:
    """``leaves``: (leaf_no, order, group, digest, tree, level, pos, ordinal); ``runs``: (tree, level, pos, blob, digest, span, parent_*,
    ordinal); ``trees``: (tree, subroot); ``root``: bytes, None if there are no leaves."""

    leaves: DataFrame
    runs: DataFrame
    trees: DataFrame
    root: bytes | None
    n_leaves: int


def fields_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of fields: ``-`` for null, else the UTF-8 length, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(digests: Column) -> Column:
    """The node above digests that stand on end."""
    return F.unhex(F.sha2(hex_of(digests), 256))


def grow(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The runs of trees whose leaves are ``nodes`` (tree, pos, digest, span, size), a staged table a level.

    ``size`` is the number of nodes of the tree on that level, ``most`` the largest of them.
    """
    levels = []
    while most > 1:
        above = nodes.where(F.col("size") > 1).groupBy("tree", F.expr(f"pos div {FAN}").alias("pos")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own"), F.sum("span").alias("span"),
            F.expr(f"(first(size) + {FAN - 1}) div {FAN}").alias("size"))
        blob = F.aggregate("own", F.lit(b""), lambda s, x: F.concat(s, x["digest"]))
        above = above.select("tree", F.lit(len(levels) + 1).alias("level"), "pos", blob.alias("blob"), "span", "size").withColumn("digest", fold(F.col("blob")))
        nodes = stage(above, "manifest_level")
        levels.append(nodes)
        most = -(-most // FAN)
    return levels


def build(rows: DataFrame, order: str, group: str, digest: str, keep: Sequence[str] = ()) -> Manifest:
    """The manifest of ``rows``: ``digest`` is the leaf, trees are the values of ``group``, leaves ascend by ``order``."""
    spark = rows.sparkSession
    spread = rows.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(digest).alias("digest"), *keep)
    leaves = numbered(spread, [F.asc_nulls_first("group"), F.asc_nulls_first("order"), F.col("digest")], "leaf_no")
    trees = leaves.groupBy(F.col("group").alias("value")).agg(F.min("leaf_no").alias("first"), F.count("*").alias("size"))
    trees = stage(numbered(stage(trees, "manifest_groups"), [F.asc_nulls_first("value")], "tree"), "manifest_trees")
    n_leaves, n_trees, most = trees.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    leaves = stage(leaves.join(sent_if_small(trees), F.col("group").eqNullSafe(F.col("value"))).select(
        "leaf_no", "order", "digest", *keep, "tree", (F.col("leaf_no") - F.col("first")).alias("pos"), "size", F.lit(1).cast("long").alias("span")), "manifest_leaves")

    levels = grow(leaves.select("tree", "pos", "digest", "span", "size"), most)
    subroots = leaves.where("size = 1").select("tree", "digest", "span")
    for level in levels:
        subroots = subroots.unionByName(level.where("size = 1").select("tree", "digest", "span"))
    subroots = stage(subroots, "manifest_subroots")
    top = grow(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", "span", F.lit(n_trees).alias("size")), n_trees)
    root = (top[-1] if top else subroots).first()

    def linked(nodes: DataFrame, level: Column) -> DataFrame:
        """Where a node's digest goes: the run above, or for the last of a tree the tree of subroots."""
        inner, last = F.col("size") > 1, (F.col("tree") != TOP) & F.lit(n_trees > 1)
        return nodes.withColumns({
            "parent_tree": F.when(inner, F.col("tree")).when(last, F.lit(TOP).cast("long")),
            "parent_level": F.when(inner, level + 1).when(last, F.lit(1)),
            "parent_pos": F.when(inner, F.expr(f"pos div {FAN}")).when(last, F.expr(f"tree div {FAN}")),
            "ordinal": F.when(inner, F.expr(f"pos % {FAN}")).when(last, F.expr(f"tree % {FAN}")).cast("int")})

    runs = leaves.select("tree", F.lit(0).alias("level"), "pos", F.lit(b"").alias("blob"), "span", "size", "digest").limit(0)
    for level in [*levels, *top]:
        runs = runs.unionByName(level)
    return Manifest(linked(leaves, F.lit(0)), linked(runs, F.col("level")), subroots.select("tree", F.col("digest").alias("subroot")),
                    bytes(root["digest"]) if root else None, n_leaves)


CLIMB = """
WITH RECURSIVE climb(leaf_no, step, folded, siblings, tree, level, pos, ordinal, more) AS (
  SELECT leaf_no, step, folded, siblings, tree, level, pos, ordinal, more FROM {start}
  UNION ALL
  SELECT c.leaf_no, c.step + 1,
         unhex(sha2(lower(hex(concat(substring(r.blob, 1, 32 * c.ordinal), c.folded, substring(r.blob, 32 * c.ordinal + 33)))), 256)),
         if({kept}, concat(substring(r.blob, 1, 32 * c.ordinal), substring(r.blob, 32 * c.ordinal + 33)), NULL),
         r.parent_tree, r.parent_level, r.parent_pos, r.ordinal, r.more
  FROM climb c JOIN {runs} r ON c.tree = r.tree AND c.level = r.level AND c.pos = r.pos
  WHERE c.more
)
SELECT * FROM climb
"""


def climb(start: DataFrame, runs: DataFrame, kept: bool = True) -> DataFrame:
    """The starts, and a row for every step above them, with the step's siblings if they are to be kept; rows climb while ``more`` holds."""
    return start.sparkSession.sql(CLIMB, start=start, runs=runs, kept=kept)


def check(manifest: Manifest, claimed: str) -> DataFrame:
    """(leaf_no, proof, folded) for every leaf: the siblings on its way, on end, and the root that ``claimed`` leads to.

    ``claimed`` is a column of the leaves with the digest to start from. The second climb folds every leaf but doesn't carry siblings: those
    above a place in the hot runs are the same for all leaves below, so a third climb collects them once a place (``8 HOT`` a level at most).
    """
    spark = manifest.leaves.sparkSession
    parent = [f"parent_{c}" for c in NODE]
    runs = manifest.runs
    crown = stage(runs.where(F.col("span") * HOT > manifest.n_leaves), "manifest_crown")
    above = F.broadcast(crown.select(*[F.col(c).alias(p) for c, p in zip(NODE, parent, strict=True)], F.lit(True).alias("hot")))
    hot_runs = F.broadcast(crown.withColumn("more", F.col("parent_tree").isNotNull()))
    climbing = ["leaf_no", "step", "folded", "siblings", *NODE, "ordinal", "more"]

    def flagged(nodes: DataFrame) -> DataFrame:
        return nodes.join(above, parent, "left").withColumn("more", F.col("hot").isNull() & F.col("parent_tree").isNotNull())

    low = flagged(runs.where(F.col("span") * HOT <= manifest.n_leaves))
    start = flagged(manifest.leaves).select(
        "leaf_no", F.lit(0).alias("step"), F.col(claimed).alias("folded"), F.lit(b"").alias("siblings"),
        *[F.col(p).alias(c) for c, p in zip(NODE, parent, strict=True)], "ordinal", "more")
    limit = "spark.sql.cteRecursionRowLimit"
    held = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the depth bounds the recursion, not the number of rows
    try:
        lower = stage(climb(start, low), "manifest_climb")
        reached = lower.where("NOT more").withColumns({"more": F.col("tree").isNotNull(), "siblings": F.lit(None).cast("binary")}).select(*climbing)
        folded = stage(climb(reached, hot_runs, kept=False).where("NOT more").select("leaf_no", "folded"), "manifest_folded")
        places = reached.where("more").groupBy(*NODE, "ordinal").agg(F.min("leaf_no").alias("leaf_no"))
        places = stage(places, "manifest_places")
        up = climb(places.select("leaf_no", F.lit(0).alias("step"), F.lit(b"").alias("folded"), F.lit(b"").alias("siblings"), *NODE, "ordinal", F.lit(True).alias("more")), hot_runs)
        ways = stage(_proofs(up).join(places, "leaf_no").select(*NODE, "ordinal", F.col("proof").alias("upper")), "manifest_ways")
    finally:
        spark.conf.set(limit, held)
    mine = _proofs(lower, F.max(F.struct("step", *NODE, "ordinal")).alias("last")).select("leaf_no", "proof", *[F.col(f"last.{c}") for c in [*NODE, "ordinal"]])
    whole = mine.join(sent_if_small(ways), [*NODE, "ordinal"], "left").join(folded, "leaf_no")
    return whole.select("leaf_no", F.concat("proof", F.coalesce("upper", F.lit(b""))).alias("proof"), "folded")


def _proofs(steps: DataFrame, *more: Column) -> DataFrame:
    """The siblings of all steps of a leaf, on end."""
    way = F.array_sort(F.collect_list(F.struct("step", "siblings")))
    return steps.groupBy("leaf_no").agg(F.aggregate(way, F.lit(b""), lambda s, x: F.concat(s, x["siblings"])).alias("proof"), *more)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    digest = fields_digest([F.col(c) for c in FIELDS])
    tampered = fields_digest([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    rows = docs.select("doc_id", "lang", digest.alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered).alias("tampered"))
    manifest = build(rows.withColumn("claimed", F.coalesce("tampered", "leaf")), "doc_id", "lang", "leaf", ["claimed"])
    checked = check(manifest, "claimed")
    root = F.lit(None if manifest.root is None else manifest.root.hex()).cast("string")
    found = manifest.leaves.select("leaf_no", "tree", F.col("order").alias("doc_id"), F.col("digest").alias("leaf")).join(checked, "leaf_no")
    return found.join(sent_if_small(manifest.trees), "tree").select(
        "doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(hex_of(F.col("proof")), 256).alias("proof_sha256"), hex_of(F.col("folded")).alias("folded_root"), (hex_of(F.col("folded")) == root).alias("verified"))


# crc32 of the decimal id: bytes into bits by the polynomial 0xEDB88320; unsigned.
OP12_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, lang, source, n_chars, text,
         list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
             lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS inverted
  FROM documents),
marked AS (SELECT *, xor(inverted, 4294967295) % 3 = 0 AS hit FROM base),
leaves AS (
  SELECT doc_id, lang,
    sha256(concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || CAST(doc_id AS VARCHAR), '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
      coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-'),
      coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS leaf,
    CASE WHEN hit THEN sha256(concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || CAST(doc_id AS VARCHAR), '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
      coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-'),
      coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) END AS tampered
  FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
low(tree, k, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, k + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM low WHERE n > 1 GROUP BY tree, k, pos // 8),
subroots AS (SELECT tree, h, k FROM low WHERE n = 1),
top(k, pos, h, n) AS (
  SELECT 0, tree, h, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT k + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY k, pos // 8),
nodes AS (SELECT tree, k, pos, h, n FROM low UNION ALL SELECT -1, k, pos, h, n FROM top),
climb(doc_id, leaf, tree, home, k, pos, folded, proof) AS (
  SELECT doc_id, leaf, tree, tree, 0, pos, coalesce(tampered, leaf), '' FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.home, c.k + 1, c.pos // 8,
         sha256(string_agg(CASE WHEN s.pos = c.pos THEN c.folded ELSE s.h END, '' ORDER BY s.pos)),
         any_value(c.proof) || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos <> c.pos), '')
  FROM (SELECT c.* FROM climb c JOIN nodes o ON o.tree = c.tree AND o.k = c.k AND o.pos = c.pos WHERE o.n > 1
        UNION ALL
        SELECT c.doc_id, c.leaf, -1, c.home, 0, c.home, c.folded, c.proof
        FROM climb c JOIN nodes o ON o.tree = c.tree AND o.k = c.k AND o.pos = c.pos JOIN top t ON t.k = 0 AND t.pos = c.home WHERE o.n = 1 AND c.tree <> -1 AND t.n > 1) c
  JOIN nodes s ON s.tree = c.tree AND s.k = c.k AND s.pos // 8 = c.pos // 8
  GROUP BY c.doc_id, c.leaf, c.tree, c.home, c.k, c.pos, c.folded)
SELECT c.doc_id, c.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.h AS verified
FROM climb c JOIN subroots s ON s.tree = c.home CROSS JOIN (SELECT h FROM top WHERE n = 1) r
WHERE (c.tree = -1 AND c.k = (SELECT max(k) FROM top)) OR (c.tree <> -1 AND c.k = s.k AND (SELECT max(k) FROM top) = 0)
"""
