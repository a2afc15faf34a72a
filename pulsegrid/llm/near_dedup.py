"""Near-duplicate groups of documents: SuperMinHash signatures, banding, verification on full shingle sets, components.

1. Every text becomes the set of its five-word shingles (64-bit hashes) and a SuperMinHash signature: each shingle deals
   its ranks 0, 1, 2 ... to positions in an order of its own, and a position keeps the least value; a text is done as
   soon as no later rank can lower any position. Equal sets are one class, whose smallest id stands for it.
2. The signature is cut in ``BANDS`` bands of ``ROWS`` values. Classes that agree on a band share a bucket; with the
   defaults, a pair at similarity 0.75 shares none with probability 2e-5. Within a bucket each member is compared with
   the smallest one only, so that pairs grow as the members do, however large a bucket is.
3. Pairs whose signatures agree too little (4 standard errors under the threshold) go; the others are confirmed by the
   sizes of the intersection and union of their full sets.
4. Components of the confirmed links are found by label propagation with pointer jumping. A bucket whose members are
   in several components is looked at again: its members of different components are compared with each other, the
   largest component's in one copy, by signatures and then by full sets; links that join components are added, and
   components made again.

Sets are shipped for classes that share a bucket only, in streams sorted by pivot; a pivot with many members is
dealt out over several streams. Nothing but counts comes to the driver.

Cases: null, empty and blank texts have no shingles, link with nothing and are their own component. A text of fewer
than five words is one shingle. Rows that share an id count as one document: what one of them links to, all do. Rows
without an id link with nothing; their component is null and they are kept. An empty table gives an empty result.
Column names of the input don't matter: only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, sent_if_small, stage

WIDTH = 5
THRESHOLD = (75, 100)
BANDS, ROWS = 40, 5
POSITIONS = BANDS * ROWS
#: Bytes of the signature that agree at least for a pair to be confirmed: 0.75 less 4 standard errors.
LEAST_AGREEING = int(POSITIONS * (0.75 - 4 * (0.75 * 0.25 / POSITIONS) ** 0.5))
#: Members a stream takes for one pivot, and classes in a block of the second look.
STREAM, BLOCK = 256, 256
#: Equal sets from so many rows on are looked up in a table of their own.
COPIES = 200
#: Shingles whose signatures are made together, and word hashes a task remembers.
TOGETHER, MEMORY = 1 << 15, 400_000

_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMORY:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. Words are split at ASCII white space and lower-cased in A-Z, as bytes do."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    k = min(WIDTH, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * _M + h[j:j + n]
    return np.unique(mix(out))


def signatures(sets: list[np.ndarray], m: int = POSITIONS) -> np.ndarray:
    """SuperMinHash signatures of sets, a row each: rank in the top bits, its random part below; empty sets keep the maximum."""
    sig = np.full((len(sets), m), np.uint64(2 ** 64 - 1))
    if not sets:
        return sig
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, order = sig.reshape(-1), None
    for j in range(m):
        if j:
            # the largest value decides whether this rank can lower any
            going = sig.max(axis=1) >= np.uint64(j << 53)
            keep = going[owner]
            if not keep.any():
                break
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(keep.sum()), 1))
                x, owner, first = x[keep], owner[keep], first[keep]
                order[np.arange(len(x)), first] = 0
            elif not keep.all():
                x, owner, order = x[keep], owner[keep], order[keep]
        with np.errstate(over="ignore"):
            r = mix(x + np.uint64((2 * j + 1) * int(_M) & (2 ** 64 - 1)))
            at = mix(x + np.uint64((2 * j + 2) * int(_M) & (2 ** 64 - 1)))
        k = (np.uint64(j) + at % np.uint64(m - j)).astype(np.int64)
        if order is None:
            place = first = k
        else:
            rows = np.arange(len(x))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
        np.minimum.at(flat, owner * m + place, (r >> np.uint64(11)) | np.uint64(j << 53))
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One hash for each band, the band's number mixed in."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _M, (len(sig), BANDS)).copy()
    for j in range(ROWS):
        out = mix(out * _A + parts[:, :, j])
    return out


def _key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch) of every row of (doc_id, text); the last three are null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def batch_of(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            sig = signatures(sets)
            bands, low = bands_of(sig).astype(np.int64), (sig & np.uint64(255)).astype(np.uint8)
            full = [len(s) > 0 for s in sets]
            pick = lambda values: [v if f else None for v, f in zip(values, full, strict=True)]
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(pick(_key(s) for s in sets), pa.binary()),
                pa.array(pick(list(b) for b in bands), pa.list_(pa.int64())), pa.array(pick(x.tobytes() for x in low), pa.binary())], schema=SKETCHED)

        for batch in batches:
            ids, sets, n = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), hashes)
                ids.append(doc_id)
                sets.append(s)
                n += len(s)
                if n >= TOGETHER:
                    yield batch_of(ids, sets)
                    ids, sets, n = [], [], 0
            if ids:
                yield batch_of(ids, sets)

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of rows (doc_id, text): sorted 64-bit hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, out, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                out.append(shingles(text.as_py(), hashes).tobytes())
                size += len(out[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "shingles"])
                    ids, out, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles binary")


def _similar(inter: int, n_a: int, n_b: int) -> bool:
    return THRESHOLD[1] * inter >= THRESHOLD[0] * (n_a + n_b - inter)


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a similarity over the threshold."""
    one = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    sized = pairs.join(two, "b").join(one, "a").where(
        F.least("n_a", "n_b") * THRESHOLD[1] >= F.greatest("n_a", "n_b") * THRESHOLD[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, POSITIONS) for k in ("sketch_a", "sketch_b"))
                yield batch.filter(pa.array((x == y).sum(axis=1) >= LEAST_AGREEING)).select(["a", "b"])

    return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar.

    Sets of b travel to the streams of their pivots a; a pivot's own set heads each of its streams.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STREAM).cast("int").alias("streams"))
    members = pairs.join(size, "a").join(sets.withColumnRenamed("doc_id", "b"), "b").select(
        "a", F.pmod(F.xxhash64("b"), F.col("streams")).cast("int").alias("stream"), "b", "shingles")
    pivots = size.join(sets.withColumnRenamed("doc_id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), F.lit(None).cast("bigint").alias("b"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, None
        for batch in batches:
            out = []
            for a, stream, b, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                s = np.frombuffer(data.as_py(), np.uint64)
                if b is None:
                    key, pivot = (a, stream), s
                    continue
                if key != (a, stream):
                    raise ValueError("a stream without its pivot")
                few, many = (s, pivot) if len(s) <= len(pivot) else (pivot, s)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                if _similar(int((many[at] == few).sum()), len(s), len(pivot)):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], ["a", "b"])

    streams = members.unionByName(pivots).repartition("a", "stream").sortWithinPartitions("a", "stream", F.col("b").asc_nulls_first())
    return streams.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable over links (a, b), for every vertex that has one."""
    edges = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("l")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("near"))
        nearer = labels.join(seen, "v").select("v", F.col("l").alias("was"), F.least("l", "near").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("l").alias("beyond"))
        moved = stage(nearer.join(jump, "l", "left").select("v", "was", F.least("l", F.coalesce("beyond", "l")).alias("l")), "labels")
        changed = moved.where("l <> was").limit(1).count()
        labels = moved.select("v", "l")
        if not changed:
            return labels.withColumnRenamed("l", "component")


def _cross_pairs(group: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """For members (rep, component, n_shingles, sketch, block, ...) of a bucket: each with the later ones of other components that may be similar."""
    comp, n, block = (np.array([g[k] for g in group], np.int64) for k in (1, 2, 4))
    sketch = np.frombuffer(b"".join(g[3] for g in group), np.uint8).reshape(-1, POSITIONS)
    mixed = len(set(block.tolist())) > 1
    for i in range(len(group) - 1):
        ok = (comp[i + 1:] != comp[i]) & (np.minimum(n[i + 1:], n[i]) * THRESHOLD[1] >= np.maximum(n[i + 1:], n[i]) * THRESHOLD[0])
        if mixed:
            ok &= block[i + 1:] != block[i]
        near = np.flatnonzero(ok) + i + 1
        if len(near):
            yield i, near[(sketch[near] == sketch[i]).sum(axis=1) >= LEAST_AGREEING]


def _streamed(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` over each run of rows that agree on their first three values."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if len(group) > 1:
                    yield work(key, group)
                key, group = row[:3], []
            group.append(row[3:])
    if len(group) > 1:
        yield work(key, group)


MET = "bucket bigint, i int, j int, rep bigint, component bigint, n_shingles bigint, sketch binary, block int"


def second_look(members: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of (v, component) that share a bucket of (bucket, rep), as a forest for each pair of blocks.

    The members of a bucket's largest component stay where they are: such a component comes once, whatever number of buckets it leads, dealt
    to blocks of members, and the other members of these buckets visit its blocks. Others that share a bucket with members of a third component
    meet those in blocks of the bucket. Sketches tell which may be similar to one of another component; only these get their full sets, which confirm.
    """
    placed = members.join(comps.select(F.col("v").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count(F.lit(1)).alias("k"),
                                         (F.sum("n") - F.max("n")).alias("others")).where("k > 1")
    inside = stage(placed.join(open_, "bucket"), "open_buckets")

    stay = inside.where("component = main").select("main", "rep", "component").distinct()
    blocks = stay.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    stay = stay.join(blocks, "main").select(F.col("main").alias("bucket"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("i"),
                                            F.lit(-1).alias("j"), "rep", "component", F.lit(0).alias("block"))
    visit = inside.where("component <> main").select("main", "rep", "component").distinct().join(blocks, "main").select(
        F.col("main").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(-1).alias("j"), "rep", "component", F.lit(1).alias("block"))
    # each block of others meets itself and every other one once, at (lower, higher)
    third = inside.where("component <> main AND k > 2").withColumn("blocks", F.ceil(F.col("others") / BLOCK).cast("int"))
    third = third.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "component", "block")
    met = stay.unionByName(visit).unionByName(third).join(classes.select("rep", "n_shingles", "sketch"), "rep").select(
        "bucket", "i", "j", "rep", "component", "n_shingles", "sketch", "block")
    names = [x.split()[0] for x in MET.split(", ")]

    def concerned(key: tuple, group: list[tuple]) -> pa.RecordBatch:
        own: set[int] = set()
        for i, near in _cross_pairs(group):
            if len(near):
                own.add(i)
                own.update(near.tolist())
        out = [(*key, *group[i]) for i in sorted(own)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    def linked(key: tuple, group: list[tuple]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        full, out = [np.frombuffer(g[5], np.uint64) for g in group], []
        for i, near in _cross_pairs(group):
            for j in near.tolist():
                x, y = root(group[i][1]), root(group[j][1])
                if x == y:
                    continue
                few, many = sorted((full[i], full[j]), key=len)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                if _similar(int((many[at] == few).sum()), len(few), len(many)):
                    parent[max(x, y)] = min(x, y)
                    out.append((group[i][0], group[j][0]))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], ["a", "b"])

    def deal(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    few = stage(deal(met).mapInArrow(lambda it: _streamed(it, concerned), MET), "second_look")
    with_sets = few.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select(*names, "shingles")
    return deal(with_sets).mapInArrow(lambda it: _streamed(it, linked), "a bigint, b bigint")


def group_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = stage(sketch_documents(rows), "sketches")
    named = sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    equal = ["set_key", "n_shingles"]
    sets_of_rows = stage(named.groupBy(*equal).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets_of_rows")
    # sets with many copies are joined apart, so that none of them meets in one task
    hot = sent_if_small(sets_of_rows.where(F.col("copies") > COPIES).select(*equal, "rep"))
    marked = named.select("doc_id", *equal).join(hot, equal, "left")
    heads = marked.where("rep IS NOT NULL").unionByName(
        marked.where("rep IS NULL").drop("rep").join(sets_of_rows.where(F.col("copies") <= COPIES).select(*equal, "rep"), equal).select("doc_id", *equal, "rep"))
    owners = stage(heads.select("doc_id", "rep").distinct(), "owners")

    own = named.join(owners.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    classes = stage(own.groupBy(F.col("doc_id").alias("rep"), "n_shingles", "set_key").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot <> last").select("bucket", "pivot")
    members = stage(banded.join(buckets, "bucket").distinct(), "members")
    pairs = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()

    sharing = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = stage(shingle_sets(rows.join(sharing, "doc_id", "left_semi")), "shingle_sets")
    links = stage(confirmed(stage(promising(pairs, classes), "pairs"), sets), "links")
    # ids that stand for a class, and rows of one id with different sets
    same = owners.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    comps = components(links)
    found = stage(second_look(members.select("bucket", "rep").distinct(), comps, classes, sets), "more_links")
    comps = components(links.union(found).union(same))
    return sketched.select("doc_id", "n_shingles").join(comps.withColumnRenamed("v", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with the columns that came in."""
    name = fresh(docs, "gone_")
    gone = stage(group_documents(docs, doc_id, text).where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti").select(*docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# every pair of documents by shared shingles, then reachability
OP6_SQL = r"""
WITH RECURSIVE
l AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') AS l FROM documents),
w AS (SELECT doc_id, [x FOR x IN l IF x <> ''] AS w FROM l),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
h AS (SELECT doc_id, md5(array_to_string(s, ' ')) AS s FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(u) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""
