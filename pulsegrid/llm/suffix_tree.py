"""LM scoring by a probabilistic suffix tree over the bytes of normalised texts, beside a unigram base.

A text is its words (lower-cased in A-Z) joined by blanks, and an end. The tree's states are contexts of up to ``DEPTH``
bytes. Training counts every (context, next byte) of all training texts: tasks count runs of ``DEPTH`` + 1 bytes, buckets
of runs sum them, and shorter contexts are sums of longer ones. A context stays if it occurs ``LEAST_COUNT`` times, however large
the corpus, and passes a divergence test against its parent (the context without its oldest byte): the gain in log-likelihood,
its count times the Kullback-Leibler divergence, must pay ``GAIN`` nats for each next byte seen. Suffixes of what stays stay too.
Distributions are smoothed by absolute discounting: what a state doesn't tell of gets the discounts' mass in the parent's
proportions; scoring uses the longest suffix that is a state.

The whole tree is a table and stays in Spark. Tasks get a cache of what it says of frequent runs (at most
``CACHED_RUNS``); other runs of a text are joined with the table, (text, run) pairs already summed, so the cache doesn't
change results. Likewise words of at least ``LEAST_WORD`` of all tokens (at most 1 / LEAST_WORD of them) are looked
up in tasks; rarer ones are joined with the counts by hash.

Words are counted by 64-bit hashes. Cases: null, empty and blank texts have only the end. A null id counts as the empty
text for the fold. Without training texts all counts are 0, base scores 0 and bytes uniform. Repeated rows are scored
and counted as often as they occur. An empty table stays empty. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage
from pulsegrid.llm.token_files import slices_of

DEPTH = 6
LEAST_COUNT = 2
#: The most runs that tasks are given to look up; no bound on the model.
CACHED_RUNS = 3_000_000
LEAST_WORD = 2e-7
GAIN = 1.0
DISCOUNT = 0.5
FOLDS, HELD_OUT = 7, 2
#: Bytes a task looks at together, and runs or words it sums before passing them on.
TOGETHER, HELD_RUNS = 1 << 21, 1 << 21
#: Rows of a group that meets by two bytes of context.
GROUP = 20_000
#: Levels down to this one have few runs, which are copied to where longer ones are dealt.
SHORT = 3
END = 10  # a line feed, which no normalised text has
SYMBOLS = 256


def in_fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


#: Bytes as they count: A-Z lower, 0 for what separates words. No text has a byte of 255.
BYTES = np.arange(SYMBOLS, dtype=np.uint8)
BYTES[65:91] += 32
BYTES[0] = 255
BYTES[[9, 10, 11, 12, 13, 32]] = 0


def _codes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The run that ends at each of the ``lengths`` bytes from ``starts`` on; before each start are ``depth`` ends."""
    at = np.ones(len(data), bool)
    at[(starts[:, None] - 1 - np.arange(depth)).ravel()] = False
    out = np.zeros(len(data), np.uint64)
    for j in range(depth, -1, -1):
        out[depth:] = (out[depth:] << np.uint64(8)) | data[depth - j:len(data) - j].astype(np.uint64)
    return out[at]


def runs(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends at each byte and end of normalised texts, oldest byte first, as a number; and each text's number of runs."""
    pad = bytes([END]) * depth
    data = np.frombuffer(pad + (bytes([END]) * (depth + 1)).join(texts) + bytes([END]), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64) + 1
    return _codes(data, np.cumsum(lengths + depth) - lengths, lengths, depth), lengths


def read(texts: pa.Array, depth: int = DEPTH) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts on end, each text's number of them, and ``runs`` of the normalised texts; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    edges = offsets - offsets[0]
    inside = raw != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = edges[:-1][np.diff(edges) > 0]
    begins[starts] = inside[starts]
    kept, firsts = raw[inside], np.flatnonzero(begins)
    kept[kept == 255] = 0  # the byte itself, not what separates words
    kept_before = np.concatenate([[0], np.cumsum(inside)])
    bounds = np.append(kept_before[firsts], len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    first_word = np.searchsorted(firsts, edges)
    n_words = np.diff(first_word)
    lengths = np.diff(kept_before[edges]) + np.maximum(n_words - 1, 0) + 1
    begin = np.cumsum(lengths + depth) - lengths
    # a word moves by the ends and blanks before it
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    nth = np.arange(len(text_of)) - first_word[text_of]
    shift = (begin - kept_before[edges[:-1]])[text_of] + nth
    data = np.full(int((lengths + depth).sum()), END, np.uint8)
    data[np.repeat(shift, np.diff(bounds)) + np.arange(len(kept))] = kept
    later = nth > 0
    data[(bounds[:-1] + shift)[later] - 1] = 32
    return words, n_words, _codes(data, begin, lengths, depth), lengths


#: A number for each byte at each place of a word; a word's hash is their sum.
PLACES = 64
SUMMANDS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, (PLACES, SYMBOLS), np.uint64).ravel()


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words that have a byte or more; those of over ``PLACES`` bytes are hashed one by one."""
    import xxhash

    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.int64)
    data, starts, sizes = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0]:bounds[-1]], bounds[:-1] - bounds[0], np.diff(bounds)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    out = np.add.reduceat(SUMMANDS[(place % PLACES) * SYMBOLS + data], starts)
    for i in np.flatnonzero(sizes > PLACES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:starts[i] + sizes[i]].tobytes())
    return out.view(np.int64)


COUNTED = ["kind", "bucket", "keys", "ns"]
RUN, WORD, TEXT = 0, 1, 2


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class _Sums:
    """Numbers of keys, passed on when many distinct ones are held."""

    def __init__(self, kind: int, buckets: int):
        self.kind, self.buckets = kind, buckets
        self.keys: list[np.ndarray] = []
        self.ns: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.ns.append(n)
        self.held += len(k)
        if self.held > HELD_RUNS:
            k, n = _summed(np.concatenate(self.keys), np.concatenate(self.ns))
            self.keys, self.ns, self.held = [k], [n], len(k)
            if len(k) > HELD_RUNS // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        """A row a bucket, with its keys and their numbers."""
        if self.held:
            k, n = _summed(np.concatenate(self.keys), np.concatenate(self.ns))
            bucket = (((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.uint16 if self.buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            own, first = np.unique(bucket[order], return_index=True)
            bounds = pa.array(np.append(first, len(k)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(own), self.kind, np.int32)), pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(k[order].astype(np.int64))),
                pa.ListArray.from_arrays(bounds, pa.array(n[order].astype(np.int64)))], COUNTED)
        self.keys, self.ns, self.held = [], [], 0


def count_texts(texts: DataFrame) -> DataFrame:
    """(kind, key, n) summed over all rows of (text): runs by number, words by hash, and the number of texts.

    Tasks sum what they read and deal the sums by key; a bucket's sums meet as arrays.
    """
    buckets = 8 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_, words_, n_texts = _Sums(RUN, buckets), _Sums(WORD, buckets), 0
        codes_, hashes_, size = [], [], 0
        for batch in batches:
            for lo, hi in slices_of(batch.column(0), TOGETHER // 4):
                n_texts += hi - lo
                words, _, codes, _ = read(batch.column(0).slice(lo, hi - lo))
                codes_.append(codes)
                hashes_.append(hashes_of(words))
                size += len(codes)
                if size >= TOGETHER:
                    yield from runs_.add(np.concatenate(codes_))
                    yield from words_.add(np.concatenate(hashes_))
                    codes_, hashes_, size = [], [], 0
        if n_texts:
            if codes_:
                yield from runs_.add(np.concatenate(codes_))
                yield from words_.add(np.concatenate(hashes_))
            yield from runs_.out()
            yield from words_.out()
            one = pa.array([[0]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([TEXT], pa.int32()), pa.array([0], pa.int32()), one, pa.array([[n_texts]], pa.list_(pa.int64()))], COUNTED)

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        keys, n = _summed(pc.list_flatten(rows["keys"]).to_numpy(), pc.list_flatten(rows["ns"]).to_numpy())
        return pa.table([pa.array(np.full(len(keys), rows["kind"][0].as_py(), np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

    dealt = texts.mapInArrow(run, "kind int, bucket int, keys array<bigint>, ns array<bigint>")
    return dealt.groupBy("kind", "bucket").applyInArrow(merge, "kind int, key bigint, n bigint")


class Tree:
    """States by level: ``nodes[k]``: (context, count), ``runs[k]``: (run, count), both sorted; level 0 has runs only."""

    def __init__(self, nodes: dict[int, tuple[np.ndarray, np.ndarray]], runs_: dict[int, tuple[np.ndarray, np.ndarray]]):
        root = np.ones(SYMBOLS)
        if 0 in runs_:
            root[runs_[0][0].astype(np.int64)] += runs_[0][1]
        self.root = root / root.sum()
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in sorted(nodes):
            contexts, count = nodes[k]
            own, n = runs_.get(k, (np.zeros(0, np.uint64), np.zeros(0)))
            at = np.searchsorted(contexts, own >> np.uint64(8))
            told = np.bincount(at, n - DISCOUNT, len(contexts))
            above = np.bincount(at, self.probabilities(own), len(contexts))  # what the parent gives to runs told here
            left = (count - told) / count / np.maximum(1 - above, 1e-12)
            self.levels.append((k, contexts, left, own, (n - DISCOUNT) / count[at] if len(own) else n))

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """The probability of each run's last byte after the rest, in its longest state."""
        p = self.root[(codes & np.uint64(255)).astype(np.int64)]
        going = np.arange(len(codes))
        for k, contexts, left, own, share in self.levels:
            part = codes[going] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, part >> np.uint64(8)), len(contexts) - 1)
            hit = contexts[at] == part >> np.uint64(8)
            going, part, at = going[hit], part[hit], at[hit]
            p[going] *= left[at]
            if len(own):
                j = np.minimum(np.searchsorted(own, part), len(own) - 1)
                told = own[j] == part
                p[going[told]] = share[j[told]]
        return p

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        return np.log10(self.probabilities(codes))


def _low(n_bytes: Column) -> Column:
    """A mask of the last bytes."""
    return F.pow(F.lit(256.0), n_bytes).cast("bigint") - 1


def _contexts(runs_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of sorted runs, their numbers, each run's place among the contexts, and how many runs each has."""
    if not len(runs_):
        return runs_, n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = runs_ >> 8
    new = np.concatenate([[True], before[1:] != before[:-1]])
    first = np.flatnonzero(new)
    return before[first], np.add.reduceat(n, first), np.cumsum(new) - 1, np.diff(np.append(first, len(runs_)))


def _passed(level: tuple[np.ndarray, np.ndarray], above: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Whether each context of a level occurs often enough and pays for its runs; ``above`` has the level above."""
    runs_, n = level
    _, c, at, kinds = _contexts(runs_, n)
    _, c_up, at_up, _ = _contexts(*above)
    up = np.searchsorted(above[0], runs_ & ((1 << 8 * k) - 1))  # without the oldest byte
    gain = np.bincount(at, n * np.log(n / c[at] * (c_up[at_up[up]] / above[1][up])), len(c))
    return (c >= LEAST_COUNT) & (gain > GAIN * kinds)


def grown(own: tuple[np.ndarray, np.ndarray], short: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
    """(is a state, level, code, n) of the tree below some contexts of two bytes.

    From all runs of ``DEPTH`` that are ``own``, the runs of level ``SHORT`` below the same two bytes, and those of level 1. What is told after states
    of up to ``SHORT`` bytes isn't given; of level 1 only the states that longer ones need are, with n 0.
    """
    levels = {1: first, SHORT: short, DEPTH: own}
    for k in [*range(DEPTH - 1, SHORT, -1), *range(SHORT - 1, 1, -1)]:
        levels[k] = _summed(levels[k + 1][0] & ((1 << 8 * (k + 1)) - 1), levels[k + 1][1])
    needed = np.zeros(0, np.int64)
    for k in range(DEPTH, 1, -1):
        contexts, c, at, _ = _contexts(*levels[k])
        stays = _passed(levels[k], levels[k - 1], k)
        stays[np.searchsorted(contexts, needed)] = True
        yield True, k, contexts[stays], c[stays]
        if k > SHORT:
            yield False, k, levels[k][0][stays[at]], levels[k][1][stays[at]]
        needed = np.unique(contexts[stays] & ((1 << 8 * (k - 1)) - 1))
    yield True, 1, needed, np.zeros(len(needed), np.int64)


def tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree from the summed runs (key, n): states (k, context, c), and the runs told after them (k, run, n).

    A state's longer and shorter ones share its last two bytes (or lie above, where the alphabet bounds the table), so that runs meet by these two
    and tasks grow their part of the tree. Two bytes with over ``GROUP`` runs are dealt by two more; the runs of level ``SHORT``, few, are copied there.
    """
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = lambda rows, k: rows.groupBy(F.col("run").bitwiseAND(_low(F.lit(k + 1))).alias("run")).agg(F.sum("n").alias("n"))
    counts = counts.select(F.col("key").alias("run"), "n")
    short = stage(cut(counts, SHORT), "runs")
    first = cut(short, 1).orderBy("run").toArrow()  # at most 65,536
    first = first["run"].to_numpy(), first["n"].to_numpy()
    none = _summed(first[0] & 255, first[1])
    shared = spark.sparkContext.broadcast(first)

    context = F.shiftright("run", 8)
    pair, four = context.bitwiseAND(_low(F.lit(2))).alias("pair"), context.bitwiseAND(_low(F.lit(4)))
    sizes = counts.groupBy(pair).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP)
    hot = F.broadcast(stage(sizes.select("pair", F.ceil(F.col("m") / GROUP).cast("int").alias("splits")), "hot_contexts"))
    subs = F.explode(F.when(F.col("splits").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("splits") - 1)))
    own = counts.select(pair, "run", "n").join(hot, "pair", "left").select(F.lit(DEPTH).alias("k"), "pair", F.coalesce(F.pmod(F.xxhash64(four), F.col("splits")).cast("int"), F.lit(0)).alias("sub"), "run", "n")
    copied = short.select(pair, "run", "n").join(hot, "pair", "left").select(F.lit(SHORT).alias("k"), "pair", subs.alias("sub"), "run", "n")
    names = ["state", "k", "code", "n"]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        k, runs_, n = (rows[x].to_numpy() for x in ("k", "run", "n"))
        deep = k == DEPTH
        copies = np.unique(runs_[~deep], return_index=True)  # parts of the same two bytes may share a task
        for state, level, code, m in grown(_summed(runs_[deep], n[deep]), (copies[0], n[~deep][copies[1]]), shared.value):
            for lo in range(0, len(code), 100_000):
                c = code[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), state)), pa.array(np.full(len(c), level, np.int32)), pa.array(c), pa.array(m[lo:lo + 100_000])], names)

    tree = stage(own.union(copied).repartition(n, "pair", "sub").select("k", "run", "n").mapInArrow(grow, "state boolean, k int, code bigint, n bigint"), "tree")
    states = tree.where("state and k > 1").select("k", F.col("code").alias("context"), F.col("n").alias("c"))
    states = states.where(F.col("k") > SHORT).union(states.where(F.col("k") <= SHORT).distinct())
    # level 1 is bounded by the alphabet
    contexts, c, at, _ = _contexts(*first)
    stays = _passed(first, none, 1)
    stays[np.searchsorted(contexts, [r["code"] for r in tree.where("state and k = 1").select("code").distinct().collect()])] = True

    def table(k: int, own: np.ndarray, m: np.ndarray, *columns: str) -> DataFrame:
        return spark.createDataFrame(pa.table([pa.array(np.full(len(own), k, np.int32)), pa.array(own), pa.array(m)], list(columns)))

    states = stage(states.union(table(1, contexts[stays], c[stays], "k", "context", "c")), "states")
    told = tree.where("not state").select("k", F.col("code").alias("run"), "n")
    few = reduce(DataFrame.union, [(short if k == SHORT else cut(short, k)).select(F.lit(k).alias("k"), "run", "n") for k in range(2, SHORT + 1)])
    few = few.withColumn("context", context).join(states.where(F.col("k") <= SHORT), ["k", "context"], "left_semi").select("k", "run", "n")
    told = told.union(few).union(table(1, first[0][stays[at]], first[1][stays[at]], "k", "run", "n")).union(table(0, *none, "k", "run", "n"))
    return states, stage(told, "told")


def _levels(table: pa.Table, key: str, value: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys (sorted) and values of a table by level."""
    level, keys, values, out = table["k"].to_numpy(), table[key].to_numpy().astype(np.uint64), table[value].to_numpy().astype(np.float64), {}
    for k in np.unique(level).tolist():
        own = np.flatnonzero(level == k)
        kinds, first = np.unique(keys[own], return_index=True)  # copies for several parts may meet
        out[k] = kinds, values[own[first]]
    return out


def values_of(wanted: DataFrame, states: DataFrame, told: DataFrame) -> DataFrame:
    """(run, value) for distinct runs: their last byte's log10 probability after the rest.

    States and runs of all levels from two bytes of context on meet by these two bytes; what is above (by the
    alphabet, at most 256 states and 256 x 257 runs) goes to all tasks. Two bytes with over ``GROUP`` rows (of at most 65,536) are dealt
    by two bytes more; their states of two and three bytes (at most 257) and what is told after those are copied.
    """
    spark = wanted.sparkSession
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = lambda context, n_bytes: context.bitwiseAND(F.lit((1 << 8 * n_bytes) - 1).cast("bigint"))
    top = spark.sparkContext.broadcast((_levels(states.where("k < 2").toArrow(), "context", "c"), _levels(told.where("k < 2").toArrow(), "run", "n")))
    last = F.shiftright("run", 8)
    asked_rows = wanted.select(low(last, 2).alias("pair"), low(last, 4).alias("four"), "run")
    context = F.when(F.col("state"), F.col("code")).otherwise(F.shiftright("code", 8))
    model = states.where("k > 1").select(F.lit(True).alias("state"), "k", F.col("context").alias("code"), F.col("c").alias("n")).union(
        told.where("k > 1").select(F.lit(False), "k", "run", "n")).select(low(context, 2).alias("pair"), low(context, 4).alias("four"), "state", "k", "code", "n")
    sizes = asked_rows.groupBy("pair").agg(F.count(F.lit(1)).alias("m")).union(model.groupBy("pair").agg(F.count(F.lit(1)))).groupBy("pair").agg(F.sum("m").alias("m"))
    hot = F.broadcast(stage(sizes.where(F.col("m") > GROUP).select("pair", F.ceil(F.col("m") / GROUP).cast("int").alias("splits")), "hot_contexts"))
    own = F.pmod(F.xxhash64("four"), F.col("splits")).cast("int")
    every = F.sequence(F.lit(0), F.col("splits") - 1)
    part = F.pmod(F.xxhash64("pair", "sub"), F.lit(n)).alias("part")
    asked_rows = asked_rows.join(hot, "pair", "left").withColumn("sub", F.coalesce(own, F.lit(0))).select(part, "run")
    subs = F.when(F.col("splits").isNull(), F.array(F.lit(0))).when(F.col("k") > 3, F.array(own)).otherwise(every)
    model = model.join(hot, "pair", "left").withColumn("sub", F.explode(subs)).select(part, "state", "k", "code", "n")

    def value(asked: pa.Table, own: pa.Table) -> pa.Table:
        nodes, runs_ = top.value
        tree = Tree({**nodes, **_levels(own.filter(own["state"]), "code", "n")}, {**runs_, **_levels(own.filter(pc.invert(own["state"])), "code", "n")})
        codes = asked["run"].to_numpy()
        return pa.table({"run": codes, "value": tree.log_probabilities(codes.astype(np.uint64))}, pa.schema([("run", pa.int64()), ("value", pa.float64())]))

    return asked_rows.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(value, "run bigint, value double")


def frequent_of(counts: DataFrame) -> DataFrame:
    """(run) of the most frequent from (key, n), by classes of n, as many as the cache takes."""
    size = F.floor(8 * F.log2("n"))
    sizes = sorted((r["size"], r["m"]) for r in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("m")).collect())  # a few hundred
    while sizes and sum(m for _, m in sizes) > CACHED_RUNS:
        sizes = sizes[1:]
    return counts.where(size >= sizes[0][0] if sizes else F.lit(False)).select(F.col("key").alias("run"))


def _found(asked: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each number among sorted keys, 0 where it isn't there; and where it is."""
    if not len(keys):
        return np.zeros(len(asked)), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return np.where(hit, values[at], 0.0), hit


def _pairs(text: np.ndarray, code: np.ndarray, wanted: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs where ``wanted``, by text, and how often each occurs."""
    own = np.flatnonzero(wanted)
    pairs, times = np.unique(text[own] * n_codes + code[own], return_counts=True)
    return pairs // n_codes, pairs % n_codes, times


def _lists(values: np.ndarray, texts: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, np.arange(n + 1)), pa.int32()), pa.array(values))


LOOKED = "doc_id bigint, n_words bigint, n_common bigint, common double, score double, rare array<bigint>, times array<int>, runs array<bigint>, run_times array<int>"


def look(docs: DataFrame, cache: pa.Table, common: pa.Table) -> DataFrame:
    """One pass over (doc_id, text): sums over frequent runs and words, and the rarer ones of both with their numbers."""
    order = np.argsort(cache["run"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((
        cache["run"].to_numpy()[order].view(np.uint64), cache["value"].to_numpy()[order], common["word"].to_numpy(), np.log10(common["n"].to_numpy() + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, known, hashes, values = shared.value
        for batch in batches:
            for lo, hi in slices_of(batch.column(1), TOGETHER // 4):
                words, n_words, codes, lengths = read(batch.column(1).slice(lo, hi - lo))
                unique, where = np.unique(codes, return_inverse=True)
                own, hit = _found(unique, frequent, known)
                scores = np.add.reduceat(own[where], np.cumsum(lengths) - lengths)
                text, number, times = _pairs(np.repeat(np.arange(hi - lo), lengths), where, ~hit[where], len(unique))
                # words likewise, by their hashes
                hashed, of = np.unique(hashes_of(words), return_inverse=True)
                logs, common = _found(hashed, hashes, values)
                by_text = np.repeat(np.arange(hi - lo), n_words)
                rare_text, rare, rare_times = _pairs(by_text, of, ~common[of], max(1, len(hashed)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(np.bincount(by_text, common[of], hi - lo).astype(np.int64)),
                    pa.array(np.bincount(by_text, logs[of], hi - lo)), pa.array(scores), _lists(hashed[rare], rare_text, hi - lo), _lists(rare_times.astype(np.int32), rare_text, hi - lo),
                    _lists(unique[number].astype(np.int64), text, hi - lo), _lists(times.astype(np.int32), text, hi - lo)], [x.split()[0] for x in LOOKED.split(", ")])

    return docs.mapInArrow(run, LOOKED)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = stage(count_texts(rows.where(~in_fold(F.col("doc_id"))).select("text")), "counts")
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    n_words, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("kind") == TEXT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, kinds = n_words + ends, n_kinds + (1 if ends else 0)
    common = words.where(F.col("n") >= max(1.0, LEAST_WORD * tokens)).orderBy("word").toArrow()  # at most 1 / LEAST_WORD
    trained = counts.where(F.col("kind") == RUN).select("key", "n")
    states, told = tables(trained)
    looked = look(rows, values_of(frequent_of(trained), states, told).toArrow(), common)  # at most CACHED_RUNS
    looked = stage(looked.withColumn("row", F.monotonically_increasing_id()), "looked")

    rare = looked.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    summed = rare.join(words, "word").groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("uncommon"))
    lacking = looked.select("row", F.explode(F.arrays_zip("runs", "run_times")).alias("x")).select("row", F.col("x.runs").alias("run"), F.col("x.run_times").alias("run_times"))
    values = stage(values_of(lacking.select("run").distinct(), states, told), "run_values")
    others = lacking.join(values, "run").groupBy("row").agg(F.sum(F.col("run_times") * F.col("value")).alias("others"))
    n_tokens = F.col("n_words") + 1
    base = F.col("common") + F.coalesce("uncommon", F.lit(0.0)) + F.log10(F.lit(float(ends + 1))) - n_tokens * F.log10(F.lit(float(tokens + kinds + 1)))
    return looked.drop("rare", "times", "runs", "run_times").join(summed, "row", "left").join(others, "row", "left").select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), n_tokens.alias("n_tokens"),
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("others", F.lit(0.0))).alias("score"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
