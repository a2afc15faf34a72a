"""Token files: patched frame-of-reference blocks of token ids, in ascending document order, with an index of blocks.

Documents are range-partitioned by id (and by a hash of the text, so that one id with many rows splits too) and
sorted; every task encodes its texts and writes one file through Arrow's file systems, under a name that depends on
the partition only. It is written beside and moved, so that a task that runs again replaces its own file. Files are
read back by ranges of documents; a reader fetches the blocks that its range covers.

File: the bytes ``PFR1``; blocks; a footer of documents (id, number of ids), block offsets and sizes; the footer's
length as eight bytes, and ``PFR1`` again. Block of up to ``BLOCK`` ids: minimum (4 bytes), width (1), number of
exceptions (2), number of ids (2), then the offsets from the minimum in ``width`` bits each, then the exceptions'
places (2 bytes each) and high bits (4 each). The width is the bit length at the ``PERCENTILE``-th percentile.

Encoding looks at stretches of blanks and following characters: the library's splitting pattern never joins
characters across the place before such a stretch, so the ids of a text are those of its stretches. A slice of texts is
cut on its bytes and every distinct stretch is looked up once. New ones of plain letters, digits and signs are cut into
the pattern's words; words not met before are encoded in one call and told apart by the bytes that their ids stand for.
Short stretches and words are kept in a worker. Texts with other white space or with the string of an added token are
encoded whole.

Cases: a null or empty text has only the end id. Repeated documents and ids are written as often as they occur; null
ids come first. An empty table gives no documents. Other columns are ignored.
"""

from __future__ import annotations

import os
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import file_system, shared_folder, stage

MAGIC = b"PFR1"
BLOCK = 256
PERCENTILE = 90
END_ID = 2
#: Token ids a task holds before it packs and writes them, and that a reading task takes.
BUFFER_IDS = 1 << 20
READ_IDS = 1 << 22
#: Blocks that a reader fetches at a time.
READ_BLOCKS = 2048
#: Bytes of text that go to one file, about.
FILE_BYTES = 16 << 20
#: Bytes of text that are cut and encoded together (one text at least).
SLICE_BYTES = 8 << 20
#: Encoded stretches and words a worker remembers, and the longest in characters; how many words are encoded in one call.
MEMORY = 500_000
MEMORY_WORDS = 1_000_000
SHORT = 64
TOGETHER = 4096
HEAD = struct.Struct("<IBHH")

# The library's splitting pattern for stretches of ASCII and the Latin letters after it.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = re.compile(f"[\\x01-\\x7f{LETTER}]+")
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
# White space other than blank and line feed.
OTHER_BLANK = r"[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# ---- blocks

def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Blocks of ids (unsigned 32-bit), and the length of each."""
    parts, sizes = [], []
    n_full = len(ids) // BLOCK
    if n_full:
        whole = ids[:n_full * BLOCK].reshape(n_full, BLOCK)
        for data in _pack_many(whole):
            parts.append(data)
            sizes.append(len(data))
    if len(ids) % BLOCK:
        data = _pack_many(ids[n_full * BLOCK:].reshape(1, -1))[0]
        parts.append(data)
        sizes.append(len(data))
    return b"".join(parts), sizes


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack_many(rows: np.ndarray) -> list[bytes]:
    n, size = rows.shape
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    at = min(size - 1, size * PERCENTILE // 100)
    widths = _bit_length(np.partition(rest, at, axis=1)[:, at])
    out: list[bytes] = [b""] * n
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        part = rest[own]
        width = int(w)
        low = part & np.uint32((1 << width) - 1)
        kind, n_bytes = ("<u2", 2) if width <= 16 else ("<u4", 4)
        bits = np.unpackbits(low.astype(kind).view(np.uint8).reshape(len(own), size, n_bytes), axis=2, bitorder="little")[:, :, :width]
        packed = np.packbits(bits.reshape(len(own), size * width), axis=1, bitorder="little") if width else np.zeros((len(own), 0), np.uint8)
        high = (part.astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
        for k, i in enumerate(own):
            places = np.flatnonzero(high[k])
            out[i] = HEAD.pack(int(least[i]), width, len(places), size) + packed[k].tobytes() \
                + places.astype("<u2").tobytes() + high[k][places].astype("<u4").tobytes()
    return out


def unpack(data: bytes, sizes: list[int]) -> np.ndarray:
    """The ids of consecutive blocks."""
    starts = np.cumsum([0, *sizes])[:-1].astype(np.int64)
    heads = [HEAD.unpack_from(data, int(s)) for s in starts]
    lengths = np.array([h[3] for h in heads], np.int64)
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault((h[1], h[3]), []).append(i)
    for (width, size), own in groups.items():
        n_bytes = (size * width + 7) // 8
        at = starts[own] + HEAD.size
        block = raw[at[:, None] + np.arange(n_bytes)] if n_bytes else np.zeros((len(own), 0), np.uint8)
        bits = np.unpackbits(block, axis=1, bitorder="little")[:, :size * width].reshape(len(own), size, width)
        kind, n_bits = ("<u2", 16) if width <= 16 else ("<u4", 32)
        wide = np.zeros((len(own), size, n_bits), np.uint8)
        wide[:, :, :width] = bits
        values = np.packbits(wide, axis=2, bitorder="little").reshape(len(own), -1).view(kind).astype(np.uint32)
        for k, i in enumerate(own):
            least, _, n_odd, _ = heads[i]
            if n_odd:
                p = int(starts[i]) + HEAD.size + n_bytes
                places = np.frombuffer(data, "<u2", n_odd, p)
                values[k, places] |= np.frombuffer(data, "<u4", n_odd, p + 2 * n_odd) << np.uint32(width)
            out[ends[i] - size:ends[i]] = values[k] + np.uint32(least)
    return out


# ---- encoding

def stretches_of(texts: pa.Array, added: list[str] = ()) -> tuple[pa.Array, np.ndarray]:
    """The stretches of texts (large strings without nulls) on end, and where each text's start among them.

    A text with other white space or one of the strings ``added`` is one stretch.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    raw, edges = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]
    blank = (raw == 32) | (raw == 10)
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    whole = pc.match_substring_regex(texts, OTHER_BLANK)
    for string in added:
        whole = pc.or_(whole, pc.match_substring(texts, string))
    for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
        begins[edges[i]:edges[i + 1]] = False
    begins[edges[:-1][np.diff(edges) > 0]] = True
    cuts = np.flatnonzero(begins)
    bounds = np.append(cuts, len(raw)) + offsets[0]
    return (pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds.astype(np.int64)), data), np.searchsorted(cuts, edges))


class Encoder:
    """Ids of texts by the tokenizers library; keeps those of short stretches, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model on words that are cut already
        self.by_word = Tokenizer.from_file(path)
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split("\0", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a character for each byte

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encodes new words, many in a call."""
        for lo in range(0, len(words), TOGETHER):
            part = words[lo:lo + TOGETHER]
            ids = np.array(self.by_word.encode_batch_fast(["\0".join(part)], add_special_tokens=False)[0].ids, "<u4")
            edges = np.cumsum([0, *(len(w.encode()) for w in part)])
            cuts = 4 * np.searchsorted(np.cumsum(self.n_bytes[ids]), edges, side="right")
            data, cuts = ids.tobytes(), cuts.tolist()
            self.words.update((w, data[a:b]) for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True))

    def _look_up(self, stretches: list[str]) -> list[bytes]:
        if len(self.stretches) > MEMORY:
            self.stretches.clear()
        if len(self.words) > MEMORY_WORDS:
            self.words.clear()
        found = list(map(self.stretches.get, stretches))
        plain, alone = [], []
        for i, ids in enumerate(found):
            if ids is None:
                x = stretches[i]
                (plain if len(x) <= SHORT and PLAIN.fullmatch(x) and not any(a in x for a in self.added) else alone).append(i)
        cut = [WORD.findall(stretches[i]) for i in plain]
        known = self.words
        self._learn(list({w: None for words in cut for w in words if w not in known}))
        for i, words in zip(plain, cut, strict=True):
            found[i] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        for i, ids in zip(alone, self._alone([stretches[i] for i in alone]), strict=True):
            found[i] = ids
        self.stretches.update((stretches[i], found[i]) for i in plain)
        self.stretches.update((stretches[i], found[i]) for i in alone if len(stretches[i]) <= SHORT)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and the number of each text's; nulls are empty texts."""
        stretches, firsts = stretches_of(pc.fill_null(texts.cast(pa.large_string()), ""), self.added)
        coded = stretches.dictionary_encode()
        found = self._look_up(coded.dictionary.to_pylist())
        flat, codes = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        counts = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, np.diff(ends[firsts])


def slices_of(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``size`` bytes together, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + size, side="right")))
        yield lo, hi
        lo = hi


_LOADED: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


# ---- writing and reading

def _write_partition(folder: str, tokenizer_path: str):
    """A function for mapInArrow: sorted (doc_id, text) rows to one file; returns one row about it."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = file_system(folder)
        final = posixpath.join(root, f"part-{task.partitionId():06d}.pfr")
        trial = f"{final}.{task.taskAttemptId()}.tmp"
        encoder, out = encoder_of(tokenizer_path), None
        docs, lengths, sizes, waiting, n_waiting, total, written = [], [], [], [], 0, 0, len(MAGIC)

        def flush(last: bool) -> None:
            nonlocal waiting, n_waiting, written
            ids = np.concatenate([*waiting, np.zeros(0, np.uint32)]).astype(np.uint32)
            cut = len(ids) if last else len(ids) // BLOCK * BLOCK
            data, new = pack(ids[:cut])
            out.write(data)
            written += len(data)
            sizes.extend(new)
            waiting, n_waiting = [ids[cut:].copy()], len(ids) - cut

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(trial)
                out.write(MAGIC)
            docs += batch.column(0).to_pylist()
            for lo, hi in slices_of(batch.column(1)):
                ids, counts = encoder.encode(batch.column(1).slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(counts), END_ID)
                lengths += (counts + 1).tolist()
                waiting.append(ids)
                n_waiting, total = n_waiting + len(ids), total + len(ids)
                if n_waiting >= BUFFER_IDS:
                    flush(False)
        if out is None:
            return
        flush(True)
        known = np.array([d is not None for d in docs], np.uint8)
        footer = struct.pack("<QQ", len(docs), len(sizes)) + known.tobytes() \
            + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + np.array(sizes, "<u4").tobytes()
        out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        out.close()
        if fs.get_file_info(final).type.name == "File":
            fs.delete_file(final)
        fs.move(trial, final)
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [posixpath.basename(final)], "docs": [len(docs)], "ids": [total]},
                                         pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))
    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files of ``docs`` under ``folder``; returns (part, file, docs, ids, start), a row a file."""
    spark = docs.sparkSession
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(n_bytes // FILE_BYTES) + 1
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = dealt.mapInArrow(_write_partition(folder, tokenizer_path), "part int, file string, docs bigint, ids bigint")
    files = stage(files, "token_files")
    # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stage(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "token_index")


def _footer(source) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = source.size()
    source.seek(size - 12)
    length, magic = struct.unpack("<Q4s", source.read(12))
    if magic != MAGIC:
        raise ValueError("not a token file")
    source.seek(size - 12 - length)
    data = source.read(length)
    n_docs, n_blocks = struct.unpack_from("<QQ", data)
    at = 16
    known = np.frombuffer(data, np.uint8, n_docs, at)
    docs = np.frombuffer(data, "<i8", n_docs, at + n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs)
    sizes = np.frombuffer(data, "<u4", n_blocks, at + 17 * n_docs)
    return known, docs, lengths.astype(np.int64), sizes.astype(np.int64)


def read_documents(folder: str, name: str, lo: int, hi: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids) of the file's documents whose first id has a place in [lo, hi)."""
    fs, root = file_system(folder)
    with fs.open_input_file(posixpath.join(root, name)) as source:
        known, docs, lengths, sizes = _footer(source)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        offsets = len(MAGIC) + np.concatenate([[0], np.cumsum(sizes)])
        first, last = np.searchsorted(starts[:-1], [lo, hi])
        next_block, last_block = int(starts[first]) // BLOCK, -(-int(starts[last]) // BLOCK)
        held, held_from = np.zeros(0, np.uint32), next_block * BLOCK
        for i in range(first, last):
            s, need = int(starts[i]), int(starts[i + 1])
            have = held_from + len(held)
            if have < need:  # many blocks at a time: for this document and those behind it
                keep = min(s, have)
                parts, held_from = [held[keep - held_from:]], keep
                while have < need:
                    end = min(next_block + READ_BLOCKS, last_block)
                    source.seek(int(offsets[next_block]))
                    parts.append(unpack(source.read(int(offsets[end] - offsets[next_block])), sizes[next_block:end].tolist()))
                    have, next_block = have + len(parts[-1]), end
                held = np.concatenate(parts)
            yield (int(docs[i]) if known[i] else None), s, held[s - held_from:need - held_from]


def digest_files(folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    ranges = files.select("file", "start", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.col("ids") - 1, F.lit(0)), F.lit(READ_IDS).cast("bigint"))).alias("lo"))
    # by number: ranges are tiny rows for much work, and would be put in one partition by their size
    ranges = ranges.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "lo")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = [(d, row["start"] + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                       for d, s, ids in read_documents(folder, row["file"], row["lo"], row["lo"] + READ_IDS)]
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return ranges.mapInArrow(read, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def op7_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest_files(folder, write_tokens(docs, folder, public_tokenizers.path(vocabulary)))
