"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The automaton reads a text once; at each position its output links list the pieces that end there, and each relaxes
the best score of that position from the best score where the piece starts. A character that no piece covers is
spelt in byte pieces, at a score below every other way. The result is the segmentation with the highest sum of the
model's piece scores; of equal sums the one with fewer pieces, then the one whose last piece is longest, again
from the end. (For a model trained as BPE this is the best segmentation under its scores, not a replay of its merges.)

Blanks become the mark U+2581 and a text that isn't empty gets one in front, as the model's settings say; decoding
undoes both. If no piece holds a mark after another character, a text falls into stretches (marks, then other
characters) that no piece can straddle, and a stretch into units between neighbours that no piece holds; a worker keeps
the ids of those it has seen. Otherwise texts go whole.

Cases: null and empty texts have no ids and decode to the empty text. Texts may be of any length. A mark that stands in
the text itself is decoded as a blank. Repeated rows get equal ids; an empty table stays empty. Column names of the
input are kept, inner ones differ from them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh

MARK = "▁"
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Stretches and units that a worker keeps, and texts whose ids leave it at a time.
MEMORY = 75_000
LONGEST_KEPT = 64
TEXTS = 500
#: Characters that the automaton's table has a column for at most, and stretches that go side by side.
COLUMNS, ROWS = 320, 4096


class Table:
    """The automaton over pieces of the commonest characters as arrays, for many stretches side by side.

    ``step[state, column]`` is the state after a character; ``ends[state]`` to ``ends[state + 1]`` are the places of the pieces
    that end there in ``length``, ``own`` (their scores) and ``piece``. Characters that no longer piece holds share the column
    ``LONE``: each is a piece of its own or spelt, whatever is around it. Those of column ``RARE`` need the other way.
    """

    LONE, RARE = COLUMNS, -1

    def __init__(self, entries: list[tuple[str, float, int]], byte_ids: dict[int, int], unknown: int, missing: float):
        uses = Counter(c for text, *_ in entries if len(text) > 1 for c in set(text))
        common = sorted(uses, key=lambda c: (-uses[c], c))[:COLUMNS]
        columns = {c: i for i, c in enumerate(common)}
        self.column = np.full(0x110000, self.LONE, np.int16)
        self.column[[ord(c) for c in uses]] = [columns.get(c, self.RARE) for c in uses]
        self.missing, self.byte_ids, self.unknown = missing, byte_ids, unknown
        self.single = {text: i for text, _, i in entries if len(text) == 1}
        below: list[dict[int, int]] = [{}]
        found: list[list[tuple[int, float, int]]] = [[]]
        for text, own, i in entries:
            if not all(c in columns for c in text):
                continue
            at = 0
            for c in text:
                at = below[at].setdefault(columns[c], len(below))
                if at == len(below):
                    below.append({})
                    found.append([])
            found[at] = [(len(text), own, i)]
        self.step = np.zeros((len(below), COLUMNS + 1), np.uint16 if len(below) <= 1 << 16 else np.int32)
        queue, fall = [0], [0] * len(below)
        for at in queue:  # grows by level; where a state falls to is shorter and done before it
            self.step[at] = self.step[fall[at]] if at else 0
            for column, to in below[at].items():
                fall[to] = int(self.step[at, column])
                found[to] = found[to] + found[fall[to]]
                self.step[at, column] = to
                queue.append(to)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        self.length = np.array([x[0] for f in found for x in f], np.int64)
        self.own = np.array([x[1] for f in found for x in f], np.float64)
        self.piece = np.array([x[2] for f in found for x in f], np.int64)

    def alone(self, c: str) -> list[int]:
        """Ids of a character that no longer piece covers."""
        return [self.single[c]] if c in self.single else [self.byte_ids.get(b, self.unknown) for b in c.encode()]

    def best(self, stretches: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of the best segmentations, as bytes, of the stretches without rare characters; and the others' places."""
        out: list[bytes] = [b""] * len(stretches)
        if not stretches:
            return out, []
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        chars = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        columns, starts = self.column[chars], np.cumsum(sizes) - sizes
        # the id of each character by itself, -1 if it has several
        kinds, which = np.unique(chars, return_inverse=True)
        ways = [self.alone(chr(c)) for c in kinds.tolist()]
        lone = np.array([w[0] if len(w) == 1 else -1 for w in ways], np.int32)[which]
        able = np.minimum.reduceat(columns, starts) >= 0
        own = np.flatnonzero(able)
        own = own[np.argsort(-sizes[own], kind="stable")]
        for lo in range(0, len(own), ROWS):
            rows = own[lo:lo + ROWS]
            for i, ids in zip(rows.tolist(), self._together(columns, lone, starts[rows], sizes[rows]), strict=True):
                out[i] = self._spelt(stretches[i], ids) if isinstance(ids, list) else ids
        return out, np.flatnonzero(~able).tolist()

    def _spelt(self, stretch: str, parts: list[tuple[int, int]]) -> bytes:
        """Ids of a stretch from its pieces by place, where -1 is a character in several bytes."""
        return np.array([x for at, i in parts for x in ([i] if i >= 0 else self.alone(stretch[at]))], "<u4").tobytes()

    def _together(self, columns: np.ndarray, lone: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes | list[tuple[int, int]]]:
        """Best segmentations of stretches in falling order of size: ids, or (place, piece) if a character takes several."""
        m, longest = len(sizes), int(sizes[0])
        score, count = np.zeros((longest + 1, m)), np.zeros((longest + 1, m), np.int32)
        back, piece = np.zeros((longest + 1, m), np.int32), np.zeros((longest + 1, m), np.int32)
        flat_score, flat_count = score.reshape(-1), count.reshape(-1)
        state = np.zeros(m, np.int64)
        for end in range(1, longest + 1):
            n = int(np.searchsorted(-sizes, -end, "right"))  # the stretches that reach this far come first
            at_char = starts[:n] + end - 1
            state = self.step[state[:n], columns[at_char]].astype(np.int64)
            first = self.ends[state]
            kinds = self.ends[state + 1] - first
            # fewer pieces win equal sums, then the longer last piece: one number, the least is best
            top, rank, of = np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -1, np.int64)
            for j in range(int(kinds.max())):
                rows = np.flatnonzero(kinds > j)
                at = first[rows] + j
                length = self.length[at]
                before = (end - length) * m + rows
                total, new = flat_score[before] + self.own[at], (flat_count[before].astype(np.int64) + 1) * 256 - length
                now = top[rows]
                better = (total > now) | ((total == now) & (new < rank[rows]))
                rows = rows[better]
                top[rows], rank[rows], of[rows] = total[better], new[better], at[better]
            told = of >= 0
            score[end, :n] = np.where(told, top, score[end - 1, :n] + self.missing)
            count[end, :n] = np.where(told, (rank + 255) >> 8, count[end - 1, :n] + 1)
            back[end, :n] = np.where(told, end - self.length[of], end - 1)
            piece[end, :n] = np.where(told, self.piece[of], lone[at_char])
        # from the ends back; the pieces of a stretch fill the last places of its row
        steps = count[sizes, np.arange(m)]
        width = int(steps.max())
        ids, places = np.zeros((m, width), "<i4"), np.zeros((m, width), np.int16)
        at, rows, place = sizes.copy(), np.arange(m), width - 1
        while len(rows):
            ids[rows, place] = piece[at, rows]
            at = back[at, rows]
            places[rows, place] = at
            rows, at, place = rows[at > 0], at[at > 0], place - 1
        raw = ids.tobytes()
        out: list[bytes | list[tuple[int, int]]] = [raw[4 * (width * (r + 1) - k):4 * width * (r + 1)] for r, k in enumerate(steps.tolist())]
        for r in np.flatnonzero((ids < 0).any(1)).tolist():
            out[r] = list(zip(places[r, width - steps[r]:].tolist(), ids[r, width - steps[r]:].tolist(), strict=True))
        return out


class Pieces:
    """The pieces of a model file with their automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids, self.automaton, least = {}, ahocorasick.Automaton(), 0.0
        self.skipped = set()
        straddles = False
        for i, piece in enumerate(self.texts):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.skipped.add(i)
            elif model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            else:
                score = model.get_score(i)
                least = min(least, score)
                straddles |= MARK in piece.lstrip(MARK)
                self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.unknown = model.unk_id()
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.spelt = np.zeros(n, bool)
        self.spelt[list(self.byte_of)] = True
        self.missing = 2 * least - 10.0
        self.splits = not straddles
        # neighbours inside pieces; a text can be cut between any others
        self.inside = {p[k:k + 2] for p, _ in self.automaton.items() for k in range(len(p) - 1)}
        self.raw = [b"" if i in self.skipped else bytes((self.byte_of[i],)) if i in self.byte_of else t.encode() for i, t in enumerate(self.texts)]
        self.memory: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.table = Table([(p, own, i) for p, (length, own, i) in self.automaton.items() if length <= LONGEST_KEPT], self.byte_ids, self.unknown, self.missing)

    def best(self, text: str) -> tuple[int, ...]:
        """Ids of the best segmentation of a marked text."""
        n = len(text)
        score, count, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here have their final score or that of a spelt character

        def spell(upto: int) -> None:
            nonlocal done
            for k in range(done + 1, upto + 1):
                if piece[k] < 0:
                    cost = score[k - 1] + self.missing
                    if cost > score[k]:
                        score[k], count[k], back[k] = cost, count[k - 1] + 1, k - 1
            done = max(done, upto)

        for end, (length, own, i) in self.automaton.iter(text):
            end += 1
            if done < end - 1:
                spell(end - 1)
            start = end - length
            total, best = score[start] + own, score[end]
            if total > best or (total == best and (count[start] + 1, -length) < (count[end], back[end] - end)):
                score[end], count[end], back[end], piece[end] = total, count[start] + 1, start, i
        spell(n)
        ids: list[int] = []
        k = n
        while k:
            if piece[k] >= 0:
                ids.append(piece[k])
            else:
                raw = text[k - 1].encode()
                ids.extend(reversed([self.byte_ids.get(b, self.unknown) for b in raw]))
            k = back[k]
        return tuple(reversed(ids))

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            ids = np.array(self.best(unit), "<u4").tobytes()
            if len(unit) <= LONGEST_KEPT:
                if len(self.units) >= MEMORY:
                    self.units.clear()
                self.units[unit] = ids
        return ids

    def _stretch(self, stretch: str) -> bytes:
        inside, at, parts = self.inside, 0, []
        for k in range(1, len(stretch)):
            if stretch[k - 1:k + 1] not in inside:
                parts.append(self._unit(stretch[at:k]))
                at = k
        parts.append(self._unit(stretch[at:]))
        ids = b"".join(parts)
        if len(stretch) <= LONGEST_KEPT:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[stretch] = ids
        return ids

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return np.array(self.best(marked), "<u4").tobytes()
        get, make = self.memory.get, self._stretch
        return b"".join([get(x) or make(x) for x in STRETCH.findall(marked)])

    def encode_texts(self, texts: Sequence[str | None]) -> list[bytes]:
        """``encode_bytes`` of each text; what is new in them goes through the table together."""
        if not self.splits:
            return [self.encode_bytes(t) for t in texts]
        split = [STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        kinds = set().union(*split)
        known, new = {}, []
        for x in kinds:
            ids = self.memory.get(x)
            if ids is not None:
                known[x] = ids
            elif len(x) <= LONGEST_KEPT:
                new.append(x)
            else:
                known[x] = self._stretch(x)
        found, others = self.table.best(new)
        for i in others:
            found[i] = self._stretch(new[i])
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
        self.memory.update(zip(new[:MEMORY], found, strict=False))
        known.update(zip(new, found, strict=True))
        return [b"".join([known[x] for x in s]) for s in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids; control ids stand for nothing, bytes that aren't UTF-8 become U+FFFD."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids] if ids is not None else []).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The pieces of a model file, made once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The batches in runs of at most ``TEXTS`` rows, so that the ids of few texts are held at once."""
    for batch in batches:
        for lo in range(0, len(batch), TEXTS):
            yield batch.iloc[lo:lo + TEXTS]


def encode_column(text: Column, path: str) -> Column:
    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(path)
        for texts in slices(batches):
            yield pd.Series([np.frombuffer(x, "<i4") for x in model.encode_texts(texts)], dtype=object)
    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(path)
        for arrays in batches:
            yield pd.Series([model.decode(None if a is None else a.tolist()) for a in arrays], dtype=object)
    return decode(ids)


def digest_column(text: Column, path: str) -> Column:
    """A text's ids, their counts and digest, and whether decoding gives the text again: a struct."""
    @F.pandas_udf("piece_ids array<int>, n_pieces bigint, ids_crc32 bigint, n_bytes_spelt bigint, round_trip boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for texts in slices(batches):
            rows = []
            for t, data in zip(texts, model.encode_texts(texts), strict=True):
                ids = np.frombuffer(data, "<u4")
                rows.append((ids.astype(np.int32), len(ids), zlib.crc32(data), int(model.spelt[ids].sum()), model.decode(ids.tolist()) == (t or "").replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=["piece_ids", "n_pieces", "ids_crc32", "n_bytes_spelt", "round_trip"])
    return digest(text)


def with_pieces(docs: DataFrame, path: str, text: str = "text", name: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each text in a further column."""
    return docs.withColumn(fresh(docs, name), encode_column(F.col(text), path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", digest_column(F.col("text"), default_model()).alias("d")).select("doc_id", "d.*")
