"""SentencePiece encoding and decoding with a unigram model.

Pieces lie in a double-array trie over UTF-8 bytes; a Viterbi search finds the
segmentation of the highest total log score. Characters that no piece covers
fall back to byte pieces. Spaces are written as the marker U+2581.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.arrow import Rows, grouped, values

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format
UNIGRAM = 1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError("not a protobuf message")
        yield key >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    dummy_prefix: bool = True


def read_model(path: str, scores: str = "auto") -> Vocabulary:
    """Pieces of a SentencePiece model file.

    A unigram model's scores are log probabilities and stay as they are. A
    model whose scores are merge ranks gets the Zipf-Mandelbrot log score
    -ln(rank + 2.7) instead (``scores`` forces "model" or "zipf"). Only models
    without a character map are read, as texts are not normalised here.
    """
    out, kind = Vocabulary(), UNIGRAM
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                got = dict(_fields(value))
                out.pieces.append(got[1].decode())
                out.scores.append(got.get(2, 0.0))
                out.types.append(got.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                got = dict(_fields(value))
                if got.get(2):
                    raise ValueError("a model with a character map is not read")
                out.dummy_prefix = bool(got.get(3, 1))
    if scores == "zipf" or scores == "auto" and kind != UNIGRAM:
        rank = 0
        for i, t in enumerate(out.types):
            if t == NORMAL:
                out.scores[i] = -math.log(rank + 2.7)
                rank += 1
    return out


class DoubleArray:
    """A double-array trie: state ``s`` goes by byte ``b`` to ``base[s] + b``
    if ``check`` of that is ``s``; ``value`` is a piece's id, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][b]
            ids[node] = value
        self.base, self.check, self.value = array("i", [0]), array("i", [-2]), array("i", [ids[0]])
        first, todo = 1, [(0, 0)]
        for node, state in todo:
            if not children[node]:
                continue
            letters = sorted(children[node])
            at, taken = max(first, letters[0] + 1), 0
            while at < len(self.check) and any(at - letters[0] + b < len(self.check) and self.check[at - letters[0] + b] != -1 for b in letters):
                taken += self.check[at] != -1
                at += 1
            if at - first > 64 and taken >= 0.9 * (at - first):  # what lies before is nearly full: later searches start here
                first = at
            base = self.base[state] = at - letters[0]
            grow = base + letters[-1] + 1 - len(self.check)
            if grow > 0:
                self.base.extend([0] * grow)
                self.check.extend([-1] * grow)
                self.value.extend([-1] * grow)
            for b in letters:
                to = base + b
                self.check[to], self.value[to] = state, ids[children[node][b]]
                todo.append((children[node][b], to))
        # A jump from any state stays inside the arrays.
        self.base.extend([0] * 256)
        self.check.extend([-1] * 256)
        self.value.extend([-1] * 256)


class Unigram:
    """Encoder and decoder. At most about twice ``cache`` units are remembered with their ids."""

    def __init__(self, vocabulary: Vocabulary, cache: int = 250_000):
        v, self.cache, self.known, self.older = vocabulary, cache, {}, {}
        self.prefix = MARK if v.dummy_prefix else ""
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(v.pieces, v.types)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(v.types) if t == UNKNOWN), 0)
        if self.bytes and len(self.bytes) < 256:
            raise ValueError("byte pieces are missing")
        normal = [s for s, t in zip(v.scores, v.types) if t == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.no_piece = low - 10.0
        self.scores = [len(p) * high - 0.1 if t == USER else s for p, s, t in zip(v.pieces, v.scores, v.types)]
        keys = {p.encode(): i for i, (p, t) in enumerate(zip(v.pieces, v.types)) if t in (NORMAL, USER) and p}
        self.trie = DoubleArray(keys)
        self.arrays = tuple(np.array(x, "i4") for x in (self.trie.base, self.trie.check, self.trie.value))
        self.texts = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(v.pieces, v.types)]
        # No piece crosses a cut before a marker that follows another character, or around a line's end,
        # if none holds such a place; then units are segmented on their own.
        inner = re.compile(f"[^{MARK}]{MARK}|\n")
        self.units = None if any(inner.search(p) for p, t in zip(v.pieces, v.types) if t in (NORMAL, USER)) else re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

    def viterbi(self, unit: bytes) -> list[int]:
        """Ids of the best segmentation; of equal ones the first found from the left."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, low = len(unit), -math.inf
        best, start, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            b = unit[at]
            char = at + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            here, state, single = best[at], 0, False
            for end in range(at, n):
                to = base[state] + unit[end]
                if check[to] != state:
                    break
                state = to
                if value[state] >= 0:
                    score = here + scores[value[state]]
                    single = single or end + 1 == char
                    if score > best[end + 1]:
                        best[end + 1], start[end + 1], piece[end + 1] = score, at, value[state]
            if not single and here + self.no_piece > best[char]:
                best[char], start[char], piece[char] = here + self.no_piece, at, -1
            at = char
        out, end = [], n
        while end:
            at = start[end]
            if piece[end] >= 0:
                out.append(piece[end])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(unit[at:end]))
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
            end = at
        return out[::-1]

    def viterbi_many(self, units: list[bytes]) -> list[bytes]:
        """Packed ids of many units: the search of ``viterbi``, a step of all units at a time."""
        lengths = np.array([len(u) for u in units])
        text = np.frombuffer(b"".join(units), "u1")
        first = np.cumsum(lengths) - lengths
        unit_of = np.repeat(np.arange(len(units)), lengths)
        stop = (first + lengths)[unit_of]
        chars = np.flatnonzero((text & 0xC0) != 0x80)
        width = np.zeros(len(text), "i8")
        width[chars] = np.diff(np.append(chars, len(text)))  # a unit begins with a character
        base, check, value = self.arrays
        at, state, depth, found = chars, np.zeros(len(chars), "i4"), 0, []
        single = np.zeros(len(text), bool)
        while len(at):
            inside = at + depth < stop[at]
            at, state = at[inside], state[inside]
            to = base[state] + text[at + depth]
            good = check[to] == state
            at, state = at[good], to[good]
            depth += 1
            hit = value[state] >= 0
            found.append((at[hit], np.full(hit.sum(), depth), value[state[hit]]))
            single[at[hit][width[at[hit]] == depth]] = True
        bare = chars[~single[chars]]
        found.append((bare, width[bare], np.full(len(bare), -1)))
        start, length, piece = (np.concatenate(x) for x in zip(*found))
        score = np.append(self.scores, self.no_piece)[piece]
        relative = start - first[unit_of[start]]
        order = np.lexsort((length, relative))
        start, length, piece, score, relative = start[order], length[order], piece[order], score[order], relative[order]
        cuts = np.flatnonzero((np.diff(relative) != 0) | (np.diff(length) != 0)) + 1
        place = start + unit_of[start]  # each unit has a place more than bytes
        best = np.full(len(text) + len(units), -math.inf)
        best[first + np.arange(len(units))] = 0.0
        back, chosen = np.zeros(len(best), "i8"), np.full(len(best), -1)
        for low, high in zip([0, *cuts], [*cuts, len(start)]):  # in order of the place in the unit, the shorter first
            total = best[place[low:high]] + score[low:high]
            end = place[low:high] + length[low:high]
            better = total > best[end]
            end = end[better]
            best[end], back[end], chosen[end] = total[better], place[low:high][better], piece[low:high][better]
        who, place, steps = np.arange(len(units)), first + lengths + np.arange(len(units)), []
        begin = first + np.arange(len(units))
        while len(who):
            steps.append((who, chosen[place]))
            place = back[place]
            going = place > begin[who]
            who, place = who[going], place[going]
        who = np.concatenate([w for w, _ in steps])
        piece = np.concatenate([p for _, p in steps])
        order = np.lexsort((-np.arange(len(who)), who))
        who, piece = who[order], piece[order]
        ids = piece.astype("<u4").tobytes()
        cut = 4 * np.searchsorted(who, np.arange(len(units) + 1))
        out = [ids[low:high] for low, high in zip(cut, cut[1:])]
        for i in np.unique(who[piece < 0]):  # byte pieces
            out[i] = array("I", self.viterbi(units[i])).tobytes()
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [self._words(t) for t in texts]
        known, older = self.known, self.older
        new = set().union(*split).difference(known)
        for w in new.intersection(older):
            known[w] = older[w]
            new.discard(w)
        whole, parts = [], []
        for w in new:
            marked = w[1:] if w[:1] == MARK else self.prefix + w
            units = [marked] if self.units is None else self.units.findall(marked)
            whole.append((w, len(units)))
            parts.extend(u.encode("utf-8", "replace") for u in units)
        short = [i for i, raw in enumerate(parts) if len(raw) <= 64]
        ids: list[bytes] = [b""] * len(parts)
        for i, got in zip(short, self.viterbi_many([parts[i] for i in short]) if short else []):
            ids[i] = got
        for i, raw in enumerate(parts):
            if len(raw) > 64:
                ids[i] = array("I", self.viterbi(raw)).tobytes()
        at, large = 0, []
        for w, n in whole:
            known[w] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            at += n
            if len(w) > 64:
                large.append(w)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in large:
            del known[w]
        if len(known) >= self.cache:  # what the last texts used stays for another round
            self.known, self.older = {}, known
        return out

    def _words(self, text: str) -> list[str]:
        """What is remembered: a word stands for its marker and itself; any other unit follows a marker."""
        if not text:
            return []
        if self.units is not None and self.prefix and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        marked = self.prefix + text.replace(" ", MARK)
        return [MARK + u for u in ([marked] if self.units is None else self.units.findall(marked))]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: markers to spaces, byte pieces to bytes, the dummy prefix removed."""
        text = b"".join(map(self.texts.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_ENCODERS: dict[tuple[str, str], Unigram] = {}


def unigram(path: str, scores: str = "auto") -> Unigram:
    """One encoder for each model file in a Python worker."""
    if (path, scores) not in _ENCODERS:
        _ENCODERS[path, scores] = Unigram(read_model(path, scores))
    return _ENCODERS[path, scores]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str, scores: str = "auto", with_ids: bool = False) -> DataFrame:
    """Each whole text encoded and decoded again, a row per document.

    doc_id, n_ids, n_byte_ids (ids of byte pieces), ids_crc32 (of the ids as
    little-endian 32-bit numbers), decoded_crc32 (of the decoded UTF-8) and
    round_trip, which is false only for texts that hold the marker itself or
    no valid Unicode; ``with_ids`` adds the ids as array and the decoded text.

    A null text counts as empty and has no ids; repeated rows give repeated
    results; other columns are not read; an empty table gives none.
    """
    fields = [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_byte_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else [])])
    ddl = "doc_id bigint, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, rows = unigram(model, scores), Rows(schema)
        is_byte = np.zeros(len(u.texts), bool)
        is_byte[list(u.bytes.values())] = True
        for group in grouped(values(batches, "doc_id", "text"), lambda row: len(row[1] or "")):
            for (doc, text), ids in zip(group, u.encode_many([text or "" for _, text in group])):
                numbers = np.frombuffer(ids, "<u4")
                back = u.decode(ids)
                row = (doc, len(numbers), int(is_byte[numbers].sum()), zlib.crc32(ids), zlib.crc32(back.encode()), back == (text or ""))
                rows.add(*row, *([numbers.astype("i4"), back] if with_ids else []), weight=len(ids) * with_ids)
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ddl)
