"""Token counts of a SentencePiece BPE vocabulary by rank-synchronous merging.

Texts are cut before each run of spaces, as no piece goes on past a letter
into one, and the different words of a batch lie one after another in ragged
numpy arrays: symbols, the rank of each neighbouring pair, and where each
sequence begins. A round finds every sequence's lowest rank and applies that
pair in all sequences at once, at all its places in a sequence as far as that
is what merging one by one would do; sequences without a pair left are
finished. Words end after a few rounds; when ``SLOW`` rounds have merged almost
nothing (a long run without a space, whose pairs wait for one another), the
rest is finished pair by pair. What counts is how many symbols survive; a character outside the
vocabulary is as many as its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.arrow import Rows, grouped, values
from quarrystone.llm.pieces import BYTE, MARK, NORMAL, UNUSED, USER, _fields

BPE = 2  # fixed value: the model type of the format
NONE = np.iinfo("i4").max
#: Characters of a text that are cut into words, and of words that are merged, at a time.
STRETCH, BATCH = 1_000_000, 500_000
#: Rounds, each with less than one merge among ``SLOW_SHARE`` symbols, after which the rest goes pair by pair.
SLOW, SLOW_SHARE = 20, 2000


def read_merges(path: str) -> tuple[dict[str, float], bool]:
    """Score of each piece, and whether a space is put before a text.

    Only what is counted rightly here is read: BPE with byte fallback, spaces
    kept as they are, no character map, no pieces of the user's own.
    """
    scores, types, dummy = {}, set(), True
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                got = dict(_fields(value))
                types.add(got.get(3, NORMAL))
                if got.get(3, NORMAL) in (NORMAL, UNUSED):
                    scores[got[1].decode()] = got.get(2, 0.0)
            elif number == 2:
                if dict(_fields(value)).get(3, 1) != BPE:
                    raise ValueError("only a BPE model has merge ranks")
            elif number == 3:
                got = dict(_fields(value))
                if got.get(2) or got.get(4, 1) or not got.get(5, 1):
                    raise ValueError("a model that rewrites its texts is not read")
                dummy = bool(got.get(3, 1))
    if USER in types or UNUSED in types or BYTE not in types:
        raise ValueError("only a model with byte fallback and without pieces of the user's own is read")
    return scores, dummy


class Merges:
    """The vocabulary as arrays: symbols of characters, and rank and result of each pair of symbols."""

    def __init__(self, scores: dict[str, float]):
        symbol = {p: i for i, p in enumerate(scores)}
        for p in scores:
            for c in p:
                symbol.setdefault(c, len(symbol))
        n = len(symbol)
        self.size = n + 4  # the last four stand for characters outside, of 1 to 4 bytes
        self.weight = np.array([1 if p in scores else len(p.encode()) for p in symbol] + [1, 2, 3, 4])
        points = np.arange(0x110000)
        self.letter = (n + (points >= 0x80).astype("i8") + (points >= 0x800) + (points >= 0x10000)).astype("i4")
        for p, i in symbol.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        self.letter[ord(" ")] = self.letter[ord(MARK)]
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs, beside = {}, set()
        for p, score in scores.items():
            for at in range(1, len(p)):
                a, b = symbol.get(p[:at]), symbol.get(p[at:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (order[score], symbol[p])
                beside.add(symbol[p[at - 1]] * self.size + symbol[p[at]])
        if any(p[at] == MARK and p[at - 1] != MARK for p in scores for at in range(1, len(p))):
            raise ValueError("a piece with a space after a letter: texts can't be cut at spaces")
        self.keys = np.array(sorted(pairs), "i8")
        self.ranks = np.array([pairs[k][0] for k in sorted(pairs)] + [NONE], "i4")
        self.results = np.array([pairs[k][1] for k in sorted(pairs)] + [-1], "i4")
        self.beside = np.array(sorted(beside), "i8")
        self.listed: tuple = ()
        # Pieces that, once made, may take part in a pair of no higher rank than their own.
        own = np.full(self.size, NONE, "i4")
        own[self.results[:-1]] = self.ranks[:-1]
        self.eager = np.zeros(self.size, bool)
        for half in (self.keys // self.size, self.keys % self.size):
            self.eager[half[(self.ranks[:-1] <= own[half]) & (own[half] < NONE)]] = True

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where ``ranks`` and ``results`` have each pair; their last entry is that of no pair."""
        key = left.astype("i8") * self.size + right
        at = np.searchsorted(self.keys, key)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(found, at, len(self.keys))

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word, all merged together."""
        total = np.zeros(len(words), "i8")
        sym = self.letter[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        if not len(sym):
            return total
        # A sequence begins with each word, and where no piece holds the two characters side by side.
        first = np.ones(len(sym), bool)
        first[1:] = (owner[1:] != owner[:-1]) | ~np.isin(sym[:-1].astype("i8") * self.size + sym[1:], self.beside)
        where = np.full(len(sym), len(self.keys))
        inside = np.flatnonzero(~first)
        where[inside - 1] = self.pair(sym[inside - 1], sym[inside])
        slow = 0
        while slow < SLOW:
            starts = np.flatnonzero(first)
            lengths = np.diff(starts, append=len(sym))
            low = np.minimum.reduceat(self.ranks[where], starts)
            done = low == NONE
            if done.any():
                gone = np.repeat(done, lengths)
                total += np.bincount(owner[gone], self.weight[sym[gone]], len(words)).astype("i8")
                sym, owner, first, where, low, lengths = sym[~gone], owner[~gone], first[~gone], where[~gone], low[~done], lengths[~done]
                if not len(sym):
                    return total
            hits = np.flatnonzero(self.ranks[where] == np.repeat(low, lengths))
            # Of places that overlap the left one comes first: every other one of a run.
            turn = np.arange(len(hits))
            begins = np.ones(len(hits), bool)
            begins[1:] = np.diff(hits) > 1
            hits = hits[(turn - np.maximum.accumulate(np.where(begins, turn, 0))) % 2 == 0]
            made = self.results[where[hits]]
            if self.eager[made].any():
                hits, made = self._in_turn(sym, first, hits, made, self.ranks[where[hits]])
            slow += len(hits) * SLOW_SHARE < len(sym)
            sym[hits] = made
            left = np.ones(len(sym), bool)
            left[hits + 1] = False
            now = np.cumsum(left)[hits] - 1  # their places after the cut
            sym, owner, first, where = sym[left], owner[left], first[left], where[left]
            where[now] = len(self.keys)
            changed = np.concatenate([now, now[~first[now]] - 1])
            changed = changed[changed + 1 < len(sym)]
            changed = changed[~first[changed + 1]]
            where[changed] = self.pair(sym[changed], sym[changed + 1])
        starts = np.flatnonzero(first)
        for begin, end in zip(starts, np.append(starts[1:], len(sym))):
            total[owner[begin]] += self.one_by_one(sym[begin:end], where[begin : end - 1])
        return total

    def one_by_one(self, sym: np.ndarray, where: np.ndarray) -> int:
        """Surviving symbols of one sequence, merged pair by pair: the lowest rank, then the left one."""
        if not self.listed:
            self.listed = self.ranks.tolist(), self.results.tolist(), dict(zip(self.keys.tolist(), range(len(self.keys))))
        (ranks, results, known), n, none, size = self.listed, len(sym), len(self.keys), self.size
        sym, where, after, before = sym.tolist(), [*where.tolist(), none], [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [ranks[w] * n + i for i, w in enumerate(where) if w != none]
        heapq.heapify(queue)
        while queue:
            rank, at = divmod(heapq.heappop(queue), n)
            if ranks[where[at]] != rank:
                continue
            gone = after[at]
            sym[at], sym[gone], where[gone], after[at] = results[where[at]], -1, none, after[gone]
            if after[at] < n:
                before[after[at]] = at
            for i in (before[at], at):
                if i >= 0:
                    where[i] = known.get(sym[i] * size + sym[after[i]], none) if after[i] < n else none
                    if where[i] != none:
                        heapq.heappush(queue, ranks[where[i]] * n + i)
        return int(self.weight[[s for s in sym if s >= 0]].sum())

    def _in_turn(self, sym: np.ndarray, first: np.ndarray, hits: np.ndarray, made: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places up to the first of each sequence whose new symbol makes a
        pair of no higher rank with a neighbour: that pair comes before the rest."""
        outside = len(self.keys)
        before = np.full(len(hits), outside)
        k = np.flatnonzero(~first[hits])
        back = sym[hits[k] - 1]
        follows = np.zeros(len(k), bool)
        follows[k > 0] = hits[k[k > 0]] - hits[k[k > 0] - 1] == 2
        back[follows] = made[k[follows] - 1]
        before[k] = self.pair(back, made[k])
        after = np.full(len(hits), outside)
        k = np.flatnonzero(hits + 2 < len(sym))
        k = k[~first[hits[k] + 2]]
        after[k] = self.pair(made[k], sym[hits[k] + 2])
        sooner = np.minimum(self.ranks[before], self.ranks[after]) <= rank
        earlier = np.cumsum(sooner) - sooner
        sequence = np.cumsum(first)[hits]
        _, begin, of = np.unique(sequence, return_index=True, return_inverse=True)
        keep = earlier == earlier[begin][of]
        return hits[keep], made[keep]


class Counter:
    """Counts of texts; at most ``cache`` words are remembered with theirs."""

    def __init__(self, path: str, cache: int = 400_000):
        scores, dummy = read_merges(path)
        self.merges, self.before, self.cache, self.known = Merges(scores), " " if dummy else "", cache, {}
        self.cut = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")

    def stretches(self, text: str) -> Iterator[str]:
        """``text`` in parts that begin with a run of spaces, all but the first."""
        at = 0
        while len(text) - at > STRETCH:
            end = at + STRETCH
            while 0 < (end := text.find(" ", end)) and text[end - 1] in (" ", MARK):
                end += 1
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def learn(self, new: list[str]) -> dict[str, int]:
        """Counts of words, merged some at a time."""
        out, at = {}, 0
        while at < len(new):
            end, n = at, 0
            while end < len(new) and (end == at or n + len(new[end]) <= BATCH):
                n += len(new[end])
                end += 1
            out.update(zip(new[at:end], self.merges.counts(new[at:end]).tolist()))
            at = end
        return out

    def count_many(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, known = [0] * len(texts), self.known
        parts = ((i, part) for i, t in enumerate(texts) if t for part in self.stretches(self.before + t))
        for group in grouped(parts, lambda p: len(p[1])):
            split = [(i, self.cut.findall(part)) for i, part in group]
            new = set().union(*(words for _, words in split)).difference(known)
            known.update(self.learn(list(new)))
            for i, words in split:
                out[i] += sum(map(known.__getitem__, words))
            for w in new:
                if len(w) > 64:
                    del known[w]
            if len(known) > self.cache:
                known.clear()
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each model file in a Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``)
    of each whole text, without begin or end.

    A null text counts as empty and has no tokens; strings of special tokens
    are ordinary text; repeated rows give repeated results; other columns are
    not read; an empty table gives no rows. Memory is bounded by the longest
    text and the remembered words.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = counter(model), Rows(schema)
        for group in grouped(values(batches, "doc_id", "text"), lambda row: len(row[1] or "")):
            texts = [text or "" for _, text in group]
            for (doc, _), text, n in zip(group, texts, count.count_many(texts)):
                rows.add(doc, len(text.encode()), n, n > limit)
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
