"""Toxicity by a linear-chain conditional random field over words.

Token labels come from labelled documents: the words of a toxic document that
the labelled documents tie to toxicity are its toxic tokens. From these a
two-state chain (clean, toxic) learns weights of words, of word shapes and of
transitions by maximum likelihood. Forward-backward marginals then say for
each token of a text how likely it is toxic. Their sum, the expected number of
toxic words, gives the document's score; runs above one half give the offending
spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.arrow import Rows, values

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


HEADS = (4, 5, 6, 7)


#: Share of each parameter's own step that a round of the fit takes.
RATE = 0.5


def features(word: str) -> list[str]:
    """The word itself and, marked by a star, those of its heads that are shorter than it."""
    return [word, *[word[:n] + "*" for n in HEADS if len(word) > n]]


@dataclass(frozen=True)
class Model:
    """Log potentials of the chain and of the words.

    ``weights`` has the gain of state toxic over clean of each feature that is
    tied to toxicity, ``heads`` the first letters of words that may have one;
    ``bias`` is the gain of every word. ``offset`` and ``slope`` turn the log of
    the expected number of toxic words into the logit of the score.
    """

    weights: dict[str, float]
    bias: float
    first: float
    moves: tuple[tuple[float, float], tuple[float, float]]
    heads: frozenset[str] = frozenset()
    offset: float = 0.0
    slope: float = 0.0

    def gain(self, word: str) -> float | None:
        """The gain of a word with a weight of its own, else None."""
        if word[: HEADS[0]] not in self.heads:
            return None
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return self.bias + sum(found) if found else None

    def marginals(self, gains: list[float]) -> list[float]:
        """P(toxic) of each token of one chain by forward-backward."""
        return self.sparse_marginals(len(gains), dict(enumerate(gains)))[0] if gains else []

    def sparse_marginals(self, n: int, gains: dict[int, float]) -> tuple[list[float], list[int]]:
        """P(toxic) along a chain of ``n`` tokens of which only those in
        ``gains`` (place, gain) differ from the bias: a value per run of tokens
        that share it, and where each run ends.

        Both passes run over the whole chain and carry the ratio of toxic to
        clean: ahead, of all before and with the token; behind, of all after
        it. Between two listed tokens a message soon repeats itself to the last
        bits (a difference below 1e-15 of it); from there on every later one is
        the same, and the rest of the gap is one run.
        """
        (cc, ct), (tc, tt) = ((math.exp(x) for x in row) for row in self.moves)
        odds = {i: math.exp(min(50.0, g)) for i, g in gains.items()}
        plain, places = math.exp(min(50.0, self.bias)), sorted(gains)

        def messages(begin: float, step, order: list[int], at: int, way: int) -> dict[int, float]:
            """The message at each token where it still changes; the others have that of the one before."""
            out, now, k = {}, begin, 0
            stop = n if way > 0 else -1
            while at != stop:
                nxt = order[k] if k < len(order) else stop
                while at != nxt:
                    out[at] = now
                    new = step(now, plain)
                    at += way
                    if abs(new - now) <= 1e-15 * now:
                        at = nxt
                    now = new
                if at != stop:
                    out[at], now, at, k = now, step(now, odds[at]), at + way, k + 1
            return out

        def onward(r: float, o: float) -> float:
            r *= o
            return (ct + r * tt) / (cc + r * tc)

        def back(r: float, o: float) -> float:
            r *= o
            return (tc + r * tt) / (cc + r * ct)

        before = messages(math.exp(self.first), onward, places, 0, 1)
        after = messages(1.0, back, places[::-1], n - 1, -1)
        # A run starts where either message changes: the one behind holds from a token down to where the next one is given.
        starts = sorted(set(before) | {i + 1 for i in after if i + 1 < n} | {0} | set(places) | {i + 1 for i in places if i + 1 < n})
        values, ends = [], []
        ahead, marks, k = before[0], sorted(after), 0
        for i, s in enumerate(starts):
            ahead = before.get(s, ahead)
            while marks[k] < s:
                k += 1
            both = ahead * odds.get(s, plain) * after[marks[k]]
            values.append(both / (1 + both))
            ends.append(starts[i + 1] if i + 1 < len(starts) else n)
        return values, ends


class Chains:
    """Whole texts as chains of which only some tokens, the marked ones, have features.

    A token without any has the gain of the bias, so a run of m such tokens is
    the m-th power of one 2x2 matrix: its passes and its expected counts come
    from the matrix's two eigenvalues, however long it is. What is kept of a
    chain is its first token, its marked ones (``ids``, 0 for no feature;
    ``gold`` if toxic), the plain tokens before each (``gaps``) and after the
    last (``tails``). Chains of like numbers of marked tokens are one block.
    """

    def __init__(self, chains: list[tuple[int, list[tuple[int, list[int]]], bool]], per: int):
        """Of each chain its tokens, its marked ones (place, features) and whether these are toxic."""
        self.blocks = []
        by_size: dict[int, list] = {}
        for n, marked, toxic in chains:
            by_size.setdefault(len(marked).bit_length(), []).append((n, marked, toxic))
        for _, some in sorted(by_size.items()):
            for at in range(0, len(some), 4096):  # the passes' memory is bounded
                self.blocks.append(self._block(some[at : at + 4096], per))
        self.tokens = sum(n for n, _, _ in chains)
        self.count = len(chains)

    @staticmethod
    def _block(some: list, per: int) -> tuple:
        wide = max(len(m) for _, m, _ in some) + 1
        ids, gold = np.zeros((len(some), wide, per), "i4"), np.zeros((len(some), wide), bool)
        gaps, there, tails = np.zeros((len(some), wide), "i8"), np.zeros((len(some), wide), bool), np.zeros(len(some), "i8")
        for i, (n, marked, toxic) in enumerate(some):
            elements = marked if marked and marked[0][0] == 0 else [(0, [0] * per), *marked]
            places = [p for p, _ in elements]
            ids[i, : len(elements)], there[i, : len(elements)] = [f for _, f in elements], True
            gold[i, : len(elements)] = ids[i, : len(elements)].any(axis=1) & toxic
            gaps[i, 1 : len(elements)] = np.diff(places) - 1
            tails[i] = n - 1 - places[-1]
        return ids, gold, gaps, there, tails

    def gold_moves(self) -> np.ndarray:
        """How often each state of the labels follows each."""
        seen = np.zeros((2, 2))
        for _, gold, gaps, there, tails in self.blocks:
            close = (gaps[:, 1:] == 0) & there[:, 1:]
            seen[1, 1] += (gold[:, 1:] & gold[:, :-1] & close).sum()
            seen[0, 1] += (gold[:, 1:] & ~(gold[:, :-1] & close)).sum()
            last = there & np.column_stack([~there[:, 1:], np.ones(len(there), bool)])
            seen[1, 0] += gold.sum() - (gold & last & (tails == 0)[:, None]).sum()  # all followed by a token, less those followed by a toxic one
        seen[1, 0] -= seen[1, 1]
        seen[0, 0] = self.tokens - self.count - seen.sum()
        return seen

    def expected(self, weights: np.ndarray, bias: float, first: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
        """Under a model: toxic tokens of each feature, moves, toxic tokens,
        toxic first tokens, and the log likelihood of the labels' partition (log Z)."""
        by_feature, got, level, begin, log_z = np.zeros(len(weights)), np.zeros((2, 2)), 0.0, 0.0, 0.0
        move = np.exp(moves)
        plain = move * np.array([1.0, math.exp(bias)])
        values, right = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        values, right = values.real[order], right.real[:, order]
        left, ratio, top = np.linalg.inv(right), values[1] / values[0], values[0]

        def power(row: np.ndarray, m: np.ndarray, into: np.ndarray, out: np.ndarray) -> np.ndarray:
            x = row @ into
            x[:, 1] *= ratio**m
            return x @ out

        for ids, _, gaps, there, tails in self.blocks:
            docs, wide = there.shape
            emit = np.stack([np.ones(there.shape), np.exp(np.minimum(50.0, bias + weights[ids].sum(axis=2)))], axis=2)
            ahead, behind, over = np.ones((docs, wide, 2)), np.ones((docs, wide, 2)), np.ones((docs, wide, 2))
            now = emit[:, 0] * np.array([1.0, math.exp(first)])
            for j in range(wide):
                if j:
                    over[:, j] = power(ahead[:, j - 1], gaps[:, j], right, left)  # just before the token
                    now = np.where(there[:, j, None], over[:, j] @ move * emit[:, j], ahead[:, j - 1])
                size = now.sum(axis=1)
                log_z += np.log(size[there[:, j]]).sum() + (gaps[there[:, j], j] * math.log(top)).sum()
                ahead[:, j] = now / size[:, None]
            last = there.sum(axis=1) - 1
            ends = power(ahead[np.arange(docs), last], tails, right, left)
            log_z += np.log(ends.sum(axis=1)).sum() + (tails * math.log(top)).sum()
            now = power(np.ones((docs, 2)), tails, left.T, right.T)
            after = np.ones((docs, wide, 2))  # just before the token, as seen from behind
            for j in range(wide - 1, -1, -1):
                behind[:, j] = now
                if j:
                    after[:, j] = (emit[:, j] * now) @ move.T
                    step = power(after[:, j], gaps[:, j], left.T, right.T)
                    now = np.where(there[:, j, None], step / step.sum(axis=1, keepdims=True), now)
            both = ahead * behind
            p = both[:, :, 1] / both.sum(axis=2) * there
            by_feature += np.bincount(ids.ravel(), weights=np.repeat(p.ravel(), ids.shape[2]), minlength=len(weights))
            level += p.sum()
            begin += p[:, 0].sum()
            # The move into each marked token, then those within the runs of plain ones: before a token, and after the last.
            k, j = np.nonzero(there[:, 1:])
            j += 1
            into = over[k, j][:, :, None] * move * (emit[k, j] * behind[k, j])[:, None, :]
            got += (into / into.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            rows = np.concatenate([ahead[k, j - 1], ahead[np.arange(docs), last]])
            columns = np.concatenate([after[k, j], np.ones((docs, 2))])
            m = np.concatenate([gaps[k, j], tails])
            rows, columns, m = rows[m > 0], columns[m > 0], m[m > 0]
            x, y = rows @ right, columns @ left.T
            sums = np.empty((len(m), 2, 2))
            sums[:, 0, 0], sums[:, 1, 1] = m, m * ratio ** (m - 1)
            sums[:, 0, 1] = sums[:, 1, 0] = (1 - ratio**m) / (1 - ratio)
            z = top * (x[:, 0] * y[:, 0] + ratio**m * x[:, 1] * y[:, 1])
            weighed = (x[:, :, None] * y[:, None, :] * sums / z[:, None, None]).sum(axis=0)
            inside = plain * (left.T @ weighed @ right.T)  # sum over eigenvectors i, j of left[i, a] weighed[i, j] right[b, j]
            got += inside
            level += inside[:, 1].sum()
        return by_feature, got, level, begin, log_z


def tokens(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def fit(texts: list[str], toxic: list[int], *, least: int = 3, rounds: int = 60, prior: float = 1.0) -> Model:
    """A model from labelled texts, whole.

    A feature is tied to toxicity if at least ``least`` toxic texts hold it and
    its log odds, with half a count on each side, lie two standard errors above
    1. Every text is one chain from its first token to its last; in toxic texts
    the words with such a feature are the toxic tokens. Weights and moves are
    fitted by gradient ascent on the conditional likelihood with an L2 penalty,
    each step scaled by how often the parameter is seen.
    """
    n_bad = sum(toxic)
    n_good = len(texts) - n_bad
    pool: dict[str, str] = {}
    split = [tuple(pool.setdefault(w, w) for w in tokens(t)) for t in texts]  # equal words are one object
    del pool
    bad = Counter(f for words, y in zip(split, toxic) if y for f in {f for w in set(words) for f in features(w)})
    bad = {f: k for f, k in bad.items() if k >= least}
    good = Counter(f for words, y in zip(split, toxic) if not y for f in {f for w in set(words) for f in features(w) if f in bad})
    tied = []
    for f, k in bad.items():
        a, b, c, d = k + 0.5, n_bad - k + 0.5, good[f] + 0.5, n_good - good[f] + 0.5
        if math.log(a * d / (b * c)) - 2 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d) > 1:
            tied.append(f)
    index = {f: i + 1 for i, f in enumerate(sorted(tied))}  # 0: no feature
    per = 1 + len(HEADS)
    heads = frozenset(f.rstrip("*")[: HEADS[0]] for f in index)

    def numbers(word: str) -> list[int]:
        got = [index[f] for f in features(word) if f in index] if word[: HEADS[0]] in heads else []
        return got + [0] * (per - len(got)) if got else []

    known = {w: got for words in split for w in words if (got := numbers(w))} if index else {}
    chains = Chains([(len(words), [(i, known[w]) for i, w in enumerate(words) if w in known], bool(y)) for words, y in zip(split, toxic) if words], per)
    del split
    weights, bias, first, moves = np.zeros(len(index) + 1), 0.0, 0.0, np.zeros((2, 2))
    count, gold_feature, gold_level, gold_first = np.zeros(len(weights)), np.zeros(len(weights)), 0, 0
    for ids, gold, _, there, _ in chains.blocks:
        count += np.bincount(ids[there].ravel(), minlength=len(weights))
        gold_feature += np.bincount(ids[gold].ravel(), minlength=len(weights))
        gold_level, gold_first = gold_level + int(gold.sum()), gold_first + int(gold[:, 0].sum())
    seen = chains.gold_moves()
    for _ in range(rounds):
        expected, got, level, begin, _ = chains.expected(weights, bias, first, moves)
        weights += RATE * (gold_feature - expected - prior * weights) / (count + prior)
        weights[0] = 0.0
        bias += RATE * float(np.clip((gold_level - level - prior * bias) / (gold_level + min(level, chains.tokens - level) + prior), -1, 1))
        first += RATE * (gold_first - begin - prior * first) / (chains.count + prior)
        moves += RATE * np.clip((seen - got - prior * moves) / (np.minimum(seen, got) + prior), -1, 1)
    model = Model(
        {f: float(weights[i]) for f, i in index.items()}, float(bias), float(first), tuple(map(tuple, moves.tolist())),
        heads,
    )
    # The score: a logistic curve over the evidence, with a prior of one text of each label.
    scorer = Scorer(model)
    x = np.array([scorer.evidence(*scorer.tagged(w)) for w in map(str.split, texts)] + [0.0, 2.0])
    y = np.array([float(v) for v in toxic] + [0.0, 1.0])
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = np.maximum(p * (1 - p), 1e-9)
        ridge = 1e-3
        g = np.array([(y - p).sum() - ridge * a, ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return replace(model, offset=a, slope=max(0.0, b))


class Scorer:
    """Scores texts by a model. Tokens are what white space separates; a
    token's gain is the largest of the words in it. At most ``cache`` tokens
    are remembered with their gains."""

    def __init__(self, model: Model, cache: int = 300_000):
        self.model, self.cache, self.known = model, cache, {}

    def gains(self, words: list[str]) -> dict[int, float]:
        """Place and gain of the tokens that hold a word with a weight."""
        known, gain = self.known, self.model.gain
        if len(known) > self.cache:
            known.clear()
        found = list(map(known.get, words))  # 0 for a word without a weight, None for a new one
        if None in found:
            for w in {w for w, g in zip(words, found) if g is None}:
                known[w] = max((g for part in WORD.findall(w) if (g := gain(part.lower())) is not None), default=0)
            found = list(map(known.__getitem__, words))
        return {i: g for i, g in enumerate(found) if g != 0} if any(found) else {}

    def tagged(self, words: list[str]) -> tuple[list[float], list[int]]:
        """P(toxic) along the whole text, and where each run of equal values ends."""
        return self.model.sparse_marginals(len(words), self.gains(words)) if words else ([], [])

    def evidence(self, p: list[float], ends: list[int]) -> float:
        """log1p of the expected number of toxic words, beyond what as many of
        the text's least likely token would give."""
        ground = min(p, default=0.0)
        return math.log1p(sum((v - ground) * (end - begin) for v, begin, end in zip(p, [0, *ends], ends)))

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score from 0 to 1, and the spans (start, end, mean P(toxic)) in code points, end exclusive."""
        words = text.split()
        values, ends = self.tagged(words)
        score = 1 / (1 + math.exp(-(self.model.offset + self.model.slope * self.evidence(values, ends))))
        toxic = [(i, p) for p, low, high in zip(values, [0, *ends], ends) if p >= 0.5 for i in range(low, high)]
        if not toxic:
            return score, []
        found = [m.span() for m in re.finditer(r"\S+", text)]
        runs: list[list[tuple[int, float]]] = []
        for i, p in toxic:
            if runs and i == runs[-1][-1][0] + 1:
                runs[-1].append((i, p))
            else:
                runs.append([(i, p)])
        return score, [(found[r[0][0]][0], found[r[-1][0]][1], sum(p for _, p in r) / len(r)) for r in runs]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_chars: int) -> list[tuple[int, str, int]]:
    """Labelled rows outside the held-out third, whole texts: the first in the
    order of a hash of the id, at most ``most`` of them; one with which they
    would exceed ``most_chars`` together is left out, the next ones are tried.
    Only the fit is bounded; every text is scored whole. If none fits, that is
    an error. An id that occurs several times counts with its
    smallest text and its largest label."""
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    marks = marks.where(crc % 3 != 1).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.xxhash64("id")
    # First the hashes and lengths of the rows in question, then the texts of those that fit.
    first = texts.select("id", F.length("text").alias("n")).join(marks, "id").groupBy("id", "y").agg(F.max("n").alias("n")).orderBy(order, "id").limit(most).collect()
    chosen, total = {}, 0
    for r in first:
        if total + r.n <= most_chars:
            total += r.n
            chosen[r.id] = int(r.y)
    if not chosen:
        if first:
            raise ValueError(f"none of the {len(first)} labelled texts has at most {most_chars} characters")
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "id bigint")  # at most ``most``
    rows = texts.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).collect()
    return sorted((r.id, r.text, chosen[r.id]) for r in rows)


#: Bounds of the sample that the chain is fitted on: rows, and characters of all its texts together.
TRAINING_ROWS, TRAINING_CHARS = 4000, 20_000_000


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAINING_ROWS, most_chars: int = TRAINING_CHARS
) -> Model:
    rows = training_rows(docs, labels, id_col, text_col, label_col, most, most_chars)
    return fit([t for _, t, _ in rows], [int(y > 0) for _, _, y in rows])


def tag_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on) and spans
    (array of start, end, p) of each whole text.

    A null text counts as empty and has the score of no toxic token; repeated
    rows give repeated results; other columns are not read.
    """
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, scorer = Rows(schema), Scorer(model)
        for doc, text in values(batches, "doc_id", "text"):
            score, spans = scorer.judge(text or "")
            rows.add(doc, score, int(score >= threshold), [dict(zip(("start", "end", "p"), s)) for s in spans], weight=24 * len(spans))
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and spans (start:end of each
    offending stretch in code points, end exclusive, comma-joined) of all
    documents, from a model trained on the labelled rows that are not held out.

    A null text counts as empty; a null id is not held out; repeated rows give
    repeated results; without labels no document is toxic; other columns are
    not read; an empty table gives no rows.
    """
    done = tag_spans(docs, train(docs, labels))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), listed.alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more.

    A null or empty text has no toxic word and stays; repeated rows are judged
    alike; without labels nothing is toxic. An empty table stays empty.
    """
    model = train(docs, labels, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                calm = [scorer.judge(t or "")[0] < threshold for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(calm, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
