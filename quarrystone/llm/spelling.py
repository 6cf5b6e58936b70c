"""Spelling variants: frequent words one edit apart, by a trie self-join with active nodes.

The vocabulary is a trie cut into partitions by what lies on either side of a
block of places: two words one edit apart agree before the block that holds
the edit and after it. So each word is dealt out once for the first half of
its places and once for the second, as the shorter and as the longer of a pair
(a longer word's places after the block lie one further on). What is between
makes the partition's own trie. Down it goes, for each node, the set of active
nodes: those at distance one at most, each with its distance, derived from the
parent's set; terminal nodes at distance one of a terminal node are pairs. A
pair counts in the block that holds the first place where the words differ.

A partition of more than ``most`` words is dealt out anew by shorter blocks, so
that its size is bounded, in the end by what two letters can spell.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.llm.arrow import Rows, values

# Fixed values of the contract: letters, every how many runs one loses a letter, and bounds of the vocabulary.
LETTERS, EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = "[A-Za-zÀ-ÿ]+", 199, 6, 5, 5
#: Words up to which a partition is one trie, and into how many blocks a larger one's block is cut.
MOST, PIECES = 2_000, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, every: int = EVERY) -> DataFrame:
    """word, n of all letter runs, lower-cased from A to Z; a run whose checksum
    with its document's id ``every`` divides loses one letter."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTERS})"))).alias("run"),
    )
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    mark = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("mark") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select("run", mark.alias("mark")).select(F.when(F.col("mark") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


class Trie:
    """A trie of short strings; ``ends`` has what is stored at each node."""

    def __init__(self) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list] = [[]]

    def add(self, key: str, item) -> None:
        node = 0
        for c in key:
            if c not in self.kids[node]:
                self.kids[node][c] = len(self.kids)
                self.kids.append({})
                self.ends.append([])
            node = self.kids[node][c]
        self.ends[node].append(item)

    def active_below(self, active: dict[int, int], letter: str) -> dict[int, int]:
        """Nodes within distance one of a child, and their distances, from those of its parent (``letter`` leads to the child)."""
        out: dict[int, int] = {}
        for node, d in active.items():
            for c, kid in self.kids[node].items():
                far = d if c == letter else d + 1
                if far <= 1 and out.get(kid, 2) > far:
                    out[kid] = far
            if d == 0 and out.get(node, 2) > 1:
                out[node] = 1  # the child's letter is one too many
        return self.with_kids(out)

    def with_kids(self, active: dict[int, int]) -> dict[int, int]:
        """``active`` and the children of what is at distance zero: one letter too few."""
        for node in [n for n, d in active.items() if d == 0]:
            for kid in self.kids[node].values():
                active.setdefault(kid, 1)
        return active

    def pairs(self) -> Iterator[tuple]:
        """Each (a, b) stored at nodes one edit apart, and (b, a)."""
        below = [(0, self.with_kids({0: 0}))]
        while below:
            node, active = below.pop()
            if self.ends[node]:
                for other, d in active.items():
                    if d == 1:
                        for a in self.ends[node]:
                            for b in self.ends[other]:
                                yield a, b
            for c, kid in self.kids[node].items():
                below.append((kid, self.active_below(active, c)))


def near_in_partition(words: Iterable[tuple[str, int]], short: int, start: int, end: int) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its n) among the words of one partition: those of
    ``short`` code points and of one more that agree before place ``start`` and,
    but for the edit, from ``end`` on."""
    trie, stop = Trie(), min(end, short)
    for word, n in words:
        trie.add(word[start : stop + len(word) - short], (word, n))
    for (a, _), (b, n) in trie.pairs():
        if len(a) > short and len(b) > short:  # as the shorter words of the next length
            continue
        place = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), short)
        # The keys are hashes: what lies outside the block is compared, too.
        if start <= place < end and a[place + (len(a) >= len(b)) :] == b[place + (len(b) >= len(a)) :]:
            yield a, b, n


def _dealt(words: DataFrame, blocks: Column) -> DataFrame:
    """word, n and key columns of each word for each of its ``blocks`` (short, start, end)."""
    rows = words.select("word", "n", F.explode(blocks).alias("b")).select("word", "n", "b.short", "b.start", "b.end")
    after = F.least("end", "short") + F.length("word") - F.col("short")
    head, tail = F.col("word").substr(F.lit(1), F.col("start")), F.col("word").substr(after + 1, F.length("word"))
    return rows.withColumns({"head": F.xxhash64(head, "start"), "tail": F.xxhash64(tail, "end")})


_KEY = ["short", "start", "end", "head", "tail"]


def _block(short: Column, start: Column, end: Column) -> Column:
    return F.struct(short.cast("int").alias("short"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def near_words(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near and best (largest n, then smallest near word, as struct of
    ``less`` (-n) and ``word``) of each word of ``vocabulary`` (word, n) that
    has words one edit apart."""
    size = F.length("word")
    halves = F.flatten(
        F.transform(
            F.array(size, size - 1),
            lambda short: F.array(_block(short, F.lit(0), F.floor(short / 2)), _block(short, F.floor(short / 2), short + 1)),
        )
    )
    dealt, tables = _dealt(vocabulary, halves), []
    while True:
        sizes = dealt.groupBy(*_KEY).agg(F.count("*").alias("size")).where("size > 1")
        sizes = written(sizes, "trie_sizes")
        shared = dealt.join(sizes, _KEY)
        large = (F.col("size") > most) & (F.col("end") - F.col("start") > 1)
        tables.append(written(_pairs(shared.where(~large).drop("size")), "near_words"))
        hot = sizes.where(large)
        if hot.isEmpty():
            break
        step = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / PIECES)).cast("int")
        starts = F.sequence("start", F.col("end") - 1, step)
        finer = dealt.join(hot.select(*_KEY), _KEY, "left_semi")
        cut = F.transform(starts, lambda s: _block(F.col("short"), s, F.least(s + step, F.col("end"))))
        dealt = written(_dealt(finer, cut).select("word", "n", *_KEY), "trie_blocks")
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _pairs(dealt: DataFrame) -> DataFrame:
    """What each partition says of its words: word, n_near, best."""
    best = pa.struct([("less", pa.int64()), ("word", pa.string())])
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", best)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)

        def close(key: tuple, words: list[tuple[str, int]]) -> None:
            near: dict[str, tuple[int, int, str]] = {}
            if len(words) > 1:
                for a, b, n in near_in_partition(words, *key[:3]):
                    count, *top = near.get(a, (0, -n, b))
                    near[a] = (count + 1, *min(tuple(top), (-n, b)))
            for word, (count, less, other) in near.items():
                rows.add(word, count, {"less": less, "word": other}, weight=len(word) + len(other))

        now, words = None, []
        for word, n, *key in values(batches, "word", "n", *_KEY):
            if key != now:
                if words:
                    close(now, words)
                    if rows.full():
                        yield rows.batch()
                now, words = key, []
            words.append((word, n))
        if words:
            close(now, words)
        yield rows.batch()

    # Only groups of a bounded size come here: a key's words lie side by side in one task.
    laid = dealt.select("word", "n", *_KEY).repartition(*_KEY).sortWithinPartitions(*_KEY)
    return laid.mapInArrow(run, "word string, n_near bigint, best struct<less: bigint, word: string>")


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """word and root of each row (word, form; null: none): the end of its chain
    of forms, of at most ``longest`` steps, by doubling."""
    now, steps = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots"), 1
    while steps < longest:
        onward = now.where("word <> root").select(F.col("word").alias("via"), F.col("root").alias("onward"))
        ends = now.join(onward, F.col("root") == F.col("via"), "left")
        now, steps = written(ends.select("word", F.coalesce("onward", "root").alias("root")), "roots"), 2 * steps
    return now


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, most: int = MOST,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the vocabulary.

    ``form`` is the near word of largest n, if that is at least ``ratio`` times
    the word's own, and ``root`` the end of the chain of forms.

    Defined results: null and empty texts have no words; a null id stands for
    an empty string in the checksum; repeated rows count again; of equally
    frequent near words the smallest in code-point order is the form; a table
    without words gives no rows; other columns are not read. Memory is bounded
    by the longest text and by ``most`` words a partition.
    """
    if least_length < 3 or ratio < 2:
        raise ValueError("words of three letters and a ratio of two at least")
    counts = word_counts(docs, id_col, text_col, every=every)
    vocabulary = written(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "vocabulary")
    near = near_words(vocabulary, most)
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    known = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), form.alias("form"))
    known = written(known.select("word", F.col("form.word").alias("form"), "n", "n_near", (-F.col("form.less")).alias("form_n")), "forms")
    top, steps = known.agg(F.max("n")).first()[0] or 0, 0
    while top >= ratio * least_count:  # each step of a chain multiplies n by the ratio at least
        top, steps = top // ratio, steps + 1
    ends = roots(known, steps)
    return known.join(ends, "word").select("word", "form", "root", "n", "n_near", "form_n")


#: Checksums by table, deletions as keys of near words, and chains by recursion.
ORACLE = f"""WITH RECURSIVE
table256 AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM counted),
marked AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM bytes, table256),
words AS (SELECT CASE WHEN h % {EVERY} = 0 THEN run[: CAST(h % length(run) AS INTEGER)] || run[CAST(h % length(run) AS INTEGER) + 2 :] ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM marked GROUP BY 1),
vocabulary AS MATERIALIZED (SELECT word, n FROM words WHERE length(word) >= {LEAST_LENGTH} AND n >= {LEAST_COUNT}),
cuts AS MATERIALIZED (SELECT word, n, i, word[: i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocabulary v ON v.word = c.rest
    UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocabulary v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS top FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= {RATIO} * v.n THEN top.other END AS form, CASE WHEN -top.less >= {RATIO} * v.n THEN -top.less END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
chains(word, root, steps) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, steps + 1 FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(root, steps) AS root FROM chains GROUP BY word) c USING (word)"""
