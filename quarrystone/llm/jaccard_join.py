"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Documents with the same set of word n-grams form a class. Each tree of the
forest gives a class a string of ``longest`` MinHash values; all strings of a
tree, sorted, are its prefix trie, and a class's longest match is with a
neighbour in that order. The whole forest is one table sorted by (tree and
first values, other values), dealt out by ranges, so that no prefix, however
common, makes a large task. Each class is linked to the first of the run that
shares its longest match; classes that share a prefix of some length are then
connected by links of at least that length.

The matches used are first those of full length. A bounded sample of them is
compared exactly; the similarities found, each weighted by the inverse of its
chance to be found at that length, estimate what a length finds of all links.
The prefix is shortened to the longest at which this reaches the target
recall. The components at that length hold the candidates; in each every pair
is compared exactly, in blocks if a component is large. The links of this full
pass give the estimate again, and if it falls short the prefix is shortened
further, down to the length at which pairs just at the threshold are found
with the target recall, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.core.names import free_names
from quarrystone.core.shared import written
from quarrystone.llm.arrow import Rows, values
from quarrystone.llm.components import connected_components
from quarrystone.llm.substring_dedup import Hasher, words_of

WORDS, THRESHOLD, TREES, LONGEST, RECALL = 5, 0.8, 32, 10, 0.9999
#: Of a block that is compared in one task: n-grams, and what each document adds to them.
BLOCK, EACH = 400_000, 400
#: Matched pairs of the sample that the first prefix length is fitted on, and steps of similarity that links are counted by.
FIT_PAIRS, STEPS = 2000, 50


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with probability ``recall``: no shorter one is needed on any data."""
    depth = longest
    while depth > 1 and found_share(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def estimated_recall(counts: dict[float, int], seen_at: int, depth: int, trees: int = TREES) -> float:
    """The share of all links that prefixes of ``depth`` find, judged by links
    (similarity: how many) found at ``seen_at``; each stands for as many as its
    chance to be found says. Without any, nothing is known: 0."""
    weights = {s: n / found_share(s, seen_at, trees) for s, n in counts.items() if n}
    total = sum(weights.values())
    return sum(w * found_share(s, depth, trees) for s, w in weights.items()) / total if total else 0.0


def shortened(counts: dict[float, int], seen_at: int, floor: int, trees: int, recall: float) -> int:
    """The longest prefix up to ``seen_at`` whose estimated recall reaches the target, ``floor`` at least."""
    depth = seen_at
    while depth > floor and estimated_recall(counts, seen_at, depth, trees) < recall:
        depth -= 1
    return depth


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words; a shorter text is one run, an empty one has none."""
    found = words_of(text)
    if not found:
        return np.empty(0, "u8")
    length = min(words, len(found))
    return np.unique(Hasher(found).at(np.arange(len(found) - length + 1), length).view("u8"))


class Forest:
    """MinHash strings of sets of 64-bit hashes, one for each tree: a key, which
    stands for the tree and the first ``floor`` values, and the other values."""

    def __init__(self, trees: int, longest: int, floor: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = trees * longest
        self.trees, self.longest, self.floor = trees, longest, floor
        self.factors = rng.integers(0, 1 << 32, n, "u4", endpoint=False) | np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, n, "u4", endpoint=False)
        self.mix = rng.integers(0, 1 << 63, (trees, floor), "u8") | np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, trees, "u8")

    def strings(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees,) keys as signed numbers, and (trees, longest - floor) other values."""
        halves, least = (x.astype("u4"), (x >> np.uint64(32)).astype("u4")), None
        for at in range(0, len(x), 512):
            # Half the functions see the low bits of a hash and half the high ones.
            part = np.concatenate([(h[at : at + 512, None] * self.factors[i::2] + self.shifts[i::2]).min(axis=0) for i, h in enumerate(halves)])
            least = part if least is None else np.minimum(least, part)
        values = least.reshape(self.trees, self.longest)
        h = (values[:, : self.floor].astype("u8") * self.mix).sum(axis=1, dtype="u8") + self.salt
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xD6E8FEB86659FD93)).view("i8"), values[:, self.floor :]


def packed(values: np.ndarray) -> np.ndarray:
    """Rows of 32-bit values, two to a signed 64-bit number, the last one alone if they are odd in number."""
    if values.shape[1] % 2:
        values = np.concatenate([values, np.zeros((len(values), 1), "u4")], axis=1)
    wide = values.astype("u8")
    return (wide[:, ::2] << np.uint64(32) | wide[:, 1::2]).view("i8")


def signatures(docs: DataFrame, words: int, trees: int, longest: int, floor: int) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, mark (a hash of the
    text), c1 and c2 (128 bits that stand for its set of n-grams), n of them,
    and its strings: keys, and the packed other values one tree after the
    other. Both are null without n-grams."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rows = Forest(trees, longest, floor), Rows(schema)
        for doc, mark, text in values(batches, "doc_id", "mark", "text"):
            x = shingles(text, words)
            if len(x):
                whole = xxhash.xxh3_128_intdigest(x.tobytes())
                keys, rest = forest.strings(x)
                rows.add(doc, mark, _signed(whole >> 64), _signed(whole), len(x), keys, packed(rest).ravel(), weight=2000)
            else:
                rows.add(doc, mark, 0, 0, 0, None, None)
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    return docs.mapInArrow(run, "doc_id bigint, mark bigint, c1 bigint, c2 bigint, n bigint, keys array<bigint>, rest array<bigint>")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def prefix_links(classes: DataFrame, trees: int, longest: int, floor: int) -> DataFrame:
    """(a, b, depth), a > b: classes (number, keys, rest) that share a prefix of
    ``depth`` values, ``floor`` at least, in some tree. The classes under one
    node of length d are connected by links of depth d or more.

    A pass over the sorted strings. A string's longest match is with the one
    before it; it is linked to the first of the run that shares this match. The
    ends of each range meet those of the next in a table of two rows a range.
    """
    width = -(-(longest - floor) // 2)
    parts = [f"r{i}" for i in range(width)]
    one = F.explode(F.arrays_zip(F.col("keys").alias("key"), F.sequence(F.lit(0), F.lit(trees - 1)).alias("tree"))).alias("at")
    other = [F.get(F.col("rest"), F.col("at.tree") * width + i).alias(p) for i, p in enumerate(parts)]
    strings = classes.select("number", "rest", one).select(F.col("at.key").alias("key"), *other, "number")
    order = ["key", *parts, "number"]
    ranges = max(2, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32()), *[(c, pa.int64()) for c in order]])

    def matched(columns: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """How many values each string shares with the one before it: 0, or ``floor`` and more."""
        alive = columns[0] == before[0]
        depth = np.where(alive, floor, 0).astype("i4")
        for i in range(width):
            x, y = columns[1 + i], before[1 + i]
            alive = alive & (x >> 32 == y >> 32)
            depth += alive
            if 2 * i + 1 < longest - floor:
                alive = alive & (x == y)
                depth += alive
        return depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        starts = dict.fromkeys(range(floor, longest + 1), 0)  # the first class of the present run of each depth
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in order]
            if first is None:
                first = [c[0] for c in columns]
            ahead = [np.concatenate([[c[0] if last is None else v], c[:-1]]) for c, v in zip(columns, last or columns)]
            depth, number = matched(columns, ahead), columns[-1]
            if last is None:
                depth[0] = 0
            parent, at = number.copy(), np.arange(len(number))
            for d in range(floor, longest + 1):
                begun = np.maximum.accumulate(np.where(depth < d, at, -1))
                head = np.where(begun < 0, starts[d], number[np.maximum(begun, 0)])
                parent = np.where(depth == d, head, parent)
                starts[d] = int(head[-1])
            last = [c[-1] for c in columns]
            keep = parent != number
            a, b = np.maximum(parent, number)[keep], np.minimum(parent, number)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(depth[keep]), *[pa.nulls(len(a), pa.int64()) for _ in order]], schema=schema)
        if first is not None:
            ends = [[int(v) for v in pair] for pair in zip(first, last)]
            yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int32()), *[pa.array(c, pa.int64()) for c in ends]], schema=schema)

    dealt = strings.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = written(dealt.mapInArrow(run, "a bigint, b bigint, depth int, " + ", ".join(f"{c} bigint" for c in order)), "prefixes")
    # The ends of the ranges, two rows each, are matched on the driver's terms: a window over that many rows.
    ends = Window.orderBy(*order)
    lag = lambda c: F.lag(c).over(ends)
    alive, depth = F.col("key") == lag("key"), F.lit(0)
    depth = F.when(alive, floor).otherwise(0)
    for i, p in enumerate(parts):
        alive = alive & (F.shiftright(p, 32) == F.shiftright(lag(p), 32))
        depth = depth + F.when(alive, 1).otherwise(0)
        if 2 * i + 1 < longest - floor:
            alive = alive & (F.col(p) == lag(p))
            depth = depth + F.when(alive, 1).otherwise(0)
    met = found.where("a is null").select("number", lag("number").alias("before"), depth.alias("depth")).where("depth > 0 and number <> before")
    met = met.select(F.greatest("number", "before").alias("a"), F.least("number", "before").alias("b"), F.col("depth").cast("int").alias("depth"))
    return found.where("a is not null").select("a", "b", "depth").unionByName(met).groupBy("a", "b").agg(F.max("depth").alias("depth"))


def _linked(sets: list[np.ndarray], sizes: np.ndarray, cut: int | None, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) of sets with a Jaccard similarity of at least the
    threshold, and this similarity in steps, rounded down; with ``cut``, only
    pairs from either side of it."""
    m = len(sets)
    if m <= 6:
        pairs = [(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True))) for i in range(m) for j in range(i + 1, m)]
        i, j, both = np.array(pairs, "i8").reshape(-1, 3).T
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), [len(s) for s in sets])
        keep = times[column] > 1  # what one set alone has is in no intersection
        row, column = row[keep], (np.cumsum(times > 1) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((m, m), "f4")
        step = max(256, 4_000_000 // m)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            low, high = np.searchsorted(column, [at, at + step])
            dense = np.zeros((m, step), "f4")
            dense[row[low:high], column[low:high] - at] = 1
            common += dense @ dense.T
        i, j = np.triu_indices(m, 1)
        both = common[i, j].astype("i8")
    union = sizes[i] + sizes[j] - both
    good = both * threshold.denominator >= union * threshold.numerator
    if cut is not None:
        good &= (i < cut) & (j >= cut)
    return i[good], j[good], both[good] * STEPS // union[good]


def _roots(m: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(m)]


def _similarity(a: np.ndarray, b: np.ndarray) -> Fraction:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return Fraction(both, len(a) + len(b) - both)


def _step(similarity: Fraction) -> int:
    return similarity.numerator * STEPS // similarity.denominator


def sampled_links(docs: DataFrame, classes: DataFrame, edges: DataFrame, words: int, exact: Fraction, most: int = FIT_PAIRS) -> dict[float, int]:
    """How many of a sample of at most ``most`` matched pairs (a, b) are links, by similarity rounded down."""
    picked = written(edges.orderBy(F.xxhash64("a", "b"), "a", "b").limit(most).select("a", "b", F.explode(F.array("a", "b")).alias("number")), "sample")
    named = picked.join(classes.select("number", "at", "mark"), "number").select("a", "b", "at", "mark")
    # At most 2 * most rows of four numbers.
    texts = docs.select(F.coalesce("doc_id", F.col("mark")).alias("at"), "mark", "text").join(F.broadcast(named), ["at", "mark"]).select("a", "b", "mark", "text")

    def compare(table: pa.Table) -> pa.Table:
        sets = [shingles(t, words) for t in dict(zip(table.column("mark").to_pylist(), table.column("text").to_pylist())).values()]
        got = _similarity(*sets) if len(sets) == 2 else Fraction(0)
        return pa.table({"step": pa.array([_step(got)] if got >= exact else [], pa.int32())})

    return {r.step / STEPS: r.n for r in texts.groupBy("a", "b").applyInArrow(compare, "step int").groupBy("step").agg(F.count("*").alias("n")).collect()}


def links(docs: DataFrame, signed: DataFrame, words: int, threshold: float, trees: int, longest: int, recall: float) -> DataFrame:
    """(c1, c2, top, links) of the classes that have links: the smallest number
    of their component, and the documents of the classes they are linked to."""
    floor, exact = prefix_length(threshold, trees, longest, recall), Fraction(threshold).limit_denominator(10_000)
    speaker = F.min(F.struct(F.coalesce("doc_id", F.col("mark")).alias("at"), "mark")).alias("speaker")
    # Copies are merged before anything is joined, so a class of very many is one row.
    merged = signed.where("n > 0").groupBy("c1", "c2").agg(speaker, F.count("*").alias("copies"), F.first("n").alias("n"), F.first(F.struct("keys", "rest")).alias("strings"))
    classes = written(merged.select(F.monotonically_increasing_id().alias("number"), "c1", "c2", "speaker.at", "speaker.mark", "copies", "n", "strings.keys", "strings.rest"), "classes")
    edges = written(prefix_links(classes, trees, longest, floor), "links")
    classes = classes.drop("keys", "rest")
    depth = longest
    if longest > floor:
        # The sample has to miss half as much as allowed, so that the full pass seldom falls short and is seldom repeated.
        depth = shortened(sampled_links(docs, classes, edges.where(F.col("depth") >= longest), words, exact), longest, floor, trees, 1 - (1 - recall) / 2)
    while True:
        found = verified(docs, classes, connected_components(edges.where(F.col("depth") >= depth).select("a", "b")), words, exact)
        counts = {r.number / STEPS: r.n for r in found.where("mate is null").groupBy("number").agg(F.sum("links").alias("n")).collect()}  # a row per step
        if depth == floor or estimated_recall(counts, depth, depth, trees) >= recall:
            break
        depth = min(depth - 1, shortened(counts, depth, floor, trees, recall))
    found = found.where("mate is not null")
    top = found.where("whole").select("number", F.col("mate").alias("top"))
    pieces = found.where("not whole")
    if not pieces.isEmpty():  # components of several blocks
        roots = connected_components(pieces.select(F.col("number").alias("a"), F.col("mate").alias("b")).where("a <> b"))
        top = top.unionByName(roots.select(F.col("node").alias("number"), F.col("root").alias("top")))
    counted = found.groupBy("number").agg(F.sum("links").alias("links"))
    return classes.select("number", "c1", "c2").join(counted, "number").join(top, "number").select("c1", "c2", "top", "links")


def verified(docs: DataFrame, classes: DataFrame, comps: DataFrame, words: int, exact: Fraction) -> DataFrame:
    """All pairs of classes in a component, compared exactly: (number, mate,
    links, whole) says to which smallest class of its task a class is linked,
    how many documents it is linked to there, and whether the task saw the
    whole component. Rows without a mate count pairs by similarity (number:
    in steps of 1 / STEPS, rounded down)."""
    members = classes.join(comps.withColumnRenamed("node", "number"), "number")
    weight = F.col("n") + EACH
    sized = members.groupBy("root").agg(F.sum(weight).alias("weight"))
    blocks = sized.select("root", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks"))
    bins = max(1, -(-int(sized.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]) // BLOCK))
    block = F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")
    placed = members.join(blocks, "root").select("number", "root", "at", "mark", "copies", "blocks", block.alias("block"))
    # Always a shuffle: the classes in question grow with the corpus, so a broadcast that small inputs allow would only hide the cost.
    texts = docs.select(F.coalesce("doc_id", F.col("mark")).alias("at"), "mark", "text").join(placed.hint("merge"), ["at", "mark"])

    # A component of one block shares a task with others; of a larger one each pair of blocks is a task.
    low, high = F.least("block", F.col("p")), F.greatest("block", F.col("p"))
    sets = _sets(texts, words)
    dealt = sets.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("group"),
        F.when(F.col("blocks") == 1, -1).otherwise(low).alias("low"), F.when(F.col("blocks") == 1, -1).otherwise(high).alias("high"),
        "number", "root", "copies", "block", "x",
    )

    def compare(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        by_root: dict[int, dict[int, tuple]] = {}
        lists = table.column("x").combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view("u8"), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        for k, (number, root, copies, block) in enumerate(zip(*(table.column(c).to_pylist() for c in ("number", "root", "copies", "block")))):
            begin = int(ends[k - 1]) if k else 0
            by_root.setdefault(root, {})[number] = (block, copies, flat[begin : int(ends[k])])  # a repeated row counts once
        out: list[tuple[int, int | None, int]] = []
        steps = np.zeros(STEPS + 1, "i8")
        for members in by_root.values():
            numbers = sorted(members, key=lambda k: (members[k][0], k))
            sets = [members[k][2] for k in numbers]
            cut = None if low == high else sum(members[k][0] == low for k in numbers)
            i, j, step = _linked(sets, np.array([len(s) for s in sets], "i8"), cut, exact)
            steps += np.bincount(step, minlength=STEPS + 1)
            copies, count = np.array([members[k][1] for k in numbers], "i8"), np.zeros(len(numbers), "i8")
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            for k, r in enumerate(_roots(len(numbers), i, j)):
                if count[k]:
                    out.append((numbers[k], numbers[r], int(count[k])))
        out += [(int(k), None, int(steps[k])) for k in np.flatnonzero(steps)]
        a, b, n = zip(*out) if out else ((), (), ())
        return pa.table({"number": pa.array(a, pa.int64()), "mate": pa.array(b, pa.int64()), "links": pa.array(n, pa.int64()), "whole": pa.array([low < 0] * len(a), pa.bool_())})

    return written(dealt.groupBy("group", "low", "high").applyInArrow(compare, "number bigint, mate bigint, links bigint, whole boolean"), "verified")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("number", pa.int64()), ("root", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int32()), ("block", pa.int32()), ("x", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for *head, text in values(batches, "number", "root", "copies", "blocks", "block", "text"):
            x = shingles(text, words)
            rows.add(*head, x.view("i8"), weight=8 * len(x))
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    return texts.mapInArrow(run, "number bigint, root bigint, copies bigint, blocks int, block int, x array<bigint>")


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    longest: int = LONGEST,
    recall: float = RECALL,
) -> DataFrame:
    """doc_id, class_id and n_links of each document.

    A link joins two documents whose sets of ``words``-word runs have a Jaccard
    similarity of at least ``threshold``; n_links counts a document's links,
    copies included. class_id is the smallest doc_id of all documents that it
    is linked to directly or through others, itself included.

    A null or empty text, or one of white space, has no runs and no link. A
    text of fewer words is one run. Repeated rows are linked to each other.
    Null ids take part; a class of nulls alone has class_id null. Other columns
    are not read; an empty table gives no rows.
    """
    return _classed(docs, id_col, text_col, words, threshold, trees, longest, recall).select("doc_id", "class_id", "n_links")


def _classed(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> DataFrame:
    """The rows of ``jaccard_join`` with mark, the hash of the text, n, its runs, and k1 and k2, which name its class also where ids repeat or are null."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    signed = written(signatures(source, words, trees, longest, prefix_length(threshold, trees, longest, recall)), "signatures")
    classes = signed.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    linked = links(source, signed, words, threshold, trees, longest, recall)
    known = classes.join(linked, ["c1", "c2"], "left")
    tops = known.where("top is not null").groupBy("top").agg(F.min("first").alias("lead"))
    known = known.join(tops, "top", "left").select(
        "c1", "c2", F.coalesce("top", "c1").alias("k1"), F.when(F.col("top").isNull(), F.col("c2")).otherwise(-1).alias("k2"), F.coalesce("lead", F.when(F.col("top").isNull(), F.col("first"))).alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    done = signed.select("doc_id", "mark", "c1", "c2", "n").join(known, ["c1", "c2"], "left")
    alone = F.col("n") == 0
    return done.select("doc_id", "mark", "n", "k1", "k2", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"))


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(mark, page): for the hash of each text, null as an empty one, a number
    that it shares with all texts it is linked to directly or through others."""
    # A key for each id and text: a group of copies stays as many keys as it has ids.
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("at"), F.col(text_col).alias("text"))
    return _classed(keyed, "at", "text", **options).groupBy("mark").agg(F.min("class_id").alias("page"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one whose id names it.

    Null, empty and blank texts have no class and stay; other columns stay as
    they are. Repeated rows of one id and text are one document and leave one row. A row
    without an id goes if its class holds an id; rows of a class of nulls alone
    all stay.
    """
    ident, mark = F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # A document is its id and the hash of its text: hashes alone would meet by chance among enough documents.
    found = _classed(docs, id_col, text_col, **options).where("n > 0")
    classes = written(found.groupBy("doc_id", "mark").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.count("*").alias("rows")), "members")
    # Written, so that the join of a class's members with their lead can be split, however many they are.
    leads = written(classes.where("doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "mark")).alias("lead")), "leads")
    goes = classes.join(leads, ["k1", "k2"]).where(~(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("mark") == F.col("lead.mark"))))
    own, text, own_2, text_2 = free_names(docs.columns, "_own", "_mark", "_own_2", "_mark_2")
    named = lambda part: part.select(F.col("doc_id").alias(own_2), F.col("mark").alias(text_2))
    same = F.col(own).eqNullSafe(F.col(own_2)) & (F.col(text) == F.col(text_2))
    kept = docs.withColumns({own: ident, text: mark}).join(named(goes), same, "left_anti")
    again = named(classes.where("doc_id is not null and rows > 1"))
    one = kept.join(again, same, "left_semi").dropDuplicates([own, text])
    return kept.join(again, same, "left_anti").unionByName(one).select(*docs.columns)
