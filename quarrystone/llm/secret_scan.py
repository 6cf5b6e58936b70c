"""Secret scans behind a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean query over trigrams is derived that every
match satisfies. The index has a posting list, in blocks of documents, of each
trigram that the queries name, over lower-cased text; a clause intersects the
lists of an alternative's trigrams and unites its alternatives, a query
intersects its clauses. The documents left are the rule's candidates, and only
these are matched against it. A rule without a mandatory trigram is matched
everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.core.names import free_names
from quarrystone.core.shared import written, written_bytes

BROADCAST_BYTES = 8_000_000
#: Documents whose postings lie in one block of the index.
BLOCK = 8192


class Rule(NamedTuple):
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group``
    has at least ``least`` characters; shorter ones are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so this finds what [0-9a-f]+ of 16 or more characters finds.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)

#: A query: every clause must hold; a clause holds if all trigrams of one of its alternatives are there.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The query of a regex, over lower-cased text; [] if no trigram is mandatory.

    Parts that can be spelled out in at most ``most`` ways join into strings;
    any other part ends the strings before it. Each stretch of strings of
    three or more characters becomes a clause.
    """
    clauses: Query = []

    def close(texts: set[str]) -> None:
        alternatives = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}
        if all(alternatives):
            clauses.append([a for a in alternatives if not any(b < a for b in alternatives)])

    def spelled(items: Iterable) -> set[str] | None:
        """All strings that the items match, or None if these are too many."""
        texts = {""}
        for item in items:
            one = part(item)
            if one is None or len(one) * len(texts) > most:
                return None
            texts = {a + b for a, b in product(texts, one)}
        return texts

    def part(item: tuple) -> set[str] | None:
        op, arg = item
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN and arg[0][0] is not sre.NEGATE:
            letters: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    letters.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < most:
                    letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return letters if len(letters) <= 8 else None
        if op is sre.SUBPATTERN:
            return spelled(arg[3])
        if op is sre.BRANCH:
            found = [spelled(x) for x in arg[1]]
            return None if any(x is None for x in found) else set().union(*found)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            if high is sre.MAXREPEAT or high > 4:
                return None
            one = spelled(inner)
            return None if one is None else {"".join(p) for n in range(low, high + 1) for p in product(one, repeat=n)}
        if op is sre.AT:
            return {""}
        return None

    def walk(items: Iterable) -> None:
        texts = {""}
        for item in items:
            one = part(item)
            if one is not None and len(one) * len(texts) <= most:
                texts = {a + b for a, b in product(texts, one)}
                continue
            close(texts)
            texts = {""} if one is None else one
            if one is None and item[0] is sre.SUBPATTERN:
                walk(item[1][3])
            elif one is None and item[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and item[1][0] > 0:
                walk(item[1][2])
        close(texts)

    walk(_parser.parse(pattern))
    return clauses


def postings(docs: DataFrame, key: Column, text: Column, trigrams: Sequence[str]) -> DataFrame:
    """(key, there): the documents, and which of the trigrams they hold, case aside."""
    there = _once(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))
    return docs.select(key.alias("key"), there.alias("there"))


def posting_lists(there: DataFrame, trigrams: Sequence[str], blocks: int) -> DataFrame:
    """A row per block of documents with the posting list, an array of keys, of
    each trigram (columns t0, t1, ...). Documents are dealt to blocks by a hash
    of their key, so a list holds about ``BLOCK`` keys however many there are."""
    block = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(blocks))
    pairs = there.select(block.alias("block"), "key", F.explode("there").alias("trigram"))
    lists = pairs.groupBy("block", "trigram").agg(F.collect_set("key").alias("docs"))
    lifted = F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists")
    nothing = F.array().cast("array<bigint>")
    by_trigram = [F.coalesce(F.try_element_at("lists", F.lit(t)), nothing).alias(f"t{i}") for i, t in enumerate(trigrams)]
    return lists.groupBy("block").agg(lifted).select("block", *by_trigram)


def candidates(lists: DataFrame, trigrams: Sequence[str], queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the rules whose query a document satisfies, by intersecting and uniting posting lists."""
    place = {t: f"t{i}" for i, t in enumerate(trigrams)}
    together = lambda columns: reduce(F.array_intersect, columns)
    either = lambda columns: reduce(F.array_union, columns)

    def answer(query: Query) -> Column:
        return together([either([together([F.col(place[t]) for t in sorted(alternative)]) for alternative in clause]) for clause in query])

    found = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), answer(q).alias("docs")) for kind, q in queries.items()]))
    flat = lists.select(found.alias("hit")).select("hit.kind", F.explode("hit.docs").alias("key"))
    return flat.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _running(parts: Column, start: Column, step) -> Column:
    """For each element of the integer array ``parts`` what ``step`` has made of
    ``start`` and the elements before it, and one value more at the end.

    Built in two levels, of about the square root of the length each, as an
    array that grows by appending costs the square of its own length.
    """
    none = F.array().cast("array<int>")

    def cut(parts: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(parts))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / wide).cast("int")), lambda k: F.slice(parts, k * wide + 1, wide))
        return F.when(F.size(parts) == 0, F.array().cast("array<array<int>>")).otherwise(chunks)

    def walk(values: Column, first: Column, by) -> Column:
        """(now, seen): the state after all of ``values``, and those before each."""
        begin = F.struct(first.alias("now"), none.alias("seen"))
        return F.aggregate(values, begin, lambda acc, v: F.struct(by(acc["now"], v).alias("now"), F.array_append(acc["seen"], acc["now"]).alias("seen")))

    def joined(chunks: Column) -> Column:
        outer = walk(chunks, start, lambda now, chunk: F.aggregate(chunk, now, step))
        return _once(outer, lambda o: F.array_append(F.flatten(F.zip_with(chunks, o["seen"], lambda chunk, first: walk(chunk, first, step)["seen"])), o["now"]))

    return _once(_once(parts, cut), joined)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, place of the rule, end) in code points, end exclusive.

    The text between matches and the matches come by split and extract; running
    sums of their lengths give the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    lengths = F.struct(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("long"), F.transform(held, F.length).alias("held"))

    def placed(of: Column) -> Column:
        steps = F.zip_with(of["gap"], of["long"], lambda gap, long: gap + long)
        ends = F.slice(_running(steps, F.lit(0), lambda at, n: at + n), F.lit(2), F.size(of["gap"]))
        spans = F.transform(F.arrays_zip(ends.alias("end"), of["long"].alias("long"), of["held"].alias("held")), lambda m: F.struct(
            (m["end"] - m["long"]).alias("start"), F.lit(order).alias("rule"), m["end"].alias("end"), m["held"].alias("held")
        ))
        kept = F.filter(spans, lambda m: m["held"] >= rule.least)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["rule"].alias("rule"), m["end"].alias("end")))

    return _once(lengths, placed)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(docs: DataFrame, text_col: str = "text", *, key: Column, rules: Sequence[Rule] = BASE + ADDED, spans: str = "spans") -> DataFrame:
    """``docs`` with a column more, named by ``spans``: the array of (start,
    rule, end) of all matches in order; ``rule`` is the place in ``rules``.

    ``key`` (bigint) tells rows apart; rows that share one share their
    candidates, which costs time and changes nothing. A null text counts as
    empty; repeated rows are each scanned; an empty table stays empty. Columns
    of ``docs`` may have any names but that of ``spans``.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for a in clause for t in a})
    joined, (own, kinds) = docs, free_names([*docs.columns, spans], "_key", "_kinds")
    if trigrams:
        there = written(postings(docs, key, F.col(text_col), trigrams), "postings")
        lists = posting_lists(there, trigrams, -(-there.where(F.size("there") > 0).count() // BLOCK) or 1)
        found = written(candidates(lists, trigrams, queries), "candidates").select(F.col("key").alias(own), F.col("kinds").alias(kinds))
        if written_bytes(found) <= BROADCAST_BYTES:
            found = F.broadcast(found)
        joined = docs.join(found, key == found[own], "left")
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    parts = []
    for i, r in enumerate(rules):
        asked = F.array_contains(kinds, r.kind) if r.kind in queries else F.rlike(F.col(text_col), F.lit(r.pattern))
        parts.append(F.when(asked, spans_of(F.col(text_col), r, i)).otherwise(none))
    out = joined.withColumn(spans, F.array_sort(F.concat(*parts)))
    return out.drop(own, kinds) if trigrams else out


def _listed(spans: Column, rules: Sequence[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def row_key(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text_col))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: Sequence[Rule] = ADDED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document.

    A null or empty text has no span, and the digest of an empty list; repeated
    rows give repeated results, rows without an id take part; other columns are
    not read; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rules = BASE + tuple(added)
    done = scan(source, key=row_key("doc_id", "text"), rules=rules).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("bigint").alias(f"n_{BASE[i].kind}")

    return done.select("doc_id", *map(count, range(len(BASE))), F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("spans"), rules).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each stretch of overlapping spans replaced by ``mask``.

    The kept stretches are cut in two levels: a text is read once for each of
    about the square root of its stretches, not once for each.
    """

    def pieces(kept: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(kept))).cast("int")

        def cut(chunk: Column) -> Column:
            base = F.element_at(chunk, 1)["start"]
            part = F.substring(text, base + 1, F.element_at(chunk, -1)["end"] - base)
            return _once(F.struct(part.alias("part"), chunk.alias("chunk"), base.alias("base")), lambda of: F.transform(of["chunk"], lambda s: F.substring(of["part"], s["start"] - of["base"] + 1, s["end"] - s["start"])))

        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(kept) - 1) / wide).cast("int")), lambda k: F.slice(kept, k * wide + 1, wide))
        return F.array_join(F.flatten(F.transform(chunks, cut)), mask)

    def stretches(of: Column) -> Column:
        reached = _running(F.transform(of, lambda s: s["end"]), F.lit(0), lambda at, end: F.greatest(at, end))
        starts = F.concat(F.transform(of, lambda s: s["start"]), F.array(F.length(text)))
        both = F.zip_with(reached, starts, lambda begin, end: F.struct(begin.alias("start"), end.alias("end")))
        # A span that begins before the end of those ahead of it opens no new stretch; the last stretch, to the text's end, always counts.
        return F.filter(both, lambda s: s["end"] >= s["start"])

    return _once(stretches(spans), pieces)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, mask: str = "[SECRET]", rules: Sequence[Rule] = BASE + ADDED) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping ones by one).

    All other columns, whatever their names, and texts without a span stay as
    they are, null and empty ones too; repeated rows are each masked; an empty
    table stays empty.
    """
    (spans,) = free_names(docs.columns, "_spans")
    found = scan(docs, text_col, key=row_key(id_col, text_col), rules=rules, spans=spans)
    text = F.col(text_col)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, _masked(text, F.col(spans), mask)).otherwise(text)).select(*docs.columns)


def oracle_sql(rules: Sequence[Rule] = BASE + ADDED) -> str:
    """The report in DuckDB SQL, by the patterns alone."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    one = []
    for i, r in enumerate(rules):
        one.append(
            f"SELECT row, text, {i} AS rule, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, {quoted(r.pattern)}) AS gaps, "
            f"regexp_extract_all(text, {quoted(r.pattern)}, 0) AS whole, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS held FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(one)}),
u AS (
  SELECT row, rule, kind, least, length(held[i]) AS held, length(whole[i]) AS long,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m WHERE len(whole) > 0)
),
s AS (
  SELECT row, rule, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + long AS BIGINT) AS span FROM u WHERE held >= least
),
g AS (
  SELECT row, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, rule) FILTER (rule < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans
  FROM s GROUP BY row
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.row = g.row
"""
