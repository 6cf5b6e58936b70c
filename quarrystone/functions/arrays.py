"""Sets as arrays, intervals and sequence helpers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.stats import running_max
from quarrystone.functions.tails import let


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Shared share of two arrays as sets; ``empty`` if both have nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def interval_union(df: DataFrame, by: Sequence[str], start: str, end: str, out: str, length: Column | None = None) -> DataFrame:
    """Places covered by the intervals of each group, ends included, cut to
    1..length; overlapping and adjacent ones merge.

    A sweep in ranges of (group, start): each range counts what lies beyond the
    largest end so far, and takes from the ranges before it only the largest of
    their ends, a row per group and range. An interval that starts earlier
    covers all up to its end, so nothing counts twice.
    """
    low, high = F.col(start), F.col(end)
    if length is not None:
        low, high = F.greatest(low, F.lit(1)), F.least(high, length)
    rows = df.select(*by, low.cast("bigint").alias("_s"), high.cast("bigint").alias("_e")).where("_e >= _s")
    swept = running_max(rows, by, F.col("_e"), "_s", "_e", out="_reach", before=True)
    return swept.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s") - 1, F.coalesce("_reach", F.col("_s") - 1)))).cast("bigint").alias(out))


def letter_counts(text: Column, letters: str) -> Column:
    """How often ``text`` holds each of ``letters``, by what is left without it:
    no row and no array per character. Each letter goes from the text in turn,
    so the rest is shorter the sooner frequent ones come. ASCII letters are a
    byte each, so they are counted by the bytes left, which need no pass."""
    size = F.octet_length if letters.isascii() else F.length
    zero = F.struct(text.alias("rest"), size(text).alias("left"), F.array().cast("array<int>").alias("counts"))

    def step(state: Column, x: Column) -> Column:
        shorter = lambda rest: let(size(rest), lambda n: F.struct(rest.alias("rest"), n.alias("left"), F.array_append(state["counts"], state["left"] - n).alias("counts")))
        return let(F.replace(state["rest"], x, F.lit("")), shorter)

    return F.aggregate(F.array(*map(F.lit, letters)), zero, step)["counts"]


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd"))


def clean_cds(seq: Column) -> Column:
    """Upper case, U as T, anything else than ACGTN as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGTN]", "N")


BASES = "TCAG"
# Fixed value: amino acids of the universal code, codons in the order of BASES.
UNIVERSAL = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE = {"".join(c): a for c, a in zip(product(BASES, repeat=3), UNIVERSAL)}


def _amino(codon: str) -> str:
    """The amino acid of a codon; with N, the one that all its codons share, else X."""
    found = {CODE["".join(c)] for c in product(*[BASES if b == "N" else b for b in codon])}
    return found.pop() if len(found) == 1 else "X"


def codons(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.transform(F.sequence(F.lit(1), F.length(seq), F.lit(3)), lambda i: F.substring(seq, i, 3))).otherwise(F.array().cast("array<string>"))


def translated(seq: Column) -> Column:
    """Protein by the universal code without stops at its end; null if the length is no multiple of 3."""
    table = F.create_map(*[F.lit(v) for c in product(BASES + "N", repeat=3) for v in ("".join(c), _amino("".join(c)))])
    protein = F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")
    return F.when(F.length(seq) % 3 == 0, F.regexp_replace(protein, r"\*+$", ""))


def compatible(protein: Column, other: Column) -> Column:
    """Equally long, no inner stop, letters equal but for X; the first may differ if one of them is M."""
    a, b = F.split(protein, ""), F.split(other, "")
    same = F.zip_with(a, b, lambda x, y: (x == y) | (x == "X") | (y == "X"))
    first = F.get(same, F.lit(0)) | (F.get(a, F.lit(0)) == "M") | (F.get(b, F.lit(0)) == "M")
    rest = F.forall(F.slice(same, 2, F.greatest(F.size(same) - 1, F.lit(1))), lambda s: s)
    return F.coalesce((F.length(protein) == F.length(other)) & ~F.contains(protein, F.lit("*")) & first & rest, F.lit(False))


def back_translated(aligned: Column, cds: Column) -> Column:
    """Codons in place of an aligned protein's letters, --- for gaps; null unless all codons are used."""
    letters, gap = F.split(aligned, ""), F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        is_gap = x == "-"
        codon = F.substring(cds, acc["used"] * 3 + 1, F.lit(3))
        return F.struct(F.when(is_gap, acc["used"]).otherwise(acc["used"] + 1).alias("used"), F.array_append(acc["out"], F.when(is_gap, F.lit("---")).otherwise(codon)).alias("out"))

    done = F.aggregate(letters, gap, step)
    return F.when(done["used"] * 3 == F.length(cds), F.array_join(done["out"], ""))


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def gap_share(aligned: Column, gap: str = "---") -> Column:
    """Share of codon columns that are gaps."""
    all_codons = codons(aligned)
    return F.size(F.filter(all_codons, lambda c: c == gap)) / F.greatest(F.size(all_codons), F.lit(1))
