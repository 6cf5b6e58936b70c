"""Text column helpers: missing tokens, term lists, labels and identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing value.
MISSING = ("", "-", "NA", "N/A", "None", "none", "null")
MISSING_NUMBER = ("", "NA", "NaN", "nan")


def present(x: Column) -> Column:
    """Trimmed text, '' for a missing token or null."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.when(t.isin(*MISSING), F.lit("")).otherwise(t)


def first_present(*columns: Column) -> Column:
    """The first of several that is not missing, else ''."""
    return F.coalesce(*[F.nullif(present(c), F.lit("")) for c in columns], F.lit(""))


def any_present(*columns: Column) -> Column:
    return first_present(*columns) != ""


def terms(x: Column, separator: str = ",") -> Column:
    """Distinct trimmed parts in order, missing tokens left out."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), separator), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: ~p.isin(*MISSING))))


def joined(x: Column, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(x), separator)


def label(x: Column, strip: str = "_.-", empty: str = "sequence") -> Column:
    """Letters, digits and _.- only; anything else becomes one underscore."""
    safe = F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(F.btrim(safe, F.lit(strip)), F.lit("")), F.lit(empty))


def without_version(x: Column) -> Column:
    """What stands before the last full stop."""
    return F.regexp_replace(x, r"\.[^.]*$", "")


def safe_text(raw: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def display_label(x: Column) -> Column:
    """Underscores as spaces, each word with a capital."""
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def iso_utc(ts: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs])), ";")


def composite_id(x: Column) -> tuple[Column, Column, Column, Column]:
    """Species, gene and family of species|gene|family, and whether it has that form."""
    parts = F.split(x, r"\|")
    good = (F.size(parts) == 3) & F.forall(parts, lambda p: p != "") & F.get(parts, F.lit(2)).startswith("OG")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), good


# Patterns of gene identifiers in order of preference: where to look, pattern, name of the rule, what stands before the key.
GENE_RULES: Sequence[tuple[str, str, str, str]] = (
    ("header", r"(?:^|\s)gene:([^\s]+)", "ensembl_gene", "ensembl_gene:"),
    ("id", r"_g(\d+)_i\d+(?:\.p\d+)?(?:\b|$)", "transdecoder_gene", "transdecoder_gene:g"),
    ("header", r"\b(LOC\d+)\b", "refseq_locus", "refseq_locus:"),
    ("header", r"\b(EGW\d+_\d+)\b", "egw_locus", "egw_locus:"),
    ("header", r"\b(ElyMa_\d+)\b", "elyma_locus", "elyma_locus:"),
    ("header", r"\b(PoB_\d+)\b", "pob_locus", "pob_locus:"),
)


def gene_key(header: Column, identifier: Column) -> tuple[Column, Column]:
    """The gene that a sequence belongs to and the rule that says so; its own id if none does."""
    key, rule = F.concat(F.lit("unique_id:"), identifier), F.lit("unique_id")
    for where, pattern, name, prefix in reversed(GENE_RULES):
        found = F.regexp_extract(header if where == "header" else identifier, pattern, 1)
        key = F.when(found != "", F.concat(F.lit(prefix), found)).otherwise(key)
        rule = F.when(found != "", F.lit(name)).otherwise(rule)
    return key, rule


def node_parts(x: Column) -> tuple[Column, Column, Column]:
    """Name, number and whether terminal of a node label such as A<12> or <7>."""
    name = F.regexp_extract(x, r"^(?:(.+))?<([0-9]+)>$", 1)
    return name, F.regexp_extract(x, r"^(?:(.+))?<([0-9]+)>$", 2).try_cast("int"), name != ""
