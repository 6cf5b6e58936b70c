"""Line dedup by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.core.names import free_names
from quarrystone.core.shared import written, written_bytes

BROADCAST_BYTES = 8_000_000
#: Share of a host's pages above which a line of several pages is boilerplate.
RATIO = 0.05


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", *, ratio: float = RATIO, classes: DataFrame | None = None) -> DataFrame:
    """(host, keys): hashes of the lines that more than ``ratio`` of a host's
    pages, and more than one of them, contain.

    A host has at most (mean distinct lines of its pages) / ratio such lines,
    so ``keys`` is bounded however many pages the host has.

    Equal texts of a host are one page of it, or its copies would make all
    their own lines boilerplate; with ``classes`` (mark, page; see
    ``copy_classes``) all texts of a class are, which holds the lines of each.
    Null hosts are a host of their own, and a null text is one empty line. An
    empty table gives no rows.
    """
    host, text = F.col(host_col), F.col(text_col)
    keys = F.array_distinct(F.transform(_lines(text), _key)).alias("keys")
    own = docs.select(host.alias("host"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), keys).dropDuplicates(["host", "mark"])
    if classes is None:
        pages = own.groupBy("host").agg(F.count("*").alias("pages"))
        seen = own.select("host", F.explode("keys").alias("key"))
    else:
        own = own.join(classes, "mark")
        pages = own.groupBy("host").agg(F.countDistinct("page").alias("pages"))
        seen = own.select("host", "page", F.explode("keys").alias("key")).distinct()
    counts = seen.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1")
    pages = pages.withColumnRenamed("host", "of")
    often = counts.join(pages, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("key").alias("keys"))


def _judged(docs: DataFrame, host_col: str, text_col: str, ratio: float, classes: DataFrame | None) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns more, and their names: the lines of the text, and those of them that stay."""
    host, keys, lines, met, kept = free_names(docs.columns, "_host", "_keys", "_lines", "_met", "_kept")
    common = written(boilerplate(docs, host_col, text_col, ratio=ratio, classes=classes), "boilerplate").select(F.col("host").alias(host), F.col("keys").alias(keys))
    if written_bytes(common) <= BROADCAST_BYTES:
        common = F.broadcast(common)
    joined = docs.join(common, docs[host_col].eqNullSafe(common[host]), "left").withColumn(lines, _lines(F.col(text_col)))
    # The document's own share of the host's keys first: one hash set a document, not a search of all keys a line.
    joined = joined.withColumn(met, F.array_intersect(F.transform(lines, _key), F.coalesce(F.col(keys), F.array().cast("array<bigint>"))))
    stays = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col(met), _key(line)))
    return joined.withColumn(kept, F.when(F.size(met) == 0, F.col(lines)).otherwise(stays)).drop(host, keys, met), lines, kept


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", *, ratio: float = RATIO, classes: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``text_col`` free of boilerplate lines.

    Lines are compared without spaces at either end; empty lines stay. Equal
    texts of a host are one page, and so are copies that ``classes`` names (see
    ``boilerplate``); all rows are cleaned. Null hosts are a host of their own. A null text counts as
    one empty line and stays null; all other columns, whatever their names,
    stay as they are. An empty table stays empty.
    """
    done, _, kept = _judged(docs, host_col, text_col, ratio, classes)
    return done.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n"))).select(*docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", *, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the kept text) of each document.

    As ``drop_boilerplate``: a null text has one line and the digest of an
    empty one, repeated rows give repeated results, other columns are not read
    and an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    done, lines, kept = _judged(source, "host", "text", ratio, None)
    return done.select(
        "doc_id", F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH own AS (
  SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), page AS (
  SELECT DISTINCT source, lines FROM own
), pages AS (
  SELECT source, count(*) AS pages FROM page GROUP BY source
), seen AS (
  SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) AS line FROM page
), often AS (
  SELECT s.source, s.line FROM (SELECT source, line, count(*) AS n FROM seen GROUP BY source, line) s
  JOIN pages p ON s.source IS NOT DISTINCT FROM p.source
  WHERE s.n > 1 AND s.n > {RATIO} * p.pages AND s.line <> ''
), common AS (
  SELECT source, list(line) AS common FROM often GROUP BY source
), kept AS (
  SELECT o.doc_id, o.lines, list_filter(o.lines, lambda x: NOT list_contains(coalesce(c.common, []), trim(x))) AS kept
  FROM own o LEFT JOIN common c ON o.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM kept
"""
