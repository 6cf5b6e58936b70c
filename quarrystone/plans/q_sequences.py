"""Queries of sequence checks: a document's text is a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import arrays as arr
from quarrystone.functions import stats as st
from quarrystone.functions.numbers import quotient, rounded
from quarrystone.functions.tails import fisher_exact
from quarrystone.operators import annotation as an
from quarrystone.operators import ranking as rk
from quarrystone.operators import selection as sel
from quarrystone.operators import validation as va
from quarrystone.plans.base import table
from quarrystone.plans.register import query


LETTERS = "etaoinsrhldcumfpgwybvkxjqz"  # frequent ones first


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("""WITH g AS (SELECT md5(text) AS digest, count(*) AS members, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) >= 2)
SELECT 'DUP' || lpad(CAST(row_number() OVER (ORDER BY digest) AS VARCHAR), 6, '0') AS duplicate_group, digest, members, first, CASE WHEN langs > 1 THEN 'cross_orthogroup' WHEN sources = 1 THEN 'within_species_family' ELSE 'cross_species_family' END AS context FROM g""")
def dup_groups_md5(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.md5("text").alias("digest"), F.col("lang").alias("family"), F.col("source").alias("species"), F.col("doc_id").alias("item"))
    return va.duplicate_groups(d).select("duplicate_group", "digest", "members", "first", "context")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch >= 'a' AND ch <= 'z' AND length(ch) = 1 GROUP BY 1, 2),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS p FROM n) SELECT doc_id, round(-sum(p * log2(p)), 6) AS bits FROM t GROUP BY 1""")
def entropy_bits(spark, sf_dir):
    bits = va.entropy(F.lower("text"), LETTERS)
    return _docs(spark, sf_dir).select("doc_id", F.round(bits, 6).alias("bits")).where("bits is not null")


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS ch FROM documents) WHERE ch IN ('!', '#', '$', '%', '&', '*', '|') GROUP BY 1")
def char_histogram(spark, sf_dir):
    odd = F.regexp_replace("text", "[^!#$%&*|]", "")
    return _docs(spark, sf_dir).select(F.explode(F.split(odd, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


@query("SELECT p_name AS id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return va.repeated(table(spark, sf_dir, "part"), "p_name").withColumnRenamed("p_name", "id")


@query("""WITH m AS (SELECT source, median(n_chars) AS med, count(*) AS size FROM documents GROUP BY 1), f AS (
SELECT doc_id, n_chars, round(n_chars / med, 6) AS length_ratio, size, list_filter([
CASE WHEN n_chars < 30 THEN 'very_short' END, CASE WHEN n_chars >= 30 AND n_chars < 100 THEN 'short' END,
CASE WHEN (length(text) - length(replace(text, '#', ''))) / length(text)::DOUBLE > 0.05 THEN 'ambiguous' END,
CASE WHEN size >= 5 AND n_chars / med < 0.5 THEN 'short_for_family' END, CASE WHEN size >= 5 AND n_chars / med > 2.0 THEN 'long_for_family' END], lambda x: x IS NOT NULL) AS flags
FROM documents JOIN m USING (source))
SELECT doc_id, length_ratio, array_to_string(flags, ';') AS flags,
CASE WHEN list_contains(flags, 'very_short') THEN 'exclude_recommended' WHEN list_contains(flags, 'ambiguous') THEN 'review_high' WHEN len(flags) > 0 THEN 'review' ELSE 'pass' END AS status FROM f""")
def qc_flags_severity(spark, sf_dir):
    d = va.with_length_ratio(_docs(spark, sf_dir), "source", "n_chars")
    n = F.col("n_chars")
    r = quotient(n, F.col("family_median"))
    hash_share = quotient(F.length("text") - F.length(F.replace("text", F.lit("#"), F.lit(""))), F.length("text"))
    big = F.col("family_size") >= 5
    flags = [
        ("very_short", n < 30, 3), ("short", (n >= 30) & (n < 100), 1), ("ambiguous", hash_share > 0.05, 2),
        ("short_for_family", big & (r < 0.5), 1), ("long_for_family", big & (r > 2.0), 1),
    ]
    return va.flagged(d, flags).select("doc_id", rounded(r, 6).alias("length_ratio"), F.array_join("flags", ";").alias("flags"), "status")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)password|secret|token') THEN 'secret' END, CASE WHEN regexp_matches(text, '(?i)licen[cs]e|copyright') THEN 'licence' END,
CASE WHEN regexp_matches(text, '[0-9]{3}\\.[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'address' END], lambda x: x IS NOT NULL), ';') AS risks FROM documents""")
def risk_regex(spark, sf_dir):
    return va.risks(_docs(spark, sf_dir), F.col("text"), {"secret": "(?i)password|secret|token", "licence": "(?i)licen[cs]e|copyright", "address": r"[0-9]{3}\.[0-9]+\.[0-9]+\.[0-9]+"}).select("doc_id", F.array_join("risks", ";").alias("risks"))


@query("""WITH i AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 60 * (1 + (floor(value)::BIGINT % 30)) AS e FROM events),
o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT user_id, island, max(e) - min(s) + 1 AS long FROM n GROUP BY 1, 2)
SELECT user_id, CAST(sum(long) AS BIGINT) AS covered FROM m GROUP BY 1""")
def interval_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = e.select("user_id", start.alias("s"), (start + 60 * (1 + F.floor("value") % 30)).alias("e"))
    return arr.interval_union(rows, ["user_id"], "s", "e", "covered")


@query("""SELECT l_orderkey, count(DISTINCT place) AS covered FROM (SELECT l_orderkey, unnest(range(greatest(1, l_linenumber * 10 - 15), least(60, l_linenumber * 10 - 15 + CAST(l_quantity AS BIGINT)) + 1)) AS place FROM lineitem) GROUP BY 1""")
def clipped_coverage(spark, sf_dir):
    """Places that hits cover on a sequence of 60, beyond whose ends some reach."""
    start = F.col("l_linenumber") * 10 - 15
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("s"), (start + F.col("l_quantity").cast("bigint")).alias("e"))
    return arr.interval_union(rows, ["l_orderkey"], "s", "e", "covered", F.lit(60))


@query("""SELECT lang, count(*) FILTER (quality = 1) AS pass, count(*) FILTER (quality = 0) AS review, count(*) FILTER (toxic = 1) AS high,
10 * count(*) FILTER (toxic = 1) + count(*) FILTER (quality = 0) AS priority FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def crosstab_status(spark, sf_dir):
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    c = d.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("pass"), F.count_if(F.col("quality") == 0).alias("review"), F.count_if(F.col("toxic") == 1).alias("high"))
    return c.withColumn("priority", 10 * F.col("high") + F.col("review"))


@query("""WITH r AS (SELECT source, md5(text) AS digest, doc_id, row_number() OVER (PARTITION BY source, md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT source, digest, doc_id FROM r WHERE rn = 1""")
def dedupe_within_group(spark, sf_dir):
    d = _docs(spark, sf_dir).select("source", F.md5("text").alias("digest"), "doc_id", "n_chars")
    return rk.best_per(d, ["source", "digest"], F.desc("n_chars"), F.col("doc_id")).select("source", "digest", "doc_id")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r1 FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM a WHERE r1 <= 3) SELECT lang, source, doc_id, place FROM b WHERE place <= 40""")
def cap_per_group(spark, sf_dir):
    return rk.capped(_docs(spark, sf_dir), ["lang", "source"], ["lang"], 3, 40, F.desc("n_chars"), F.col("doc_id")).select("lang", "source", "doc_id", "place")


@query("""WITH w AS (SELECT *, p_size <= 10 AS wanted FROM part), t AS (SELECT *, wanted AND row_number() OVER (PARTITION BY p_brand, wanted ORDER BY p_retailprice DESC, p_partkey) <= 6 AS taken FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY taken DESC, p_retailprice DESC, p_partkey) AS fill FROM t)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rank FROM f WHERE fill <= 30""")
def quota_select(spark, sf_dir):
    first, final = [F.desc("p_retailprice"), F.col("p_partkey")], [F.col("p_size"), F.col("p_partkey")]
    return rk.quota(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size") <= 10, 6, 30, first, final).select("p_brand", "p_partkey", "rank")


@query("""SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '__' || rn END AS label FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)""")
def label_dedupe(spark, sf_dir):
    return rk.unique_labels(table(spark, sf_dir, "part"), "p_name", "label", F.col("p_partkey")).select("p_partkey", "label")


@query("SELECT p_brand, p_partkey, 'L' || lpad(CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR), 4, '0') AS serial FROM part")
def seq_ids(spark, sf_dir):
    return rk.serial(table(spark, sf_dir, "part"), "L", 4, "serial", ["p_brand"], F.col("p_partkey")).select("p_brand", "p_partkey", "serial")


@query("""WITH u AS (SELECT doc_id AS id, text, 'documents' AS source FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark UNION ALL SELECT conv_id, text, 'conversations' FROM conversations)
SELECT id, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, count(DISTINCT text) - 1 AS conflicts FROM u GROUP BY 1""")
def union_distinct_sources(spark, sf_dir):
    sources = {
        "documents": _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"),
        "benchmark": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"),
        "conversations": table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text"),
    }
    return an.union_distinct(sources, "id", "text").select("id", F.array_join("sources", ";").alias("sources"), "conflicts")


@query("""SELECT lang, source, max(length(replace(text, '*', ''))) AS longest, arg_max(doc_id, length(replace(text, '*', ''))::BIGINT * 1000000000 + doc_id) AS doc_id FROM documents GROUP BY 1, 2""")
def longest_per_key(spark, sf_dir):
    """The longest text of each language and source, stops not counted; of equally long ones the larger id."""
    return sel.longest_per(_docs(spark, sf_dir), ["lang", "source"], "text", "doc_id")


@query("""SELECT doc_id, source, arg_max(doc_id, n_chars * 1000000000 + doc_id) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS winner_then FROM documents""")
def winner_log(spark, sf_dir):
    return rk.winners_log(_docs(spark, sf_dir), "source", "n_chars", "doc_id", F.col("doc_id")).select("doc_id", "source", "winner_then")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("""WITH t AS (SELECT user_id, CASE WHEN value = 0 THEN 'undetected' WHEN value < 0.1 THEN 'trace' WHEN value < 1 THEN 'low' WHEN value < 10 THEN 'moderate' ELSE 'high' END AS bin FROM events) SELECT bin, count(*) AS n, count(DISTINCT user_id) AS users FROM t GROUP BY 1""")
def expression_bins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("bin", va.expression_bin(F.col("value")))
    return e.groupBy("bin").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""WITH g AS (SELECT event_type, user_id, count(*) AS copies, count(*) FILTER (value >= 10) AS detected, sum(value) AS total, max(value) AS most, avg(value) AS mean FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS users, count(*) FILTER (detected > 0) AS detected_users, CAST(sum(copies) AS BIGINT) AS copies, CAST(sum(detected) AS BIGINT) AS detected, round(sum(total), 4) AS total, max(most) AS most, round(avg(mean), 4) AS mean FROM g GROUP BY 1""")
def two_level_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return va.rollup(e, ["event_type", "user_id"], ["event_type"], "value", 10.0).withColumnsRenamed({"groups": "users", "detected_groups": "detected_users"}).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4)})


@query("SELECT event_type, t AS threshold, count(*) FILTER (value >= t) AS detected FROM events CROSS JOIN (SELECT unnest([1.0::DOUBLE, 10.0::DOUBLE, 50.0::DOUBLE]) AS t) GROUP BY 1, 2")
def detection_counts(spark, sf_dir):
    return va.detection(table(spark, sf_dir, "events"), ["event_type"], "value", (1.0, 10.0, 50.0))


WILCOXON = """WITH r AS (SELECT quality, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM documents JOIN labels USING (doc_id)),
t AS (SELECT sum(n * n * n - n) AS ties FROM (SELECT n_chars, count(*)::DOUBLE AS n FROM r GROUP BY 1)),
s AS (SELECT sum(rk) FILTER (quality = 1) AS ra, count(*) FILTER (quality = 1)::DOUBLE AS a, count(*)::DOUBLE AS n FROM r),
result AS (SELECT ra - a * (a + 1) / 2 AS w, (ra - a * (a + 1) / 2 - a * (n - a) / 2 - 0.5 * sign(ra - a * (a + 1) / 2 - a * (n - a) / 2)) / sqrt(a * (n - a) / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM s, t)"""


@query(WILCOXON + " SELECT round(w, 6) AS w, round(z, 6) AS z FROM result")
def wilcoxon_statistic(spark, sf_dir):
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return st.rank_sum_test(d, "n_chars", F.col("quality") == 1).select(F.round("w", 6).alias("w"), F.round("z", 6).alias("z"))


# The tail of the normal curve by Simpson's rule over twelve deviations.
@query(WILCOXON + """, x AS (SELECT round(w, 6) AS w, abs(z) AS z FROM (SELECT * FROM result))
SELECT w, round(2 * (12.0 / 4000 / 3) * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z + i * 12.0 / 4000) * (z + i * 12.0 / 4000)) / sqrt(2 * pi()))), 6) AS p_value FROM x""")
def wilcoxon_p_value(spark, sf_dir):
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return st.rank_sum_test(d, "n_chars", F.col("quality") == 1).select(F.round("w", 6).alias("w"), F.round("p_value", 6).alias("p_value"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS x, rank() OVER (ORDER BY doc_id) AS y FROM documents)
SELECT n, round(rho, 6) AS rho, round(list_sum(list_transform(range(0, 20001), lambda i: CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(0.0, cos(a + (pi() / 2 - a) * i / 20000)), n - 3))) * (pi() / 2 - a)
 / (list_sum(list_transform(range(0, 20001), lambda i: CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(0.0, cos(pi() / 2 * i / 20000)), n - 3))) * (pi() / 2)), 6) AS p_value
FROM (SELECT n, rho, atan(abs(rho) / sqrt(1 - rho * rho)) AS a FROM (SELECT count(*)::DOUBLE AS n, corr(x, y) AS rho FROM r))""")
def spearman_statistic(spark, sf_dir):
    """The tail of Student's t, in SQL by Simpson's rule over the angle whose tangent it is."""
    return st.spearman_test(_docs(spark, sf_dir), "n_chars", "doc_id").select("n", F.round("rho", 6).alias("rho"), F.round("p_value", 6).alias("p_value"))


@query("""WITH c AS (SELECT lang, count(*) FILTER (toxic = 1 AND quality = 1)::BIGINT AS a, count(*) FILTER (toxic = 1 AND quality = 0)::BIGINT AS b, count(*) FILTER (toxic = 0 AND quality = 1)::BIGINT AS c, count(*) FILTER (toxic = 0 AND quality = 0)::BIGINT AS d
FROM documents JOIN labels USING (doc_id) GROUP BY 1),
p AS (SELECT *, list_transform(range(greatest(0, a + c - (c + d)), least(a + c, a + b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(d + i - a + 1)
 - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1))) AS ps, a - greatest(0, a - d) AS place FROM c),
-- The odds at which the mean of the tilted distribution is the first cell, halved over its logarithm.
o AS (SELECT lang, list_reduce(list_prepend([-6.0::DOUBLE, 6.0::DOUBLE], list_transform(range(55), lambda i: [0.0::DOUBLE, 0.0::DOUBLE])), lambda e, z: CASE WHEN
 list_sum(list_transform(range(0, len(ps)), lambda i: i * ps[i + 1] * exp((i - place) * (e[1] + e[2]) / 2))) / list_sum(list_transform(range(0, len(ps)), lambda i: ps[i + 1] * exp((i - place) * (e[1] + e[2]) / 2))) < place
 THEN [(e[1] + e[2]) / 2, e[2]] ELSE [e[1], (e[1] + e[2]) / 2] END) AS e FROM p)
SELECT lang, a, b, c, d, round(least(1.0, list_sum(list_filter(ps, lambda x: x <= ps[place + 1] * (1 + 1e-7)))), 6) AS p_value,
CASE WHEN place = 0 THEN 0.0 WHEN place = len(ps) - 1 THEN 'inf'::DOUBLE ELSE round(exp((e[1] + e[2]) / 2), 6) END AS odds_ratio FROM p JOIN o USING (lang)""")
def fisher(spark, sf_dir):
    x = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    cell = lambda t, q: F.count_if((F.col("toxic") == t) & (F.col("quality") == q))
    c = x.groupBy("lang").agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    return c.withColumn("t", fisher_exact("a", "b", "c", "d")).select("lang", "a", "b", "c", "d", F.round("t.p_value", 6).alias("p_value"), F.round("t.odds_ratio", 6).alias("odds_ratio"))


