"""Queries of occupancy: a part is a family, a region a species, a first line a copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import occupancy as occ
from quarrystone.plans.base import COPIES, REGIONS, copies, supplied, table
from quarrystone.plans.register import query

NAMES = ("west", "east")

STATS = f"""{COPIES},
dense AS (SELECT f.family, r.r_name AS species, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT family FROM copies) f CROSS JOIN region r
          LEFT JOIN copies c ON c.family = f.family AND c.species = r.r_name),
stats AS (
  SELECT family, CASE WHEN min(n) = 1 AND max(n) = 1 THEN 'universal_single_copy' WHEN min(n) > 0 THEN 'universal_multicopy'
                      WHEN count(*) FILTER (n > 0) >= 4 THEN 'near_core' WHEN count(*) FILTER (n > 0) = 1 THEN 'species_specific' ELSE 'shell' END AS category,
         count(*) FILTER (n > 0) AS present, count(*) FILTER (n > 0) / 5.0::DOUBLE AS occupancy, CAST(sum(n) AS BIGINT) AS total, sum(n) / 5.0::DOUBLE AS mean_all,
         CAST(median(n) AS DOUBLE) AS median_all, max(n) AS most, CAST(sum(n) AS DOUBLE) / count(*) FILTER (n > 0) AS mean_present
  FROM dense GROUP BY family
)"""


@query(f"WITH {STATS} SELECT family, category FROM stats")
def occ_classify(spark, sf_dir):
    return occ.row_stats(copies(spark, sf_dir), REGIONS).select("family", "category")


@query(f"""WITH {STATS},
dim AS (SELECT unnest(['universal_single_copy', 'universal_multicopy', 'near_core', 'shell', 'species_specific']) AS category),
got AS (SELECT category, count(*) AS families, CAST(sum(total) AS BIGINT) AS copies FROM stats GROUP BY 1)
SELECT category, coalesce(families, 0) AS families, round(100.0 * coalesce(families, 0) / (SELECT sum(families) FROM got), 6) AS percent_families,
       coalesce(copies, 0) AS copies, round(100.0 * coalesce(copies, 0) / (SELECT sum(copies) FROM got), 6) AS percent_copies
FROM dim LEFT JOIN got USING (category)""")
def occ_category_summary(spark, sf_dir):
    return occ.category_summary(occ.row_stats(copies(spark, sf_dir), REGIONS))


@query(f"""WITH {STATS} SELECT family, present, round(occupancy, 6) AS occupancy, total, round(mean_all, 6) AS mean_all, median_all, most,
round(mean_present, 6) AS mean_present, most > 1 AS duplicated, most >= 100 AS high_copy FROM stats""")
def occ_row_stats(spark, sf_dir):
    s = occ.row_stats(copies(spark, sf_dir), REGIONS)
    return s.select("family", "present", F.round("occupancy", 6).alias("occupancy"), "total", F.round("mean_all", 6).alias("mean_all"), "median_all", "most", F.round("mean_present", 6).alias("mean_present"), "duplicated", "high_copy")


@query(f"""WITH {STATS} SELECT s.family, s.most, string_agg(c.species, ';' ORDER BY c.species) AS most_species
FROM stats s JOIN copies c ON c.family = s.family AND c.n = s.most GROUP BY 1, 2""")
def occ_argmax_species(spark, sf_dir):
    return occ.row_stats(copies(spark, sf_dir), REGIONS).select("family", "most", "most_species")


PRESENCE = f"""{COPIES},
presence AS (
  SELECT family, CAST(coalesce(sum(n) FILTER (species IN ('AFRICA', 'AMERICA')), 0) AS BIGINT) AS west_copies, count(*) FILTER (species IN ('AFRICA', 'AMERICA')) AS west_species,
         CAST(coalesce(sum(n) FILTER (species NOT IN ('AFRICA', 'AMERICA')), 0) AS BIGINT) AS east_copies, count(*) FILTER (species NOT IN ('AFRICA', 'AMERICA')) AS east_species, max(n) AS most
  FROM copies GROUP BY 1
), named AS (
  SELECT *, CASE WHEN west_species > 0 AND east_species > 0 THEN 'shared_between_classes' WHEN west_species > 0 THEN 'west_only' ELSE 'east_only' END AS presence FROM presence
)"""


def _presence(spark, sf_dir):
    return occ.class_presence(copies(spark, sf_dir), F.col("species").isin("AFRICA", "AMERICA"), NAMES)


@query(f"WITH {PRESENCE} SELECT * FROM named")
def class_presence(spark, sf_dir):
    return _presence(spark, sf_dir)


@query(f"""WITH {PRESENCE} SELECT presence, count(*) AS families, CAST(sum(west_copies + east_copies) AS BIGINT) AS copies, count(*) FILTER (most > 1) AS duplicated_families
FROM named GROUP BY 1""")
def class_summary(spark, sf_dir):
    return occ.class_summary(_presence(spark, sf_dir), NAMES)


@query(f"""WITH {PRESENCE} SELECT CASE WHEN west_copies = 0 OR east_copies = 0 THEN 'root_absent' WHEN most > 2 THEN 'large' ELSE 'primary' END AS route,
count(*) AS families, CAST(sum(west_copies + east_copies) AS BIGINT) AS copies FROM named GROUP BY 1""")
def family_route(spark, sf_dir):
    return occ.route(_presence(spark, sf_dir), NAMES, largest=2).groupBy("route").agg(F.count("*").alias("families"), F.sum(F.col("west_copies") + F.col("east_copies")).alias("copies"))


WIDE = "SELECT family, " + ", ".join(f"""CAST(coalesce(sum(n) FILTER (species = '{r}'), 0) AS BIGINT) AS "{r}" """ for r in REGIONS) + ", CAST(sum(n) AS BIGINT) AS total FROM copies GROUP BY family"


@query(f"WITH {COPIES} {WIDE}")
def matrix_pivot(spark, sf_dir):
    return occ.to_wide(copies(spark, sf_dir), REGIONS)


@query(f"""WITH {COPIES}, wide AS ({WIDE}) SELECT family, r_name AS species, CASE r_name {" ".join(f"WHEN '{r}' THEN {chr(34)}{r}{chr(34)}" for r in REGIONS)} END AS n FROM wide CROSS JOIN region""")
def matrix_unpivot(spark, sf_dir):
    return occ.to_long(occ.to_wide(copies(spark, sf_dir), REGIONS), REGIONS)


@query(f"WITH {COPIES}, wide AS ({WIDE}) SELECT count(*) AS mismatches FROM wide WHERE total <> {' + '.join(f'{chr(34)}{r}{chr(34)}' for r in REGIONS)}")
def check_totals(spark, sf_dir):
    wide = occ.to_wide(copies(spark, sf_dir), REGIONS)
    return occ.total_mismatch(wide, REGIONS).agg(F.count("*").alias("mismatches"))


@query("""SELECT r_name AS species, count(*) FILTER (l_linenumber = 1) AS assigned, count(*) FILTER (l_linenumber <> 1) AS unassigned, count(*) AS total,
round(100.0 * count(*) FILTER (l_linenumber = 1) / count(*), 6) AS rate_percent
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def assign_rate(spark, sf_dir):
    lines = supplied(spark, sf_dir)
    return occ.assignment(lines.where("l_linenumber = 1").groupBy("species").agg(F.count("*").alias("n")), lines.groupBy("species").agg(F.count("*").alias("n")))


@query(f"WITH {COPIES} SELECT species, CAST(sum(n) AS BIGINT) AS copies, count(*) AS families FROM copies GROUP BY 1")
def species_totals(spark, sf_dir):
    return copies(spark, sf_dir).groupBy("species").agg(F.sum("n").alias("copies"), F.count("*").alias("families"))


@query("""SELECT coalesce(p_brand, 'none') AS brand, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def left_group_join(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return p.join(li, p.p_partkey == li.l_partkey, "left").groupBy(F.coalesce("p_brand", F.lit("none")).alias("brand")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))
