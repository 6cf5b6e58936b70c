"""Codon alignments, eligibility and the tests' JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.arrays import codons
from quarrystone.functions.stats import group_places
from quarrystone.functions.tails import let

STOPS = ("TAA", "TAG", "TGA")  # fixed value: stop codons of the universal code


def kept_codons(df: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """(family, id, kept): aligned sequences without the codon columns that are
    valid (no gap, no N, no stop) in fewer than max(least, ceil(share n)) rows."""
    rows = df.select("family", "id", F.posexplode(codons(F.col("seq"))).alias("at", "codon"))
    valid = ~F.contains("codon", F.lit("-")) & ~F.contains("codon", F.lit("N")) & ~F.col("codon").isin(*STOPS) & (F.length("codon") == 3)
    n = df.groupBy("family").agg(F.countDistinct("id").alias("_n"))
    good = rows.groupBy("family", "at").agg(F.count_if(valid).alias("_v")).join(n, "family")
    good = good.where(F.col("_v") >= F.greatest(F.lit(least), F.ceil(share * F.col("_n")))).select("family", "at")
    parts = F.array_sort(F.collect_list(F.struct("at", "codon")))
    kept = rows.join(good, ["family", "at"]).groupBy("family", "id").agg(F.array_join(F.transform(parts, lambda p: p["codon"]), "").alias("kept"))
    return df.select("family", "id").join(kept, ["family", "id"], "left").withColumn("kept", F.coalesce("kept", F.lit("")))


def eligibility(sequences: Column, species: Column, sites: Column, mapped: Column) -> tuple[Column, Column]:
    """Whether a family can be tested, and why not."""
    from quarrystone.functions.text import reasons

    why = reasons((sequences < 5, "sequences_lt_5"), (species < 3, "species_lt_3"), (sites < 100, "codon_sites_lt_100"), (mapped < 0.70, "mapping_fraction_lt_0.70"))
    return why == "", why


#: Levels of nesting that are searched; deeper documents are an error.
DEPTH = 48


def find_number(document: Column, wanted: str, depth: int = DEPTH) -> Column:
    """The first finite number of a JSON text, depth first, whose key holds
    ``wanted``, case aside; null if it is no JSON or holds none.

    A level at a time: each object or list on it gives its members, with the
    way that leads to them as an array of places. Of the numbers found the
    least way is the first, and what lies beyond it is not opened. Objects are
    read both as texts, which keep their inner order, and as variants, which
    know a number from a text that looks like one. Of repeated keys the last
    counts.
    """
    inside = "array<struct<way:array<int>,text:string>>"
    zero = F.struct(
        F.array(F.struct(F.array().cast("array<int>").alias("way"), document.alias("text"))).cast(inside).alias("level"),
        F.lit(None).cast("array<int>").alias("way"), F.lit(None).cast("double").alias("value"),
    )

    def members(node: Column) -> Column:
        """(way, key, kind, text, value) of what an object or list holds."""

        def listed(keys: Column, texts: Column, values: Column) -> Column:
            def one(key: Column, i: Column) -> Column:
                value = F.get(values, i)
                kind = F.schema_of_variant(value)
                number = F.when(F.rlike(kind, F.lit("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")), F.try_variant_get(value, "$", "double"))
                finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
                return F.struct(F.array_append(node["way"], i).alias("way"), key.alias("key"), kind.alias("kind"), F.get(texts, i).alias("text"), finite.alias("value"))

            return F.transform(keys, one)

        def of_map(m: Column) -> Column:
            keys = F.map_keys(m["texts"])
            some = listed(keys, F.map_values(m["texts"]), F.map_values(m["values"]))
            last = F.filter(some, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
            return F.when(F.size(F.array_distinct(keys)) < F.size(keys), last).otherwise(some)

        def of_list(m: Column) -> Column:
            return listed(F.transform(m["texts"], lambda _: F.lit("")), m["texts"], m["values"])

        both = lambda a, b: F.struct(F.from_json(node["text"], a).alias("texts"), F.from_json(node["text"], b).alias("values"))
        is_object = F.startswith(F.ltrim(node["text"]), F.lit("{"))
        return F.when(is_object, let(both("map<string,string>", "map<string,variant>"), of_map)).otherwise(let(both("array<string>", "array<variant>"), of_list))

    def step(state: Column, _: Column) -> Column:
        found = F.flatten(F.transform(state["level"], lambda n: F.coalesce(members(n), F.array().cast("array<struct<way:array<int>,key:string,kind:string,text:string,value:double>>"))))

        def next_state(held: Column) -> Column:
            hits = F.filter(held, lambda m: m["value"].isNotNull() & F.contains(F.lower(m["key"]), F.lit(wanted.lower())))
            best = F.array_min(F.array_append(F.transform(hits, lambda m: F.struct(m["way"].alias("way"), m["value"].alias("value"))), F.when(state["way"].isNotNull(), F.struct(state["way"].alias("way"), state["value"].alias("value")))))

            def onward(b: Column) -> Column:
                more = F.filter(held, lambda m: F.rlike(m["kind"], F.lit("^(OBJECT|ARRAY)")) & (b.isNull() | (m["way"] < b["way"])))
                return F.struct(F.transform(more, lambda m: F.struct(m["way"].alias("way"), m["text"].alias("text"))).cast(inside).alias("level"), b["way"].alias("way"), b["value"].alias("value"))

            return let(best, onward)

        return F.when(F.size(state["level"]) == 0, state).otherwise(let(found, next_state))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), zero, step, lambda s: F.when(F.size(s["level"]) > 0, F.raise_error(F.lit(f"JSON of more than {depth} levels"))).otherwise(s["value"]))
    return F.when(document.isNotNull(), done)


def test_result(document: Column, name: str) -> Column:
    """A number of ``test results``."""
    return F.try_variant_get(F.try_parse_json(document), f'$["test results"]["{name}"]', "double")


def branch_table(df: DataFrame, document: str) -> DataFrame:
    """(…, branch, corrected_p, omega) of the first partition of ``branch attributes``: the first keys that hold corrected p-value and omega."""
    attributes = F.try_parse_json(document)
    keep = [c for c in df.columns if c != document]
    first = df.select(*keep, F.to_json(F.try_variant_get(attributes, '$["branch attributes"]["0"]', "variant")).alias("_json")).where("_json is not null")
    pairs = first.select(*keep, F.explode(F.from_json("_json", "map<string,string>")).alias("branch", "_values"))
    inner = pairs.select(*keep, "branch", F.posexplode(F.map_entries(F.from_json("_values", "map<string,string>"))).alias("_at", "_e"))
    number = F.col("_e.value").try_cast("double")
    pick = lambda text: F.min_by(F.when(F.contains(F.lower("_e.key"), F.lit(text)), number), F.when(F.contains(F.lower("_e.key"), F.lit(text)), F.col("_at")))
    return inner.groupBy(*keep, "branch").agg(pick("corrected p-value").alias("corrected_p"), pick("omega").alias("omega"))


def event_members(df: DataFrame, by: str) -> DataFrame:
    """Rows numbered within each family by ``rank``, which must not tie, for stable array indices."""
    return group_places(df, [by], "rank", out="array_index")
