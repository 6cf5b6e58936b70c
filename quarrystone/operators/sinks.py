"""Writers: tables, sequences, routed outputs, manifests and a commit pointer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.core.names import free_names
from quarrystone.core.shared import written
from quarrystone.functions.arrays import wrapped
from quarrystone.operators import contents


def write_tsv(df: DataFrame, path: str, columns: Sequence[str], missing: str = "", quoted: bool = True, line_end: str = "\n") -> None:
    """Just ``columns``, in this order, with a header; fails if the folder exists."""
    writer = df.select(*columns).write.option("sep", "\t").option("header", True).option("nullValue", missing).option("emptyValue", "").option("lineSep", line_end).option("escape", '"')
    if not quoted:
        writer = writer.option("quote", "")
    writer.mode("errorifexists").csv(path)


def python_format(x: Column, spec: str) -> Column:
    """Numbers as Python prints them, for text outputs that must match it to the letter."""

    @F.pandas_udf(T.StringType())
    def text(values):
        return values.map(lambda v: None if v is None or v != v else format(v, spec)).astype(object)

    return text(x.cast("double"))


def write_fasta(df: DataFrame, path: str, ident: str = "id", seq: str = "seq", width: int = 60) -> None:
    df.select(F.concat(F.lit(">"), F.col(ident), F.lit("\n"), wrapped(F.col(seq), width))).write.mode("errorifexists").text(path)


def observed_write(df: DataFrame, path: str, metrics: Mapping[str, Column], *by: str) -> dict[str, object]:
    """Writes ``df`` as Parquet, in folders ``by`` columns if there are any, and
    gives ``metrics``, aggregates of the rows taken while they are written: one
    job, and nothing is read again to be counted."""
    seen = Observation()
    writer = df.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return dict(seen.get)


def write_routed(df: DataFrame, path: str, route: str) -> dict[str, int]:
    """A folder per route in one pass, and the rows of each, as the files state them; they must add up to what was written."""
    total = observed_write(df, path, {"n": F.count("*")}, route)["n"]
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    counts = {r[route]: r["n"] for r in stored.groupBy(route).agg(F.count("*").alias("n")).collect()}  # a row per folder
    if sum(counts.values()) != total:
        raise ValueError(f"{sum(counts.values())} routed rows of {total}")
    return counts


def write_children(df: DataFrame, path: str, name: Column) -> None:
    """A table of tab-separated text for each value of ``name``, in the folder output=name, all in one pass over their parent."""
    rows = df.withColumn("output", name)
    rows.write.mode("errorifexists").partitionBy("output").option("sep", "\t").option("header", True).option("escape", '"').csv(path)


def manifest(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """(path, name, bytes), and the contents' ``digest`` (sha256 or md5) if asked, of all files but markers, by name."""
    if digest is None:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    else:
        rows = contents.digested(spark, path, digest).withColumnRenamed("digest", digest)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.select("path", name.alias("name"), F.col("length").alias("bytes"), *([digest] if digest else []))
    return rows.where(~F.col("name").startswith("_") & (F.col("name") != "COMPLETE")).orderBy("name")


def digests(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, sha256 or md5) of every file below a folder but markers."""
    rows = contents.digested(spark, path, kind).where(~F.element_at(F.split("path", "/"), -1).startswith("_"))
    return rows.select("path", F.col("digest").alias(kind))


def against(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, status, expected, found): PASS where both sides have the same digest; what one side lacks fails."""
    both = expected.join(found, key, "full")
    return both.select(key, F.when(F.col("expected") == F.col("found"), "PASS").otherwise("FAIL").alias("status"), "expected", "found")


def step_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(step, files, bytes) of each folder right below ``path``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    step = F.regexp_extract("path", rf"{path.rstrip('/')}/([^/]+)/", 1)
    return rows.groupBy(step.alias("step")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def blocked_content(spark: SparkSession, path: str, patterns: Mapping[str, str]) -> DataFrame:
    """(path, rule) of text files that match a forbidden pattern; an archive needs this empty."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.array_compact(F.array(*[F.when(F.rlike("value", F.lit(p)), F.lit(n)) for n, p in patterns.items()]))
    return rows.select("path", F.explode(found).alias("rule"))


def commit(df: DataFrame, folder: str, run: str) -> DataFrame:
    """Writes a run of its own, marks it complete, and then names it in the log
    of commits. A run is never overwritten and the log only grows, so readers
    see the old run or the new one, never none."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{folder}/run_{run}")
    done = spark.createDataFrame([(run,)], "run string").withColumn("at", F.current_timestamp()).coalesce(1)
    done.write.mode("errorifexists").json(f"{folder}/run_{run}/COMPLETE")
    done.write.mode("append").json(f"{folder}/commits")
    return spark.read.parquet(f"{folder}/run_{run}")


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The run that was committed last; one without its marker is an error."""
    run = spark.read.schema("run string, at timestamp").json(f"{folder}/commits").agg(F.max_by("run", "at")).first()[0]
    if spark.read.schema("run string").json(f"{folder}/run_{run}/COMPLETE").first()[0] != run:
        raise ValueError(f"run {run} is not complete")
    return spark.read.parquet(f"{folder}/run_{run}")


def sync(source: DataFrame, target: str, key: str) -> int:
    """Rows of ``source`` whose key the table at ``target`` lacks are appended; how many. Again, it appends none."""
    spark = source.sparkSession
    known = written(spark.read.parquet(target).select(key).distinct(), "known")
    fresh = written(source.join(known, key, "left_anti"), "fresh")
    fresh.write.mode("append").parquet(target)
    return fresh.count()


def checks(spark: SparkSession, named: Mapping[str, tuple[object, object]]) -> DataFrame:
    """(check, status, observed, expected) of numbers known on the driver, as ``observed_write`` gives them; PASS where both agree."""
    rows = [(n, "PASS" if a == b else "FAIL", str(a), str(b)) for n, (a, b) in named.items()]
    return spark.createDataFrame(rows, "check string, status string, observed string, expected string")


def measured(named: Mapping[str, tuple[DataFrame, object]]) -> DataFrame:
    """The same of tables of one row and one column beside what they must hold: all in one job, when the result is read."""
    out = None
    for name, (df, expected) in named.items():
        value = F.col(f"`{df.columns[0]}`")
        status = F.when(value.eqNullSafe(F.lit(expected)), "PASS").otherwise("FAIL")
        row = df.select(F.lit(name).alias("check"), status.alias("status"), value.cast("string").alias("observed"), F.lit(str(expected)).alias("expected"))
        out = row if out is None else out.unionByName(row)
    return out


def required(df: DataFrame, check: DataFrame, message: str) -> DataFrame:
    """``df``, which fails when it is read unless the one row of ``check`` (ok) holds true, be ``df`` empty or not."""
    (ok,) = free_names(df.columns, "_ok")
    one = check.select(F.when(F.col("ok"), True).otherwise(F.raise_error(F.lit(message))).alias(ok))
    held = df.crossJoin(F.broadcast(one)).where(F.col(ok)).drop(ok)  # one row
    nothing = one.where(~F.col(ok)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return held.unionByName(nothing)


def exactly(df: DataFrame, by: Sequence[str], each: int, groups: int) -> DataFrame:
    """``df``, which fails when it is read unless it has just ``groups`` groups of just ``each`` rows."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    check = sizes.agg(((F.count("*") == groups) & F.coalesce(F.bool_and(F.col("n") == each), F.lit(groups == 0))).alias("ok"))
    return required(df, check, f"not {groups} groups of {each} rows each by {', '.join(by)}")


def all_pass(df: DataFrame) -> DataFrame:
    failed = df.where("status <> 'PASS'").limit(10).collect()
    if failed:
        raise ValueError("failed: " + "; ".join(f"{r['check']}: {r['observed']} for {r['expected']}" for r in failed))
    return df
