"""Versions that switch at once, and tables of which only what changed is rebuilt.

Both write first and switch last: data go into a folder of their own, are read back and compared, and only then a small
pointer file is replaced by a rename, which readers see whole or not at all. A write that fails leaves what was there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import durable


def _folder(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _folder(spark, path)
    return system.exists(at)


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Have the file at path say text from one moment to the next: written beside it, then renamed over it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, system = _folder(spark, path)
    system.mkdirs(at.getParent())
    staged, _ = _folder(spark, f"{path}.{uuid.uuid4().hex}")
    out = system.create(staged, True)
    out.write(text.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    qualified = system.makeQualified(at)
    context = hadoop.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(staged), qualified, options)


def read_pointer(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()[0] if _exists(spark, path) else None


def _digest(rows: DataFrame) -> tuple[int, str | None]:
    """How many rows there are, and a digest that does not depend on their order."""
    found = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")).cast("string").alias("d")).first()
    return found["n"], found["d"]


def _landed(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """rows as they lie at path, written once and compared with what was to be written; nothing is left there if they differ."""
    spark = rows.sparkSession
    try:
        rows.write.partitionBy(*by).parquet(path) if by else rows.write.parquet(path)
        kept = spark.read.schema(rows.schema).parquet(path)
        if _digest(kept.select(rows.columns)) != _digest(rows):
            raise OSError(f"{path} does not hold what was written")
        return kept
    except BaseException:
        at, system = _folder(spark, path)
        system.delete(at, True)
        raise


def version_key(version: str) -> tuple:
    """What versions are ordered by: numbers as numbers, so that 0.10 follows 0.9; a release after what leads up to it."""
    number, _, suffix = version.partition("-")
    return tuple(int(n) for n in re.findall(r"\d+", number)), suffix == "", suffix


def publish(documents: DataFrame, root: str, version: str) -> None:
    """Publish documents (name, body) as a version of the registry under root, and make it the current one.

    A version that is there already is replaced. Documents and a manifest (name, bytes, sha256) are written to a folder of
    their own; then the version's pointer, then the registry's are switched. Names are the documents' only ones: a name
    that comes twice, or none, is an error.
    """
    if not re.fullmatch(r"[\w.+-]+", version):
        raise ValueError(f"{version!r} is no version")
    spark, run = documents.sparkSession, uuid.uuid4().hex
    rows = documents.select("name", "body")
    again = rows.groupBy("name").count().where("count > 1 or name is null").first()
    if again:
        raise ValueError(f"{again['name']}: no name, or not the only one")
    kept = _landed(rows, f"{root}/versions/{version}/{run}/documents")
    manifest = kept.select("name", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))
    _landed(manifest, f"{root}/versions/{version}/{run}/manifest")
    write_pointer(spark, f"{root}/versions/{version}/CURRENT", run)
    write_pointer(spark, f"{root}/LATEST", version)


def published(spark: SparkSession, root: str, version: str | None = None, what: str = "documents") -> DataFrame:
    """The documents, or the manifest, of a version; of the current one if none is named."""
    version = version or read_pointer(spark, f"{root}/LATEST")
    run = version and read_pointer(spark, f"{root}/versions/{version}/CURRENT")
    if not run:
        raise FileNotFoundError(f"no version {version or ''} under {root}")
    return spark.read.parquet(f"{root}/versions/{version}/{run}/{what}")


def version_list(spark: SparkSession, root: str) -> DataFrame:
    """version, place, status (current, superseded), documents, bytes of every version under root, in the versions' order."""
    at, system = _folder(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    names = sorted((n for n in names if _exists(spark, f"{root}/versions/{n}/CURRENT")), key=version_key)
    latest = read_pointer(spark, f"{root}/LATEST")
    schema = "version string, place int, status string"
    rows = spark.createDataFrame([(n, k + 1, "current" if n == latest else "superseded") for k, n in enumerate(names)], schema)
    if not names:
        return rows.selectExpr("*", "0L as documents", "0L as bytes")
    sizes = (published(spark, root, n, "manifest").agg(F.count("*").alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select(F.lit(n).alias("version"), "*") for n in names)
    return rows.join(F.broadcast(reduce(DataFrame.unionByName, sizes)), "version").select("version", "place", "status", "documents", "bytes")


_STATE = "part string, hash string, built string"


def _state(spark: SparkSession, root: str) -> DataFrame:
    run = read_pointer(spark, f"{root}/STATE")
    return spark.read.schema(_STATE).parquet(f"{root}/state/{run}") if run else spark.createDataFrame([], _STATE)


def rebuild_plan(state: DataFrame, sources: DataFrame) -> DataFrame:
    """part, hash, built, reason: why a part of sources (part, hash) is to be rebuilt; null where it is current.

    Reasons: missing, "hash changed (old -> new)", "records no hash", and removed for a part that no source has.
    """
    now, old = sources.select("part", F.col("hash").alias("new")), state.withColumnRenamed("hash", "old").withColumn("known", F.lit(True))
    rows = now.withColumn("here", F.lit(True)).join(old, "part", "full")
    reason = (
        F.when(F.col("here").isNull(), "removed")
        .when(F.col("known").isNull(), "missing")
        .when(F.col("old").isNull(), "records no hash")
        .when(F.col("old") != F.col("new"), F.format_string("hash changed (%s -> %s)", "old", "new"))
    )
    return rows.select("part", F.col("new").alias("hash"), "built", reason.alias("reason"))


def refresh(spark: SparkSession, root: str, sources: DataFrame, build: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Bring the table under root up to date with sources (part, hash), and tell why: rebuild_plan's rows.

    build makes the rows of the parts that it is given (part, hash): a column `part` and others. Only parts that are
    missing or whose hash differs are built; with `force` all are. Parts of a null name, and parts that come twice, are
    errors. Nothing is written where all is current. A new snapshot lies beside the old one until the pointer is switched;
    rows of parts that did not change stay where they were built.
    """
    wrong = sources.groupBy("part").count().where("count > 1 or part is null").first()
    if wrong:
        raise ValueError(f"{wrong['part']}: no part, or not the only one")
    plan = rebuild_plan(_state(spark, root), sources)
    if force:
        plan = plan.withColumn("reason", F.coalesce("reason", F.lit("forced")))
    plan = durable(plan, "plan")  # it tells of the state before the switch
    if plan.where("reason is not null").isEmpty():
        return plan
    run = uuid.uuid4().hex
    todo = plan.where("reason is not null and reason <> 'removed'")
    if not todo.isEmpty():
        _landed(build(todo.select("part", "hash")), f"{root}/data/{run}")
    kept = plan.where("reason is null").select("part", "hash", "built").unionByName(todo.select("part", "hash", F.lit(run).alias("built")))
    _landed(kept, f"{root}/state/{run}")
    write_pointer(spark, f"{root}/STATE", run)
    return plan


def current_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all parts as they were last built."""
    state = _state(spark, root)
    runs = sorted(r["built"] for r in state.select("built").distinct().collect())  # one for each refresh that built something
    if not runs:
        raise FileNotFoundError(f"nothing built under {root}")
    of = lambda run: spark.read.parquet(f"{root}/data/{run}").join(state.where(F.col("built") == run).select("part"), "part", "left_semi")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(of, runs))
