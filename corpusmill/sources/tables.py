"""Keyed parquet tables in place of the document and vector stores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.index import latest

ANCHORS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("href", T.StringType())]))
BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("ordered", T.BooleanType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("html", T.StringType()), T.StructField("anchors", ANCHORS)]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    """S1."""
    return runs.where(F.col("run_id") == run_id)


def page_scan(pages: DataFrame, run_id: str) -> DataFrame:
    """S3. A run's pages in the order of their crawl."""
    return pages.where(F.col("run_id") == run_id).orderBy("crawled_at", "page_id")


def decode_documents(raw: DataFrame) -> DataFrame:
    """S6. Fields stored in two casings become one snake-case column each: the first that is not null."""
    names: dict[str, list[str]] = {}
    places = raw.toDF(*[f"_{n}" for n in range(len(raw.columns))])
    for n, c in enumerate(raw.columns):
        key = "".join("_" + x.lower() if x.isupper() and i and not c[i - 1].isupper() else x.lower() for i, x in enumerate(c))
        names.setdefault(key, []).append(f"_{n}")
    return places.select(*[F.coalesce(*map(F.col, cs)).alias(k) for k, cs in names.items()])


def block_files(spark: SparkSession, folder: str) -> DataFrame:
    """S25. Cached block files, one JSON array a file: run (its folder), file, blocks; null blocks where malformed."""
    raw = spark.read.text(f"{folder}/*/*.blocks.json", wholetext=True).select(F.input_file_name().alias("file"), "value")
    return raw.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("run_id"), "file", F.from_json("value", BLOCKS).alias("blocks"))


def check_points(df: DataFrame, dimensions: int) -> None:
    """S10. Raise unless the table has ids and vectors of one width."""
    need = {"point_id", "run_id", "embedding"}
    if not need <= set(df.columns):
        raise ValueError(f"columns missing: {sorted(need - set(df.columns))}")
    if not df.where(F.size("embedding") != dimensions).isEmpty():
        raise ValueError("a vector has another width")


def write_run(points: DataFrame, path: str) -> None:
    """S12, S13. Replace the partitions of the runs in `points`; other runs stay. Ids are deterministic, so a repeated write
    gives the same partition."""
    spark = points.sparkSession
    points.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    spark.catalog.refreshByPath(path)


def upsert(old: DataFrame | None, new: DataFrame, key: str, newest: str) -> DataFrame:
    """S12. Union of both with the newest row of every key."""
    return latest(new if old is None else old.unionByName(new), key, newest)


def delete_where_run(path: str, spark: SparkSession, run_id: str) -> bool:
    """S13. Remove a run's partition; a table that does not exist yet is no error. False when there was nothing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and bool(fs.delete(p, True))


def exists(spark: SparkSession, path: str) -> bool | None:
    """S18. Whether a table exists; null when its storage cannot be asked."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
    except Exception:
        return None


def crawl_types(points: DataFrame, host: str) -> DataFrame:
    """S17. Distinct crawl types of a host, sorted, at most 16."""
    return points.where(F.col("host") == host).select("crawl_type").distinct().orderBy("crawl_type").limit(16)


def any_point(points: DataFrame, host: str, crawl_type: str | None = None) -> DataFrame:
    """S16. One point of a host, the smallest id."""
    p = points.where(F.col("host") == host)
    return (p if crawl_type is None else p.where(F.col("crawl_type") == crawl_type)).orderBy("point_id").limit(1)


def cached_vectors(cache: DataFrame, texts: DataFrame, dimensions: int, key: str = "key") -> DataFrame:
    """S20. Vectors of the keys asked for; those of another width are misses."""
    return texts.select(key).distinct().join(cache.where(F.size("vector") == dimensions), key)


def new_vectors(cache: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """S21. Rows to append: keys the cache lacks, one each."""
    return rows.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def quarantine(rows: list[dict], folder: str, reason: str, preview: int = 500) -> str:
    """S23. Write a failing batch with shortened texts as JSON; the file's path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{int(time.time() * 1000)}.json")
    short = [{k: v[:preview] if isinstance(v, str) else v for k, v in r.items()} for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"reason": reason, "items": short}, f, ensure_ascii=False, default=str)
    return path
