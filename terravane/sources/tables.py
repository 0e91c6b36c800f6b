"""Readers: parquet tables, GeoEAS text, soft-PDF text; and the bindings of the star schema to points, grids and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_geoeas(spark: SparkSession, path: str) -> DataFrame:
    """A title line, the number p of columns, p names, then rows of p numbers in white space; blank lines are skipped.

    The p + 2 header lines come to the driver; rows are parsed by the executors. Adds
    `row`, increasing in file order. Files with several parts are read part by part.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("row"), F.trim("value").alias("line")).where("line <> ''")
    head = lines.orderBy("row").limit(2).collect()
    if len(head) < 2:
        raise ValueError("no GeoEAS header")
    p = int(head[1]["line"].split()[0])
    top = lines.orderBy("row").limit(p + 2).collect()
    names = [r["line"].strip() for r in top[2:]]
    cells = F.split("line", r"\s+")
    rows = lines.where(F.col("row") > top[-1]["row"])
    return rows.select("row", *(F.element_at(cells, i + 1).cast("double").alias(n) for i, n in enumerate(names)))


def write_geoeas(df: DataFrame, path: str, title: str, order: str = "row") -> None:
    """The inverse of read_geoeas, as one sorted text part: for exchange of small tables."""
    names = [c for c in df.columns if c != order]
    head = [title, str(len(names)), *names]
    spark = df.sparkSession
    body = df.select(F.col(order).cast("long").alias("__o"), F.concat_ws(" ", *(F.col(c).cast("string") for c in names)).alias("value"))
    lines = spark.createDataFrame([(i - len(head) - (1 << 62), v) for i, v in enumerate(head)], "__o long, value string")
    lines.unionByName(body).repartitionByRange(1, "__o").sortWithinPartitions("__o").select("value").write.text(path)


def read_soft_pdf(spark: SparkSession, path: str, delimiter: str = ",", skip: int = 0) -> DataFrame:
    """Rows n, n + 1 limits, n + 1 densities -> struct soft(type 2, nl, limi, probdens)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), "value")
    if skip:
        last = lines.orderBy("id").limit(skip).agg(F.max("id")).first()[0]
        lines = lines.where(F.col("id") > last)
    cells = F.transform(F.split("value", delimiter), lambda v: F.trim(v).cast("double"))
    nl = (cells[0] + 1).cast("int")
    return lines.where("trim(value) <> ''").select("id", F.struct(F.lit(2).alias("type"), nl.alias("nl"), F.slice(cells, 2, nl).alias("limi"), F.slice(cells, nl + 2, nl).alias("probdens")).alias("soft"))


#: The bindings, as SQL that Spark and DuckDB both run over the star schema: coordinates are fixed modular hashes of keys.
BINDINGS = {
    "pts_s": "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 97 AS DOUBLE) AS y, CAST(s_acctbal AS DOUBLE) / 1000 AS z FROM supplier",
    "pts_c": "SELECT CAST(c_custkey AS BIGINT) AS id, CAST((c_custkey * 37) % 211 AS DOUBLE) AS x, CAST((c_custkey * 53) % 199 AS DOUBLE) AS y, CAST(c_acctbal AS DOUBLE) / 1000 AS z, c_mktsegment AS cls FROM customer",
    "targets": "SELECT CAST(p_partkey AS BIGINT) AS k, CAST((p_partkey * 41) % 101 AS DOUBLE) + 0.5 AS x, CAST((p_partkey * 59) % 97 AS DOUBLE) + 0.25 AS y FROM part",
    "grid": "SELECT site, CAST((site * 37) % 31 AS DOUBLE) AS x, CAST((site * 53) % 29 AS DOUBLE) AS y, t, z FROM (SELECT CAST(user_id AS BIGINT) AS site, CAST(dayofmonth(ts) AS DOUBLE) AS t, avg(CAST(value AS DOUBLE)) AS z FROM events GROUP BY 1, 2) g",
    "soft": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_retailprice AS DOUBLE) / 100 AS m, CAST(p_size AS DOUBLE) / 10 AS w, CAST((p_partkey * 41) % 101 AS DOUBLE) AS x, CAST((p_partkey * 59) % 97 AS DOUBLE) AS y FROM part",
    "field": "SELECT CAST(vec_id AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CAST(v AS DOUBLE) AS v FROM {explode}",
    "evals": "SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y_true, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS y_pred, 1.0 / (1.0 + exp(CAST(400 - d.n_chars AS DOUBLE) / 400)) AS p1 FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
}


def binding(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame; only the columns that it names are read."""
    used = {"pts_s": ["supplier"], "pts_c": ["customer"], "targets": ["part"], "grid": ["events"], "soft": ["part"], "field": ["embeddings"], "evals": ["labels", "documents"]}[name]
    text = BINDINGS[name].replace("{explode}", "(SELECT vec_id, posexplode(embedding) AS (c, v) FROM embeddings) e")
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def binding_sql(name: str) -> str:
    return BINDINGS[name].replace("{explode}", "(SELECT vec_id, unnest(range(len(embedding))) AS c, unnest(embedding) AS v FROM embeddings) e")
