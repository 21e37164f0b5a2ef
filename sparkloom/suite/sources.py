"""Queries that go by way of files, models, the dialect and flows."""

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkloom.operators.tables import _checkpoint_dir
from sparkloom.plans import dialect, models
from sparkloom.plans.flow import Flow
from sparkloom.sources import files as S
from sparkloom.suite import query


def place(t, name: str) -> str:
    """A fresh path in the folder that the cluster shares."""
    _checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("io_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def _(t):
    path = place(t, "csv")
    S.output(t("nation").select("n_nationkey", "n_name", "n_regionkey"), path, "csv")
    return S.file(t.spark, path, ",", names=["k", "name", "region"])


@query("io_tsv_bad_lines", "SELECT 2 AS foundcols, 3 AS expectedcols, r_regionkey || chr(9) || r_name AS contents FROM region")
def _(t):
    path = place(t, "tsv")
    S.output(t("region").select("r_regionkey", "r_name"), path, "tsv")
    return S.file(t.spark, path, "\t", names=["a", "b", "c"], strict=-1)


@query("io_parts", "SELECT c_custkey, c_nationkey AS part FROM customer WHERE c_nationkey BETWEEN 3 AND 6")
def _(t):
    path = place(t, "parts")
    S.output(t("customer").select("c_custkey", F.col("c_nationkey").alias("part")), path, "parquet", split=["part"])
    return S.unionalldb(t.spark, path, 3, 7).select("c_custkey", "part")


@query("io_json_lines", "SELECT event_id, event_type FROM events")
def _(t):
    path = place(t, "json")
    S.output(t("events").select("event_id", "event_type"), path, "json")
    return t.spark.read.schema("event_id long, event_type string").json(path)


@query("io_xml", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def _(t):
    text = F.concat(F.lit("<row><name>"), F.col("n_name"), F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></row>"))
    return S.xmlparse(t("nation").select(text.alias("x")), "x", "name string, region string")


@query("io_webtable", "SELECT n_nationkey, n_name AS cell FROM nation")
def _(t):
    df = t("nation").withColumn("html", F.concat(F.lit("<p>x<table><tr><th>name</th></tr><tr><td>"), F.col("n_name"), F.lit("</td></tr></table>")))
    return df.select("n_nationkey", S.webtable(df, "html")[1][0].alias("cell"))


@query("dialect_pipeline", "SELECT row_number() OVER (ORDER BY n_name) AS rowid, n_name FROM nation WHERE n_regionkey = 1")
def _(t):
    t("nation").createOrReplaceTempView("nation")
    return dialect.run(t.spark, "rowidvt order:n_name SELECT n_name FROM nation WHERE n_regionkey = %{r}", {"r": "1"})


@query("dialect_nested", "SELECT r_regionkey AS rid, 'r_name' AS colname, r_name AS val FROM region")
def _(t):
    t("region").createOrReplaceTempView("region")
    return dialect.run(t.spark, "toeav r_regionkey setschema 'r_regionkey int, r_name string' SELECT * FROM region")


@query("flow_exec", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_regionkey = 2")
def _(t):
    t("nation").createOrReplaceTempView("nation")
    return Flow(t.spark, region="2").exec(["-- a comment", "ignorefail SELECT * FROM nowhere;", "var 'k' from SELECT %{r};", "SELECT count(*) AS n", "FROM nation WHERE n_regionkey = %{k};"], {"r": "region"})


@query("flow_variables", "SELECT 'a' AS variable, '1' AS value")
def _(t):
    return Flow(t.spark, a="1").table()


def vectors(t):
    """The whole embedding as one vector, with its label."""
    return t("embeddings").select("vec_id", F.col("label").cast("int").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("f"))


@query("ml_cluster")
def _(t):
    return models.skcluster(vectors(t), "vec_id", ["f"], "KMeans", k=4, seed=1)


@query("ml_reduce")
def _(t):
    return models.skdimred(vectors(t), "vec_id", ["f"], 2)


@query("ml_train_predict")
def _(t):
    v = vectors(t).withColumn("label", F.col("label") % 2)
    return models.sktrain(v, place(t, "model"), "LogisticRegression", "vec_id", "label", ["f"], 1)
