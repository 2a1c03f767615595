"""A deterministic email table derived from a document table.

Used by the registered queries, tests and benchmark.  The statement is valid in Spark SQL and in
other ANSI dialects alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMAILS_SQL = """
SELECT d.doc_id AS email_id, d.source AS source,
 CASE d.doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN concat('user', d.doc_id, '@gmail.com')
  WHEN 2 THEN 'support@paypa1.com' WHEN 3 THEN 'help@mail.paypal.com' WHEN 4 THEN 'hr@company.co.uk'
  WHEN 5 THEN 'a.b@xn--pypal-4ve.com' WHEN 6 THEN 'news@lists.example.com'
  ELSE 'no-reply@accounts.google.com' END AS from_address,
 CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE substring(d.text, 1, 40) END AS subject,
 concat(d.text, CASE d.doc_id % 13
  WHEN 0 THEN '' WHEN 1 THEN ' URGENT: verify your account at http://192.168.1.1/login'
  WHEN 2 THEN ' Click https://secure-bank.com/login?id=7 to reset your password!'
  WHEN 3 THEN ' Pay $50 in bitcoin: http://evil.zip/pay and http://evil.zip/pay2 or http://x.tk/a'
  WHEN 4 THEN ' see bit.ly/abc or https://t.co/xyz'
  WHEN 5 THEN ' please find attached the invoice <b>now</b>'
  WHEN 6 THEN ' http://xn--pypal-4ve.com/a' WHEN 7 THEN ' visit www.example.org and docs.example.net today?'
  WHEN 8 THEN ' https://www.paypal.com/home your wallet' WHEN 9 THEN ' http://paypa1.com:8080/x'
  WHEN 10 THEN ' https://shop.company.co.uk/a' WHEN 11 THEN ' https://accounts.google.com/verify account alert'
  ELSE ' open paypal today' END) AS body,
 {label} AS label,
 CASE d.doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '0.0' WHEN 2 THEN 'maybe' ELSE NULL END AS has_url_raw,
 CASE d.doc_id % 9 WHEN 0 THEN '.html' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE NULL END AS attachment_ext,
 (d.doc_id % 3 = 0) AS dkim_pass,
 CASE d.doc_id % 6 WHEN 0 THEN 'paypal.com' WHEN 3 THEN 'google.com' ELSE NULL END AS dkim_domain,
 CAST((d.doc_id * 37) % 1000 AS DOUBLE) / 1000.0 AS supervised_proba,
 CAST((d.doc_id * 91) % 997 AS DOUBLE) / 997.0 AS transformer_proba
FROM {tables}
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emails(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """The derived email table; extensions as an array.

    Without the label the label table is not read: the join cannot be left out by Spark.
    """
    labels = read_table(spark, sf_dir, "labels") if labelled else None
    return emails_from(read_table(spark, sf_dir, "documents"), labels)


def emails_from(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    spark = documents.sparkSession
    if labels is None:
        query = EMAILS_SQL.replace("{label}", "CAST(NULL AS INT)").replace("{tables}", "{documents} d")
        view = spark.sql(query, documents=documents)
    else:
        query = EMAILS_SQL.replace("{label}", "l.toxic").replace(
            "{tables}", "{documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"
        )
        view = spark.sql(query, documents=documents, labels=labels)
    ext = F.col("attachment_ext")
    return view.withColumn(
        "attachment_extensions",
        F.when(ext.isNotNull(), F.array(ext)).otherwise(F.array().cast("array<string>")),
    )


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read as a stream of files, be it one file or a folder of part files."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    # A file source wants a folder or a pattern.  A pattern that names the path alone takes the
    # file itself, or the folder with what is in it.
    return stream.parquet(f"{sf_dir}/{_literal(name)}[.]parquet")


def _literal(name: str) -> str:
    """The name as a file pattern that matches nothing else."""
    return "".join(f"[{c}]" if c in "*?{}[]\\" else c for c in name)
