"""Small observation tables for tests."""

from collections import Counter

from pyspark.sql import functions as F

DDL = "batch string, site string, class_age string, campaign int, date string, id_ind string, code_param string, value double"


def table(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("date", F.col("date").cast("date"))


def obs(batch, site, date, bag, param, value):
    return batch, site, batch[5:7], int(batch[:4]), date, bag, param, float(value)


def plain(df):
    return Counter((r.batch, r.site, str(r.date), r.id_ind, r.code_param, r.value) for r in df.collect())
