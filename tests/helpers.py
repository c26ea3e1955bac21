"""Small literal tables and comparable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise import schemas


def make(spark: SparkSession, name: str, rows: list[dict], **defaults) -> DataFrame:
    """Rows of one ERP table; columns left out are NULL. Dates may be text."""
    schema = schemas.TABLES[name]
    texts = ", ".join(f"{f.name} string" for f in schema.fields)
    data = [
        tuple(None if (v := {**defaults, **row}.get(f.name)) is None else str(v) for f in schema.fields) for row in rows
    ]
    df = spark.createDataFrame(data, texts)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def sales(spark, *rows, **defaults):
    """(customer, date, group, price) invoice lines."""
    base = [
        {"customer_id": c, "customer_name": f"N{c}", "invoice_date": d, "product_group_id": g,
         "product_group_desc": g and f"G {g}", "extended_price": p, "invoice_no": f"{c}-{d}", "other_charge_item": "N"}
        for c, d, g, p in rows
    ]
    return make(spark, "invoice_sales", base, **defaults)


def customers(spark, *rows):
    """(id, class, rep) customers."""
    return make(
        spark, "customers",
        [{"customer_id": i, "customer_name": f"N{i}", "customer_class": k, "salesrep_id": r} for i, k, r in rows],
    )


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def only(df: DataFrame):
    found = df.collect()
    assert len(found) == 1, found
    return found[0]


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "customer_id string")
