"""The eight commerce source tables: schemas and one loader for every file format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Table and column names of the commerce sources. The two misspelled
# product columns are spelled as in the source.
SCHEMAS = {
    "raw_customers": (
        "customer_id string, customer_unique_id string, customer_zip_code_prefix string, "
        "customer_city string, customer_state string"),
    "raw_orders": (
        "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
        "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"),
    "raw_order_items": (
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "shipping_limit_date timestamp_ntz, price decimal(12,2), freight_value decimal(12,2)"),
    "raw_order_payments": (
        "order_id string, payment_sequential int, payment_type string, payment_installments int, "
        "payment_value decimal(12,2)"),
    "raw_order_reviews": (
        "review_id string, order_id string, review_score int, review_comment_title string, "
        "review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz"),
    "raw_products": (
        "product_id string, product_category_name string, product_name_lenght int, "
        "product_description_lenght int, product_photos_qty int, product_weight_g int, product_length_cm int, "
        "product_height_cm int, product_width_cm int"),
    "raw_sellers": "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string",
    "raw_product_category_name_translation": (
        "product_category_name string, product_category_name_english string"),
}
SOURCE_TABLES = tuple(SCHEMAS)


def load(spark: SparkSession, root: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """One source table by name from ``root/name`` with its declared schema.

    ``fmt`` is any file source; ``jdbc`` reads the table ``name`` from the database
    whose URL is ``root`` (pass partitionColumn and bounds to read it in parallel).
    """
    if fmt == "jdbc":
        reader = spark.read.format("jdbc").option("url", root).option("dbtable", name)
        return reader.option("customSchema", SCHEMAS[name].replace("timestamp_ntz", "timestamp")).options(
            **options).load()
    reader = spark.read.format(fmt).schema(SCHEMAS[name])
    if fmt == "csv":
        options = {"header": True, "multiLine": False, **options}
    return reader.options(**options).load(f"{root.rstrip('/')}/{name}")


def load_all(spark: SparkSession, root: str, fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    return {name: load(spark, root, name, fmt, **options) for name in SOURCE_TABLES}
