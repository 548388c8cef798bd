"""File sources, column harmonising and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.sources import cleaning as C

# fixed values: column names of the two deliveries
CATALOG_COLS = ["ste_id", "name", "category", "attributes"]
CONTRACT_COLS = [
    "purchase_name", "contract_id", "ste_id", "contract_date", "contract_cost", "customer_inn", "customer_name",
    "customer_region", "supplier_inn", "supplier_name", "supplier_region",
]
# fixed values: accepted headers per field
CATALOG_ALIASES = {
    "id": ["id", "ste_id", "identifier", "ste"],
    "name": ["name", "naimenovanie", "ste_name", "название"],
    "category": ["category", "kategoriya", "kategoria", "категория", "кпгз"],
    "attributes": ["attributes", "atributy", "attrs", "характеристики"],
}
CONTRACT_ALIASES = {
    "purchase_name": ["purchase_name", "naimenovanie_zakupki", "naimenovanie", "наименование"],
    "contract_id": ["contract_id", "identifikator_kontrakta", "id_kontrakta"],
    "ste_id": ["ste_id", "identifikator_ste", "id_ste", "кпгз"],
    "contract_date": ["contract_date", "data_zaklyucheniya", "data", "дата"],
    "cost": ["cost", "stoimost", "stoimost_kontrakta", "стоимость", "contract_cost"],
    "customer_inn": ["customer_inn", "inn_zakazchika", "инн заказчика", "инн"],
    "customer_name": ["customer_name", "naimenovanie_zakazchika"],
    "customer_region": ["customer_region", "region_zakazchika"],
    "supplier_inn": ["supplier_inn", "inn_postavshchika"],
    "supplier_name": ["supplier_name", "naimenovanie_postavshchika"],
    "supplier_region": ["supplier_region", "region_postavshchika"],
}


def _read(spark: SparkSession, path: str, header: bool, columns: list[str] | None) -> DataFrame:
    reader = spark.read.option("header", header).option("escape", '"').option("multiLine", False)
    if columns is None:
        return reader.option("sep", ",").csv(path)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return reader.option("sep", ";").schema(schema).csv(path)


def read_catalog(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Catalogue rows (item_id, name, category, attributes): headerless ``;`` file or headed file."""
    raw = _read(spark, path, header, None if header else CATALOG_COLS)
    named = harmonise_columns(raw, CATALOG_ALIASES) if header else raw.withColumnRenamed("ste_id", "id")
    out = named.select(C.to_int("id").alias("item_id"), "name", "category", "attributes")
    return out.withColumn("attributes", C.dedup_attributes(F.col("attributes")))


def read_contracts(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Contract rows with typed item, date and cost; ids stay strings."""
    raw = _read(spark, path, header, None if header else CONTRACT_COLS)
    named = harmonise_columns(raw, CONTRACT_ALIASES) if header else raw.withColumnRenamed("contract_cost", "cost")
    return (
        named.withColumn("item_id", C.to_int("ste_id"))
        .withColumn("contract_date", C.to_day("contract_date"))
        .withColumn("cost", C.to_number("cost").cast("decimal(15,2)"))
        .drop("ste_id")
    )


def column_mapping(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Field to column: an exact alias first, else the first column that contains an alias."""
    by_lower = {c.lower().strip(): c for c in columns}
    found = {}
    for field, names in aliases.items():
        names = [n.lower() for n in names]
        exact = [by_lower[n] for n in names if n in by_lower]
        partial = [c for low, c in by_lower.items() if any(n in low for n in names)]
        if exact or partial:
            found[field] = (exact or partial[-1:])[0]
    return found


def harmonise_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Select the known fields under their canonical names; missing ones become null."""
    found = column_mapping(df.columns, aliases)
    return df.select(*[
        (F.col(f"`{found[f]}`") if f in found else F.lit(None).cast("string")).alias(f) for f in aliases
    ])


def feature_sink(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Persist a feature table as Parquet."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_slice(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only the slices of ``column`` that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def event_source(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Interaction events of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
