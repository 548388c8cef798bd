"""Cleaning of catalogue, contract and profile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.functions.text import short_substrings
from bidlens.operators.analytics import numbered


# ---- values ------------------------------------------------------------------------------
def to_number(c) -> Column:
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def to_int(c: str) -> Column:
    """Integer via float, null if it is no number."""
    return F.expr(f"try_cast(try_cast({c} as double) as bigint)")


def to_day(c: str) -> Column:
    return F.expr(f"try_cast({c} as date)")


def typed_cast(df: DataFrame, ints: list[str] = (), numbers: list[str] = (), days: list[str] = ()) -> DataFrame:
    """Lenient casts; values that do not parse become null."""
    casts = {**{c: to_int(c) for c in ints}, **{c: to_number(c) for c in numbers}, **{c: to_day(c) for c in days}}
    return df.withColumns(casts)


def dedup_attributes(c: Column) -> Column:
    """Drop repeated ``k:v`` pairs of a ``;`` list, keeping the order."""
    pairs = F.filter(F.transform(F.split(c, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(c.isNull() | (c == "nan"), "").otherwise(F.array_join(F.array_distinct(pairs), "; "))


def parse_attributes(c: Column) -> Column:
    """JSON object, else the pairs of ``k:v; k:v``, else the text under ``raw``."""
    as_json = F.when(F.startswith(F.trim(c), F.lit("{")), F.from_json(c, "map<string,string>"))
    colon = lambda p: F.locate(":", p)
    pairs = F.filter(
        F.transform(
            F.split(c, ";"),
            lambda p: F.struct(
                F.trim(F.substring_index(p, ":", 1)).alias("key"),
                F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("value"),
            ),
        ),
        lambda e: (e["key"] != "") & (e["value"] != "") & (e["key"] != e["value"]),
    )
    # the last value of a repeated key wins
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda n: n["key"] == e["key"]))
    raw = F.when(c.isNotNull() & (F.trim(c) != ""), F.create_map(F.lit("raw"), c))
    return F.coalesce(
        as_json, F.when(F.contains(c, F.lit(":")) & (F.size(last) > 0), F.map_from_entries(last)), raw,
        F.create_map().cast("map<string,string>"),
    )


# ---- rows --------------------------------------------------------------------------------
def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key in ``order``; a minimum, so map tasks already reduce repeated keys."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def dedup_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, kept rows and dropped rows of a de-duplication."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows_in"), F.count("*").alias("rows_kept"), F.sum(F.col("n") - 1).alias("rows_dropped")
    )


def ingest_report(raw: DataFrame, typed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows in, and per field the values that were present but did not parse."""
    both = raw.select(key, *[F.col(f).alias(f"_raw_{f}") for f in fields]).join(typed.select(key, *fields), key)
    return both.agg(
        F.count("*").alias("rows_in"),
        *[F.count_if(F.col(f"_raw_{f}").isNotNull() & F.col(f).isNull()).alias(f"rejected_{f}") for f in fields],
    )


def profiles_from_contracts(contracts: DataFrame, existing: DataFrame) -> DataFrame:
    """One profile per customer (first name and region by contract), only for new customers."""
    first = first_by_key(
        contracts.select(F.col("customer_id").alias("user_id"), "contract_id", "customer_name", "customer_region")
        .where("user_id is not null"),
        "user_id", ["contract_id"],
    )
    fresh = first.join(existing.select("user_id").distinct(), "user_id", "left_anti")
    return fresh.select("user_id", F.col("customer_name").alias("name"), F.col("customer_region").alias("region"))


def profile_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge onboarding answers: given values overwrite; interests default to the industry."""
    given = lambda c: F.nullif(F.col(f"n.{c}"), F.lit(""))
    wanted = F.when(F.size("n.interests") > 0, F.col("n.interests")).otherwise(
        F.when(given("industry").isNotNull(), F.array(given("industry")))
    )
    is_new = F.col("e.user_id").isNull()
    return (
        existing.alias("e")
        .join(incoming.alias("n"), F.col("e.user_id") == F.col("n.user_id"), "full")
        .select(
            F.coalesce("e.user_id", "n.user_id").alias("user_id"),
            F.coalesce(given("name"), "e.name").alias("name"),
            F.coalesce(given("region"), "e.region").alias("region"),
            F.coalesce(given("industry"), F.when(is_new, F.get(wanted, F.lit(0))), F.col("e.industry")).alias("industry"),
            F.coalesce(wanted, "e.interests", F.when(is_new, F.array().cast("array<string>"))).alias("interests"),
        )
    )


def category_sample_contracts(
    patterns: DataFrame, catalog: DataFrame, as_of: Column
) -> DataFrame:
    """Up to n items per (profile, category pattern) as synthetic contracts.

    ``patterns(profile_id, pattern, n)``. Patterns meet the distinct categories on three letters;
    a category's items are numbered first, so that a pattern meets no more than its n of each.
    """
    names = catalog.select("category").distinct()
    matched = (
        patterns.withColumn("k", F.substring(F.lower("pattern"), 1, 3))
        .join(names.select("category", F.explode(short_substrings(F.lower("category"))).alias("k")), "k")
        .where(F.contains(F.lower("category"), F.lower("pattern")))
        .drop("k")
    )
    items = numbered(catalog.select("category", "item_id"), "category", ["item_id"]).withColumnRenamed("rn", "place")
    rows = matched.join(items, "category").where("place <= n").withColumn("slice", F.concat_ws("-", "profile_id", "pattern"))
    best = numbered(rows, "slice", ["item_id"]).where("rn <= n")
    contract_id = F.concat_ws("-", F.lit("DEMO"), "profile_id", "item_id")
    digest = F.conv(F.substring(F.md5(contract_id), 1, 8), 16, 10).cast("long")
    return best.select(
        contract_id.alias("contract_id"), "profile_id", "item_id", F.concat(F.lit("Закупка: "), "pattern").alias("purchase_name"),
        F.date_sub(as_of, (digest % 365 + 1).cast("int")).alias("contract_date"),
        ((digest % 49900001 + 100000) / 100.0).alias("cost"),
    ).dropDuplicates(["contract_id"])


def delta_ingest(source: DataFrame, cached: DataFrame, key: str, derive) -> DataFrame:
    """Derive only the rows missing from the cached table; append the result to it."""
    return derive(source.join(cached.select(key), key, "left_anti"))


def validated_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events and the quarantined rest."""
    ok = (
        F.col("event_type").isin(dicts.EVENT_TYPES) & F.col("user_id").isNotNull() & F.col("item_id").isNotNull()
    )
    ok = F.coalesce(ok, F.lit(False))
    return events.where(ok), events.where(~ok)
