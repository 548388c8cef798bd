"""Engine tables derived from the star-schema and event tables.

Every property is a lazy DataFrame over the whole source table; nothing is sampled, so the
work of a query grows with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.functions.skew import salted_join
from bidlens.operators.analytics import item_totals
from bidlens.session import cut_lineage


class Tables:
    """Catalogue, contracts, profiles, events, vectors and request log of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._stages: dict[str, DataFrame] | None = None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows over all cores if the file has fewer splits than that; large inputs stay as they are."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def keep(self, *names: str) -> "Tables":
        """Write the named tables once to the shared folder, for plans that read them often."""
        for name in names:
            self.__dict__[name] = cut_lineage(getattr(self, name), name)
        return self

    def staged(self) -> "Tables":
        """From now on keep signal tables: each is written once and read by every later step."""
        if self._stages is None:
            self._stages = {}
            self.keep("facts", "user_events", "requests")
        return self

    def stage(self, name: str, build) -> DataFrame:
        """The signal table ``name``; written once if staging is on, else just the plan."""
        if self._stages is None:
            return build()
        if name not in self._stages:
            self._stages[name] = cut_lineage(build(), name)
        return self._stages[name]

    def dim(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # ---- catalogue -----------------------------------------------------------------
    @cached_property
    def catalog_base(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("creator_user_id"),
            F.format_string(
                "brand:%s; size:%d; brand:%s", "p_brand", "p_size", "p_brand"
            ).alias("attributes_raw"),
        )

    @cached_property
    def order_counts(self) -> DataFrame:
        return self.item_totals.select("item_id", F.col("contract_count").alias("order_count"))

    @property
    def item_totals(self) -> DataFrame:
        """Contracts, volume and customers of every item; written once if staging is on."""
        return self.stage("item-totals", lambda: item_totals(self.facts))

    @cached_property
    def catalog(self) -> DataFrame:
        return self.catalog_base.join(self.order_counts, "item_id", "left").withColumn(
            "order_count", F.coalesce("order_count", F.lit(0).cast("long"))
        )

    # ---- contracts -----------------------------------------------------------------
    @cached_property
    def buyers(self) -> DataFrame:
        """Customers that file contracts."""
        return self.raw("customer")

    @cached_property
    def purchases(self) -> DataFrame:
        """Narrow contract rows: item, customer, supplier, date, cost."""
        return (
            self.raw("lineitem")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.buyers.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("l_partkey").alias("item_id"),
                F.col("c_custkey").alias("customer_id"),
                F.col("l_suppkey").alias("supplier_id"),
                F.to_date("o_orderdate").alias("contract_date"),
                F.col("l_extendedprice").cast("decimal(15,2)").alias("cost"),
                F.col("l_orderkey"),
                F.col("l_linenumber"),
                F.col("l_quantity"),
                F.col("l_discount"),
                F.col("l_tax"),
                F.col("l_shipdate"),
                F.col("l_returnflag"),
                F.col("l_linestatus"),
            )
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Purchases counted per (user, item); counts, popularity and profiles all start here."""
        return self.purchases.groupBy(F.col("customer_id").alias("user_id"), "item_id").agg(
            F.count("*").alias("times"), F.max("contract_date").alias("last_date"), F.sum("cost").alias("volume")
        )

    @cached_property
    def regional_facts(self) -> DataFrame:
        regions = self.customer_regions.select(F.col("customer_id").alias("user_id"), "customer_region")
        return self.facts.join(regions, "user_id")

    @cached_property
    def customer_regions(self) -> DataFrame:
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                F.col("r_name").alias("customer_region"),
                F.col("c_mktsegment").alias("segment"),
                F.col("c_acctbal").alias("balance"),
            )
        )

    @cached_property
    def contracts(self) -> DataFrame:
        """Contract rows with a unique id and the customer's name and region."""
        line = W.partitionBy("l_orderkey", "l_linenumber").orderBy(
            "item_id", "supplier_id", "l_quantity", "cost", "l_discount", "l_tax",
            "l_shipdate", "l_returnflag", "l_linestatus",
        )
        return (
            self.purchases.withColumn("rn", F.row_number().over(line))
            .withColumn("contract_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "rn"))
            .join(self.customer_regions.drop("segment", "balance"), "customer_id")
            .select(
                "contract_id", "item_id", "contract_date", "cost", "customer_id",
                "customer_name", "customer_region", "supplier_id",
            )
        )

    @cached_property
    def raw_contract_rows(self) -> DataFrame:
        """Contract rows whose id repeats, as an uncleaned delivery would have them."""
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("contract_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_extendedprice").alias("cost"),
        )

    # ---- profiles ------------------------------------------------------------------
    @cached_property
    def profiles(self) -> DataFrame:
        return self.customer_regions.select(
            F.col("customer_id").alias("user_id"),
            F.col("customer_name").alias("name"),
            F.col("customer_region").alias("region"),
            F.when(F.col("balance") > 0, F.col("segment")).alias("industry"),
            F.when(F.col("balance") > 5000, F.array("segment", F.lit("BUILDING"))).alias("interests"),
        )

    @cached_property
    def industry_categories(self) -> DataFrame:
        return self.dim(dicts.INDUSTRY_CATEGORIES, "industry string, category string")

    @cached_property
    def universal_categories(self) -> DataFrame:
        return self.dim(dicts.UNIVERSAL_CATEGORIES, "category string")

    @cached_property
    def domain_categories(self) -> DataFrame:
        return self.dim(dicts.DOMAIN_CATEGORIES, "category string, industry string")

    # ---- events --------------------------------------------------------------------
    @cached_property
    def user_events(self) -> DataFrame:
        return shape_events(self.raw("events"), self.catalog_base)

    @cached_property
    def requests(self) -> DataFrame:
        """One search request per user and normalised query of the log."""
        asked = self.user_events.select(
            "user_id", F.lower(F.trim("query")).alias("query"), "session_id"
        ).where("query is not null and query not in ('', '*')")
        return (
            asked.groupBy("user_id", "query")
            .agg(F.max("session_id").alias("session_id"))
            .join(
                self.raw("customer").select(
                    F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")
                ),
                "user_id",
                "left",
            )
            .select(
                F.concat_ws("|", "user_id", "query").alias("request_id"),
                "user_id", "query", "session_id",
                F.array("segment").alias("interests"),
                F.lit(10).alias("limit"), F.lit(0).alias("offset"),
                F.lit("relevance").alias("sort_by"), F.lit(None).cast("string").alias("category_filter"),
            )
        )

    def fan_out(self, hits: DataFrame, requests: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
        """Candidate rows of every request from the hits of its query.

        The requests, with their ``notes``, are hashed before they meet the hits, which are few and broadcast if Spark
        finds them small: then later steps per request find their rows in place and no candidate is shuffled. Else a query
        asked very often is spread over several tasks. The number of tasks is fixed, as size-based merging would see
        only the few bytes before the fan-out.
        """
        cores = self.spark.sparkContext.defaultParallelism
        tasks = max(cores, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        asked = (self.requests if requests is None else requests).repartition(tasks, "request_id")
        if notes is not None:
            asked = asked.join(notes.hint("merge"), "request_id", "left")  # leaves requests in order: so stay their candidates
        return salted_join(asked, hits, ["query"], ["request_id"])

    # ---- vectors and text ----------------------------------------------------------
    @cached_property
    def item_vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector")
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.spread(self.raw("documents"))


def shape_events(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Interaction events with item, session, query text and category; works on streams too."""
    kind = (
        F.when(F.col("event_type") == "purchase", "like")
        .when(F.col("event_type") == "signup", "compare")
        .when(
            F.col("event_type") == "error",
            F.when(F.col("value") < 20, "bounce").when(F.col("value") < 60, "dislike").otherwise("hide"),
        )
        .otherwise(F.col("event_type"))
    )
    shaped = events.select(
        "event_id", "ts", "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        kind.alias("event_type"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
    )
    joined = shaped.join(catalog.select("item_id", "name", "category"), "item_id", "left")  # unknown items stay, without name
    form = F.col("event_id") % 5
    query = (
        F.when(form == 0, F.lit(None).cast("string"))
        .when(form == 1, "*")
        .when(form == 2, F.upper(F.split_part("name", F.lit(" "), F.lit(1))))
        .when(form == 3, F.concat(F.lit("  "), F.split_part("name", F.lit(" "), F.lit(2)), F.lit(" ")))
        .otherwise(F.col("name"))
    )
    return joined.select(
        "event_id", "ts", "user_id", "item_id", "event_type", "session_id",
        query.alias("query"), "category", "name",
    )
