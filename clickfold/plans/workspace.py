"""Workspace: the staged and derived tables of one dataset, built lazily from raw tables.

The reference materialises every stage (``SELECT ... INTO``) and queries views over them. Here a
``Workspace`` holds lazy DataFrames for each stage; :meth:`Workspace.materialize` writes them as
Parquet into the shared checkpoint folder (cutting lineage, surviving executor loss) with the file
layout the reference's two covering indexes ask for, and returns a workspace reading them back.
Metric functions in :mod:`clickfold.plans` take DataFrames, so they work on either form.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.functions.semantics import collate_strings
from clickfold.operators import inventory, staging
from clickfold.plans import abandonment
from clickfold.plans.publish import publish
from clickfold.session import scratch_path
from clickfold.sources.raw import LazyRawTables, RawTables

STAGED = ("events_temp", "inventory_events_temp", "orders_temp", "order_items_temp", "users_temp", "products")
DERIVED = ("cart_product_map", "stock_timeline", "stock_check", "cart_facts_sourced")
# A written table that also serves as another (its columns are a superset).
SERVES_AS = {"cart_facts_sourced": ("cart_facts",)}

# (one, its key, many, the key there): every row of ``many`` belongs to at most one row of ``one``. A slicer on
# ``one`` narrows ``many``, as filters travel along a dashboard's relationships; parents come first.
RELATIONS = (
    ("users_temp", "id", "orders_temp", "user_id"),
    ("users_temp", "id", "events_temp", "user_id_fix"),
    ("orders_temp", "order_id", "order_items_temp", "order_id"),
    ("products", "id", "order_items_temp", "product_id"),
    ("products", "id", "inventory_events_temp", "product_id"),
    ("products", "id", "cart_product_map", "product_id"),
)

# File layout per table when written: (cluster key, sort within files). Mirrors the reference's
# indexes on events (session_id, sequence_number) and inventory (product_id, created, sold).
LAYOUT = {
    "events_temp": (["session_id"], ["session_id", "sequence_number"]),
    "inventory_events_temp": (["product_id"], ["product_id", "created_date_clean", "sold_date_clean"]),
    "orders_temp": (["user_id"], ["user_id", "created_date_clean"]),
    "order_items_temp": (["order_id"], ["order_id"]),
    "users_temp": (["id"], ["id"]),
    "products": (["id"], ["id"]),
    "cart_product_map": (["session_id"], ["session_id", "cart_time"]),
    "stock_timeline": (["product_id"], ["product_id", "t"]),
    "stock_check": (["session_id"], ["session_id", "cart_time"]),
    "cart_facts_sourced": (["product_id"], ["product_id", "session_id"]),
}


def _bucketed(df: DataFrame) -> bool:
    """Whether ``df`` is a table that :meth:`Workspace.materialize` wrote in buckets, as it stands."""
    return getattr(df, "clickfold_bucketed", False)


class Workspace:
    def __init__(self, raw: RawTables | LazyRawTables | None = None, *,
                 tables: dict[str, DataFrame] | None = None, collation: str | None = None):
        """``collation``: ``None`` compares text byte-wise (the default decision of SURVEY S5);
        :data:`clickfold.functions.semantics.TSQL_COLLATION` reproduces SQL Server's case- and
        trailing-blank-insensitive comparisons for every raw string column."""
        self.raw = raw
        self.collation = collation
        for name, df in (tables or {}).items():
            self.__dict__[name] = df  # pre-seeds the cached properties

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> Workspace:
        from clickfold.sources.testdata import raw_tables
        return cls(raw_tables(spark, sf_dir), **kw)

    def _source(self, name: str) -> DataFrame:
        return collate_strings(getattr(self.raw, name), self.collation)

    # -- staged (preprocessing) -------------------------------------------------------------
    @cached_property
    def events_temp(self) -> DataFrame:
        return staging.stage_events(self._source("events"))

    @cached_property
    def inventory_events_temp(self) -> DataFrame:
        return staging.stage_inventory_events(self._source("inventory_events"))

    @cached_property
    def orders_temp(self) -> DataFrame:
        return staging.stage_orders(self._source("orders"))

    @cached_property
    def order_items_temp(self) -> DataFrame:
        return staging.stage_order_items(self._source("order_items"), self._source("orders"))

    @cached_property
    def users_temp(self) -> DataFrame:
        return staging.dedupe_users(self._source("users"))

    @cached_property
    def products(self) -> DataFrame:
        return self._source("products")

    # -- derived (analysis) -----------------------------------------------------------------
    @cached_property
    def cart_product_map(self) -> DataFrame:
        return inventory.cart_product_map(self.events_temp, clustered=_bucketed(self.events_temp))

    @cached_property
    def stock_timeline(self) -> DataFrame:
        return inventory.stock_timeline(self.inventory_events_temp)

    @cached_property
    def stock_check(self) -> DataFrame:
        return inventory.stock_check(self.cart_product_map, self.inventory_events_temp)

    @cached_property
    def cart_facts(self) -> DataFrame:
        """Stock-check rows with their session's purchase flag (abandonment metrics)."""
        return abandonment.cart_facts(self.stock_check, self.events_temp)

    @cached_property
    def cart_facts_sourced(self) -> DataFrame:
        """Cart facts with the session's source too (breakdowns by source)."""
        return abandonment.cart_facts(self.stock_check, self.events_temp, with_source=True)

    # -- slicers (dashboard cross-filters, D8) ----------------------------------------------
    def sliced(self, **predicates: Column) -> Workspace:
        """A workspace restricted by predicates on staged tables, e.g. ``sliced(events_temp=col('browser') == 'IE')``.

        The predicate sits directly above its stage and is pushed into the scan by Catalyst. Tables on the
        many side of a relation (:data:`RELATIONS`) keep the rows whose parent is left, by semi-joins on the
        key: a slicer on users narrows their orders, events and items, one on products the items, the stock
        and the cart map. The cart map is cut after the forward fill, so a product slicer does not change
        which product a cart belongs to. Other derived tables are rebuilt from the restricted ones.
        """
        unknown = sorted(set(predicates) - set(STAGED))
        if unknown:
            raise KeyError(f"slicers only apply to staged tables {STAGED}, got {unknown}")
        tables = {name: getattr(self, name) for name in STAGED}
        narrowed = set(predicates)
        for name, predicate in predicates.items():
            tables[name] = tables[name].filter(predicate)
        for one, key, many, ref in RELATIONS:
            if one not in narrowed:
                continue
            if many not in tables:  # the cart map, of the events as they are restricted by now
                tables[many] = Workspace(self.raw, tables=tables, collation=self.collation).cart_product_map
            parents = tables[one].select(F.col(key).alias("__parent"))
            tables[many] = tables[many].join(parents, F.col(ref) == F.col("__parent"), "left_semi")
            narrowed.add(many)
        return Workspace(self.raw, tables=tables, collation=self.collation)

    # -- materialisation --------------------------------------------------------------------
    def replace(self, root: str, names: tuple[str, ...] = STAGED + DERIVED, buckets: int | None = None) -> Workspace:
        """:meth:`materialize` as a new version below ``root``; the version of an earlier run goes once this
        one is complete, with its catalog tables (:mod:`clickfold.plans.publish`)."""
        spark = self.events_temp.sparkSession
        of_root = f"{zlib.crc32(root.rstrip('/').encode()):08x}"
        before = [t.name for t in spark.catalog.listTables(pattern=f"clickfold_{of_root}_*")]
        run = f"{of_root}_{uuid.uuid4().hex[:12]}"
        written = publish(spark, root, lambda folder: self.materialize(folder, names, buckets, run))
        for table in before:
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        return written

    def materialize(self, root: str | None = None, names: tuple[str, ...] = STAGED + DERIVED,
                    buckets: int | None = None, run: str | None = None) -> Workspace:
        """Write the named tables as Parquet under ``root`` (default: the shared checkpoint folder)
        and return a workspace that reads them back. Each write is one job; later metrics start
        from files, so an executor lost later never recomputes staging.

        Files hold ranges of (key, order), like an index on both: a key's rows lie together in order, and
        a key with many rows is split over as many files and write tasks as its share of the rows.

        With ``buckets``, every table is written as a bucketed catalog table instead (``bucketBy`` on its
        layout key, files under ``root``): events, cart map and stock check by session; inventory,
        timeline and cart facts by product; orders by user; items by order. Spark then reads each
        table already hash-partitioned by that key, so the per-session rollups, the forward fill
        and the joins on those keys need no shuffle at all. All rows of a key share a bucket: this is
        for tables without hot keys. Tables are registered in the session catalog (a metastore on a
        cluster) under ``clickfold_<run>_<name>``.
        """
        spark = self.events_temp.sparkSession
        run = run or uuid.uuid4().hex[:12]
        root = root or scratch_path(spark, f"workspace-{run}")
        # Tables already given to this workspace (e.g. by a slicer) carry over; every other table
        # is derived from the files written before it (names are in dependency order), so each
        # stage of the chain runs exactly once.
        seeded = {n: self.__dict__[n] for n in STAGED + DERIVED + ("cart_facts",) if n in self.__dict__}
        ws = Workspace(self.raw, tables=seeded, collation=self.collation)
        for name in names:
            df = getattr(ws, name)
            cluster, sort = LAYOUT[name]
            path = os.path.join(root, name)
            if buckets:
                table = f"clickfold_{run}_{name}"
                # hash-repartitioned like the buckets: each task writes one file per bucket
                (df.repartition(buckets, *cluster).write.bucketBy(buckets, *cluster).sortBy(*sort)
                 .option("path", path).mode("overwrite").saveAsTable(table))
                ws.__dict__[name] = spark.table(table)
                ws.__dict__[name].clickfold_bucketed = True
            else:
                (df.repartitionByRange(*sort).sortWithinPartitions(*sort)
                 .write.mode("overwrite").parquet(path))
                ws.__dict__[name] = spark.read.parquet(path)
            for alias in SERVES_AS.get(name, ()):
                ws.__dict__[alias] = ws.__dict__[name]
        return ws
