"""The driver's tables seen as the study's tables.

nation is the province, (nation, market segment) the department, customer the establishment,
order priority its type, supplier and events are the cultural centres, and ordered parts are
people: part size is the age, quantity the number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# Level flags, by the type id they stand for (the order priority's digit minus one).
FLAGS = {f"flag_{i}": i for i in range(5)}

# Even nations have the shorter primary school.
LAST_PRIMARY_AGE = {12: range(0, 25, 2), 13: range(1, 25, 2)}

CITY, CITY_LABEL = 2, "ALL"


# The columns in use. Declared, so that opening a table does not start a job to read footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_size int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double"
    ),
    "events": "event_id bigint, user_id bigint, event_type string, value double",
}


class StandIns:
    """Model-shaped views of one data directory. Nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self._dir}/{name}.parquet")
        return self._tables[name]

    # -- dimensions -------------------------------------------------------------------------

    def provinces(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("id_prov"), F.col("n_name").alias("nombre")
        )

    def primary_ages(self) -> DataFrame:
        """(id_prov, last_age): a row for each supplier, so most provinces are listed many times.

        Provinces divisible by seven are not listed, or without an age.
        """
        nation = F.col("s_nationkey")
        return (
            self.table("supplier")
            .where((nation % 7 != 0) | (nation % 2 == 0))
            .select(
                nation.alias("id_prov"),
                F.when(nation % 7 != 0, 12 + nation % 3).cast("int").alias("last_age"),
            )
        )

    def departments(self, with_city: bool = False) -> DataFrame:
        areas = self.table("customer").select(
            F.col("c_nationkey").alias("id_prov"),
            F.col("c_mktsegment").alias("id_depto"),
            F.col("c_mktsegment").alias("nombre"),
        )
        if with_city:
            city = self.table("nation").where(F.col("n_nationkey") == CITY)
            areas = areas.union(city.select("n_nationkey", F.lit(CITY_LABEL), F.lit("City")))
        return areas.distinct()

    def event_departments(self) -> DataFrame:
        return (
            self.event_centres()
            .select("id_prov", "id_depto", F.upper("id_depto").alias("nombre"))
            .distinct()
        )

    # -- establishments ---------------------------------------------------------------------

    def establishments(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("Cueanexo"),
            F.col("c_nationkey").alias("id_prov"),
            F.col("c_mktsegment").alias("id_depto"),
        )

    def flags(self) -> DataFrame:
        """Register rows: an establishment repeats, each row sets one flag to '1'."""
        return self.table("orders").selectExpr(
            "o_custkey AS Cueanexo",
            *[
                f"IF(substring(o_orderpriority, 1, 1) = '{i + 1}', '1', ' ') AS {flag}"
                for flag, i in FLAGS.items()
            ],
        )

    def location_codes(self) -> DataFrame:
        """7- and 8-digit codes; departments of one nation are numbered districts.

        A few codes are bad: missing, of six digits, with letters, or no digits at all.
        """
        customer = self.table("customer")
        code = (F.col("c_nationkey") + 1).cast("bigint") * 1_000_000 + (
            (F.col("c_custkey") % 15 + 1) * 1000 + 7
        )
        district = F.when(
            F.col("c_nationkey") == 1,
            F.concat(F.lit("comuna "), (F.col("c_custkey") % 15 + 1).cast("string")),
        ).otherwise(F.col("c_mktsegment"))
        digits = code.cast("string")
        kind = F.col("c_custkey") % 13
        typed = (
            F.when(kind == 0, F.lit(None))
            .when(kind == 1, F.substring(digits, 1, 6))
            .when(kind == 2, F.concat(F.lit("x"), F.substring(digits, 2, 7)))
            .when(kind == 3, F.lit("s/d"))
            .otherwise(digits)
        )
        return customer.select(
            "c_custkey", typed.alias("cod_loc"), F.upper(district).alias("district")
        )

    def glued_keys(self) -> DataFrame:
        """Department keys of province and three digits; a few are missing, short or have letters."""
        digits = (
            (F.col("s_nationkey") + 1) * 1000 + (F.col("s_suppkey") % 5).cast("int") * 7
        ).cast("string")
        kind = F.col("s_suppkey") % 7
        typed = (
            F.when(kind == 0, F.lit(None))
            .when(kind == 1, F.lit("12"))
            .when(kind == 2, F.concat(F.lit("abc"), F.substring(digits, 1, 2)))
            .otherwise(digits)
        )
        return self.table("supplier").select("s_suppkey", typed.alias("glued"))

    # -- cultural centres -------------------------------------------------------------------

    def supplier_centres(self) -> DataFrame:
        segment = F.element_at(
            F.array(*[F.lit(s) for s in SEGMENTS]), (F.col("s_suppkey") % 5 + 1).cast("int")
        )
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id_cc"),
            F.col("s_nationkey").alias("id_prov"),
            segment.alias("id_depto"),
        )

    def event_centres(self) -> DataFrame:
        """Events as centres, with mail fields in the shapes people type them."""
        return self.table("events").selectExpr(
            "event_id AS id_cc",
            "CAST(user_id % 25 AS INT) AS id_prov",
            "event_type AS id_depto",
            "value AS Capacidad",
            """CASE event_id % 8
                 WHEN 0 THEN NULL
                 WHEN 1 THEN concat(' A', event_id % 5, '@Mail', user_id % 3, '.Com ')
                 WHEN 2 THEN 'a@x.org, b@y.org'
                 WHEN 3 THEN 'a@x.org b@y.org'
                 WHEN 4 THEN 's/d'
                 WHEN 5 THEN 'a@x.org,b@z.org'
                 WHEN 6 THEN 'u@'
                 ELSE concat('c@', event_type, '.net')
               END AS Mail""",
        )

    # -- population -------------------------------------------------------------------------

    def _order_areas(self) -> DataFrame:
        """Each order's department: the small join, done before the lineitems come in."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customers = self.table("customer").select(
            "c_custkey",
            F.col("c_nationkey").alias("id_prov"),
            F.col("c_mktsegment").alias("id_depto"),
        )
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop(
            "o_custkey", "c_custkey"
        )

    def population(self) -> DataFrame:
        """(id_prov, id_depto, Edad, Casos), one row per lineitem."""
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("Casos")
        )
        parts = self.table("part").select("p_partkey", F.col("p_size").alias("Edad"))
        return (
            lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .join(self._order_areas(), F.col("l_orderkey") == F.col("o_orderkey"))
            .select("id_prov", "id_depto", "Edad", "Casos")
        )

    def people(self) -> DataFrame:
        """(id_prov, id_depto, Casos) for reports that do not need ages.

        Lineitems are summed per order first: the join needs that partitioning anyway, and an
        order with very many lines meets it as one row.
        """
        per_order = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("Casos"))
        )
        return per_order.join(
            self._order_areas(), F.col("l_orderkey") == F.col("o_orderkey")
        ).select("id_prov", "id_depto", "Casos")

    def line_prices(self) -> DataFrame:
        """(id_prov, id_depto, price), one row per lineitem."""
        lines = self.table("lineitem").select("l_orderkey", F.col("l_extendedprice").alias("price"))
        return lines.join(
            self._order_areas(), F.col("l_orderkey") == F.col("o_orderkey")
        ).select("id_prov", "id_depto", "price")

    def raw_report(self, with_words: bool = False) -> DataFrame:
        """The orders as lines (seq, Edad, Casos) of one sectioned report.

        Urgent orders open a section, pending ones are totals, the last one is the summary. With
        words there is a ``path``, some ages and areas are words and some cells are empty.
        """
        orders = self.table("orders")
        last = orders.agg(F.max("o_orderkey")).scalar()
        code = F.lpad(F.col("o_custkey").cast("string"), 5, "0")
        is_header = F.col("o_orderpriority") == "1-URGENT"
        price = F.col("o_totalprice").cast("bigint").cast("string")
        if with_words:
            kind = F.col("o_custkey") % 17
            code = F.when(kind == 3, F.lit("s/d")).otherwise(code)
            price = F.when(kind == 4, F.lit(None)).when(kind == 5, F.lit("muchos")).otherwise(price)
            age = F.when(kind == 6, F.lit("85 y más")).otherwise((F.col("o_custkey") % 111).cast("string"))
        else:
            age = (F.col("o_custkey") % 111).cast("string")
        return orders.select(
            *([F.lit("orders").alias("path")] if with_words else []),
            F.col("o_orderkey").alias("seq"),
            F.when(F.col("o_orderkey") == last, "RESUMEN")
            .when(is_header, F.concat(F.lit("AREA # "), code))
            .when(F.col("o_orderstatus") == "P", "Total")
            .otherwise(age)
            .alias("Edad"),
            F.when(is_header, F.col("o_orderpriority")).otherwise(price).alias("Casos"),
        )
