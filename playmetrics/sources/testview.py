"""The driver's TPC-H-style tables re-expressed in the shapes the operators take.

No driver table holds listen events, so the test view maps them:

    userId = o_custkey     artist = p_brand      song = p_name
    state  = n_name        duration = l_quantity ts = o_orderdate
    subscription = 'paid' for '1-URGENT' orders, else 'free'

Every view is a lazy join over the parquet files; all work grows with them.

Join order: customer x nation first (nation is 25 rows; its parquet size lets
the planner broadcast it), then orders x customer, lineitem x orders, and
lineitem x part on their keys, so only two joins move lineitem-sized data.
lineitem x orders is always a sort-merge join (both sides plain shuffles, so
adaptive execution can split a skewed key); the others are sort-merge joins
unless a side's file size is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import damage_text
from ..functions.time import calendar_columns, ntz_to_epoch_millis
from .schemas import US_STATES


# Fixed schemas of the driver tables (as stored in their parquet files).
# Reading with a schema skips the per-read footer inference on the driver.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.format("parquet")
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.load(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    cust = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    # lineitem and the orders side are both fact-sized: join them by sort-merge
    # at every size. Without the hint the static planner, which sizes a join
    # output as the product of its inputs, would broadcast the lineitem scan
    # whenever its pruned columns look small (about 0.7 s per query at sf0.1).
    lines = t("lineitem").join(orders.hint("merge"),
                               F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))


def _subscription() -> "F.Column":
    return (F.when(F.col("o_orderpriority") == F.lit("1-URGENT"), F.lit("paid"))
            .otherwise(F.lit("free")))


def listens_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned-listen shape without calendar columns."""
    return _joined(spark, sf_dir).select(
        F.col("o_custkey").alias("userId"),
        F.col("p_brand").alias("artist"),
        F.col("p_name").alias("song"),
        F.col("n_name").alias("state"),
        F.col("l_quantity").alias("duration"),
        _subscription().alias("subscription"),
        F.col("o_orderdate").alias("ts"),
    )


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned-listen shape: ``userId, artist, song, state, duration,
    subscription, ts, year, month, month_name``."""
    return listens_base(spark, sf_dir).withColumns(calendar_columns("ts"))


def hard_listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned-listen shape with harder values: NULL users, artists and states, fractional
    durations (quarters, so that sums are exact), the 64 part names as artists, and USPS codes
    (the first 25 of the state table) for the nations."""
    line = F.col("l_linenumber")
    codes = F.array(*[F.lit(code) for _, code in US_STATES[:25]])
    return _joined(spark, sf_dir).select(
        F.when(line != 7, F.col("o_custkey")).alias("userId"),
        F.when(line != 6, F.col("p_name")).alias("artist"),
        F.col("p_brand").alias("song"),
        F.when(line != 5, F.element_at(codes, (F.col("n_nationkey") + 1).cast("int")))
        .alias("state"),
        (F.col("l_quantity") + line * F.lit(0.25)).alias("duration"),
        _subscription().alias("subscription"),
        F.col("o_orderdate").alias("ts"),
    ).withColumns(calendar_columns("ts"))


def raw_listen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listen-event shape (19 columns, ``level``, epoch-ms ``ts``).

    Columns the driver tables have no counterpart for are typed NULLs.
    """
    def null(t: str) -> "F.Column":
        return F.lit(None).cast(t)

    return _joined(spark, sf_dir).select(
        F.col("o_custkey").cast("string").alias("userId"),
        null("string").alias("lastName"),
        null("string").alias("firstName"),
        null("string").alias("gender"),
        F.col("p_name").alias("song"),
        F.col("p_brand").alias("artist"),
        F.col("l_quantity").alias("duration"),
        F.col("l_orderkey").alias("sessionId"),
        F.col("l_linenumber").cast("long").alias("itemInSession"),
        null("string").alias("auth"),
        _subscription().alias("level"),
        null("string").alias("city"),
        F.col("n_name").alias("state"),
        null("string").alias("zip"),
        null("double").alias("lat"),
        null("double").alias("lon"),
        null("long").alias("registration"),
        null("string").alias("userAgent"),
        ntz_to_epoch_millis("o_orderdate").alias("ts"),
    )


def nation_dim(spark: SparkSession, sf_dir: str, with_regions: bool = False) -> DataFrame:
    """A state-style dimension from ``nation`` x ``region``:
    ``NAME = r_name || '/' || n_name``, ``state = n_name``.

    ``with_regions=True`` adds one row per region (``NAME = state = r_name``),
    which no listen carries, the way territories join the 51 states.
    """
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.col("r_name"), F.lit("/"), F.col("n_name")).alias("NAME"),
        F.col("n_name").alias("state"),
    )
    if not with_regions:
        return nations
    return nations.unionByName(r.select(F.col("r_name").alias("NAME"),
                                        F.col("r_name").alias("state")))


def nation_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary-style attribute table with one row per row of
    `nation_dim(with_regions=True)`: ``NAME``, ``STUSPS = state``, and
    ``geometry`` a WKT point (nationkey, regionkey) or (regionkey, 0)."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nations = (n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
               .select(F.concat(F.col("r_name"), F.lit("/"), F.col("n_name")).alias("NAME"),
                       F.col("n_name").alias("STUSPS"),
                       F.format_string("POINT (%d %d)", F.col("n_nationkey"),
                                       F.col("n_regionkey")).alias("geometry")))
    regions = r.select(F.col("r_name").alias("NAME"), F.col("r_name").alias("STUSPS"),
                       F.format_string("POINT (%d 0)", F.col("r_regionkey")).alias("geometry"))
    return nations.unionByName(regions)


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auth-event shape (the 16 auth columns, typed as `AUTH_SCHEMA`) plus
    ``event_id`` and ``event_type``, from ``events``, with NULLs to audit:

    ``userId`` NULL on 'error' events; ``level`` NULL on 'view' events,
    'paid' on 'purchase' events, else 'free'; ``success`` 'true' when
    ``value`` >= 50, else 'false'; ``ts`` epoch milliseconds.
    """
    def null(t: str) -> "F.Column":
        return F.lit(None).cast(t)

    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("event_type") == F.lit("error"), null("string"))
        .otherwise(F.col("user_id").cast("string")).alias("userId"),
        null("string").alias("lastName"), null("string").alias("firstName"),
        null("string").alias("gender"), null("string").alias("city"),
        null("string").alias("state"), null("string").alias("zip"),
        null("double").alias("lat"), null("double").alias("lon"),
        F.when(F.col("event_type") == F.lit("view"), null("string"))
        .when(F.col("event_type") == F.lit("purchase"), F.lit("paid"))
        .otherwise(F.lit("free")).alias("level"),
        F.col("event_id").alias("sessionId"), null("long").alias("itemInSession"),
        null("long").alias("registration"),
        F.when(F.col("value") >= F.lit(50.0), F.lit("true")).otherwise(F.lit("false"))
        .alias("success"),
        null("string").alias("userAgent"),
        ntz_to_epoch_millis("ts").alias("ts"),
        "event_id", "event_type",
    )


#: An accented ending, so that damage changes a name.
ACCENT = " Beyoncé"


def damaged_listen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`raw_listen_events` with accented artists and songs, damaged as often as the item's
    number modulo 3 says: never, once or twice."""
    times = F.col("itemInSession") % 3
    return raw_listen_events(spark, sf_dir).withColumns({
        c: F.when(times == 0, name).when(times == 1, damage_text(name, 1))
        .otherwise(damage_text(name, 2))
        for c in ("artist", "song") for name in [F.concat(F.col(c), F.lit(ACCENT))]})


def props_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, line): the JSON text of ``events.props``, broken by the id's last digit: 3 cut
    short, 4 a text for the number, 5 an array, 6 blank, 7 twice on a line."""
    digit, props = F.col("event_id") % 10, F.col("props")
    return table(spark, sf_dir, "events").select("event_id", F.when(
        digit == 3, F.substring(props, F.lit(1), F.length(props) - 1)).when(
        digit == 4, F.lit('{"k": "x"}')).when(digit == 5, F.concat(F.lit("["), props, F.lit("]")))
        .when(digit == 6, F.lit("  ")).when(digit == 7, F.concat_ws(" ", props, props))
        .otherwise(props).alias("line"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): `audit_events` as JSON lines; those whose session's last digit is 8 are cut short."""
    e = audit_events(spark, sf_dir).drop("event_id", "event_type")
    line = F.to_json(F.struct("*"))
    return e.select(F.when(F.col("sessionId") % 10 == 8, F.substring(line, F.lit(1), F.length(line) - 1))
                    .otherwise(line).alias("value"))


def page_view_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): ``events`` as JSON lines of unequal shape: ``user`` a text on every fourth
    event, ``amount`` on purchases only, ``extra`` an object."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(F.concat(
        F.lit('{"event_id": '), "event_id", F.lit(', "user": '),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"'), user, F.lit('"'))).otherwise(user),
        F.lit(', "kind": "'), "event_type", F.lit('", "value": '), F.col("value").cast("string"),
        F.when(F.col("event_type") == "purchase", F.concat(
            F.lit(', "amount": '), F.col("value").cast("string"))).otherwise(F.lit("")),
        F.lit(', "extra": '), "props", F.lit("}")).alias("value"))


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): ``orders`` as JSON lines."""
    return table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")).alias("value"))


def part_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, geometry): a WKT shape for each part, an L of arm width s at (x, y).

    By the key modulo 8: 0 with a square hole, 1 with a second square, 2 not closed, 3 a point,
    4 with a word for a number, 5 empty, 6 the L alone, 7 the L clockwise with heights."""
    kind = F.col("p_partkey") % 8
    x, y = -175.0 + F.col("p_partkey") % 50, 45.0 + F.col("p_size") % 20
    s = 0.5 + F.col("p_size") / 16.0

    def ring(*points, z=""):
        return F.concat(F.lit("("), F.concat_ws(", ", *[
            F.concat((x + s * a).cast("string"), F.lit(" "), (y + s * b).cast("string"), F.lit(z))
            for a, b in points]), F.lit(")"))

    def square(a, b, side):
        return ring((a, b), (a + side, b), (a + side, b + side), (a, b + side), (a, b))

    corners = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]
    shape = ring(*corners)
    text = (F.when(kind == 0, F.concat(F.lit("POLYGON ("), shape, F.lit(", "), square(0.25, 0.25, 0.25), F.lit(")")))
            .when(kind == 1, F.concat(F.lit("MULTIPOLYGON (("), shape, F.lit("), ("), square(3, 0, 1), F.lit("))")))
            .when(kind == 2, F.concat(F.lit("POLYGON ("), ring(*corners[:-1]), F.lit(")")))
            .when(kind == 3, F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" 0)")))
            .when(kind == 4, F.lit("POLYGON ((0 0, 1 0, 1 one, 0 0))")).when(kind == 5, F.lit("MULTIPOLYGON EMPTY"))
            .when(kind == 6, F.concat(F.lit("polygon("), shape, F.lit(")")))
            .otherwise(F.concat(F.lit("POLYGON Z ("), ring(*corners[::-1], z=" 12.5"), F.lit(")"))))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("geometry"))


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, lon, lat): a point for each customer, all over the globe."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 360 - 180 + F.lit(0.25)).alias("lon"),
        (F.col("c_custkey") % 179 - 89 + F.lit(0.5)).alias("lat"))
