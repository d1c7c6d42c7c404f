"""Connected components of links, and dealing large groups out in cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import passing, stored

#: Bytes of the smaller side of a join up to which it is broadcast; beyond them both sides are shuffled.
BROADCAST_BYTES = 24 << 20
#: Members of a block; two blocks at most meet in a task.
BLOCK = 512
#: What the rows of a block weigh together, about, where they have a weight: tokens.
WEIGHT = 2_000_000


def _width(name: str, kind: T.DataType) -> Column | int:
    """Bytes of a column in a row, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        each = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, T.StructType) else 8
        return F.coalesce(F.size(name), F.lit(0)) * each + 16
    return 40 if isinstance(kind, T.StructType) else 8


def weight(df: DataFrame) -> int:
    """Bytes of a table's rows, about: strings, binaries and arrays by their lengths. Reads no other columns."""
    widths = [_width(f.name, f.dataType) for f in df.schema]
    fixed = 24 + sum(x for x in widths if isinstance(x, int))
    varying = [x for x in widths if not isinstance(x, int)]
    n, more = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(varying, F.lit(0)).cast("long")), F.lit(0))).first()
    return n * fixed + more


def small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its bytes are few enough."""
    return F.broadcast(df) if weight(df) <= BROADCAST_BYTES else df


def components(links: DataFrame) -> DataFrame:
    """id, component (least id reachable) of every id in links (a, b long); a stored table. Self-links and repeated links
    are allowed.

    Alternates two steps until nothing changes: every larger neighbour of a node is linked to the least one around it,
    then every node and its smaller neighbours to the least of these. Each step aggregates minima and joins them back.
    """
    with passing(links.sparkSession):
        now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null").distinct())
        before = None
        while True:
            state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("a")).first()
            if state == before or state[0] == state[2] and not now.select("b").intersect(now.where("a <> b").select("a")).head(1):
                break
            before = state
            both = now.union(now.select("b", "a"))
            least = small(stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))))
            large = both.join(least, F.col("a") == F.col("u")).where("b >= a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            large = stored(large)
            least = small(stored(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")))
            now = stored(large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).distinct())
        out = now.union(now.select(F.col("b").alias("a"), "b")).groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
        return stored(out, after=True)


def cells(members: DataFrame, group: str, block: int = BLOCK, own: bool = False, weight: str | None = None) -> DataFrame:
    """Rows of `group` (not null) dealt out so that each two of a group meet in a task: adds cell_ and, if asked for, own_ (the row's block).

    Groups of up to `block` rows, whose column `weight` (if named) adds up to WEIGHT at most, are one cell; larger ones are
    cut into blocks by id, and a cell holds two blocks.
    """
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(weight) / WEIGHT if weight else F.lit(0.0))).cast("int")
    sizes = small(stored(members.groupBy(group).agg(blocks.alias("blocks_")).where("blocks_ > 1")))
    dealt = members.join(sizes, group, "left").withColumn("blocks_", F.coalesce("blocks_", F.lit(1))).withColumn("own_", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks_")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks_") - 1)
    met = F.explode(F.transform(others, lambda x: F.struct(F.least("own_", x).alias("i"), F.greatest("own_", x).alias("j"))))
    return dealt.select(*members.columns, *(["own_"] if own else []), met.alias("cell_"))
