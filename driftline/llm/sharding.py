"""Sharding by a k-d tree over metadata.

A node that has to make k shards is split into floor(k/2) and ceil(k/2): along its widest metadata dimension (spread of
the scaled coordinate), at the weighted quantile of bytes that goes with k. The quantile is found by histograms over the
cluster: each round narrows the interval of every open node by a factor of ``BUCKETS``, the buckets are added up in the cluster,
and the driver sees one row a node and round. What rows have to know of their node comes by a join with the table of nodes,
one row a node, so it has at most as many rows as there are shards.

Equal texts have one key: the least coordinate of all rows with the text in each dimension, then a hash of the text. So they
stay together whatever their metadata. Where a quantile falls into such a group, a light group goes to one side whole; a
heavy one (a group of copies may hold a third of all rows) is split by a hash of the identifier, as a hot key has to be.

Only DataFrame operations are used. Defined results: null texts count one byte and are equal to empty ones; null metadata are the
least coordinate; repeated rows, and rows with a null identifier, are separate rows; an empty table gives an empty table; the
input's other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, with_slots

#: Numbers a histogram has for one node.
BUCKETS = 4096
#: Bits of a coordinate, of the text hash that orders equal coordinates, and of the identifier hash.
COORDINATE_BITS, TEXT_BITS, ID_BITS = 24, 24, 24
#: A group under this share of the bytes of a shard goes to one side whole.
LIGHT = 0.02
#: Texts with at least this share of all rows get their coordinates by a broadcast; there are at most 1 / COMMON of them.
COMMON = 0.001


@dataclass
class _Node:
    """An open node makes shards ``first`` to ``first + k - 1``."""

    first: int
    k: int
    bytes: int = 0
    dim: int = 0


def _coordinate(value: Column, kind: str) -> Column:
    """A coordinate scaled to [0, 2^24): log scale for numbers, hash order for names."""
    top = (1 << COORDINATE_BITS) - 1
    if kind == "string":
        return F.when(value.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(value), 64 - COORDINATE_BITS)).cast("long")
    logs = F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1)
    return F.coalesce(F.least(F.floor(logs / 40 * top), F.lit(top)), F.lit(0)).cast("long")


def _nodes(table: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """The rows of ``table`` that are in one of the given nodes, with what is said of it: one row a node, at most as many as shards."""
    return table.join(F.broadcast(table.sparkSession.createDataFrame(rows, f"shard int, {schema}")), "shard")


def _quantiles(table: DataFrame, bits: int, want: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """For each node the ``key`` at which the bytes so far reach ``want``: (key, bytes below it, bytes at it)."""
    low, below, at = dict.fromkeys(want, 0), dict.fromkeys(want, 0), dict.fromkeys(want, 0)
    so_far = Window.partitionBy("shard").orderBy("b")
    while bits > 0:
        step = min(bits, BUCKETS.bit_length() - 1)
        bits -= step
        rows = _nodes(table, [(f, low[f], float(w - below[f])) for f, w in want.items()], "low long, rest double")
        rows = rows.withColumn("b", F.shiftright(F.col("key") - F.col("low"), bits)).where(f"b between 0 and {(1 << step) - 1}")
        sums = rows.groupBy("shard", "b").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
        sums = sums.withColumn("c", F.sum("s").over(so_far))  # no more than BUCKETS rows a node
        place = F.struct("b", (F.col("c") - F.col("s")).alias("before"), "s")
        reached = F.coalesce(F.min(F.when(F.col("c") >= F.col("rest"), place)), F.max(place))
        for r in sums.groupBy("shard").agg(reached.alias("p")).collect():
            f, p = r["shard"], r["p"]
            low[f], below[f], at[f] = low[f] + (p["b"] << bits), below[f] + p["before"], p["s"]
    return {f: (low[f], below[f], at[f]) for f in want}


def _split(table: DataFrame, nodes: dict[int, _Node], dims: int) -> DataFrame:
    """Splits every open node once; rows to the right get the first shard of the right child."""
    spread = [(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"w{i}") for i in range(dims)]
    for r in _nodes(table, [(f, n.k) for f, n in nodes.items()], "k int").groupBy("shard").agg(F.sum("size").alias("s"), *spread).collect():
        node = nodes[r["shard"]]
        node.bytes, node.dim = r["s"], max(range(dims), key=lambda i: (r[f"w{i}"], -i))
    live = {f: n for f, n in nodes.items() if n.bytes}
    key = F.shiftleft(F.array(*[f"d{i}" for i in range(dims)])[F.col("dim")], TEXT_BITS).bitwiseOR(F.col("text_hash"))
    keyed = _nodes(table, [(f, n.dim) for f, n in live.items()], "dim int").select("shard", "size", "id_hash", key.alias("key"))
    want = {f: n.bytes * (n.k // 2) / n.k for f, n in live.items()}
    cuts = _quantiles(keyed, COORDINATE_BITS + TEXT_BITS, want)
    heavy, limit = {}, {}  # keys below the limit go left
    for f, (k, below, at) in cuts.items():
        if at <= LIGHT * live[f].bytes / live[f].k:
            limit[f] = k + 1 if below + at - want[f] <= want[f] - below else k
        else:
            limit[f], heavy[f] = k, want[f] - below
    inner = {}
    if heavy:
        group = _nodes(keyed, [(f, cuts[f][0]) for f in heavy], "cut long").where("key = cut").select("shard", "size", F.col("id_hash").alias("key"))
        inner = _quantiles(group, ID_BITS, heavy)
    rows = [(f, n.dim, limit[f], cuts[f][0] if f in inner else None, inner[f][0] if f in inner else None, f + n.k // 2) for f, n in live.items()]
    told = F.broadcast(table.sparkSession.createDataFrame(rows, "shard int, dim int, _limit long, _cut long, _inner long, _right int"))
    left = (key < F.col("_limit")) | F.coalesce((key == F.col("_cut")) & (F.col("id_hash") <= F.col("_inner")), F.lit(False))
    moved = F.when(F.col("_right").isNotNull() & ~left, F.col("_right")).otherwise(F.col("shard"))
    return table.join(told, "shard", "left").withColumn("shard", moved).select(*table.columns)


def _together(table: DataFrame, dims: int) -> DataFrame:
    """Gives all rows of one text (``_text``) the least coordinate of them in each dimension."""
    names = [f"d{i}" for i in range(dims)]
    least = [F.min(n).alias(f"_{n}") for n in names]
    unequal = " or ".join(f"min({n}) < max({n})" for n in names)
    groups = table.groupBy("_text").agg(F.count(F.lit(1)).alias("_n"), F.expr(unequal).alias("_unequal"), *least).where("_unequal").drop("_unequal")
    # Texts of very many rows are at most 1 / COMMON; joined by a broadcast they don't meet in one task.
    total = table.count()
    common = F.broadcast(groups.where(F.col("_n") >= max(2.0, COMMON * total)).drop("_n"))
    rest = groups.where(F.col("_n") < max(2.0, COMMON * total)).drop("_n")
    is_common = table.join(common.withColumn("_common", F.lit(True)), "_text", "left")
    others = is_common.where("_common is null").drop("_common", *[f"_{n}" for n in names]).join(rest, "_text", "left")
    both = is_common.where("_common").drop("_common").unionByName(others)
    return both.withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop("_text", *[f"_{n}" for n in names])


def shard(documents: DataFrame, target_bytes: int | None = None, n_shards: int | None = None, dimensions: tuple[tuple[str, str], ...] = (("size", "number"), ("n_chars", "number"), ("lang", "string")), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    ``dimensions`` names metadata columns and their kind; ``size`` stands for the bytes of the row. Give ``target_bytes``
    (leaves reach it) or ``n_shards``.
    """
    scratch = Scratch(documents.sparkSession, "sharding")
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 1).cast("long")
    dims = [_coordinate(size if c == "size" else F.col(c), kind).alias(f"d{i}") for i, (c, kind) in enumerate(dimensions)]
    read = scratch.write(
        "read",
        documents.select(
            F.col(key).cast("long").alias("doc_id"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(body), 64 - TEXT_BITS).alias("text_hash"), F.shiftrightunsigned(F.xxhash64(F.col(key).cast("long"), F.lit("shard")), 64 - ID_BITS).alias("id_hash"), *dims,
            F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit("text"), body).alias("b")).alias("_text"),
        ),
    )
    table = scratch.write("rows", _together(read, len(dimensions)))
    scratch.drop("read")
    total, rows = table.agg(F.sum("size"), F.count(F.lit(1))).first()
    n = n_shards or max(1, -(-(total or 0) // target_bytes))
    nodes = {0: _Node(0, n)}
    table = table.withColumn("shard", F.lit(0))
    level = 0
    while rows and (open_ := {f: x for f, x in nodes.items() if x.k > 1}):
        table = scratch.write(f"level-{level}", _split(table, open_, len(dimensions)))
        if level:
            scratch.drop(f"level-{level - 1}")
        level += 1
        nodes = {c.first: c for x in nodes.values() for c in ([_Node(x.first, x.k // 2), _Node(x.first + x.k // 2, x.k - x.k // 2)] if x.k > 1 else [x])}
    out = with_slots(table.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id"], "slot", rows or 0)
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
