"""Problem 7: filling containers of fixed capacity with documents.

Bound-certified repacking. Items are hashed into groups of bounded size; each group is packed by
best-fit decreasing, and dual feasible functions over its sizes give a lower bound that certifies
its container count. Groups above their bound release the documents of their containers with
room; these are exchanged between groups by another hash and packed again, as long as that saves
containers. A document above the capacity is cut into full containers and one rest; nothing else
is ever cut.

Null and empty texts have no tokens and need no container. Each document counts once; a capacity
that is null or below 1 is ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .tokens import token_sizes

GROUP_ITEMS = 20_000  # items a group holds on average; bounds the memory of a task
KINDS_AT_ONCE = 1_000  # kinds of containers filled in one pass; more are filled in several


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, room left in each container). Open containers are kept by room,
    and a bit set of the rooms in use finds the tightest one at once."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # bit r is set if some container has room r
    room: list[int] = []
    for i in order:
        s = int(sizes[i])
        fits = used >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            c = by_room[r].pop()
            if not by_room[r]:
                used &= ~(1 << r)
        else:
            c, r = len(room), capacity
            room.append(0)
        r -= s
        room[c] = r
        by_room[r].append(c)
        used |= 1 << r
        where[i] = c
    return where, np.array(room, dtype=np.int64)


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that any packing needs, by the volume and two families of dual feasible functions."""
    if not len(sizes):
        return 0
    if counts is None:
        sizes, counts = np.unique(sizes, return_counts=True)
    sizes, c = sizes.astype(np.int64), capacity
    best = -(-int((sizes * counts).sum()) // c)
    for k in range(1, 21):  # u_k: x if (k+1)x is whole, else floor((k+1)x)/k
        scaled = (k + 1) * sizes
        whole = scaled % c == 0
        value = np.where(whole, k * sizes, c * (scaled // c))  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * c)))
    # for each limit e: items above c - e fill a container alone, items below e vanish; sums by prefix
    order = np.argsort(sizes, kind="stable")
    x, n = sizes[order], counts[order].astype(np.int64)
    below_n, below_v = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(x * n)])
    e = x[x * 2 <= c]
    if len(e):
        large, small = np.searchsorted(x, c - e, side="right"), np.searchsorted(x, e, side="left")
        value = c * (below_n[-1] - below_n[large]) + below_v[large] - below_v[small]
        best = max(best, -(-int(value.max()) // c))
    return best


_PACKED = "container_kind string, capacity int, grp long, doc_id long, piece_no int, start_token long, size int, bin int, room int, n_bins int, least_bins int"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    sizes = pdf["size"].to_numpy()
    capacity = int(pdf["capacity"].iloc[0])
    where, room = best_fit_decreasing(sizes, capacity)
    return pdf.assign(bin=where.astype("int32"), room=room[where].astype("int32"), n_bins=np.int32(len(room)), least_bins=np.int32(lower_bound(sizes, capacity)))[[c.split()[0] for c in _PACKED.split(", ")]]


def _packed(items: DataFrame, salt: int) -> DataFrame:
    """Items hashed into groups of their kind and packed; groups grow in number, not in size."""
    counts = items.groupBy("container_kind").agg(F.ceil(F.count("*") / GROUP_ITEMS).alias("groups"))
    keyed = items.drop("grp").join(counts, "container_kind").withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(salt)), F.col("groups")).cast("long")).drop("groups")
    return cut_lineage(keyed.groupBy("container_kind", "grp").applyInPandas(_pack, _PACKED))


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container_kind, container_id, capacity, doc_id, piece_no, start_token, size) of every piece.

    `sizes`: doc_id, tokens. The table of capacities is one row a kind.
    """
    kinds = capacities.where("container_kind is not null and capacity_tokens >= 1").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c")).orderBy("container_kind").collect()  # a table of settings
    if len(kinds) > KINDS_AT_ONCE:
        parts = [capacities.sparkSession.createDataFrame([(k["container_kind"], k["c"]) for k in kinds[lo : lo + KINDS_AT_ONCE]], "container_kind string, capacity_tokens int") for lo in range(0, len(kinds), KINDS_AT_ONCE)]
        return reduce(DataFrame.unionByName, [pack(sizes, part) for part in parts])
    if not kinds:
        kinds_col = F.array().cast("array<struct<container_kind:string,capacity:int>>")
    else:
        kinds_col = F.array(*[F.struct(F.lit(k["container_kind"]).alias("container_kind"), F.lit(int(k["c"])).alias("capacity")) for k in kinds])
    each = sizes.where("tokens > 0").select("doc_id", "tokens", F.explode(kinds_col).alias("k")).select("k.*", "doc_id", "tokens")
    n_pieces = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    pieces = each.select("container_kind", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * F.col("capacity")
    pieces = pieces.select("container_kind", "capacity", F.lit(0).cast("long").alias("grp"), "doc_id", "piece_no", start.alias("start_token"), F.least(F.col("capacity").cast("long"), F.col("tokens") - start).cast("int").alias("size"))
    full = pieces.where("size = capacity")
    named = lambda df, r: df.withColumn("container_id", F.concat_ws("-", "container_kind", F.lit(str(r)), "grp", "bin"))
    columns = ["container_kind", "container_id", "capacity", "doc_id", "piece_no", "start_token", "size"]
    done = full.withColumn("container_id", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece_no")).select(columns)
    packed = _packed(pieces.where("size < capacity"), 0)
    r = 0
    while True:  # ends: each round but the last saves a container of some kind
        r += 1
        loose = (F.col("n_bins") > F.col("least_bins")) & (F.col("room") > 0)
        released = packed.where(loose)
        if released.isEmpty():
            break
        again = _packed(released.select("container_kind", "capacity", "grp", "doc_id", "piece_no", "start_token", "size"), r)
        bins = lambda df, name: df.groupBy("container_kind").agg(F.count_distinct("grp", "bin").alias(name))
        better = bins(released, "before").join(bins(again, "after"), "container_kind").where("after < before").select("container_kind").collect()
        better = [x["container_kind"] for x in better]  # at most one a kind
        if not better:
            break
        won = F.col("container_kind").isin(better)
        done = done.unionByName(named(packed.where(won & ~loose), r - 1).select(columns))
        done = done.unionByName(named(packed.where(~won), r - 1).select(columns))
        packed = again.where(won)
    return done.unionByName(named(packed, r - 1).select(columns))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return cut_lineage(token_sizes(docs, ["doc_id"]).groupBy("doc_id").agg(F.max("tokens").alias("tokens")))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the containers of each kind."""
    return pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, certified least number, and share of room unused, by kind."""
    placed = cut_lineage(placements(spark, sf_dir))
    made = placed.groupBy("container_kind", "capacity").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("size").alias("n_tokens"), F.count_distinct("doc_id").alias("n_documents"))
    sizes = placed.groupBy("container_kind", "capacity", "size").agg(F.count("*").alias("n"))  # at most `capacity` rows a kind

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"container_kind": [pdf["container_kind"].iloc[0]], "least": [lower_bound(pdf["size"].to_numpy(), int(pdf["capacity"].iloc[0]), pdf["n"].to_numpy())]})

    least = sizes.groupBy("container_kind").applyInPandas(bound, "container_kind string, least long")
    unused = 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))
    return made.join(least, "container_kind").select("container_kind", "capacity", "n_documents", "n_tokens", "n_containers", F.col("least").alias("least_containers"), unused.alias("unused_share"))


QUERIES = {"p7_placements": placements, "p7_report": report}
ORACLES: dict[str, str] = {}
