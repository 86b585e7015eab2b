"""Sharding by a hierarchical weighted hash tree.

A document descends the tree one level at a time. Every region draws, for the document, an exponential number
with the weight of its subtree as the rate, seeded by the document's identifier and the region's own name; the
region with the least draw takes it. Within the region racks draw with their weights, within the rack shards.
So a document costs one hash for each region, each rack of one region and each shard of one rack. Changing a
shard's weight changes the draws of its region, of its rack and its own, so documents move only into or out of
these subtrees.

The last region may have places that no shard fills yet. It has the weight of all its places, and draws for
them all: a rack's draw is the region's plus the rack's lag behind the first of its racks, a shard's is its
rack's plus the shard's lag behind the first of its rack. These are the draws that each place would have alone
(of independent exponential numbers the least, and the lags of the others, are exponential again). The draw of
a region that isn't full is the least of the shards that it has. A shard that fills a place changes no other
draw, so one more shard takes documents only into itself, whatever the number of shards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RACKS_PER_REGION, SHARDS_PER_RACK = 2, 4
#: Rows that one task numbers.
ROWS_PER_BUCKET = 50_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def layout(shards: int, weights: Sequence[float] | None = None) -> list[Shard]:
    """Shards 0, 1, 2 ... fill racks of four in regions of two racks."""
    if weights is not None and len(weights) != shards:
        raise ValueError(f"{len(weights)} weights for {shards} shards")
    rack = lambda n: n // SHARDS_PER_RACK
    return [Shard(n, rack(n) // RACKS_PER_REGION, rack(n), float(weights[n]) if weights else 1.0) for n in range(shards)]


def _draw(kind: str, seed: int, number: Column, doc_id: Column, weight: Column) -> Column:
    """An exponential number with a rate, seeded by the name of a region, rack or shard; null for weight 0."""
    name = F.concat(F.lit(f"{kind}-{seed}-"), number.cast("string"))
    return F.when(weight > 0, -F.log(common.hash_unit(name, doc_id)) / weight)


def _first(draws: list[Column], number: list[Column]) -> Column:
    """The number with the least draw; null draws are none."""
    both = [F.when(d.isNotNull(), F.struct(d.alias("draw"), n.alias("number"))) for d, n in zip(draws, number, strict=True)]
    return F.array_min(F.array(*both))


def placed(docs: DataFrame, doc_id: str, tree: Sequence[Shard], name: str, seed: int = 0) -> DataFrame:
    """Adds the column `name`, a struct of region, rack and shard.

    A shard of weight 0 gets no rows; one weight must be positive. Places that the tree doesn't name count with
    weight 1 in the draws of their region.
    """
    if not any(s.weight > 0 for s in tree):
        raise ValueError("no shard has a positive weight")
    racks = -(-len(tree) // SHARDS_PER_RACK)
    regions = -(-racks // RACKS_PER_REGION)
    places = regions * RACKS_PER_REGION * SHARDS_PER_RACK
    leaf = [s.weight for s in tree] + [1.0] * (places - len(tree))
    rack = [sum(leaf[i : i + SHARDS_PER_RACK]) for i in range(0, places, SHARDS_PER_RACK)]
    region = [sum(rack[i : i + RACKS_PER_REGION]) for i in range(0, len(rack), RACKS_PER_REGION)]
    weights = {"region": region, "rack": rack, "shard": leaf}
    id_ = F.col(doc_id)

    def draws(kind: str, first: Column, count: int) -> tuple[list[Column], list[Column]]:
        """Draws of `count` children in a row, of which the first has a number known only by the row."""
        table = F.array(*[F.lit(w) for w in weights[kind]])
        numbers = [first + i for i in range(count)]
        return [_draw(kind, seed, n, id_, F.get(table, n)) for n in numbers], numbers

    full = regions if places == len(tree) else regions - 1
    tops = [(_draw("region", seed, F.lit(n), id_, F.lit(region[n])), F.lit(n)) for n in range(full)]
    if full:
        docs = docs.withColumn("__region", _first(*map(list, zip(*tops, strict=True))))
    else:
        docs = docs.withColumn("__region", F.lit(None).cast("struct<draw:double,number:int>"))
    docs = docs.withColumn("__rack", _first(*draws("rack", F.col("__region.number") * RACKS_PER_REGION, RACKS_PER_REGION)))
    docs = docs.withColumn("__shard", _first(*draws("shard", F.col("__rack.number") * SHARDS_PER_RACK, SHARDS_PER_RACK)))
    place = F.struct(F.col("__region.number").alias("region"), F.col("__rack.number").alias("rack"), F.col("__shard.number").alias("shard"))
    if full < regions:
        top = _draw("region", seed, F.lit(full), id_, F.lit(region[full]))
        racked, _ = draws("rack", F.lit(full * RACKS_PER_REGION), RACKS_PER_REGION)
        docs = docs.withColumn("__top", top).withColumn("__racked", F.array(*racked))
        docs = docs.withColumn("__sharded", F.array(*[F.array(*draws("shard", F.lit((full * RACKS_PER_REGION + r) * SHARDS_PER_RACK), SHARDS_PER_RACK)[0]) for r in range(RACKS_PER_REGION)]))
        live = []
        for s in tree[full * RACKS_PER_REGION * SHARDS_PER_RACK :]:
            r, own = s.rack - full * RACKS_PER_REGION, F.get("__sharded", F.lit(s.rack - full * RACKS_PER_REGION))
            lag = F.get("__racked", F.lit(r)) - F.array_min("__racked") + F.get(own, F.lit(s.number % SHARDS_PER_RACK)) - F.array_min(own)
            if s.weight > 0:
                live.append(F.struct((F.col("__top") + lag).alias("draw"), F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack"), F.lit(s.number).alias("shard")))
        if live:
            least = F.array_min(F.array(*live))
            whole = F.when(F.col("__region").isNotNull(), F.struct(F.col("__region.draw").alias("draw"), "__region.number", "__rack.number", "__shard.number"))
            best = F.array_min(F.array(whole.cast("struct<draw:double,region:int,rack:int,shard:int>"), least))
            place = F.struct(best["region"].alias("region"), best["rack"].alias("rack"), best["shard"].alias("shard"))
    return docs.withColumn(name, place).drop("__region", "__rack", "__shard", "__top", "__racked", "__sharded")


def shard_documents(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, text: str = "text", seed: int = 0) -> DataFrame:
    """Every document's place: doc_id, size, text_crc32, region, rack, shard, slot, grown_shard.

    size is the text's bytes plus 1, a null text having none. shard depends on doc_id and the tree alone;
    grown_shard is the place after one more shard of weight 1. slot numbers a shard's rows 0, 1, 2 ... in
    the order of an MD5 of doc_id and text checksum, then doc_id, checksum and size; rows equal in all of
    these are interchangeable. A null doc_id is placed like the empty string. Empty table: empty result.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    tree = layout(shards, weights)
    grown = layout(shards + 1, [*weights, 1.0] if weights else None)
    whole = common.text_or_empty(text)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(whole).cast("bigint") + 1).alias("size"),
        F.crc32(whole).alias("text_crc32"),
    )
    rows = placed(placed(rows, "doc_id", tree, "place", seed), "doc_id", grown, "grown", seed)
    rows = rows.select(
        "doc_id", "size", "text_crc32", "place.region", "place.rack", "place.shard", F.col("grown.shard").alias("grown_shard"),
        F.md5(F.concat_ws(":", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"))).alias("at"),
    )
    rows = common.cut(rows)
    total = rows.count()
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = common.gapless_rank(rows, ["shard"], order, "at", common.bucket_digits(total, shards * ROWS_PER_BUCKET), "slot")
    return ranked.drop("at").withColumn("slot", F.col("slot").cast("bigint"))
