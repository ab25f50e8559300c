"""Merkle manifest of a dataset: one digest for the whole table, one per source, and a proof for every row.

The nodes are kept outside memory, in Parquet partitioned by level. Leaves are sorted once by (source, doc_id) and
numbered within their source; a level reads the one below it, joins each run of 16 consecutive nodes to one and is written
before the next begins, so a level is a sixteenth of the one below and nothing but the root digest reaches the driver. The
sources' own roots are the leaves of a last tree in the order of the sources. Proofs come from the top down: each level is
joined once with the paths of its own nodes by coordinate (tree, index), a sort-merge join of two tables in that order, and
hands every child its siblings and the path above. A path is an array of (left, right): the digests before and after the
node in its run, as hex text.

H is lowercase hex SHA-256 of its inputs concatenated. A tree is named by the place of its first leaf in the sorted order.

Cases: a null field is `-`, other than an empty one, `0:`; rows without a source are a tree of their own, before all others;
null doc_ids come first in their tree; rows of one doc_id stand in the order of their leaves, so equal rows have equal
leaves, though different proofs; a row without doc_id has no CRC and isn't tampered with; an empty table gives no rows and
no root; columns besides the five fields are neither read nor needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.plans.ranking import with_position
from lumenspark.plans.scratch import materialize, new_path

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_digest(**changed: Column) -> Column:
    """H of the five fields of a row, some of them replaced."""
    parts = []
    for name in FIELDS:
        text = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, source, digest and `more` columns, one row per document."""
    return docs.select(*FIELDS).select("doc_id", F.col("source").cast("string").alias("source"), leaf_digest().alias("digest"), *[c.alias(n) for n, c in more.items()])


def _grow(nodes: DataFrame, biggest: int, store: str) -> list[DataFrame]:
    """The levels above `nodes` (tree, index, size, digest and what else a leaf carries): (tree, index, size, digest, children).

    size is the number of the tree's nodes on a level; a node with size 1 is its tree's root and goes no further.
    """
    levels, parent = [], F.col("index") - F.pmod("index", F.lit(FANOUT))
    while biggest > 1:
        carried = [c for c in nodes.columns if c not in ("tree", "size", "children")]
        runs = nodes.filter("size > 1").groupBy("tree", (parent / FANOUT).cast("long").alias("up"), F.ceil(F.col("size") / FANOUT).alias("size"))
        joined = runs.agg(F.sort_array(F.collect_list(F.struct("index", *[c for c in carried if c != "index"]))).alias("children"))
        digest = F.sha2(F.array_join("children.digest", ""), 256)
        nodes = materialize(joined.select("tree", F.col("up").alias("index"), "size", digest.alias("digest"), "children"), path=f"{store}/level={len(levels) + 1}")
        levels.append(nodes)
        biggest = -(-biggest // FANOUT)
    return levels


def _descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """tree, path and the fields of every leaf of the trees with a level above it. roots: tree, height, path of a tree's root."""
    below = None
    for height in range(len(levels), 0, -1):
        here = roots.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("index"), "path")
        here = here if below is None else here.unionByName(below.select("tree", "index", "path"))
        met = levels[height - 1].select("tree", "index", "children").join(here, ["tree", "index"])
        opened = met.select("tree", "path", F.col("children.digest").alias("run"), F.posexplode("children").alias("at", "child"))
        left, right = F.array_join(F.slice("run", 1, F.col("at")), ""), F.array_join(F.slice("run", F.col("at") + 2, F.size("run") - F.col("at") - 1), "")
        own = F.array(F.struct(left.alias("left"), right.alias("right")))
        below = opened.select("tree", "child.*", F.concat(own, "path").alias("path"))
    return below


@dataclass
class Manifest:
    """root: hex digest, None without rows; nodes: the leaves; levels: what stands above them; sources: source, tree, size,
    height, subroot and path, the siblings on the subroot's way to the root; store: the folder that holds the levels."""

    root: str | None
    nodes: DataFrame
    levels: list[DataFrame]
    sources: DataFrame
    store: str


def build(rows: DataFrame, store: str | None = None) -> Manifest:
    """The trees over leaves(), written to `store`, a folder of this driver's scratch tables if it isn't given."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = store or new_path(spark, "nodes")
    # written first: the sort samples its input, and texts shall be hashed once
    placed = with_position(materialize(rows, "leaves"), ["source", "doc_id", "digest"], parts, "place")
    sizes = materialize(placed.groupBy("source").agg(F.min("place").alias("tree"), F.count("*").alias("size")), "sources")
    spans = sizes.withColumnRenamed("source", "of")
    nodes = placed.join(spans, F.col("source").eqNullSafe(F.col("of"))).withColumn("index", F.col("place") - F.col("tree")).drop("of", "place", "source")
    nodes = materialize(nodes, path=f"{store}/level=0")
    levels = _grow(nodes, sizes.agg(F.max("size")).first()[0] or 0, f"{store}")
    tops = [x.filter("size = 1").select("tree", F.lit(k).alias("height"), F.col("digest")) for k, x in enumerate([nodes, *levels])]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    subroots = materialize(with_position(subroots, ["tree"], parts, "index"), "subroots")
    n = subroots.count()
    over = subroots.select(F.lit(0).cast("long").alias("tree"), "index", F.lit(n).cast("long").alias("size"), "digest", F.col("tree").alias("own"))
    upper = _grow(over, n, f"{store}/sources")
    root = (upper[-1] if upper else over).first()
    empty = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    if upper:
        whole = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(len(upper)).alias("height"), empty.alias("path"))
        paths = _descend(upper, whole).select(F.col("own").alias("tree"), "path")
        paths = subroots.join(paths, "tree")
    else:
        paths = subroots.withColumn("path", empty)
    sources = sizes.join(paths.select("tree", "height", F.col("digest").alias("subroot"), "path"), "tree")
    return Manifest(root["digest"] if root else None, nodes, levels, materialize(sources, "paths"), store)


def proofs(m: Manifest) -> DataFrame:
    """The leaves' columns, subroot and path: what leads from each leaf to the root."""
    alone = m.nodes.filter("size = 1").join(m.sources.filter("height = 0").select("tree", "path"), "tree").drop("size")
    rows = alone if not m.levels else alone.unionByName(_descend(m.levels, m.sources.select("tree", "height", "path")))
    return rows.join(m.sources.select("tree", "subroot"), "tree").drop("tree", "index")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda below, x: F.sha2(F.concat(x["left"], below, x["right"]), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Rows whose doc_id, as decimal text, has a CRC-32 that 5 divides are tampered with: A to Z of the text become lower case.
    Their folded root is that of the changed leaf with the original siblings.
    """
    text = F.col("text").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(hit & text.rlike("[A-Z]"), leaf_digest(text=F.translate(text, _UPPER, _UPPER.lower())))
    m = build(leaves(docs, changed=changed))
    rows = proofs(m).withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("path")))
    root = F.lit(m.root).cast("string")
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
