"""Embedding near-dedup by sorted projection passes.

Vectors that are equal within a label form one class, compared once. A pass orders the classes of a label and dimension
by a key of concatenated random hyperplane hashes (ties by a hash of their own per pass) and compares neighbours in
windows of about SPAN classes, all pairs of a window by cosine in double precision; the links of all passes are united.

How many windows a label needs decides how many leading hashes, its depth, tell them apart. A window holds whole ranges
of equal leading hashes, so two vectors at the threshold meet in a pass with probability (1 - angle / pi) ** depth at
least, closer ones sooner, and a label gets as many passes as find a link at the threshold with probability RECALL. A
label of SPAN classes or fewer is one window in one pass: all its links are found.

No window is cut: a range that dense groups or repeated directions have made longer than SPAN is compared in full, block
by block of WINDOW classes. Such blocks have a centre and a radius (the largest angle to the centre); by the triangle
inequality pairs of blocks too far apart hold no link and pairs close enough hold every link, and neither is compared.
Blocks of a window are cut along the windows that its members had in earlier passes, so that pairs of blocks which have
met before are skipped as a whole. A pair of classes counts in the first pass in which they share a window, which the
windows of both tell, so no pair list is needed: a pair of blocks returns link counts and the edges of a spanning forest.

Cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with
nothing and is its own component; vectors of different lengths don't link; repeated rows are linked copies; a null
vec_id takes part but never names a component with other members, and isn't kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.operators.graph import connected_components
from lumenspark.plans.ranking import with_position
from lumenspark.plans.scratch import materialize

THRESHOLD = 0.93
BITS = 48
SPAN = 8192
WINDOW = 8192
RECALL = 0.98
SEED = 20
_NUMBERS = 2_000_000  # components in a block at most, so that long vectors fit in memory
_SAFE = 1e-6  # what rounding may add to an angle


def hashes(vectors: np.ndarray, number: int) -> np.ndarray:
    """Sort keys of a pass: the signs of BITS random projections, the first in the highest bit."""
    planes = np.random.default_rng([SEED, vectors.shape[1], number]).standard_normal((vectors.shape[1], BITS))
    return (vectors @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def passes_for(depth: F.Column, threshold: float, recall: float) -> F.Column:
    """Passes that find a link at the threshold with probability `recall`."""
    agree = F.pow(F.lit(1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi), depth)
    return F.when(depth == 0, 1).otherwise(F.ceil(np.log(1 - recall) / F.log1p(-agree))).cast("int")


def units(v: pa.Array) -> np.ndarray:
    """Lists of one length as unit vectors."""
    own = v.flatten().to_numpy().astype(np.float64).reshape(len(v), -1)
    own = own / np.abs(own).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return own / np.sqrt((own * own).sum(axis=1, keepdims=True))


def block_links(left: np.ndarray, right: np.ndarray | None, mult: np.ndarray, threshold: float = THRESHOLD, met: np.ndarray | None = None, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Per class of two blocks (or of one, without `right`): the vectors linked to it, and the least place it is connected to.

    Places, `mult` and `met` go over the left block and then the right one. `met`: a row of earlier windows per class;
    two classes that share one have been compared.
    """
    other, shift = (left, 0) if right is None else (right, len(left))
    links, label = np.zeros(len(mult), np.int64), np.arange(len(mult))
    for begin in range(0, len(left), chunk):
        near = left[begin : begin + chunk] @ other.T >= threshold
        rows = np.arange(len(near))
        if right is None:
            near[rows, begin + rows] = False
        if met is not None and met.shape[1]:
            r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            some = near[np.ix_(r, c)]
            for mine, theirs in zip(met[begin + r].T, met[shift + c].T, strict=True):
                some &= mine[:, None] != theirs[None, :]
            near[np.ix_(r, c)] = some
        if right is not None:
            links[shift:] += mult[begin : begin + len(near)] @ near
        links[begin : begin + len(near)] += near @ mult[shift:]
        for x in np.flatnonzero(near.any(axis=1)).tolist():
            found = label[shift:][near[x]]
            least, most = min(found.min(), label[begin + x]), max(found.max(), label[begin + x])
            if least < most:
                joined = np.zeros(len(mult), bool)
                joined[found] = joined[label[begin + x]] = True
                label[joined[label]] = least
    return links, label


def _windows(classes: DataFrame, threshold: float, span: int, recall: float, n_parts: int) -> DataFrame:
    """(cid, label, dim, pass, window, position): the window of every class in each pass. A window's number is unique."""
    room = F.least(F.lit(span), F.greatest(F.lit(1), F.floor(F.lit(_NUMBERS) / F.col("dim")))).cast("long")
    depth = F.least(F.lit(BITS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / room)))).cast("int")
    plans = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("room", room).withColumn("depth", depth)
    plans = plans.select("label", "dim", "room", "depth", passes_for(F.col("depth"), threshold, recall).alias("passes"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cid, depths, passes = (b.column(c).to_numpy() for c in ("dim", "cid", "depth", "passes"))
            lists = b.column("v")
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for d in np.unique(dims).tolist():
                for number in range(int(passes[dims == d].max())):
                    at = np.flatnonzero((dims == d) & (passes > number))
                    key = hashes(flat[(offsets[at][:, None] + np.arange(d))].astype(np.float64), number)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("label").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), number, np.int32)), pa.array(key >> (BITS - depths[at])), pa.array(key), pa.array(cid[at])],
                        names=["label", "dim", "pass", "lead", "key", "cid"],
                    )

    kind = classes.schema["label"].dataType.simpleString()
    keyed = classes.join(plans, ["label", "dim"]).select("label", "dim", "v", "cid", "depth", "passes").mapInArrow(keys, f"label {kind}, dim int, pass int, lead long, key long, cid long")
    tied = keyed.withColumn("tie", F.xxhash64("cid", "pass"))
    placed = with_position(tied, ["label", "dim", "pass", "key", "tie"], n_parts).select("label", "dim", "pass", "lead", "cid", "position")
    starts = placed.groupBy("label", "dim", "pass", "lead").agg(F.min("position").alias("start"))
    begins = starts.groupBy("label", "dim", "pass").agg(F.min("start").alias("begin"))
    window = F.col("begin") + F.floor((F.col("start") - F.col("begin")) / F.col("room")) * F.col("room")
    ranges = starts.join(begins, ["label", "dim", "pass"]).join(plans, ["label", "dim"]).select("label", "dim", "pass", "lead", window.cast("long").alias("window"))
    return placed.join(ranges, ["label", "dim", "pass", "lead"]).select("cid", "label", "dim", "pass", "window", "position")


def _blocks(windows: DataFrame, window: int, n_parts: int) -> DataFrame:
    """(cid, pass, window, block, met): a window's blocks of `window` classes, and a class's windows in the passes before.

    The members of a window come in the order of their windows over all passes, so that a block's members mostly share them.
    """
    several = windows.filter("pass > 0")
    if several.isEmpty():
        placed = windows.withColumn("all", F.array("window"))
    else:
        every = windows.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("pass", "window"))).alias("all"))
        both = windows.join(every.select("cid", F.transform("all", lambda x: x["window"]).alias("all")), "cid").select("cid", "dim", "pass", "window", "all")
        placed = with_position(both, ["window", "all", "cid"], n_parts)
    begins = placed.groupBy("window").agg(F.min("position").alias("begin"))
    rows = F.least(F.lit(window), F.greatest(F.lit(1), F.floor(F.lit(_NUMBERS) / F.col("dim"))))
    block = (F.col("begin") + F.floor((F.col("position") - F.col("begin")) / rows) * rows).cast("long")  # the position of its first class
    return placed.join(begins, "window").select("cid", "pass", "window", block.alias("block"), F.slice("all", F.lit(1), F.col("pass")).alias("met"))


def _met(t: pa.Table) -> np.ndarray:
    return t.column("met").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, span: int = SPAN, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    element = vectors.schema["embedding"].dataType.elementType
    width = "float" if isinstance(element, T.FloatType) else "double"  # floats are exact in double precision, and half the shuffle
    rows = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{width}>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("v").isNotNull()
    marked = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    usable = marked.filter("fine").select("vec_id", "label", "v")
    classes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")
    windows = materialize(_windows(classes, threshold, span, recall, n_parts), "windows")
    blocks = materialize(_blocks(windows, window, n_parts), "blocks")  # without the vectors, which are fetched where they are compared
    ends = blocks.groupBy("window").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    whole = ends.filter("low = high").select("window", F.col("low").alias("block_a"), F.col("low").alias("block_b"))
    cut = blocks.join(ends.filter("low < high").select("window"), "window", "left_semi")
    own = classes.select("cid", "mult", "v")

    def outline(t: pa.Table) -> pa.Table:
        unit, met = units(t.column("v").combine_chunks()), _met(t)
        centre = unit.mean(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-3 else unit[0]
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
        cid, mult = t.column("cid").to_numpy(), t.column("mult").to_numpy()
        low, high = pa.array([met.min(axis=0).tolist()], pa.list_(pa.int64())), pa.array([met.max(axis=0).tolist()], pa.list_(pa.int64()))
        return pa.table({"window": t.column("window").slice(0, 1), "block": t.column("block").slice(0, 1), "centre": pa.array([centre.tolist()]), "radius": [radius], "root": [int(cid.min())], "total": [int(mult.sum())], "low": low, "high": high})

    outlines = cut.join(own, "cid").groupBy("block").applyInArrow(outline, "window long, block long, centre array<double>, radius double, root long, total long, low array<long>, high array<long>")
    outlines = materialize(outlines, "outlines")
    left, right = (outlines.select("window", *[F.col(c).alias(f"{c}_{x}") for c in outlines.columns[1:]]) for x in "ab")
    cosine = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    between = F.when(F.col("block_a") == F.col("block_b"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    both, reach = F.col("radius_a") + F.col("radius_b"), float(np.arccos(np.clip(threshold, -1, 1)))
    # earlier windows as (low, high) of the two blocks: one that all members share, or that no two of them can share
    earlier = F.zip_with(F.arrays_zip("low_a", "high_a"), F.arrays_zip("low_b", "high_b"), lambda x, y: F.struct(x["low_a"].alias("p"), x["high_a"].alias("q"), y["low_b"].alias("r"), y["high_b"].alias("s")))
    shared = F.exists(earlier, lambda x: (x["p"] == x["q"]) & (x["q"] == x["r"]) & (x["r"] == x["s"]))
    new = F.forall(earlier, lambda x: (x["q"] < x["r"]) | (x["s"] < x["p"]))
    pairs = left.join(right, "window").filter("block_a <= block_b").withColumn("between", between).filter((F.col("between") - both <= reach + _SAFE) & ~shared)
    pairs = pairs.select("block_a", "block_b", "root_a", "root_b", "total_a", "total_b", ((F.col("between") + both < reach - _SAFE) & new).alias("sure"))
    pairs = materialize(pairs, "pairs")

    compared = pairs.filter("not sure").select("block_a", "block_b").union(whole.select("block_a", "block_b"))
    members = compared.select(F.col("block_a").alias("block"), "block_a", "block_b").union(compared.filter("block_a < block_b").select(F.col("block_b"), "block_a", "block_b"))
    dealt = blocks.select("cid", "met", "block").join(members, "block").join(own, "cid").select("cid", "mult", "v", "met", "block", "block_a", "block_b")

    def compare(t: pa.Table) -> pa.Table:
        first = t.column("block").to_numpy() == t.column("block_a").to_numpy()
        order = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])
        n = int(first.sum())
        cid, mult = (t.column(c).to_numpy()[order] for c in ("cid", "mult"))
        unit = units(t.column("v").combine_chunks())[order]
        links, label = block_links(unit[:n], unit[n:] if n < len(unit) else None, mult, threshold, _met(t)[order])
        got = links > 0
        return pa.table({"cid": pa.array(cid[got]), "links": pa.array(links[got]), "root": pa.array(cid[label[got]])})

    tested = dealt.groupBy("block_a", "block_b").applyInArrow(compare, "cid long, links long, root long")
    # every class of a block links with every class of a sure partner
    partners = pairs.filter("sure").select(F.col("block_a").alias("block"), F.col("root_b").alias("root"), F.col("total_b").alias("total"))
    partners = partners.union(pairs.filter("sure and block_a < block_b").select("block_b", "root_a", "total_a"))
    partners = partners.groupBy("block").agg(F.sum("total").alias("total"), F.min("root").alias("root"))
    itself = pairs.filter("sure and block_a = block_b").select(F.col("block_a").alias("block"), F.lit(1).alias("itself"))
    sure = cut.select("cid", "block").join(partners, "block").join(itself, "block", "left").join(own.select("cid", "mult"), "cid")
    sure = sure.select("cid", (F.col("total") - F.when(F.col("itself").isNotNull(), F.col("mult")).otherwise(0)).alias("links"), "root")
    bridges = pairs.filter("sure and block_a < block_b").select(F.col("root_a").alias("cid"), F.lit(0).cast("long").alias("links"), F.col("root_b").alias("root"))
    found = materialize(tested.unionByName(sure).unionByName(bridges), "links")
    comps = connected_components(found.select("cid", "root")).toDF("cid", "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = materialize(classes.select("cid", "label", "v", "first", "mult").join(comps, "cid", "left").join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root")
    result = named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.col("least").alias("component_id"))
    linked = usable.join(result, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = marked.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
