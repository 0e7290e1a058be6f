"""Operator 5: exact Jaccard join of documents' shingle sets in metric space.

Jaccard distance d is a metric; two documents link within RADIUS of each other. Equal sets fall together first.

Who can link. Within the radius of x lies no set that lacks more than a quarter of x. A document of whose shingles less
than three quarters occur in other documents (`repeats`) is therefore alone, and most documents are.

Where they meet. All shingles have one order, those of few documents first. Two linked sets of n and m members share
s >= 0.75 (n + m) / 1.75 of them. If the first shared one stands at the places i and j of the sets (from 0), s is at most
n - i and m - j. So a document enters the regions of its first n - ceil(0.75 n) + 1 shingles with its place there, and two
members of a region are compared only if n - i and m - j allow a link: each linked pair passes in the region of its first
shared shingle.

What is left to ask. Only components are wanted, so members of a region that are joined already need no comparison, and
a region whose members are all joined is done. Level after level, crowded regions (at first all) draw pivots, four times
as many each level; members that are not yet joined to a pivot and may link with it are measured against it, and links
join them. In the end the members outside the largest component of a region are compared with all others of the region.

Every step follows from the threshold alone, so no component is lost; every link is verified on whole sets, in integers.
Before whole sets are sent for a pair, bitmaps of them bound its likeness from above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered
from .components import components
from .repeats import repeated_shingles
from .shingles import shingle_set

#: Least likeness as a fraction: intersection * DEN >= union * NUM.
NUM, DEN = 75, 100
#: A region with more members is crowded: it draws pivots at every level, others only at the first.
CROWDED = 64
LEVELS = 4
#: So many members of a region are compared with one outside its largest component by one key of the last join.
BLOCK = 256
#: Lists of ids up to this many are broadcast (some 40 MB); longer ones are joined by shuffles.
BROADCAST_IDS = 2_000_000


def linked(shared, a, b):
    """Whether sets of a and b members with so many in common link; exact in integers."""
    return DEN * shared >= NUM * (a + b - shared)


def _bounded(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table, broadcast where it is short."""
    return F.broadcast(df) if df.count() <= most else df


def _sets(rows: DataFrame) -> DataFrame:
    """node, n, set, bits of rows (node, text); empty sets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(b.column(1)[i].as_py()).view(np.int64) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.binary())], ["node", "n", "set", "bits"])

    return rows.mapInArrow(run, "node long, n long, set array<long>, bits binary").where("n > 0")


def bitmap(hashes: np.ndarray) -> bytes:
    """A bitmap of the low bits of a set's hashes: of a power of two of bits, 8 a hash at least."""
    bits = 64
    while bits < 8 * len(hashes):
        bits *= 2
    out = np.zeros(bits, bool)
    out[hashes & (bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def most_likeness(a: bytes, an: int, b: bytes, bn: int) -> float:
    """A bound from above of the likeness of sets of an and bn members with these bitmaps.

    Members that both have lie on bits that both have; beyond one a bit, only as many as share their bits in either set.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y, an, bn = y, x, bn, an
    x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)  # the low bits of the longer one
    count = lambda z: int(np.bitwise_count(z).sum(dtype=np.int64))
    shared = min(an, bn, count(x & y) + min(an - count(x), bn - count(y)))
    return shared / (an + bn - shared)


def _hopeful(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b, least) whose bitmaps allow a likeness of `least`."""
    one = sets.select(F.col("node").alias("na"), F.col("n").alias("an"), F.col("bits").alias("ab"))
    two = sets.select(F.col("node").alias("nb"), F.col("n").alias("bn"), F.col("bits").alias("bb"))
    met = pairs.join(one, F.col("a") == F.col("na")).join(two, F.col("b") == F.col("nb")).select("a", "b", "least", "an", "ab", "bn", "bb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, an, bn = (b.column(k).to_numpy() for k in (2, 3, 5))
            left, right = b.column(4).to_pylist(), b.column(6).to_pylist()
            kept = [most_likeness(left[i], int(an[i]), right[i], int(bn[i])) >= least[i] for i in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return gathered(met).mapInArrow(run, "a long, b long")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, likeness, ok of pairs(a, b, least): the share of the union that both have, and whether they link, exactly.

    Pairs whose likeness is below `least` by their bitmaps are left out.
    """
    pairs = cut(_hopeful(pairs, sets))
    one = sets.select(F.col("node").alias("na"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("nb"), F.col("set").alias("sb"))
    met = pairs.select("a", "b").join(one, F.col("a") == F.col("na")).join(two, F.col("b") == F.col("nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like, ok = [], []
            left, right = b.column(2), b.column(3)
            for i in range(b.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                like.append(shared / (len(x) + len(y) - shared))
                ok.append(bool(linked(shared, len(x), len(y))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(like, pa.float64()), pa.array(ok, pa.bool_())], ["a", "b", "likeness", "ok"])

    return gathered(met).mapInArrow(run, "a long, b long, likeness double, ok boolean")


def _regions(sets: DataFrame) -> DataFrame:
    """region, node, n, place: each set in the regions of as many of its first shingles as the threshold asks for.

    Shingles of one set alone come first of all and are no regions, so they count by their number only.
    """
    entries = sets.select("node", "n", F.xxhash64("set").alias("own"), F.explode("set").alias("region"))
    shared = entries.groupBy(F.col("region").alias("r")).agg(F.count("*").alias("members")).where("members > 1")
    held = entries.join(shared, F.col("region") == F.col("r")).groupBy("node", "n", "own").agg(F.collect_list(F.struct("members", "region")).alias("late")).select("node", "n", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i in range(b.num_rows):
                node, n, late = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].values
                members, region = (x.to_numpy(zero_copy_only=False) for x in late.flatten())
                alone = n - len(region)
                first = region[np.lexsort((region, members))][: max(0, n - -(-NUM * n // DEN) + 1 - alone)]
                made.append((first, np.full(len(first), node, np.int64), np.full(len(first), n, np.int64), alone + np.arange(len(first), dtype=np.int64)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], ["region", "node", "n", "place"])

    return held.mapInArrow(run, "region long, node long, n long, place long")


def _open(regions: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """region, node, n, place, root, members of the regions whose members are not all joined; without roots each is its own."""
    if roots is not None:
        known = roots.select(F.col("node").alias("x"), F.col("root").alias("new"))
        regions = regions.select("region", "node", "n", "place").join(_bounded(known), F.col("node") == F.col("x"), "left").withColumn("root", F.coalesce("new", "node")).drop("x", "new")
    else:
        regions = regions.withColumn("root", F.col("node"))
    apart = regions.groupBy(F.col("region").alias("r")).agg(F.count("*").alias("members"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return regions.join(apart.select("r", "members"), F.col("region") == F.col("r")).select("region", "node", "n", "place", "root", "members")


#: No pair that links is less like in floating point.
LINKS = NUM / DEN - 1e-9


def _may_link():
    """Whether sets of n and pn members whose first shared shingle stands at these places can link."""
    least = NUM * (F.col("n") + F.col("pn"))
    return ((F.col("n") - F.col("place")) * (NUM + DEN) >= least) & ((F.col("pn") - F.col("pplace")) * (NUM + DEN) >= least)


def _pairs(met: DataFrame) -> DataFrame:
    """a > b, once a pair, of rows with a node and a pivot p."""
    return met.select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b"), F.lit(LINKS).alias("least")).distinct()


def _with_pivots(met: DataFrame, level: int) -> DataFrame:
    """Pairs of the members of regions with up to 4 ** level pivots of theirs, each the first of a part of them by a draw."""
    part = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(4**level))
    draw = F.struct(F.xxhash64("node", F.lit(-1 - level)).alias("draw"), "node", "n", "place", "root")
    pivots = met.groupBy(F.col("region").alias("r"), part.alias("part")).agg(F.min(draw).alias("x")).select("r", F.col("x.node").alias("p"), F.col("x.n").alias("pn"), F.col("x.place").alias("pplace"), F.col("x.root").alias("proot"))
    return _pairs(met.join(pivots, (F.col("region") == F.col("r")) & (F.col("root") != F.col("proot")) & _may_link()))


def _all_pairs(met: DataFrame) -> DataFrame:
    """Pairs of the members of regions that are not joined yet: of two components, one isn't the region's largest."""
    sizes = met.groupBy("region", "root").agg(F.count("*").alias("k"))
    largest = cut(sizes.groupBy(F.col("region").alias("g")).agg(F.max_by("root", F.struct("k", "root")).alias("main")))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    outside = met.join(largest, (F.col("region") == F.col("g")) & (F.col("root") != F.col("main")))
    outside = outside.select(F.col("region").alias("r"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("q"), F.col("node").alias("p"), F.col("n").alias("pn"), F.col("place").alias("pplace"), F.col("root").alias("proot"))
    dealt = met.select("region", F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int").alias("part"), "node", "n", "place", "root")
    return _pairs(dealt.join(outside, (F.col("region") == F.col("r")) & (F.col("part") == F.col("q")) & (F.col("root") != F.col("proot")) & _may_link()))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: id, n_shingles, node; links: a, b between nodes). A node stands for the rows with equal sets: their smallest id; one
    without a set for itself.

    The links join all linked documents, but need not hold every linked pair of one component.
    """
    rows = cut(repeated_shingles(docs, id_col, text_col))
    named = rows.where("digest is not null and id is not null")
    classes = cut(named.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("node"), F.max((DEN * F.col("repeated") >= NUM * F.col("n_shingles"))).alias("social")))
    out = rows.join(classes, F.col("digest") == F.col("d"), "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("node", "id")).alias("node"))
    # Rows of one id are one document.
    either = F.coalesce("digest", F.lit(b""))
    texts_of_id = rows.where("id is not null").groupBy("id").agg(F.min(either).alias("one"), F.max(either).alias("other")).where("one <> other").select(F.col("id").alias("twice"))
    links = [named.join(_bounded(cut(texts_of_id)), F.col("id") == F.col("twice")).join(classes, F.col("digest") == F.col("d")).select(F.col("id").alias("a"), F.col("node").alias("b"))]
    wanted = _bounded(cut(classes.where("social").select("node").distinct()))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(wanted, "node", "left_semi")
    sets = cut(_sets(texts.dropDuplicates(["node", "text"])))
    regions = cut(_open(_regions(sets)))
    found, roots = None, None
    for level in range(LEVELS):
        met = regions if not level else regions.where(F.col("members") > CROWDED)
        if not met.head(1):
            break
        near = cut(_measured(_with_pivots(met, level), sets).where("ok").select("a", "b"))
        found = near if found is None else found.unionByName(near)
        roots = cut(components(found))
        regions = cut(_open(regions, roots))
    if regions.head(1):
        links.append(cut(_measured(_all_pairs(regions), sets).where("ok").select("a", "b")))
    if found is not None:
        links.append(found)
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    return out, every


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row.

    Null, empty and blank texts have empty sets: 0 shingles, their own id as the component. Rows of equal ids are one
    document; rows with a null id link with nothing and have a null component. An empty table gives no rows; other
    columns of any name are left out; texts are taken whole, however long.
    """
    kind = dict(docs.dtypes)[id_col]
    rows, links = near_links(docs, id_col, text_col)
    roots = components(links).withColumnRenamed("node", "_node")
    named = rows.join(_bounded(cut(roots)), F.col("node") == F.col("_node"), "left")
    return named.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.coalesce("root", "node").cast(kind).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, of the smallest id of each component; equal rows stay together, null ids all stay."""
    rows, links = near_links(docs, id_col, text_col)
    roots = _bounded(cut(components(links).withColumnRenamed("node", "_node")))
    gone = rows.join(roots, F.col("node") == F.col("_node"), "left").where(F.coalesce("root", "node") != F.col("id")).select(F.col("id").alias("_gone")).distinct()
    return docs.join(_bounded(cut(gone)), docs[id_col] == F.col("_gone"), "left_anti")
