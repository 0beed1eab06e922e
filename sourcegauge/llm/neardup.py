"""Near duplicates by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct 5-word shingles; its sketch the ``SKETCH`` smallest of them. Two sets
with similarity 0.85 share about 0.85 of the smallest hashes of their union. Inverted lists of retained hashes find
pairs: if two sketches must share ``SHARED`` hashes, they share one of the ``SKETCH - SHARED + 1`` rarest of each, so only
those are listed, rarest first by how many documents retain them. A passage in a third of all documents is the last to be
listed. Sets no larger than a sketch are known whole and listed by the same rule without any chance of error. SHARED lies
six standard deviations below the expected overlap of pairs at the threshold.

The union-sketch estimate filters pairs, the exact similarity of the whole sets decides. Equal sets were merged before.
Groups of thousands of near copies are never paired all with all: lists first link their members to one member, the one
that has the fewest hashes of its own. Documents still apart from others of their lists are listed again by their whole sets and linked the
same way; what then remains apart in a list is compared pair by pair, so that no link between components is lost.

Intermediate tables are written to the shared folder; nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from . import hashing
from .common import keyed

SHINGLE = 5
SKETCH = 40
SHARED = 20
#: Threshold of the links, in hundredths.
SIMILAR = 85
#: Sets are linked if STEP times their symmetric difference is at most SLACK times the sum of their sizes.
STEP, SLACK = 100 + SIMILAR, 100 - SIMILAR
#: Lists of so many members at most are compared pair by pair; keys of a document on average up to which pairs of hashes serve as keys.
FEW, KEYS = 16, 500
#: Where the classes of a group's members begin, as shares of its members from the nearest to its middle on.
CLASSES = (0.01, 0.03, 0.1, 0.3, 0.6)
_SKETCHED = "k1 long, k2 long, doc_id long, s1 long, s2 long, n long, sketch array<long>"


def sets_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(identity in two halves, sorted distinct shingle hashes) of each text."""
    w = hashing.words(data, offsets, fold=hashing.LOWER)
    start = w.window_starts(SHINGLE)
    h = w.window_hashes(start, start + SHINGLE).view(np.int64)
    first, n = np.searchsorted(start, w.first), w.counts
    whole = [w.window_hashes(w.first[:-1], w.first[1:], second).view(np.int64) for second in (False, True)]
    for i in range(len(n)):
        if n[i] >= SHINGLE:
            yield int(whole[0][i]), int(whole[1][i]), np.unique(h[first[i] : first[i + 1]])
        else:
            yield int(whole[0][i]), int(whole[1][i]), whole[0][i : i + 1] if n[i] else whole[0][:0]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in hashing.slices(batch):
            got = list(sets_of(data, offsets))
            yield pa.RecordBatch.from_arrays([
                *(rows.column(c) for c in ("k1", "k2", "doc_id")), *(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)),
                pa.array([len(g[2]) for g in got], pa.int64()), pa.array([g[2][:SKETCH] for g in got], pa.list_(pa.int64())),
            ], ["k1", "k2", "doc_id", "s1", "s2", "n", "sketch"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in hashing.slices(batch):
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([g[2] for g in sets_of(data, offsets)], pa.list_(pa.int64()))], ["node", "hashes"])


def _node() -> Column:
    """A set's identity as one value that sorts and joins: 128 bits in hexadecimal."""
    return F.concat(F.lpad(F.hex("s1"), 16, "0"), F.lpad(F.hex("s2"), 16, "0")).alias("node")


def _close(a: Column, b: Column) -> Column:
    """Whether set sizes allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILAR


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps until all links are stars around their smallest node; the number of rounds grows with
    the logarithm of the number of nodes. No neighbourhood is gathered, and each round is written out, which cuts the lineage.
    """
    links = _stars(freeze(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _stars(links: DataFrame) -> DataFrame:
    """Written different links (u, v), u > v, made stars around the smallest nodes: one row for each other node."""

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v")

    def stars(links: DataFrame) -> bool:
        """Whether each node has one smaller neighbour, or only larger ones."""
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("v", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return nodes.where("up > 1 OR up = 1 AND down = 1").isEmpty()

    while not stars(links):
        links = freeze(star(star(links, True), False).distinct(), "links")
    return links


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after components were linked: only their labels are walked again, not the nodes."""
    stars = _stars(links)
    moved = stars.select(F.col("u").alias("label"), F.col("v").alias("to"))
    now = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return freeze(now.unionAll(stars.select(F.col("u").alias("node"), F.col("v").alias("label"))), "labels")


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, exact: bool) -> DataFrame:
    """Of pairs (a, b) of components (x, y), the links (u, v) of components, u > v: estimate from sketches first unless ``exact``, then whole sets."""

    def both(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            rows = rows.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return rows

    likely = pairs
    if not exact:
        a, b = F.col("sketch_a"), F.col("sketch_b")
        union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
        shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
        likely = freeze(both(pairs, reps, "sketch").where(shared * SKETCH >= F.size(union) * SHARED).select("a", "b", "x", "y"), "likely")
    a, b = F.col("hashes_a"), F.col("hashes_b")
    shared = F.size(F.array_intersect(a, b))
    linked = both(likely, sets, "hashes").where(shared * 100 >= (F.size(a) + F.size(b) - shared) * SIMILAR)
    return freeze(linked.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "linked")


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, any others); k1, k2 as in ``keyed``.

    Documents are linked if their sets' intersection has at least 85 hundredths of their union. A component's id is its smallest
    doc_id, null if all are null; the row with that id is kept. Null, empty and blank texts have no shingles and are linked with
    nothing. Texts of fewer than five words have one shingle. Rows that repeat in id and text are all kept or none. Other columns
    are not read. An empty table gives an empty result.

    ``exact``: list every document by its whole set, not only those that sketches leave apart, and filter no pair by sketches. No link can be
    lost then; without it one at the threshold is, about 3.5 times in 10^8. Whole sets of all documents are listed, which costs several times more.
    """
    rows = keyed(docs)
    sketched = freeze(rows.mapInArrow(_sketch, _SKETCHED).withColumn("node", F.when(F.col("n") > 0, _node())), "sketched")
    key = F.struct("k1", "k2")
    # One row for each different word sequence, with the document that stands for it.
    reps = sketched.where("n > 0").groupBy("node").agg(F.min(key).alias("k"), F.min("n").alias("n"), F.min_by("sketch", key).alias("sketch"))
    reps = freeze(reps, "sketches")

    lists = freeze(_listed(reps.withColumnRenamed("sketch", "held"), whole=False), "lists")
    wanted = reps if exact else lists.select("node").distinct().join(reps.select("node", "k"), "node")
    wanted = wanted.select("node", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"))
    # Rows that repeat are one, by the keys by which they were joined.
    texts = rows.join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("node").alias("node"), F.min("text").alias("text"))
    sets = freeze(texts.select("node", "text").mapInArrow(_whole, "node string, hashes array<long>"), "sets")

    # Before any link each node is a component of its own. Labels are kept of nodes that are not the smallest of their component.
    alone = lists.withColumn("label", F.col("node"))
    labels = _stars(_verified(_across(alone, _centres(alone)), reps, sets, exact)).select(F.col("u").alias("node"), F.col("v").alias("label"))

    # Members of lists in which more than one component is left are listed anew by their whole sets, without any chance of error:
    # of documents that are no more than alike, hashes of their own fill the part that is listed. What they leave is so few that sketches would
    # filter little of it: whole sets decide at once.
    rest = sets if exact else sets.join(_apart(lists.select("node", "h"), labels).select("node").distinct(), "node")
    lists = freeze(_listed(rest.select("node", F.size("hashes").cast("long").alias("n"), F.col("hashes").alias("held")), whole=True), "whole-lists")
    rest = freeze(_apart(lists, labels), "apart")
    more = _verified(_across(rest, _centres(rest)), reps, sets, True)
    if not more.isEmpty():
        labels = _merged(labels, more)
        rest = freeze(_apart(rest.drop("label", "members"), labels), "apart")
    few, many = rest.where(f"members <= {FEW}"), rest.where(f"members > {FEW}")
    every = few.select("h", F.struct("node", "n", "label", "most", "listed").alias("c"))
    more = _across(few, every, F.col("node") < F.col("c.node"))
    lists, nearest = _differing(many, sets)
    more = _verified(more.unionByName(nearest).unionByName(_feasible(lists, _middles(lists))), reps, sets, True)
    if not more.isEmpty():
        labels = _merged(labels, more)
    rest = freeze(_apart(lists.drop("label"), labels), "apart")
    every = rest.select("h", F.struct("node", "label", "far", "common", "class").alias("c"))
    more = _verified(_feasible(rest, every, F.col("node") < F.col("c.node")), reps, sets, True)
    if not more.isEmpty():
        labels = _merged(labels, more)

    known = sketched.drop("sketch").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = freeze(known, "members")
    # Written, so that the join deals out both sides anew and a large component can be split.
    least = freeze(known.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    out = known.join(least, "label", "left")
    of = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"),
                      F.coalesce(F.col("doc_id") == of, F.col("label").isNull() | F.col("least").isNull()).alias("kept"))


def _differing(many: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inverted lists of differences for members (h, node, label) of long lists, and pairs (a, b) that are links without any list.

    Lists with one centre form a group. Its middle M holds the hashes of more than half of the members; a set A is written as its symmetric
    difference A' from M. Two sets differ in |A'| + |B'| - 2 |A' & B'| hashes. With far(A) = STEP |A'| - SLACK |A| they are linked if and only if
    2 STEP |A' & B'| >= far(A) + far(B). If that sum is not above zero they are, whatever they share: these hang on the member of least ``far``.
    Else they share at least ``must`` of those differences that any two have (``common``), hence one of the common - must + 1 rarest, and of
    these the first shared and the must-th shared lie at least must - 1 places apart, so pairs of such places serve as keys.
    A partner that can share so many has 2 STEP common - far (its ``reach``) >= far(A); the least ``far`` of such gives ``must``.

    A few members near the middle would make ``must`` small for all. So members are in classes by their ``far``, and a pair is looked for on
    the level of its lower class alone: on that level all members from the class on are listed, with ``must`` for partners of that class or above.
    """
    centres = _centres(many).select("h", F.col("c.node").alias("g"))
    group = many.join(centres, "h").select("g", "node", "label").distinct()
    held = freeze(group.join(sets, "node"), "group-sets")
    half = held.groupBy("g").agg((F.count(F.lit(1)) / 2).alias("half"))
    shared = held.select("g", F.explode("hashes").alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("df"))
    middle = freeze(shared.join(half, "g").where("df > half").groupBy("g").agg(F.collect_list("x").alias("middle")), "group-middles")
    # A group without a middle differs from nothing.
    apart = held.join(middle, "g", "left").withColumn("middle", F.coalesce("middle", F.array().cast("array<bigint>")))
    differ = F.concat(F.array_except("hashes", "middle"), F.array_except("middle", "hashes"))
    differ = freeze(apart.select("g", "node", "label", F.size("hashes").cast("long").alias("n"), differ.alias("differ")), "group-differences")

    each = differ.select("g", "node", F.explode("differ").alias("x"))
    often = each.groupBy("g", "x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = each.join(often, ["g", "x"]).groupBy("g", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "x"))), lambda y: y["x"]).alias("places"))
    rows = differ.join(common, ["g", "node"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<bigint>")))
    rows = rows.withColumns({"far": F.size("differ") * STEP - F.col("n") * SLACK, "common": F.size("places").cast("long")}).drop("differ")
    rows = freeze(rows.withColumn("reach", 2 * STEP * F.col("common") - F.col("far")), "group-places")

    nearest = rows.groupBy("g").agg(F.min(F.struct("far", "node", "label")).alias("c"))
    nearest = rows.join(nearest, "g").where((F.col("label") != F.col("c.label")) & (F.col("far") + F.col("c.far") <= 0))
    # There are no more different values of reach in a group than sizes of sets and differences allow.
    partners = rows.groupBy("g", "reach").agg(F.min("far").alias("far")).groupBy("g").agg(F.collect_list(F.struct("reach", "far")).alias("partners"))
    nearest_far = F.array_min(F.transform(F.filter("partners", lambda y: y["reach"] >= F.col("far")), lambda y: y["far"]))
    rows = rows.join(freeze(partners, "group-partners"), "g").withColumn("least", nearest_far).where("least IS NOT NULL").drop("partners", "reach")
    bounds = rows.groupBy("g").agg(F.array_sort(F.array_distinct(F.concat(
        F.array(F.min("far")), F.percentile_approx("far", F.array(*map(F.lit, CLASSES)), F.lit(1000))))).alias("bounds"))
    rows = rows.join(freeze(bounds, "group-bounds"), "g").withColumn("class", F.size(F.filter("bounds", lambda y: y <= F.col("far"))) - 1)
    rows = rows.select("*", F.posexplode(F.slice("bounds", 1, F.col("class") + 1)).alias("level", "bound")).drop("bounds")
    rows = rows.withColumn("must", F.greatest(F.ceil((F.col("far") + F.greatest("least", "bound")) / (2 * STEP)), F.lit(1))).where("must <= common")
    rows = freeze(rows.withColumn("rarest", (F.col("common") - F.col("must") + 1).cast("int")), "group-listed")
    space = rows.groupBy("g", "level").agg(F.min("must").cast("int").alias("space"), F.avg(F.col("rarest") * (F.col("rarest") + 1) / 2).alias("keys"))
    rows = rows.join(freeze(space, "group-spaces"), ["g", "level"])
    one = F.transform(F.slice("places", 1, F.col("rarest")), lambda y: F.xxhash64("g", "level", y))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.col("rarest") - 1), lambda i: F.transform(
        F.slice("places", i + F.col("space"), F.col("rarest") - i), lambda y: F.xxhash64("g", "level", F.get("places", i), y))))
    keys = F.when((F.col("space") > 1) & (F.col("keys") <= KEYS), two).otherwise(one)
    lists = rows.select("node", "label", "far", "common", "class", "level", F.explode(F.array_distinct(keys)).alias("h"))
    several = lists.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min(F.col("class") - F.col("level")).alias("above")).where("df > 1 AND above = 0").select("h")
    return (freeze(lists.join(several, "h"), "group-lists"),
            nearest.select(*_pair()))


def _middles(lists: DataFrame) -> DataFrame:
    """Of each list of differences the member that is nearest to its group's middle."""
    return lists.groupBy("h").agg(F.min_by(F.struct("node", "label", "far", "common", "class"), F.struct("far", "node")).alias("c"))


def _feasible(rest: DataFrame, others: DataFrame, order: Column | None = None) -> DataFrame:
    """Pairs (a, b) of one list of differences in different components that have enough differences which others have too."""
    enough = (F.col("far") + F.col("c.far") <= 2 * STEP * F.least("common", "c.common")) & (F.least("class", "c.class") == F.col("level"))
    found = rest.join(others, "h").where((F.col("label") != F.col("c.label")) & enough & (F.lit(True) if order is None else order))
    return found.select(*_pair()).distinct()


def _listed(reps: DataFrame, whole: bool) -> DataFrame:
    """Inverted lists, one row for each (node, h): ``listed`` are all of a node's listed hashes, ``weight`` is large for a node
    whose hashes others have too, ``most`` is the largest intersection that it can have with any other; of sketches, as opposed to ``whole`` sets, only its size is known.

    ``reps``: (node, n, held), held being the set or its sketch; two linked nodes share ``must`` of their held hashes at least, so they share one of the ``size - must + 1``
    rarest of each. Hashes held by one node alone come first in that order, and need no list.
    """
    must = F.ceil(F.col("n") * SIMILAR / 100)
    held_size = F.col("n") if whole else F.least("n", F.lit(SKETCH))
    must = must if whole else F.when(F.col("n") >= SKETCH, SHARED).otherwise(must)
    held = reps.select("node", "n", F.explode("held").alias("h"))
    shared = held.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = held.join(shared, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    # Hashes of its own tell a copy from what it was copied from; between those without, the commoner wins.
    shared_by = F.aggregate("common", F.lit(0.0), lambda a, x: a + F.log(x["df"].cast("double"))) / F.size("common")
    weight = F.size("common") * 4 - held_size * 3 + shared_by / 1000
    # size - must + 1, less the hashes held by this node alone.
    rarest = F.greatest(F.size("common") - must + 1, F.lit(0)).cast("int")
    most = F.size("common").cast("long") if whole else F.col("n")
    return rows.select("node", "n", weight.alias("weight"), most.alias("most"), F.transform(F.slice("common", 1, rarest), lambda x: x["h"]).alias("listed")).withColumn("h", F.explode("listed"))


def _centres(rest: DataFrame) -> DataFrame:
    """Of each list the node with the fewest hashes of its own: of a group of near copies, the one nearest to all."""
    return rest.groupBy("h").agg(F.max_by(F.struct("node", "n", "label", "most", "listed"), F.struct("weight", "node")).alias("c"))


def _apart(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with the label of their component and the number of members, of lists that hold more than one component."""
    now = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = now.groupBy("h").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("members")).where("l <> m").select("h", "members")
    return now.join(several, "h")


def _pair() -> list[Column]:
    """A row and another one, c, as a pair (a, b) of components (x, y)."""
    a, b = F.struct("node", "label"), F.struct("c.node", "c.label")
    low, high = F.least(a, b), F.greatest(a, b)
    return [low["node"].alias("a"), high["node"].alias("b"), low["label"].alias("x"), high["label"].alias("y")]


def _across(rest: DataFrame, centres: DataFrame, order: Column | None = None) -> DataFrame:
    """Pairs (a, b) of members and centres of one list that are different components and whose sizes and hashes of their own allow a link.

    A pair comes from the least of the lists it shares only, so none comes twice; ``order`` keeps one of its two directions where all are centres.
    """
    possible = (F.col("n") + F.col("c.n")) * SIMILAR <= F.least("most", "c.most") * (100 + SIMILAR)
    once = F.array_min(F.array_intersect("listed", "c.listed")) == F.col("h")
    found = rest.join(centres, "h").where((F.col("label") != F.col("c.label")) & _close(F.col("n"), F.col("c.n")) & possible & once & (F.lit(True) if order is None else order))
    return found.select(*_pair())
