"""From shared buckets to links: which members of a bucket are worth comparing, without pairing all of them.

A bucket (a prefix n-gram, a MinHash band) proposes its members as candidates of each other. In a bucket of m copies,
m - 1 links already connect everything, so comparing all pairs would be quadratic work for nothing. Members are first
compared with a few hubs of their bucket, as pairs. Buckets whose members then still lie in different components are
compared completely: small ones as pairs, each pair once however many buckets propose it; large ones in blocks, where
each two blocks meet in one task that counts the overlaps of all their sets at once and returns links only. Both ways
compare the same members. So the components at the end are those of the full candidate graph, and neither candidates nor
partners are capped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrain.llm.common import settle
from riskgrain.llm.components import components

#: Hubs of a bucket in the successive rounds of pairs.
HUB_ROUNDS = (3,)
#: Members of a bucket compared as pairs, and of one block of a larger bucket.
SMALL, BLOCK = 32, 256


def shared_members(members: DataFrame) -> DataFrame:
    """The distinct rows of members (bucket, node, ...) whose bucket holds at least two different nodes.

    Counting and picking read one exchange of the members, by bucket.
    """
    dealt = members.repartition("bucket")
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = shared.where("low < high").select("bucket")
    return dealt.join(shared.hint("shuffle_hash"), "bucket").select(*members.columns).distinct()


def one_per_set(members: DataFrame) -> DataFrame:
    """The members (bucket, node), distinct rows, without buckets that propose what another one of the same members does.

    Sets of members are told by two 64-bit hashes and their size.
    """
    h = lambda *salt: F.bit_xor(F.xxhash64("node", *salt))
    per = members.groupBy("bucket").agg(F.count("*").alias("m"), h().alias("x"), h(F.lit(1)).alias("y"))
    return members.join(per.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")


def packed_sets(column: pa.Array) -> list[np.ndarray]:
    """Sets from their packed 64-bit hashes."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _size_ok(a: str, b: str, share: float):
    """Sets whose sizes differ too much cannot reach the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(share - 1e-9)


def block_links(members: DataFrame, sets: DataFrame, share: float, sets_of: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """(a, b) of components linked by members (bucket, node, comp) of one bucket and different components.

    ``sets`` has (node, payload), from which ``sets_of`` makes the hashes of each member's set. Members outside their bucket's largest component
    are probes; every block of probes meets every block of the bucket's members in one task.
    """
    per = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    size = per.groupBy("bucket").agg(F.sum("k").alias("m"), F.max(F.struct("k", "comp")).alias("main"))
    size = size.select("bucket", F.col("main.comp").alias("main"), *(F.ceil(n / BLOCK).cast("int").alias(c) for c, n in (("blocks", F.col("m")), ("probe_blocks", F.col("m") - F.col("main.k")))))
    placed = members.join(size, "bucket")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = placed.where("comp <> main").select("bucket", "node", "comp", own("probe_blocks").alias("i"), every("blocks").alias("j"), F.lit(True).alias("probe"))
    targets = placed.select("bucket", "node", "comp", every("probe_blocks").alias("i"), own("blocks").alias("j"), F.lit(False).alias("probe"))
    sent = probes.unionByName(targets).join(sets.toDF("node", "payload"), "node").select("bucket", "i", "j", "probe", "comp", "payload")

    def compare(rows):
        comps, probe = np.array(rows.column("comp")), np.array(rows.column("probe"))
        grams = sets_of(rows.column("payload"))
        left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
        a, b = set_links([grams[k] for k in left], [grams[k] for k in right], share)
        x, y = comps[left[a]], comps[right[b]]
        pairs = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)])[x != y], axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return sent.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def set_links(left: list[np.ndarray], right: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of sets whose Jaccard similarity is at least ``share``, by products of incidence matrices.

    Only elements of both sides can overlap; they go through in slices of columns.
    """
    common = np.zeros((len(left), len(right)), np.float32)
    sizes, flat, row = [], [], []
    for side in (left, right):
        sizes.append(np.array([len(s) for s in side], np.int64))
        flat.append(np.concatenate([np.zeros(0, np.uint64), *side]))
        row.append(np.repeat(np.arange(len(side)), sizes[-1]))
    both = np.intersect1d(flat[0], flat[1])
    spots = []
    for k in (0, 1):
        spot = np.minimum(np.searchsorted(both, flat[k]), max(len(both) - 1, 0))
        own = both[spot] == flat[k] if len(both) else np.zeros(len(flat[k]), bool)
        spots.append((row[k][own], spot[own]))
    for start in range(0, len(both), 4096):
        parts = []
        for (r, c), side in zip(spots, (left, right), strict=True):
            own = (c >= start) & (c < start + 4096)
            part = np.zeros((len(side), min(4096, len(both) - start)), np.float32)
            part[r[own], c[own] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    need = share * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-6
    return np.nonzero((common >= need) & (common > 0))


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after joining whole components by links (a, b) between them."""
    merged = components(links)
    if labels is None:
        return merged
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return settle(old.unionByName(merged.join(labels.select("node"), "node", "left_anti")))


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of buckets that hold more than one component, with their components."""
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    known = labels.select("node", F.col("component").alias("known"))
    now = members.join(known, "node", "left").withColumn("comp", F.coalesce("known", "node")).select(*members.columns, "comp")
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    return now.join(mixed.select("bucket"), "bucket")


def _pairs(now: DataFrame, other: DataFrame, size_share: float, tested: DataFrame | None) -> DataFrame:
    """(a, b, comp_a, comp_b), a < b: untested pairs of members of one bucket and different components."""
    pairs = now.join(other, "bucket").where((F.col("comp") != F.col("o_comp")) & _size_ok("n", "o_n", size_share))
    swap = F.col("node") > F.col("o_node")
    flip = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = pairs.select(flip("node", "o_node").alias("a"), flip("o_node", "node").alias("b"), flip("comp", "o_comp").alias("comp_a"), flip("o_comp", "comp").alias("comp_b"))
    pairs = pairs.distinct()
    return settle(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))


def connect(members: DataFrame, sets: DataFrame, share: float, size_share: float, verify: Callable[[DataFrame], DataFrame], sets_of: Callable[[pa.Array], list[np.ndarray]] = packed_sets) -> DataFrame:
    """(node, component) over the verified links among the members (bucket, node, n) of shared buckets.

    ``members`` and ``sets`` (node, payload, see ``block_links``) should be written tables, as every round reads them; ``sets`` bucketed by
    node. ``share``: the least Jaccard similarity of a link; ``size_share``: the least ratio of n. ``verify`` takes pairs
    (a, b), a < b, and returns those that are links. The result covers the nodes that have a link.
    """
    labels = tested = None
    names = [F.col(c).alias(f"o_{c}") for c in ("node", "n", "comp")]

    def joined(pairs: DataFrame) -> DataFrame:
        found = settle(verify(pairs.select("a", "b")))
        # links join whole components: only these need to be connected further
        return found.join(pairs, ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))

    for hubs in HUB_ROUNDS:
        now = _mixed(members, labels)
        slot = F.pmod(F.xxhash64("node"), F.lit(hubs)).alias("slot")
        hub = now.groupBy("bucket", slot).agg(F.min(F.struct(*names)).alias("hub")).select("bucket", "hub.*")
        pairs = _pairs(now, hub, size_share, tested)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        labels = _merge(labels, joined(pairs))
    # what two members have is tested; of more, all that is left
    rest = _mixed(members, labels)
    size = rest.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 2")
    rest = settle(rest.join(size, "bucket"))
    small = rest.where(F.col("m") <= SMALL).drop("m")
    links = joined(_pairs(small, small.select("bucket", *names), size_share, tested))
    large = rest.where(F.col("m") > SMALL).select("bucket", "node", "comp")
    return _merge(labels, links.unionByName(block_links(large, sets, share, sets_of)).distinct())
