"""Near-duplicate detection with a MinHash LSH forest.

1. One pass makes, for each text, its set of distinct 5-word shingles (fewer words: the
   whole sequence), a 128-bit fingerprint of the set and ``K`` minimum hashes. Texts with
   equal sets are one class, represented by its smallest doc_id, before anything else.
2. *Forest.* The signature is read in ``TREES`` orders; each tree sorts the classes by
   its order. A *region* is a run of classes that agree in the first ``DEPTH`` places of
   the order. In a small region every pair is a candidate. In a larger one the next
   places of the order decide: candidates are the neighbours with the longest common
   prefix, and the region's smallest id as a hub. A region of more than ``BIG`` classes is
   cut into sub-regions by its further places before it is sorted, and a sub-region that
   still is larger by its ids, so no task sorts an unbounded group; counts and hubs come
   from an aggregate.
3. *Confirmation.* Candidates are held against each other on their full shingle sets,
   in two rounds: first each class with the ``FIRST`` partners that most trees name, then
   all that is left between different components. A pair inside one component
   can't change the result and isn't computed. Texts travel to their partner in the
   order of the partner's id and are compared as a stream, so one set is in memory;
   a partner of many is copied to several places, ``MEMBERS`` a place.
4. Links are joined to connected components by aggregates and joins; later links are
   joined as edges between the components that were there before.
5. *Open regions.* A region larger than ``SMALL`` whose members are then still in more
   than one component is open. All links between members of open regions are found by
   a prefix-filtered join: each set is ordered by how rare its shingles are, and two
   linked sets share a shingle among the first of both (by the length and positional
   bounds of the public prefix-filter joins). The join is cut in a grid for a
   shingle of many sets, and leaves out pairs inside a shingle's largest component.
   What it finds is confirmed and joined like the forest's candidates.

Two texts at the threshold share a region in no tree with probability (1 - 0.75**4)**32 =
5e-6, fewer above it; every link between two that share a region is found.

Broadcast: a bitmap of fixed size that preselects the texts that take part in a round,
and a table of fixed size of how common shingles are; it orders them and decides the cost,
not the result.

Defined results: null, empty or blank texts have the empty set, are linked with
nothing and kept; rows with a null doc_id are not linked, their component is null and
they are kept; rows that share a doc_id are one document (linked if any of its texts is);
ties go to the smaller doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.llm.common import (WordHashes, batches_of, doc_bytes, gram_hashes, mixed, released, rows_of, small_batches,
                                   stored, table)
from shelfscope.llm.graph import components

SHINGLE, PERCENT = 5, 75
K, TREES, DEPTH = 128, 32, 4
SMALL, BIG = 8, 2_000
#: Partners of a class in the first round.
FIRST = 2
#: Members of a region that are looked up in one place, in the mean.
PLACE = 500
#: Members of a hub that are compared in one place, in the mean.
MEMBERS = 64
BITMAP_BITS = 22
#: Slots of the table of how common shingles are, and texts that a task counts before it
#: hands on what it has; slots that come to the driver as one row.
SKETCH_BITS, SKETCH_TEXTS, SKETCH_RUN = 22, 1 << 17, 1 << 10
#: Sets of one shingle on each side of one place of the prefix join.
SIDE = 1000
_rng = np.random.default_rng(10)
_MULTIPLIERS = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = hashes.of(text.lower().split())
    return np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The ``K`` minimum hashes of a non-empty set."""
    low = np.full(K, np.uint32(0xFFFFFFFF))
    for i in range(0, len(s), 2048):
        part = (s[i:i + 2048, None] * _MULTIPLIERS[None, :]) >> np.uint64(32)
        np.minimum(low, part.min(0).astype(np.uint32), out=low)
    return low


def sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set, signature (empty for the empty set)."""
    def make(batches):
        hashes = WordHashes()

        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                s = shingle_set(text, hashes, k)
                yield (doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()),
                       signature(s).tobytes() if len(s) and doc_id is not None else b"")

        yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                                                 ("fp", pa.binary()), ("sig", pa.binary())]))

    return doc_bytes(docs).mapInArrow(released(make), "doc_id long, n_shingles long, fp binary, sig binary")


def forest(classes: DataFrame) -> DataFrame:
    """(region, rest, id) of each class in each tree: the hash of the first ``DEPTH``
    places of the tree's order, and the next ``DEPTH`` places as one sortable number."""
    def expand(batches):
        tree = mixed(np.arange(TREES, dtype=np.uint64) + np.uint64(1))
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH).astype(np.uint64)
            region = np.broadcast_to(tree, sig.shape[:2]).copy()
            for j in range(DEPTH):
                region = mixed(region * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, j])
            after = np.roll(sig, -1, axis=1)
            rest = np.zeros(sig.shape[:2], np.uint64)
            for j in range(DEPTH):
                rest = rest << np.uint64(16) | mixed(after[:, :, j]) >> np.uint64(48)
            ids = np.repeat(np.array(b.column("id").to_pylist(), np.int64), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(region.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)),
                                              pa.array(ids)], names=["region", "rest", "id"])

    return classes.select("id", "sig").mapInArrow(released(expand), "region long, rest long, id long")


def regions(trees: DataFrame) -> DataFrame:
    """(region, rest, id, n, hub) of the regions of more than one class. The sizes are a table
    of their own, so that a region that holds many rows is split when it is joined to them."""
    size = stored(trees.groupBy("region").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1"), "lsh-sizes")
    return trees.join(size, "region")


def candidates(shared: DataFrame) -> DataFrame:
    """(a, b, votes): candidate pairs a < b and the number of trees that name them."""
    cut = F.when(F.col("n") <= BIG, F.lit(0)).otherwise(
        F.pmod(F.xxhash64(F.shiftrightunsigned("rest", 32)), F.ceil(F.col("n") / BIG)))
    shared = shared.withColumn("cut", cut).withColumn("part", F.lit(0).cast("long"))
    crowded = stored(shared.where(F.col("n") > BIG).groupBy("region", "cut").agg(F.ceil(F.count("*") / BIG).alias("parts"))
                     .where("parts > 1"), "lsh-crowded")
    if not crowded.isEmpty():
        shared = shared.join(crowded, ["region", "cut"], "left").withColumn(
            "part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)))
        # else the window would go by the join's partitions, which hold a sub-region as a whole
        shared = shared.repartition("region", "cut", "part")
    w = W.partitionBy("region", "cut", "part").orderBy("rest", "id")
    near = [F.lead("id", j).over(w).alias(f"p{j}") for j in range(1, SMALL)]
    return (shared.select("id", "n", "hub", *near)
            .select("id", F.explode(F.when(F.col("n") <= SMALL, F.array(*(f"p{j}" for j in range(1, SMALL))))
                                    .otherwise(F.array("p1", "hub"))).alias("p"))
            .where("p <> id")
            .select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
            .groupBy("a", "b").agg(F.count("*").alias("votes")))


def _bits_of(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap of fixed size over hashed ids, built by one aggregate."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS))
    got = (ids.select(at.alias("at"))
           .selectExpr("cast(shiftright(at, 5) as int) w", "shiftleft(1L, cast(at & 31L as int)) bit")
           .groupBy("w").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    out[got["w"].to_numpy()] = got["bit"].to_numpy().astype(np.uint32)
    return out


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the texts with one of the ids, and of few others."""
    sent = docs.sparkSession.sparkContext.broadcast(_bits_of(ids.select("id").distinct(), "id"))

    def preselect(batches):
        bits = sent.value
        for b in batches:
            at = np.array(b.column("at").to_pylist(), np.int64)
            keep = (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 if len(at) else at
            yield b.filter(pa.array(keep.astype(bool))).select(["doc_id", "text"])

    return (doc_bytes(docs, F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << BITMAP_BITS)).alias("at"))
            .where("doc_id is not null").mapInArrow(released(preselect), "doc_id long, text binary"))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Those (hub, member) pairs whose full shingle sets overlap enough, as (a, b)."""
    # a hub of many members is asked for in several places, each with its own copy of the hub's text
    size = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).alias("places"))
    pairs = pairs.join(size, "hub").select("hub", "member", F.pmod(F.xxhash64("member"), F.col("places")).alias("place"))
    asked = pairs.select("hub", "place", F.col("member").alias("id"), F.lit(1).alias("part")).union(
        pairs.select("hub", "place", F.col("hub").alias("id"), F.lit(0).alias("part")).distinct())
    texts = _texts_of(asked, docs)
    # The order part 0 (the hub's own texts) before part 1 (its members) makes a stream.
    sent_out = (asked.join(texts, F.col("id") == F.col("doc_id")).select("hub", "place", "part", "id", "text")
                .repartition("hub", "place").sortWithinPartitions("hub", "place", "part"))

    def compare(batches):
        hashes = WordHashes()

        def rows():
            at, own = None, []
            for h, place, part, i, text in rows_of(batches, "hub", "place", "part", "id", "text"):
                s = shingle_set(text, hashes, k)
                if (h, place) != at:
                    at, own = (h, place), []
                if part == 0:
                    own.append(s)
                    continue
                for o in own:
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    if 100 * both >= percent * (len(o) + len(s) - both) and both:
                        yield min(h, i), max(h, i)
                        break

        yield from batches_of(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 10_000)

    return sent_out.mapInArrow(released(compare), "a long, b long").distinct()


def named(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs with the components of their ends as ``ca``, ``cb``; an end without one is its own."""
    name = found.select(F.col("id").alias("__id"), F.col("component").alias("__c"))
    for end, comp in (("a", "ca"), ("b", "cb")):
        pairs = pairs.join(name, F.col(end) == F.col("__id"), "left").withColumn(
            comp, F.coalesce("__c", end)).drop("__id", "__c")
    return pairs


def contracted(found: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components ``found`` once more ``a``, ``b`` edges between their names join them."""
    step = components(edges)
    if found is None:
        return step
    name = step.select(F.col("id").alias("__id"), F.col("component").alias("__c"))
    moved = (found.join(name, F.col("component") == F.col("__id"), "left")
             .select("id", F.coalesce("__c", "component").alias("component")))
    return stored(moved.union(step.join(found.select("id"), "id", "left_anti")), "lsh-components")


def joined(pairs: DataFrame, found: DataFrame | None, docs: DataFrame, percent: int, k: int) -> DataFrame | None:
    """Components once the candidate pairs are confirmed, in rounds."""
    left = stored(named(pairs, found) if found is not None else pairs.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")),
                  "lsh-pairs")
    first = True
    while not left.isEmpty():
        if first:
            ends = left.select(F.col("a").alias("x"), F.col("b").alias("p"), "votes").union(left.select("b", "a", "votes"))
            order = W.partitionBy("x").orderBy(F.desc("votes"), "p")
            best = ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST).select("x", "p")
            # of two that name each other, the smaller is the hub
            chosen = (best.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b"), F.col("p").alias("hub"))
                      .groupBy("a", "b").agg(F.min("hub").alias("hub")))
        else:
            chosen = left.select("a", "b", F.col("a").alias("hub"))
        chosen = stored(chosen, "lsh-chosen")
        asked = chosen.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))
        new = stored(confirm(asked, docs, percent, k), "lsh-links")
        edges = new.join(left, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        found = contracted(found, edges)
        if not first:
            break
        rest = left.join(chosen.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "votes")
        left = stored(named(rest, found).where("ca <> cb"), "lsh-pairs")
        first = False
    return found


def open_members(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(id, c) of the members of regions above ``SMALL`` that hold several components."""
    name = found.select(F.col("id").alias("__id"), "component")
    places = F.ceil(F.col("n") / PLACE)
    large = (shared.where(F.col("n") > SMALL).select("region", "id", "n", F.pmod(F.xxhash64("id"), places).alias("place"))
             .join(name, F.col("id") == F.col("__id"), "left")
             .select("region", "id", "n", "place", F.coalesce("component", "id").alias("c")))
    several = (large.groupBy("region").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("n").alias("n")).where("lo <> hi")
               .select("region", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place")))
    return large.join(several, ["region", "place"], "left_semi").select("id", "c").distinct()


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of a slot are in all the texts, on a log scale. The counts of
    a run of slots are added up in one task, and the run comes to the driver as one row of
    bytes: a row a slot would be up to ``2**SKETCH_BITS`` objects there."""
    most = SKETCH_TEXTS

    def count(batches):
        hashes, slots = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)

        def counted():
            at = np.flatnonzero(slots)
            for i in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000].astype(np.int32)),
                                                  pa.array(slots[at[i:i + 100_000]])], names=["slot", "n"])
            slots[at] = 0

        for done, (_, text) in enumerate(rows_of(batches, "doc_id", "text")):
            if done and done % most == 0:
                yield from counted()
            np.add.at(slots, (shingle_set(text, hashes, k) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        yield from counted()

    def levels(batches):
        slots = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            np.add.at(slots, b.column("slot").to_numpy(), b.column("n").to_numpy())
        runs = slots.reshape(-1, SKETCH_RUN)

        def rows():
            for i in np.flatnonzero((runs > 1).any(1)).tolist():
                yield i, np.minimum(255, 4 * np.log2(np.maximum(runs[i], 1))).astype(np.uint8).tobytes()

        yield from batches_of(rows(), pa.schema([("run", pa.int32()), ("level", pa.binary())]))

    out = np.zeros(((1 << SKETCH_BITS) // SKETCH_RUN, SKETCH_RUN), np.uint8)
    for r in (texts.mapInArrow(released(count), "slot int, n long").repartition(F.expr(f"slot div {SKETCH_RUN}"))
              .mapInArrow(released(levels), "run int, level binary").collect()):
        out[r["run"]] = np.frombuffer(r["level"], np.uint8)
    return out.ravel()


def prefixes(members: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """(token, id, c, n, p, short): the shingles at the rare end of each member's sets,
    with the set's size and the place. ``short``: also within the bound for a partner that
    is no smaller; the others matter for a smaller partner only."""
    # read twice; stored, so that no task has two Python workers, which would live on beside each other
    texts = stored(_texts_of(members, docs), "lsh-texts")
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, k))

    def cut(batches):
        hashes, common = WordHashes(), sent.value
        for b in batches:
            parts = []
            for i, c, text in rows_of([b], "id", "c", "text"):
                s = shingle_set(text, hashes, k)
                often = common[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                # ties in the order of the hash, so all sets are in one order
                order = np.lexsort((s, often))[:len(s) + (-percent * len(s) // 100) + 1]
                p = np.arange(len(order))
                # a shingle of one set only can't be shared
                keep = often[order] > 0
                parts.append((s[order][keep].view(np.int64), np.full(keep.sum(), i), np.full(keep.sum(), c),
                              np.full(keep.sum(), len(s)), p[keep],
                              ((100 + percent) * (len(s) - p) >= 2 * percent * len(s))[keep]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)],
                                                 names=["token", "id", "c", "n", "p", "short"])

    return (members.join(texts, F.col("id") == F.col("doc_id")).select("id", "c", "text")
            .mapInArrow(released(cut), "token long, id long, c long, n long, p long, short boolean"))


def open_pairs(members: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b, votes): pairs a < b of different components that share a shingle at the rare
    ends of their sets, and the number of such shingles."""
    rare = stored(prefixes(members, docs, percent, k), "lsh-prefixes")
    # a table of its own, so that a shingle of many sets is split when its sets are joined to it
    size = (rare.groupBy("token", "c").agg(F.count("*").alias("n_c"), F.count_if("short").alias("s_c"))
            .groupBy("token").agg(F.count("*").alias("components"), F.sum("n_c").alias("n_all"), F.sum("s_c").alias("s_all"),
                                  F.max(F.struct("n_c", "s_c", "c")).alias("most"))
            .where("components > 1 and s_all > 0")
            .select("token", "n_all", "s_all", F.col("most.c").alias("major"), F.col("most.n_c").alias("n_major"),
                    F.col("most.s_c").alias("s_major")))
    rare = stored(rare.join(stored(size, "lsh-tokens"), "token"), "lsh-shared")
    own, other = F.col("c") == F.col("major"), F.col("c") != F.col("major")

    def pairs(x: DataFrame, y: DataFrame, n_x: str, n_y: str) -> DataFrame:
        """Smaller sets x with larger ones y by shingle, in a grid of places."""
        rows, columns = F.ceil(F.expr(n_x) / SIDE), F.ceil(F.expr(n_y) / SIDE)
        x = (x.where(rows * columns > 0)
             .select("token", F.pmod(F.xxhash64("id"), rows).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), columns - 1)).alias("j"),
                     F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("p").alias("px")))
        y = (y.where(rows * columns > 0)
             .select("token", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("i"), F.pmod(F.xxhash64("id"), columns).alias("j"),
                     F.col("id").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("p").alias("py")))
        bound = (100 + percent) * F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= percent * (F.col("nx") + F.col("ny"))
        x, y = x.alias("l"), y.alias("r")
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("token", "i", "j")]
        return (x.join(y, [*on, F.col("cx") != F.col("cy"), F.col("nx") <= F.col("ny"), bound])
                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("l.token").alias("token")).distinct())

    short = rare.where("short")
    both = pairs(short.where(other), rare, "s_all - s_major", "n_all").union(
        pairs(short.where(own), rare.where(other), "s_major", "n_all - n_major"))
    return both.groupBy("a", "b").agg(F.count("*").alias("votes"))


def linked(classes: DataFrame, docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(id, component) of the classes that are linked with another one."""
    shared = stored(regions(forest(classes)), "lsh-regions")
    found = joined(candidates(shared), None, docs, percent, k)
    if found is None:
        return classes.select("id", F.col("id").alias("component")).limit(0)
    members = stored(open_members(shared, found), "lsh-open")
    if not members.isEmpty():
        found = joined(open_pairs(members, docs, percent, k), found, docs, percent, k)
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """One row for each document: n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    all_sets = stored(sets(docs, k), "lsh-sets")
    classes = stored(all_sets.where("n_shingles > 0 and doc_id is not null").groupBy("fp")
                     .agg(F.min(F.struct("doc_id", "sig")).alias("m"))
                     .select("fp", F.col("m.doc_id").alias("id"), F.col("m.sig").alias("sig")), "lsh-classes")
    found = linked(classes, docs, percent, k)
    # rows that share an id are one document, so the classes of an id with several sets are one component
    several = (all_sets.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id")
               .agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id"))
    ends = stored(all_sets.where("n_shingles > 0").join(several, "doc_id").select("doc_id", "fp").distinct()
                  .join(classes.select("fp", "id"), "fp").select("doc_id", "id"), "lsh-shared-ids")
    if not ends.isEmpty():
        least = ends.groupBy("doc_id").agg(F.min("id").alias("least"))
        same = ends.join(least, "doc_id").select(F.col("least").alias("a"), F.col("id").alias("b"))
        found = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(same))
    of_set = (classes.select("fp", "id").join(found, "id", "left")
              .select(F.col("fp").alias("__fp"), F.coalesce("component", "id").alias("__c")))
    out = (all_sets.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("fp")).alias("fp"))
           .join(of_set, F.col("fp") == F.col("__fp"), "left")
           .select("doc_id", "n_shingles", F.coalesce("__c", "doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM doc_words
  UNION
  SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM doc_words d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, n
"""
