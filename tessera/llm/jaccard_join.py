"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance d is a metric, so distances to pivots bound distances between
documents. The join is exact:

1. Documents of equal sets become one class, led by its smallest id.
2. *Pivots* are elected by the classes that share one of their least shingle
   hashes (near copies share most of these): the smallest id of each hash.
3. Voronoi cells: of the pivots that its least hashes elect, and that size and
   parity bounds leave, every class finds the exact distances and takes the
   nearest; within the radius r = 1 - threshold it is linked to the pivot and
   joins its cell. Other classes are cells of their own, of radius 0: nearly all
   documents are at distance 1 from nearly all pivots, so no choice of pivots
   would part them further.
4. Cells that are not yet connected can only be linked if members share one of
   their first shingles in a global order from rare to frequent. Of those that
   do, the pivots p and q are compared: if d(p, q) > r + radius(p) + radius(q), no
   members are linked (triangle inequality).
5. Linked pivots connect their whole cells. The pairs of cells that are still
   unconnected are joined in the region of the larger cell's pivot
   p: a member y of the smaller one is replicated into it, once, if it lies in the
   window d(y, p) <= r + radius(p), and meets the members x with
   |d(x, p) - d(y, p)| <= r.
6. A region of more than ``REGION`` rows is joined recursively: its first row is
   the pivot of sub-regions, rings of width r about it; the rows from outside are
   replicated into the neighbouring rings, until the regions are small or get no
   smaller. Pairs that are left in a region are verified exactly.

Only components are asked for, so pairs that are connected already are never
built; a group of thousands of near copies costs a pair for each member.

Defined cases: null and empty texts have empty sets and are linked with
nothing; rows that share an id are one node (a link of any of their texts is its
link), each with its own n_shingles; rows with a null id get a null component;
long texts are handled whole; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._rarity import levels, ordered_key
from ._spark import release, small_enough, table, written

SHINGLE = 4
#: Links as 100 * intersection >= PERCENT * union.
PERCENT = 85
#: 64-bit words of the parity sketch.
PARITY = 16
#: Least shingle hashes by which classes elect pivots; more find no other links.
LEADING = 8
#: Sets that one task compares with one set.
PARTNERS = 500
#: Rows of a region that is joined without dividing it further.
REGION = 5000
#: A region is divided further as long as its largest part holds at most this share of its rows.
SHRINKS = 0.9


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's word shingles, with repeats, and their rows."""
    data = B.ASCII_LOWER[data]
    start, end, row = B.spans(data, offsets, B.IS_SPACE)
    return B.ngram_hash(B.span_hash(B.prefix_hash(data), start, end), row, size, len(offsets) - 1)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, rarity: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2 (digests of the set), parity sketch, prefix and least hashes of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for first, last, data, offsets in B.slices(batch["text"]):
                rows = last - first
                values, at = B.by_row(*shingles_of(data, offsets, size), rows)
                n = np.diff(at)
                row = np.repeat(np.arange(rows), n)
                digests = np.zeros((2, rows), np.uint64)
                parity = np.zeros((rows, PARITY), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    starts = at[:-1][some]
                    digests[0, some] = np.add.reduceat(values, starts)
                    digests[1, some] = np.add.reduceat(B.mix(values + np.uint64(1)), starts)
                    bit = np.uint64(1) << ((values >> np.uint64(8)) & np.uint64(63))
                    word = (values & np.uint64(PARITY - 1)).astype(np.int64)
                    for k in range(PARITY):
                        parity[some, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), starts)
                ranked = np.argsort(ordered_key(values, order))
                ranked = ranked[np.argsort(row[ranked].astype(np.uint16), kind="stable")]
                take = np.where(n > 0, prefix_length(n, percent), 0)
                cut = np.concatenate(([0], np.cumsum(take)))
                pick = ranked[np.repeat(at[:-1] - cut[:-1], take) + np.arange(cut[-1])]
                prefix = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values[pick].view(np.int64)))
                cut = np.concatenate(([0], np.cumsum(np.minimum(n, LEADING))))
                pick = np.repeat(at[:-1] - cut[:-1], np.diff(cut)) + np.arange(cut[-1])
                least = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values[pick].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, rows), pa.array(n.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digests),
                     *(pa.array(np.ascontiguousarray(parity[:, k]).view(np.int64)) for k in range(PARITY)), prefix, least],
                    ["doc_id", "n", "d1", "d2", *(f"p{k}" for k in range(PARITY)), "prefix", "least"],
                )

    words = ", ".join(f"p{k} long" for k in range(PARITY))
    return docs.mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, {words}, prefix array<long>, least array<long>")


def least_distance(a: str, b: str) -> Column:
    """A lower bound of the Jaccard distance from the sizes and parity sketches of ``a`` and ``b``.

    The sketches differ in no more bits than the sets in shingles, and
    d = D / ((na + nb + D) / 2) for a symmetric difference of size D.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = F.lit(0)
    for k in range(PARITY):
        bits = bits + F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}")))
    apart = F.greatest(bits, F.abs(na - nb))
    return 2 * apart / (na + nb + apart)


def distances(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with their exact distance and whether they are linked.

    The texts of each a's partners are sent to it, as they compress far better
    than their sets of hashes; an a with many partners is replicated to one task
    for every ``PARTNERS`` of them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    partner = pairs.select("a", "b").join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(True).alias("partner"), F.col("b").alias("doc_id"))
    pivot = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("partner"), F.col("a").alias("doc_id"))
    wanted = written(partner.union(pivot).groupBy("doc_id").agg(F.collect_list(F.struct("a", "part", "partner")).alias("to")), "wanted")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = np.empty(0, np.uint64), None
        for batch in batches:
            keep, d, linked = [], [], []
            names, parts_, is_partner = (batch[c].to_pylist() for c in ("a", "part", "partner"))
            for first, last, data, offsets in B.slices(batch["body"]):
                values, at = B.by_row(*shingles_of(data, offsets, size), last - first)
                for i in range(first, last):
                    x = values[at[i - first] : at[i - first + 1]]
                    if not is_partner[i]:
                        own, key = x.copy(), (names[i], parts_[i])
                    elif key == (names[i], parts_[i]):
                        both = np.intersect1d(own, x, assume_unique=True).size
                        union = len(own) + len(x) - both
                        keep.append(i)
                        d.append(1 - both / union if union else 1.0)
                        linked.append(union > 0 and 100 * both >= percent * union)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(take), batch["b"].take(take), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "d", "linked"])

    sent = docs.join(small_enough(wanted), "doc_id").select(F.explode("to").alias("to"), F.col("doc_id").alias("b"), F.col("text").cast("binary").alias("body")).select("to.*", "b", "body")
    met = sent.repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "partner")
    out = written(met.mapInArrow(measure, f"a {kind}, b {kind}, d double, linked boolean"), "distances")
    release(docs.sparkSession)  # the texts that were sent
    return out


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of every node of ``edges`` (a, b): the smallest id that it reaches.

    Large-star and small-star steps alternate until nothing changes; each is a
    minimum by node and a join, so a hub is never one task's list.
    """
    edges = written(edges.where("a != b").select("a", "b").distinct(), "edges")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    last = state(edges)
    while last[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = written(small.where("a != b").distinct(), "edges")
        now = state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))


def named(df: DataFrame, doc: str, as_: str, facts: DataFrame) -> DataFrame:
    """Add the facts of the document in column ``doc`` as a struct column."""
    return df.join(facts.select(F.col("doc_id").alias(doc), F.struct(*[c for c in facts.columns if c != "doc_id"]).alias(as_)), doc)


def links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents with their n_shingles and class, links between classes that connect all linked ones)."""
    r = 1 - percent / 100
    slim = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    rarity = levels(slim, lambda data, offsets: shingles_of(data, offsets, size)[0])
    signed = written(signatures(slim, rarity, size, percent), "signatures")
    slim = slim.where("doc_id is not null and text is not null")

    # 1. classes
    classes = signed.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("class"))
    leads = written(signed.where("n > 0").join(classes.select(F.col("class").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]), "leads")
    parity = [f"p{k}" for k in range(PARITY)]
    facts = leads.select("doc_id", "n", *parity)

    # 2. pivots, elected by the classes that share one of their least shingle hashes
    leading = leads.select("doc_id", F.explode("least").alias("shingle"))
    elected = leading.groupBy("shingle").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("shingle", "pivot")
    votes = leading.join(elected, "shingle").where("doc_id != pivot").select("doc_id", "pivot").distinct()

    # 3. Voronoi cells
    votes = named(named(votes, "doc_id", "x", facts), "pivot", "p", facts).where(least_distance("x", "p") <= r + 1e-9)
    assigned = distances(slim, votes.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), size, percent)
    found = assigned.where("linked").select(F.col("b").alias("a"), F.col("a").alias("b"))
    nearest = assigned.where("linked").groupBy("b").agg(F.min(F.struct("d", "a")).alias("p")).select(F.col("b").alias("a"), F.col("p.a").alias("b"), "p.d")
    # a class whose pivot has joined a cell itself stays a cell of its own
    members = written(nearest.join(nearest.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("a").alias("doc_id"), F.col("b").alias("cell"), "d"), "members")
    cells = members.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("members"))

    # 4. cells that members with a common first shingle bring together
    linked_to = components(found)
    celled = leads.select("doc_id", "prefix").join(members, "doc_id", "left").join(linked_to, "doc_id", "left")
    celled = written(celled.select(F.coalesce("cell", "doc_id").alias("cell"), F.coalesce("component", "doc_id").alias("component"), "prefix"), "celled")
    each = celled.select("cell", "component", F.explode("prefix").alias("shingle"))
    apart = each.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("shingle")
    placed = each.join(small_enough(written(apart, "apart")), "shingle").distinct().join(cells, "cell", "left")
    placed = placed.select("shingle", "component", "cell", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("members", F.lit(0)).alias("members"))
    placed = written(named(placed, "cell", "s", facts).select("shingle", "component", F.struct("cell", "radius", "members", "s.*").alias("s")), "placed")
    release(docs.sparkSession)  # the shingles that were exploded
    x, y = placed.select("shingle", F.col("component").alias("cx"), F.col("s").alias("x")), placed.select("shingle", F.col("component").alias("cy"), F.col("s").alias("y"))
    near = least_distance("x", "y") <= r + F.col("x.radius") + F.col("y.radius") + 1e-9
    larger = F.struct("x.members", "x.cell") > F.struct("y.members", "y.cell")
    meet = x.join(y, (x["shingle"] == y["shingle"]) & larger & (F.col("cx") != F.col("cy")) & near)
    meet = written(meet.select(F.col("x.cell").alias("a"), F.col("y.cell").alias("b"), F.col("x.radius").alias("ra"), F.col("y.radius").alias("rb")).distinct(), "meet")
    between = written(meet.join(distances(slim, meet, size, percent), ["a", "b"]), "between")
    found = written(found.union(between.where("linked").select("a", "b")), "found")

    # 5. pairs of cells with members that may still be linked, in the region of the larger one
    beyond = between.where(~F.col("linked") & (F.col("d") <= r + F.col("ra") + F.col("rb") + 1e-9) & (F.col("ra") + F.col("rb") > 0))
    # whole cells are connected by now: those that other cells have brought together need no region
    linked_to = written(components(found), "components")
    of = {e: linked_to.select(F.col("doc_id").alias(e), F.col("component").alias(f"c{e}")) for e in "ab"}
    beyond = beyond.join(of["a"], "a", "left").join(of["b"], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    beyond = written(beyond.select("a", "b", "ra", F.col("d").alias("between")), "beyond")
    if beyond.isEmpty():
        return signed, found
    owners = named(beyond, "a", "p", facts)
    pivots = beyond.where(F.col("between") <= r + F.col("ra") + 1e-9).select("a", F.col("b").alias("doc_id"), F.col("between").alias("d"))
    replicas = owners.join(members.withColumnRenamed("cell", "b"), "b")
    replicas = named(replicas, "doc_id", "y", facts).where((F.col("d") >= F.col("between") - r - F.col("ra") - 1e-9) & (least_distance("y", "p") <= r + F.col("ra") + 1e-9))
    measured = distances(slim, replicas.select("a", F.col("doc_id").alias("b")).distinct(), size, percent)
    found = found.union(measured.where("linked").select("a", "b"))
    outside = pivots.union(measured.select("a", F.col("b").alias("doc_id"), "d")).distinct()
    own = members.withColumnRenamed("cell", "a").join(beyond.select("a").distinct(), "a")
    region = own.select("a", "doc_id", "d", F.lit(True).alias("inside")).union(outside.select("a", "doc_id", "d", F.lit(False)))
    region = region.join(linked_to, "doc_id", "left").select("doc_id", F.xxhash64("a").alias("region"), "d", "inside", F.coalesce("component", "doc_id").alias("component"))
    return signed, found.union(joined_regions(slim, written(region, "region"), facts, size, percent))


def joined_regions(docs: DataFrame, region: DataFrame, facts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between rows inside and outside of each region (region, doc_id, d to its pivot, inside, component)."""
    r = 1 - percent / 100
    done = []
    while True:
        counted = region.groupBy("region").agg(F.count("*").alias("c"), F.min("doc_id").alias("pivot"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        counted = written(counted.where("lo < hi").select("region", "c", "pivot"), "regions")
        region = region.join(small_enough(counted.select("region")), "region", "left_semi")
        large = counted.where(F.col("c") > REGION)
        if large.isEmpty():
            done.append(region)
            break
        done.append(region.join(small_enough(large), "region", "left_anti"))
        held = region.join(small_enough(large), "region")
        d = distances(docs, held.where("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), size, percent)
        held = held.drop("d").join(d.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), "d"), ["pivot", "doc_id"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
        ring = F.floor(F.col("d") / r)
        rings = F.when(F.col("inside"), F.array(ring)).otherwise(F.array(ring - 1, ring, ring + 1))
        parts = held.withColumn("ring", F.explode(rings)).withColumn("part", F.xxhash64("region", "ring"))
        # parts with rows of both sides stay; a region that has shrunk too little is joined as it is
        both = parts.groupBy("region", "part").agg(F.max("inside").alias("i"), F.min("inside").alias("o"), F.count("*").alias("n")).where("i and not o")
        both = written(both.select("region", "part", "n"), "parts")
        better = both.groupBy("region").agg(F.max("n").alias("most")).join(large, "region").where(F.col("most") <= SHRINKS * F.col("c")).select("region")
        better = written(better, "better")
        done.append(held.join(small_enough(better.join(both.select("region").distinct(), "region")), "region", "left_anti").join(both.select("region").distinct(), "region", "left_semi").select(*region.columns))
        region = parts.join(small_enough(both.drop("n")), ["region", "part"], "left_semi").join(small_enough(better), "region", "left_semi")
        region = written(region.select("doc_id", F.col("part").alias("region"), "d", "inside", "component"), "region")
    every = done[0]
    for other in done[1:]:
        every = every.union(other)
    side = {k: named(every.where("inside" if k == "x" else "not inside").select(F.col("doc_id").alias(k), "region", F.col("component").alias(f"c{k}"), F.col("d").alias(f"d{k}")), k, f"f{k}", facts) for k in "xy"}
    # size and parity bounds are part of the join, so only pairs that they leave are ever moved
    window = side["x"].join(side["y"], "region").where((F.abs(F.col("dx") - F.col("dy")) <= r + 1e-9) & (F.col("cx") != F.col("cy")) & (least_distance("fx", "fy") <= r + 1e-9))
    window = written(window.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "window")
    return distances(docs, window, size, percent).where("linked").select("a", "b")


def cluster(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    signed, edges = links(docs, size, percent)
    classes = signed.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("class"))
    of_class = classes.join(components(edges).withColumnRenamed("doc_id", "class"), "class", "left").select("d1", "d2", F.coalesce("component", "class").alias("component"))
    some = signed.where("n > 0").join(of_class, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return some.union(signed.where("n = 0").select("doc_id", "n", "doc_id"))


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the smallest id; columns unchanged. Of rows that share an id all stay."""
    later = cluster(docs, size, percent).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(small_enough(written(later, "later")), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


#: DuckDB SQL of the query's rows, for small tables: it pairs all documents that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS k, len(w) AS m FROM w),
g AS (SELECT doc_id, k, m, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
e AS (SELECT DISTINCT doc_id, md5_number(g) AS g FROM g WHERE k <= greatest(m - 4, 0)),
n AS (SELECT doc_id, cast(count(g) AS bigint) AS n FROM w LEFT JOIN e USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY ALL
"""
