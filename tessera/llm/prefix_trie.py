"""The prefix trie of conversations: what conversations that begin alike share.

A node is a distinct sequence of the first d turns (role, text) of some
conversation; its members are the conversations that begin with it, and the
smallest of them owns it. Along one conversation the smallest member never gets
smaller, so what it owns is a chain: from its first owned depth to its end.

Method:

1. Turns are numbered and given prefix digests: the digest of a prefix is the
   XOR of 128-bit hashes of (depth, turn), so it is a running sum that blocks of
   1,024 turns contribute to apart. No conversation is ever one row or one task.
2. Minima of the members by (depth, digest) are the nodes, aggregated map-side.
3. Each conversation's first owned depth is found by binary search: every round
   joins the middle depths of all unsettled conversations to the minima. The
   join is on (owner, depth), which is unique on both sides, so that a first
   turn that a third of all conversations share is no hot key.
4. The node above a chain is looked up once by digest: nodes with over one in
   ``HOT`` of all prefixes (at most ``HOT`` of them) are broadcast, others joined.
5. Chains are aggregated bottom-up: chains without open chains below send
   their sums to the chain above, pre-aggregated; rounds are as many as chains
   nest. Running sums from the end of each chain then give its nodes' sums.

Every step is a written table in the shared folder, so lost executors cost their
tasks only. The digits of one node's ending members are hashed in order, which
SHA-256 demands of one task: they come in blocks of up to 8,192 ids, as a stream.

Defined cases: null roles and texts are empty; rows without a conv_id belong to
no conversation; turns are ordered by number (null first), then role, then text,
so repeated rows are turns of their own; long texts are read whole but leave the
plan once numbered; an empty table has no nodes; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._crc_sql import CRC_SQL, crc_sql
from ._spark import WORD, crc, table, written

#: Turns of one block, as a power of two; ids of one block.
TURN_BITS, ID_BITS = 10, 13
#: Nodes with over one in so many of all prefixes are broadcast: at most so many.
HOT = 10_000
#: The block of null turns comes first.
_NULLS = -(1 << 62)

NODE = ["owner", "depth"]


def block(position: Column, bits: int) -> Column:
    return F.shiftright(position, bits)


def before_blocks(blocks: DataFrame, key: str, order: Column, values: list[str], combine=F.sum) -> DataFrame:
    """``blocks`` (key, block, values) with the combined values of the earlier blocks of the key, where it has any."""
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [combine(v).over(earlier).alias(f"{v}_before") for v in values]
    return blocks.select(key, "block", *sums).where(F.col(f"{values[0]}_before").isNotNull())


def running(df: DataFrame, key: str, position: str, values: list[str], combine=F.sum, backwards: bool = False) -> DataFrame:
    """``df`` with each value combined over all positions of its key up to its own; positions are cut in blocks, so no key is one task's."""
    df = df.withColumn("block", block(F.col(position), TURN_BITS))
    way = (lambda c: F.col(c).desc()) if backwards else F.col
    inside = Window.partitionBy(key, "block").orderBy(way(position)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = before_blocks(df.groupBy(key, "block").agg(*[combine(v).alias(v) for v in values]), key, way("block"), values, combine)
    local = df.select(*[c for c in df.columns if c not in values], *[combine(v).over(inside).alias(v) for v in values])
    both = (lambda v: F.col(v).bitwiseXOR(F.coalesce(f"{v}_before", F.lit(0).cast("long")))) if combine is F.bit_xor else (lambda v: F.col(v) + F.coalesce(f"{v}_before", F.lit(0).cast("long")))
    return local.join(earlier, [key, "block"], "left").select(*[c for c in df.columns if c not in (*values, "block")], *[both(v).alias(v) for v in values])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (1, 2, ... in the conversation), a and b (hashes of role and text) and words of every turn; written."""
    text = F.coalesce(conversations["text"].cast("string"), F.lit(""))
    role = F.coalesce(conversations["role"].cast("string"), F.lit(""))
    number = conversations["turn"].cast("long")
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), number.alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(block(number, TURN_BITS), F.lit(_NULLS)).alias("block"),
    ).where(F.col("conv_id").isNotNull())
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    local = rows.select(
        "conv_id", "block", at.cast("long").alias("k"), F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    out = local.join(before_blocks(counts, "conv_id", F.col("block"), ["n"]), ["conv_id", "block"], "left")
    return written(out.select("conv_id", (F.col("k") + F.coalesce("n_before", F.lit(0).cast("long"))).alias("k"), "a", "b", "words"), "turns")


def lengths(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("conv_id").agg(F.count("*").alias("size"))


def prefixes(rebuilt: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, depth, words and digest (a, b) of every prefix, the empty one included; written.

    ``rebuilt`` has conv_id, depth, a, b and words of every turn, ``sizes`` conv_id and size of every conversation.
    """
    own = rebuilt.select("conv_id", "depth", "words", F.xxhash64("depth", "a").alias("a"), F.xxhash64("depth", "b").alias("b"))
    zero = F.lit(0).cast("long")
    empty = sizes.select("conv_id", zero.alias("depth"), zero.alias("words"), zero.alias("a"), zero.alias("b"))
    return written(running(own, "conv_id", "depth", ["a", "b"], F.bit_xor).unionByName(empty), "prefixes")


def minima(prefix: DataFrame) -> DataFrame:
    """depth, digest, owner, n_convs and the last turn's words of every node; written."""
    return written(prefix.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "minima")


def first_owned(sizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, size and first: the least depth that the conversation owns, one more than its size if none.

    All conversations are searched at once, one batched join of their middle depths with the minima each round.
    """
    owned = nodes.select(F.col("owner").alias("conv_id"), F.col("depth").alias("middle"), F.lit(True).alias("owned"))
    state = sizes.select("conv_id", "size", F.lit(0).cast("long").alias("low"), (F.col("size") + 1).alias("high"))
    settled = []
    while True:
        probe = state.withColumn("middle", F.shiftright(F.col("low") + F.col("high"), 1)).join(owned, ["conv_id", "middle"], "left")
        state = written(probe.select(
            "conv_id", "size", F.when(F.col("owned"), F.col("low")).otherwise(F.col("middle") + 1).alias("low"), F.when(F.col("owned"), F.col("middle")).otherwise(F.col("high")).alias("high"),
        ), "search")
        settled.append(state.where("low = high"))
        state = state.where("low < high")
        if state.isEmpty():
            break
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("conv_id", "size", F.col("low").alias("first"))


def with_above(found: DataFrame, prefix: DataFrame, nodes: DataFrame) -> DataFrame:
    """``found`` with the owner of the node above the chain (null for the root's); written."""
    digests = found.withColumn("depth", F.col("first") - 1).join(prefix.drop("words"), ["conv_id", "depth"], "left")
    total = prefix.count()
    keyed = nodes.select("depth", "a", "b", F.col("owner").alias("above"), (F.col("n_convs") * HOT >= total).alias("hot"))
    hot = F.broadcast(keyed.where("hot").drop("hot"))
    digests = digests.join(hot, ["depth", "a", "b"], "left")
    rest = digests.where("above IS NULL AND a IS NOT NULL").drop("above").join(keyed.where("NOT hot").drop("hot"), ["depth", "a", "b"], "left")
    columns = ["conv_id", "size", "first", "above"]
    return written(digests.where("above IS NOT NULL OR a IS NULL").select(columns).unionByName(rest.select(columns)), "chains")


def chain_sums(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, first, above, saved and leaves of every chain with all below it; written parts.

    Rounds from the bottom: a chain whose lower chains are all done sends its sums to the chain above.
    """
    zero = F.lit(0).cast("long")
    saved = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = chains.where("first <= size")
    hung = own.groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("at")).agg(F.count("*").alias("n"))
    below = hung.groupBy("conv_id").agg(F.sum("n").alias("open"))
    at_end = hung.select("conv_id", F.col("at").alias("size"), F.lit(True).alias("grows"))
    state = written(
        own.join(saved, "conv_id").join(below, "conv_id", "left").join(at_end, ["conv_id", "size"], "left")
        .select("conv_id", "first", "above", "saved", F.when(F.col("grows"), zero).otherwise(zero + 1).alias("leaves"), F.coalesce("open", zero).alias("open")), "sums")
    done = []
    while True:
        done.append(state.where("open = 0").drop("open"))
        waiting = state.where("open > 0")
        if waiting.isEmpty():
            break
        sent = done[-1].where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("n"))
        state = written(waiting.join(sent, "conv_id", "left").select(
            "conv_id", "first", "above", (F.col("saved") + F.coalesce("s", zero)).alias("saved"), (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("open") - F.coalesce("n", zero)).alias("open")), "sums")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def id_digests(ends: DataFrame) -> DataFrame:
    """owner, depth and ends_sha256 (of the ids in ascending order, comma-joined) of the nodes where conversations end; ``ends`` has owner, depth, conv_id."""
    blocks = ends.groupBy(*NODE, block(F.col("conv_id"), ID_BITS).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    blocks = written(blocks, "ends")
    several = blocks.groupBy(*NODE).agg(F.count("*").alias("n")).where("n > 1").select(NODE)
    alone = blocks.join(several, NODE, "left_anti").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a node follow each other in order; only its hash state is held
        node = state = None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(batch["owner"].to_pylist(), batch["depth"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if (owner, depth) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(ids.encode())
            yield rows(out)
        if node is not None:
            yield rows([(*node, state.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        owner, depth, digest = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], [*NODE, "ends_sha256"])

    ordered = blocks.join(several, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return alone.unionByName(ordered.mapInArrow(run, "owner long, depth long, ends_sha256 string"))


def trie(rebuilt: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every node of the trie: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``rebuilt`` has conv_id, depth (from 1, without gaps), a, b (hashes of the turn) and words; ``sizes`` conv_id and size, 0 for conversations without turns.
    """
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    prefix = prefixes(rebuilt, sizes)
    nodes = minima(prefix)
    chains = with_above(first_owned(sizes, nodes), prefix, nodes)
    sums = chain_sums(chains, nodes)
    owns = F.col("first") <= F.col("size")
    ends = chains.select(F.when(owns, F.col("conv_id")).otherwise(F.col("above")).alias("owner"), F.col("size").alias("depth"), "conv_id")

    def facts(df: DataFrame, **given: Column) -> DataFrame:
        kinds = {"n_convs": none, "words": none, "above": none, "chain": zero, "last": zero, "hung": zero, "saved": zero, "leaves": zero, "ends_sha256": F.lit(None).cast("string")}
        return df.select(*NODE, *[given.get(name, default).alias(name) for name, default in kinds.items()])

    # what is known of a node by its owner and depth, brought together in one shuffle
    known = facts(nodes, n_convs=F.col("n_convs"), words=F.col("words"))
    known = known.unionByName(facts(chains.where(owns).select(F.col("conv_id").alias("owner"), F.col("first").alias("depth"), "above"), above=F.col("above"), chain=zero + 1))
    known = known.unionByName(facts(chains.where(owns).select(F.col("conv_id").alias("owner"), F.col("size").alias("depth")), last=zero + 1))
    known = known.unionByName(facts(
        sums.where("above IS NOT NULL").select(F.col("above").alias("owner"), (F.col("first") - 1).alias("depth"), "saved", "leaves"), hung=zero + 1, saved=F.col("saved"), leaves=F.col("leaves")))
    known = known.unionByName(facts(id_digests(ends), ends_sha256=F.col("ends_sha256")))
    by_node = known.groupBy(*NODE).agg(
        *[F.max(c).alias(c) for c in ("n_convs", "words", "above", "chain", "last", "ends_sha256")], *[F.sum(c).alias(c) for c in ("hung", "saved", "leaves")])
    n_children = F.col("hung") + 1 - F.col("last")
    each = written(by_node.select(
        *NODE, "n_convs", F.when(F.col("chain") == 1, F.col("above")).otherwise(F.col("owner")).alias("parent"), n_children.alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("leaves") + F.when(n_children == 0, 1).otherwise(0)).alias("leaves")), "nodes")
    return running(each, "owner", "depth", ["saved", "leaves"], backwards=True).select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def build(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    numbered = turns(conversations)
    return trie(numbered.withColumnRenamed("k", "depth"), lengths(numbered))


def rebuilt(numbered: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, sizes) of the query's conversations: the first h = crc32(c) mod ``most`` turns of conversation c - c mod ``family``, then c's own from turn h + 1 on.

    Turns are joined by (conversation, block), so that no long conversation is a hot key.
    """
    c = F.col("conv_id")
    own = lengths(numbered)
    base = own.select(c.alias("base"), F.col("size").alias("base_size"))
    h = F.pmod(crc(c), F.lit(most))
    # how many turns the base gives, and where c's own go
    shape = own.select(c, "size", (c - c % family).alias("base"), h.alias("h")).join(base, "base", "left").select(
        c, "base", "h", F.least("h", F.coalesce("base_size", F.lit(0).cast("long"))).alias("given"), F.greatest(F.col("size") - F.col("h"), F.lit(0).cast("long")).alias("left"))
    shape = written(shape, "shape")
    keyed = numbered.withColumn("block", block(F.col("k"), TURN_BITS))
    blocks = keyed.select("conv_id", "block").distinct().join(shape.select("conv_id", "h", "given"), "conv_id")
    later = keyed.join(blocks, ["conv_id", "block"]).where("k > h").select("conv_id", (F.col("given") + F.col("k") - F.col("h")).alias("depth"), "a", "b", "words")
    heads = numbered.where(F.col("k") < most).select(c.alias("base"), "k", "a", "b", "words")
    given = shape.where("given > 0").select("conv_id", "base", "given").join(heads, "base").where("k <= given").select("conv_id", F.col("k").alias("depth"), "a", "b", "words")
    return later.unionByName(given), shape.select("conv_id", (F.col("given") + F.col("left")).alias("size"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))


#: DuckDB SQL of the query's rows; prefixes are told apart by chained digests, subtrees by a join with all ancestors.
SQL = rf"""
WITH {CRC_SQL},
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("cast(conv_id AS varchar)")} % 4 AS h, n
      FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc_list),
s AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS given FROM c LEFT JOIN c b ON c.base = b.conv_id),
r AS (
  SELECT s.conv_id, t.k AS depth, role, text FROM s JOIN t ON t.conv_id = s.base AND t.k <= s.given
  UNION ALL SELECT s.conv_id, s.given + t.k - s.h, role, text FROM s JOIN t ON t.conv_id = s.conv_id AND t.k > s.h),
l AS (SELECT s.conv_id, coalesce(max(depth), 0) AS size FROM s LEFT JOIN r USING (conv_id) GROUP BY s.conv_id),
p AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '{WORD}')) AS words,
         sha256(string_agg(sha256(role) || sha256(text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM l),
n AS (SELECT depth, prefix, min(conv_id) AS owner, count(*) AS n_convs, max(words) AS words FROM p GROUP BY depth, prefix),
parent AS (SELECT n.*, pn.owner AS parent, pn.prefix AS parent_prefix FROM n LEFT JOIN p ON p.conv_id = n.owner AND p.depth = n.depth - 1 LEFT JOIN n pn ON pn.depth = p.depth AND pn.prefix = p.prefix),
children AS (SELECT depth - 1 AS depth, parent_prefix AS prefix, count(*) AS n_children FROM parent WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT parent.*, coalesce(n_children, 0) AS n_children FROM parent LEFT JOIN children USING (depth, prefix)),
subtree AS (
  SELECT p.depth, p.prefix, sum((w.n_convs - 1) * w.words) AS saved, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves
  FROM whole w JOIN p ON p.conv_id = w.owner AND p.depth <= w.depth GROUP BY p.depth, p.prefix),
ends AS (SELECT p.depth, p.prefix, string_agg(cast(p.conv_id AS varchar), ',' ORDER BY p.conv_id) AS ids FROM p JOIN l ON l.conv_id = p.conv_id AND l.size = p.depth GROUP BY p.depth, p.prefix)
SELECT owner AS conv_id, cast(depth AS bigint) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, cast(saved AS bigint) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole JOIN subtree USING (depth, prefix) LEFT JOIN ends USING (depth, prefix)
"""
