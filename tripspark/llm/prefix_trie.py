"""Trie of conversation prefixes by hashing of fixed-length blocks.

Turns are dealt into blocks of `BLOCK` turns, each block gets one digest, and the digest of all blocks up to a place is
composed by doubling, so the rounds grow with the logarithm of the longest conversation. Conversations are grouped by
(digest of the blocks before, digest of the block); a group is one row whatever its size. Only where several blocks
follow the same ones are they cut into turns, and equal beginnings found; a block without a sibling gives its turns'
nodes as they are. Sums over subtrees are doubled over ancestors in the same way. No conversation or group is collected
in one row: a block holds `BLOCK` digests at most, and ids that end at a node are hashed as a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.llm.common import words
from tripspark.session import checkpointed

BLOCK = 4  # turns of a block
ROOT = "root"
FAMILY = 20  # conversations that start with turns of one of them
HEAD = 4  # their number of such turns is below this


def digest(role: Column, text: Column) -> Column:
    """128 bits of a role and a text, told apart by the role's length."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def _prefix_digests(blocks: DataFrame) -> DataFrame:
    """(conv, j, s): digest of the blocks 0 to j of a conversation, the same for equal blocks."""
    s = checkpointed(blocks.select("conv", "j", F.col("bd").alias("s")))
    last, step = s.agg(F.max("j")).first()[0] or 0, 1
    while step <= last:
        before = s.select("conv", (F.col("j") + step).alias("j"), F.col("s").alias("before"))
        both = F.when(F.col("before").isNull(), F.col("s")).otherwise(F.md5(F.concat("before", "s")))
        s = checkpointed(s.join(before, ["conv", "j"], "left").select("conv", "j", both.alias("s")))
        step *= 2
    return s


def _turn_nodes(groups: DataFrame, block: int) -> DataFrame:
    """(nid, parent, depth, n, conv_id, words) for each turn of each block of (g, s, j, turns, n, conv_id)."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: F.struct(i.alias("i"), F.array_join(F.transform(F.slice("turns", F.lit(1), i), lambda t: t["td"]), "").alias("path")),
    )
    full = lambda step: F.when(step["i"] == block, F.col("s")).otherwise(F.md5(F.concat(F.lit("n"), F.col("g"), step["path"])))
    named = groups.withColumn("steps", steps).withColumn("nids", F.transform("steps", full))
    each = named.select("*", F.posexplode("nids").alias("k", "nid"))
    return each.select(
        "nid",
        F.when(F.col("k") == 0, F.col("g")).otherwise(F.get("nids", F.col("k") - 1)).alias("parent"),
        (F.col("j") * block + F.col("k") + 1).cast("long").alias("depth"),
        "n",
        "conv_id",
        F.get("turns", F.col("k"))["words"].alias("words"),
    )


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """(nid, ends_sha256) of (nid, conv): ids ascending, joined by commas, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            nids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names, digests = [], []
            for nid, conv in zip(nids, convs, strict=True):
                if nid != now:
                    if now is not None:
                        names.append(now)
                        digests.append(state.hexdigest())
                    now, state = nid, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], names=["nid", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["nid", "ends_sha256"])

    dealt = ends.select("nid", "conv").repartition("nid").sortWithinPartitions("nid", "conv")
    return dealt.mapInArrow(run, "nid string, ends_sha256 string")


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """(nid, n_leaves, saved_tokens) of (nid, parent, leaf, saved), by doubling the distance of the ancestor."""
    t = checkpointed(nodes.select("nid", F.col("parent").alias("anc"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
    while not t.filter("anc IS NOT NULL").isEmpty():
        more = t.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("nid")).agg(F.sum("n_leaves").alias("__l"), F.sum("saved_tokens").alias("__s"))
        above = t.select(F.col("nid").alias("anc"), F.col("anc").alias("__anc"))
        t = t.join(more, "nid", "left").join(above, "anc", "left")
        zero = F.lit(0).cast("long")
        t = t.select(
            "nid",
            F.col("__anc").alias("anc"),
            (F.col("n_leaves") + F.coalesce("__l", zero)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("__s", zero)).alias("saved_tokens"),
        )
        t = checkpointed(t)
    return t.drop("anc")


def trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv, depth, td, words), one row per node.

    ``depth`` counts a conversation's turns from 1 without gaps, ``td`` is a turn's `digest`; ``members`` (conv, long,
    distinct) also names conversations without a turn. Columns: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No member gives no node.
    """
    members = checkpointed(members)
    told = F.struct("depth", "td", "words")
    blocks = turns.groupBy("conv", F.expr(f"CAST((depth - 1) DIV {block} AS INT)").alias("j")).agg(F.array_sort(F.collect_list(told)).alias("turns"))
    blocks = blocks.withColumn("path", F.array_join(F.transform("turns", lambda t: t["td"]), ""))
    blocks = checkpointed(blocks.withColumn("bd", F.md5("path")))
    s = _prefix_digests(blocks)
    before = s.select("conv", (F.col("j") + 1).alias("j"), F.col("s").alias("g"))
    placed = blocks.join(s, ["conv", "j"]).join(before, ["conv", "j"], "left").withColumn("g", F.coalesce("g", F.lit(ROOT)))
    placed = checkpointed(placed.select("conv", "j", "turns", "path", "bd", "g", "s"))

    groups = placed.groupBy("g", "j", "bd").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv_id"), F.min("s").alias("s"), F.min("turns").alias("turns"))
    groups = checkpointed(groups)
    siblings = groups.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    apart = siblings.filter("k > 1").select("g")
    alone = _turn_nodes(groups.join(apart, "g", "left_anti"), block)
    cut = _turn_nodes(groups.join(apart, "g", "left_semi"), block)
    cut = cut.groupBy("nid").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"))
    root = members.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    root = root.select(F.lit(ROOT).alias("nid"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "n", "conv_id", F.lit(0).cast("long").alias("words"))
    nodes = checkpointed(alone.unionByName(cut).unionByName(root))

    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("nid")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = checkpointed(nodes.join(children, "nid", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    own = nodes.select("nid", "parent", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    sums = _subtree_sums(own)

    last = placed.groupBy("conv").agg(F.max("j").alias("j"))
    where = F.when(F.size("turns") == block, F.col("s")).otherwise(F.md5(F.concat(F.lit("n"), "g", "path")))
    ends = placed.join(last, ["conv", "j"]).select(where.alias("nid"), "conv")
    bare = members.join(last, "conv", "left_anti").select(F.lit(ROOT).alias("nid"), "conv")
    hashed = _hashed_ends(ends.unionByName(bare))

    over = nodes.select(F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, "nid").join(hashed, "nid", "left").join(over, "parent", "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv, depth, td, words) of their turns, and (conv) of all of them.

    Turns are ordered by number, null first, and turns of one number by their digest; null roles and texts are empty;
    rows without a conversation id are left out; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), digest(role, text).alias("td"), F.size(words(text)).cast("long").alias("words")
    )
    order = Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "td")
    own = checkpointed(own.select("conv", "td", "words", F.row_number().over(order).alias("pos")))
    # a conversation's first turns come from the first of its family
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD).alias("h"), (F.col("conv") - F.pmod("conv", F.lit(FAMILY))).alias("first"))
    convs = checkpointed(convs)
    sizes = convs.select(F.col("conv").alias("first"), F.col("n").alias("there"))
    convs = checkpointed(convs.join(sizes, "first", "left").withColumn("a", F.least("h", F.coalesce("there", F.lit(0).cast("long")))))
    heads = own.filter(F.col("pos") < HEAD).select(F.col("conv").alias("first"), "td", "words", "pos")
    taken = convs.filter("a > 0").join(heads, "first").filter("pos <= a").select("conv", F.col("pos").cast("long").alias("depth"), "td", "words")
    kept = own.join(convs.select("conv", "h", "a"), "conv").filter("pos > h").select("conv", (F.col("a") + F.col("pos") - F.col("h")).alias("depth"), "td", "words")
    return taken.unionByName(kept), convs.select("conv")


def op13_prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Contract columns of the trie of rebuilt conversations, one row per node."""
    told, members = rebuilt(turns.select("conv_id", "turn", "role", "text"))
    return trie(told, members, block)


SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc(i, c) AS (SELECT i, c FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS td,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, td, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, td) AS pos FROM turns),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY 1),
walk(conv_id, rest, c) AS (
  SELECT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM sizes
  UNION ALL
  SELECT conv_id, substr(rest, 2), xor(w.c >> 8, crc.c) FROM walk w JOIN crc ON crc.i = xor(w.c, ascii(rest)::BIGINT) % 256 WHERE rest <> ''),
convs AS (
  SELECT w.conv_id, xor(w.c, 4294967295) % {HEAD} AS h, least(xor(w.c, 4294967295) % {HEAD}, coalesce(s.n, 0)) AS a
  FROM walk w LEFT JOIN sizes s ON s.conv_id = w.conv_id - (w.conv_id % {FAMILY} + {FAMILY}) % {FAMILY} WHERE rest = ''),
told AS (
  SELECT c.conv_id, o.pos AS depth, td, words FROM convs c JOIN own o ON o.conv_id = c.conv_id - (c.conv_id % {FAMILY} + {FAMILY}) % {FAMILY} AND o.pos <= c.a
  UNION ALL
  SELECT conv_id, a + pos - h, td, words FROM own JOIN convs USING (conv_id) WHERE pos > h),
paths AS (
  SELECT conv_id, depth, words, md5(string_agg(td, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS nid FROM told
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY 1),
nodes AS (
  SELECT nid, depth, min(words) AS words, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '') AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY 1, 2),
over AS (
  SELECT DISTINCT below.nid, above.nid AS anc, below.depth - above.depth AS far
  FROM nodes below JOIN paths above ON above.conv_id = below.conv_id AND above.depth <= below.depth),
kids AS (SELECT anc AS nid, count(*) AS n_children FROM over WHERE far = 1 GROUP BY 1),
sums AS (
  SELECT anc AS nid, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n - 1) * words) AS saved
  FROM over JOIN nodes USING (nid) LEFT JOIN kids USING (nid) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums USING (nid) LEFT JOIN kids USING (nid)
LEFT JOIN over o ON o.nid = n.nid AND o.far = 1 LEFT JOIN nodes p ON p.nid = o.anc
"""
