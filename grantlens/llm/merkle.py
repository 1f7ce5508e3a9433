"""A Merkle manifest of a table, as a rollup of nested structs.

Every row has a rank in its tree; the hexadecimal digits of the rank are the way to it. Blocks of 16 ** 3
nodes are rolled up: the digit columns are grouped away one after the other, each grouping nests the nodes of a run
as an array of structs in their parent. The nodes that blocks end in are the leaves of the next round, until each tree
has one node. Proofs come out of the nested rows again: a transform takes the hashes of a run, an
explode hands each child its run's others. Rows of documents are never joined for that; a block meets the way
from it to the root by a grouping on the block's number.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.common import written

#: Bits of a digit: a run has 16 nodes.
DIGIT = 4
RUN = 1 << DIGIT
#: Levels that a block rolls up: it has at most 4,096 nodes.
LEVELS = 3
#: Columns that a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of the documents that the check tampers with, the hash of the id has this remainder by that number.
TAMPER = (5, 0)


def digest(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(**replaced) -> F.Column:
    """The hash of a row: each field as '-' if null, else its bytes' number, ':' and itself."""
    values = [replaced.get(f, F.col(f)).cast("string") for f in FIELDS]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def ranked(rows: DataFrame, order: list[F.Column]) -> DataFrame:
    """`rows` with `rank` (from 0, by `order`) within `tree` and `n`, the rows of the tree.

    Rows are dealt by ranges of the whole order, so a tree of any size spreads over tasks; the places
    inside a range and the numbers of rows before it, one row per range and tree, give the ranks.
    """
    key = [F.col("tree").asc_nulls_first(), *order]
    placed = written(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()), "manifest-rows")
    part = F.shiftright("at", 33)
    pieces = placed.groupBy(F.col("tree").alias("of"), part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("own"))
    tree = Window.partitionBy("of")
    before = F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("of", "part", (F.col("low") - F.coalesce(before, F.lit(0))).alias("base"), F.sum("own").over(tree).alias("n"))
    return placed.join(pieces, F.col("tree").eqNullSafe(F.col("of")) & (part == F.col("part"))).withColumn("rank", F.col("at") - F.col("base")).drop("at", "of", "part", "base")


def _nodes(level: int) -> F.Column:
    """Nodes of a tree at a level, from its n nodes at level 0."""
    return F.shiftright(F.col("n") - 1, DIGIT * level) + 1


def rolled(nodes: DataFrame) -> DataFrame:
    """One row per block: tree, rank (of the block), n (nodes at its lowest level), hash and the nested `runs`.

    `nodes` have tree, n, rank, hash and item, what a leaf carries. A tree that has come to one node
    isn't hashed again. Blocks are dealt by tree and number, once: every grouping is on finer keys.
    """
    rows = nodes.select(
        "tree", "n", F.shiftright("rank", DIGIT * LEVELS).alias("block"), *[F.shiftright("rank", DIGIT * i).bitwiseAND(RUN - 1).alias(f"d{i}") for i in range(LEVELS)],
        "hash", F.col("item").alias("below")).repartition("tree", "block")
    for level in range(LEVELS):
        above = [f"d{i}" for i in range(LEVELS - 1, level, -1)]
        run = F.array_sort(F.collect_list(F.struct(F.col(f"d{level}").alias("digit"), "hash", "below")))
        rows = rows.groupBy("tree", "n", "block", *above).agg(run.alias("below"))
        joint = digest(F.array_join(F.transform("below", lambda c: c["hash"]), ""))
        rows = rows.withColumn("hash", F.when(_nodes(level) > 1, joint).otherwise(F.col("below")[0]["hash"]))
    return rows.select("tree", "n", F.col("block").alias("rank"), "hash", F.col("below").alias("runs"))


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Rounds of blocks, written, from those of the leaves up to one block per tree. `leaves` as for rolled()."""
    rounds = []
    while True:
        rounds.append(written(rolled(leaves), "manifest-blocks"))
        left = _nodes(LEVELS)
        if (rounds[-1].agg(F.max(left)).first()[0] or 0) <= 1:
            return rounds
        leaves = rounds[-1].select("tree", left.alias("n"), "rank", "hash", F.lit(None).cast("boolean").alias("item"))


def opened(blocks: DataFrame) -> DataFrame:
    """(tree, rank, hash, item, path) of every leaf of blocks that know their `path`, the way from the block to the root.

    A path has root, subroot and steps from below: of each run the hashes left and right of the node.
    """
    rows = blocks.select("tree", "n", "rank", F.col("runs").alias("below"), "path.root", "path.subroot", "path.steps")
    for level in reversed(range(LEVELS)):
        rows = rows.select("*", F.transform("below", lambda c: c["hash"]).alias("run"), F.posexplode("below").alias("at", "node")).drop("below")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("run", F.col("at") + 2, F.lit(RUN)), "").alias("right"))
        rows = rows.select(
            "tree", "n", (F.shiftleft("rank", DIGIT) + F.col("node.digit")).alias("rank"), F.col("node.hash").alias("hash"), F.col("node.below").alias("below"),
            "root", "subroot", F.when(_nodes(level) > 1, F.concat(F.array(step), "steps")).otherwise(F.col("steps")).alias("steps"))
    return rows.select("tree", "rank", "hash", F.col("below").alias("item"), F.struct("root", "subroot", "steps").alias("path"))


def met(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the paths (tree, rank, path) to them: both have one row per block, and meet by a grouping."""
    both = blocks.select("tree", "rank", "n", "runs", F.lit(None).cast(paths.schema["path"].dataType).alias("path")).unionByName(
        paths.select("tree", "rank", F.lit(None).cast("long").alias("n"), F.lit(None).cast(blocks.schema["runs"].dataType).alias("runs"), "path"))
    return both.groupBy("tree", "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "runs", "path")])


def _handed_down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The leaves of the first round with their paths; `top` are the blocks of the last one with theirs."""
    rows = opened(top)
    for blocks in reversed(rounds[:-1]):
        rows = opened(met(blocks, rows.select("tree", "rank", "path")))
    return rows


_STEPS = "array<struct<left:string,right:string>>"


def proofs(leaves: DataFrame, order: list[F.Column]) -> DataFrame:
    """tree, leaf, item, subroot, root and steps of every row of `leaves`: tree (a string), hash, item and the columns of `order`.

    Each tree's rows in their order make its subroot, the subroots by tree (null first, by bytes) the root.
    """
    rounds = grown(ranked(leaves, order))
    subroots = rounds[-1].select(F.lit("").alias("tree"), "hash", F.col("tree").alias("item"))
    over = grown(ranked(subroots, [F.col("item").asc_nulls_first()]))
    nowhere = F.struct(F.col("hash").alias("root"), F.lit(None).cast("string").alias("subroot"), F.array().cast(_STEPS).alias("steps"))
    sources = _handed_down(over, over[-1].withColumn("path", nowhere))
    paths = sources.select(
        F.col("item").alias("tree"), F.lit(0).cast("long").alias("rank"), F.struct("path.root", F.col("hash").alias("subroot"), "path.steps").alias("path"))
    rows = _handed_down(rounds, met(rounds[-1], paths))
    return rows.select("tree", F.col("hash").alias("leaf"), "item", "path.subroot", "path.root", "path.steps")


def folded(leaf_hash, steps) -> F.Column:
    """The root that a leaf's hash and the steps of its proof lead to."""
    return F.aggregate(steps, leaf_hash, lambda held, s: digest(F.concat(s["left"], held, s["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """Per document doc_id, source, leaf, subroot, root, steps (its proof), and `tampered`, the hash of the altered row that a check is to catch.

    Null fields are part of the hash, null sources are a tree of their own, null ids come first and
    aren't altered. Rows of one id stand in order of their hashes. Texts are hashed whole in the scan and
    don't travel. Columns other than the five have no part. An empty table gives no rows.
    """
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER[0] == TAMPER[1], leaf(text=F.translate("text", ascii_uppercase, ascii_lowercase)))
    leaves = docs.select(F.col("source").alias("tree"), leaf().alias("hash"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), altered.alias("tampered")).alias("item"))
    rows = proofs(leaves, [F.col("item.doc_id").asc_nulls_first(), F.col("hash")])
    return rows.select("item.doc_id", F.col("tree").alias("source"), "leaf", "subroot", "root", "steps", "item.tampered")


def verified(docs: DataFrame) -> DataFrame:
    """Per document doc_id, leaf, subroot, root, proof_sha256, folded_root and verified; edge cases as in manifest()."""
    rows = manifest(docs)
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = r"""
with recursive crc_table as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as t),
fields as (select doc_id, source, text, crc % 5 = 0 as altered,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
        coalesce(strlen(text) || ':' || text, '-') as body,
        coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') as low
    from (select d.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from documents d, crc_table)),
leaves as (select doc_id, source, sha256(head || body) as leaf, case when altered then sha256(head || low) else sha256(head || body) end as used from fields),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r from leaves),
nodes as (select 0 as level, source, r as i, leaf as hash, count(*) over (partition by source) as n from placed
    union all
    select level + 1, source, i // 16, sha256(string_agg(hash, '' order by i)), (n + 15) // 16 from nodes where n > 1 group by level, source, i // 16, n),
subroots as (select source, hash as subroot, row_number() over (order by encode(source) nulls first) - 1 as s from nodes where n = 1),
over_nodes as (select 0 as level, s as i, subroot as hash, count(*) over () as n from subroots
    union all
    select level + 1, i // 16, sha256(string_agg(hash, '' order by i)), (n + 15) // 16 from over_nodes where n > 1 group by level, i // 16, n),
doc_steps as (select p.doc_id, p.leaf, p.source, p.r, a.level, coalesce(string_agg(b.hash, '' order by b.i) filter (b.i < a.i), '') as lefts, coalesce(string_agg(b.hash, '' order by b.i) filter (b.i > a.i), '') as rights
    from placed p join nodes a on a.source is not distinct from p.source and a.i = p.r // (16 ** a.level)::bigint and a.n > 1
    join nodes b on b.source is not distinct from a.source and b.level = a.level and b.i // 16 = a.i // 16 group by all),
source_steps as (select s.s, a.level, coalesce(string_agg(b.hash, '' order by b.i) filter (b.i < a.i), '') as lefts, coalesce(string_agg(b.hash, '' order by b.i) filter (b.i > a.i), '') as rights
    from subroots s join over_nodes a on a.i = s.s // (16 ** a.level)::bigint and a.n > 1 join over_nodes b on b.level = a.level and b.i // 16 = a.i // 16 group by all),
doc_paths as (select source, r, list(lefts || '|' || rights order by level) as steps from doc_steps group by source, r),
source_paths as (select s, list(lefts || '|' || rights order by level) as steps from source_steps group by s),
ways as (select p.doc_id, p.leaf, p.used, s.subroot, (select hash from over_nodes where n = 1) as root, list_concat(coalesce(d.steps, []), coalesce(o.steps, [])) as steps
    from placed p join subroots s on s.source is not distinct from p.source left join doc_paths d on d.source is not distinct from p.source and d.r = p.r left join source_paths o on o.s = s.s),
ends as (select *, list_reduce(list_concat([used], steps), lambda held, step: sha256(split_part(step, '|', 1) || held || split_part(step, '|', 2))) as folded_root from ways)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) as proof_sha256, folded_root, folded_root = root as verified from ends
"""
