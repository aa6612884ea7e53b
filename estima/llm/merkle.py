"""Merkle manifest of a dataset as a content-addressed DAG, proofs by descent (operator 13).

Building. Every row is a leaf (sha256 of its columns); the leaves of a group, in the order of
their ids, are runs of ``FANOUT`` whose sha256 are the next level's nodes, until one node, the
group's subroot, is left; the subroots in the order of the groups likewise give the root. Every
run becomes a record ``digest -> children`` of a content-addressed store: equal runs are one
record, wherever they lie.

Proving. Leaf requests (a leaf's rank in its group and the group's rank) descend from the root.
The digits of the ranks to the base ``FANOUT`` say which child to go to; each step looks the
current digest up in the store, goes on with the selected child and collects the children that
were not selected as a segment (those to the left, those to the right). Requests that agree in
all digits so far travel as one row, so a level costs its nodes, not the leaves below. At the
leaves the path is reversed: read from the leaf upwards it is the proof. Only then does it meet
the leaf rows, run by run. The driver holds the number of levels and nothing that grows.

Order without a single task: rows are range partitioned by (group, id, digest) and a number
that parts equal rows, and written; a row's rank is its place in its task's rows of the group
plus what earlier tasks hold of the group. So a group of any share of the rows is dealt out.

Defined cases: null values are written as ``-``; a null group is a group and comes first; null
ids come first in their group; rows that repeat an id are leaves of their own, by digest; a row
whose tampered copy equals it verifies; a null id is not tampered with; a group of one leaf has
that leaf as its subroot; a single group's subroot is the root; an empty table gives no rows.
Very long texts are hashed whole. Columns that are not named take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estima.llm.common import crc32_text, join_unique, written

FANOUT = 16
#: Rows that one task could hold whatever their keys: below, plain joins.
NARROW = 200_000

_SEGMENT = "array<struct<left:string,right:string>>"


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as ``length:value`` (UTF-8 bytes), a null as ``-``."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return sha256(F.concat(*[field(v) for v in values]))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, everything else kept."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Manifest:
    """``leaves``: tree, idx, n and the carried columns, one row per leaf; ``store``: records
    (digest, children, uses) by height of the node; ``tops``: tree, n, subroot, place, trees;
    ``root_store``: the records over the subroots; ``root``: one row with the root, or none."""

    leaves: DataFrame
    store: dict[int, DataFrame]
    tops: DataFrame
    root_store: dict[int, DataFrame]
    root: DataFrame


def ranked(df: DataFrame, tree: str, order: list[str], tag: str) -> DataFrame:
    """Adds idx (0, 1, ... within ``tree`` by ``order``) and n (rows of the tree)."""
    rows = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order], F.col("__tie")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), tag)
    rows = rows.withColumn("__part", F.shiftright("__row", 33))
    # one row per task and tree; a task's rows of a tree follow each other
    counts = rows.groupBy(tree, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    per = Window.partitionBy(tree)
    before = per.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(tree, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                           F.sum("__n").over(per).alias("n"))
    return rows.join(counts, [tree, "__part"]).withColumn(
        "idx", F.col("__row") - F.col("__first") + F.col("__before")).drop("__row", "__part", "__first", "__before")


def levels(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def build(nodes: DataFrame, most: int) -> tuple[dict[int, DataFrame], DataFrame]:
    """Store and tops (tree, n of leaves, digest) over nodes (tree, idx, n, digest); ``most``:
    leaves of the largest tree."""
    store: dict[int, DataFrame] = {}
    at = nodes.select("tree", "idx", "digest", "n", F.col("n").alias("left"))
    tops = at.where("left = 1")
    for height in range(1, levels(most) + 1):
        run = at.where("left > 1").groupBy("tree", F.floor(F.col("idx") / FANOUT).cast("long").alias("up"), "n", "left").agg(
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        run = run.select("tree", F.col("up").alias("idx"), "n", F.ceil(F.col("left") / FANOUT).cast("long").alias("left"),
                         F.col("kids.digest").alias("children"))
        at = written(run.withColumn("digest", sha256(F.array_join("children", ""))), f"merkle-{height}")
        # equal runs are one record
        store[height] = written(at.groupBy("digest").agg(F.first("children").alias("children"), F.count("*").alias("uses")),
                                f"merkle-store-{height}")
        tops = tops.unionByName(at.where("left = 1").drop("children"))
    return store, tops.select("tree", "n", "digest")


def manifest(rows: DataFrame, group: str, order: str, digest: str, carried: list[str]) -> Manifest:
    """Manifest of rows with a leaf digest; ``group`` may be null."""
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(group).cast("string")))
    kept = list(dict.fromkeys([order, digest, *carried]))
    leaves = written(ranked(rows.select(key.alias("tree"), *kept), "tree", [order, digest], "merkle-leaves"), "merkle-ranked")
    most = leaves.agg(F.max("n")).first()[0] or 0
    store, tops = build(leaves.select("tree", "idx", "n", F.col(digest).alias("digest")), most)
    tops = ranked(tops.select(F.lit("").alias("all"), "tree", F.col("n").alias("leaves"), F.col("digest").alias("subroot")),
                  "all", ["tree"], "merkle-tops")
    tops = written(tops.select("tree", F.col("leaves").alias("n"), "subroot", F.col("idx").alias("place"), F.col("n").alias("trees")),
                   "merkle-places")
    trees = tops.agg(F.max("trees")).first()[0] or 0
    root_store, root = build(tops.select(F.lit("").alias("tree"), F.col("place").alias("idx"), F.col("trees").alias("n"),
                                         F.col("subroot").alias("digest")), trees)
    return Manifest(leaves, store, tops, root_store, written(root.select(F.col("digest").alias("root"), "n"), "merkle-root"))


def _segment(children: Column, at: Column) -> Column:
    """The children that are not selected, as texts left and right of the selected one."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("left"),
                    F.array_join(F.slice(children, at + 2, F.lit(FANOUT)), "").alias("right"))


def _looked_up(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests with the children of their current digest; a digest that many nodes share may be hot."""
    return join_unique(requests, records, "digest", requests.count(), "uses", NARROW)


def descend(starts: DataFrame, store: dict[int, DataFrame], to: int) -> DataFrame:
    """Requests (height, idx, digest, path and what else ``starts`` holds) taken down from their
    trees' tops to the nodes of height ``to``; a tree that is no higher stays at its top. ``path``
    gets a segment a level, downwards."""
    at = starts
    for height in range(max(store, default=0), to, -1):
        other = [c for c in at.columns if c not in ("idx", "digest", "path")]
        met = _looked_up(at.where(F.col("height") >= height), store[height])
        step = met.select(*other, "idx", "path", "children", F.posexplode("children").alias("digit", "next")).select(
            *other, (F.col("idx") * FANOUT + F.col("digit")).alias("idx"), F.col("next").alias("digest"),
            F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))
        # trees lower than this level wait at their tops
        at = written(step.unionByName(at.where(F.col("height") < height)), f"merkle-descent-{height}")
    return at


def _height(n: str, most: int) -> Column:
    """Levels of a tree of ``n`` leaves."""
    out = F.lit(0)
    for h in range(1, levels(most) + 1):
        out = F.when(F.col(n) > FANOUT ** (h - 1), F.lit(h)).otherwise(out)
    return out


def proofs(m: Manifest) -> DataFrame:
    """Every leaf with subroot, root and path: its segments upwards, (left, right) a level."""
    path = F.array().cast(_SEGMENT).alias("path")
    trees, root = m.tops.agg(F.max("trees")).first()[0] or 0, m.root.first()
    top = descend(m.root.select(_height("n", trees).alias("height"), F.lit(0).cast("long").alias("idx"), F.col("root").alias("digest"), path),
                  m.root_store, 0)
    most = m.tops.agg(F.max("n")).first()[0] or 0
    starts = m.tops.join(top.select(F.col("idx").alias("place"), "path"), "place").select(
        "tree", _height("n", most).alias("height"), F.lit(0).cast("long").alias("idx"), F.col("subroot").alias("digest"), "subroot", "path")
    runs = descend(written(starts, "merkle-requests"), m.store, 1)
    runs = runs.where("height = 0").withColumn("children", F.lit(None).cast("array<string>")).unionByName(
        _looked_up(runs.where("height > 0"), m.store[1]) if m.store else runs.where("false").withColumn("children", F.lit(None).cast("array<string>")))
    other = [c for c in m.leaves.columns if c not in ("tree", "n")]
    rows = m.leaves.groupBy("tree", F.floor(F.col("idx") / FANOUT).cast("long").alias("run")).agg(F.collect_list(F.struct(*other)).alias("rows"))
    met = rows.join(runs.select("tree", F.col("idx").alias("run"), "subroot", "path", "children"), ["tree", "run"])
    met = met.select("subroot", "path", "children", F.explode("rows").alias("row")).select("subroot", "path", "children", "row.*")
    at = (F.col("idx") % FANOUT).cast("int")
    whole = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(_segment(F.col("children"), at))))
    return met.select(*[c for c in other if c != "idx"], "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"),
                      F.reverse(whole).alias("path"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its path give."""
    return F.aggregate(path, start, lambda at, s: sha256(F.concat(s["left"], at, s["right"])))


def merkle_proofs(docs: DataFrame, order: str = "doc_id", group: str = "source",
                  columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), every: int = 5) -> DataFrame:
    """Every row's leaf, subroot, root and the digest of its proof, and an audit: rows whose id has a crc32
    divisible by ``every`` are given a tampered text (the last of ``columns`` in lower case) and folded again."""
    *first, text = [F.col(c) for c in columns]
    tampered = F.col(order).isNotNull() & (crc32_text(F.col(order)) % every == 0)
    rows = docs.select(F.col(order).alias("__id"), F.col(group).alias("__group"), leaf_digest([*first, text]).alias("__leaf"),
                       F.when(tampered, leaf_digest([*first, lower_ascii(text)])).alias("__altered"))
    m = manifest(written(rows, "merkle-digests"), "__group", "__id", "__leaf", ["__altered"])
    found = proofs(m)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select(F.col("__id").alias(order), F.col("__leaf").alias("leaf"), "subroot", "root", sha256(siblings).alias("proof_sha256"),
                       folded(F.coalesce("__altered", "__leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
