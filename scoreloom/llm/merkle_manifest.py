"""A Merkle manifest of a dataset, and proofs that a row belongs to it.

Every row is a leaf. The leaves of a source, in order, are hashed in runs of 16, level by level, to a
subroot; the subroots, in order of their source, likewise to the root. All nodes are kept as a table
(tree, level, idx, digest), so that a proof is a lookup: the coordinates of the siblings follow from a
leaf's index and its group's size, are exploded, joined with the node table, put in order,
concatenated and folded. From the second level on the leaves of a run need the same siblings, so a run's
coordinates are exploded once for its up to 16 leaves; those of its first level are the run's leaves.

No step sees a whole source: leaves are numbered by range partitions and the counts of the partitions
before, a group to hash has at most 16 nodes, and each level has a sixteenth of the rows of the one below.

Defined cases: a null field is "-", so a null text and an empty one are different leaves; leaves with
equal doc_id are ordered by their digest, and a null doc_id comes first; repeated rows are leaves of their
own; a null source is a source before all others; a source with one leaf has that leaf as its
subroot, and with one source its subroot is the root; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, fold, store
from scoreloom.llm.expressions import CRC32_SQL, CRC_TABLE_SQL

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over subroots; a source's own tree is named "-" or "=" and the source.
TOP = ""
#: Added to the levels of the top tree, so that they follow those of any source.
ABOVE = 100
#: One row in so many is tampered with before it is folded.
TAMPER = 5


def digest(*parts: Column) -> Column:
    """H: lowercase hexadecimal SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lower(text: Column) -> Column:
    """text with A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with idx, the place from 0 within their tree, and n, the rows of the tree.

    Rows are range-partitioned by tree and order, so the place follows from that in the partition and the
    counts of the tree's earlier partitions: one small row for each tree and partition.
    """
    keys = ["tree", *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = store(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered-leaves")
    runs = stored.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    out = stored.join(starts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    kept = store(out, "placed-leaves")
    discard(stored)
    return kept


def levels(leaves: DataFrame) -> DataFrame:
    """(tree, level, idx, size, digest): every node above leaves(tree, idx, n, digest), they included.

    size is how many nodes the tree has at that level; the node of size 1 is its root.
    """
    level = leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("n").alias("size"), "digest")
    most = level.agg(F.max("size")).first()[0] or 0
    out, k = level, 0
    while most > 1:
        k, most = k + 1, (most + FANOUT - 1) >> FANOUT_BITS
        in_order = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        up = level.filter("size > 1").groupBy("tree", F.shiftright("idx", FANOUT_BITS).alias("up"), F.shiftright(F.col("size") + FANOUT - 1, FANOUT_BITS).alias("less"))
        level = up.agg(F.sha2(F.array_join(in_order["digest"], ""), 256).alias("digest")).select("tree", F.lit(k).alias("level"), F.col("up").alias("idx"), F.col("less").alias("size"), "digest")
        level = store(level, "nodes")
        out = out.unionByName(level)
    return out


@dataclass
class Manifest:
    """leaves(tree, idx, n, digest and what they carry), nodes of all trees, tops(tree, rank, sources, subroot), root."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: str | None


def manifest(leaves: DataFrame, *order: str) -> Manifest:
    """The manifest of leaves(tree, digest, ...), which are numbered by order, then digest."""
    leaves = placed(leaves, *order, "digest")
    nodes = levels(leaves)
    subroots = nodes.filter("size = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest")
    tops = placed(subroots, "of")
    upper = levels(tops)
    root = upper.filter("size = 1").select("digest").first()
    named = tops.select(F.col("of").alias("tree"), F.col("idx").alias("rank"), F.col("n").alias("sources"), F.col("digest").alias("subroot"))
    return Manifest(leaves, nodes.unionByName(upper).drop("size"), named, root and root[0])


def height(n: str) -> Column:
    """How many times n nodes are hashed in runs until one is left."""
    return sum(((F.col(n) > 1 << FANOUT_BITS * k).cast("int") for k in range(15)), F.lit(0))


def coordinates(tree: str, at: str, own: str, n: str, high: str, above: int) -> Column:
    """array<struct<tree, level, idx, ord, after>> of the siblings on the way from a node to the root of its tree.

    at is the node's run; own the node itself, or -1 for all nodes of the run; n the nodes at the lowest level.
    after tells that a sibling stands behind the node on the way.
    """
    b = FANOUT_BITS
    mine = f"IF(l = 0, {own}, shiftright({at}, {b} * (l - 1)))"
    run = f"sequence(shiftright({at}, {b} * l) * {FANOUT}, least(shiftright({at}, {b} * l) * {FANOUT} + {FANOUT - 1}, shiftright({n} - 1, {b} * l)))"
    level = f"transform(filter({run}, i -> i <> {mine}), i -> named_struct('tree', {tree}, 'level', l, 'idx', i, 'ord', l + {above}, 'after', i > {mine}))"
    kind = "array<struct<tree:string,level:int,idx:bigint,ord:int,after:boolean>>"
    return F.expr(f"IF({high} = 0, CAST(array() AS {kind}), flatten(transform(sequence(0, {high} - 1), l -> {level})))")


def proofs(m: Manifest) -> DataFrame:
    """m.leaves with subroot, siblings (array of digests, in order) and steps: what stands left and right of the node at each level."""
    runs = m.leaves.filter(F.col("idx") % FANOUT == 0).select("tree", F.shiftright("idx", FANOUT_BITS).alias("run"), "n")
    runs = runs.join(m.tops, "tree").withColumns({"high": height("n"), "top_run": F.shiftright("rank", FANOUT_BITS), "top_high": height("sources")})
    # Each run is a row of its own; its paths are few rows, however large its source.
    asked = runs.select(
        "tree",
        "run",
        F.explode(F.concat(coordinates("tree", "run", "-1L", "n", "high", 0), coordinates(f"'{TOP}'", "top_run", "rank", "sources", "top_high", ABOVE))).alias("c"),
    ).select("tree", "run", F.col("c.tree").alias("in_tree"), F.col("c.level").alias("level"), F.col("c.idx").alias("idx"), F.col("c.ord").alias("ord"), F.col("c.after").alias("after"))
    nodes = m.nodes.withColumnRenamed("tree", "in_tree")
    found = asked.join(nodes, ["in_tree", "level", "idx"]).groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("ord", "idx", "after", "digest"))).alias("found"))
    side = lambda o, after: f"array_join(transform(filter(found, x -> x.ord = {o} AND x.after = {after}), x -> x.digest), '')"
    ords = f"concat(IF(high > 1, sequence(1, high - 1), CAST(array() AS array<int>)), IF(top_high > 0, sequence({ABOVE}, {ABOVE} + top_high - 1), CAST(array() AS array<int>)))"
    none = "CAST(array() AS array<struct<ord:int,idx:bigint,after:boolean,digest:string>>)"
    paths = runs.join(found, ["tree", "run"], "left").withColumn("found", F.expr(f"coalesce(found, {none})"))
    paths = paths.select(
        "tree",
        "run",
        "subroot",
        "high",
        F.expr("filter(found, x -> x.ord = 0)").alias("kin"),
        F.expr("transform(filter(found, x -> x.ord > 0), x -> x.digest)").alias("upper"),
        F.expr(f"transform({ords}, o -> named_struct('left', {side('o', 'false')}, 'right', {side('o', 'true')}))").alias("steps"),
    )
    leaves = m.leaves.withColumn("run", F.shiftright("idx", FANOUT_BITS))
    out = leaves.join(paths, ["tree", "run"])
    beside = lambda sign: f"array_join(transform(filter(kin, x -> x.idx {sign} idx), x -> x.digest), '')"
    first = F.expr(f"IF(high > 0, array(named_struct('left', {beside('<')}, 'right', {beside('>')})), array())").cast("array<struct<left:string,right:string>>")
    siblings = F.concat(F.expr("transform(filter(kin, x -> x.idx <> idx), x -> x.digest)"), F.col("upper"))
    return out.withColumns({"siblings": siblings, "steps": F.concat(first, F.col("steps"))}).drop("run", "high", "kin", "upper")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered): tampered is the digest with A to Z of the text in lower case, where a row is tampered with."""
    plain = docs.select(*FIELDS)
    fields = [field(F.col(c)) for c in FIELDS]
    head, text = F.concat(*fields[:-1]), F.col("text").cast("string")
    wrong = F.when(fold(F.col("doc_id"), TAMPER) == 0, digest(head, field(lower(text))))
    tree = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    return plain.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(head, field(text)).alias("digest"), wrong.alias("tampered"))


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def op13(docs: DataFrame) -> DataFrame:
    """The contract's rows: digests of leaves, subroots, root and proofs, and whether the leaf, tampered with or not, leads to the root."""
    leaves = store(document_leaves(docs), "leaves")
    m = manifest(leaves, "doc_id")
    discard(leaves)
    if m.root is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    again = folded(F.coalesce("tampered", "digest"), F.col("steps"))
    out = proofs(m).select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(m.root).alias("root"), F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _h(columns: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns.split(", ")]
    return f"sha256({' || '.join(parts)})"


ORACLE = f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE_SQL}), low AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text, coalesce('=' || source, '-') AS tree,
    {CRC32_SQL.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS crc FROM documents, crc_table
), d AS (
  SELECT tree, doc_id, {_h("doc_id, source, lang, n_chars, text")} AS leaf, CASE WHEN crc % 5 = 0 THEN {_h("doc_id, source, lang, n_chars, lower_text")} END AS wrong FROM low
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d
), nodes AS (
  SELECT tree, 0 AS level, idx, n AS size, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE size > 1 GROUP BY tree, level, idx // 16, size
), tops AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE size = 1
), upper AS (
  SELECT 0 AS level, rank AS idx, n AS size, subroot AS digest FROM tops
  UNION ALL
  SELECT level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper WHERE size > 1 GROUP BY level, idx // 16, size
), every AS (
  SELECT tree, level, idx, size, digest FROM nodes UNION ALL SELECT '', level + 100, idx, size, digest FROM upper
), sides AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.size > 1 GROUP BY 1, 2, 3
), way AS (
  SELECT row_number() OVER () AS k, doc_id, leaf, subroot, rank, l.tree, 0 AS level, idx, coalesce(wrong, leaf) AS h, '' AS proof FROM leaves l JOIN tops USING (tree)
  UNION ALL
  SELECT k, doc_id, leaf, subroot, rank, CASE WHEN s.level IS NULL THEN '' ELSE w.tree END, CASE WHEN s.level IS NULL THEN 100 ELSE w.level + 1 END, CASE WHEN s.level IS NULL THEN rank ELSE w.idx // 16 END,
    CASE WHEN s.level IS NULL THEN h ELSE sha256(s.l || h || s.r) END, proof || coalesce(s.l || s.r, '')
  FROM way w LEFT JOIN sides s ON w.tree = s.tree AND w.level = s.level AND w.idx = s.idx WHERE s.level IS NOT NULL OR w.tree <> ''
), ends AS (
  SELECT doc_id, leaf, subroot, h, proof FROM way WHERE tree = '' QUALIFY level = max(level) OVER (PARTITION BY k)
), root AS (
  SELECT digest AS root FROM upper WHERE size = 1
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM ends, root
"""
