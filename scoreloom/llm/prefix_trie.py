"""The trie of conversation prefixes, as a Cartesian tree over the LCP array of the sorted conversations.

Conversations are sorted by their turns and numbered; the LCP array holds how many turns each shares
with the one before. A node that several conversations reach is an interval of that array: from the nearest
smaller value on the left to the nearest on the right of any of its least values. All these nearest
smaller values are found in parallel: within blocks by a stack, and, for what a block leaves open, by the
minima of all blocks, which name the one block to ask. Equal values with the same interval are
one node; a conversation that goes on alone ends in a node of its own; depths between a node and its parent are filled in.
Counts over a node's subtree are differences of running sums over the numbered conversations.

Turns are compared by 128 bits of their SHA-256. A block has n / MOST_BLOCKS conversations or
LEAST_BLOCK, so that at most MOST_BLOCKS minima are sent to the driver and to the tasks. One conversation's digests (16
bytes for each turn, no text) are a row; members that end at a node are joined in chunks of a block.

Defined cases: rows without a conv_id belong to no conversation; a null role or text is empty; equal turns
of a conversation, null ones too, are ordered by their digest, and repeated rows are all kept;
conversation 0 and all multiples of 20 lend to themselves; a negative conv_id borrows from the next
multiple of 20 towards zero; an empty table gives an empty result, without a root; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import fold, store
from scoreloom.llm.expressions import CRC32_SQL, CRC_TABLE_SQL, running_starts
from scoreloom.llm.merkle_manifest import placed

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations whose first turns are lent, and how many turns at most.
LENDERS, MOST_LENT = 20, 3
MOST_BLOCKS, LEAST_BLOCK = 16_384, 256
NONE = np.iinfo(np.int64).max


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns in order, each as (turn, token, words)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    token = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), token.alias("token"), F.regexp_count(text("text"), F.lit(WORD)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, tokens, upto): conversations that begin with turns lent by others; upto[k] is the words of the first k turns."""
    base = F.col("conv_id") - F.col("conv_id") % LENDERS
    heads = convs.filter(F.col("conv_id") % LENDERS == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_LENT).alias("head"))
    lent = fold(F.col("conv_id"), MOST_LENT + 1).cast("int")
    joined = convs.withColumns({"base": base, "lent": lent}).join(heads, "base", "left")
    own = F.slice("turns", F.col("lent") + 1, F.greatest(F.size("turns"), F.lit(1)))
    seq = F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("lent")), own))
    return joined.select("conv_id", seq.alias("seq")).select("conv_id", F.col("seq.token").alias("tokens"), running_starts(F.concat(F.col("seq.words"), F.array(F.lit(0)))).alias("upto"))


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the nearest smaller one on the left (-1: none) and on the right (size: none)."""
    n = len(values)
    left, right = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    open_: list[int] = []
    listed = values.tolist()
    for i, v in enumerate(listed):
        while open_ and listed[open_[-1]] > v:
            right[open_.pop()] = i
        # Equal values stay open, and share what is left of the first of them.
        if open_:
            top = open_[-1]
            left[i] = left[top] if listed[top] == v else top
        open_.append(i)
    return left, right


class Least:
    """Minima of any stretch of values, from a table of doubling stretches."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [np.asarray(values, np.int64)]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, start: int, end: int) -> int:
        """The least of values[start:end]; NONE if there is none."""
        if start >= end:
            return NONE
        k = (end - start).bit_length() - 1
        return int(min(self.rows[k][start], self.rows[k][end - (1 << k)]))


def intervals(lcps: DataFrame, n: int) -> DataFrame:
    """(idx, lcp, a, b, conv): for each place of lcps(idx, conv_id, lcp) its node's conversations a to b - 1 and the least conv_id of them."""
    size = max(LEAST_BLOCK, -(-n // MOST_BLOCKS))
    blocked = store(lcps.select("idx", "conv_id", F.col("lcp").cast("long").alias("lcp"), F.expr(f"idx div {size}").alias("block")), "lcp-blocks")
    # At most MOST_BLOCKS rows.
    minima = sorted(tuple(r) for r in blocked.groupBy("block").agg(F.min("lcp"), F.min("conv_id")).collect())
    low = np.array([m for _, m, _ in minima], np.int64)
    least_of_blocks = Least(np.array([c for _, _, c in minima], np.int64))
    root = least_of_blocks.of(0, len(minima))

    def asked(block: int, value: int, left: bool) -> int:
        """The nearest block with a smaller value; -1 if there is none, as only on the right can be."""
        found = np.flatnonzero(low[:block] < value) if left else np.flatnonzero(low[block + 1 :] < value)
        return -1 if not len(found) else int(found[-1] if left else block + 1 + found[0])

    def ask(key, frame: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        values = frame.sort_values("idx")["lcp"].to_numpy()
        left, right = nearest_smaller(values)
        rows = []
        for is_left, unknown in ((True, left < 0), (False, right >= len(values))):
            for v in np.unique(values[unknown & (values > 0)]).tolist():
                if (t := asked(block, v, is_left)) >= 0:
                    rows.append((t, block, is_left, v))
        return pd.DataFrame(rows, columns=["target", "block", "is_left", "value"])

    def answer(key, frame: pd.DataFrame, requests: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        idx, values, least = frame["idx"].to_numpy(), frame["lcp"].to_numpy(), Least(frame["conv_id"].to_numpy())
        rows = []
        for block, is_left, v in zip(requests["block"], requests["is_left"], requests["value"]):
            smaller = np.flatnonzero(values < v)
            at = int(smaller[-1] if is_left else smaller[0])
            rows.append((block, is_left, v, int(idx[at]), least.of(at, len(values)) if is_left else least.of(0, at)))
        return pd.DataFrame(rows, columns=["block", "is_left", "value", "place", "least"])

    def resolve(key, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["idx", "lcp", "a", "b", "conv"])
        block = int(key[0])
        frame = frame.sort_values("idx")
        idx, values, least = frame["idx"].to_numpy(), frame["lcp"].to_numpy(), Least(frame["conv_id"].to_numpy())
        told = {(bool(s), int(v)): (int(p), int(m)) for s, v, p, m in zip(answers["is_left"], answers["value"], answers["place"], answers["least"])}
        left, right = nearest_smaller(values)
        rows, count = [], len(values)
        for i, v in enumerate(values.tolist()):
            if v == 0:
                rows.append((int(idx[i]), 0, 0, n, root))
                continue
            if left[i] >= 0:
                a, low_left = int(idx[left[i]]), least.of(int(left[i]), i)
            else:
                a, m = told[True, v]
                low_left = min(m, least_of_blocks.of(a // size + 1, block), least.of(0, i))
            if right[i] < count:
                b, low_right = int(idx[right[i]]), least.of(i, int(right[i]))
            elif (False, v) in told:
                b, m = told[False, v]
                low_right = min(m, least_of_blocks.of(block + 1, b // size), least.of(i, count))
            else:
                b, low_right = n, min(least_of_blocks.of(block + 1, len(minima)), least.of(i, count))
            rows.append((int(idx[i]), v, a, b, min(low_left, low_right)))
        return pd.DataFrame(rows, columns=["idx", "lcp", "a", "b", "conv"])

    requests = blocked.groupBy("block").applyInPandas(ask, "target long, block long, is_left boolean, value long")
    answers = blocked.groupBy("block").cogroup(requests.groupBy("target")).applyInPandas(answer, "block long, is_left boolean, value long, place long, least long")
    out = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(resolve, "idx long, lcp long, a long, b long, conv long")
    return store(out, "lcp-nodes")


def running(rows: DataFrame, n: int, *sums: str) -> DataFrame:
    """rows(idx, ...) with each sum over all places up to and with idx."""
    size = max(LEAST_BLOCK, -(-n // MOST_BLOCKS))
    blocked = store(rows.withColumn("block", F.expr(f"idx div {size}")), "running")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # At most MOST_BLOCKS rows, so one task and a broadcast will do.
    starts = blocked.groupBy("block").agg(*[F.sum(s).alias(f"own_{s}") for s in sums]).select("block", *[F.coalesce(F.sum(f"own_{s}").over(before), F.lit(0)).alias(f"from_{s}") for s in sums])
    inside = Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(F.broadcast(starts), "block").select("idx", *[(F.sum(s).over(inside) + F.col(f"from_{s}")).alias(s) for s in sums])


def trie(seqs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, ends) of seqs(conv_id, tokens, upto); None without conversations.

    nodes(a, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens): conversations a to
    a + n_convs - 1 of the sorted ones share the node's turns. ends(a, depth, chunk, ids): the conv_ids that end at
    a node, ascending, in chunks.
    """
    ordered = placed(seqs.withColumn("tree", F.lit("")), "tokens", "conv_id")
    n = ordered.agg(F.max("n")).first()[0]
    if not n:
        return None
    before = ordered.select((F.col("idx") + 1).alias("idx"), F.col("tokens").alias("before"))
    differs = F.array_position(F.zip_with("tokens", "before", lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(F.col("before").isNull(), 0).when(differs == 0, F.size("tokens")).otherwise(differs - 1)
    lcps = ordered.join(before, "idx", "left").select("idx", "conv_id", F.size("tokens").alias("len"), shared.alias("lcp"), F.size("before").alias("len_before"))
    lcps = store(lcps, "lcps")
    places = intervals(lcps, n)
    root_conv = lcps.agg(F.min("conv_id")).first()[0]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # A conversation that goes on after all that it shares has a node of its own at its end.
    after = lcps.select((F.col("idx") - 1).alias("idx"), F.col("lcp").alias("lcp_after"))
    alone = lcps.join(after, "idx", "left").filter(F.col("len") > F.greatest("lcp", zero("lcp_after")))
    alone = alone.select(F.col("idx").alias("a"), (F.col("idx") + 1).alias("b"), F.col("len").cast("long").alias("depth"), F.col("conv_id").alias("conv"))
    shared_nodes = places.filter("lcp > 0").select("a", "b", F.col("lcp").alias("depth"), "conv").distinct()
    # The parent is the node of the larger of the two values beside the interval.
    beside = lambda key: places.select(F.col("idx").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in ("lcp", "a", "conv")])
    joined = shared_nodes.unionByName(alone).join(beside("a"), "a").join(beside("b"), "b", "left")
    from_left = F.col("a_lcp") >= zero("b_lcp")
    pick = lambda c: F.when(from_left, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    nodes = joined.select("a", "b", "depth", "conv", pick("lcp").alias("up"), pick("a").alias("up_a"), pick("conv").alias("up_conv"))
    root = ordered.sparkSession.createDataFrame([(0, n, 0, root_conv, -1, None, None)], "a long, b long, depth long, conv long, up long, up_a long, up_conv long")
    nodes = store(nodes.unionByName(root), "trie-nodes")
    children = nodes.filter("up >= 0").groupBy(F.col("up_a").alias("a"), F.col("up").alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    words = ordered.select(F.col("idx").alias("a"), "upto")
    full = nodes.join(children, ["a", "depth"], "left").join(words, "a")
    own = F.when(F.col("up") < 0, F.lit(0)).otherwise((F.col("b") - F.col("a") - 1) * (F.get("upto", F.col("depth").cast("int")) - F.get("upto", F.col("up").cast("int"))))
    full = store(full.withColumns({"n_children": zero("n_children"), "own": own, "leaf": F.col("n_children").isNull().cast("long")}), "counted-nodes")
    at_place = full.groupBy(F.col("a").alias("idx")).agg(F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"))
    every = lcps.select("idx").join(at_place, "idx", "left").select("idx", zero("saved").alias("saved"), zero("leaves").alias("leaves"))
    sums = store(running(every, n, "saved", "leaves"), "running-sums")
    up_to = lambda key, by: sums.select((F.col("idx") + by).alias(key), *[F.col(c).alias(f"{key}_{c}") for c in ("saved", "leaves")])
    # Of the nodes that begin at the same place the deeper ones are below.
    deeper = Window.partitionBy("a").orderBy(F.desc("depth"))
    below = deeper.rowsBetween(Window.unboundedPreceding, -1)
    inner = full.withColumns({"deeper_saved": F.coalesce(F.sum("own").over(below), F.lit(0)), "deeper_leaves": F.sum("leaf").over(deeper.rowsBetween(Window.unboundedPreceding, 0))})
    placed_nodes = inner.join(up_to("a", 0), "a").join(up_to("b", 1), "b")
    count = F.col("b") - F.col("a")
    below_saved = F.col("b_saved") - F.col("a_saved") + F.col("deeper_saved")
    tail = F.expr("transform(sequence(up + 1, depth), d -> named_struct('d', d, 'words', IF(d = 0, 0L, get(upto, CAST(depth AS INT)) - get(upto, CAST(d - 1 AS INT)))))")
    rows = placed_nodes.select(
        "a", "depth", "conv", "up", "up_conv", "n_children", count.alias("n_convs"), (F.col("b_leaves") - F.col("a_leaves") + F.col("deeper_leaves")).alias("n_leaves"), below_saved.alias("below"), F.explode(tail).alias("t")
    )
    d = F.col("t.d")
    parent = F.when(d == 0, F.lit(None)).when(d > F.col("up") + 1, F.col("conv")).when(F.col("up") == 0, F.lit(root_conv)).otherwise(F.col("up_conv"))
    out = rows.select(
        "a",
        d.alias("depth"),
        F.col("conv").alias("conv_id"),
        parent.cast("long").alias("parent_conv_id"),
        "n_convs",
        F.when(d == F.col("depth"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * F.col("t.words")).alias("saved_tokens"),
    )
    # Of equal conversations all but the first find the place of the first as that of their node.
    again = (F.col("lcp") == F.col("len")) & (F.col("len") == F.col("len_before"))
    starts = lcps.select("idx", "conv_id", "len", again.alias("again")).join(places.select("idx", F.col("a").alias("first")), "idx")
    first = F.when(F.coalesce("again", F.lit(False)), F.when(F.col("len") == 0, F.lit(0)).otherwise(F.col("first"))).otherwise(F.col("idx"))
    ends = starts.select(first.alias("a"), F.col("len").cast("long").alias("depth"), F.expr(f"idx div {LEAST_BLOCK}").alias("chunk"), "idx", "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "conv_id"))), lambda x: x["conv_id"].cast("string")), ",")
    return out, ends.groupBy("a", "depth", "chunk").agg(ids.alias("ids"))


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def op11(turns: DataFrame) -> DataFrame:
    """The contract's rows: a row for each node of the trie of the rebuilt conversations."""
    found = trie(rebuilt(store(conversations(turns), "conversations")))
    if found is None:
        return turns.sparkSession.createDataFrame([], RESULT)
    nodes, ends = found
    joined = ends.groupBy("a", "depth").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk", "ids")))["ids"], ",").alias("ids"))
    digest: Column = F.sha2(F.coalesce("ids", F.lit("")), 256)
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.join(joined, ["a", "depth"], "left").select("conv_id", "depth", "parent_conv_id", *counts, digest.alias("ends_sha256"))


ORACLE = f"""
WITH crc_table AS ({CRC_TABLE_SQL}), g AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), lent AS (
  SELECT *, {CRC32_SQL.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM g, crc_table
), seq AS (
  SELECT g.conv_id, list_concat(coalesce(b.turns[1:g.h], []), g.turns[g.h + 1:]) AS turns FROM lent g LEFT JOIN g b ON b.conv_id = g.conv_id - g.conv_id % 20
), prefix AS (
  SELECT conv_id, d, turns[1:d] AS k, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM seq) s
), node AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(k[d].x, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefix GROUP BY k, d
), family AS (
  SELECT c.k, c.d, p.conv_id AS parent_conv_id FROM node c JOIN node p ON c.d = p.d + 1 AND c.k[1:p.d] = p.k
), kids AS (
  SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2
), full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k, d)
), below AS (
  SELECT k[1:u] AS k, u AS d, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM full_node) t GROUP BY 1, 2
)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM full_node JOIN below USING (k, d) LEFT JOIN family USING (k, d)
"""
