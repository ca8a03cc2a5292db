"""A trie of conversation prefixes, built by collapsing whole sequences.

1. Turns get their rank in the conversation. They are laid out by range of (conversation, turn), and ranks, running
   hashes and running word counts go in two levels, inside a range and over the ranges, so a conversation of very many turns is
   spread over tasks. Texts are hashed where they are read; they are never shuffled.
2. Identical conversations become one weighted sequence with the list of the conversations that end there. Only the rows of
   its smallest conversation go on.
3. Sequences that are proper prefixes of others are found by a join with the prefixes; an anti-join leaves the leaves.
4. The prefixes of the weighted sequences are aggregated to nodes. The sum over a subtree needs no walk: a node at depth d saves, over all
   sequences through it, what follows d in them, counted once per conversation, less what follows d and no sequence
   of a smaller conversation shares. Both are differences of running counts.

A node is named by its depth and two 64-bit hashes of its turns.

Turns that tie are ordered by role and the MD5 of their text; equal rows are turns of their own. Rows without a conversation belong to none.
NULL roles and texts are empty. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerpulse.llm.stored import stored

WORDS = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "a", "b"]
CHUNK_BITS = 12


def own_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, block, place (from 1) and, per turn, two hashes and the number of its words."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit(WORDS)).cast("long")
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("md5"), words.alias("words")
    ).where("conv IS NOT NULL")
    order = ["turn", "role", "md5"]
    laid = rows.repartitionByRange("conv", *[F.col(c).asc_nulls_first() for c in order]).withColumn("block", F.spark_partition_id())
    laid = laid.select("conv", "block", *order, "words", F.xxhash64("role", "md5").alias("x"), F.xxhash64("md5", "role").alias("y"))
    laid = stored(laid, "turns")
    inside = Window.partitionBy("conv", "block").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = laid.withColumn("rank", F.row_number().over(inside))
    sizes = laid.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return stored(ranked.join(offsets, ["conv", "block"]).select("conv", "block", (F.col("before") + F.col("rank")).alias("place"), "x", "y", "words"), "ranked")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every conversation of ``convs`` (conv, n) begins with the first turns of the one whose number is the next multiple
    of 20 below, then goes on with its own behind as many: conv, block, place, x, y, words."""
    h, donor = shared_turns(F.col("conv")), F.col("conv") - F.col("conv") % 20
    taken = turns.where((F.col("place") <= 3) & (F.col("conv") % 20 == 0)).select(F.col("conv").alias("donor"), "place", "x", "y", "words")
    asked = convs.select("conv", donor.alias("donor"), h.alias("h"))
    lent = asked.join(taken, "donor").where("place <= h").select("conv", F.lit(-1).alias("block"), "place", "x", "y", "words")
    donors = convs.where("conv % 20 = 0").select(F.col("conv").alias("donor"), F.col("n").alias("donor_n"))
    shift = asked.join(donors, "donor", "left").select("conv", "h", (F.least("h", F.coalesce("donor_n", F.lit(0))) - F.col("h")).alias("shift"))
    kept = turns.join(shift, "conv").where("place > h").select("conv", "block", (F.col("place") + F.col("shift")).alias("place"), "x", "y", "words")
    return lent.unionByName(kept)


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running hashes and word counts of every turn (conv, depth, a, b, those before it pa, pb, words, upto), and the totals per
    conversation."""
    at = F.col("place").cast("long")
    hashed = turns.select("conv", "block", at.alias("depth"), F.xxhash64("x", at).alias("x0"), F.xxhash64(at, "y").alias("y0"), "words")
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = hashed.select("*", F.bit_xor("x0").over(inside).alias("x"), F.bit_xor("y0").over(inside).alias("y"), F.sum("words").over(inside).alias("upto"))
    sums = hashed.groupBy("conv", "block").agg(F.bit_xor("x0").alias("sx"), F.bit_xor("y0").alias("sy"), F.sum("words").alias("sw"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    offsets = sums.select("conv", "block", *[F.coalesce(f(c).over(before), none).alias(c) for f, c in ((F.bit_xor, "sx"), (F.bit_xor, "sy"), (F.sum, "sw"))])
    a, b = F.col("x").bitwiseXOR(F.col("sx")), F.col("y").bitwiseXOR(F.col("sy"))
    rows = running.join(offsets, ["conv", "block"]).select(
        "conv", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x0")).alias("pa"), b.bitwiseXOR(F.col("y0")).alias("pb"), "words",
        (F.col("upto") + F.col("sw")).alias("upto"),
    )
    totals = sums.groupBy("conv").agg(F.sum("n").alias("depth"), F.bit_xor("sx").alias("a"), F.bit_xor("sy").alias("b"), F.sum("sw").alias("total"))
    return rows, totals


def ending_lists(ends: DataFrame) -> DataFrame:
    """Per sequence (depth, a, b) the SHA-256 of its conversations in ascending order, joined by commas.

    A list is written in pieces of a range of numbers each, then the pieces are hashed one after the other as a stream.
    """
    chunk = F.shiftright("conv", CHUNK_BITS)
    pieces = ends.groupBy(*KEY, chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
            for key, piece in zip(keys, batch.column("piece").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield _digests(out)
                out = []
        if now is not None:
            yield _digests([(*now, state.hexdigest())])

    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return ordered.select(*KEY, "piece").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*KEY, "ends_sha256"])


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    none = F.lit(0).cast("long")
    turns = own_turns(df, conv_col, turn_col, role_col, text_col)
    convs = stored(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "convs")
    rows, totals = prefixes(stored(rebuilt(turns, convs), "rebuilt"))
    # Whole sequences.
    whole = convs.select("conv").join(totals, "conv", "left").select("conv", *[F.coalesce(c, none).alias(c) for c in (*KEY, "total")])
    whole = stored(whole, "whole")
    sequences = whole.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"), F.first("total").alias("total"))
    sequences = stored(sequences, "sequences")
    ends = stored(ending_lists(whole.select(*KEY, "conv")), "ends")
    # The prefixes of the sequences, each from its smallest conversation; the root is one of them.
    root = sequences.select("conv", *[none.alias(c) for c in (*KEY, "pa", "pb", "words", "upto")])
    own = rows.join(sequences.select("conv"), "conv", "left_semi").unionByName(root)
    own = own.join(sequences.select("conv", "weight", "total", F.col("depth").alias("length")), "conv")
    own = stored(own, "prefixes")
    proper = own.where("depth < length").select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("conv", F.lit(1).alias("leaf"))
    own = own.join(leaves, "conv", "left")
    nodes = stored(own.groupBy(*KEY).agg(
        F.min("conv").alias("owner"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves")
    ), "nodes")
    owned = stored(own.join(nodes.select(*KEY, "owner"), KEY), "owned")
    # A sequence owns the nodes from some depth on that no sequence of a smaller conversation passes.
    mine = F.col("owner") == F.col("conv")
    since = owned.groupBy("conv").agg(
        F.min(F.when(mine, F.col("depth"))).alias("since"), F.min(F.when(mine, F.col("upto") - F.col("words"))).alias("before"),
        F.max_by(F.when(~mine, F.col("owner")), F.when(~mine, F.col("depth"))).alias("above"),
    )
    behind = F.col("total") - (F.col("upto") - F.col("words"))
    alone = F.when(F.col("before").isNotNull(), F.col("total") - F.greatest(F.col("upto") - F.col("words"), "before")).otherwise(none)
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") > F.col("since"), F.col("conv")).otherwise(F.col("above")))
    saved = owned.join(since, "conv").groupBy(*KEY).agg(
        F.sum(F.col("weight") * behind - alone).alias("saved_tokens"), F.max(F.when(mine, parent)).alias("parent_conv_id"),
    )
    above = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = owned.where(mine & (F.col("depth") > 0)).select(*above).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    out = nodes.join(saved, KEY).join(children, KEY, "left").join(ends, KEY, "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
