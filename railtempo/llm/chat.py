"""Chat formatting over a prefix tree: initial turns that conversations share are emitted once.

Template: ``<turn>`` role ``<text>`` text ``</turn>`` newline. Inside roles and texts a backslash goes before each backslash and each ``<``,
so no control string can occur there and every text can be had back.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railtempo.llm.bpe import ByteBpe, with_bytes
from railtempo.session import checkpointed

OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"
LEARNT = "assistant"  # whose texts the loss is taken over


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, text, a, b, last): turns numbered from 0, and two 64-bit names of the prefix that ends there.

    A prefix is named by the XOR of hashes of its (position, role, text); equal prefixes of any conversation get equal names.
    """
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("last", F.lead("role").over(order).isNull())
    for name, salt in (("a", 1), ("b", 2)):
        numbered = numbered.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), "at", "role", "text")).over(
            order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered


def _encode(bpe: ByteBpe):
    @F.arrow_udf("struct<ids:array<int>,loss_begin:int,loss_end:int>")
    def encode(heads: pa.Array, bodies: pa.Array, learnt: pa.Array) -> pa.Array:
        own, out = bpe.encoding, []
        close = own.encode_ordinary(CLOSE)
        for head, body, learns in zip(heads.to_pylist(), bodies.to_pylist(), learnt.to_pylist()):
            first, inner = own.encode_ordinary(head), own.encode_ordinary(body)
            begin = len(first) if learns else 0
            out.append({"ids": first + inner + close, "loss_begin": begin, "loss_end": begin + len(inner) if learns else 0})
        return pa.array(out, pa.struct({"ids": pa.list_(pa.int32()), "loss_begin": pa.int32(), "loss_end": pa.int32()}))

    return encode


def prefix_tree(conversations: DataFrame, bpe: ByteBpe) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, leaves, members) of the conversations' prefix trees.

    * nodes: one row per different prefix, in depth-first order of ``offset``, its place in the emitted token stream: ids, length,
      position (that of its first token; it is the number of tokens before it in its conversation), loss_begin and loss_end
      (token places in ids under the loss mask, an assistant's text and nothing else), ancestors (intervals of the stream that
      its tokens attend to besides the earlier ones of the node itself).
    * leaves: one row per different conversation: leaf, n_turns, intervals of the stream that make it up, and offsets, those of
      its nodes.
    * members: conv_id and leaf.

    Turns are taken by turn, then role, then text (nulls are empty, a null turn first); repeated rows are turns of their own;
    rows without conv_id are one conversation with a null id. Other columns are not looked at. Equal conversations cost
    one path. Paths are sorted in range partitions; stream offsets come from sums per partition. A turn that many share is
    only ever counted or minimised over, and joined by name, where adaptive execution splits it.
    """
    spark = conversations.sparkSession
    turns = _turns(conversations)
    names = checkpointed(turns.select("conv_id", "at", "a", "b", "last"))
    members = names.filter("last").select("conv_id", "a", "b", (F.col("at") + 1).alias("n_turns"))
    chosen = members.groupBy("a", "b").agg(F.min(F.struct("conv_id")).alias("one")).select(
        F.col("one.conv_id").alias("own"), F.col("a").alias("leaf_a"), F.col("b").alias("leaf_b"))
    paths = names.join(chosen, names["conv_id"].eqNullSafe(chosen["own"])).groupBy("leaf_a", "leaf_b").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "a", "b"))), lambda x: F.struct(x["a"], x["b"])).alias("path"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = checkpointed(paths.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn(
        "rank", F.monotonically_increasing_id()))
    steps = ranked.select("rank", F.posexplode("path").alias("at", "node")).select("rank", "at", F.col("node.a").alias("a"), F.col("node.b").alias("b"))
    owners = steps.groupBy("a", "b").agg(F.min("rank").alias("owner"), F.first("at").alias("at"))

    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    coded = turns.select("a", "b", "role", "text").dropDuplicates(["a", "b"]).select(
        F.col("a").alias("x"), F.col("b").alias("y"), _encode(bpe)(head, escaped(F.col("text")), F.col("role") == LEARNT).alias("t"))
    # the rank's upper bits are the range partition in which its path was sorted
    sized = checkpointed(owners.join(coded, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select(
        "a", "b", "at", "owner", F.shiftright("owner", 33).alias("part"), "t.*", F.size("t.ids").cast("bigint").alias("length")))
    totals = sized.groupBy("part").agg(F.sum("length").alias("total"))  # a row per range partition
    starts = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("start"))
    emission = Window.partitionBy("part").orderBy("owner", "at")
    placed = sized.join(F.broadcast(starts), "part").withColumn("offset", F.col("start") + F.sum("length").over(emission) - F.col("length"))
    nodes = checkpointed(placed.drop("start", "part"))

    along = steps.join(nodes.select(F.col("a").alias("x"), F.col("b").alias("y"), "owner", "offset", "length"), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
    # what a conversation shares with one earlier path is one run of the stream
    runs = along.groupBy("rank", "owner").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sum("length").alias("tokens"),
        F.sort_array(F.collect_list("offset")).alias("offsets"))
    interval = F.struct("begin", "end")
    whole = runs.groupBy("rank").agg(
        F.sort_array(F.collect_list(interval)).alias("intervals"), F.flatten(F.transform(F.sort_array(F.collect_list(
            F.struct("begin", "offsets"))), lambda r: r["offsets"])).alias("offsets"),
        F.sort_array(F.collect_list(F.when(F.col("owner") != F.col("rank"), interval))).alias("shared"),
        F.coalesce(F.sum(F.when(F.col("owner") != F.col("rank"), F.col("tokens"))), F.lit(0)).alias("shared_tokens"),
        F.min(F.when(F.col("owner") == F.col("rank"), F.col("begin"))).alias("own_begin"))
    whole = checkpointed(whole)
    attached = nodes.join(whole.select(F.col("rank").alias("owner"), "shared", "shared_tokens", "own_begin"), "owner")
    before = F.col("offset") - F.col("own_begin")
    own = F.when(before > 0, F.array(F.struct(F.col("own_begin").alias("begin"), F.col("offset").alias("end")))).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    out = attached.select(
        "offset", "length", (F.col("shared_tokens") + before).alias("position"), "ids", "loss_begin", "loss_end", F.concat("shared", own).alias("ancestors"))
    leaf = ranked.select("rank", "leaf_a", "leaf_b", F.size("path").cast("bigint").alias("n_turns"))
    leaves = leaf.join(whole, "rank").select(F.col("rank").alias("leaf"), "n_turns", "intervals", "offsets")
    joined = members.join(leaf.drop("n_turns"), (F.col("a") == F.col("leaf_a")) & (F.col("b") == F.col("leaf_b")))
    return out, leaves, joined.select("conv_id", F.col("rank").alias("leaf"))


def read_back(nodes: DataFrame, leaves: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(leaf, turns, formatted_chars) with turns of (position, role, text, loss) in order: decoded from the emitted tokens alone.
    ``loss`` is the text under the loss mask, null without any."""
    learns = F.col("loss_end") > F.col("loss_begin")
    masked = F.when(learns, F.slice("ids", F.col("loss_begin") + 1, F.col("loss_end") - F.col("loss_begin")))
    decoded = with_bytes(with_bytes(nodes.withColumn("masked", masked), bpe, "ids", "bytes"), bpe, "masked", "masked_bytes").select(
        "offset", "position", F.col("bytes").cast("string").alias("turn"), F.col("masked_bytes").cast("string").alias("masked"))
    inner = F.expr(f"substring(turn, {len(OPEN) + 1}, length(turn) - {len(OPEN) + len(CLOSE)})")
    split = F.instr(inner, MIDDLE)
    texts = decoded.withColumn("inner", inner).withColumn("cut", split).select(
        "offset", F.struct(
            "position", unescaped(F.expr("substring(inner, 1, cut - 1)")).alias("role"),
            unescaped(F.expr(f"substring(inner, cut + {len(MIDDLE)})")).alias("text"), unescaped(F.col("masked")).alias("loss")).alias("turn"),
        F.length("turn").cast("bigint").alias("chars"))
    path = leaves.select("leaf", F.explode("offsets").alias("offset"))
    return path.join(texts, "offset").groupBy("leaf").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"), F.sum("chars").alias("formatted_chars"))


def digests(conversations: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read back from the tree."""
    nodes, leaves, members = prefix_tree(conversations, bpe)
    nodes = checkpointed(nodes)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")  # nulls are left out
    # written out: with a shuffle of its own on either side, the join below splits a conversation that very many repeat
    read = checkpointed(read_back(nodes, leaves, bpe).select(
        "leaf", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"))
    return members.join(read, "leaf").drop("leaf")
