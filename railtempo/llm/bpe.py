"""Byte-level BPE over chunks of texts, equal to encoding each whole text."""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

class ByteBpe:
    """A rank table (as bytes of lines "base64 rank") and the pattern of its pre-tokens; travels to tasks by value."""

    def __init__(self, lines: bytes, pattern: str):
        self.lines, self.pattern = lines, pattern

    @classmethod
    def load(cls, path: str, pattern: str) -> "ByteBpe":
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def __getstate__(self):
        return {"lines": self.lines, "pattern": self.pattern}  # tasks build their own encoder

    def _ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.lines.splitlines() if line)}

    @property
    def encoding(self) -> tiktoken.Encoding:
        if "built" not in self.__dict__:
            self.built = tiktoken.Encoding("byte-bpe", pat_str=self.pattern, mergeable_ranks=self._ranks(), special_tokens={})
        return self.built

    @property
    def table(self) -> dict[int, bytes]:
        """The bytes of each id."""
        if "bytes_of" not in self.__dict__:
            self.bytes_of = {rank: raw for raw, rank in self._ranks().items()}
        return self.bytes_of

    def boundaries(self, text: str, begin: int, end: int) -> list[int]:
        """Where pre-tokens end in ``text`` between two places, counting from its start."""
        # this module's white space is Unicode's, as in the encoder
        return [m.end() for m in regex.finditer(self.pattern, text) if begin <= m.end() <= end]


def _encode_udf(bpe: ByteBpe):
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = bpe.encoding
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 256):  # numbers are kept as 32-bit arrays, never as Python lists
                ids = [own.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in batch.slice(at, 256).to_pylist()]
                places = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(places, np.concatenate(ids).astype(np.int32)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode


def with_ids(
    docs: DataFrame, bpe: ByteBpe, text: str = "text", into: str = "ids", chunk: int = 32_768, overlap: int = 1_024,
) -> DataFrame:
    """Adds the token ids of each whole text (null or empty: no ids).

    Texts up to ``chunk`` characters are one chunk. Longer ones are cut into chunks that run ``overlap`` characters into the next and
    are spread over the cluster; each chunk is pre-tokenised by itself. What a match is depends only on the text from its
    start on, so from the first boundary that two neighbours share in their overlap, both agree: there they are
    stitched, and the pieces between stitches are encoded. A text with an overlap without common boundary (one pre-token
    longer than it) is encoded as one piece. Copies of a long text are encoded once.
    """
    short = F.coalesce(F.length(text), F.lit(0)) <= chunk
    encode = _encode_udf(bpe)
    marked = docs.withColumn("_key", F.when(~short, F.sha2(text, 256)))
    once = marked.filter("_key is null").withColumn(into, encode(F.col(text)))
    pieces = long_pieces(docs.filter(~short).select(F.col(text).alias("text")), bpe, chunk, overlap)
    long_ids = pieces.withColumn("ids", encode("piece")).groupBy("key").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"])).alias("_ids"))
    many = marked.filter("_key is not null").join(long_ids.withColumnRenamed("key", "_of"), F.col("_key") == F.col("_of")).select(*(c for c in docs.columns if c != into), F.col("_ids").alias(into))
    return once.select(*(c for c in docs.columns if c != into), into).union(many)


def long_pieces(texts: DataFrame, bpe: ByteBpe, chunk: int, overlap: int) -> DataFrame:
    """(key, part, piece): different long texts cut at pre-token boundaries; key is the SHA-256 of the whole text."""
    # a text travels once per chunk inside its row's task only: the cut is made right behind the explode
    cut = texts.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"]).select(
        "key", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("part")).select(
        "key", "part", F.substring("text", F.col("part") * chunk + 1, F.lit(chunk + overlap)).alias("piece"))
    spread = cut.repartition("key", "part")

    inner = overlap - 4  # a contraction cut off by a chunk's end may leave a false boundary there

    @F.arrow_udf("struct<head:array<int>,tail:array<int>>")
    def ends(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [{"head": bpe.boundaries(t, 1, inner), "tail": [b - chunk for b in bpe.boundaries(t, chunk + 1, chunk + inner)]}
                    for t in batch.to_pylist()]
            yield pa.array(rows, pa.struct({"head": pa.list_(pa.int32()), "tail": pa.list_(pa.int32())}))

    whole = Window.partitionBy("key")
    order = whole.orderBy("part")
    begin = F.when(F.col("part") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("ends.tail").over(order), "ends.head")))
    placed = spread.withColumn("ends", ends("piece")).withColumn("begin", begin).withColumn("until", F.lead("begin").over(order)).withColumn(
        "last", F.lead("part").over(order).isNull()).withColumn("broken", F.max(F.col("begin").isNull()).over(whole))
    inside = F.when(F.col("broken"), F.when(F.col("last"), F.col("piece")).otherwise(F.substring("piece", F.lit(1), F.lit(chunk)))).when(
        F.col("last"), F.expr("substring(piece, begin + 1)")).otherwise(F.expr(f"substring(piece, begin + 1, {chunk} + until - begin)"))
    # rows of a key lie together already: joining the chunks of a text that could not be stitched takes no shuffle
    joined = placed.groupBy("key", F.when(F.col("broken"), 0).otherwise(F.col("part")).alias("to")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("part", inside.alias("p")))), lambda x: x["p"]), "").alias("piece"))
    return joined.select("key", F.col("to").alias("part"), "piece").repartition("key", "part")


def with_bytes(df: DataFrame, bpe: ByteBpe, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes that ids stand for, joined without any repair (null ids: null)."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = bpe.table
        for batch in batches:
            yield pa.array([b"".join(map(table.__getitem__, x.values.to_pylist())) if x.is_valid else None for x in batch], pa.binary())

    return df.withColumn(into, decode(F.col(ids)))
