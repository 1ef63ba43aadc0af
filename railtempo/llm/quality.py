"""Compression classifier: texts compress better with a dictionary of texts like them."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512  # bytes compressed at a time, so that a text's own repetitions hide little of what the dictionary gives


@dataclass
class QualityModel:
    """Dictionaries of bad and good text, and what turns the difference of sizes into the probability of good."""

    bad: bytes
    good: bytes
    center: float
    spread: float
    offset: float
    slope: float

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """Per whole text the normalised difference of its sizes with either dictionary: the larger, the more it is like good text. Null
        counts as empty."""
        with_bad, with_good = _compressor(self.bad), _compressor(self.good)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            b = g = 0
            for at in range(0, max(1, len(raw)), BLOCK):
                block = raw[at:at + BLOCK]
                b += len(with_bad.compress(block))
                g += len(with_good.compress(block))
            out[i] = (b - g) / (b + g)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.offset + self.slope * (self.differences(texts) - self.center) / self.spread)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _compressor(dictionary: bytes, level: int = 3) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary)
    own.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


def blocks_of(texts: list[str]) -> list[bytes]:
    """The different blocks of whole texts, in the order of the texts."""
    raws = (text.encode() for text in texts)
    return list(dict.fromkeys(raw[at:at + BLOCK] for raw in raws for at in range(0, len(raw), BLOCK)))


def dictionary(blocks: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on all blocks; of too few blocks for training, these blocks."""
    try:
        # all blocks are trained on: by default a quarter would only choose between settings
        return zstandard.train_dictionary(size, [b for b in blocks if len(b) >= 8], d=8, steps=4, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size].ljust(64, b"-")


def digest(blocks: list[bytes], size: int) -> list[bytes]:
    """What blocks have in common, as blocks of at most ``size`` bytes in all; fewer bytes are kept as they are."""
    if sum(map(len, blocks)) <= size:
        return blocks
    common = dictionary(blocks, size)
    return [common[at:at + BLOCK] for at in range(BLOCK, len(common), BLOCK)]  # the first block holds a dictionary's code tables


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Newton steps, halved until the penalised loss falls; row i weighs ``n[i]``."""
    w = np.zeros(x.shape[1])

    def loss(v):
        m = x @ v
        return (n * np.logaddexp(0, -np.where(y > 0, m, -m))).sum() + ridge * (v @ v) / 2

    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        scale, now = 1.0, loss(w)
        while scale > 1e-6 and loss(w - scale * step) > now:
            scale /= 2
        w -= scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return w


def _dictionaries(
    texts: DataFrame, known: DataFrame, part: Column, parts: int, size: int, folds: int, digest_bytes: int, fan: int,
) -> dict[tuple[int, int], bytes]:
    """Per label and fold the dictionary of all ``texts`` (doc_id, text) ``known`` (doc_id, quality) to have the label, but the fold's;
    fold ``folds`` leaves none out. Labels without any text are missing.

    Texts meet their labels in ``parts`` (column ``part``, of a fold each). What a part has of a label is digested to ``digest_bytes``,
    and ``fan`` digests of a fold together to one again, until no more than ``fan`` are left. So texts are shuffled once, no task trains
    on more than a part or ``fan * folds`` digests, however many texts there are, and every byte of every labelled text has been
    trained on.
    """
    schema = "quality int, fold int, part bigint, blocks array<binary>"

    def table_of(rows: list[tuple]) -> pa.Table:
        types = [("quality", pa.int32()), ("fold", pa.int32()), ("part", pa.int64()), ("blocks", pa.list_(pa.binary()))]
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(types)})

    def digested(key: tuple, labelled: pa.Table, part: pa.Table) -> pa.Table:
        out = []
        for q in (0, 1):
            ids = labelled.filter(pc.equal(labelled.column("quality"), q)).column("doc_id")
            own = part.filter(pc.is_in(part.column("doc_id"), value_set=ids.combine_chunks()))
            if own.num_rows:
                at, fold = divmod(key[0].as_py(), folds)
                out.append((q, fold, at, digest(blocks_of(sorted(own.column("text").to_pylist())), digest_bytes)))
        return table_of(out)

    def in_order(rows: pa.Table) -> list[bytes]:
        parts = rows.sort_by([("fold", "ascending"), ("part", "ascending")]).column("blocks").to_pylist()
        return list(dict.fromkeys(b for part in parts for b in part))

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        return table_of([(*(k.as_py() for k in key), digest(in_order(rows), digest_bytes))])

    def final(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"quality": pa.array([key[0].as_py()], pa.int32()), "left": pa.array([key[1].as_py()], pa.int32()),
                         "bytes": pa.array([dictionary(in_order(rows), size)])})

    found = known.select("doc_id", "quality", part.alias("part")).groupBy("part").cogroup(
        texts.select("doc_id", "text", part.alias("part")).groupBy("part")).applyInArrow(digested, schema)
    parts //= folds
    while parts > fan:
        found = found.withColumn("into", F.floor(F.col("part") / fan)).groupBy("quality", "fold", "into").applyInArrow(joined, schema)
        parts = -(-parts // fan)
    left_out = found.withColumn("left", F.explode(F.sequence(F.lit(0), F.lit(folds)))).filter("left <> fold")
    rows = left_out.groupBy("quality", "left").applyInArrow(final, "quality int, left int, bytes binary").collect()
    return {(r["quality"], r["left"]): bytes(r["bytes"]) for r in rows}


def train(
    docs: DataFrame, labels: DataFrame, dictionary_bytes: int = 32_768, folds: int = 4, part_bytes: int = 1 << 23, digest_bytes: int = 1 << 20,
    fan: int = 4,
) -> QualityModel:
    """Learns from all bytes of all texts with a label.

    Dictionaries are trained on parts of about ``part_bytes`` of ``docs`` and joined (``_dictionaries``). The calibration is a logistic curve over the
    difference of sizes, its only input, which never falls; it is fitted to the differences of all rows by dictionaries made without
    their fold (a hash of the id decides), counted by ten-thousandths, either label weighing half. Only these counts and
    ``2 * (folds + 1)`` dictionaries are collected. The calibration is set to the share of good among all ``labels`` rows given. Rows
    with a null label, id or text are passed over. With only one label, or none, the score is that label's share (0.5 without any).
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    parts = folds * max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (folds * part_bytes)))
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(parts)).cast("bigint")  # its remainder by ``folds`` is the fold
    found = _dictionaries(texts, known, part, parts, dictionary_bytes, folds, digest_bytes, fan)

    def without(fold: int) -> QualityModel:
        """The model of all folds but one; a label without texts in any other fold keeps all its texts."""
        whole = (found.get((q, folds), dictionary([], dictionary_bytes)) for q in (0, 1))
        return QualityModel(*(found.get((q, fold), w) for q, w in enumerate(whole)), 0.0, 1.0, 0.0, 0.0)

    model, total = without(folds), sum(counts.values())
    if len({q for q, _ in found}) < 2:
        share = (counts.get(1, 0) + 1) / (total + 2)
        model.offset = float(np.log(share / (1 - share)))
        return model
    others = [without(fold) for fold in range(folds)]

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, other in enumerate(others):
                part = batch.filter(pc.equal(batch.column("fold"), fold))
                x = pa.array(other.differences(part.column("text").to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), x], ["doc_id", "x"])

    # scored before they meet their labels, so that no text is shuffled again
    seen = texts.select("doc_id", "text", (part % folds).alias("fold")).mapInArrow(differences, known.select("doc_id", F.lit(0.0).alias("x")).schema)
    rows = seen.join(known, "doc_id").groupBy("quality", F.round(F.col("x") * 10_000).cast("int").alias("at")).agg(
        F.count("*").alias("n")).orderBy("quality", "at").collect()
    x, y, n = (np.array([r[c] for r in rows], dtype=float) for c in ("at", "quality", "n"))
    x /= 10_000
    n *= n.sum() / 2 / np.where(y > 0, n[y > 0].sum(), n[y == 0].sum())
    model.center = float((n * x).sum() / n.sum())
    model.spread = float(np.sqrt((n * (x - model.center) ** 2).sum() / n.sum())) + 1e-9
    offset, slope = _logistic(np.column_stack([np.ones(len(x)), (x - model.center) / model.spread]), y, n).tolist()
    model.offset = offset + float(np.log(counts[1] / counts[0]))
    model.slope = max(0.0, slope)
    return model


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the calibrated probability (0 to 1) that a whole text is good; null and empty texts are scored as empty.

    Rows are scored one by one: repeated rows and rows without id stay as they are. A column named ``into`` is replaced, all others stay.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(batch.to_pylist()), pa.float64())

    return docs.withColumn(into, score(F.col(text)))


def held_out(id_column: str):
    """Whether a document belongs to the fifth that training never sees."""
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0
