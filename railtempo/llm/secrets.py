"""Secret scan: long key-like strings, and a random forest that removes the false positives. DataFrame functions only.

Features of a candidate: its length, transitions between kinds of character, the share of it that a dictionary of word trigrams covers,
signs of a path, and the words next to it.
"""

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtempo.session import checkpointed

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
MARK = "[SECRET]"
BEFORE, AFTER = 48, 24  # characters of context looked at

# words that name credentials
NAMED = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)"
FEATURES = ["length", "transitions", "digits", "uppers", "distinct", "hexadecimal", "coverage", "slashes", "in_path", "named", "assigned",
            "quoted", "word_before"]


def candidates(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, value, before, after, occurrence): every occurrence of a key-like string in each whole text, what stands around it, and its number."""
    found = docs.select(
        *keys, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_values"), F.split(text, CANDIDATE, -1).alias("_between"))
    one = found.select(*keys, "_values", "_between", F.posexplode("_values").alias("occurrence", "value"))

    def at(name: str, step: int) -> str:
        return f"coalesce(get({name}, occurrence + {step}), '')"

    # a value has 16 characters or more, so three before and two after fill the context
    left = ", ".join([f"{at('_values', -k)}, {at('_between', 1 - k)}" for k in (3, 2, 1)])
    right = f"{at('_between', 1)}, {at('_values', 1)}, {at('_between', 2)}, {at('_values', 2)}"
    return one.select(
        *keys, "value", F.expr(f"right(concat({left}), {BEFORE})").alias("before"), F.expr(f"left(concat({right}), {AFTER})").alias("after"), "occurrence")


def _kinds(value: str) -> Column:
    """A letter for each character's kind: lower case a, upper case A, digit 0, others as they are."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")


def _trigrams(word: Column) -> Column:
    """Numbers (base 26) of the letter trigrams of a lower-case string; -1 where one holds anything else. One pass: a substring at a place
    reads all that stands before it."""
    def number(three):
        codes = [F.ascii(F.substring(three, k, 1)) - 97 for k in (1, 2, 3)]
        inside = (F.least(*codes) >= 0) & (F.greatest(*codes) < 26)
        return F.when(inside, codes[0] * 676 + codes[1] * 26 + codes[2]).otherwise(-1)

    overlapping = F.regexp_extract_all(word, F.lit(r"(?s)(?=(.{3}))."), F.lit(1))
    return F.when(F.coalesce(F.length(word), F.lit(0)) < 3, F.array(F.lit(-1))).otherwise(F.transform(overlapping, number))


def dictionary(docs: DataFrame, text: str = "text", at_least: int = 20, per_docs: int = 4_000) -> list[int]:
    """Bit set (275 longs for the 26 ** 3 trigrams) of letter trigrams that occur ``at_least`` times in words of ``docs``; over more than
    ``per_docs`` documents so often in each ``per_docs``, so that rare ones stay rare however many documents there are."""
    at_least = max(at_least, at_least * docs.count() // per_docs)
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,15}"), F.lit(0))).alias("w"))
    often = words.groupBy("w").count().select("count", F.explode(_trigrams(F.col("w"))).alias("t")).groupBy("t").agg(
        F.sum("count").alias("n")).filter(f"n >= {at_least} and t >= 0")
    bits = often.groupBy(F.expr("shiftright(t, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, t & 63))").alias("word")).collect()
    held = {r["at"]: r["word"] for r in bits}
    return [held.get(i, 0) for i in range(26 ** 3 // 64 + 1)]


def with_features(found: DataFrame, words: list[int]) -> DataFrame:
    """Adds the columns FEATURES."""
    value, n = F.col("value"), F.length("value")
    grams = _trigrams(F.lower(value))
    known = F.array(*(F.lit(w) for w in words))
    covered = F.size(F.filter(F.col("_grams"), lambda g: (g >= 0) & (F.shiftrightunsigned(
        F.get(F.col("_known"), F.shiftright(g, 6)), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), g.bitwiseAND(F.lit(63)))) != 0)))
    kinds = F.col("_kinds")
    frame = found.withColumn("_known", known).withColumn("_grams", grams).withColumn("_kinds", _kinds("value"))
    columns = {
        "length": n, "transitions": 1 - F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "digits": F.regexp_count(kinds, F.lit("0")) / n, "uppers": F.regexp_count(kinds, F.lit("A")) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hexadecimal": value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "coverage": covered / F.size("_grams"), "slashes": F.regexp_count(value, F.lit("/")) / n,
        "in_path": (F.col("before").rlike(r"[./\\@]$") | F.col("after").rlike(r"^[./\\@]\w")).cast("int"),
        "named": F.col("before").rlike(NAMED + r"\w{0,12}\W{0,5}$").cast("int"), "assigned": F.col("before").rlike(r"[=:]\s?[\"']?$").cast("int"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"'!.,;]")).cast("int"),
        "word_before": F.length(F.regexp_extract("before", r"(\w*)\W*$", 1)),
    }
    return frame.select("*", *(c.cast("double").alias(f"_f_{k}") for k, c in columns.items())).drop("_known", "_grams", "_kinds")


def labelled(found: DataFrame) -> Column:
    """Label of a finding where no reviewer gave one: 1 for a string that is assigned to a credential's name and is not made of words."""
    named = F.col("before").rlike(NAMED + r"\w{0,12}\s{0,2}[=:]\s{0,2}[\"']?$")
    return (named & F.col("value").rlike("[0-9]") & (F.regexp_count("value", F.lit("[0-9]")) * 8 >= F.length("value"))).cast("int")


@dataclass
class SecretModel:
    forest: PipelineModel | None
    words: list[int]


def train(docs: DataFrame, findings: DataFrame | None = None, trees: int = 24, depth: int = 6) -> SecretModel:
    """Fits the forest on all true and false findings; both labels weigh the same, however many there are of each.

    ``findings`` has value, before, after and label (0 or 1), as a review leaves them. Without it, the findings of all whole texts are
    labelled by rule (``labelled``). The dictionary of trigrams is counted over all documents. With no findings, or of one label only,
    there is no forest and the rule decides.
    """
    words = dictionary(docs.select("text"))
    if findings is None:
        found = candidates(docs.select("text").withColumn("k", F.lit(0)), ["k"])
        findings = found.withColumn("label", labelled(found))
    known = findings.filter("label in (0, 1) and value is not null").select(
        "value", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "label").distinct()
    rows = checkpointed(with_features(known, words).select(F.col("label").cast("double").alias("label"), *(f"_f_{k}" for k in FEATURES)))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if counts.keys() != {0.0, 1.0}:
        return SecretModel(None, words)
    rows = rows.withColumn("_weight", sum(counts.values()) / 2 / F.when(F.col("label") == 1, counts[1.0]).otherwise(counts[0.0]))
    forest = Pipeline(stages=[
        VectorAssembler(inputCols=[f"_f_{k}" for k in FEATURES], outputCol="_features"),
        RandomForestClassifier(labelCol="label", weightCol="_weight", featuresCol="_features", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted",
                               numTrees=trees, maxDepth=depth, seed=11)]).fit(rows)
    return SecretModel(forest, words)


def scan(docs: DataFrame, model: SecretModel, keys: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(keys, value, before, after, score): the candidates of all whole texts that the forest takes for secrets.

    Null, empty and word-only texts have none. Every occurrence is scored; a string that occurs several times in a text is one
    finding, with the largest score and what stands around the first place that has it. Repeated rows give repeated findings. Only the keys and the text are looked at, so columns of any other name may be there.
    """
    renamed = docs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(text).alias("_t"), F.xxhash64(text).alias("_text_hash"))
    names = [f"_k{i}" for i in range(len(keys))]
    own = [*names, "_text_hash"]
    found = candidates(renamed, own, "_t")
    if model.forest is None:
        scored = found.withColumn("score", labelled(found).cast("double"))
    else:
        scored = model.forest.transform(with_features(found, model.words)).withColumn("score", vector_to_array("_probability")[1])
    taken = scored.filter(F.col("score") >= threshold)
    # repeated rows repeat each occurrence as often as they are there
    times = taken.groupBy(*own, "value", "before", "after", "occurrence", "score").agg(F.count("*").cast("int").alias("_times"))
    best = times.groupBy(*own, "value").agg(F.max(F.struct("score", -F.col("occurrence"), "before", "after", "_times")).alias("_best"))
    return best.withColumn("_again", F.explode(F.expr("sequence(1, _best._times)"))).select(
        *(F.col(n).alias(k) for n, k in zip(names, keys)), "value", "_best.before", "_best.after", "_best.score")


def redacted(docs: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """All documents, with every occurrence of each secret in their texts replaced by MARK; n_chars, if there, follows.

    Texts that hold a secret are told apart by id and text, so documents without id are treated one by one.
    """
    hashed = docs.withColumn("_hash", F.xxhash64(text))
    found = scan(hashed, model, ["doc_id", "_hash"], text).groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_secret")).agg(
        F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("_found"))
    both = hashed.join(found, hashed["doc_id"].eqNullSafe(found["_id"]) & (hashed["_hash"] == found["_secret"]), "left")
    cleaned = F.when(F.col("_found").isNotNull(), F.aggregate("_found", F.col(text), lambda t, v: F.replace(t, v, F.lit(MARK)))).otherwise(F.col(text))
    columns = [F.length(cleaned).cast("bigint").alias(c) if c == "n_chars" else cleaned.alias(c) if c == text else F.col(c) for c in docs.columns]
    return both.select(*columns)
