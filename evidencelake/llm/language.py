"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

A text's features are its words' character 1-, 2- and 3-grams (lower case, word ends marked), hashed into a fixed
number of buckets; a value is the n-gram's share of the text times its inverse document frequency over all learnable
documents. Follow-the-regularised-leader updates with elastic-net penalties are run in shards over a sample of
bounded expected size for each language, and averaged; a temperature, fitted on further sampled rows, calibrates the
scores. Prediction reads every text once, without a shuffle.

Defined results: a null text or one without a letter is `und` with score 0; without any learnable row all texts are;
a null doc_id is predicted, never learnt from; repeated rows get equal results; an empty table gives no row. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import common

BUCKETS = 1 << 16
#: Rows of each language that are learnt from, in expectation; a tenth as many fit the temperature.
ROWS_PER_LANGUAGE = 3_000
#: Rows that a shard learns from, about.
SHARD_ROWS, EPOCHS = 2_000, 5
ALPHA, BETA, L1, L2 = 0.5, 0.05, 1e-4, 1e-4
UNKNOWN = "und"


def word_ngrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of each character n-gram of the words."""
    spaced = " " + " ".join(pc.utf8_lower(words).to_pylist()) + " "
    points = np.frombuffer(spaced.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    space = points == 32
    word = np.cumsum(space) - 1
    first, second, third = points[:-2], points[1:-1], points[2:]
    with np.errstate(over="ignore"):
        # by the middle sign: the sign alone, with the one before, with the one after, with both
        inside = np.flatnonzero(~space[1:-1])
        a, b, c = first[inside], second[inside], third[inside]
        two, three = np.uint64(1 << 21), np.uint64(1 << 42)
        ends = c == 32
        keys = np.concatenate([b, a + two * b, (b + two * c)[ends], a + two * b + three * c])
        kind = np.concatenate([np.full(len(b), 1), np.full(len(b), 2), np.full(int(ends.sum()), 2), np.full(len(b), 3)]).astype(np.uint64)
        bucket = common.mix(keys * np.uint64(4) + kind) & np.uint64(BUCKETS - 1)
    owner = word[inside + 1]
    return np.concatenate([owner, owner, owner[ends], owner]), bucket.astype(np.int64)


def _by_word(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, one word after another, and where each word's begin."""
    owner, bucket = word_ngrams(words)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def text_buckets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The buckets of all n-gram occurrences of each text."""
    offsets, codes, words = common.split_words(texts)
    if not len(words):
        yield from (np.empty(0, np.int64) for _ in range(len(texts)))
        return
    bucket, begin = _by_word(words)
    size = np.diff(begin)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = codes[a:b]
        many = size[own]
        yield bucket[np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all the texts each bucket occurs; at most BUCKETS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in common.slices(batches):
            for buckets in text_buckets(batch["text"]):
                seen = np.zeros(BUCKETS, dtype=bool)
                seen[buckets] = True
                total[np.flatnonzero(seen)] += 1
            rows += batch.num_rows
        total[BUCKETS] = rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in counted.collect():
        found[r["bucket"]] = r["n"]
    return found[:BUCKETS], int(found[BUCKETS])


def sparse(buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, many = np.unique(buckets, return_counts=True)
    return np.append(at, BUCKETS), np.append(many / max(len(buckets), 1) * idf[at], 1.0)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int) -> np.ndarray:
    """Multinomial FTRL-proximal with elastic-net penalties; a row of class weights for each bucket, the bias last."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    for _ in range(epochs):
        for at, x, label in examples:
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return _weights(z, n)


def logits(texts: pa.Array, scaled: np.ndarray) -> np.ndarray:
    """Class logits of each text; `scaled` holds weights times inverse document frequencies, the bias last."""
    offsets, codes, words = common.split_words(texts)
    out = np.tile(scaled[BUCKETS], (len(texts), 1)).astype(np.float64)
    if len(words):
        bucket, begin = _by_word(words)
        sums = np.add.reduceat(scaled[bucket], begin[:-1], axis=0)  # every word has n-grams
        filled = np.flatnonzero(np.diff(offsets))
        per_text = np.add.reduceat(sums[codes], offsets[:-1][filled], axis=0)
        grams = np.add.reduceat(np.diff(begin)[codes], offsets[:-1][filled])
        out[filled] += per_text / grams[:, None]
    return out


class Model:
    def __init__(self, languages: list[str], scaled: np.ndarray, temperature: float):
        self.languages, self.scaled, self.temperature = languages, scaled.astype(np.float32), temperature

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = logits(texts, self.scaled) / self.temperature
        found = np.exp(found - found.max(axis=1, keepdims=True))
        return found.argmax(axis=1), found.max(axis=1) / found.sum(axis=1)


def _temperature(found: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        x = found / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, *, usable: Column | None = None, rows: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of the languages in `lang`, or None if no row can be learnt from."""
    common.prepare(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & usable)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    numbers = {lang: i for i, lang in enumerate(languages)}
    df, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + df)) + 1.0
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.1 * rows / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) / 1_000_000
    label = F.create_map(*(F.lit(x) for lang in languages for x in (lang, numbers[lang])))
    sample = known.filter(draw < share[F.col("lang")]).withColumn("label", label[F.col("lang")])
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(11))  # one in eleven fits the temperature
    classes = len(languages)

    def train(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(common.mix(table["doc_id"].to_numpy().astype(np.uint64)), kind="stable")))
        examples = []
        for batch in common.slices(iter(table.combine_chunks().to_batches())):
            for buckets, number in zip(text_buckets(batch["text"]), batch["label"].to_pylist(), strict=True):
                examples.append((*sparse(buckets, idf), number))
        weights = follow_the_leader(examples, classes, EPOCHS)
        used = np.flatnonzero(np.append((weights[:BUCKETS] != 0).any(axis=1), True))
        return pa.table({"bucket": used, "weights": list(weights[used])})

    shards = max(1, round(sum(min(n, rows) for n in counts.values()) / SHARD_ROWS))
    sharded = sample.filter(part > 0).select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(shards)).alias("shard"))
    learnt = sharded.groupBy("shard").applyInArrow(train, "bucket long, weights array<double>")
    summed = learnt.select("bucket", F.posexplode("weights").alias("class", "w")).groupBy("bucket", "class").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    scaled = np.zeros((BUCKETS + 1, classes))
    found = summed.collect()  # at most BUCKETS rows for each language
    trained = max(r["n"] for r in found) if found else 1  # every shard reports its bias
    for r in found:
        scaled[r["bucket"], r["class"]] = r["w"] / trained
    scaled[:BUCKETS] *= idf[:, None]
    small = scaled.astype(np.float32)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(list(logits(batch["text"], small)), pa.list_(pa.float64()))], ["label", "logits"])

    rest = sample.filter(part == 0).select("text", "label").mapInArrow(judge, "label int, logits array<double>").collect()
    temperature = _temperature(np.array([r["logits"] for r in rest]), np.array([r["label"] for r in rest])) if rest else 1.0
    return Model(languages, scaled, temperature)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    narrow = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return narrow.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in common.slices(batches):
            best, score = model.predict(batch["text"])
            letters = batch["letters"].to_numpy(zero_copy_only=False)
            best = np.where(letters, best, len(model.languages))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"]
            )

    schema = narrow.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    return narrow.mapInArrow(run, schema)


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32(doc_id) leaves 2 by division by 4 are never learnt from."""
    model = fit(docs, usable=common.crc_remainder("doc_id", 4) != 2)
    held_out = F.coalesce(common.crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held_out, "lang_pred", "score")
