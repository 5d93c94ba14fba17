"""Toxicity by class-conditional Kneser-Ney models over byte 5-grams (A-Z lower-cased).

An expression counts once per document, so that one repeating itself does not fill a model. A toxic and an ordinary model are estimated from labelled rows. Both fall back on one shared Kneser-Ney model whose counts and
continuation counts (orders 5, 4, 3) come from all documents, so that rare expressions, which either class has hardly seen, say the same
in both. A document's evidence is the difference of the two log-likelihoods over all its n-grams, also divided by its length, and beside it
what its strong n-grams (``LEAST``) say for and against; a logistic curve, fitted on labelled rows that the counts have not seen, turns it into a score.

At scale: counts are combined in the task before the shuffle and grow with the corpus's distinct n-grams; nothing of that size reaches the
driver. For n-grams that no labelled row holds the shared model cancels, so one weight per context covers them, and the table of weights
grows with the labelled sample alone (``most`` rows, their ids are broadcast). Tasks look it up in blocks of ``BLOCK`` weights, one pass over the texts per block.

Cases: null and empty texts are scored (no evidence); without toxic or ordinary labels every score is the share of toxic rows or 0.5; a
null id is scored and never learned from; repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import cut_lineage
from . import texts as T

FOLDS, HELD_OUT, TUNING = 5, 0, 4
ORDER = 5
DISCOUNT = 0.75
CLASS_DISCOUNT = 1.0  # what one document alone holds is no evidence
MASK = (1 << 40) - 1
LEAST = 3.0  # from here on an n-gram also counts as strong evidence
CONTEXT = 1 << 40  # added to the code of a context, whose weight holds for its n-grams that no labelled row has
BLOCK = 1 << 22  # weights that a task holds at once
FLUSH = 1 << 21
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of every byte n-gram; a text is preceded by spaces, so that its first byte ends an n-gram too."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    padded = np.full(len(raw) + n * (ORDER - 1), 32, np.int64)
    at = np.arange(len(raw)) + (doc + 1) * (ORDER - 1)
    padded[at] = _LOWER[raw]
    code = np.zeros(len(raw), np.int64)
    for back in range(ORDER - 1, -1, -1):
        code = (code << 8) | padded[at - back]
    return code, doc


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once; sorts in place, which costs a fraction of what ``np.unique`` takes by hashing."""
    values.sort()
    return values[np.flatnonzero(np.diff(values, prepend=values[:1] - 1))]


def count_grams(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(gram, n, n_ordinary, n_toxic) over all documents; ``classes`` (id_, class_ 1 or 2) is small and broadcast."""
    rows = documents.select(F.col("doc_id").alias("id_"), "text").join(F.broadcast(classes), "id_", "left").select("text", F.coalesce("class_", F.lit(0)).cast("long").alias("class_"))

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, times = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(keys)
            keys, first = np.unique(keys[order], return_index=True)
            return keys, np.add.reduceat(times[order], first)

        def batch(keys, times):
            return pa.RecordBatch.from_arrays([pa.array(keys >> 2), pa.array(keys & 3), pa.array(times)], names=["gram", "class_", "n"])

        held = 0
        for b in batches:
            column, cls = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("class_")).to_numpy()
            for i, j, raw, offsets in T.slices(column):
                code, doc = grams(raw, offsets)
                once = _distinct((doc << 40) | code)
                parts.append(np.unique(((once & MASK) << 2) | cls[i:j][once >> 40], return_counts=True))
                held += len(parts[-1][0])
                if held > FLUSH:
                    parts[:] = [merged()]
                    held = len(parts[0][0])
                    if held > FLUSH // 2:
                        yield batch(*parts.pop())
                        held = 0
        if parts:
            yield batch(*merged())

    got = rows.mapInArrow(run, "gram long, class_ long, n long")
    each = [F.sum(F.when(F.col("class_") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((1, "n_ordinary"), (2, "n_toxic"))]
    return got.groupBy("gram").agg(F.sum("n").alias("n"), *each)


def _context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def _shared(counts: DataFrame, order: int) -> DataFrame:
    """(gram, shared): the probability of each n-gram's last byte in the shared model; ``counts`` (gram, n) is of that order.

    Below the highest order a count is the number of different n-grams that end in this one; order 3 falls back on all bytes alike.
    """
    stats = counts.groupBy(_context(F.col("gram")).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    rows = counts.withColumn("context", _context(F.col("gram"))).join(stats, "context")
    if order > 3:
        mask = (1 << (8 * (order - 1))) - 1
        shorter = counts.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask))).join(_shared(shorter, order - 1).select(F.col("gram").alias("suffix"), F.col("shared").alias("lower")), "suffix")
    else:
        rows = rows.withColumn("lower", F.lit(1 / 256))
    return rows.select("gram", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("lower")) / F.col("total")).alias("shared"))


def evidence(counts: DataFrame) -> DataFrame:
    """(code, context, weight): log of the toxic over the ordinary probability of every n-gram, none left out.

    An n-gram that labelled rows hold has its own weight. All others of a context share one, as their shared probability cancels: it
    stands under the context (``CONTEXT`` added to its code). Where the context is unseen in both classes too, the weight is 0.
    """
    classes = ("ordinary", "toxic")
    labelled = counts.where(F.col("n_ordinary") + F.col("n_toxic") > 0).withColumn("context", _context(F.col("gram")))
    stats = labelled.groupBy("context").agg(*[f for c in classes for f in (F.sum(f"n_{c}").alias(f"total_{c}"), F.count_if(F.col(f"n_{c}") > 0).alias(f"types_{c}"))])
    rows = labelled.join(_shared(counts.select("gram", "n"), ORDER), "gram").join(stats, "context")

    def probability(c: str) -> Column:
        own = (F.greatest(F.col(f"n_{c}") - CLASS_DISCOUNT, F.lit(0.0)) + CLASS_DISCOUNT * F.col(f"types_{c}") * F.col("shared")) / F.col(f"total_{c}")
        return F.when(F.col(f"total_{c}") > 0, own).otherwise(F.col("shared"))

    def unseen(c: str) -> Column:
        return F.when(F.col(f"total_{c}") > 0, CLASS_DISCOUNT * F.col(f"types_{c}") / F.col(f"total_{c}")).otherwise(F.lit(1.0))

    own = rows.select(F.col("gram").alias("code"), "context", F.log(probability("toxic") / probability("ordinary")).alias("weight"))
    return own.unionByName(stats.select((F.col("context") + CONTEXT).alias("code"), "context", F.log(unseen("toxic") / unseen("ordinary")).alias("weight")))


def weight_blocks(table: DataFrame) -> list:
    """The weights as broadcast pairs of sorted codes and weights; block k of n has the contexts that leave k when divided by n."""
    n = max(1, -(-table.count() // BLOCK))
    blocks = []
    for k in range(n):
        part = table.where(F.col("context") % n == k).select("code", "weight").toArrow()
        code, weight = part["code"].to_numpy(), part["weight"].to_numpy()
        order = np.argsort(code)
        blocks.append(table.sparkSession.sparkContext.broadcast((code[order], weight[order])))
    return blocks


def weights_of(gram: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of each n-gram: its own, else that of its context, else 0."""
    out = np.zeros(len(gram))
    if len(codes):
        for key in ((gram >> 8) + CONTEXT, gram):
            at = np.minimum(np.searchsorted(codes, key), len(codes) - 1)
            hit = codes[at] == key
            out[hit] = weights[at[hit]]
    return out


SUMS = ("toxic", "ordinary", "all_")


def gather(documents: DataFrame, blocks: list) -> DataFrame:
    """(doc_id, size, toxic, ordinary, all_): bytes, the sums of the strong evidence for and against, and of all evidence, for every row of ``documents``."""
    kind, n = documents.schema["doc_id"].dataType, len(blocks)
    shape = StructType([StructField("row", LongType()), StructField("doc_id", kind), StructField("size", LongType()), *[StructField(k, DoubleType()) for k in SUMS]])

    def summed(k: int) -> DataFrame:
        block = blocks[k]

        def run(batches):
            for b in batches:
                rows, ids = b.column(b.schema.get_field_index("row")), b.column(b.schema.get_field_index("doc_id"))
                for i, j, raw, offsets in T.slices(b.column(b.schema.get_field_index("text"))):
                    code, doc = grams(raw, offsets)
                    if n > 1:
                        mine = (code >> 8) % n == k
                        code, doc = code[mine], doc[mine]
                    once = _distinct((doc << 40) | code)
                    code, at = once & MASK, once >> 40
                    gram = _distinct(code.copy())  # an n-gram of many documents is looked up once
                    value = weights_of(gram, *block.value)[np.searchsorted(gram, code)]
                    sums = [np.bincount(at, v, j - i).astype(float) for v in (np.where(value >= LEAST, value, 0.0), np.where(value <= -LEAST, value, 0.0), value)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.slice(i, j - i), ids.slice(i, j - i), pa.array(np.diff(offsets)), *map(pa.array, sums)], names=["row", "doc_id", "size", *SUMS]
                    )

        return documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, shape)

    found = summed(0)
    for k in range(1, n):
        found = found.unionByName(summed(k))
    if n > 1:  # a row has the same number in each pass, as all read the same parts of the same table
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), *[F.sum(c).alias(c) for c in SUMS])
    return found.drop("row")


def _inputs() -> list[Column]:
    size = F.greatest(F.col("size"), F.lit(1))
    strong = [F.log1p("toxic"), F.log1p(-F.col("ordinary")), F.log1p(F.col("size").cast("double")), 100 * (F.col("toxic") + F.col("ordinary")) / size, 100 * F.col("toxic") / size]
    return [*strong, 100 * F.col("all_") / size, F.signum("all_") * F.log1p(F.abs("all_"))]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Weights of a ridge logistic curve on standardised inputs, given back for the raw ones; the last is the intercept."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 50_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = labels.select(F.col("doc_id").alias("id_"), F.col("toxic").alias("label_")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    rows = rows.where(T.remainder("id_", FOLDS) != HELD_OUT).groupBy("id_").agg(F.max("label_").alias("label_"))
    chosen = cut_lineage(T.bounded_sample(rows, "id_", most).select("id_", (1 + (F.col("label_") > 0).cast("int")).alias("class_")))
    learned, tuned = chosen.where(T.remainder("id_", FOLDS) != TUNING), chosen.where(T.remainder("id_", FOLDS) == TUNING)

    counts = cut_lineage(count_grams(documents, learned))
    blocks = weight_blocks(cut_lineage(evidence(counts)))
    tuning = gather(documents.join(F.broadcast(tuned.select(F.col("id_").alias("doc_id"))), "doc_id", "left_semi"), blocks)
    known = tuning.join(F.broadcast(tuned), F.col("doc_id") == F.col("id_")).select("class_", F.array(*_inputs()).alias("x")).orderBy("class_", "x").limit(most).collect()
    y = np.array([float(r["class_"] == 2) for r in known])
    if 0 < y.sum() < len(y):
        w = _logistic(np.array([r["x"] for r in known]), y)
    else:
        w = np.zeros(len(_inputs()) + 1)
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    total = F.lit(float(w[-1]))
    for weight, value in zip(w[:-1], _inputs(), strict=True):
        total = total + F.lit(float(weight)) * value
    scored = gather(documents, blocks).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0)))))
    return scored.select(
        "doc_id", F.coalesce(T.remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
