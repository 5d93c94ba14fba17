"""Near-duplicates by SetSketch registers: exponentially spaced, truncated minima of word shingles.

1. Every whole text becomes its set of shingles, a content key and ``REGISTERS`` register values. Documents with equal sets are one node
   from here on, however many they are (combined on the map side).
2. Bands of ``WIDTH`` registers give buckets. In each bucket the member that shares most buckets leads, and all others are compared with
   it: one pair per member, not all pairs. Sets that differ from one original thus meet the original.
3. A pair's registers and set sizes give the likelihood estimate of its similarity; what is ``MARGIN`` below the threshold is left out
   (more than five standard errors), the rest is decided on the full sets.
4. Components of the links. Members of buckets that still hold several components are gone through again without a leader: two sets
   similar enough share one of their rarest shingles (the first n - ceil(0.8 n) + 1 in an order by frequency), and what stands behind it
   bounds how many more they can share. Members of different components that pass this exact test are compared in pairs. So a link that
   no leader saw is found as well, and documents that share only a common passage are not paired.

A pair at similarity s shares none of the 28 bands with probability (1 - s^4)^28: 4e-7 at 0.8.

Cases: null and empty texts have no shingles, link with nothing and are kept; fewer words than a shingle make one shingle; repeated rows
are documents each, and a repeated id counts as one id in the smallest-id rule; a null id never becomes a component id unless its whole
component has none, and such documents are kept; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import texts as T
from .components import components, cut_and_release

BASE = 1.02
RATE = 20.0
TOP = 1000
WIDTH, BANDS = 4, 28
REGISTERS = WIDTH * BANDS
MARGIN = 0.2
COUNTERS = 1 << 20
BITS = 8_388_593  # size of the bitmap of wanted nodes, a prime near 2 ** 23
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of the distinct shingles, in that order; a shingle is 48 bits of its words' hash."""
    n = len(offsets) - 1
    start, end, doc = T.words(raw, offsets)
    h = T.span_hash(T.running(T.LOWER_TABLE[raw]), start, end)
    key, first = T.windows(h, doc, size)
    of = doc[first]
    n_words = np.bincount(doc, minlength=n)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        at = np.searchsorted(doc, short)
        key = np.concatenate([key, T.span_hash(T.running(h), at, at + n_words[short])])
        of = np.concatenate([of, short])
    key >>= np.uint64(16)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return of[new], key[new]


def content_keys(of: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, content keys) per document, key 0 without shingles; equal sets have equal keys."""
    sizes = np.bincount(of, minlength=n)
    some = np.flatnonzero(sizes)
    content = np.zeros(n, np.int64)
    if len(some):
        at = np.cumsum(sizes[some]) - sizes[some]
        x = T.mix(key + np.uint64(0x1234567))
        both = np.add.reduceat(x, at) ^ T.mix(np.add.reduceat(T.mix(x ^ np.uint64(0x5DEECE66D)), at))
        content[some] = T.mix(both + sizes[some].astype(np.uint64)).view(np.int64)
    return sizes, content


def registers(of: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Register values (uint16) per document, all 0 without shingles."""
    sizes = np.bincount(of, minlength=n)
    some = np.flatnonzero(sizes)
    out = np.zeros((n, REGISTERS), np.uint16)
    if len(some):
        at = np.cumsum(sizes[some]) - sizes[some]
        x = T.mix(key + np.uint64(0x1234567))
        least = np.empty((len(some), REGISTERS))
        for j, factor in enumerate(_FACTORS):
            least[:, j] = np.minimum.reduceat(x * factor, at)
        exponential = -np.log1p(-(least + 1) / 2.0**64)
        out[some] = np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300) / RATE) / np.log(BASE)), 0, TOP)
    return out


def _sketches(raw, offsets, size):
    of, key = shingles(raw, offsets, size)
    n = len(offsets) - 1
    sizes, content = content_keys(of, key, n)
    return {"n_shingles": sizes, "node": content, "sketch": [r.tobytes() for r in registers(of, key, n)]}


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _bands(batches):
    for b in batches:
        r = _rows(b.column(1), np.uint16, REGISTERS).astype(np.uint64)
        h = np.zeros((len(r), BANDS), np.uint64)
        for k in range(WIDTH):
            h = T.mix(h + r[:, k::WIDTH] + np.uint64(k + 1))
        h = T.mix(h ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(56)))
        node = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(r))), pa.array(h.ravel().view(np.int64))], names=["node", "band", "bucket"])


def likelihood_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 101) -> np.ndarray:
    """Maximum likelihood estimates of the similarity from how many registers are greater, less and equal, given the set sizes."""
    greater, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - greater - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    s = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * s), p(v - u * s)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = sum(np.where(k > 0, k * np.log(np.maximum(q, 1e-12)), 0) for k, q in ((greater, up), (less, down), (equal, 1 - up - down)))
    return s[np.arange(len(a)), value.argmax(1)]


def _estimates(batches):
    for b in batches:
        if b.num_rows:
            get = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            s = likelihood_similarity(_rows(get["sketch_a"], np.uint16, REGISTERS), _rows(get["sketch_b"], np.uint16, REGISTERS), get["n_a"].to_numpy(), get["n_b"].to_numpy())
            yield pa.RecordBatch.from_arrays([get["a"], get["b"], pa.array(s)], names=["a", "b", "estimate"])


def _sets(raw, offsets, size, wanted):
    of, key = shingles(raw, offsets, size)
    n = len(offsets) - 1
    _, content = content_keys(of, key, n)
    bound = np.searchsorted(of, np.arange(n + 1))
    packed = key.view(np.uint8).reshape(-1, 8)[:, :6]
    ok = (bound[1:] > bound[:-1]) & wanted[content % BITS]
    return {"node": content, "items": [packed[bound[i] : bound[i + 1]].tobytes() if ok[i] else None for i in range(n)]}


def _unpacked(items: bytes) -> np.ndarray:
    raw = np.frombuffer(items, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def _confirm(batches, percent):
    for b in batches:
        get = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        ok = []
        for x, y in zip(get["items_a"].to_pylist(), get["items_b"].to_pylist(), strict=True):
            x, y = _unpacked(x), _unpacked(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([get["a"].filter(ok), get["b"].filter(ok)], names=["a", "b"])


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """Which of ``BITS`` places the nodes fall on: a filter of fixed size, whatever the number of nodes."""
    place = f"pmod(node, {BITS})"
    words = nodes.groupBy(F.expr(f"{place} div 64").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64 + 1, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _sets_of(nodes: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """(node, items): the full sets of (at least) these nodes, each once."""
    sets = T.map_texts(documents.select("text"), functools.partial(_sets, size=size, wanted=_bitmap(nodes)), "node long, items binary")
    return cut_and_release(sets.where(F.col("items").isNotNull()).groupBy("node").agg(F.first("items").alias("items")))


def _counted(batches):
    seen = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for items in b.column(0).to_pylist():
            np.add.at(seen, (_unpacked(items) % np.uint64(COUNTERS)).astype(np.int64), 1)
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["place", "n"])


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle, by ``COUNTERS`` places that shingles share: an order in which common shingles come late."""
    got = sets.select("items").mapInArrow(_counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got["place"].to_numpy()] = got["n"].to_numpy()
    return out


def _heads(batches, frequency, percent):
    """The rarest shingles of each set: of two sets similar enough, the heads share one. With its place in the order and the set's size."""
    for b in batches:
        get = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        nodes, shingle, place, size = [], [], [], []
        for node, items in zip(get["node"].to_pylist(), get["items"].to_pylist(), strict=True):
            x = _unpacked(items)
            head = len(x) - -(-percent * len(x) // 100) + 1
            x = x[np.lexsort((x, frequency[(x % np.uint64(COUNTERS)).astype(np.int64)]))[:head]]
            nodes.append(np.full(head, node))
            shingle.append(x.astype(np.int64))
            place.append(np.arange(head))
            size.append(np.full(head, len(items) // 6))
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (nodes, shingle, place, size)], names=["node", "shingle", "place", "size"])


def _linked(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = {k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab"}
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    known = pairs.join(side["a"], "a").join(side["b"], "b").where(fits).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    likely = cut_and_release(known.mapInArrow(_estimates, "a long, b long, estimate double").where(F.col("estimate") >= percent / 100 - MARGIN).select("a", "b"))
    sets = _sets_of(likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))), documents, size)
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    return full.mapInArrow(functools.partial(_confirm, percent=percent), "a long, b long")


def _groups(nodes: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of all nodes that link with another."""
    bands = nodes.select("node", "sketch").mapInArrow(_bands, "node long, band int, bucket long")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    crowded = cut_and_release(bands.join(shared, "bucket"))
    weight = crowded.groupBy("node").agg(F.sum("members").alias("weight"))
    led = crowded.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("lead")).select("bucket", F.col("lead.node").alias("b"))
    pairs = crowded.join(led, "bucket").where(F.col("node") != F.col("b")).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    links = cut_and_release(_linked(pairs, nodes, documents, size, percent))
    found = cut_and_release(components(links))

    # buckets with several components: their members once more, by the rare shingles that similar sets must share
    of = crowded.select("node", "bucket").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = of.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high")).select("bucket")
    open_nodes = cut_and_release(of.join(mixed, "bucket", "left_semi").select("node", "component").distinct())
    sets = _sets_of(open_nodes.select("node"), documents, size)
    frequency = _frequencies(sets)
    heads = sets.mapInArrow(functools.partial(_heads, frequency=frequency, percent=percent), "node long, shingle long, place long, size long").join(open_nodes, "node")
    x, y = (heads.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"), F.col("size").alias(f"n_{k}"), F.col("place").alias(f"at_{k}"), "shingle") for k in "ab")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    enough = (100 + percent) * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    rest = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & fits & enough).select("a", "b").distinct()
    more = cut_and_release(_linked(rest.join(pairs, ["a", "b"], "left_anti"), nodes, documents, size, percent))
    if more.isEmpty():
        return found
    # the new links join whole components, so only components are gone through again
    name = {k: open_nodes.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in "ab"}
    between = components(more.join(name["a"], "a").join(name["b"], "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    alone = open_nodes.join(found, "node", "left_anti").select("node", "component")
    return found.unionByName(alone).join(between.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def near_duplicates(documents: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    docs = documents.select("doc_id", "text")
    return _verdicts(_sketched(docs, size), docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    return cut_lineage(T.map_texts(docs, functools.partial(_sketches, size=size), "n_shingles long, node long, sketch binary"))


def _verdicts(sketched: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    nodes = sketched.where(F.col("n_shingles") > 0).groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"))
    nodes = cut_and_release(nodes)
    groups = cut_and_release(_groups(nodes, docs, size, percent))
    members = nodes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = members.join(least, "component").select("node", "component", "component_id")
    # a document without shingles is alone: its key is made up, so that such rows spread and match nothing
    rows = sketched.drop("sketch").withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(-F.monotonically_increasing_id()))
    out = rows.join(ids, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that remain when one of each group stays: the one with the smallest id. Rows that share an id stay or go together.

    Rows without an id go if their group has one; of a group without any id one row stays. Documents without words all stay.
    """
    docs = documents.select("doc_id", "text")
    verdict = cut_lineage(_verdicts(_sketched(docs, size), docs, size, percent).select("doc_id", "n_shingles", "node", "component", "component_id", "kept"))
    named = verdict.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    with_id = documents.where(F.col("doc_id").isNotNull()).join(named, "doc_id", "left_semi")
    # a row without an id is found again by the key of its content
    key, n = T.free_name(documents, "node"), T.free_name(documents, "n_shingles")

    def keyed(raw, offsets):
        got = _sketches(raw, offsets, size=size)
        return {n: got["n_shingles"], key: got["node"]}

    nameless = T.map_texts(documents.where(F.col("doc_id").isNull()), keyed, f"`{n}` long, `{key}` long", ())
    chosen = verdict.where("doc_id is null and component_id is null and n_shingles > 0").groupBy("component").agg(F.min("node").alias(key)).select(key)
    one_each = nameless.where(F.col(n) > 0).join(chosen, key, "left_semi").dropDuplicates([key])
    rest = nameless.where(F.col(n) == 0).unionByName(one_each)
    return with_id.unionByName(rest.drop(key, n)).select(*documents.columns)
