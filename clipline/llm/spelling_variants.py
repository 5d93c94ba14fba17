"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling, and each rare word's usual form.

Two words differ by exactly one inserted, deleted or replaced code point if and only if their common prefix and common suffix together
reach the longer length minus one. So the place of the edit lies in one of a few parts of the longer word, and all before and after that part
agree: every word is listed under (longer length, part, what stands before and after it), once as the longer and once as the shorter
word. What the words of one such group have in that part, and one code point more, are rows of padded code-point matrices, one aligned left
and one aligned right, and blocks of row pairs are compared at once. A pair counts only in the group whose part holds its edit, so once.

Scale: words are counted with map-side combining, and all after that is rows of the vocabulary. A part has about ``WILD`` code points (a word has ``PARTS`` parts at most), so that a group holds few
words; a group of more than ``BLOCK`` words is cut into blocks by a hash of the word and each pair of blocks becomes a tile of its own, so
that no task holds a whole large group. A tile gives one row per word that has a near word, never pairs.

Cases: a null or empty text has no words; a null id counts as an empty id in the hash of a run; repeated rows count each for itself; runs
of any length are taken whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, USUAL, DAMAGED = 7, 2, 10, 31
WILD, PARTS, BLOCK, PAIRS = 3, 8, 2048, 1 << 17


def words(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters, lower-cased A-Z, some with one code point deleted, that occur often enough."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # lower() is fast but would also change the letters beyond ASCII
    plain = F.octet_length("run") == F.length("run")
    runs = runs.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def keyed(vocabulary: DataFrame, wild: int = WILD) -> DataFrame:
    """(key, longer, span, middle, word, n): each word under every part of its own length and of one more.

    ``span`` is the length of the part in the longer word, ``middle`` what the word has there and the code point after it.
    """
    size = F.length("word")
    longer = vocabulary.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    parts = F.least(F.ceil(F.col("longer") / wild), F.lit(PARTS)).cast("int")
    part = longer.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bounds = [F.floor(F.col("longer") * (F.col("part") + k) / F.col("parts")).cast("int") for k in (0, 1)]
    part = part.select("word", "n", "longer", bounds[0].alias("low"), bounds[1].alias("high"))
    after = F.col("longer") - F.col("high")
    before = F.substring(F.col("word"), F.lit(1), F.col("low"))
    rest = F.substring(F.col("word"), F.length("word") - after + 1, after)
    middle = F.substring(F.col("word"), F.col("low") + 1, F.length("word") - F.col("low") - after + 1)
    return part.select(F.concat_ws(" ", "longer", "low", before, rest).alias("key"), "longer", (F.col("high") - F.col("low")).alias("span"), middle.alias("middle"), "word", "n")


def tiles(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``tile`` (the key, or the key and two blocks) and ``side``: 0 where all rows of a tile meet, else the one of its two blocks."""
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    rows = rows.join(large, "key", "left").withColumn("blocks", blocks)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(" ", "key", F.least("own", "other"), F.greatest("own", "other"))
    tile = F.when(F.col("blocks") > 1, pair).otherwise(F.col("key"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select(tile.alias("tile"), side.alias("side"), "longer", "span", "middle", "word", "n")


def matrices(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left, the same aligned right (reversed), padded with zeros, and the lengths."""
    size = np.array([len(x) for x in items], np.int32)
    width = max(1, int(size.max()))
    left = np.array(items, f"<U{width}").view(np.uint32).reshape(len(items), width)
    at = size[:, None] - 1 - np.arange(width)[None, :]
    return left, np.where(at >= 0, np.take_along_axis(left, np.maximum(at, 0), 1), 0), size


def one_edit(left: np.ndarray, right: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) of distinct rows are one edit apart, and the lengths of their common prefixes."""
    longer, shorter = np.maximum(size[i], size[j]), np.minimum(size[i], size[j])

    def agree(m):
        differs = m[i] != m[j]
        return np.minimum(np.where(differs.any(1), differs.argmax(1), m.shape[1]), shorter)

    prefix = agree(left)
    return (longer - shorter <= 1) & (prefix + agree(right) >= longer - 1), prefix


def compare(rows: dict, first: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among rows sorted by tile; ``first`` gives where each row's tile begins. About ``pairs`` row pairs at once."""
    left, right, size = matrices(rows["middle"])
    pairs = max(1, pairs * 8 // left.shape[1])
    upto = np.cumsum(np.arange(len(size)) - first)
    out, at = [(np.zeros(0, np.int64),) * 2], 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + pairs, "right")))
        many = np.arange(at, end) - first[at:end]
        i = np.repeat(np.arange(at, end), many)
        j = np.repeat(first[at:end] - np.cumsum(many) + many, many) + np.arange(len(i))
        use = np.maximum(rows["length"][i], rows["length"][j]) == rows["longer"][i]
        use &= (rows["side"][i] == 0) | (rows["side"][i] != rows["side"][j])
        i, j = i[use], j[use]
        near, prefix = one_edit(left, right, size, i, j)
        near &= prefix < rows["span"][i]
        out.append((i[near], j[near]))
        at = end
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


_OUT = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
_CELLS = 1 << 22


def _near_of(table: pa.Table) -> pa.RecordBatch:
    """One row per word with a near word in its tile: how many, and the most frequent (ties: the least)."""
    tile = table.column("tile").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.maximum.accumulate(np.where(np.append(True, tile[1:] != tile[:-1]), np.arange(len(tile)), 0))
    rows = {k: table.column(k).to_numpy() for k in ("side", "longer", "span", "n")} | {k: table.column(k).to_pylist() for k in ("word", "middle")}
    rows["length"] = pc.utf8_length(table.column("word")).to_numpy()
    i, j = compare(rows, first)
    # rows of a tile stand in the order of words, so the least index among equals is the least word
    word, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort([other, -rows["n"][other], word])
    word, other = word[order], other[order]
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
    return pa.RecordBatch.from_arrays([
        pa.array([rows["word"][k] for k in word[head]], pa.string()), pa.array(np.diff(np.append(head, len(word))), pa.int64()), pa.array(rows["n"][other[head]], pa.int64()),
        pa.array([rows["word"][k] for k in other[head]], pa.string()),
    ], schema=_OUT)


def _pieces(table: pa.Table):
    """Whole tiles, together of about ``_CELLS`` matrix cells."""
    width = np.maximum(1, pc.utf8_length(table.column("middle")).to_numpy())
    tile = table.column("tile").combine_chunks().dictionary_encode().indices.to_numpy()
    begins = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile))
    widest, at, most = np.maximum.reduceat(width, begins[:-1]), 0, 0
    for a, b, w in zip(begins[:-1].tolist(), begins[1:].tolist(), widest.tolist(), strict=True):
        most = max(most, w)
        if a > at and most * (b - at) > _CELLS:
            yield table.slice(at, a - at)
            at, most = a, w
    yield table.slice(at)


def _compare_partition(batches):
    """A partition sorted by tile; the last tile of a batch may go on in the next, and waits."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        if not table.num_rows:
            continue
        whole = pc.index(table.column("tile"), table.column("tile")[-1]).as_py()
        held = table.slice(whole)
        if whole:
            yield from map(_near_of, _pieces(table.slice(0, whole)))
    if held is not None and held.num_rows:
        yield from map(_near_of, _pieces(held))


def near_words(vocabulary: DataFrame, wild: int = WILD, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form) in parts: a word has a row for each tile in which it has a near word."""
    rows = tiles(keyed(vocabulary, wild), block).repartition("tile").sortWithinPartitions("tile", "word")
    return rows.mapInArrow(_compare_partition, "word string, n_near long, form_n long, form string")


def with_forms(vocabulary: DataFrame, near: DataFrame, usual: int = USUAL) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, if it is at least ``usual`` times as frequent."""
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<least:bigint,form:string>").alias("best"))
    found = near.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("least"), "form").alias("best"))
    each = own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    takes = -F.col("best.least") >= usual * F.col("n")
    return each.select("word", "n", "n_near", F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.least")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. Each step is ``usual`` times as frequent, so chains are short; ends when no word moves."""
    links = formed.where(F.col("form").isNotNull()).select("word", "form")
    step = links.select(F.col("word").alias("root"), F.col("form").alias("next"))
    now = cut_lineage(links.withColumnRenamed("form", "root"))
    while True:
        moved = cut_lineage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return now


def variants(documents: DataFrame, wild: int = WILD, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``documents``."""
    vocabulary = cut_lineage(words(documents))
    formed = cut_lineage(with_forms(vocabulary, near_words(vocabulary, wild, block)))
    out = formed.join(roots(formed), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL: crc32 from its polynomial, candidates by deletion of one code point.
SQL = r"""
WITH crc AS (
  SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(0, 256)] AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, 2 * k + 1, 2))::BIGINT FOR k IN range(0, len(x) // 2)]),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM counted), crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (
  SELECT word, n, k, CASE WHEN k = 0 THEN word ELSE substr(word, 1, k - 1) || substr(word, k + 1) END AS rest
  FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS k FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
  FROM cuts a JOIN cuts b USING (rest) WHERE a.word <> b.word AND (a.k = b.k OR a.k = 0 OR b.k = 0)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
hops AS (
  SELECT f0.word, coalesce(f5.form, f4.form, f3.form, f2.form, f1.form, f0.form, f0.word) AS root
  FROM formed f0 LEFT JOIN formed f1 ON f1.word = f0.form LEFT JOIN formed f2 ON f2.word = f1.form LEFT JOIN formed f3 ON f3.word = f2.form
  LEFT JOIN formed f4 ON f4.word = f3.form LEFT JOIN formed f5 ON f5.word = f4.form)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN hops USING (word)
"""
