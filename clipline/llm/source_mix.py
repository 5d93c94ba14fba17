"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources in code-point order weigh 1, 2, 3, 1, ... (``WEIGHTS``) and share the words of the whole corpus; a target stops at ``REPEAT`` times
its source, and the excess is shared again by weight among the others until none is above. The words are dealt in blocks of ``block``
words: the highest quotients votes / (2 k + 1) give each source its number of blocks, and then each shard of a source its own, with the
source's target split by the shards' words as votes.

The documents of a shard stand on a circle of words in an order drawn by a hash of seed, id and text. The shard takes its quota of
blocks in a row from a seeded place on that circle, so each word is taken q times or q + 1 times, and what a document gives follows from
its place alone: no block is ever a row.

Scale: one pass over the texts, then narrow rows. A source is cut into shards of about ``shard`` documents (``MOST_SHARDS`` at most, so a
task never sorts more than that part of a source), and the running sum of words runs per shard. Sources are one narrow row each; they
are numbered and given their seats in one task, as are the shards of one source, of which there are at most ``MOST_SHARDS``.
The driver sees sums and counts only.

Cases: a null text has size 0 and is never taken; the null source comes last in order; a null id is carried through; repeated rows count
each for itself; if all documents are empty, all targets are 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: The weights in the order of sources, and how often a document may be repeated.
WEIGHTS = (1, 2, 3)
REPEAT = 3

BLOCK, SHARD, MOST_SHARDS, SEED = 4, 2000, 65_536, "mix"


def _number(text: Column) -> Column:
    """60 bits of a hash of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sized(documents: DataFrame, seed: str) -> DataFrame:
    """Narrow rows: doc_id, size, the source (``known``, ``name``) and the seeded key of the document."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return documents.select(
        "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNotNull().alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), F.md5(key).alias("drawn"),
    )


def with_targets(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``target`` to (known, name, source_size, ...): shares by weight, capped, the excess shared again."""
    place = F.row_number().over(Window.orderBy(F.col("known").desc(), "name"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((place - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = cut_lineage(sources.withColumn("weight", weight.cast("long")))
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else REPEAT * F.col("source_size") < F.lit(level) * F.col("weight")
        got = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, REPEAT * F.col("source_size"))).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n"),
        ).first()
        if got.n == capped or not got.open:
            break
        level, capped = ((got["all"] or 0) - (got.held or 0)) / got.open, got.n
    return sources.withColumn("target", F.least((REPEAT * F.col("source_size")).cast("double"), F.lit(level or 0.0) * F.col("weight")))


def highest_quotients(parties: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds ``quota``: ``seats`` of each group go one by one to the highest votes / (2 k + 1), ties by ``order``, none beyond ``most``.

    Two divisors bracket the outcome: rounding by the greater gives seats that are won in any case, by the smaller all that can be won.
    They lie at most 2 seats a party apart on average, and only quotients between them are ranked.
    """
    of_group = Window.partitionBy(*group)
    n, votes = F.count(F.lit(1)).over(of_group), F.sum("votes").over(of_group)
    bound = parties.withColumns({"n_": n, "all_": votes})
    low = F.when((F.col("seats") * 2 > F.col("n_")) & (F.col("all_") > 0), F.floor(F.col("votes") * (F.col("seats") - F.col("n_") / 2) / F.col("all_") + 0.5) - 1)
    high = F.when(F.col("all_") > 0, F.floor(F.col("votes") * (F.col("seats") + F.col("n_") / 2) / F.col("all_") + 0.5) + 1)
    bound = bound.withColumns({
        "low_": F.least(F.greatest(F.coalesce(low, F.lit(0)), F.lit(0)), "most").cast("long"), "high_": F.least(F.coalesce(high, F.lit(0)), "most").cast("long"),
    })
    left = F.max("seats").over(of_group) - F.sum("low_").over(of_group)
    seat = F.explode_outer(F.when(F.col("high_") > F.col("low_"), F.sequence(F.col("low_"), F.col("high_") - 1)))
    open_ = bound.withColumn("left_", left).withColumn("seat_", seat).withColumn("quotient_", F.col("votes") / (2 * F.col("seat_") + 1))
    rank = F.row_number().over(of_group.orderBy(F.col("quotient_").desc_nulls_last(), *order))
    won = F.count_if(F.col("seat_").isNotNull() & (F.col("rank_") <= F.col("left_")))
    return (
        open_.withColumn("rank_", rank).groupBy(*parties.columns).agg((F.first("low_") + won).alias("quota"))
    )


def mix(documents: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    rows = cut_lineage(sized(documents, seed))
    source, whole = ["known", "name"], F.lit(0)
    per = rows.groupBy(*source).agg(F.sum("size").alias("source_size"), F.least(F.ceil(F.count(F.lit(1)) / shard), F.lit(MOST_SHARDS)).alias("shards"))
    sources = with_targets(per)
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    parties = sources.withColumns({
        "whole": whole, "votes": F.col("target"), "seats": F.lit(int(total / block + 0.5)), "most": F.floor(REPEAT * F.col("source_size") / block),
    })
    dealt = highest_quotients(parties, ["whole"], [F.col("known").desc(), F.col("name")])
    dealt = cut_lineage(dealt.select(*source, "source_size", "shards", "target", F.col("quota").alias("seats")))

    # sources are joined as a table of one row each; a hot source's documents are split by AQE
    in_shard = rows.join(dealt.select(*source, "shards"), source).withColumn("shard", F.conv(F.substring("drawn", 1, 8), 16, 10).cast("long") % F.col("shards"))
    in_shard = cut_lineage(in_shard.select("doc_id", "size", *source, "shard", "drawn"))
    circles = in_shard.groupBy(*source, "shard").agg(F.sum("size").alias("words")).join(dealt.drop("shards"), source)
    circles = circles.withColumns({"votes": F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0), "most": F.floor(REPEAT * F.col("words") / block)})
    circles = highest_quotients(circles, source, [F.col("shard")])
    start = _number(F.concat_ws(":", F.lit(seed), F.col("name"), F.col("shard").cast("string"))) % F.greatest("words", F.lit(1))
    circles = circles.select(*source, "shard", "words", "source_size", "target", start.alias("first"), (start + F.col("quota") * block).alias("end"))

    at = F.sum("size").over(Window.partitionBy(*source, "shard").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = in_shard.withColumn("at", at).join(circles, [*source, "shard"])

    def before(x: Column) -> Column:
        """Words of the document among the first ``x`` words read around the circle."""
        rest = F.least(F.greatest(x % F.col("words") - F.col("at"), F.lit(0)), F.col("size"))
        return F.when(F.col("words") > 0, F.floor(x / F.col("words")).cast("long") * F.col("size") + rest).otherwise(0)

    return placed.select("doc_id", "size", "source_size", "target", (before(F.col("end")) - before(F.col("first"))).cast("long").alias("taken"))


#: The same in SQL: all quotients that can win are listed, ranked and cut at the number of seats.
SQL = rf"""
WITH docs AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, source IS NOT NULL AS known, coalesce(source, '') AS name,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS drawn
  FROM documents),
per AS (
  SELECT known, name, sum(size)::BIGINT AS source_size, least(ceil(count(*) / {SHARD}), {MOST_SHARDS})::BIGINT AS shards,
         [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY known DESC, name) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight
  FROM docs GROUP BY known, name),
ranked AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({REPEAT} * source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY {REPEAT} * source_size / weight, known DESC, name) AS place
  FROM per WINDOW before AS (ORDER BY {REPEAT} * source_size / weight, known DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT arg_min(level, place) AS level FROM ranked WHERE NOT {REPEAT} * source_size < level * weight),
targets AS (
  SELECT known, name, source_size, shards, least(({REPEAT} * source_size)::DOUBLE, coalesce(s.level, 0) * weight) AS target FROM ranked, settled s),
seats AS (SELECT floor(sum(target) / {BLOCK} + 0.5)::BIGINT AS n, count(*) AS parties, sum(target) AS votes FROM targets),
won AS (
  SELECT known, name, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, known DESC, name) AS rank, n
  FROM (SELECT t.*, seats.n, unnest(range(0, least(floor({REPEAT} * source_size / {BLOCK})::BIGINT, ceil(target * n / greatest(seats.votes, 1))::BIGINT + parties + 2))) AS k FROM targets t, seats)),
dealt AS (
  SELECT t.*, coalesce(w.quota, 0) AS seats FROM targets t LEFT JOIN (SELECT known, name, count(*) AS quota FROM won WHERE rank <= n GROUP BY known, name) w USING (known, name)),
sharded AS (SELECT d.*, ('0x' || substr(drawn, 1, 8))::BIGINT % shards AS shard FROM docs d JOIN dealt USING (known, name)),
circles AS (
  SELECT known, name, shard, words, target, source_size, seats, CASE WHEN source_size > 0 THEN target * words / source_size ELSE 0 END AS votes, count(*) OVER (PARTITION BY known, name) AS parties
  FROM (SELECT known, name, shard, sum(size)::BIGINT AS words FROM sharded GROUP BY known, name, shard) JOIN dealt USING (known, name)),
shard_won AS (
  SELECT known, name, shard, seats, row_number() OVER (PARTITION BY known, name ORDER BY votes / (2 * k + 1) DESC, shard) AS rank
  FROM (SELECT *, unnest(range(0, least(floor({REPEAT} * words / {BLOCK})::BIGINT, ceil(votes * seats / greatest(target, 1))::BIGINT + parties + 2))) AS k FROM circles)),
quotas AS (
  SELECT c.*, coalesce(q.quota, 0) AS quota, ('0x' || substr(md5('{SEED}:' || name || ':' || shard), 1, 15))::BIGINT % greatest(words, 1) AS start
  FROM circles c LEFT JOIN (SELECT known, name, shard, count(*) AS quota FROM shard_won WHERE rank <= seats GROUP BY known, name, shard) q USING (known, name, shard)),
placed AS (
  SELECT d.doc_id, d.size, q.*, sum(d.size) OVER (PARTITION BY known, name, shard ORDER BY drawn, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS begins
  FROM sharded d JOIN quotas q USING (known, name, shard)),
spans AS (SELECT *, start AS x0, start + quota * {BLOCK} AS x1 FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN words = 0 THEN 0 ELSE (x1 // words - x0 // words) * size
          + least(greatest(x1 % words - begins, 0), size) - least(greatest(x0 % words - begins, 0), size) END)::BIGINT AS taken
FROM spans
"""
