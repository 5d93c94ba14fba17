"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings (``assign``, ``access``, ``hex``) are reported wherever they stand. Weak parts (``ident``: an identifier, ``opaque``: a
long run of letters and digits, ``endpoint``: an address) say nothing alone. An interval join within a scope of ``reach`` code points
reports a weak part only if a complementary one co-occurs: an identifier or endpoint beside a secret, a secret beside an identifier or
endpoint. The join is a semi join on (text, scope bucket, wanted class), so that no pairs are emitted; it works on distinct texts with weak
parts, of which copies are merged on the map side before the shuffle.

Cases: a null or empty text has no spans; repeated rows and repeated ids each give a row; a null id is carried through; texts of any
length are scanned whole; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 8
IDENTIFIERS = "|".join(_either_case(w) for w in ("access_?key_?id", "client_?id", "user_?name", "user", "login", "account"))

#: kind -> (order among equal starts, class, weak, pattern)
KINDS = {
    "assign": (0, "S", False, ASSIGN),
    "access": (1, "I", False, r"AKIA[A-Z0-9]{12,}"),
    "hex": (2, "S", False, r"[0-9a-f]{32,}"),
    "ident": (3, "I", True, rf"""({IDENTIFIERS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)"""),
    "opaque": (4, "S", True, r"[A-Za-z0-9+/_-]{20,}"),
    "endpoint": (5, "E", True, r"[a-z]+://[A-Za-z0-9_.:/?&%@=-]+|[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+:[0-9]+"),
}
#: lower-case words of which every match of the kind holds one
HINTS = {"assign": ("password", "passwd", "secret", "token", "api"), "ident": ("access", "client", "user", "login", "account")}
WANTS = {"I": ("S",), "S": ("I", "E"), "E": ("S",)}
REACH = 200
_SPANS = "array<struct<start:bigint,kind_order:int,kind:string,end:bigint>>"


def _passes(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_VALUE
    if kind == "opaque":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _spans_of(text: Column, kind: str) -> Column:
    """All matches of a kind with their places: what stands between matches and the matches themselves add up to positions."""
    order, _, _, pattern = KINDS[kind]
    parts = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size"), _passes(kind, match).alias("passes")),
    )
    placed = F.aggregate(
        parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("found")),
        lambda acc, x: F.struct(
            (acc.at + x.gap + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["size"].isNotNull() & x.passes, F.array_append(acc.found, F.struct((acc.at + x.gap).alias("start"), F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), (acc.at + x.gap + x["size"]).alias("end"))))
            .otherwise(acc.found).cast(_SPANS).alias("found"),
        ),
    )
    return F.when(_may_hold(text, kind) & text.rlike(pattern), placed.found).otherwise(F.array().cast(_SPANS))


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    if kind == "endpoint":
        return text.contains("://") | text.rlike(":[0-9]")
    if kind == "access":
        return text.contains("AKIA")
    if kind in HINTS:
        low = F.col("low_")
        return (text.contains(":") | text.contains("=")) & functools.reduce(lambda a, b: a | b, [low.contains(w) for w in HINTS[kind]])
    return F.lit(True)


def _outside(spans: str, covers: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(covers, lambda y: (y.start < x.end) & (y.end > x.start)))


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base_", lambda x: x.kind == kind)).cast("long")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts of ``parts`` (key_, start, kind_order, kind, end) that have a complementary part in reach."""
    classes = F.create_map([F.lit(v) for k, (_, c, _, _) in KINDS.items() for v in (k, c)])
    weak_kinds = [k for k, (_, _, weak, _) in KINDS.items() if weak]
    bucket = 2 * reach

    def buckets(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket)))

    parts = parts.withColumn("class_", classes[F.col("kind")])
    wants = F.create_map([v for k, w in WANTS.items() for v in (F.lit(k), F.array(*[F.lit(x) for x in w]))])
    weak = parts.where(F.col("kind").isin(weak_kinds)).withColumn("wanted_", F.explode(wants[F.col("class_")])).withColumn("bucket_", buckets(F.col("start") - reach, F.col("end") + reach))
    other = parts.select("key_", F.col("class_").alias("wanted_"), F.col("start").alias("start_"), F.col("end").alias("end_"), buckets(F.col("start"), F.col("end")).alias("bucket_"))
    near = (other.start_ <= weak.end + reach) & (other.end_ >= weak.start - reach)
    apart = (other.start_ >= weak.end) | (other.end_ <= weak.start)
    hit = weak.join(other, (weak.key_ == other.key_) & (weak.wanted_ == other.wanted_) & (weak.bucket_ == other.bucket_) & near & apart, "left_semi")
    return hit.select("key_", "start", "kind_order", "kind", "end").distinct()


def add_spans(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """Append ``base_`` and ``spans_`` (arrays of start, kind_order, kind, end in order) to the rows of ``documents``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weak_kinds = [k for k, (_, _, weak, _) in KINDS.items() if weak]
    found = documents.withColumn("low_", F.lower(text))
    found = found.withColumns({f"{k}_": _spans_of(text, k) for k in KINDS if k != "opaque"}).drop("low_")
    # a long run is reported beside an identifier or an endpoint only, so it is looked for only where there is one
    found = found.withColumn("opaque_", F.when(F.size("access_") + F.size("ident_") + F.size("endpoint_") > 0, _spans_of(text, "opaque")).otherwise(F.array().cast(_SPANS)))
    found = found.withColumn("base_", F.array_sort(F.concat("assign_", "access_", "hex_")))
    # a weak part inside a strong one, or a long run inside an address, is no part of its own
    for k in weak_kinds:
        covers = F.col("base_") if k != "opaque" else F.concat("base_", "endpoint_", "ident_")
        found = found.withColumn(f"{k}_", F.when(F.size(f"{k}_") > 0, _outside(f"{k}_", covers)).otherwise(F.col(f"{k}_")))
    found = found.withColumn("weak_", F.concat(*[f"{k}_" for k in weak_kinds])).drop(*[f"{k}_" for k in KINDS])
    linkable = (F.size("weak_") > 0) & (F.size("weak_") + F.size("base_") > 1)
    # rows that cannot link get a key of their own, so that they spread evenly and match nothing
    keyed = found.withColumn("key_", F.when(linkable, F.sha2(text, 256)).otherwise(F.monotonically_increasing_id().cast("string")))
    parts = keyed.where(linkable).select("key_", F.explode(F.concat("base_", "weak_")).alias("p")).select("key_", "p.*").distinct()
    links = _linked(parts, reach).groupBy("key_").agg(F.collect_list(F.struct("start", "kind_order", "kind", "end")).alias("linked_"))
    joined = keyed.drop("weak_").join(links, "key_", "left").drop("key_")
    return joined.withColumn("spans_", F.array_sort(F.concat("base_", F.coalesce("linked_", F.array().cast(_SPANS))))).drop("linked_")


def _listed(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)))


def scan(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    found = add_spans(documents.select("doc_id", "text"), reach)
    return found.select("doc_id", *[_number_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(_listed("base_"), 256).alias("base_sha256"), _listed("spans_").alias("spans"))


def redact(documents: DataFrame, mask: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """The documents with every reported span replaced by ``mask``; overlapping spans become one. ``n_chars`` follows the text."""
    # columns whose names end as those of this module do wait under other names
    waiting = {c: f"{c}kept" for c in documents.columns if c.endswith("_")}
    found = add_spans(documents.withColumnsRenamed(waiting), reach)
    text = F.col("text")
    done = F.aggregate(
        "spans_", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc.at, x.end).alias("at"),
            F.when(x.start >= acc.at, F.concat(acc.out, F.substring(text, (acc.at + 1).cast("int"), (x.start - acc.at).cast("int")), F.lit(mask))).otherwise(acc.out).alias("out"),
        ),
        lambda acc: F.concat(acc.out, F.substring(text, (acc.at + 1).cast("int"), F.length(text))),
    )
    out = found.withColumn("text", F.when(F.size("spans_") > 0, done).otherwise(text))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(waiting.get(c, c)).alias(c) for c in documents.columns])


def _sql_spans(kind: str) -> str:
    order, cls, weak, pattern = KINDS[kind]
    quoted = pattern.replace("'", "''")
    passes = {"assign": f"length(regexp_extract(m, '{quoted}', 2)) >= {LEAST_VALUE}", "opaque": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"}.get(kind, "true")
    return f"""
      SELECT row_id, {order} AS kind_order, '{kind}' AS kind, '{cls}' AS cls, {str(weak).lower()} AS weak, s AS "start", s + length(m) AS "end"
      FROM (
        SELECT row_id, unnest(found) AS m,
               unnest(list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s
        FROM (SELECT row_id, string_split_regex(t, '{quoted}') AS pieces, regexp_extract_all(t, '{quoted}') AS found FROM d WHERE regexp_matches(t, '{quoted}'))
      ) WHERE {passes}"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
raw_parts AS ({" UNION ALL ".join(_sql_spans(k) for k in KINDS)}),
parts AS (
  SELECT * FROM raw_parts a WHERE NOT weak OR NOT EXISTS (
    SELECT 1 FROM raw_parts b WHERE b.row_id = a.row_id AND b."start" < a."end" AND b."end" > a."start"
      AND (NOT b.weak OR (a.kind = 'opaque' AND b.kind IN ('endpoint', 'ident'))))),
kept AS (
  SELECT * FROM parts a WHERE NOT weak OR EXISTS (
    SELECT 1 FROM parts b WHERE b.row_id = a.row_id AND (b."start" >= a."end" OR b."end" <= a."start")
      AND b."start" <= a."end" + {REACH} AND b."end" >= a."start" - {REACH}
      AND ((a.cls IN ('I', 'E') AND b.cls = 'S') OR (a.cls = 'S' AND b.cls IN ('I', 'E'))))),
listed AS (
  SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", kind_order) FILTER (NOT weak) AS base,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", kind_order) AS spans
  FROM kept GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (row_id)
"""
