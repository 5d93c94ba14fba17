"""SQL pieces shared by the oracle queries: the given tables in the library's shapes, written independently in SQL."""

from __future__ import annotations

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SENTENCES = rf"""
sent AS (
  SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS INTEGER) AS seg_id, text,
         len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n
  FROM (SELECT d.doc_id AS video_id, u.i, trim(u.s, {WS}) AS text
        FROM documents d, unnest(string_split(regexp_replace(trim(d.text, {WS}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))
             WITH ORDINALITY AS u(s, i))
  WHERE text <> ''
)"""

SEGMENTS = SENTENCES + """,
tot AS (SELECT video_id, sum(n) AS w, count(*) AS s FROM sent GROUP BY video_id),
seg0 AS (
  SELECT sent.video_id, seg_id, text, n, greatest(w * 0.35::DOUBLE, s * 2.0::DOUBLE) AS d, w,
         coalesce(sum(n) OVER (PARTITION BY sent.video_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0
  FROM sent JOIN tot USING (video_id)
),
seg AS (
  SELECT video_id, seg_id, text, n, CAST(w0 AS INTEGER) AS w0,
         least(d, greatest(d / w, 0.18::DOUBLE) * w0) AS start_s,
         least(d, greatest(d / w, 0.18::DOUBLE) * (w0 + n)) AS end_s
  FROM seg0
)"""

WORD_ROWS = r"""
wrd AS (
  SELECT video_id, seg_id, CAST(w0 + j - 1 AS INTEGER) AS word_idx, word,
         regexp_replace(lower(word), '[^\p{L}\p{N}_]', '', 'g') AS clean,
         round_even((s + (j - 1) * wd) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS start_s,
         round_even(least(e, s + j * wd) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS end_s
  FROM (SELECT video_id, seg_id, w0, start_s AS s, end_s AS e, greatest(0.12::DOUBLE, (end_s - start_s) / n) AS wd, u.word, u.j
        FROM seg, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) WITH ORDINALITY AS u(word, j))
)"""

WORDS = SEGMENTS + "," + WORD_ROWS

TURNS = r"""
turn0 AS (
  SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS seg_id, text, role AS speaker,
         len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n
  FROM conversations
),
turn1 AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY video_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0,
         sum(n) OVER (PARTITION BY video_id) AS w, greatest(sum(n) OVER (PARTITION BY video_id) * 0.35::DOUBLE, count(*) OVER (PARTITION BY video_id) * 2.0::DOUBLE) AS d
  FROM turn0 WHERE n > 0
),
seg AS (
  SELECT video_id, seg_id, text, speaker, n, CAST(w0 AS INTEGER) AS w0,
         least(d, greatest(d / w, 0.18::DOUBLE) * w0) AS start_s, least(d, greatest(d / w, 0.18::DOUBLE) * (w0 + n)) AS end_s
  FROM turn1
)"""

SPANS = """
span AS (
  SELECT user_id AS video_id, event_id AS candidate_id, start_s, length_s, start_s + length_s AS end_s, value AS score, event_type AS speaker, ts
  FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE / 1200.0::DOUBLE AS start_s,
               greatest(value, 5.0::DOUBLE) AS length_s
        FROM events)
)"""


def r3(x: str) -> str:
    """Half-even rounding to 3 digits, the same double arithmetic as on the other side."""
    return f"(round_even(CAST({x} AS DOUBLE) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE)"


def stamp(x: str) -> str:
    """MM:SS.ss"""
    m = f"CAST(floor(({x}) / 60) AS BIGINT)"
    cs = f"CAST(round_even((({x}) - {m} * 60) * 100.0::DOUBLE, 0) AS BIGINT)"
    two = lambda v: f"CASE WHEN {v} < 10 THEN '0' ELSE '' END || CAST({v} AS VARCHAR)"
    return f"({two(m)} || ':' || {two(f'({cs} // 100)')} || '.' || {two(f'({cs} % 100)')})"
