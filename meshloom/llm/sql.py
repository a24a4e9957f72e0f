"""DuckDB SQL that gives the rows of operators 11 and 13, independently of their methods."""

from __future__ import annotations

#: A table of one row with the 256 remainders that zlib's crc32 is made of.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def crc32(text: str) -> str:
    """SQL for the crc32 of a text's UTF-8 bytes; needs ``crc_table`` in the same FROM."""
    byte = "(instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1"
    data = f"(SELECT list_transform(range(len(h) // 2), lambda i: ({byte})::BIGINT) FROM (SELECT hex(encode({text})) AS h))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

RESAMPLING_SQL = f"""
WITH {CRC_TABLE}, docs AS (
  SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS words FROM documents
), wanted AS (
  SELECT unnest({_WORDS}) AS word FROM benchmark
), features AS (
  SELECT k, unnest(words) AS word FROM docs
), buckets AS (
  SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT word FROM features UNION SELECT word FROM wanted), crc_table
), have AS (
  SELECT bucket, count(*) AS n FROM features JOIN buckets USING (word) GROUP BY bucket
), want AS (
  SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT coalesce(sum(n), 0) FROM have)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM want)::DOUBLE AS t
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(w.n, 0) + 1.0::DOUBLE) * (s + 10000) / ((h.n + 1.0::DOUBLE) * (t + 10000))))::BIGINT AS gain FROM have h LEFT JOIN want w USING (bucket), totals
), weights AS (
  SELECT k, sum(gain)::BIGINT AS weight FROM features JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY k
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (k)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""


def _more(way: str, cost: str, letter: str) -> str:
    """A way, its cost in ten digits before its letters, with one more edit; so the least text is the cheapest way, ties by letters."""
    return f"lpad((({way}[1:10])::BIGINT + {cost})::VARCHAR, 10, '0') || {way}[11:] || '{letter}'"


def _step(to: str, initial: str, before: str) -> str:
    """The best way to a state by reading a row: deleted, or kept or given a role behind one of the states before."""
    ways = [_more(to, "2", "D")]
    for state in before:
        ways.append(f"CASE WHEN NOT must_go AND ini = '{initial}' THEN {_more(state, 'x', 'K')} END")
        if initial != "s":
            ways.append(f"CASE WHEN NOT must_go THEN {_more(state, '(x + 1)', 'R')} END")
    return f"least({', '.join(ways)}, NULL)"


CONVERSATIONS_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM source, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged
), faults AS (
  SELECT *, role[1:1] AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM ordered
), rows_in AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x FROM faults
), ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, '0000000000' AS e, NULL::VARCHAR AS s, '0000000005I' AS u, '0000000010II' AS a FROM rows_in
  UNION ALL
  SELECT conv_id, k, e, s, u, least(a, {_more("u", "5", "I")}) AS a FROM (
    SELECT conv_id, k, e, s, least(u, {_more("e", "5", "I")}, {_more("s", "5", "I")}, {_more("a", "5", "I")}) AS u, a FROM (
      SELECT w.conv_id, r.k, {_step("e", "", "")} AS e, {_step("s", "s", "e")} AS s, {_step("u", "u", "esa")} AS u, {_step("a", "a", "u")} AS a
      FROM ways w JOIN rows_in r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = w.k + 1))
), found AS (
  SELECT conv_id, (best[1:10])::BIGINT AS cost, best[11:] AS audit FROM (SELECT conv_id, least(e, a) AS best, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS place FROM ways) WHERE place = 1
), letters AS (
  SELECT conv_id, i, audit[i:i] AS letter, len(replace(audit[1:i], 'I', '')) AS k FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM found)
), put AS (
  SELECT l.conv_id, i, letter, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, role, row_number() OVER (PARTITION BY l.conv_id ORDER BY i) AS n,
    first_value(letter = 'K' AND ini = 's') OVER (PARTITION BY l.conv_id ORDER BY i) AS after_system
  FROM letters l LEFT JOIN rows_in r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.k = r.k AND letter <> 'I' WHERE letter <> 'D'
), left_over AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (n - after_system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS said FROM put GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN found f ON i.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN left_over l ON i.conv_id IS NOT DISTINCT FROM l.conv_id
"""
