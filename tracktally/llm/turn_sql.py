"""DuckDB twin of op12: cheapest repairs by a recursion over the turns, state by state.

A state holds the cost, letters and turns of the best way there; ties go to the least letters.
No way to a node has another's letters as its prefix at equal cost, so comparing ways in the
middle decides as comparing them at the end does.
"""

from __future__ import annotations

INK = r"[^\x20\x09-\x0D]"
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
      lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""


def step(state: str, letter: str, cost: str, said: str | None = None, when: str = "true") -> str:
    turns = f"list_append({state}.said, {said})" if said else f"{state}.said"
    made = f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'said': {turns}}}"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {made} END"


def best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def insert(state: str, role: str) -> str:
    return step(state, "I", "2", f"'{role}:'")


def keep(state: str, initial: str) -> str:
    return step(state, "K", "more", "role || ':' || text", f"fault NOT IN (1, 2) AND starts_with(role, '{initial}')")


def rerole(state: str, role: str) -> str:
    return step(state, "R", "(2 + more)", f"'{role}:' || text", "fault NOT IN (1, 2)")


def delete(state: str) -> str:
    return step(state, "D", "3")


#: What inserting before a turn, or at the end, adds to the states after user and assistant.
USER = best("w.u", *(insert(f"w.{s}", "user") for s in ("b", "s", "a")))
ASSISTANT = best("a", insert("u", "assistant"))

REPAIR_SQL = rf"""
WITH RECURSIVE
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named
  FROM conversations),
lots AS (SELECT *, {CRC.format(key="named")} % 20 AS lot FROM d),
bad AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM lots WHERE lot <> 0),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (
  SELECT c, turn, role, text,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS k
  FROM bad JOIN convs ON bad.conv_id IS NOT DISTINCT FROM convs.conv_id),
heard AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 AS seen FROM numbered),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{INK}') THEN 1 WHEN seen THEN 2
                 WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 3 END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY k) || substr(role, 1, 1) AS meets
  FROM heard),
t AS (SELECT *, (fault = 3)::BIGINT AS more FROM judged),
sums AS (
  SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (meets NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS k
  FROM t GROUP BY c),
walk AS (
  SELECT c, 0::BIGINT AS k, {{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}} AS b,
         NULL::STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[]) AS s, NULL::STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[]) AS u,
         NULL::STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[]) AS a
  FROM convs
  UNION ALL
  SELECT c, k, {delete("b")}, {best(delete("s"), keep("b", "s"))},
         {best(delete("u"), *(f(x, "u" if f is keep else "user") for x in ("b", "s", "a") for f in (keep, rerole)))},
         {best(delete("a"), keep("u", "a"), rerole("u", "assistant"))}
  FROM (SELECT c, k, role, text, fault, more, b, s, u, {ASSISTANT} AS a
        FROM (SELECT w.c, t.k, t.role, t.text, t.fault, t.more, w.b, w.s, {USER} AS u, w.a
              FROM walk w JOIN t ON t.c = w.c AND t.k = w.k + 1))),
ended AS (SELECT c, k, b, {best("a", insert("u", "assistant"))} AS a FROM (SELECT w.c, w.k, w.b, {USER} AS u, w.a FROM walk w)),
done AS (SELECT c, k, {best("b", "a")} AS way FROM ended)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(way.cost, 0) AS BIGINT) AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.said, chr(10)), '')) AS repaired_sha256
FROM convs LEFT JOIN sums USING (c) LEFT JOIN done ON done.c = convs.c AND done.k = sums.k"""
