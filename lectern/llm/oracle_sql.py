"""DuckDB SQL for the rows of queries that SQL can express: by plain rounds, plain joins of events and plain word grams."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from lectern.llm import license_scan


def _crc32(value: str) -> str:
    """crc32 of a value written as text in ASCII, bit by bit."""
    codes = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    bits = "lambda q, k: xor(q >> 1, CASE WHEN q & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), {bits})), 4294967295)"


def clusters(k: int = 40, rounds: int = 5, seed: str = "2:", scale: int = 256, dimension: int = 64) -> str:
    squared = "list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT rid, vec_id, kept.v, c.c, {squared} AS d FROM kept CROSS JOIN c{n} c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c.c) = 1)")
        if n < rounds:
            each = f"SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dimension})) AS i FROM a{n}) GROUP BY c, i"
            means = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM ({each}) GROUP BY c"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT old.c, coalesce(u.v, old.v) AS v FROM c{n} old LEFT JOIN ({means}) u ON u.c = old.c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} f ON f.c = a.c"""


def sequences(gap: int = 900_000_000, span: int = 2_250_000_000, longest: int = 4) -> str:
    parts = [
        "raw AS (SELECT click_id, client_id AS c, epoch_us(ts) AS t, kind FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL)",
        f"framed AS (SELECT c, t FROM raw WHERE click_id IS NOT NULL AND {_crc32('click_id')} % 5 = 0)",
        "e AS MATERIALIZED (SELECT c, t, kind FROM raw UNION SELECT c, t - 1000000, 'open' FROM framed UNION SELECT c, t + 1000000, 'shut' FROM framed)",
        "l1 AS MATERIALIZED (SELECT c, t, kind AS p, t AS s FROM e)",
    ]
    for n in range(2, longest + 1):
        parts.append(
            f"l{n} AS MATERIALIZED (SELECT e.c, e.t, l.p || '>' || e.kind AS p, max(l.s) AS s FROM l{n - 1} l JOIN e ON e.c = l.c AND e.t > l.t AND e.t <= l.t + {gap} AND e.t - l.s <= {span} GROUP BY ALL)"
        )
    every = " UNION ".join(f"SELECT p, c FROM l{n}" for n in range(1, longest + 1))
    split = "string_split(p, '>')"
    return f"""WITH {", ".join(parts)},
crc AS (SELECT c, {_crc32("c")} AS crc FROM (SELECT DISTINCT c FROM e)),
kept AS (SELECT p, len({split}) AS length, count(*) AS support, CAST(sum(crc) AS BIGINT) AS clients_crc FROM ({every}) JOIN crc USING (c) GROUP BY p
  HAVING count(*) >= 2 AND count(*) * 10 >= 3 * (SELECT count(*) FROM crc)),
less AS (SELECT DISTINCT p AS wide, support, array_to_string(list_filter({split}, lambda x, i: (b >> (i - 1)) & 1 = 1), '>') AS p FROM kept, range(1, {2**longest - 1}) r(b) WHERE b < (1 << length) - 1),
wider AS (SELECT p, support, count(*) AS n FROM less GROUP BY ALL)
SELECT p AS pattern, CAST(length AS INTEGER) AS length, kept.support, clients_crc, coalesce(n, 0) AS n_wider, n IS NULL AS closed FROM kept LEFT JOIN wider USING (p, support)"""


def licenses() -> str:
    told = [(label, text, True) for text, label in license_scan.PHRASES.items()] + [(label, text, False) for label, text in license_scan.STATEMENTS]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(label)}, {str(exact).lower()}, {quoted(text)})" for k, (label, text, exact) in enumerate(told))
    cut = lambda text: f"regexp_extract_all(translate({text}, '{ascii_uppercase}', '{ascii_lowercase}'), '{license_scan.WORD}')"

    def grams(n: int) -> str:
        joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
        return f"unnest(range(len(w) - {n - 1})) AS pos, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {joined})) AS gram"

    short, long = license_scan.PHRASE_GRAM, license_scan.GRAM
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {cut("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT template, label, exact, {cut("text")} AS w FROM (VALUES {rows}) x(template, label, exact, text)),
tg AS (SELECT template, exact, {grams(short)} FROM t WHERE exact UNION ALL SELECT template, exact, {grams(long)} FROM t WHERE NOT exact),
dg AS (SELECT rid, TRUE AS exact, {grams(short)} FROM d WHERE len(w) >= {short} UNION ALL SELECT rid, FALSE, {grams(long)} FROM d WHERE len(w) >= {long}),
hit AS (SELECT rid, template, dg.pos, tg.pos AS tpos FROM dg JOIN tg ON dg.exact = tg.exact AND dg.gram = tg.gram),
voted AS (SELECT rid, template, pos - tpos AS diagonal, list(DISTINCT tpos) AS ats, min(pos) AS first FROM hit GROUP BY ALL),
named AS (SELECT v.*, label, exact, len(t.w) AS n, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, v.template ORDER BY diagonal) > len(t.w) // {license_scan.SHIFT}, TRUE) THEN 1 ELSE 0 END AS fresh
  FROM voted v JOIN t USING (template)),
merged AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM named),
spans AS (SELECT rid, label, exact, min(first) AS start, len(list_distinct(flatten(list(ats)))) / CAST(n - CASE WHEN exact THEN {short} ELSE {long} END + 1 AS DOUBLE) AS agreement
  FROM merged GROUP BY rid, template, span, label, exact, n),
real AS (SELECT * FROM spans WHERE NOT exact OR agreement = 1),
told AS (SELECT rid, count(*) FILTER (WHERE exact) AS n_base, min(start) FILTER (WHERE exact) AS first_word, max(start) FILTER (WHERE exact) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE exact)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE exact OR agreement >= {license_scan.AGREEMENT})), ',') AS labels, max(agreement) AS score FROM real GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN told USING (rid)"""
