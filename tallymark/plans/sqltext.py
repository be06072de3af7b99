"""Small builders for the DuckDB check statements."""

from __future__ import annotations

from tallymark.functions import fixed as K


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def not_repeated(c: str) -> str:
    return f"replace({c}, substr({c}, 1, 1), '') <> ''"


def _plain(s: str) -> str:
    c = f"regexp_replace({s}, '[-_ ]', '', 'g')"
    return (
        f"(length({c}) >= 4 AND lower({c}) NOT IN {inlist(K.ACCOUNT_STOP_WORDS)} "
        f"AND regexp_matches({c}, '^[\\p{{L}}\\p{{N}}]+$') AND {not_repeated(c)})"
    )


def valid_account(x: str) -> str:
    s = f"trim({x})"
    return (
        f"CASE WHEN coalesce({s}, '') = '' THEN false WHEN regexp_matches({s}, '[*xX#]') THEN length({digits(s)}) >= 3 "
        f"WHEN contains({s}, '-') THEN length({digits(s)}) >= 4 ELSE {_plain(s)} END"
    )


def valid_account_strict(x: str) -> str:
    s = f"trim({x})"
    c = f"regexp_replace({s}, '[-_ ]', '', 'g')"
    return (
        f"CASE WHEN coalesce({s}, '') = '' THEN false WHEN contains({s}, '*') THEN false "
        f"WHEN regexp_matches({s}, '[xX#]') AND length({s}) <= 8 THEN false "
        f"WHEN regexp_matches({c}, '^[0-9]{{4}}$') THEN false ELSE {_plain(s)} END"
    )


def valid_routing(x: str) -> str:
    def d(i):
        return f"CAST(substr({x}, {i}, 1) AS INTEGER)"

    total = f"3 * ({d(1)} + {d(4)} + {d(7)}) + 7 * ({d(2)} + {d(5)} + {d(8)}) + {d(3)} + {d(6)} + {d(9)}"
    return (
        f"CASE WHEN regexp_matches(coalesce({x}, ''), '^[0-9]{{9}}$') THEN ({total}) % 10 = 0 AND {not_repeated(x)} "
        f"ELSE false END"
    )


def first_valid(text: str, patterns, valid, shape=lambda m: m, flags: str = "(?i)") -> str:
    parts = [
        f"list_filter(list_transform(regexp_extract_all({text}, {q(flags + p)}, 1), lambda m: {shape('m')}), "
        f"lambda m: {valid('m')})[1]"
        for p in patterns
    ]
    return "coalesce(" + ", ".join(parts) + ")"


def norm_bank(x: str) -> str:
    s = f"trim(upper(coalesce({x}, '')))"
    s = f"regexp_replace({s}, '[,\\.]+', '', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\b(?:STOCK\\s+YARDS|STOCKYARDS)\\b', 'STOCK YARDS', 'g')"
    s = f"regexp_replace({s}, '\\s*&\\s*', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s+AND\\s+', ' ', 'g')"
    for p in K.BANK_NORM_SUFFIXES:
        s = f"regexp_replace({s}, {q(p)}, '', 'g')"
    for a, b in K.BANK_NORM_REPLACEMENTS:
        s = f"replace({s}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def sanitize(x: str) -> str:
    s = f"replace(coalesce({x}, ''), '/', '-')"
    s = f"regexp_replace({s}, '[^\\x20-\\x7E]', ' ', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'), ' ')"


def rules(low: str, table) -> str:
    whens = " ".join(
        "WHEN " + " AND ".join(any_contains(low, g) for g in groups) + f" THEN '{code}'" for code, groups in table
    )
    return f"CASE {whens} ELSE '{K.ERROR_UNKNOWN}' END"


# Ratcliff-Obershelp similarity of (a, b) pairs, as a recursive search for the longest common
# block; the leftmost block wins among equals. Give a CTE named ``pairs`` with columns a, b.
SIMILARITY = """
segs AS (
  SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS matched
  FROM (SELECT DISTINCT a, b FROM pairs)
  UNION ALL
  SELECT a, b, nalo, nahi, nblo, nbhi, m FROM (
    SELECT a, b, unnest([
        {'nalo': alo, 'nahi': hit.i, 'nblo': blo, 'nbhi': hit.j, 'm': hit.k},
        {'nalo': hit.i + hit.k, 'nahi': ahi, 'nblo': hit.j + hit.k, 'nbhi': bhi, 'm': 0}], recursive := true)
    FROM (
      SELECT a, b, alo, ahi, blo, bhi,
        list_sort(list_filter(flatten(list_transform(range(alo, ahi), lambda i:
          list_transform(range(blo, bhi), lambda j: {'n': -len(list_filter(range(1, least(ahi - i, bhi - j) + 1),
             lambda k: substr(a, i, k) = substr(b, j, k))), 'i': i, 'j': j,
             'k': len(list_filter(range(1, least(ahi - i, bhi - j) + 1),
             lambda k: substr(a, i, k) = substr(b, j, k)))}))), lambda x: x.k > 0))[1] AS hit
      FROM segs WHERE alo < ahi AND blo < bhi)
    WHERE hit IS NOT NULL)
),
sims AS (
  SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0
    ELSE 2.0 * sum(matched) / (length(a) + length(b)) END AS sim
  FROM segs GROUP BY a, b
)"""
