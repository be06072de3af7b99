"""The workload views as DuckDB common table expressions, for checking results."""

from tallymark.plans.workload import PAGE

PLACE = "translate({0}, '_0123456789', ' ABCDEFGHIJ')"
MONEY = "format('{{:,.2f}}', CAST({0} / 100.0 AS DOUBLE))"


def acct12(n: str) -> str:
    return f"lpad(CAST({n} * 125 + 1000003 AS VARCHAR), 12, '0')"


def _check(base: str) -> str:
    def d(i):
        return f"CAST(substr({base}, {i}, 1) AS INTEGER)"

    return (
        f"CAST((10 - (3 * ({d(1)} + {d(4)} + {d(7)}) + 7 * ({d(2)} + {d(5)} + {d(8)}) + {d(3)} + {d(6)}) % 10) % 10 AS VARCHAR)"
    )


_RBASE = "lpad(CAST(s_suppkey * 37 + 11000000 AS VARCHAR), 8, '0')"
REGISTRY = f"""registry AS (
  SELECT s_suppkey AS ordinal,
    CASE s_suppkey % 4 WHEN 0 THEN 'First National Bank of ' || {PLACE.format('n_name')}
      WHEN 1 THEN {PLACE.format('n_name')} || ' Community Bank & Trust'
      WHEN 2 THEN 'Bank of ' || {PLACE.format('n_name')}
      ELSE {PLACE.format('n_name')} || ' Federal Credit Union' END AS bank_name,
    CAST(s_suppkey % 900 + 100 AS VARCHAR) || ' Main Street' AS address,
    {acct12('s_suppkey')} AS account_number,
    {_RBASE} || {_check(_RBASE)} AS routing_number
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

_A = acct12("(c_custkey // 15)")
DETECTED = f"""detected AS (
  SELECT c_custkey AS doc_id,
    CASE c_custkey % 9 WHEN 0 THEN {_A} WHEN 1 THEN ltrim({_A}, '0')
      WHEN 2 THEN 'XXXXXX' || right({_A}, 4) WHEN 3 THEN '***' || right({_A}, 2)
      WHEN 4 THEN '***' || right({_A}, 4) WHEN 5 THEN '*' || right({_A}, 4)
      WHEN 6 THEN 'xxxxx' || right({_A}, 3)
      WHEN 7 THEN substr({_A}, 1, 6) || '-' || substr({_A}, 7, 6)
      ELSE '99' || lpad(CAST(c_custkey AS VARCHAR), 8, '7') END AS account,
    CASE c_custkey % 4 WHEN 1 THEN 'FIRST NATIONAL BANK OF ' || {PLACE.format('n_name')}
      WHEN 2 THEN {PLACE.format('n_name')} || ' Community Bank'
      WHEN 3 THEN 'Harbor Lending Group' END AS bank_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

LEDGER = f"""ledger AS (
  SELECT concat_ws('-', 'S' || o_custkey, year(o_orderdate) // 10,
      o_orderkey % ((count(*) OVER (PARTITION BY o_custkey, year(o_orderdate) // 10) + {PAGE} - 1) // {PAGE})) AS doc_id,
    o_custkey AS account, o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS txn_date,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
    o_orderstatus = 'F' AS is_debit, o_orderpriority = '1-URGENT' AS is_fee,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Maintenance Fee ' WHEN '2-HIGH' THEN 'Deposit / Branch '
      WHEN '3-MEDIUM' THEN 'Card Purchase, Rivertown ' WHEN '4-NOT SPECIFIED' THEN 'Preauthorized Wd '
      ELSE 'Café Payment  No ' END || CAST(o_orderkey AS VARCHAR) AS description
  FROM orders)"""

BALANCES = """net AS (
  SELECT account AS a, CAST(sum(amount_cents) AS BIGINT) AS net, CAST(sum(greatest(amount_cents, 0)) AS BIGINT) AS dep
  FROM ledger GROUP BY account),
balances AS (
  SELECT c_custkey AS account,
    CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN coalesce(dep, 0)
      ELSE CAST(round(c_acctbal * 100) AS BIGINT) END AS opening,
    CASE WHEN c_custkey % 13 <> 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) + coalesce(net, 0)
      + CASE WHEN c_custkey % 7 = 0 THEN 250 ELSE 0 END + c_custkey % 2 END AS closing
  FROM customer LEFT JOIN net ON c_custkey = a)"""

_SA = acct12("account")
STATEMENTS = f"""statements AS (
  SELECT doc_id, account,
    'First National Bank of ' || {PLACE.format("('NATION_' || CAST(account % 25 AS VARCHAR))")} || chr(10) ||
    CASE account % 5 WHEN 0 THEN 'Account Number: ' || {_SA}
      WHEN 1 THEN 'Account number' || chr(10) || {_SA} || ' Beginning balance'
      WHEN 2 THEN 'Acct #: XXXXXX' || right({_SA}, 4)
      WHEN 3 THEN 'Your account ending in ' || right({_SA}, 4) ELSE 'Customer copy' END || chr(10) ||
    'Statement Period 01/01/2025 through 06/30/2025' || chr(10) || 'DEBITS' || chr(10) ||
    coalesce(string_agg(strftime(txn_date, '%m-%d') || chr(10) || description || chr(10) || {MONEY.format('cents')} || chr(10), '' ORDER BY txn_date, txn_id) FILTER (WHERE is_debit), '') ||
    'CREDITS' || chr(10) ||
    coalesce(string_agg(strftime(txn_date, '%m-%d') || chr(10) || description || chr(10) || {MONEY.format('cents')} || chr(10), '' ORDER BY txn_date, txn_id) FILTER (WHERE NOT is_debit), '') ||
    'DAILY BALANCES' || chr(10) ||
    string_agg(strftime(txn_date, '%m-%d') || chr(10) || {MONEY.format('cents')}, chr(10) ORDER BY txn_date, txn_id) AS text
  FROM ledger GROUP BY doc_id, account)"""

_DEC = "CAST({0} // 100 AS VARCHAR) || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"
_LINE = f"""'16,' || CASE WHEN is_debit THEN '451' ELSE '301' END || ',' ||
      CASE txn_id % 3 WHEN 0 THEN CAST(cents AS VARCHAR) WHEN 1 THEN {_DEC.format('cents')}
        ELSE '-' || CAST(cents AS VARCHAR) END || ',Z,999,,' || description || '/' || chr(10)"""
BAI2_FILES = f"""per_file AS (
  SELECT doc_id AS file_id, account,
    coalesce(string_agg({_LINE}, '' ORDER BY txn_date, txn_id) FILTER (WHERE is_debit), '') AS out_lines,
    coalesce(string_agg({_LINE}, '' ORDER BY txn_date, txn_id) FILTER (WHERE NOT is_debit), '') AS in_lines,
    CAST(coalesce(sum(cents) FILTER (WHERE is_debit), 0) AS BIGINT) AS out_cents,
    CAST(coalesce(sum(cents) FILTER (WHERE NOT is_debit), 0) AS BIGINT) AS in_cents
  FROM ledger GROUP BY doc_id, account),
bai2_files AS (
  SELECT file_id, account,
    CASE WHEN account % 13 <> 12 THEN '01,ORIG' || CAST(account AS VARCHAR) || ',WORKDAY,' ||
      CASE WHEN account % 5 = 0 THEN '251340' ELSE '250630' END || ',1200,1,,,2/' || chr(10) ELSE '' END ||
    '16,301,5,Z,1,,orphan/' || chr(10) ||
    '02,WORKDAY,ORIG' || CAST(account AS VARCHAR) || ',1,' || CASE WHEN account % 4 = 1 THEN '250631' ELSE '250630' END || ',,USD,2/' || chr(10) ||
    '03,' || {_SA} || ',USD,010,,,Z/' || chr(10) || out_lines ||
    CASE account % 3 WHEN 0 THEN '49,-' || {_DEC.format('out_cents')} || ',0/' || chr(10)
      WHEN 1 THEN '49,' || CAST(out_cents AS VARCHAR) || ',0/' || chr(10) ELSE '' END ||
    '98,0,0,0/' || chr(10) || '16,301,777,Z,1,,late entry/' || chr(10) || chr(10) ||
    '02,WORKDAY,ORIG' || CAST(account AS VARCHAR) || ',1,250630,,USD,2/' || chr(10) ||
    '03,' || {_SA} || ',USD,010,,,Z/' || chr(10) || in_lines ||
    '49,' || CAST(in_cents AS VARCHAR) || ',0/' || chr(10) ||
    CASE WHEN account % 7 <> 0 THEN '98,0,0,0/' || chr(10) ELSE '' END || '99,0,0,0/' AS text
  FROM per_file)"""

_DA = "lpad(CAST(doc_id * 37 + 1000003 AS VARCHAR), 10, '0')"
_DR = "lpad(CAST(doc_id * 37 + 11000000 AS VARCHAR), 8, '0')"
NOISY = f"""noisy AS (
  SELECT doc_id,
    CASE doc_id % 7 WHEN 0 THEN 'First National Bank of Rivertown' WHEN 1 THEN 'MEMBER FDIC Harbor Savings Bank'
      WHEN 2 THEN 'Statement of account' WHEN 3 THEN 'Lakeside Federal Credit Union Phone 555-1234'
      WHEN 4 THEN 'Bank of the West Hills and Trust Company' WHEN 5 THEN '1 First United Bank & Trust'
      ELSE 'Mesa Savings and Loan Association of Harbor' END || chr(10) ||
    CASE doc_id % 12 WHEN 0 THEN 'Account Number: ' || {_DA}
      WHEN 1 THEN 'Account # : ' || substr({_DA}, 5, 3) || '-' || substr({_DA}, 8, 3)
      WHEN 2 THEN 'ACCOUNT' || chr(10) || {_DA}
      WHEN 3 THEN 'Checking Account Number' || chr(10) || 'Branch 12' || chr(10) || {_DA} || ' Joint'
      WHEN 4 THEN 'Acct # XXXX' || right({_DA}, 4) WHEN 5 THEN 'Card ending in ' || right({_DA}, 4)
      WHEN 6 THEN 'Savings account: **' || right({_DA}, 4) WHEN 7 THEN 'Last 4 digits: ' || right({_DA}, 4)
      WHEN 8 THEN 'Routing number: ' || {_DR} || {_check(_DR)} || ' today'
      WHEN 9 THEN 'For account AB' || {_DA}
      WHEN 10 THEN 'Balance total $10.00 last ' || right({_DA}, 4) || ' digits'
      ELSE 'No reference here' END || chr(10) ||
    CASE doc_id % 5 WHEN 0 THEN 'Statement Period 07/01/25 through 07/31/25'
      WHEN 1 THEN 'From 6/1/2025 to 6/30/2025' WHEN 2 THEN 'Date 06/15/2025'
      WHEN 3 THEN 'June 30, 2025' ELSE 'Opened 3/4' END || chr(10) || text AS text
  FROM documents)"""

_TEXTS = [
    "Multiple accounts match with low similarity", "Multiple accounts but no bank given",
    "Routing number missing", "Account not found in file", "No account number on page",
    "Bank name unreadable", "OpenAI parsing broke", "Document Intelligence failed",
    "Connection reset by peer", "Network down", "Request timeout", "Rate limit 429 reached",
    "Out of memory", "Authentication 401", "KeyError: field", "Processing failed", "Quota used up",
    "Odd trouble", "Socket closed",
]
_KINDS = ["ValueError", "TimeoutError", "KeyError", "MemoryError", "Exception", "AttributeError", "IndexError"]


def _case(expr, values):
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


MESSAGES = f"""messages AS (
  SELECT event_id, ts, {_case(f'event_id % {len(_TEXTS)}', _TEXTS)} || ' for user ' || CAST(user_id AS VARCHAR) AS message,
    {_case(f'event_id % {len(_KINDS)}', _KINDS)} AS exc_type FROM events)"""

INCOMING = """incoming AS (
  SELECT event_id, ts,
    'https://store.example.com/data/' || CASE WHEN event_id % 5 = 0 THEN 'archive' ELSE 'incoming-bank-statements' END
      || '/file' || CAST(user_id AS VARCHAR) || '.pdf' AS url,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE '/blobServices/default/containers/data/blobs/' ||
      CASE WHEN event_id % 5 = 0 THEN 'archive' ELSE 'incoming-bank-statements' END || '/file' || CAST(user_id AS VARCHAR) || '.pdf' END AS subject,
    CAST(user_id % 3 AS VARCHAR) AS etag FROM events)"""

VIEWS = {
    "registry": [REGISTRY],
    "detected": [DETECTED],
    "ledger": [LEDGER],
    "balances": [LEDGER, BALANCES],
    "statements": [LEDGER, STATEMENTS],
    "bai2": [LEDGER, BAI2_FILES],
    "noisy": [NOISY],
    "messages": [MESSAGES],
    "incoming": [INCOMING],
}


def ctes(*names: str, recursive: bool = False, extra: str = "") -> str:
    """WITH clause holding the named views once each, and further ones."""
    seen: list[str] = []
    for n in names:
        for part in VIEWS[n]:
            if part not in seen:
                seen.append(part)
    if extra:
        seen.append(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(seen) + "\n"
