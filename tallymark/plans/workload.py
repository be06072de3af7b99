"""Bank-statement views over the given tables.

The tables hold orders, customers, suppliers and free texts, not statements. These views give them
the shapes the operators expect: suppliers become the registry, orders the ledger, ledgers the
printed statements and BAI2 files (with faults), documents the noisy texts.

A statement is an account, a calendar decade and a page. Accounts with more than ``PAGE`` transactions
in a decade, counted first, are dealt to numbered pages, so an account that holds a third of all
orders is spread over many statements and grouping by statement is bounded, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.scalars import money_text

PAGE = 20000
DAY = "250701"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def once(value: Column) -> Column:
    """A built text as a generator's output: filters on it stay above, so it is built one time."""
    return F.explode(F.array(value))


def place(name: Column) -> Column:
    return F.translate(name, "_0123456789", " ABCDEFGHIJ")


def account12(n: Column) -> Column:
    return F.lpad((n * 125 + 1000003).cast("string"), 12, "0")


def _right(c: Column, n: int) -> Column:
    return F.substring(c, -n, n)


def registry(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    p = place(F.col("n_name"))
    kind = F.col("s_suppkey") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("First National Bank of "), p))
        .when(kind == 1, F.concat(p, F.lit(" Community Bank & Trust")))
        .when(kind == 2, F.concat(F.lit("Bank of "), p))
        .otherwise(F.concat(p, F.lit(" Federal Credit Union")))
    )
    base = F.lpad((F.col("s_suppkey") * 37 + 11000000).cast("string"), 8, "0")
    d = [F.substring(base, i, 1).cast("int") for i in range(1, 9)]
    total = 3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5]
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("ordinal"),
        name.alias("bank_name"),
        F.concat((F.col("s_suppkey") % 900 + 100).cast("string"), F.lit(" Main Street")).alias("address"),
        account12(F.col("s_suppkey")).alias("account_number"),
        F.concat(base, ((10 - total % 10) % 10).cast("string")).alias("routing_number"),
    )


def detected(spark: SparkSession, sf: str) -> DataFrame:
    """Account and bank name as read from one statement per customer, in many printed forms."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    acct = account12(F.expr("c_custkey div 15"))
    form = F.col("c_custkey") % 9
    account = (
        F.when(form == 0, acct)
        .when(form == 1, F.ltrim(acct, F.lit("0")))
        .when(form == 2, F.concat(F.lit("XXXXXX"), _right(acct, 4)))
        .when(form == 3, F.concat(F.lit("***"), _right(acct, 2)))
        .when(form == 4, F.concat(F.lit("***"), _right(acct, 4)))
        .when(form == 5, F.concat(F.lit("*"), _right(acct, 4)))
        .when(form == 6, F.concat(F.lit("xxxxx"), _right(acct, 3)))
        .when(form == 7, F.concat(F.substring(acct, 1, 6), F.lit("-"), F.substring(acct, 7, 6)))
        .otherwise(F.concat(F.lit("99"), F.lpad(F.col("c_custkey").cast("string"), 8, "7")))
    )
    p = place(F.col("n_name"))
    kind = F.col("c_custkey") % 4
    bank = (
        F.when(kind == 1, F.concat(F.lit("FIRST NATIONAL BANK OF "), p))
        .when(kind == 2, F.concat(p, F.lit(" Community Bank")))
        .when(kind == 3, F.lit("Harbor Lending Group"))
    )
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").alias("doc_id"), account.alias("account"), bank.alias("bank_name")
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", "Maintenance Fee ")
        .when(p == "2-HIGH", "Deposit / Branch ")
        .when(p == "3-MEDIUM", "Card Purchase, Rivertown ")
        .when(p == "4-NOT SPECIFIED", "Preauthorized Wd ")
        .otherwise("Café Payment  No ")
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    debit = F.col("o_orderstatus") == "F"
    o = o.withColumn("decade", F.expr("year(o_orderdate) div 10"))
    hot = o.groupBy(F.col("o_custkey").alias("hot_key"), F.col("decade").alias("hot_decade")).count()
    hot = hot.where(F.col("count") > PAGE).withColumn("pages", F.ceil(F.col("count") / PAGE))
    o = o.join(hot, (F.col("o_custkey") == F.col("hot_key")) & (F.col("decade") == F.col("hot_decade")), "left")
    page = F.coalesce(F.col("o_orderkey") % F.col("pages"), F.lit(0))
    return o.select(
        F.concat_ws("-", F.concat(F.lit("S"), F.col("o_custkey")), F.col("decade"), page).alias("doc_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderkey").alias("txn_id"),
        F.to_date("o_orderdate").alias("txn_date"),
        cents.alias("cents"),
        F.when(debit, -cents).otherwise(cents).alias("amount_cents"),
        debit.alias("is_debit"),
        (p == "1-URGENT").alias("is_fee"),
        F.concat(text, F.col("o_orderkey").cast("string")).alias("description"),
    )


def balances(spark: SparkSession, sf: str) -> DataFrame:
    """Opening and closing per account; some closings are off, some are missing."""
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("o")
    )
    t = ledger(spark, sf).groupBy("account").agg(
        F.sum("amount_cents").alias("net"), F.sum(F.greatest("amount_cents", F.lit(0))).alias("dep")
    )
    key = F.col("account")
    opening = (
        F.when(key % 11 == 0, F.lit(None).cast("bigint"))
        .when(key % 17 == 0, F.coalesce("dep", F.lit(0)))
        .otherwise(F.col("o"))
    )
    closing = F.when(key % 13 != 0, F.col("o") + F.coalesce("net", F.lit(0)) + F.when(key % 7 == 0, 250).otherwise(0) + key % 2)
    return c.join(t, "account", "left").select("account", opening.alias("opening"), closing.alias("closing"))


def _header(account: Column) -> Column:
    acct = account12(account)
    last4 = _right(acct, 4)
    form = account % 5
    line = (
        F.when(form == 0, F.concat(F.lit("Account Number: "), acct))
        .when(form == 1, F.concat(F.lit("Account number\n"), acct, F.lit(" Beginning balance")))
        .when(form == 2, F.concat(F.lit("Acct #: XXXXXX"), last4))
        .when(form == 3, F.concat(F.lit("Your account ending in "), last4))
        .otherwise(F.lit("Customer copy"))
    )
    bank = F.concat(
        F.lit("First National Bank of "), place(F.concat(F.lit("NATION_"), (account % 25).cast("string")))
    )
    return F.concat(bank, F.lit("\n"), line, F.lit("\nStatement Period 01/01/2025 through 06/30/2025"))


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Printed statements: header, DEBITS, CREDITS and a DAILY BALANCES block."""
    rows = F.array_sort(
        F.collect_list(
            F.struct(
                "txn_date",
                "txn_id",
                "is_debit",
                F.date_format("txn_date", "MM-dd").alias("day"),
                "description",
                money_text("cents").alias("amount"),
            )
        )
    )
    g = ledger(spark, sf).groupBy("doc_id", "account").agg(rows.alias("r"))

    def block(name, rows):
        return F.concat(F.array(F.lit(name)), rows)

    def txn(x):
        return F.concat_ws("\n", x["day"], x["description"], x["amount"])

    text = F.array_join(
        F.concat(
            F.array(_header(F.col("account"))),
            block("DEBITS", F.transform(F.filter("r", lambda x: x["is_debit"]), txn)),
            block("CREDITS", F.transform(F.filter("r", lambda x: ~x["is_debit"]), txn)),
            block("DAILY BALANCES", F.transform("r", lambda x: F.concat_ws("\n", x["day"], x["amount"]))),
        ),
        "\n",
    )
    return g.select("doc_id", "account", once(text).alias("text"))


def bai2_files(spark: SparkSession, sf: str) -> DataFrame:
    """Cash-management files with the usual faults: bad dates, decimals, signs, missing trailers,
    stray entries, unsafe descriptions and, for some, no header at all."""
    cents = F.col("cents").cast("string")
    amount = (
        F.when(F.col("txn_id") % 3 == 0, cents)
        .when(
            F.col("txn_id") % 3 == 1,
            F.concat(
                F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
            ),
        )
        .otherwise(F.concat(F.lit("-"), cents))
    )
    line = F.concat(
        F.lit("16,"), F.when(F.col("is_debit"), "451").otherwise("301"), F.lit(","), amount, F.lit(",Z,999,,"),
        F.col("description"), F.lit("/"),
    )
    g = ledger(spark, sf).groupBy("doc_id", "account").agg(
        F.array_sort(F.collect_list(F.struct("txn_date", "txn_id", "is_debit", line.alias("line")))).alias("r"),
        F.sum(F.when(F.col("is_debit"), F.col("cents")).otherwise(0)).alias("out_cents"),
        F.sum(F.when(F.col("is_debit"), 0).otherwise(F.col("cents"))).alias("in_cents"),
    )
    a = F.col("account")
    acct = account12(a)
    orig = F.concat(F.lit("ORIG"), a.cast("string"))
    out_text = F.concat(
        F.lit("-"), F.expr("out_cents div 100").cast("string"), F.lit("."),
        F.lpad((F.col("out_cents") % 100).cast("string"), 2, "0"),
    )
    none = F.array().cast("array<string>")

    def lines(debit):
        return F.transform(F.filter("r", lambda x: x["is_debit"] == F.lit(debit)), lambda x: x["line"])

    def group_head(day):
        return F.array(
            F.concat(F.lit("02,WORKDAY,"), orig, F.lit(",1,"), day, F.lit(",,USD,2/")),
            F.concat(F.lit("03,"), acct, F.lit(",USD,010,,,Z/")),
        )

    text = F.array_join(
        F.concat(
            F.when(
                a % 13 != 12,
                F.array(
                    F.concat(
                        F.lit("01,"), orig, F.lit(",WORKDAY,"), F.when(a % 5 == 0, "251340").otherwise("250630"),
                        F.lit(",1200,1,,,2/"),
                    )
                ),
            ).otherwise(none),
            F.array(F.lit("16,301,5,Z,1,,orphan/")),
            group_head(F.when(a % 4 == 1, "250631").otherwise("250630")),
            lines(True),
            F.when(a % 3 == 0, F.array(F.concat(F.lit("49,"), out_text, F.lit(",0/"))))
            .when(a % 3 == 1, F.array(F.concat(F.lit("49,"), F.col("out_cents").cast("string"), F.lit(",0/"))))
            .otherwise(none),
            F.array(F.lit("98,0,0,0/"), F.lit("16,301,777,Z,1,,late entry/"), F.lit("")),
            group_head(F.lit("250630")),
            lines(False),
            F.array(F.concat(F.lit("49,"), F.col("in_cents").cast("string"), F.lit(",0/"))),
            F.when(a % 7 != 0, F.array(F.lit("98,0,0,0/"))).otherwise(none),
            F.array(F.lit("99,0,0,0/")),
        ),
        "\n",
    )
    return g.select(F.col("doc_id").alias("file_id"), "account", once(text).alias("text"))


def noisy_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents under a statement header in one of many printed forms."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    acct = F.lpad((k * 37 + 1000003).cast("string"), 10, "0")
    last4 = _right(acct, 4)
    base = F.lpad((k * 37 + 11000000).cast("string"), 8, "0")
    dg = [F.substring(base, i, 1).cast("int") for i in range(1, 9)]
    total = 3 * (dg[0] + dg[3] + dg[6]) + 7 * (dg[1] + dg[4] + dg[7]) + dg[2] + dg[5]
    routing = F.concat(base, ((10 - total % 10) % 10).cast("string"))
    lines = [
        F.concat(F.lit("Account Number: "), acct),
        F.concat(F.lit("Account # : "), F.substring(acct, 5, 3), F.lit("-"), F.substring(acct, 8, 3)),
        F.concat(F.lit("ACCOUNT\n"), acct),
        F.concat(F.lit("Checking Account Number\nBranch 12\n"), acct, F.lit(" Joint")),
        F.concat(F.lit("Acct # XXXX"), last4),
        F.concat(F.lit("Card ending in "), last4),
        F.concat(F.lit("Savings account: **"), last4),
        F.concat(F.lit("Last 4 digits: "), last4),
        F.concat(F.lit("Routing number: "), routing, F.lit(" today")),
        F.concat(F.lit("For account AB"), acct),
        F.concat(F.lit("Balance total $10.00 last "), last4, F.lit(" digits")),
        F.lit("No reference here"),
    ]
    names = [
        "First National Bank of Rivertown",
        "MEMBER FDIC Harbor Savings Bank",
        "Statement of account",
        "Lakeside Federal Credit Union Phone 555-1234",
        "Bank of the West Hills and Trust Company",
        "1 First United Bank & Trust",
        "Mesa Savings and Loan Association of Harbor",
    ]
    periods = [
        "Statement Period 07/01/25 through 07/31/25",
        "From 6/1/2025 to 6/30/2025",
        "Date 06/15/2025",
        "June 30, 2025",
        "Opened 3/4",
    ]

    def pick(values):
        out = F
        for i, v in enumerate(values):
            out = out.when(k % len(values) == i, v if isinstance(v, Column) else F.lit(v))
        return out

    return d.select(
        "doc_id",
        F.concat_ws("\n", pick(names), pick(lines), pick(periods), F.col("text")).alias("text"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Failure messages and exception types, one per event."""
    e = table(spark, sf, "events")
    texts = [
        "Multiple accounts match with low similarity", "Multiple accounts but no bank given",
        "Routing number missing", "Account not found in file", "No account number on page",
        "Bank name unreadable", "OpenAI parsing broke", "Document Intelligence failed",
        "Connection reset by peer", "Network down", "Request timeout", "Rate limit 429 reached",
        "Out of memory", "Authentication 401", "KeyError: field", "Processing failed", "Quota used up",
        "Odd trouble", "Socket closed",
    ]
    kinds = ["ValueError", "TimeoutError", "KeyError", "MemoryError", "Exception", "AttributeError", "IndexError"]
    k = F.col("event_id")
    msg, kind = F, F
    for i, t in enumerate(texts):
        msg = msg.when(k % len(texts) == i, t)
    for i, t in enumerate(kinds):
        kind = kind.when(k % len(kinds) == i, t)
    return e.select(
        "event_id",
        "ts",
        F.concat(msg, F.lit(" for user "), F.col("user_id").cast("string")).alias("message"),
        kind.alias("exc_type"),
    )


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    """Storage events: folders that are ours and not, empty subjects, repeated keys."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    name = F.concat(F.lit("file"), F.col("user_id").cast("string"), F.lit(".pdf"))
    folder = F.when(k % 5 == 0, "archive").otherwise("incoming-bank-statements")
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("https://store.example.com/data/"), folder, F.lit("/"), name).alias("url"),
        F.when(k % 4 == 0, F.lit(""))
        .otherwise(
            F.concat(F.lit("/blobServices/default/containers/data/blobs/"), folder, F.lit("/"), name)
        )
        .alias("subject"),
        (F.col("user_id") % 3).cast("string").alias("eTag"),
    )
