"""Statement to cash-management file: the whole way, for a batch or a micro-batch.

Per document, in one projection: account, bank name, statement date. One join by lookup against
the registry. Transactions are read and the file is written in the row, so nothing is regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.predicates import let
from tallymark.functions.scalars import sanitize
from tallymark.operators import accounts as A
from tallymark.operators import bai2 as B
from tallymark.operators import banks as N
from tallymark.operators import error_files as E
from tallymark.operators import match as M
from tallymark.operators import transactions as T
from tallymark.session import work_dir

ERRORS = {
    "multiple_accounts_low_similarity": "ERROR_MULTIPLE_ACCOUNTS_LOW_SIMILARITY",
    "multiple_accounts_no_bank_name": "ERROR_MULTIPLE_ACCOUNTS_NO_BANK",
}


def _header_columns() -> list[Column]:
    return [
        F.col("doc_id"),
        F.col("text"),
        A.account_cascade("text", low="_low").alias("account"),
        N.bank_name("text").alias("bank_name"),
        N.statement_date(text="text").alias("file_date"),
    ]


def read_header(docs: DataFrame) -> DataFrame:
    """Account, bank name and statement date of every document; the text goes along."""
    return docs.withColumn("_low", F.lower("text")).select(*_header_columns())


def stored_headers(docs: DataFrame) -> DataFrame:
    """:func:`read_header` written to the shared folder and read back: what follows needs the fields
    twice (as lookups and per document), and the texts are searched only once."""
    return _stored(read_header(docs))


def _stored(headers: DataFrame) -> DataFrame:
    path = work_dir(headers.sparkSession, "headers")
    headers.write.parquet(path)
    return headers.sparkSession.read.schema(headers.schema).parquet(path)


def resolve(headers: DataFrame, registry: DataFrame | M.RegistryIndex, as_of_date: str) -> DataFrame:
    """Header fields with the registry answer and the outcome code (null when all is well).

    Only the distinct lookups go through the registry; one join brings the answers back.
    """
    answers = M.resolve_lookups(M.lookups(headers), registry)
    m = M.answer(headers, answers)
    code = (
        F.when(F.coalesce(F.col("account"), F.lit("")) == "", "ERROR_NO_ACCOUNT")
        .when(F.coalesce(F.col("account_valid"), F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("match_type") == "multiple_accounts_low_similarity", ERRORS["multiple_accounts_low_similarity"])
        .when(F.col("match_type") == "multiple_accounts_no_bank_name", ERRORS["multiple_accounts_no_bank_name"])
        .otherwise("ERROR_NO_ROUTING")
    )
    return m.withColumn("code", code).withColumn("file_date", F.coalesce("file_date", F.lit(as_of_date)))


def _resolved_file(file_time: str):
    """File text of a resolved document from its transactions ``_t``."""
    entries = F.transform(
        "_t",
        lambda x, i: F.struct(
            B.type_code(x["txn_type"] == "fee", x["section"] == "credits").alias("type_code"),
            x["amount_cents"].cast("string").alias("amount"),
            F.lpad((i + 1).cast("string"), 5, "0").alias("ref_num"),
            sanitize(x["description"]).alias("description"),
        ),
    )
    net = F.aggregate(
        F.transform(
            "_t", lambda x: F.when(x["section"] == "debits", -x["amount_cents"]).otherwise(x["amount_cents"])
        ),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )
    nested = B.file_column(
        entries,
        F.col("matched_account"),
        F.col("matched_routing"),
        F.col("file_date"),
        F.lit(file_time),
        net.cast("string"),
    )
    return let(nested, lambda b: F.concat(F.array_join(B.render_lines(b), "\n"), F.lit("\n")))


def _error_file(as_of_date: str, file_time: str):
    message = (
        F.when(F.col("code") == "ERROR_NO_ACCOUNT", "No valid account number found on statement")
        .when(F.col("code") == "ERROR_NO_ROUTING", F.concat(F.lit("No routing number for account "), "account"))
        .otherwise(F.concat(F.lit("Several accounts end with "), "ending_digits"))
    )
    found = F.array_compact(
        F.array(
            F.concat(F.lit("Extracted Account Number: "), "account"),
            F.concat(F.lit("Extracted Bank Name: "), "bank_name"),
            F.concat(F.lit("Match Type: "), "match_type"),
            F.concat(F.lit("Number of Candidate Accounts: "), F.col("candidate_count").cast("string")),
        )
    )
    details = F.when(
        F.col("code") == "ERROR_NO_ACCOUNT",
        E.diagnostics(A.number_candidates("text"), F.col("bank_name"), F.size(F.split("text", "\n"))),
    ).otherwise(found)
    return E.error_file_text(
        message,
        F.col("doc_id").cast("string"),
        F.col("file_date"),
        F.lit(file_time),
        F.lit(as_of_date),
        code=F.col("code"),
        details=details,
    )


class Flow:
    """The way from documents to output files with its expressions built once, for any number of batches:
    building them takes the driver seconds, as long as a small batch takes to run."""

    def __init__(self, as_of_date: str, file_time: str = "0000"):
        self.as_of_date = as_of_date
        good = F.col("code").isNull()
        self.header = _header_columns()
        self.transactions = F.when(good, T.transactions_array("text"))
        self.out_text = F.when(good, _resolved_file(file_time)).otherwise(_error_file(as_of_date, file_time))

    def headers(self, docs: DataFrame) -> DataFrame:
        return _stored(docs.withColumn("_low", F.lower("text")).select(*self.header))

    def files(self, headers: DataFrame, registry: DataFrame | M.RegistryIndex) -> DataFrame:
        resolved = resolve(headers, registry, self.as_of_date)
        out = resolved.withColumn("_t", self.transactions).select("doc_id", "code", self.out_text.alias("out_text"))
        return out.withColumn("status", E.file_status("out_text")).withColumn(
            "output_name", E.output_name(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), F.col("out_text"))
        )


def to_files(
    headers: DataFrame, registry: DataFrame | M.RegistryIndex, as_of_date: str, file_time: str = "0000"
) -> DataFrame:
    """One output file per document of :func:`stored_headers`: records for a resolved one, an error
    stand-in otherwise."""
    return Flow(as_of_date, file_time).files(headers, registry)
