"""Schemas of the inputs, so that no reader has to infer one."""

from pyspark.sql import types as T

FIELD = T.StructType([T.StructField("content", T.StringType()), T.StructField("confidence", T.DoubleType())])
CELL = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("row_index", T.IntegerType()),
        T.StructField("column_index", T.IntegerType()),
    ]
)
TABLE = T.StructType(
    [
        T.StructField("row_count", T.IntegerType()),
        T.StructField("column_count", T.IntegerType()),
        T.StructField("cells", T.ArrayType(CELL)),
    ]
)
# Output of a document model: fields of its documents, tables and the text.
ANALYSIS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField(
            "documents",
            T.ArrayType(T.StructType([T.StructField("fields", T.MapType(T.StringType(), FIELD))])),
        ),
        T.StructField("tables", T.ArrayType(TABLE)),
        T.StructField("content", T.StringType()),
    ]
)
TRANSACTION = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("amount", T.DecimalType(18, 2)),
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("balance_after", T.DecimalType(18, 2)),
        T.StructField("reference_number", T.StringType()),
    ]
)
BALANCE = T.StructType([T.StructField("amount", T.DecimalType(18, 2)), T.StructField("date", T.StringType())])
STATEMENT = T.StructType(
    [
        T.StructField("account_number", T.StringType()),
        T.StructField(
            "statement_period",
            T.StructType([T.StructField("start_date", T.StringType()), T.StructField("end_date", T.StringType())]),
        ),
        T.StructField("opening_balance", BALANCE),
        T.StructField("closing_balance", BALANCE),
        T.StructField("transactions", T.ArrayType(TRANSACTION)),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("total_deposits", T.DecimalType(18, 2)),
                    T.StructField("total_withdrawals", T.DecimalType(18, 2)),
                    T.StructField("transaction_count", T.IntegerType()),
                    T.StructField("deposit_count", T.IntegerType()),
                    T.StructField("withdrawal_count", T.IntegerType()),
                ]
            ),
        ),
    ]
)
PROMPT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField(
            "messages",
            T.ArrayType(
                T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
            ),
        ),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("eTag", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
REGISTRY_CSV = T.StructType(
    [
        T.StructField("Bank Name", T.StringType()),
        T.StructField("Address", T.StringType()),
        T.StructField("Account Number", T.StringType()),
        T.StructField("Routing Number", T.StringType()),
    ]
)
BANK_LIST = T.StructType([T.StructField("Bank Name", T.StringType())])
