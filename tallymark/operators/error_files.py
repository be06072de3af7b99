"""Error outputs: coded BAI2 stand-ins with an explanation, and routing of finished files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.predicates import any_contains, error_code_from_message

# What went wrong and what a person should look at, per code family.
GUIDANCE = {
    "ERROR_NO_ACCOUNT": (
        "No usable account number was found in the document",
        [
            "Is an account number printed on the statement?",
            "Does it have at least four digits?",
            "Is the text readable?",
            "Is the account in the registry?",
        ],
    ),
    "ERROR_NO_ROUTING": (
        "The account was read but the registry has no entry for it",
        [
            "Is this bank or account new?",
            "Was the bank name read correctly?",
            "Is the number the same in the registry?",
        ],
    ),
    "ERROR_NO_BANK_NAME": (
        "No bank name was recognised, so the registry could not be searched",
        ["Is the name visible at the top?", "Is the scan clear?", "Is the bank in the registry?"],
    ),
    "ERROR_MULTIPLE_ACCOUNTS_LOW_SIMILARITY": (
        "Several registry accounts share the visible ending and the bank name fits none well enough",
        ["Is the bank name readable?", "Does it agree with the registry?", "Are the last digits right?"],
    ),
    "ERROR_MULTIPLE_ACCOUNTS_NO_BANK": (
        "Several registry accounts share the visible ending and the statement names no bank",
        ["Is the bank name visible?", "Is the scan good enough?", "Are the last digits right?"],
    ),
    "ERROR_AI": (
        "The text could not be turned into a cash-management file",
        ["Is the text readable?", "Is the statement in a usual layout?"],
    ),
    "ERROR_DOC_INTEL_FAILED": (
        "The document could not be read",
        ["Is it a readable document?", "Is it a statement?", "Is the file small enough?"],
    ),
    "OTHER": (
        "An unexpected error stopped the work",
        ["Process the document again", "Check the document format", "Ask for support"],
    ),
}
RULER = "# " + "=" * 40


def _guidance(code: Column) -> Column:
    def block(key):
        what, checks = GUIDANCE[key]
        steps = "\n".join(f"# {i}. {c}" for i, c in enumerate(checks, 1))
        return f"# PROBLEM: {what}\n#\n# WHAT TO CHECK:\n{steps}"

    out = F
    for key in GUIDANCE:
        if key == "ERROR_AI":
            cond = code.rlike("^ERROR_(?:AI|OPENAI)")
        elif key == "OTHER":
            continue
        else:
            cond = code == key
        out = out.when(cond, block(key))
    return out.otherwise(block("OTHER"))


def error_records(code: Column, file_date: Column, file_time: Column, receiver_id: str = K.BAI2_RECEIVER) -> Column:
    """The fixed records of an error file. 98 and 99 count every record."""
    return F.array(
        F.concat(F.lit(f"01,ERROR,{receiver_id},"), file_date, F.lit(","), file_time, F.lit(",1,,,2/")),
        F.concat(F.lit("02,ERROR,000000000,1,"), file_date, F.lit(",,USD,2/")),
        F.lit("03,ERROR,USD,010,,,Z/"),
        F.concat(F.lit("88,999,"), code, F.lit(",,Z/")),
        F.lit("49,0,3/"),
        F.lit("98,0,1,5/"),
        F.lit("99,0,1,7/"),
    )


def error_file_text(
    message: Column,
    filename: Column,
    file_date: Column,
    file_time: Column,
    as_of: Column,
    code: Column | None = None,
    details: Column | None = None,
) -> Column:
    """Explanation block and records of one error file. ``details`` is an array of report lines."""
    code = error_code_from_message(message) if code is None else code
    default = F.array(F.lit("No diagnostic data available"))
    notes = default if details is None else F.when(F.size(details) > 0, details).otherwise(default)
    head = F.array(
        F.lit(RULER),
        F.lit("# ERROR BAI2 FILE - PROCESSING FAILED"),
        F.lit(RULER),
        F.concat(F.lit("# File: "), filename),
        F.concat(F.lit("# Date: "), as_of),
        F.concat(F.lit("# Error Code: "), code),
        F.lit("#"),
        F.lit("# WHAT HAPPENED:"),
        F.concat(F.lit("# "), message),
        F.lit("#"),
        _guidance(code),
        F.lit("#"),
        F.lit("# TECHNICAL DETAILS:"),
    )
    body = F.transform(notes, lambda x: F.concat(F.lit("# "), x))
    end = F.array(F.lit("#"), F.lit(RULER), F.lit(""))
    return F.concat(
        F.array_join(F.concat(head, body, end, error_records(code, file_date, file_time)), "\n"), F.lit("\n")
    )


def file_status(text) -> Column:
    """ERROR when a finished file is an error stand-in, else OK."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(any_contains(t, K.ERROR_MARKERS), "ERROR").otherwise("OK")


def output_name(name, text) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(F.substring_index(n, "/", -1), r"\.[^.]*$", "")
    return F.concat(F.when(file_status(text) == "ERROR", "ERROR_").otherwise(""), stem, F.lit(".bai"))


def diagnostics(candidates: Column, bank: Column, n_lines: Column, most: int | None = None) -> Column:
    """Report lines of a statement whose account is missing; lists all candidates, or ``most`` of them."""
    shown = candidates if most is None else F.slice(candidates, 1, most)
    return F.array(
        F.concat(F.lit("Bank Names Found: "), F.coalesce(bank, F.lit("Unknown"))),
        F.concat(
            F.lit("Account Numbers Found: "),
            F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("None"),
        ),
        F.concat(F.lit("OCR Text Lines: "), n_lines.cast("string"), F.lit(" lines extracted")),
    )


def route_errors(files: DataFrame, text_col: str = "text", name_col: str = "file_id") -> DataFrame:
    return files.withColumn("status", file_status(text_col)).withColumn(
        "output_name", output_name(name_col, text_col)
    )


def strip_fence(text) -> Column:
    """BAI2 records out of a fenced answer; other text stays."""
    t = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_extract(t, r"(?ds)(?:^|\n)(01,.*\n99,[^\n]*)", 1)
    return F.when(F.startswith(t, F.lit("```")) & (inner != ""), inner).otherwise(t)
