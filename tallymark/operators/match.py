"""Resolution of detected accounts against a registry of own accounts.

Shape shared by all matchers:

1. Statements are first reduced to their distinct lookups (account text, bank name). A bank that
   sends a third of all statements becomes a handful of lookups, and the work below depends on
   the number of different lookups, not of statements.
2. The registry is reduced to one row per key before any join: per account, per account without
   leading zeros, per suffix. "Ends with" is thereby an equality join on the suffix and every
   join is N:1, whatever number of accounts share a suffix.
3. Names are compared only for ambiguous lookups, and only over the distinct names behind a suffix.
4. The answers are joined back by lookup. No side is forced to broadcast; size decides.

``ordinal`` is the registry order and settles every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.scalars import account_digits, mask_digits, norm_bank, strip_zeros
from tallymark.functions.similarity import ratio

#: Classes of characters and ones for each in a name's counts; growth of the bands of lengths.
SLOTS, SLOT_BITS, BAND = 45, 7, 1.35
ROW_FIELDS = ("ordinal", "bank_name", "account_number", "routing_number")


def _row() -> Column:
    return F.struct(*[F.col(c) for c in ROW_FIELDS])


def suffix_rows(registry: DataFrame) -> DataFrame:
    """One row per registry account and suffix length."""
    return registry.select(
        *ROW_FIELDS,
        F.explode(F.sequence(F.lit(1), F.greatest(F.length("account_number"), F.lit(1)))).alias("_n"),
    ).select(*ROW_FIELDS, F.expr("right(account_number, _n)").alias("suffix"))


def suffix_index(registry: DataFrame) -> DataFrame:
    """Per suffix: how many accounts end with it and the first of them."""
    return (
        suffix_rows(registry)
        .groupBy("suffix")
        .agg(F.count("*").alias("candidate_count"), F.min(_row()).alias("first_hit"))
    )


def _first_by(registry: DataFrame, key: Column, name: str, out: str) -> DataFrame:
    return registry.groupBy(key.alias(name)).agg(F.min(_row()).alias(out))


def _lookups(docs: DataFrame, account: str, bank: str) -> DataFrame:
    return docs.select(F.col(account).alias("_acct"), F.col(bank).alias("_bank")).distinct()


def _answer(docs: DataFrame, resolved: DataFrame, account: str, bank: str) -> DataFrame:
    cond = docs[account].eqNullSafe(resolved["_acct"]) & docs[bank].eqNullSafe(resolved["_bank"])
    return docs.join(resolved, cond, "left").drop("_acct", "_bank")


def suffix_names(registry: DataFrame) -> DataFrame:
    """Distinct normal bank names behind every suffix, with the first account of each.

    Accounts are folded per name before anything is gathered by suffix, so a suffix that most
    accounts share brings its names together, not its accounts.
    """
    return suffix_rows(registry).groupBy("suffix", norm_bank("bank_name").alias("_nr")).agg(F.min(_row()).alias("hit"))


class RegistryIndex:
    """A registry as the tables that lookups are joined with: by account, by account without leading
    zeros, by ending, and the names behind an ending."""

    def __init__(self, by_account: DataFrame, by_zero: DataFrame, endings: DataFrame, ending_names: DataFrame):
        self.by_account, self.by_zero, self.endings, self.ending_names = by_account, by_zero, endings, ending_names

    def stored(self, path: str) -> RegistryIndex:
        """The index written once (per version of the registry) and read from there, by any number of batches."""
        out = []
        for name in ("by_account", "by_zero", "endings", "ending_names"):
            df = getattr(self, name)
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            out.append(df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}"))
        return RegistryIndex(*out)


def registry_index(registry: DataFrame) -> RegistryIndex:
    registry = registry.withColumn("account_number", F.trim("account_number"))
    return RegistryIndex(
        _first_by(registry, F.col("account_number"), "_k1", "_exact"),
        _first_by(registry, strip_zeros("account_number"), "_k2", "_zero").where(F.col("_k2") != ""),
        suffix_index(registry),
        suffix_names(registry),
    )


def best_names(open_lookups: DataFrame, ending_names: DataFrame) -> DataFrame:
    """Most similar bank name behind each open lookup (_key, _nd); the first account settles ties.
    Each pair of names is compared once, however many lookups and endings ask for it."""
    pairs = open_lookups.join(ending_names, F.col("_key") == F.col("suffix"))
    names = pairs.select("_nd", "_nr").distinct().withColumn("_sim", ratio("_nd", "_nr"))
    scored = pairs.join(names.toDF("_n1", "_n2", "_sim"), (F.col("_nd") == F.col("_n1")) & (F.col("_nr") == F.col("_n2")))
    best = F.max(F.struct(F.col("_sim").alias("s"), (-F.col("hit.ordinal")).alias("o"), F.col("hit").alias("h")))
    return scored.groupBy("_key", "_nd").agg(best.alias("_b"))


def suffix_hits(look: DataFrame, registry: DataFrame | RegistryIndex, compare: Column) -> DataFrame:
    """Lookups with ``_key``: number of accounts with that ending, the first of them, and, where
    ``compare`` holds and there are several, the one with the most similar bank name.

    The ending itself is an N:1 join for every lookup; only lookups that several accounts answer and
    that bring a name go on to the names, as distinct (ending, name) questions."""
    cols = look.columns
    if isinstance(registry, RegistryIndex):
        endings, ending_names = registry.endings, registry.ending_names
    else:
        endings, ending_names = suffix_index(registry), suffix_names(registry)
    first = look.join(endings, F.col("_key") == F.col("suffix"), "left").drop("suffix")
    wanted = F.coalesce(compare, F.lit(False)) & (F.col("candidate_count") > 1)
    first = first.withColumn("_nd", F.when(F.coalesce(wanted, F.lit(False)), F.coalesce(norm_bank("_bank"), F.lit(""))))
    open_lookups = first.where(F.col("_nd").isNotNull()).select("_key", "_nd").distinct()
    best = best_names(open_lookups, ending_names).toDF("_bk", "_bn", "_b")
    both = first.join(best, (F.col("_key") == F.col("_bk")) & (F.col("_nd") == F.col("_bn")), "left")
    return both.select(
        *cols, "candidate_count", "first_hit", F.col("_b.s").alias("best_similarity"), F.col("_b.h").alias("best_hit")
    )


# --- single rules ------------------------------------------------------------------------


def join_exact(docs: DataFrame, registry: DataFrame, account: str = "account") -> DataFrame:
    """First registry row with the same account."""
    keyed = _first_by(registry, F.trim("account_number"), "_k", "hit")
    return docs.join(keyed, F.trim(docs[account]) == keyed["_k"]).drop("_k")


def join_zero_norm(docs: DataFrame, registry: DataFrame, account: str = "account") -> DataFrame:
    """First registry row with the same account once leading zeros are gone."""
    keyed = _first_by(registry, strip_zeros(F.trim("account_number")), "_k", "hit").where(F.col("_k") != "")
    return docs.join(keyed, strip_zeros(docs[account]) == keyed["_k"]).drop("_k")


def join_suffix(docs: DataFrame, registry: DataFrame, account: str = "account", least: int = 2) -> DataFrame:
    """Accounts that end with the visible digits: their number and the first of them."""
    digits = account_digits(docs[account])
    keyed = suffix_index(registry)
    return (
        docs.withColumn("_d", digits)
        .where(F.length("_d") >= least)
        .join(keyed, F.col("_d") == keyed["suffix"])
        .drop("_d")
    )


# --- account first, bank name only to break ties --------------------------------------------


def match_account(
    docs: DataFrame,
    registry: DataFrame,
    account: str = "account",
    bank: str = "bank_name",
    threshold: float = K.SIM_DISAMBIGUATE,
) -> DataFrame:
    """Resolve each statement's account; see :func:`resolve_lookups` for the rule."""
    resolved = resolve_lookups(_lookups(docs, account, bank), registry, threshold)
    return _answer(docs, resolved, account, bank)


def lookups(docs: DataFrame, account: str = "account", bank: str = "bank_name") -> DataFrame:
    """Distinct (account text, bank name) questions of a set of statements."""
    return _lookups(docs, account, bank)


def answer(docs: DataFrame, resolved: DataFrame, account: str = "account", bank: str = "bank_name") -> DataFrame:
    return _answer(docs, resolved, account, bank)


def resolve_lookups(
    look: DataFrame, registry: DataFrame | RegistryIndex, threshold: float = K.SIM_DISAMBIGUATE
) -> DataFrame:
    """Answers for distinct lookups, from a registry or its ready index.

    ``XXXXXX1234`` and ``***34`` forms look for accounts with that ending: one hit stands, several
    are settled by the bank name when it is similar enough. Other forms take the first registry row
    that is equal, equal without leading zeros, or ends with three or more digits.
    """
    digits = account_digits("_acct")
    is_partial = F.startswith("_acct", F.lit("XXXXXX")) & (F.length("_acct") == 10)
    is_masked = F.startswith("_acct", F.lit("***")) & (F.length(digits) >= 2)
    kind = F.when(is_partial, "partial").when(is_masked, "masked")
    look = look.withColumn("_kind", kind).withColumn(
        "_key",
        F.when(is_partial, F.expr("right(_acct, 4)")).when(is_masked | (F.length(digits) >= 3), digits),
    )
    index = registry if isinstance(registry, RegistryIndex) else registry_index(registry)
    plain = F.col("_kind").isNull()
    named = F.coalesce(F.col("_bank"), F.lit("")) != ""
    look = (
        suffix_hits(look, index, ~plain & named)
        .join(index.by_account, plain & (F.col("_acct") == F.col("_k1")), "left")
        .join(index.by_zero, plain & (strip_zeros("_acct") == F.col("_k2")), "left")
    )
    n = F.coalesce(F.col("candidate_count"), F.lit(0))
    ambiguous = ~plain & (n > 1)

    def ranked(hit, rank, name):
        return F.when(
            F.col(hit).isNotNull(),
            F.struct(F.col(f"{hit}.ordinal").alias("o"), F.lit(rank).alias("r"), F.lit(name).alias("t"), F.col(hit).alias("h")),
        )

    first = F.least(
        ranked("_exact", 1, "exact"), ranked("_zero", 2, "normalized"), ranked("first_hit", 3, "legacy_partial")
    )
    sim = F.coalesce(F.col("best_similarity"), F.lit(0.0))
    settled = ambiguous & named & (sim >= threshold)
    single = F.col("_kind").isNotNull() & (n == 1)
    match_type = (
        F.when(F.coalesce(F.col("_acct"), F.lit("")) == "", "no_account")
        .when(single, F.concat("_kind", F.lit("_single")))
        .when(settled, F.concat("_kind", F.lit("_disambiguated")))
        .when(ambiguous & named, "multiple_accounts_low_similarity")
        .when(ambiguous, "multiple_accounts_no_bank_name")
        .when(F.col("_kind") == "masked", "no_account_match")
        .when(F.col("_kind") == "partial", "none")
        .otherwise(F.coalesce(first["t"], F.lit("none")))
    )
    hit = F.when(single, F.col("first_hit")).when(settled, F.col("best_hit")).when(plain, first["h"])
    return look.select(
        "_acct",
        "_bank",
        match_type.alias("match_type"),
        hit.alias("_hit"),
        F.when(ambiguous & named, sim).when(hit.isNotNull(), 1.0).otherwise(0.0).alias("similarity"),
        F.when(ambiguous, F.col("_key")).alias("ending_digits"),
        F.when(ambiguous, n).alias("candidate_count"),
    ).select(
        "_acct",
        "_bank",
        F.col("_hit").isNotNull().alias("account_valid"),
        "match_type",
        "similarity",
        "ending_digits",
        "candidate_count",
        F.col("_hit.ordinal").alias("matched_ordinal"),
        F.col("_hit.account_number").alias("matched_account"),
        F.col("_hit.bank_name").alias("matched_bank"),
        F.col("_hit.routing_number").alias("matched_routing"),
    )


def match_status(matched: DataFrame) -> DataFrame:
    """Outcome of a match as the pipeline reports it."""
    t = F.col("match_type")
    return matched.withColumn(
        "status",
        F.when(F.coalesce(F.col("account_valid"), F.lit(False)), "own_account")
        .when(t.isin("multiple_accounts_low_similarity", "multiple_accounts_no_bank_name"), t)
        .when(t == "none", "no_account_match")
        .otherwise("error"),
    )


AMBIGUOUS = ("multiple_accounts_low_similarity", "multiple_accounts_no_bank_name")


def open_questions(matched: DataFrame, bank: str = "bank_name") -> DataFrame:
    """Different (ending_digits, detected_bank) of the unresolved ambiguous statements, and how many ask."""
    return (
        matched.where(F.col("match_type").isin(*AMBIGUOUS))
        .groupBy("ending_digits", F.coalesce(F.col(bank), F.lit("")).alias("detected_bank"))
        .agg(F.count("*").alias("statements"))
    )


def _name_scores(pairs: DataFrame) -> DataFrame:
    """(detected_bank, bank_name, similarity) of the different pairs of names, each compared once."""
    sim = F.when(F.col("detected_bank") != "", ratio(norm_bank("detected_bank"), norm_bank("bank_name"))).otherwise(0.0)
    return pairs.select("detected_bank", "bank_name").distinct().withColumn("similarity", sim)


def candidate_rows(matched: DataFrame, registry: DataFrame, bank: str = "bank_name") -> DataFrame:
    """The registry accounts behind every open question, one row per question and account.

    Statements with the same ending and bank share their rows: the list of one statement is a join on
    (ending_digits, bank name), so rows grow with questions and accounts, not with statements."""
    rows = suffix_rows(registry.withColumn("account_number", F.trim("account_number")))
    pairs = open_questions(matched, bank).join(rows.withColumnRenamed("suffix", "ending_digits"), "ending_digits")
    return pairs.join(_name_scores(pairs), ["detected_bank", "bank_name"]).select(
        "ending_digits",
        "detected_bank",
        F.col("ordinal"),
        F.col("account_number").alias("account"),
        F.col("bank_name").alias("bank"),
        F.col("routing_number").alias("routing"),
        "similarity",
    )


def candidate_details(matched: DataFrame, registry: DataFrame, bank: str = "bank_name") -> DataFrame:
    """Per open question: how many accounts and the best similarity."""
    rows = suffix_rows(registry.withColumn("account_number", F.trim("account_number")))
    names = rows.groupBy(F.col("suffix").alias("ending_digits"), "bank_name").agg(F.count("*").alias("accounts"))
    pairs = open_questions(matched, bank).join(names, "ending_digits")
    return (
        pairs.join(_name_scores(pairs), ["detected_bank", "bank_name"])
        .groupBy("ending_digits", "detected_bank")
        .agg(
            F.first("statements").alias("statements"),
            F.sum("accounts").alias("candidate_count"),
            F.count("*").alias("candidate_banks"),
            F.max("similarity").alias("best_similarity"),
        )
    )


# --- routing number by account -----------------------------------------------------------------


def match_routing(
    docs: DataFrame,
    registry: DataFrame,
    account: str = "account",
    bank: str = "bank_name",
    threshold: float = K.SIM_ROUTING,
) -> DataFrame:
    """Routing number for an account; nothing is looked up for a statement without a bank name.

    A masked account takes the most similar bank among its endings when it beats the threshold,
    else the first ending; other accounts an equal one, else the first ending of 3+ digits.
    """
    masked = F.col("_acct").rlike("[*xX]")
    look = (
        _lookups(docs, account, bank)
        .where((F.coalesce(F.col("_bank"), F.lit("")) != "") & (F.coalesce(F.col("_acct"), F.lit("")) != ""))
        .withColumn("_masked", masked)
        .withColumn("_plain", F.trim(mask_digits("_acct")))
        .withColumn("_key", F.when(masked, mask_digits("_acct")).otherwise(account_digits("_acct")))
    )
    by_account = _first_by(registry, F.trim("account_number"), "_k1", "_exact")
    look = suffix_hits(look, registry, F.col("_masked")).join(by_account, F.col("_plain") == F.col("_k1"), "left")
    ambiguous = F.col("_masked") & (F.coalesce(F.col("candidate_count"), F.lit(0)) > 1)
    by_name = ambiguous & (F.coalesce(F.col("best_similarity"), F.lit(0.0)) > threshold)
    stage = (
        F.when(by_name, "masked_best_name")
        .when(F.col("_masked") & F.col("first_hit").isNotNull(), "masked_first")
        .when(F.col("_exact").isNotNull(), "exact")
        .when((F.length(F.col("_key")) >= 3) & F.col("first_hit").isNotNull(), "suffix_first")
    )
    hit = (
        F.when(by_name, F.col("best_hit"))
        .when(F.col("_masked") & F.col("first_hit").isNotNull(), F.col("first_hit"))
        .when(F.col("_exact").isNotNull(), F.col("_exact"))
        .when(F.length(F.col("_key")) >= 3, F.col("first_hit"))
    )
    resolved = look.select("_acct", "_bank", stage.alias("routing_stage"), hit.alias("_hit")).select(
        "_acct",
        "_bank",
        "routing_stage",
        F.col("_hit.ordinal").alias("matched_ordinal"),
        F.col("_hit.routing_number").alias("routing_number"),
        F.col("_hit.account_number").alias("matched_account"),
    )
    return _answer(docs, resolved, account, bank)


# --- by name ------------------------------------------------------------------------------------


def _name_tokens(norm: Column) -> Column:
    """Characters of a name, repeated ones numbered: a multiset written as a set."""
    chars = F.filter(F.split(norm, ""), lambda c: c != "")
    return F.transform(
        chars,
        lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")),
    )


def _letter_counts(norm: Column, prefix: str) -> tuple[list[Column], list[Column]]:
    """How often each of ``SLOTS`` classes of characters occurs, as runs of up to ``SLOT_BITS`` ones in a
    few longs, and what runs over. The ones that two names have in common, and the smaller of their
    overruns, are at least the characters they have in common."""
    per_long = 63 // SLOT_BITS
    code = lambda c: F.pmod(F.ascii(c), F.lit(SLOTS))
    chars = F.filter(F.split(norm, ""), lambda c: c != "")
    slots = F.transform(chars, code)
    counts = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.size(F.filter(slots, lambda x: x == s)))
    out = []
    for first in range(0, SLOTS, per_long):
        bits = F.lit(0).cast("long")
        for k, slot in enumerate(range(first, min(first + per_long, SLOTS))):
            ones = F.expr(f"shiftleft(1L, least({SLOT_BITS}, counts[{slot}])) - 1L")
            bits = bits.bitwiseOR(F.shiftleft(ones, SLOT_BITS * k))
        out.append(bits.alias(f"{prefix}_bits{first // per_long}"))
    over = F.aggregate("counts", F.lit(0), lambda a, c: a + F.greatest(c - SLOT_BITS, F.lit(0)))
    return [counts.alias("counts")], [*out, over.alias(f"{prefix}_over")]


def _bucket(length: Column) -> Column:
    """Lengths in bands that grow with them."""
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.log(F.lit(BAND)) + 1e-9).cast("int")


def _bucket_low(bucket: Column) -> Column:
    return F.ceil(F.pow(F.lit(BAND), bucket.cast("double")) - 1e-6)


def _subsets(tokens: Column, size: Column) -> Column:
    """All sets of ``size`` (1, 2 or 3) tokens in order, as texts."""
    places = lambda low: F.sequence(low, F.size(tokens))
    at = lambda i: F.element_at(tokens, i)
    tail = lambda i: F.filter(places(i), lambda j: j > i)
    n = F.size(tokens)
    one = tokens
    two = F.flatten(F.transform(places(F.lit(1)), lambda i: F.transform(tail(i), lambda j: F.concat_ws("|", at(i), at(j)))))
    three = F.flatten(
        F.transform(
            places(F.lit(1)),
            lambda i: F.flatten(
                F.transform(tail(i), lambda j: F.transform(tail(j), lambda k: F.concat_ws("|", at(i), at(j), at(k))))
            ),
        )
    )
    none = F.array().cast("array<string>")
    return F.when(n < size, none).when(size == 1, one).when(size == 2, two).otherwise(three)


def name_candidates(left: DataFrame, right: DataFrame, threshold: float, shared: int = 3) -> DataFrame:
    """Pairs (a_norm, b_norm) of distinct names that can reach the similarity; no pair that does is lost.

    The ratio 2M/(la+lb) needs M >= threshold/2 * (la+lb) common characters. With the characters of
    both names in order of their rarity, a pair that has ``need`` in common shares at least ``l`` among the
    first len-need+l of each. So every set of ``l`` (``shared``, fewer where need is smaller) of those is a
    key, together with the bands of both lengths: needs follow from the bands, and names of unfitting
    lengths don't meet. Such keys are rare, so no key gathers many names. What meets must have enough
    characters in common, counted by class in a few longs, before a pair is formed.
    """
    half, eps = threshold / 2.0, 1e-9
    ratio_of_lengths = half / (1.0 - half)  # shortest partner of a name, as a share of its length

    def prepared(df: DataFrame, tag: str) -> DataFrame:
        counts, bits = _letter_counts(F.col("norm"), tag)
        own = df.select("norm", F.length("norm").alias("len"), *counts)
        return own.select(F.col("norm").alias(f"{tag}_norm"), F.col("len").alias(f"{tag}_len"), *bits)

    def need(one: Column, two: Column) -> Column:
        return F.ceil(half * (one + two) - eps).cast("int")

    freq = right.select(F.explode(_name_tokens(F.col("norm"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("f"))

    def keyed(df: DataFrame, tag: str) -> DataFrame:
        own = df.select("norm", F.length("norm").alias("len"), F.explode(_name_tokens(F.col("norm"))).alias("tok"))
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "tok")))
        ranked = own.join(freq, "tok", "left").groupBy("norm", "len").agg(F.transform(ordered, lambda x: x["tok"]).alias("r"))
        least = F.ceil(F.col("len") * ratio_of_lengths - eps)
        most = F.floor(F.col("len") / ratio_of_lengths + eps)
        banded = ranked.withColumn("other", F.explode(F.sequence(_bucket(least), _bucket(most)))).withColumn("own", _bucket(F.col("len")))
        lows = need(_bucket_low(F.col("own")), _bucket_low(F.col("other")))
        size = F.greatest(F.lit(1), F.least(F.lit(shared), lows))
        other_low = F.greatest(_bucket_low(F.col("other")), least)
        many = F.col("len") - need(F.col("len"), other_low) + F.col("size")
        front = banded.withColumn("size", size).withColumn(
            "front", F.slice("r", F.lit(1), F.greatest(F.least(many, F.col("len")), F.lit(0)).cast("int"))
        )
        bands = ("own", "other") if tag == "a" else ("other", "own")
        return front.select(
            F.col("norm").alias(f"{tag}_norm"), *bands, F.explode(_subsets(F.col("front"), F.col("size"))).alias("set")
        ).select(f"{tag}_norm", F.xxhash64(*bands, "set").alias("key"))

    a, b = prepared(left, "a"), prepared(right, "b")
    longs = [c[2:] for c in a.columns if "_bits" in c]
    common = F.least("a_over", "b_over")
    for c in longs:
        common = common + F.bit_count(F.col(f"a_{c}").bitwiseAND(F.col(f"b_{c}")))
    total = F.col("a_len") + F.col("b_len")
    fits = (2 * F.least("a_len", "b_len") >= threshold * total - eps) & (2 * common >= threshold * total - eps)
    one = keyed(left, "a").join(a, "a_norm")
    two = keyed(right, "b").join(b, "b_norm")
    return one.join(two, (one["key"] == two["key"]) & fits).select("a_norm", "b_norm").distinct()


def similar_name_pairs(left: DataFrame, right: DataFrame, threshold: float = K.SIM_NAME) -> DataFrame:
    """All (detected, registry) pairs of distinct normal names with similarity >= threshold, scored.
    ``left`` and ``right`` have one column ``norm``."""
    pairs = name_candidates(left, right, threshold)
    same = left.join(right, "norm").select(F.col("norm").alias("a_norm"), F.col("norm").alias("b_norm"))
    scored = pairs.union(same).distinct().withColumn("similarity", ratio("a_norm", "b_norm"))
    return scored.where(F.col("similarity") >= threshold)


def best_name_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs that hold every left name's highest similarity, from the threshold on. Names are first looked
    up as they are; only those that the right side lacks are compared."""
    same = left.join(right, "norm").select(F.col("norm").alias("a_norm"), F.col("norm").alias("b_norm"))
    rest = left.join(right, "norm", "left_anti")
    return same.withColumn("similarity", F.lit(1.0)).union(similar_name_pairs(rest, right, threshold))


def match_name(
    docs: DataFrame, registry: DataFrame, bank: str = "bank_name", threshold: float = K.SIM_NAME
) -> DataFrame:
    """Most similar registry bank per statement, from the threshold on; the first of equals wins."""
    detected = docs.select(F.col(bank).alias("_bank")).where(F.coalesce(F.col(bank), F.lit("")) != "").distinct()
    detected = detected.withColumn("a_norm", norm_bank("_bank"))
    reg = registry.withColumn("b_norm", norm_bank("bank_name")).groupBy("b_norm").agg(F.min(_row()).alias("hit"))
    pairs = best_name_pairs(
        detected.select(F.col("a_norm").alias("norm")).distinct(), reg.select(F.col("b_norm").alias("norm")), threshold
    )
    best = (
        pairs.join(reg, "b_norm")
        .groupBy("a_norm")
        .agg(F.max(F.struct(F.col("similarity"), (-F.col("hit.ordinal")).alias("o"), F.col("hit"))).alias("_m"))
    )
    resolved = detected.join(best, "a_norm").select(
        "_bank",
        F.col("_m.similarity").alias("match_confidence"),
        F.col("_m.hit.ordinal").alias("matched_ordinal"),
        F.col("_m.hit.bank_name").alias("matched_bank"),
        F.col("_m.hit.account_number").alias("matched_account"),
        F.col("_m.hit.routing_number").alias("matched_routing"),
    )
    return docs.join(resolved, docs[bank] == resolved["_bank"], "left").drop("_bank")


def match_account_first(
    docs: DataFrame, registry: DataFrame, account: str = "account", bank: str = "bank_name"
) -> DataFrame:
    """Equal account, else best ending of 4+ digits (name breaks ties), else bank name alone."""
    digits = account_digits("_acct")
    look = _lookups(docs, account, bank).withColumn("_key", F.when(F.length(digits) >= 4, digits))
    by_account = _first_by(registry, F.col("account_number"), "_k1", "_exact")
    named = F.coalesce(F.col("_bank"), F.lit("")) != ""
    look = suffix_hits(look, registry, named).join(by_account, F.col("_acct") == F.col("_k1"), "left")
    open_ = F.col("_exact").isNull()
    names = look.where(open_ & F.col("first_hit").isNull()).select(F.col("_bank").alias("_nb")).distinct()
    by_name = match_name(names, registry, "_nb").where(F.col("matched_ordinal").isNotNull())
    by_name = by_name.select(
        "_nb", F.col("matched_routing").alias("_name_routing"), F.col("matched_ordinal").alias("_name_ordinal")
    )
    look = look.join(by_name, open_ & F.col("first_hit").isNull() & (F.col("_bank") == F.col("_nb")), "left")
    partial = F.coalesce(F.col("best_hit"), F.col("first_hit"))
    resolved = look.select(
        "_acct",
        "_bank",
        F.when(~open_, "exact_account_match")
        .when(partial.isNotNull(), "partial_account_match")
        .when(F.col("_name_routing").isNotNull(), "customer_statement")
        .otherwise("no_match")
        .alias("match_type"),
        F.when(~open_, F.col("_exact.account_number"))
        .when(partial.isNotNull(), partial["account_number"])
        .when(F.col("_name_routing").isNotNull(), F.col("_acct"))
        .alias("resolved_account"),
        F.when(~open_, F.col("_exact.routing_number"))
        .when(partial.isNotNull(), partial["routing_number"])
        .otherwise(F.col("_name_routing"))
        .alias("resolved_routing"),
        F.when(~open_, F.col("_exact.ordinal"))
        .when(partial.isNotNull(), partial["ordinal"])
        .otherwise(F.col("_name_ordinal"))
        .alias("matched_ordinal"),
    )
    return _answer(docs, resolved, account, bank)


def match_with_fallback(docs: DataFrame, registry: DataFrame, bank: str = "bank_name", threshold: float = 0.8) -> DataFrame:
    """Registry details where the bank is known, else a fallback row with its reason."""
    out = match_name(docs, registry, bank, threshold)
    found = F.col("matched_ordinal").isNotNull()
    return out.withColumn("bank_info_found", found).withColumn(
        "processing_method", F.when(found, "registry").otherwise("fallback")
    ).withColumn(
        "fallback_reason",
        F.when(~found, F.lit(f"No matching bank found above {round(threshold * 100)}% threshold")),
    )


def rank_similarity(registry: DataFrame, name: str, normalise: bool = False, good: float = 70.0) -> DataFrame:
    """Every registry row scored against one name, best first."""
    if normalise:
        score = ratio(norm_bank(F.lit(name)), norm_bank("bank_name"))
    else:
        score = ratio(F.lit(name.lower()), F.lower("bank_name"))
    return (
        registry.withColumn("score", F.round(score * 100, 4))
        .withColumn("similar", F.col("score") >= good)
        .orderBy(F.desc("score"), "ordinal")
    )
