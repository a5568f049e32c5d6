"""Quality rules as a ledger of bits: every rule is evaluated once, policies are masks over the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import WHITE, WHITE_RUN

#: Symbols that count as markup or junk.
SYMBOLS = "#*$%&|<>"

#: Name and failure condition of each rule, over the measurements; the position is the bit.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("longest_word", "max_word_chars > 1000"),
)

#: A policy version names the rules that it enforces.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "longest_word"),
}


def _bound(value: Column, use) -> Column:
    """use(value), with the value evaluated once for the row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, n: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that are found twice or more in the text."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(marks: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["at"])).alias("n"), p.alias("at"))
        return F.aggregate(marks, first, step, lambda a: a["n"])

    def repeats(w: Column) -> Column:
        def marks(s: Column) -> Column:
            h = lambda k: F.get(s, k)["h"]  # noqa: E731  null outside the array, which is not equal to anything
            hit = F.filter(s, lambda x, k: F.coalesce(h(k - 1) == x["h"], F.lit(False)) | F.coalesce(h(k + 1) == x["h"], F.lit(False)))
            return covered(F.sort_array(F.transform(hit, lambda x: x["p"])))

        pairs = F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_bound(F.sort_array(pairs), marks))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n <= width, 0).otherwise(_bound(_bound(hashes, windows), repeats))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, max_word_chars."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select(
        "doc_id",
        "_t",
        F.filter(F.split("_t", WHITE_RUN), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("_l"),
    )
    n = F.size("_w")
    return d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w"), n).cast("long").alias("n_repeat_words"),
        F.coalesce(F.array_max(F.transform("_w", lambda w: F.length(w))), F.lit(0)).cast("long").alias("max_word_chars"),
    )


def mask(policy: int) -> int:
    """The bits of the rules that a policy version enforces."""
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every rule evaluated once for every text: the measurements and `fail_bits`, a bit for each rule of RULES that fails.

    Built-in expressions only, one pass, no shuffle: a text is worked on in its own row, so hot sources or copies
    cost what they hold. Null text has no words, lines or symbols (it fails `few_words`); an empty text likewise.
    Very long texts need memory in proportion to their words. A null identifier is kept. Repeated rows are measured
    one by one. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    bits = F.lit(0).cast("long")
    for k, (_, failing) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: int = 2) -> DataFrame:
    """Adds base_failed (policy 1) and kept, the verdict of the given policy version, from the bits alone."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p)).cast("long")) != 0
    return ledger.withColumn("base_failed", failed(1)).withColumn("kept", ~failed(1) & ~failed(policy)).withColumn("policy", F.lit(policy))


def keep_passing(docs: DataFrame, text_col: str = "text", policy: int = 2) -> DataFrame:
    """The rows whose texts pass the policy, with all their columns; the row rides through the ledger, so nothing is joined."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_text"))
    return apply_policy(rule_ledger(row, "_row", "_text"), policy).where("kept").select("doc_id.*")


def ablations(ledger: DataFrame) -> DataFrame:
    """For each policy and rule: rows that fail the rule, rows that fail nothing else in the policy, rows kept with and without it.

    One aggregation over the bits: rows are first counted by their bits (64 values at most for these rules), then
    each policy and rule is read off these counts with bitwise operations.
    """
    counts = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = [(p, name, mask(p), 1 << k) for p in POLICIES for k, (name, _) in enumerate(RULES) if name in POLICIES[p]]
    rules = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in names]))
    x = counts.select("fail_bits", "n", rules.alias("r")).select("fail_bits", "n", "r.*")
    within = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return x.groupBy("policy", "rule").agg(
        total(within.bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(within == F.col("bit")).alias("failing_only_this"),
        total(within == 0).alias("kept"),
        total((within == 0) | (within == F.col("bit"))).alias("kept_without_rule"),
    )
