"""Quality rules: a ledger of rule failures kept as bits.

Every rule is evaluated once per document. The ledger keeps the measurements
and one long whose bit b says that rule b failed; a policy is a named set of
rules, so applying one, comparing versions and computing what a rule alone
rejects are bit operations on that long, with no second look at the texts.

Native: DataFrame functions only. A text's repeated five-word windows are found
from 64-bit hashes of its own windows (two windows of one text that differ
share a hash with probability 2**-64); texts without a repeat skip that work's
second half.

Defined results: a null text has no words, lines or symbols and fails
few_words; repeated rows and null ids are rated each on its own; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

SPACES, SYMBOLS, CAPITALS = r"[\x20\x09-\x0D]", "[#*$%&|<>]", "[A-Z]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Fails where `fails` is true; the bit is its place in RULES and never changes its meaning."""

    name: str
    fails: str


#: Bit b belongs to the b-th rule. New rules are added at the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "3 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words", "short_words", "capitals"),
}
BASE, CURRENT = "v1", "v2"


def bits(names) -> int:
    order = [r.name for r in RULES]
    return sum(1 << order.index(n) for n in set(names))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _covered(windows: Column, width: int) -> Column:
    """How many words lie in windows that occur twice or more, from the list of a text's window hashes in order."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        repeated = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        at = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        state = lambda last, n: F.struct(last.cast("int").alias("last"), n.cast("int").alias("n"))
        return F.aggregate(at, state(F.lit(-width), F.lit(0)), lambda a, x: state(x, a["n"] + F.least(F.lit(width), x - a["last"])), lambda a: a["n"])

    # A list of one, so that the sorted windows are computed once and then named.
    return F.element_at(F.transform(F.array(placed), count), 1)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements that RULES read, a row for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # What is read more than once is a column of its own, which Spark then computes once.
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    df = df.select("doc_id", "t", F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("t") - _count(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).alias("n_symbols"),
        _count(F.col("t"), CAPITALS).alias("n_capitals"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.sequence(F.lit(0), F.size("hashes") - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(WINDOW)]))
    df = df.withColumn("windows", F.when(F.size("hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"), WINDOW)).otherwise(0)
    measures = {
        "n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_capitals": F.col("n_capitals"),
        "n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_repeat_words": repeated.cast("long"),
    }
    # A generator, through which a filter on the measures isn't pushed: it would compute them again for each mention.
    return df.select("doc_id", F.inline(F.array(F.struct(*[c.alias(n) for n, c in measures.items()]))))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and fail_bits: bit b is set where RULES[b] fails."""
    failed = F.lit(0).cast("long")
    for b, rule in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << b)).otherwise(0).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", failed)


def stored(entries: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder: policies, comparisons and ablations read it and never the texts."""
    return cut(entries)


def rejected_by(policy: str) -> Column:
    """Whether a policy rejects a ledger row."""
    return F.col("fail_bits").bitwiseAND(F.lit(bits(POLICIES[policy]))) != 0


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it (kept without the rule), and what the policy rejects in all.

    One pass over the ledger, in which each rule's counts are sums of bit tests.
    """
    mask, names = bits(POLICIES[policy]), POLICIES[policy]
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask))
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    sums = [count(failed != 0).alias("n_rejected")]
    for n in names:
        sums += [count(failed.bitwiseAND(F.lit(bits([n]))) != 0).alias(f"fail_{n}"), count(failed == bits([n])).alias(f"only_{n}")]
    one = entries.agg(*sums)
    rows = [F.struct(F.lit(policy).alias("policy"), F.lit(n).alias("rule"), F.col(f"fail_{n}").alias("n_failed"), F.col(f"only_{n}").alias("n_only"), F.col("n_rejected")) for n in names]
    return one.select(F.inline(F.array(*rows)))


def op1_rules(spark, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejected_by(BASE).alias("base_failed"),
        (~rejected_by(BASE) & ~rejected_by(CURRENT)).alias("kept"),
        "fail_bits",
    )


def rule_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, all read from one stored ledger."""
    entries = stored(ledger(table(spark, sf_dir, "documents")))
    first, *others = [ablation(entries, p) for p in POLICIES]
    for other in others:
        first = first.unionByName(other)
    return first


_MEASURED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, i, w[i:i + 4] AS phrase FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT r, phrase FROM win GROUP BY r, phrase HAVING count(*) > 1),
cov AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS p FROM win JOIN rep USING (r, phrase)) GROUP BY r),
lin AS (SELECT r, unnest(string_split(t, chr(10))) AS s FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT s) AS n_dup FROM lin WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN ln USING (r) LEFT JOIN cov USING (r)),
l AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {r.fails} THEN {1 << b} ELSE 0 END" for b, r in enumerate(RULES)) + r""" AS BIGINT) AS fail_bits FROM m)
"""

ORACLE = _MEASURED + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {bits(POLICIES[BASE])}) <> 0 AS base_failed,
       (fail_bits & {bits(POLICIES[BASE]) | bits(POLICIES[CURRENT])}) = 0 AS kept, fail_bits FROM l
"""

ABLATION_ORACLE = _MEASURED + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{n}' AS rule, count(*) FILTER (WHERE (fail_bits & {bits([n])}) <> 0) AS n_failed, "
    f"count(*) FILTER (WHERE (fail_bits & {bits(names)}) = {bits([n])}) AS n_only, count(*) FILTER (WHERE (fail_bits & {bits(names)}) <> 0) AS n_rejected FROM l"
    for p, names in POLICIES.items()
    for n in names
)
