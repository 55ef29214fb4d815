"""License scans: entire texts looked up by the digest of their canonical form.

The canonical form lower-cases A-Z, drops lines that state a copyright (but not
licence wording that a line break puts in their form, like `copyright notice
and this permission notice`), writes equivalent spellings one way and turns
every run of other characters than letters and digits into one space. Its
SHA-256 is joined to the digests of the known licences: whole documents, and
each of their lines as an entire notice.

The catalogue has short licences as texts and long ones as the digests of their
canonical forms; callers may pass others.

Native: DataFrame functions only. The catalogue is a constant of a few dozen
entries (at most CATALOGUE, checked) and is broadcast; documents aren't
shuffled, whatever they hold.

Defined results: a null or empty text, or one whose canonical form is empty,
has no licence; repeated rows and null ids are looked up each on its own; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, table
from .licence_texts import DIGESTS, NOTICES, TEXTS

#: Most entries of a catalogue, which is broadcast.
CATALOGUE = 10_000
#: Fixed values: (spelling, the one that stands for it), applied in order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("modifications are permitted", "modification are permitted"), ("https://", "http://"), ("&", " and "),
)
_COPYRIGHT = r"(?m)^[ \t]*(?:[/*#;-]+[ \t]*)?(?:copyright|\(c\)|\x{A9}|all rights reserved)[^\n]*$"
#: Words after `copyright` that make it licence wording; a colon makes it a statement again (`copyright holder: ...`).
_WORDING = "notices?|holders?|owners?|laws?|licen[cs]e[sd]?|interests?|statements?|disclaimers?|permissions?|protection|resulting|treat(?:y|ies)|rights?|acts?|and|or|in|to|of|on|for|is|are|as|under"
#: _COPYRIGHT without that wording.
_STATEMENT = _COPYRIGHT.replace("copyright|", rf"copyright(?![a-z]|[ \t]*$|[ \t]+(?:{_WORDING})\b(?![ \t]*:))|")
_OTHERS = r"[^a-z0-9\x{80}-\x{10FFFF}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form, still divided into lines."""
    out = F.regexp_replace(lower_ascii(text), _STATEMENT, "")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.regexp_replace(out, _OTHERS, " ")


def canonical(lines: Column) -> Column:
    """The canonical form of what canonical_lines gives."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(spark, catalogue, known=()) -> DataFrame:
    """known_digest and license_id of (SPDX identifier, text) entries and of known (identifier, digest) ones; for one canonical form the smallest identifier."""
    if len(catalogue) + len(known) > CATALOGUE:
        raise ValueError(f"a catalogue has at most {CATALOGUE} entries")
    rows = spark.createDataFrame(list(catalogue), "license_id string, text string")
    rows = rows.select("license_id", canonical(canonical_lines(F.col("text"))).alias("form")).where("form <> ''")
    rows = rows.select("license_id", _digest(F.col("form")).alias("known_digest"))
    rows = rows.unionByName(spark.createDataFrame(list(known), "license_id string, known_digest string"))
    return rows.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts=TEXTS, notices=NOTICES, known=DIGESTS) -> DataFrame:
    """Per row: doc_id, digest (of the whole text's canonical form), license_id (or null), notices (sorted identifiers of whole lines) and n_notices."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(text).alias("lines"))
    rows = rows.select("doc_id", canonical(F.col("lines")).alias("form"), F.transform(F.split("lines", "\n"), lambda x: F.trim(x)).alias("lines"))
    # The notices as one row of a map, by digest; a document's lines meet them where they are.
    lines = digests(spark, notices).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("known_digest", "license_id")))).alias("known"))
    rows = rows.crossJoin(F.broadcast(lines))  # one row
    named = F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.element_at(F.col("known"), _digest(x)))
    rows = rows.select("doc_id", F.when(F.col("form") != "", _digest(F.col("form"))).alias("digest"), F.filter(named, lambda x: x.isNotNull()).alias("found"))
    out = rows.join(F.broadcast(digests(spark, texts, known)), rows["digest"] == F.col("known_digest"), "left")
    return out.select("doc_id", "digest", "license_id", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))


def op7_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    # Line by line and without lookahead: a line is a statement if it starts like one and isn't wording.
    start = r"^[ \t]*(?:[/*#;-]+[ \t]*)?"
    wording = rf"copyright[ \t]+(?:{_WORDING})\b"
    states = f"regexp_matches(x, {quote(start + '(?:copyright|[(]c[)]|©|all rights reserved)')})"
    tests = [start + r"copyright(?:[a-z]|[ \t]*$)", start + wording, start + wording + r"[ \t]*:"]
    glued, worded, headed = (f"regexp_matches(x, {quote(t)})" for t in tests)

    def lines(column: str) -> str:
        out = f"string_split(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))"
        out = f"array_to_string(list_transform({out}, lambda x: CASE WHEN {states} AND NOT {glued} AND NOT ({worded} AND NOT {headed}) THEN '' ELSE x END), chr(10))"
        for spelling, one in SPELLINGS:
            out = f"replace({out}, {quote(spelling)}, {quote(one)})"
        return f"regexp_replace({out}, {quote(_OTHERS)}, ' ', 'g')"

    def form(column: str) -> str:
        return f"trim(regexp_replace({column}, '[ \\n]+', ' ', 'g'))"

    def values(catalogue) -> str:
        return "(VALUES " + ", ".join(f"({quote(i)}, {quote(t)})" for i, t in catalogue) + ") AS v(license_id, text)"

    def known(catalogue) -> str:
        return f"SELECT sha256(f) AS known, min(license_id) AS license_id FROM (SELECT license_id, {form(lines('text'))} AS f FROM {values(catalogue)}) WHERE f <> '' GROUP BY 1"

    return f"""
WITH k AS (SELECT known, min(license_id) AS license_id FROM ({known(TEXTS)} UNION ALL SELECT * FROM (VALUES {", ".join(f"({quote(d)}, {quote(i)})" for i, d in DIGESTS)}) AS v(known, license_id)) GROUP BY known), n AS ({known(NOTICES)}),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines("coalesce(text, '')")} AS l FROM documents),
w AS (SELECT r, doc_id, l, CASE WHEN {form('l')} <> '' THEN sha256({form('l')}) END AS digest FROM d),
x AS (SELECT r, license_id FROM (SELECT r, trim(unnest(string_split(l, chr(10)))) AS s FROM d) JOIN n ON sha256(s) = known WHERE s <> ''),
f AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM x GROUP BY r)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices
FROM w LEFT JOIN k ON digest = known LEFT JOIN f USING (r)
"""


ORACLE = _oracle()
