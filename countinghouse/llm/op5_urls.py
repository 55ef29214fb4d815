"""URL filters: word segmentation of hosts and a multinomial naive Bayes verdict.

1. Words are what separators set apart in any url of the table: parts of
   hyphenated host labels and of paths, two letters or more, with their counts
   over all urls, and SEEDS. A Viterbi pass over each distinct host label finds
   the split into words with the least cost, a word's cost being minus the log
   of its share; a letter that no word covers costs UNKNOWN, and such letters
   stay together as one word. Of splits with equal costs the one whose last
   word starts first wins.
2. A host is a weakly labelled example of the block class if its words hold one
   of SEEDS, or if it has LEAST_PAGES pages or more, half of whose contents are
   mostly marks (BLOCK_CONTENT); all other hosts are of the allow class. Rules
   teach nothing: their words would only teach the rules back. Naive Bayes
   counts the words of hosts and of paths in each class, over all urls.
3. A url takes the verdict of the longest rule that fits it; without one, block
   if the naive Bayes odds are above even. A word that no counted url has weighs
   nothing.

All counts are tables that are joined by word, host or path. Urls are first
grouped by host and by path, so that a host with a third of all urls is a row
in these joins. A label meets the dictionary by its pieces of up to PIECE
letters; longer words meet it by their first PIECE letters and are compared
whole, so words may have any length. No join asks for a broadcast; Spark
broadcasts a side whose measured size is below its own threshold. Costs are
whole millionths and odds decimals, so sums don't depend on order.

Defined results: a null url, or one without `://`, has an empty host and path
and no words, score 0, and is allowed; hosts keep letters beyond ASCII, which
count as letters and aren't lower-cased; words of digits only are left out of
the counts; pages without an html column, or with null html, tell nothing by
their content; repeated rows are judged each on its own; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, table

#: (rule, verdict): a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that mark a host as unwanted, for the weak labels.
SEEDS = ("ads", "adult", "bets", "betting", "casino", "cheap", "gambling", "jackpot", "loans", "pills", "poker", "porn", "sex", "spam", "torrent", "track", "viagra", "warez", "xxx")
#: How often each seed counts as seen, and the cost of a letter that no word covers, in millionths of a nat.
SEED_COUNT, UNKNOWN = 50, 12_000_000
#: Pages that a host needs for its contents to count, and whether a page's content is mostly marks.
LEAST_PAGES = 3
BLOCK_CONTENT = "10 * marks > words"
#: Letters of the pieces by which labels meet the dictionary.
PIECE = 24
_SEPARATOR = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_MARKS, _WORD = r"[#*$%]{3}|!!", r"[^\x20\x09-\x0D]+"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, start = rule.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{start}"))
        out = F.when(fits, rule).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and spam (whether the content is mostly marks) of each row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")) if "html" in pages.columns else F.lit("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.regexp_count(html, F.lit(_MARKS)).alias("marks"), F.regexp_count(html, F.lit(_WORD)).alias("words"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.expr(BLOCK_CONTENT).alias("spam"))
    return rows.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"), "spam")


def parts_of(text: Column) -> Column:
    """What separators set apart, in order."""
    return F.filter(F.split(text, _SEPARATOR), lambda x: x != "")


def dictionary(hosts: DataFrame, paths: DataFrame, seeds=SEEDS) -> DataFrame:
    """(word, cost) of the words that separators set apart in hosts and paths (with n urls each), and of the seeds."""
    labels = F.filter(F.split("host", r"\."), lambda x: F.contains(x, F.lit("-")))
    words = hosts.select(F.explode(F.flatten(F.transform(labels, parts_of))).alias("word"), "n").unionByName(paths.select(F.explode(parts_of(lower_ascii(F.col("path")))).alias("word"), "n"))
    words = words.where("length(word) >= 2 AND NOT word RLIKE '^[0-9]+$'")
    own = hosts.sparkSession.createDataFrame([(w, SEED_COUNT) for w in seeds], "word string, n long")
    counts = words.unionByName(own).groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))  # one number
    return cut(counts.select("word", F.round(F.log(F.col("total") / F.col("n")) * 1e6).cast("long").alias("cost")))


def _pieces(batches):
    """From (label_id, label): (label_id, start, piece) for each piece of 2 to PIECE letters."""
    names = ["label_id", "start", "piece"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string()))], names)

    for batch in batches:
        rows = []
        for label_id, label in zip(batch["label_id"].to_pylist(), batch["label"].to_pylist()):
            for start in range(len(label)):
                rows += [(label_id, start, label[start:end]) for end in range(start + 2, min(len(label), start + PIECE) + 1)]
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        yield out(rows)


def split_label(label: str, found) -> list[str]:
    """The cheapest split of a label, from the words found in it as (start, word, cost)."""
    starts: dict[int, list] = {}
    for start, word, cost in found:
        if label.startswith(word, start):
            starts.setdefault(start, []).append((start + len(word), cost))
    # The cheapest way to each place, with the start of its last word: places are settled from left to right.
    best: list = [(0, 0)] + [None] * len(label)
    for at in range(len(label)):
        for end, cost in [(at + 1, UNKNOWN), *starts.get(at, [])]:
            way = (best[at][0] + cost, at)
            if best[end] is None or way < best[end]:
                best[end] = way
    words, end, loose = [], len(label), 0
    while end or loose:
        start = best[end][1] if end else 0
        if end and end - start == 1:  # a letter that no word covers joins the letters after it
            loose, end = loose or end, start
            continue
        if loose:
            words.append(label[end:loose])
            loose = 0
        if end:
            words.append(label[start:end])
            end = start
    return words[::-1]


def _split(batches):
    for batch in batches:
        found = [[(x["start"], x["word"], x["cost"]) for x in f or ()] for f in batch["found"].to_pylist()]
        words = [split_label(label, f) for label, f in zip(batch["label"].to_pylist(), found)]
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(words, pa.list_(pa.string()))], ["label", "words"])


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words): the cheapest split of each distinct label, by a dictionary (word, cost)."""
    labels = labels.select("label", F.md5(F.col("label").cast("binary")).alias("label_id"))
    pieces = labels.select("label_id", "label").mapInArrow(_pieces, "label_id string, start int, piece string")
    known = words.select(F.substring("word", 1, PIECE).alias("key"), "word", "cost")
    met = pieces.join(known, pieces["piece"] == known["key"])
    found = met.groupBy(F.col("label_id").alias("found_id")).agg(F.collect_list(F.struct("start", "word", "cost")).alias("found"))
    return labels.join(found, labels["label_id"] == found["found_id"], "left").select("label", "found").mapInArrow(_split, "label string, words array<string>")


def _counted(word: Column) -> Column:
    return ~word.rlike("^[0-9]+$")


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words): the words of each host's labels, in order."""
    parts = cut(hosts.select("host", F.posexplode(parts_of(F.col("host"))).alias("place", "part")))
    split = segmented(parts.select(F.col("part").alias("label")).distinct(), words)
    out = parts.join(split, parts["part"] == split["label"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("w"))
    return out.select("host", F.flatten(F.transform("w", lambda x: x["words"])).alias("words"))


def _odds(hosts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, odds): the log odds of block against allow, with add-one smoothing, from hosts (words, block, n) and pairs (path_words, block, n)."""
    both = hosts.select(F.explode("words").alias("word"), "block", "n").unionByName(pairs.select(F.explode("path_words").alias("word"), "block", "n")).where(_counted(F.col("word")))
    sides = [F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))).alias("a")]
    counts = cut(both.groupBy("word").agg(*sides))
    totals = counts.agg((F.sum("b") + F.count("*")).alias("all_b"), (F.sum("a") + F.count("*")).alias("all_a"))
    counts = counts.crossJoin(F.broadcast(totals))  # two numbers
    odds = F.log((F.col("b") + 1) / F.col("all_b")) - F.log((F.col("a") + 1) / F.col("all_a"))
    return counts.select("word", F.round(odds, 9).cast("decimal(20,9)").alias("odds"))


def filter_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, learn: Column | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, words (segmented host and path), score (log odds of block) and verdict.

    learn: which rows of (page_id, host, path, rule, spam) the counts are taken from; all if it isn't given.
    """
    urls = cut(judged(pages, rules))
    seen = urls if learn is None else urls.where(learn)
    numbers = [F.count("*").alias("n"), F.sum(F.col("spam").cast("long")).alias("spam")]
    hosts = cut(urls.groupBy("host").agg(F.lit(1).alias("any")).join(seen.groupBy("host").agg(*numbers), "host", "left").drop("any").na.fill(0))
    pairs = cut(seen.groupBy("host", "path").agg(F.count("*").alias("n")))
    words = dictionary(hosts.where("n > 0"), pairs.groupBy("path").agg(F.sum("n").alias("n")), seeds)
    split = host_words(hosts, words)
    content = (F.col("n") >= LEAST_PAGES) & (2 * F.col("spam") >= F.col("n"))
    seeded = F.coalesce(F.arrays_overlap("words", F.array(*[F.lit(w) for w in seeds])), F.lit(False)) if seeds else F.lit(False)
    hosts = hosts.join(split, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    hosts = cut(hosts.select("host", "n", "words", (seeded | content).alias("block")))
    blocks = hosts.select("host", "block")
    path_words = F.filter(parts_of(lower_ascii(F.col("path"))), _counted)
    pairs = pairs.join(blocks, "host").groupBy("path", "block").agg(F.sum("n").alias("n")).withColumn("path_words", path_words)
    odds = cut(_odds(hosts.where("n > 0"), pairs))

    def scored(rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows (key, words) with the sum of their words' odds."""
        each = rows.select(key, F.explode("words").alias("word")).join(odds, "word")
        return rows.join(each.groupBy(key).agg(F.sum("odds").alias(name)), key, "left").select(key, F.col("words").alias(f"{name}_words"), F.coalesce(name, F.lit(0)).cast("decimal(28,9)").alias(name))

    # Written, so that both sides of the joins below are plain exchanges, whose large partitions Spark splits.
    by_host = cut(scored(hosts.select("host", "words"), "host", "host_score"))
    by_path = cut(scored(urls.select("path").distinct().withColumn("words", path_words), "path", "path_score"))
    sizes = hosts.groupBy("block").agg(F.sum("n").alias("n"))
    prior = sizes.agg((F.log((F.coalesce(F.sum(F.when(F.col("block"), F.col("n"))), F.lit(0)) + 1) / (F.coalesce(F.sum(F.when(~F.col("block"), F.col("n"))), F.lit(0)) + 1))).alias("prior"))
    out = urls.drop("spam").join(by_host, "host").join(by_path, "path").crossJoin(F.broadcast(prior))  # a number
    score = (F.round("prior", 9).cast("decimal(20,9)") + F.col("host_score") + F.col("path_score")).cast("double")
    out = out.withColumn("words", F.concat("host_score_words", "path_score_words"))
    out = out.withColumn("score", F.when(F.size("words") > 0, score).otherwise(F.lit(0.0)))
    verdict = F.when(F.col("score") > 0, "block").otherwise("allow")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return out.select("page_id", "host", "path", "rule", "words", "score", verdict.alias("verdict"))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    rest = "substr(url, strpos(url, '://') + 3)"
    parts = lambda x: f"list_filter(regexp_split_to_array({x}, {quote(_SEPARATOR)}), lambda x: x <> '')"
    fits = lambda rule: f"(host = {quote(rule.split('/')[0])} OR ends_with(host, {quote('.' + rule.split('/')[0])})) AND starts_with(path, {quote('/' + rule.split('/', 1)[1])})"
    longest = sorted(RULES, key=lambda r: (len(r[0]), r[0]), reverse=True)
    digits = "regexp_full_match({}, '[0-9]+')".format
    seeds = ", ".join(f"({quote(w)}, {SEED_COUNT})" for w in SEEDS)
    return f"""
WITH RECURSIVE
a AS (SELECT page_id, coalesce(url, '') AS url, 10 * len(regexp_extract_all(coalesce(html, ''), {quote(_MARKS)})) > len(regexp_extract_all(coalesce(html, ''), {quote(_WORD)})) AS spam FROM pages),
u AS MATERIALIZED (SELECT page_id, spam, CASE WHEN contains(url, '://') THEN {lower(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM a),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE spam) AS spam, {parts('host')} AS parts FROM u GROUP BY host),
sep AS (
  SELECT unnest({parts('label')}) AS word, n FROM (SELECT unnest(string_split(host, '.')) AS label, n FROM h) WHERE contains(label, '-')
  UNION ALL SELECT unnest({parts(lower('path'))}), 1 FROM u),
cnt AS (SELECT word, sum(n) AS n FROM (SELECT word, n FROM sep WHERE length(word) >= 2 AND NOT {digits('word')} UNION ALL SELECT * FROM (VALUES {seeds}) AS v(w, c)) GROUP BY word),
dict AS MATERIALIZED (SELECT word, CAST(round(ln(sum(n) OVER () / n) * 1e6) AS BIGINT) AS cost FROM cnt),
p AS MATERIALIZED (SELECT DISTINCT unnest(parts) AS part FROM h),
sub AS (SELECT part, s, unnest(range(2, length(part) - s + 1)) AS l FROM (SELECT part, unnest(range(0, length(part))) AS s FROM p)),
met AS (SELECT part, s + l AS e, s, cost FROM sub JOIN dict ON word = substr(part, s + 1, l) UNION ALL SELECT part, s + 1, s, {UNKNOWN} FROM (SELECT part, unnest(range(0, length(part))) AS s FROM p)),
opt AS MATERIALIZED (SELECT part, e, list({{'s': s, 'c': cost}}) AS ways FROM met GROUP BY part, e),
best AS (SELECT part, CAST(0 AS BIGINT) AS e, [CAST(0 AS BIGINT)] AS cost, [CAST(0 AS BIGINT)] AS back FROM p
  UNION ALL SELECT part, e, list_append(cost, w.c), list_append(back, w.s) FROM (
    SELECT best.part, opt.e, cost, back, list_sort(list_transform(ways, lambda x: {{'c': CAST(cost[x.s + 1] + x.c AS BIGINT), 's': CAST(x.s AS BIGINT)}}))[1] AS w FROM best JOIN opt ON opt.part = best.part AND opt.e = best.e + 1)),
done AS (SELECT * FROM best WHERE e = length(part)),
walk AS (SELECT part, back, e, back[e + 1] AS s FROM done WHERE e > 0 UNION ALL SELECT part, back, s, back[s + 1] FROM walk WHERE s > 0),
run AS (SELECT part, s, e, CASE WHEN e - s = 1 THEN s - row_number() OVER (PARTITION BY part, e - s = 1 ORDER BY s) END AS loose FROM walk),
split AS MATERIALIZED (SELECT part, substr(part, min(s) + 1, max(e) - min(s)) AS word FROM run GROUP BY part, loose, CASE WHEN loose IS NULL THEN s END),
hw AS MATERIALIZED (SELECT host, word FROM (SELECT host, unnest(parts) AS part FROM h) JOIN split USING (part)),
hb AS MATERIALIZED (SELECT host, n, (n >= {LEAST_PAGES} AND 2 * spam >= n) OR host IN (SELECT host FROM hw WHERE word IN (SELECT w FROM (VALUES {seeds}) AS v(w, c))) AS block FROM h),
pw AS MATERIALIZED (SELECT path, word FROM (SELECT path, unnest({parts(lower('path'))}) AS word FROM (SELECT DISTINCT path FROM u)) WHERE NOT {digits('word')}),
wc AS (SELECT word, sum(CASE WHEN block THEN n ELSE 0 END) AS b, sum(CASE WHEN block THEN 0 ELSE n END) AS a FROM (
  SELECT word, block, n FROM hw JOIN hb USING (host) WHERE NOT {digits('word')}
  UNION ALL SELECT word, block, n FROM (SELECT path, block, count(*) AS n FROM u JOIN hb USING (host) GROUP BY path, block) JOIN pw USING (path)) GROUP BY word),
od AS (SELECT word, CAST(round(ln((b + 1) / (sum(b) OVER () + count(*) OVER ())) - ln((a + 1) / (sum(a) OVER () + count(*) OVER ())), 9) AS DECIMAL(20, 9)) AS odds FROM wc),
hs AS (SELECT host, sum(odds) AS score FROM hw JOIN od USING (word) GROUP BY host),
ps AS (SELECT path, sum(odds) AS score FROM pw JOIN od USING (word) GROUP BY path),
pr AS (SELECT CAST(round(ln(CAST(coalesce(sum(n) FILTER (WHERE block), 0) + 1 AS DOUBLE) / CAST(coalesce(sum(n) FILTER (WHERE NOT block), 0) + 1 AS DOUBLE)), 9) AS DECIMAL(20, 9)) AS prior FROM hb),
f AS (SELECT page_id, u.host, u.path, CASE {" ".join(f"WHEN {fits(r)} THEN {quote(r)}" for r, _ in longest)} END AS rule,
  CASE WHEN u.host IN (SELECT host FROM hw) OR u.path IN (SELECT path FROM pw) THEN CAST(prior + coalesce(hs.score, 0) + coalesce(ps.score, 0) AS DOUBLE) ELSE 0.0 END AS score
  FROM u LEFT JOIN hs USING (host) LEFT JOIN ps USING (path), pr)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = {quote(r)} THEN {quote(v)}" for r, v in RULES)} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, CAST(score AS DOUBLE) AS score FROM f
"""


ORACLE = _oracle()
