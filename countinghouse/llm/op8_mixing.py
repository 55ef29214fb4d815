"""Mixing sources to target weights: iterative proportional fitting, then sampling.

The tokens of each (source, language, topic) cell get a weight. Raking scales
the weights to the target share of each source, then of each language, then of
each topic, until every value's share is within DISTANCE of its target (or
SWEEPS rounds are over, where targets contradict each other or the cells); the
distance reached is returned with the cells. A document is then drawn with its
cell's weight divided by a common scale, so that the expected token shares of
the sample are the targets that raking reached. The scale is the weight below
which all but WHOLE of the tokens lie (to a 16th of a doubling); the few cells
above it are kept whole, which moves a share by less than WHOLE. With the
largest weight as the scale one rare cell would thin out all others, the more
the larger the corpus. The draw is a hash of the document's id: the same on
every run and for every copy of a row.

Topics are a column or expression of the caller's; by default a document's
topic is its form, told by measured shares: table, symbols, capitals, list,
note or prose.

Targets are shares by value; where none are given, the actual share to the
power of TEMPERATURE, which lifts small sources, languages and topics.

Native: DataFrame functions only. The cell table has a row for each combination
that occurs. Up to CELLS rows (counted first) it is raked in one partition,
where the window sums need no shuffle, and is broadcast to the documents; more
rows take the same steps over shuffles and a shuffled join.

Defined results: a null source, language or topic is a value of its own; a text
without words has no tokens, and a cell without tokens keeps the weight of its
last scaling; a row without an id is always drawn; values that targets don't
name get share 0 and aren't drawn; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

MARGINS = ("source", "lang", "topic")
#: Rounds at most, rounds between two looks at the distance, and the largest difference of a share from its target that counts as met.
SWEEPS, LOOK, DISTANCE = 200, 4, 1e-11
TEMPERATURE, SEED, WHOLE = 0.9, "mix-1", 0.01
#: Decimal places of weights and probabilities.
PLACES = 6
#: Most cells that are raked in one partition and broadcast.
CELLS = 100_000
#: (form, test on words, chars, lines, pipes, symbols and capitals): the first that holds is the topic.
FORMS = (
    ("table", "4 * pipes > words"), ("symbols", "3 * symbols > words"), ("capitals", "2 * capitals > chars - words AND capitals >= 20"),
    ("note", "words < 50"), ("list", "words < 10 * lines"),
)
OTHER_FORM = "prose"


def with_form(rows: DataFrame) -> DataFrame:
    """rows (t: text, words) with topic: the form of the text."""
    t = F.col("t")
    without = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    counts = {"chars": F.length(t), "lines": without("\n") + 1, "pipes": without("|"), "symbols": F.regexp_count(t, F.lit("[#*$%&<>=]")), "capitals": F.regexp_count(t, F.lit("[A-Z]"))}
    topic = F.lit(OTHER_FORM)
    for name, test in reversed(FORMS):
        topic = F.when(F.expr(test), name).otherwise(topic)
    return rows.withColumns(counts).withColumn("topic", topic).drop(*counts)


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic (its form, or the caller's expression) and n_tokens of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [] if topic is None else [topic.cast("string").alias("topic")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", text.alias("t"), tokens(text).alias("words"), *own)
    rows = with_form(rows) if topic is None else rows
    return rows.select("doc_id", "source", "lang", "topic", F.col("words").alias("n_tokens"))


def _targets(cells: DataFrame, margin: str, given: dict | None, temperature: float) -> DataFrame:
    """cells with goal_<margin>: the target share of the cell's value."""
    values = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("mass").alias("actual"))
    if given is not None:
        share = F.lit(0.0)
        for value, goal in given.items():
            share = F.when(F.col("value").eqNullSafe(F.lit(value)), float(goal)).otherwise(share)
    else:
        share = F.pow(F.col("actual"), F.lit(temperature))
    values = values.withColumn("goal", F.when(F.col("actual") > 0, share).otherwise(0.0))
    values = values.crossJoin(F.broadcast(values.agg(F.sum("goal").alias("all"))))  # a single number
    goals = values.select("value", F.when(F.col("all") > 0, F.col("goal") / F.col("all")).otherwise(0.0).alias(f"goal_{margin}"))
    return cells.join(goals, cells[margin].eqNullSafe(goals["value"])).drop("value")


def _distance(cells: DataFrame, margins) -> float:
    """The largest difference of a value's share of the mass from its goal, over all margins."""
    out = 0.0
    for m in margins:
        got = cells.groupBy(m).agg(F.sum(F.col("weight") * F.col("mass")).alias("got"), F.max(f"goal_{m}").alias("goal"))
        out = max(out, got.agg(F.max(F.abs(F.col("got") - F.col("goal")))).first()[0] or 0.0)
    return out


def rake(cells: DataFrame, margins=MARGINS, targets: dict | None = None, temperature: float = TEMPERATURE, sweeps: int = SWEEPS) -> DataFrame:
    """cells (the margins and mass) with a weight each: weight * mass sums to the target shares of every margin, but for `distance`."""
    # Written before anything else, so that the texts behind them are read once.
    cells = cut(cells.withColumn("mass", F.col("mass").cast("double")))
    few = cells.count() <= CELLS
    for m in margins:
        cells = _targets(cells, m, (targets or {}).get(m), temperature)
    cells, distance = cells.withColumn("weight", F.lit(1.0)), float("inf")
    cells = cells.coalesce(1) if few else cells
    for sweep in range(1, sweeps + 1):
        for m in margins:
            total = F.sum(F.col("weight") * F.col("mass")).over(Window.partitionBy(m))
            cells = cells.withColumn("total", total)
            cells = cells.withColumn("weight", F.when(F.col("total") > 0, F.col("weight") * F.col(f"goal_{m}") / F.col("total")).otherwise(F.col("weight"))).drop("total")
        if sweep % LOOK == 0 or sweep == sweeps:
            cells = cut(cells)
            cells, distance = (cells.coalesce(1) if few else cells), _distance(cells, margins)
            if distance <= DISTANCE:
                break
    return cells.select(*margins, "mass", *[f"goal_{m}" for m in margins], "weight", F.lit(distance).alias("distance"))


def _scale(cells: DataFrame) -> DataFrame:
    """One row: scale, the weight whose documents are just certain; from the mass by steps of the weight, some hundred rows at most."""
    steps = cells.where("mass > 0 AND weight > 0").groupBy(F.floor(16 * F.log2("weight")).alias("step")).agg(F.sum("mass").alias("mass"))
    steps = steps.withColumn("upto", F.sum("mass").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    total = steps.agg(F.sum("mass").alias("all"))
    held = steps.crossJoin(F.broadcast(total)).where(F.col("upto") >= (1 - WHOLE) * F.col("all"))  # a single number
    return held.agg(F.pow(F.lit(2.0), (F.min("step") + 1) / 16).alias("scale"))


def probabilities(rows: DataFrame, targets: dict | None = None) -> DataFrame:
    """The margins of each cell with its weight (1: just certain to be drawn) and the probability of its documents."""
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("mass"))
    raked = cut(rake(cells, targets=targets))
    out = raked.crossJoin(F.broadcast(_scale(raked)))  # a single number
    weight = F.coalesce(F.when(F.col("mass") > 0, F.col("weight") / F.col("scale")), F.lit(0.0))
    share = F.when(F.col("mass") > 0, F.least(weight, F.lit(1.0))).otherwise(1.0)
    return out.select(*MARGINS, F.round(weight, PLACES).alias("weight"), F.round(share, PLACES).alias("probability"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that the id decides; 0 for a null id."""
    digits = F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return F.coalesce(F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52)), F.lit(0.0))


def _with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    cells = cells.select(*[F.col(m).alias(f"cell_{m}") for m in MARGINS], "weight", "probability")
    on = [rows[m].eqNullSafe(cells[f"cell_{m}"]) for m in MARGINS]
    small = cells.limit(CELLS + 1).count() <= CELLS
    return rows.join(F.broadcast(cells) if small else cells, on).drop(*[f"cell_{m}" for m in MARGINS])


def mix(docs: DataFrame, targets: dict | None = None, topic: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens, weight and probability of its cell, and kept (drawn)."""
    rows = described(docs, topic)
    out = _with_probability(rows, probabilities(rows, targets))
    return out.withColumn("kept", F.col("doc_id").isNull() | (draw(F.col("doc_id")) < F.col("probability")))


def sample(docs: DataFrame, targets: dict | None = None, topic: Column | None = None) -> DataFrame:
    """The rows of docs that are drawn; all columns stay as they are."""
    cells = probabilities(described(docs, topic), targets)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [tokens(text).alias("words")] if topic is None else [topic.cast("string").alias("topic")]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", text.alias("t"), *own)
    rows = with_form(rows).drop("words") if topic is None else rows
    kept = _with_probability(rows.drop("t"), cells).where(F.col("doc_id").isNull() | (draw(F.col("doc_id")) < F.col("probability")))
    return kept.select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle(sweeps: int = 40) -> str:
    """The same with a fixed number of sweeps, more than the stopping rule takes on tables whose cells are all there."""
    cases = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in FORMS) + f" ELSE '{OTHER_FORM}' END"
    count = lambda chars: f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g'))"
    parts = [
        "d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)",
        f"f AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words, len(string_split(t, chr(10))) AS lines, {count('|')} AS pipes, {count('#*$%&<>=')} AS symbols, {count('A-Z')} AS capitals, length(t) AS chars FROM d)",
        f"r AS (SELECT doc_id, source, lang, {cases} AS topic, CAST(words AS BIGINT) AS n_tokens FROM f)",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM r GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"v_{m} AS (SELECT {m}, CASE WHEN sum(mass) > 0 THEN pow(sum(mass), {TEMPERATURE}) ELSE 0 END AS goal FROM c GROUP BY {m})")
        parts.append(f"g_{m} AS (SELECT {m}, CASE WHEN sum(goal) OVER () > 0 THEN goal / sum(goal) OVER () ELSE 0 END AS goal_{m} FROM v_{m})")
    parts.append("w0 AS MATERIALIZED (SELECT c.*, goal_source, goal_lang, goal_topic, 1.0::DOUBLE AS weight FROM c " + " ".join(f"JOIN g_{m} ON c.{m} IS NOT DISTINCT FROM g_{m}.{m}" for m in MARGINS) + ")")
    # One recursive step is one margin's scaling.
    goal = "CASE k % 3 " + " ".join(f"WHEN {i} THEN goal_{m}" for i, m in enumerate(MARGINS)) + " END"
    value = "CASE k % 3 " + " ".join(f"WHEN {i} THEN coalesce('v' || {m}, '')" for i, m in enumerate(MARGINS)) + " END"
    parts.append(f"""s AS (SELECT 0 AS k, * FROM w0 UNION ALL
  SELECT k + 1, source, lang, topic, mass, goal_source, goal_lang, goal_topic, CASE WHEN total > 0 THEN weight * goal / total ELSE weight END
  FROM (SELECT *, sum(weight * mass) OVER (PARTITION BY {value}) AS total, {goal} AS goal FROM s) WHERE k < {len(MARGINS) * sweeps})""")
    parts.append(f"p AS MATERIALIZED (SELECT * FROM s WHERE k = {len(MARGINS) * sweeps})")
    parts.append("t AS (SELECT CAST(floor(16 * log2(weight)) AS BIGINT) AS step, sum(mass) AS mass FROM p WHERE mass > 0 AND weight > 0 GROUP BY step)")
    parts.append("m AS (SELECT step, sum(mass) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS upto, sum(mass) OVER () AS total FROM t)")
    parts.append(f"e AS (SELECT pow(2::DOUBLE, (min(step) + 1) / 16::DOUBLE) AS scale FROM m WHERE upto >= (1 - {WHOLE}::DOUBLE) * total)")
    parts.append(
        f"q AS (SELECT source, lang, topic, round(CASE WHEN mass > 0 THEN coalesce(weight / scale, 0) ELSE 0 END, {PLACES}) AS weight, "
        f"round(CASE WHEN mass > 0 THEN least(coalesce(weight / scale, 0), 1) ELSE 1 END, {PLACES}) AS probability FROM p, e)"
    )
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT r.doc_id, r.source, r.lang, r.topic, n_tokens, weight, probability, "
        f"r.doc_id IS NULL OR CAST(('0x' || substr(md5(CAST(r.doc_id AS VARCHAR) || ':{SEED}'), 1, 13)) AS BIGINT) / {1 << 52}::DOUBLE < probability AS kept "
        "FROM r JOIN q ON " + " AND ".join(f"r.{m} IS NOT DISTINCT FROM q.{m}" for m in MARGINS)
    )


ORACLE = _oracle()
