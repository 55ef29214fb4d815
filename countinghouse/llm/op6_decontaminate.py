"""Benchmark decontamination: Wu-Manber search for many word patterns.

The patterns are the 13-word windows of the benchmark items (an item of fewer
words is one window). For the patterns of one length a shift table over blocks
of two words tells how far a search may jump; only where it says 0 does a
suffix-hash bucket name the patterns to test, and a comparison of the words
themselves confirms an occurrence. Cursors over stretches of all documents of a
chunk move together, so that each step is a few numpy operations.

Documents are scanned where they are read: nothing is shuffled. The patterns go
to the executors in blocks: Spark numbers the benchmark's text by running size,
so that a block has at most BLOCK_CHARS characters; an item that is longer is
cut into pieces that overlap by a window less a word, which have the same
windows. One block at a time is on the driver. With more than one block the
documents' hit marks are carried from block to block with the whole row.

Defined results: a null or empty text has no words, no hits, and isn't
contaminated; an item without words has no window; an item whose item_id is
null marks words but isn't counted; repeated rows are scanned each on its own;
extra columns are ignored; empty tables give no rows (documents) or no hits
(benchmark).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, table
from .words import Hasher, alnum_table, lower_table, text_chunks, word_spans

WINDOW = 13
#: Most characters of benchmark text whose patterns are sent to the executors at once.
BLOCK_CHARS = 16_000_000
#: Window starts in the stretch of one cursor.
STRETCH = 256
_BLOCK = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Patterns:
    """The tables for the patterns of one length."""

    def __init__(self, length: int, phrases: dict[bytes, set], hasher: Hasher):
        self.length, self.phrases = length, list(phrases)
        self.items = [sorted(phrases[p]) for p in self.phrases]
        data = np.frombuffer(b" ".join(self.phrases), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), alnum_table())
        words = hasher.of_words(data, starts, ends).reshape(-1, length)
        self.size = min(2, length)
        self.bits = int(min(22, max(12, np.ceil(np.log2(16 * words.size)))))
        self.shift = np.full(1 << self.bits, length - self.size + 1, np.uint8)
        for end in range(self.size, length + 1):
            np.minimum.at(self.shift, self.block(words, end - self.size), length - end)
        suffix = self.suffix(words)
        order = np.argsort(suffix, kind="stable")
        self.buckets, first = np.unique(suffix[order], return_index=True)
        self.order, self.first = order, np.append(first, len(order))
        self.words = words

    def block(self, words, at):
        """Places in the shift table of the blocks that start at `at`, along the last axis."""
        h = words[..., at] * _BLOCK
        if self.size == 2:
            h = (h ^ (h >> np.uint64(29))) + words[..., at + 1]
        return (h * _BLOCK) >> np.uint64(64 - self.bits)

    def suffix(self, words):
        """Hashes of the last four words, or of all if there are fewer, of rows of words."""
        h = np.zeros(len(words), np.uint64)
        for j in range(max(0, self.length - 4), self.length):
            h = (h ^ (h >> np.uint64(31))) * _BLOCK + words[:, j]
        return h

    def search(self, words, bounds):
        """(start, pattern) of windows that have the words' hashes of a pattern."""
        none = np.zeros(0, np.int64)
        last = bounds[1:] - self.length + 1
        has = last > bounds[:-1]
        if not has.any():
            return none, none
        lo, hi = bounds[:-1][has], last[has]
        n = -(-(hi - lo) // STRETCH)
        at = np.repeat(lo, n) + STRETCH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(at + STRETCH, np.repeat(hi, n))
        found = []
        while len(at):
            step = self.shift[self.block(words, at + self.length - self.size)]
            zero = step == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(step, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        if not found:
            return none, none
        at = np.concatenate(found)
        rows = words[at[:, None] + np.arange(self.length)]
        suffix = self.suffix(rows)
        bucket = np.minimum(np.searchsorted(self.buckets, suffix), len(self.buckets) - 1)
        same = self.buckets[bucket] == suffix
        at, rows, bucket = at[same], rows[same], bucket[same]
        out_at, out_pattern, k = [], [], 0
        while len(at):
            left = self.first[bucket] + k < self.first[bucket + 1]
            at, rows, bucket = at[left], rows[left], bucket[left]
            pattern = self.order[self.first[bucket] + k]
            equal = (rows == self.words[pattern]).all(axis=1)
            out_at.append(at[equal])
            out_pattern.append(pattern[equal])
            k += 1
        return (np.concatenate(out_at), np.concatenate(out_pattern)) if out_at else (none, none)


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(lower_table().tobytes())


def patterns_of(items, window: int = WINDOW) -> list[Patterns]:
    """Search tables for rows (item, text); a text of fewer words than a window is one window."""
    hasher, by_length = Hasher(), defaultdict(lambda: defaultdict(set))
    for item, text in items:
        data = _lowered(text or "")
        starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]), alnum_table())
        words = [data[a:b] for a, b in zip(starts, ends)]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            by_length[size][b" ".join(words[i : i + size])].update([item] if item is not None else [])
    return [Patterns(n, phrases, hasher) for n, phrases in sorted(by_length.items())]


def scan(column, groups: list[Patterns], hasher: Hasher):
    """For each chunk of a column of texts: (bounds, marks of hit words, items by row)."""
    lower, alnum = lower_table(), alnum_table()
    for lo, hi, data, offsets in text_chunks(column):
        data = lower[data]
        starts, ends, bounds = word_spans(data, offsets, alnum)
        words = hasher.of_words(data, starts, ends)
        edges, items = np.zeros(len(words) + 1, np.int32), defaultdict(set)
        for g in groups:
            at, pattern = g.search(words, bounds)
            docs = np.searchsorted(bounds, at, side="right") - 1
            for a, p, d in zip(at.tolist(), pattern.tolist(), docs.tolist()):
                text = b" ".join(data[s:e].tobytes() for s, e in zip(starts[a : a + g.length].tolist(), ends[a : a + g.length].tolist()))
                if text == g.phrases[p]:
                    edges[a] += 1
                    edges[a + g.length] -= 1
                    items[d].update(g.items[p])
        yield lo, hi, bounds, np.cumsum(edges[:-1]) > 0, items


def _digest(n_words, n_hit, items):
    names = sorted(items)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def _results(column, groups, hasher, before=None):
    """Per row n_words, n_hit, n_items, items_sha256, contaminated; before: (marks, items) columns of earlier blocks."""
    for lo, hi, bounds, hit, items in scan(column, groups, hasher):
        for d in range(hi - lo):
            mine, known = hit[bounds[d] : bounds[d + 1]], items.get(d, set())
            if before is not None and before[0][lo + d] is not None:
                mine = mine | np.unpackbits(np.frombuffer(before[0][lo + d], np.uint8), count=len(mine)).astype(bool)
                known = known | set(before[1][lo + d])
            yield mine, known


def _batches(groups, emit):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            yield emit(batch, lambda column, before=None: _results(column, groups, hasher, before))

    return run


def pieces_of(benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    """(item, text): the items' words joined by spaces, in pieces of a 64th of a block (but not of less than two windows) that have all their windows, each piece once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(lower_ascii(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    # So many window starts a piece that it has at most block_chars / 64 characters, by its item's longest word: at least a window's worth, so that overlaps at most double the text.
    longest = F.array_max(F.transform("w", lambda x: F.length(x))) + 1
    step = F.greatest(F.lit(window), F.floor(F.lit(block_chars / 64) / longest) - window).cast("int")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)), step))
    return words.select("item", "w", step.alias("step"), at.alias("at")).select("item", F.array_join(F.slice("w", F.col("at"), F.col("step") + window - 1), " ").alias("text")).distinct()


def blocks_of(benchmark: DataFrame, window: int, block_chars: int):
    """The patterns in blocks of at most block_chars characters (one that is a single piece may have more): (how many, one's rows by its number)."""
    pieces = pieces_of(benchmark, window, block_chars)
    total = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= block_chars:
        return 1, lambda b: pieces.collect()
    # Chunks of pieces, each below half of a block, are numbered by running size: a row a chunk.
    chunks, half = -(-16 * total // block_chars), block_chars // 2
    while True:
        dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(chunks)))
        sizes = cut(dealt.groupBy("chunk").agg(F.sum(F.length("text")).alias("size"), F.max(F.length("text")).alias("longest")))
        if not sizes.where((F.col("size") > half) & (F.col("longest") < F.col("size"))).limit(1).count():
            break
        chunks *= 2
    so_far = F.sum("size").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut(sizes.withColumn("block", F.floor(F.coalesce(so_far, F.lit(0)) / F.lit(half))).select("chunk", "block"))
    blocks = [r["block"] for r in numbered.select("block").distinct().orderBy("block").collect()]
    dealt = cut(dealt.join(numbered, "chunk").select("block", "item", "text"))
    return len(blocks), lambda b: dealt.where(F.col("block") == blocks[b]).drop("block").collect()


def _free(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have yet."""
    while name in df.columns:
        name = f"_{name}"
    return name


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int):
    """docs with the marks and items that all blocks but the last give (null if there is one block), these columns' names, and the last one's patterns."""
    n, rows_of = blocks_of(benchmark, window, block_chars)
    marks, items = _free("marks", docs), _free("items", docs)
    rows, names = docs.withColumns({marks: F.lit(None).cast("binary"), items: F.lit(None).cast("array<string>")}), docs.columns

    def emit(batch, results):
        out = [(np.packbits(m).tobytes(), sorted(k)) for m, k in results(batch["text"], (batch[marks].to_pylist(), batch[items].to_pylist()))]
        columns = [batch[c] for c in names] + [pa.array([m for m, _ in out], pa.binary()), pa.array([k for _, k in out], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, [*names, marks, items])

    for b in range(n - 1):
        rows = cut(rows.mapInArrow(_batches(patterns_of(rows_of(b), window), emit), rows.schema))
    return rows, marks, items, patterns_of(rows_of(n - 1), window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id and the digest columns of SCHEMA."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, marks, items, groups = _marked(rows, benchmark, window, block_chars)

    def last(batch, results):
        out = [_digest(len(m), int(m.sum()), k) for m, k in results(batch["text"], (batch[marks].to_pylist(), batch[items].to_pylist()))]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.mapInArrow(_batches(groups, last), SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that are contaminated, each row judged by itself; all columns stay as they are."""
    names = docs.columns
    rows, marks, items, groups = _marked(docs, benchmark, window, block_chars)

    def clean(batch, results):
        keep = [not _digest(len(m), int(m.sum()), ())[-1] for m, _ in results(batch["text"], (batch[marks].to_pylist(), batch[items].to_pylist()))]
        return batch.select(names).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(_batches(groups, clean), docs.schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.size, dw.i, bw.item_id FROM dw JOIN bw USING (size, phrase)),
covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
