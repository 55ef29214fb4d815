"""Line dedup: range-partitioned line hashes, secondary sort, first occurrences streamed.

1. Each task takes the keys of its documents' lines (stripped, A-Z lower-cased,
   at least 10 code points) as 128-bit hashes. Within a block of lines a key's
   smallest document is known, so its other documents are settled there; only
   (key, smallest document, position) is dealt on, a row a block even for a line
   that a third of all documents hold.
2. Those rows are range partitioned by key and sorted by key, document and
   position; one pass over each partition meets a key's first occurrence first
   and tells every later document to drop the key.
3. Each document meets its dropped keys by doc_id and gets a keep bitmap, a bit
   a line, compressed to run lengths, and the digest of what the bitmap leaves.
   The text itself doesn't leave the task; `apply_bitmap` gives it.

A bitmap is written as the lengths of its runs, joined by commas: lines that
stay, lines that go, and so on by turns; the first length may be 0.

Defined results: a null or empty text is one empty line, which stays; a
document without an id neither holds nor loses lines; rows that repeat a doc_id
are one document (they don't drop each other's lines); extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, table

MIN_CHARS = 10
BLOCK_LINES = 200_000
_SPACE = b" \t\n\x0b\x0c\r"
_FOUND = "h1 long, h2 long, doc_id long, at int, keys binary"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """A 16-byte hash for each line, None where the key is too short."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(_SPACE)
        chars = len(key) if key.isascii() else sum(b & 0xC0 != 0x80 for b in key)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if chars >= min_chars else None)
    return out


def _rows(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["h1", "h2", "doc_id", "at", "keys"])


def _settled(lines: list) -> pa.RecordBatch:
    """lines: (key, doc_id, position). A row for each key with its smallest document, and for the other documents what they drop."""
    least, drop = {}, {}
    for line in lines:
        if line[0] not in least or line[1:] < least[line[0]][1:]:
            least[line[0]] = line
    for key, doc, _ in lines:
        if doc > least[key][1]:
            drop.setdefault(doc, set()).add(key)
    first = [(int.from_bytes(k[:8], "big", signed=True), int.from_bytes(k[8:], "big", signed=True), doc, at, None) for k, doc, at in least.values()]
    return _rows(first + [(None, None, doc, None, b"".join(sorted(keys))) for doc, keys in drop.items()])


def _holders(min_chars: int):
    def run(batches):
        block = []
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                block += [(k, doc, at) for at, k in enumerate(line_keys(text.as_py(), min_chars)) if k is not None]
                if len(block) >= BLOCK_LINES:
                    yield _settled(block)
                    block = []
        if block:
            yield _settled(block)

    return run


def _later(batches):
    """From rows sorted by key, document and position: (doc_id, key) for each document after a key's first."""
    h1 = h2 = first = None
    for batch in batches:
        if not len(batch):
            continue
        a, b, doc = (batch[c].to_numpy() for c in ("h1", "h2", "doc_id"))
        new = np.append(h1 is None or a[0] != h1 or b[0] != h2, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        firsts = np.append(-1 if first is None else first, doc[new])
        lead = firsts[np.cumsum(new)]
        h1, h2, first = a[-1], b[-1], lead[-1]
        later = doc > lead
        keys = np.stack([a[later], b[later]], axis=1).astype(">i8").tobytes()
        n = int(later.sum())
        yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array([keys[16 * i : 16 * i + 16] for i in range(n)], pa.binary())], ["doc_id", "keys"])


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """drop_id, drop_keys: for each document that loses lines the 16-byte hashes of their keys."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = cut(rows.where(F.col("doc_id").isNotNull()).mapInArrow(_holders(min_chars), _FOUND))
    first = held.where(F.col("h1").isNotNull()).select("h1", "h2", "doc_id", "at")
    dealt = first.repartitionByRange(partitions(docs.sparkSession), "h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "at")
    later = dealt.mapInArrow(_later, "doc_id long, keys binary")
    settled = held.where(F.col("h1").isNull()).select("doc_id", "keys")
    return later.unionByName(settled).groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_list("keys").alias("drop_keys"))


def keep_bits(text: str | None, drop_keys, min_chars: int = MIN_CHARS) -> np.ndarray:
    """A truth value for each line of a text: whether it stays."""
    if not drop_keys:
        return np.ones((text or "").count("\n") + 1, bool)
    gone = {blob[i : i + 16] for blob in drop_keys for i in range(0, len(blob), 16)}
    return np.array([k is None or k not in gone for k in line_keys(text, min_chars)], bool)


def packed(keep: np.ndarray) -> str:
    """The run lengths of a bitmap."""
    edges = np.flatnonzero(np.append(keep[1:] != keep[:-1], True)) + 1
    return ",".join(map(str, [*[0] * (not keep[0]), *np.diff(edges, prepend=0)]))


def unpacked(bitmap: str) -> np.ndarray:
    """The bitmap that run lengths stand for."""
    runs = list(map(int, bitmap.split(",")))
    return np.repeat(np.arange(len(runs)) % 2 == 0, runs)


def kept_text(text: str | None, keep: np.ndarray) -> str:
    """The lines that a keep bitmap leaves, joined."""
    text = text or ""
    return text if keep.all() else "\n".join(line for line, k in zip(text.split("\n"), keep) if k)


def apply_bitmap(text: str | None, bitmap: str) -> str:
    """The lines that a keep bitmap of keep_bitmaps leaves, joined."""
    return kept_text(text, unpacked(bitmap))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, keep_bitmap (run lengths) and kept_sha256 (of the kept lines, UTF-8)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drops = dropped_keys(docs, min_chars)

    def run(batches):
        for batch in batches:
            out = []
            for text, keys in zip(batch["text"], batch["drop_keys"].to_pylist()):
                text = text.as_py()
                keep = keep_bits(text, keys, min_chars)
                bitmap = packed(keep)
                left = apply_bitmap(text, bitmap)
                out.append((len(keep), len(keep) - int(keep.sum()), bitmap, hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"])

    joined = rows.join(drops, rows["doc_id"] == drops["drop_id"], "left").drop("drop_id")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, keep_bitmap string, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the repeated lines gone from `text`, n_chars (if there is one) counted anew; the other columns stay."""
    drops = dropped_keys(docs, min_chars)
    keys = "drop_keys"
    while keys in docs.columns:
        keys = f"_{keys}"
    drops = drops.withColumnRenamed("drop_keys", keys)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = [None if t.as_py() is None else kept_text(t.as_py(), keep_bits(t.as_py(), k, min_chars)) for t, k in zip(batch["text"], batch[keys].to_pylist())]
            columns = {c: batch[c] for c in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    out = docs.join(drops, docs["doc_id"] == drops["drop_id"], "left").drop(drops["drop_id"]).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op10_lines(spark, sf_dir: str) -> DataFrame:
    return keep_bitmaps(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (
  SELECT doc_id, p, s, translate(regexp_replace(regexp_replace(s, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM x WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
y AS (SELECT x.*, least IS NOT NULL AND doc_id > least AS gone FROM x LEFT JOIN f USING (k)),
z AS (SELECT doc_id, p, gone, p - row_number() OVER (PARTITION BY doc_id, gone ORDER BY p) AS run FROM y),
r AS (SELECT doc_id, gone, min(p) AS place, count(*) AS n FROM z GROUP BY doc_id, gone, run),
b AS (SELECT doc_id, CASE WHEN bool_or(gone AND place = 1) THEN '0,' ELSE '' END || string_agg(n, ',' ORDER BY place) AS keep_bitmap FROM r GROUP BY doc_id)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, any_value(keep_bitmap) AS keep_bitmap,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM y JOIN b USING (doc_id) GROUP BY doc_id
"""
