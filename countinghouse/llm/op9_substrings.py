"""Substring dedup: Rabin-Karp hashes of every 13-word window, counted in Spark.

A word goes if a window over it also starts in a document with a smaller
doc_id. Windows are judged on the input.

1. Each task hashes every window of its documents twice, with independent bases,
   in blocks of about a million windows. Within a block a window's smallest
   document is known, so the other documents' removals are settled there, by
   both hashes, and merge into intervals; only one (fingerprint, smallest
   document) per window and block is dealt on. A passage held by a third of all
   documents thus costs a row a block, not a row a document.
2. Fingerprints, the top bits of the first hash (as many as number the windows
   thousands of times over), are dealt by their own top bits, packed into sorted, delta coded arrays, to buckets of bounded
   size. Where documents share one, the bucket answers: all but the smallest are
   to remove such windows, if the second hash bears it out.
3. The answers are dealt by groups of documents, packed likewise, and a group
   tells each of its documents in one row what to remove.
4. Each document meets its row by doc_id. Documents that share fingerprints send
   the second hashes of those windows to the fingerprints' buckets, where the few
   windows that share a fingerprint but not the second hash are found; only
   these exceptions are sent back.
5. Windows that remain to be removed merge with the intervals of step 1 into
   maximal removal intervals.

Buckets, groups, partitions and fingerprints grow with the size of the input.
Packed rows are at most tasks times buckets, and never more than the windows in
them. A session with many partitions gets no more buckets than have a fair number
of windows, which bounds the rows of an input whatever the partitions. Where tasks
grow with the input, as buckets do, packed rows grow faster than it, up to one a
window.
Windows are taken for equal if a fingerprint of log2(n) + 13 bits and a second
hash of 64 agree: n distinct windows give about n / 2**78 pairs that do so by
accident, 5e-16 for the 1.4e8 windows of 0.5 GB and 5e-11 for the 1.6e13 of
100 TB. Of the windows one in 8,000 shares a fingerprint with another by
accident, and is told apart.

Defined results: a null or empty text has no words; a document without an id
neither holds nor loses a passage; rows that repeat a doc_id are one document's
parts (a window in two of them isn't removed, and each part loses what smaller
documents hold); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, table
from .words import Hasher, mix, run_starts, spaced_table, text_chunks, word_spans

WINDOW = 13
BLOCK_WINDOWS = 1 << 20
#: Bits of a fingerprint beyond those that number the windows, and the least and the most bits it has.
SPARE_BITS, LEAST_BITS, MOST_BITS = 13, 32, 56
#: Windows that a bucket gets on average, at most, and at least where there are more partitions than the input needs.
BUCKET_WINDOWS, LEAST_WINDOWS = 1 << 19, 1 << 15
#: Characters of text a partition has, about, where the session has fewer partitions.
PARTITION_CHARS = 16_000_000
_PAIRS = "bucket int, doc_id long, version long, hashes binary, docs binary"


def pack(values: np.ndarray) -> bytes:
    """The bytes of 8-byte numbers plane by plane (all first bytes, all second bytes ...), compressed: what the numbers share costs little."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes, n: int, kind) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(blob, decompressed_size=8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """n as 4 bytes, then the packed differences of sorted unsigned numbers."""
    return len(values).to_bytes(4, "little") + pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob[4:], int.from_bytes(blob[:4], "little"), np.uint64), dtype=np.uint64)


def merged(starts: np.ndarray, ends: np.ndarray):
    """Maximal intervals that sorted, perhaps overlapping intervals cover."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


class _Prints:
    """Fingerprints of so many bits and the buckets, 2**bits of them, in which they meet."""

    def __init__(self, size: int, bits: int):
        self.size, self.bits = size, min(bits, size)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.size)

    def bucket(self, prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(self.size - self.bits)).astype(np.int64)


class _Block:
    """Windows of some documents, and what they say once the block is full."""

    def __init__(self, width: int, prints: _Prints):
        self.width, self.prints = width, prints
        self.clear()

    def clear(self):
        self.hash, self.check, self.doc, self.row, self.at, self.ids, self.versions, self.size = [], [], [], [], [], [], [], 0

    def add(self, hashes, checks, rows, at, ids, versions):
        base = sum(map(len, self.ids))
        self.hash.append(hashes)
        self.check.append(checks)
        self.doc.append(ids[rows])
        self.row.append(rows + base)
        self.at.append(at)
        self.ids.append(ids)
        self.versions.append(versions)
        self.size += len(hashes)

    def flush(self):
        if not self.size:
            self.clear()
            return
        h, c, doc, row, at = (np.concatenate(x) for x in (self.hash, self.check, self.doc, self.row, self.at))
        ids, versions = np.concatenate(self.ids), np.concatenate(self.versions)
        if (doc[1:] < doc[:-1]).any():
            order = np.argsort(doc, kind="stable")
            h, c, doc, row, at = h[order], c[order], doc[order], row[order], at[order]
        order = np.argsort(h, kind="stable")
        if ((h[order][1:] == h[order][:-1]) & (c[order][1:] != c[order][:-1])).any():
            order = np.lexsort((c, h))
        h, c, doc = h[order], c[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        least = doc[new][np.cumsum(new) - 1]
        out = []
        again = order[doc > least]
        row, at = row[again], at[again]
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        edges = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
        for a, b in zip(edges, np.append(edges[1:], len(row))):
            s, e = merged(at[a:b], at[a:b] + self.width)
            r = row[a]
            out.append((int(_group(ids[r : r + 1], self.prints.bits)[0]), int(ids[r]), int(versions[r]), None, np.concatenate([s, e]).astype(np.int32).tobytes()))
        prints, doc = self.prints.of(h[new]), doc[new]
        bucket = self.prints.bucket(prints)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(prints))):
            out.append((int(bucket[a]), None, None, pack_sorted(prints[a:b]), pack(doc[a:b])))
        self.clear()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "doc_id", "version", "hashes", "docs"])


class _Windows:
    """The windows of the texts of a column, chunk by chunk, with their first hashes; the second ones are made when asked for."""

    def __init__(self, width: int):
        self.width, self.first, self.second, self.table = width, Hasher(), Hasher(1), spaced_table()

    def chunks(self, column):
        for lo, hi, data, offsets in text_chunks(column):
            starts, ends, bounds = word_spans(data, offsets, self.table)
            first, last, docs = run_starts(bounds, self.width, short=False)
            hashes = self.first.of_runs(self.first.of_words(data, starts, ends), first, last)
            checks = lambda: self.second.of_runs(self.second.of_words(data, starts, ends), first, last)  # noqa: B023, E731
            yield lo, hi, data, offsets, bounds, hashes, checks, docs, first


def _pairs(width: int, prints: _Prints):
    def run(batches):
        windows, block = _Windows(width), _Block(width, prints)
        for batch in batches:
            ids, versions = batch["doc_id"].to_numpy(zero_copy_only=False), batch["version"].to_numpy(zero_copy_only=False)
            for lo, hi, _, _, bounds, hashes, checks, docs, first in windows.chunks(batch["text"]):
                block.add(hashes, checks(), docs, first - bounds[docs], ids[lo:hi], versions[lo:hi])
                if block.size >= BLOCK_WINDOWS:
                    yield from block.flush()
        yield from block.flush()

    return run


def _group(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)


def _answers(group_bits: int):
    """From the pairs by bucket, rows by group of documents: packed (documents, fingerprints they share), and intervals passed on."""
    names, kinds = ["bucket", "doc_id", "version", "hashes", "docs"], (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches):
        now, hashes, docs, out_doc, out_hash, size = None, [], [], [], [], 0

        def settle():
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.append(True, h[1:] != h[:-1])
            run = np.cumsum(new) - 1
            later = d > d[new][run]
            leads = new & np.bincount(run, weights=later).astype(bool)[run]
            later[1:] &= ~((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
            # The last bit of an answer is 1 for the document that keeps its windows.
            for said, bit in ((later, 0), (leads, 1)):
                out_doc.append(d[said])
                out_hash.append((h[said] << np.uint64(1)) | np.uint64(bit))
            hashes.clear()
            docs.clear()
            return int(later.sum() + leads.sum())

        def answer():
            d, h = np.concatenate(out_doc), np.concatenate(out_hash)
            out_doc.clear()
            out_hash.clear()
            group = _group(d, group_bits)
            order = np.lexsort((h, group))
            group, d, h = group[order], d[order], h[order]
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            both = list(zip(edges, np.append(edges[1:], len(d))))
            none = pa.nulls(len(edges), pa.int64())
            blobs = [pa.array(x, pa.binary()) for x in ([pack_sorted(h[a:b]) for a, b in both], [pack(d[a:b]) for a, b in both])]
            return pa.RecordBatch.from_arrays([pa.array(group[edges]), none, none, *blobs], names)

        for batch in batches:
            passed = batch.filter(pa.array(np.logical_not(batch["doc_id"].is_null().to_numpy(zero_copy_only=False))))
            if len(passed):
                group = _group(passed["doc_id"].to_numpy(), group_bits)
                yield pa.RecordBatch.from_arrays([pa.array(group), passed["doc_id"], passed["version"], pa.nulls(len(passed), kinds[3]), passed["docs"]], names)
            for bucket, h, d in zip(batch["bucket"].to_pylist(), batch["hashes"].to_pylist(), batch["docs"].to_pylist()):
                if h is None:
                    continue
                if bucket != now and hashes:
                    size += settle()
                    if size >= BLOCK_WINDOWS:
                        yield answer()
                        size = 0
                now = bucket
                hashes.append(unpack_sorted(h))
                docs.append(unpack(d, len(hashes[-1]), np.int64))
        if hashes:
            size += settle()
        if size:
            yield answer()

    return run


def _by_document(batches):
    """From the answers by group: a row a document with all that it is to remove."""
    now, hashes, docs, spans = None, [], [], {}

    def settle():
        found = {d: [{"version": v, "hashes": None, "spans": s} for v, s in x] for d, x in spans.items()}
        if hashes:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            edges = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(d))):
                found.setdefault(int(d[a]), []).append({"version": None, "hashes": pack_sorted(h[a:b]), "spans": None})
        hashes.clear()
        docs.clear()
        spans.clear()
        kind = pa.list_(pa.struct([("version", pa.int64()), ("hashes", pa.binary()), ("spans", pa.binary())]))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), kind)], ["found_id", "found"])

    for batch in batches:
        for group, doc, version, h, d in zip(*(batch[c].to_pylist() for c in ("bucket", "doc_id", "version", "hashes", "docs"))):
            if group != now and (hashes or spans):
                yield settle()
            now = group
            if h is None:
                spans.setdefault(doc, set()).add((version, d))
            else:
                hashes.append(unpack_sorted(h))
                docs.append(unpack(d, len(hashes[-1]), np.int64))
    if hashes or spans:
        yield settle()


def _shared(found) -> np.ndarray:
    """The answers among what was found for a document, sorted."""
    blobs = [unpack_sorted(x["hashes"]) for x in found or () if x["hashes"] is not None]
    return np.concatenate(blobs) if blobs else np.zeros(0, np.uint64)


_CHECKS = "bucket int, hashes binary, docs binary, checks binary"


def _checks(width: int, prints: _Prints):
    """From documents and what was found for them, rows by bucket: packed (fingerprints, documents, second hashes) of their shared windows.

    Of windows with both hashes in common a block hands on the smallest document only: the others lose theirs either way.
    """

    def run(batches):
        windows, held, size = _Windows(width), [], 0

        def out():
            f, d, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((d, c, f))
            f, d, c = f[order], d[order], c[order]
            new = np.append(True, (f[1:] != f[:-1]) | (c[1:] != c[:-1]))
            f, d, c = f[new], d[new], c[new]
            bucket = prints.bucket(f)
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            both = list(zip(edges, np.append(edges[1:], len(f))))
            blobs = [pa.array(x, pa.binary()) for x in ([pack_sorted(f[a:b]) for a, b in both], [pack(d[a:b]) for a, b in both], [c[a:b].tobytes() for a, b in both])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int32()), *blobs], ["bucket", "hashes", "docs", "checks"])

        for batch in batches:
            found, ids = batch["found"].to_pylist(), batch["doc_id"].to_pylist()
            for lo, hi, _, _, _, hashes, checks, docs, _ in windows.chunks(batch["text"]):
                edge, c = np.searchsorted(docs, np.arange(hi - lo + 1)), None
                for d in range(hi - lo):
                    shared = _shared(found[lo + d])
                    if not len(shared):
                        continue
                    f = prints.of(hashes[edge[d] : edge[d + 1]])
                    at = np.flatnonzero(np.isin(f, shared >> np.uint64(1)))
                    if len(at):
                        c = checks() if c is None else c
                        held.append((f[at], np.full(len(at), ids[lo + d], np.int64), c[edge[d] + at]))
                        size += len(at)
                if size >= BLOCK_WINDOWS:
                    yield out()
                    size = 0
        if held:
            yield out()

    return run


def _exceptions(batches):
    """From the rows of _checks by bucket: (keep_id, hash, check) of windows that share a fingerprint with a smaller document, but not the second hash."""
    now, held = None, []

    def settle():
        f, d, c = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((d, c, f))
        f, d, c = f[order], d[order], c[order]
        new_f = np.append(True, f[1:] != f[:-1])
        run = np.cumsum(new_f) - 1
        new = new_f | np.append(True, c[1:] != c[:-1])
        least = np.minimum.reduceat(d, np.flatnonzero(new_f))[run]
        # The smallest document of a second hash, where another one with the fingerprint is smaller still.
        kept = new & (d > least)
        kinds = (d[kept], f[kept].view(np.int64), c[kept].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kinds], ["keep_id", "hash", "check"])

    for batch in batches:
        for bucket, h, d, c in zip(*(batch[n].to_pylist() for n in ("bucket", "hashes", "docs", "checks"))):
            if bucket != now and held:
                yield settle()
            now = bucket
            f = unpack_sorted(h)
            held.append((f, unpack(d, len(f), np.int64), np.frombuffer(c, np.uint64)))
    if held:
        yield settle()


def _kept(width: int, prints: _Prints):
    def run(batches):
        windows = _Windows(width)
        for batch in batches:
            found, versions, keep, ids = batch["found"].to_pylist(), batch["version"].to_pylist(), batch["keep"].to_pylist(), batch["doc_id"]
            for lo, hi, data, offsets, bounds, hashes, checks, docs, _ in windows.chunks(batch["text"]):
                edge, second = np.searchsorted(docs, np.arange(hi - lo + 1)), None
                n_words, n_removed, spans, texts = np.diff(bounds), [], [], []
                for d in range(hi - lo):
                    words = data[offsets[d] : offsets[d + 1]].tobytes().split()
                    starts = ends = np.zeros(0, np.int64)
                    if found[lo + d]:
                        shared = _shared(found[lo + d])
                        remove = shared[shared & np.uint64(1) == 0] >> np.uint64(1)
                        if len(remove):
                            f = prints.of(hashes[edge[d] : edge[d + 1]])
                            gone = np.isin(f, remove)
                            if keep[lo + d]:
                                second = checks() if second is None else second
                                c, pairs = second[edge[d] : edge[d + 1]], {(x["hash"], x["check"]) for x in keep[lo + d]}
                                for i in np.flatnonzero(gone).tolist():
                                    gone[i] = (int(f[i]), int(c[i : i + 1].view(np.int64)[0])) not in pairs
                            starts = np.flatnonzero(gone)
                            ends = starts + width
                        for x in found[lo + d]:
                            if x["spans"] is not None and x["version"] == versions[lo + d]:
                                s, e = np.frombuffer(x["spans"], np.int32).reshape(2, -1)
                                starts, ends = np.append(starts, s), np.append(ends, e)
                        order = np.argsort(starts, kind="stable")
                        starts, ends = merged(starts[order], ends[order])
                        kept, at = [], 0
                        for s, e in zip(starts.tolist(), ends.tolist()):
                            kept += words[at:s]
                            at = e
                        words = kept + words[at:]
                    n_removed.append(int((ends - starts).sum()))
                    spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
                    texts.append(b" ".join(words))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [ids[lo:hi], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return run


def _chars(docs: DataFrame, rows: DataFrame) -> int:
    """About how many characters of text there are: the size of the files where Spark knows it, else counted."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else rows.agg(F.sum(F.length("text"))).first()[0] or 0


def _bucket_bits(n: int, windows: float) -> int:
    """Bits that number the buckets: two for each of n partitions if so many get enough windows, more where one would hold too much."""
    return min(30, max(4, math.ceil(math.log2(max(1, windows / BUCKET_WINDOWS, min(2 * n, windows / LEAST_WINDOWS))))))


def repeated_passages(docs: DataFrame, width: int = WINDOW, print_bits: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, removed (maximal intervals of word numbers, end excluded) and kept_text (kept words joined by a space).

    print_bits: bits of a fingerprint; by the size of the input if not given. Results don't depend on it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    size = _chars(docs, rows)
    n = max(partitions(docs.sparkSession), size // PARTITION_CHARS)
    if print_bits is None:
        print_bits = min(MOST_BITS, max(LEAST_BITS, SPARE_BITS + math.ceil(math.log2(max(1, size / 4)))))
    prints = _Prints(print_bits, _bucket_bits(n, size / 4))

    def dealt(df):
        return df.repartition(n, "bucket").sortWithinPartitions("bucket")

    pairs = rows.where(F.col("doc_id").isNotNull()).mapInArrow(_pairs(width, prints), _PAIRS)
    answers = dealt(dealt(pairs).mapInArrow(_answers(prints.bits), _PAIRS))
    found = answers.mapInArrow(_by_document, "found_id long, found array<struct<version:long,hashes:binary,spans:binary>>")
    # Read twice, all rows and columns both times: so Spark moves the texts and what was found once and reuses the exchanges.
    joined = rows.join(found, rows["doc_id"] == found["found_id"], "left").drop("found_id")
    checks = dealt(joined.mapInArrow(_checks(width, prints), _CHECKS))
    odd = checks.mapInArrow(_exceptions, "keep_id long, hash long, check long")
    keep = odd.groupBy("keep_id").agg(F.collect_list(F.struct("hash", "check")).alias("keep"))
    last = joined.join(keep, joined["doc_id"] == keep["keep_id"], "left").drop("keep_id")
    return last.mapInArrow(_kept(width, prints), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
lead AS (SELECT phrase, min(doc_id) AS least FROM win GROUP BY phrase HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN lead USING (phrase) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(w) AS s, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(s, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
