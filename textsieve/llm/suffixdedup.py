"""Removal of long repeated byte strings by distributed prefix doubling over sampled positions.

Positions are ranked by growing strings around them; a rank is a 128-bit hash of the string. In each step Spark brings
the positions with equal ranks together and drops those whose rank is unique; the others are paired with the next,
longer strings, until a repeated string is as long as the threshold or all ranks are unique.

Not every position is ranked. Each window of `length` bytes elects the position whose string of K = length - W + 1
bytes hashes lowest among its W = 256 first ones (leftmost if equal). Equal windows elect positions at equal offsets, so
only elected positions (about 2 of 257) need ranks, at the W offsets d at which a window may begin before them:

- step 0 ranks an elected position by its K bytes, which all windows that elect it share; unique ranks are dropped.
  The string from W - 1 bytes before to `length` bytes after it holds all W windows: if that repeats, all do, and one of
  the positions that share it stays as a witness for others.
- step s splits the offsets left in doubt into cells of 32, then 4, then 1: all windows of a cell share a string (longer
  in each step: if it is unique, none of them repeats) and lie in another (if that repeats, all of them do).

In the last step both are the window itself. No step needs the rows of one rank in one task: they are counted with
partial sums and joined back on plain exchanges, which Spark splits where hot. Bytes of repeated windows are removed.

Beside what is removed, `n_passages` counts strings of half of `passage` words (26 of 51) that a text elects and shares with
another text. It is above 0 for every text that shares a passage of `passage` words, which may be shorter than `length`
bytes and then stays, and for some that share fewer words, from that half on (see `shared_passages`).

Strings are compared by hashes of 128 bits. Defined cases: a null text is empty; texts shorter than the threshold
repeat nothing; repeated rows are documents of their own, so each makes the other's strings repeat; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.bytehash import BLOCK, NOT_SPACE, mix, prefix, raw, slices, substring, word_hashes
from textsieve.llm.common import Workspace, split_by_keys, texts

W = 256
CELLS = (32, 4, 1)
BATCH_BYTES = 8 << 20
_INDEX = np.uint64((1 << 24) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def elected(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Elected positions of a block of bytes, with their K-byte hashes. ends: for each byte the end of its document."""
    n, k = len(b), length - W + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    s = prefix(b)
    i = np.arange(n - k + 1)
    h = mix(substring(s, i, i + k))
    key = (h & ~_INDEX) | i.astype(np.uint64)
    low = key
    step = 1
    while step < W:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    starts = np.arange(len(low))
    ok = starts + length <= ends[: len(low)]
    at = (low[ok] & _INDEX).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return at, h[at]


def _positions(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1, BATCH_BYTES)):
            data, offsets = raw(batch.column(1))
            rids = batch.column(0).to_numpy()
            lo = 0
            while lo < batch.num_rows:  # documents together up to a block; a longer one in overlapping blocks
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
                begin, end = int(offsets[lo]), int(offsets[hi])
                seen, at = -1, begin
                while at < end:
                    stop = min(at + 4 * BLOCK, end)
                    sizes = np.diff(np.clip(offsets[lo : hi + 1], at, stop))
                    ends = np.repeat(np.minimum(offsets[lo + 1 : hi + 1], stop) - at, sizes)
                    p, h = elected(data[at:stop], ends, length)
                    p = p + at
                    h, p = h[p > seen], p[p > seen]
                    if len(p):
                        seen = int(p[-1])
                        d = np.searchsorted(offsets, p, "right") - 1
                        yield _rows(data, offsets, rids, p, h, d, length)
                    at = stop - length + 1 if stop < end else end
                lo = hi
    return run


def _rows(data: np.ndarray, offsets: np.ndarray, rids: np.ndarray, p: np.ndarray, h: np.ndarray, d: np.ndarray, length: int) -> pa.RecordBatch:
    view = memoryview(data)
    hull = [xxhash.xxh3_128_digest(view[a:z]) if a >= lo and z <= hi else None for a, z, lo, hi in zip((p - W + 1).tolist(), (p + length).tolist(), offsets[d].tolist(), offsets[d + 1].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(rids[d]), pa.array(p - offsets[d]), pa.array(h.view(np.int64)), pa.array(hull, pa.binary())], ["rid", "pos", "rank", "hull"])


def _cells(width: int, length: int):
    """For each position in doubt and each cell of its open offsets: hashes of the shared and of the whole string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for rid, pos, frm, text, cells, wide in zip(*(batch.column(c).to_pylist() for c in ("rid", "pos", "from", "bytes", "cells", "wide")), strict=True):
                a = pos - frm  # the position within the bytes at hand
                for c in cells:
                    for lo in range(c, c + wide, width):
                        hi = lo + width - 1  # offsets lo to hi
                        s, e = a - lo, a - hi + length  # what all its windows share
                        if s < 0 or e > len(text):
                            continue
                        x, y = a - hi, a - lo + length
                        tag = lo.to_bytes(2, "little")
                        out[0].append(rid)
                        out[1].append(pos)
                        out[2].append(lo)
                        out[3].append(xxhash.xxh3_128_digest(tag + text[s:e]))
                        out[4].append(xxhash.xxh3_128_digest(tag + text[x:y]) if x >= 0 and y <= len(text) else None)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["rid", "pos", "cell", "rank", "hull"])

    return run


def _repeated(df: DataFrame, column: str) -> DataFrame:
    """The values of a column that occur twice or more, with partial counts."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(column)


def repeated_spans(docs: DataFrame, work: Workspace, length: int) -> DataFrame:
    """(rid, start, end) of byte spans made of repeated windows, for docs (rid, text)."""
    ranked = work.write(docs.mapInArrow(_positions(length), "rid long, pos long, rank long, hull binary"), "rank0")
    spans = None
    known = None
    wide = W
    for step, width in enumerate((W, *CELLS)):
        shared = work.write(_repeated(ranked, "rank"), f"shared{step}")
        ranked = work.write(ranked.join(shared, "rank", "left_semi"), f"kept{step}")
        cell = F.col("cell") if step else F.lit(0)
        placed = ranked.select("rid", "pos", cell.cast("int").alias("cell"), "rank", "hull")
        groups = placed.where("hull is not null").groupBy("hull", "rank").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("rid", "pos", "cell")).alias("one"))
        whole = work.write(groups.where("_n > 1").select("hull", "rank", "one"), f"whole{step}")
        full = placed.join(whole.select("hull"), "hull", "left_semi").select("rid", (F.col("pos") - F.col("cell") - (width - 1)).alias("start"), (F.col("pos") - F.col("cell") + length).alias("end"))
        full = work.write(full, f"spans{step}")
        spans = full if spans is None else spans.union(full)
        if width == 1:
            break
        doubt = work.write(placed.join(whole.select("hull"), "hull", "left_anti").select("rid", "pos", "cell", "rank"), f"doubt{step}")
        # of positions that repeat as a whole one stays on, as it may be what a position in doubt repeats
        ranks = work.write(doubt.select("rank").distinct(), f"ranks{step}")
        witness = whole.join(ranks, "rank", "left_semi").select("one.*")
        doubt = doubt.select("rid", "pos", "cell").union(witness).groupBy("rid", "pos").agg(F.collect_list("cell").alias("cells"))  # W / width cells at most
        doubt = work.write(doubt, f"open{step}")
        if known is None:  # the bytes around a position in doubt, read from the texts once
            lists = work.write(doubt.groupBy("rid").agg(F.collect_list("pos").alias("at")), "lists")
            _, maybe = split_by_keys(docs, F.xxhash64("rid"), lists.select(F.xxhash64("rid").alias("k")))
            known = work.write(maybe.join(lists, "rid").mapInArrow(_around(length), "rid long, pos long, from long, bytes binary"), "around")
        doubt = known.join(doubt, ["rid", "pos"]).withColumn("wide", F.lit(wide))
        wide = CELLS[step]
        ranked = work.write(doubt.mapInArrow(_cells(wide, length), "rid long, pos long, cell int, rank binary, hull binary"), f"rank{step + 1}")
        work.drop(f"rank{step}", f"shared{step}", f"whole{step}", f"kept{step}", f"open{step}", f"doubt{step}", f"ranks{step}")
    return spans


def _passages(passage: int):
    """Elected strings of half a passage's words, with the text they lie in."""
    k = (passage + 1) // 2
    w = passage - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1, BATCH_BYTES)):
            data, offsets = raw(batch.column(1))
            h, owner = word_hashes(data, offsets, NOT_SPACE)
            n = len(h) - passage + 1
            if n <= 0:
                continue
            with np.errstate(over="ignore"):
                g = np.zeros(n + w - 1, np.uint64)
                for i in range(k):
                    g = g * _STEP + h[i : i + len(g)]
                g = mix(g)
            low = (g & ~_INDEX) | np.arange(len(g), dtype=np.uint64)
            step = 1
            while step < w:  # the lowest of w strings from each place on
                ahead = min(step, w - step)
                low = np.minimum(low[: len(low) - ahead], low[ahead:])
                step += ahead
            at = np.unique((low[:n][owner[:n] == owner[passage - 1 :]] & _INDEX).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at])), pa.array(g[at].view(np.int64))], ["rid", "h"])

    return run


def shared_passages(docs: DataFrame, work: Workspace, passage: int) -> DataFrame:
    """(rid, n_passages): how many elected strings of a text stand in another text too, without texts that have none.

    Each window of `passage` words elects one of its strings of half as many words, the one that hashes lowest, so every
    passage that two texts share has an elected string in both. Words are compared in lower case, by 64-bit hashes.
    """
    each = work.write(docs.mapInArrow(_passages(passage), "rid long, h long"), "passages")
    shared = each.groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("h")
    shared = work.write(shared, "shared_passages")  # written, so that the join reads plain exchanges, whose hot partitions Spark can split
    return each.join(shared, "h").groupBy("rid").agg(F.count(F.lit(1)).alias("n_passages"))


def _around(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", BATCH_BYTES)):
            out: list[list] = [[], [], [], []]
            size = 0
            for rid, text, at in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("at").to_pylist(), strict=True):
                b = text.as_buffer().to_pybytes() if text.is_valid else b""
                for pos in at:
                    frm = max(0, pos - W + 1)
                    part = b[frm : pos + length]
                    for column, x in zip(out, (rid, pos, frm, part), strict=True):
                        column.append(x)
                    size += len(part)
                    if size > 8 << 20:
                        yield _bytes_batch(out)
                        out, size = [[], [], [], []], 0
            yield _bytes_batch(out)

    return run


def _bytes_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["rid", "pos", "from", "bytes"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in slices(b, "text", BATCH_BYTES)):
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            b = text.as_buffer().to_pybytes() if text.is_valid else b""
            merged: list[list[int]] = []
            if spans.is_valid:
                flat = spans.values
                for s, e in sorted(zip(flat.field("start").to_pylist(), flat.field("end").to_pylist(), strict=True)):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
            at, kept = 0, []
            for s, e in merged:
                kept.append(b[at:s])
                at = e
            kept.append(b[at:])
            left = b"".join(kept)
            for column, x in zip(out, (len(b), sum(e - s for s, e in merged), [{"start": s, "end": e} for s, e in merged], left, hashlib.sha256(left).hexdigest()), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string())
        passages = pc.fill_null(batch.column("n_passages"), 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True)), passages], ["doc_id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256", "n_passages"])


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 51) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed spans, kept bytes, kept_sha256, n_passages) for every row of docs. length: W at least."""
    if length < W:
        raise ValueError(f"length must be {W} or more")
    work = Workspace(docs.sparkSession, "suffix")
    rows = texts(docs).withColumn("rid", F.monotonically_increasing_id())
    rows = work.write(rows, "rows")  # with an id per row that later steps can rely on
    spans = repeated_spans(rows.select("rid", "text"), work, length)
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = work.write(spans.join(shared_passages(rows.select("rid", "text"), work, passage), "rid", "full_outer"), "found")
    # only texts in which something was found are moved
    others, maybe = split_by_keys(rows, F.xxhash64("rid"), found.select(F.xxhash64("rid").alias("k")))
    none = others.select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), F.lit(None).cast("long").alias("n_passages"))
    out = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary, kept_sha256 string, n_passages long"
    return none.unionByName(maybe.join(found, "rid", "left").select("doc_id", "text", "spans", "n_passages")).mapInArrow(_cut, out)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", "n_passages")
