"""Substring dedup by level-wise doubling: windows of words that also start in an earlier document are removed.

A window of ``length`` words is stood for by a shorter one inside it. At the first level that is the least hashed of its
``base``-word windows; only those that are repeated across documents survive, and are extended to twice their length (the
least hashed window of that length that holds the survivor and lies in the long window), until the full length is reached
or no candidate survives. Equal long windows choose equal shorter ones, so none is lost, and each level looks at fewer
places. Lower levels compare 64-bit hashes, as they only narrow the search; the last one adds 32 bits of an
independent hash (at 10**13 windows, a false match anywhere is expected with less than one in a thousand).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.mixing import same
from bidlens.llm.suffix import NO_ID, sliding_min
from bidlens.llm.tables import stage, unstage
from bidlens.llm.wordhash import chunks, mix, stretch_hashes, text_bytes, word_bounds

LENGTH, BASE = 13, 4
PIECE = 1 << 20  # windows looked at together
TAG = 24  # bits of a text's hash that tell rows of one id apart
RUN = 40  # a run of places in one number: its length above this bit, its first position below
MOST = 1 << 22  # places of a run
ASK, TELL = 0, -1  # kinds of rows: to be compared; survives already and tells others; a run of n places that survive is n
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = (np.arange(256) * 167 + 13).astype(np.uint8)  # each byte changed to another one


def levels(base: int, length: int) -> list[int]:
    """Window lengths: ``base`` (at most ``length``), then twice as long each time, the last one cut to ``length``."""
    out = [min(base, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def longer(hashes: np.ndarray, size: int, to: int) -> np.ndarray:
    """Hashes of the windows of ``to`` words from those of ``size`` words (at least half as long): two of them each."""
    n = len(hashes) - (to - size)
    return mix(hashes[: max(n, 0)] * _ODD + mix(hashes[to - size:] ^ np.uint64(to)))


def hashes_at(words: np.ndarray, size: int) -> np.ndarray:
    at, got = 1, words
    while at < size:
        to = min(2 * at, size)
        got, at = longer(got, at, to), to
    return got


def second_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A further hash of each word: ``stretch_hashes`` with other letter values."""
    return stretch_hashes(_OTHER[buf], starts, ends)


def representatives(names: dict[int, np.ndarray], sizes: list[int], length: int, n: int) -> list[np.ndarray]:
    """For the windows of ``length`` words that start at 0 to n - 1: where the window that stands for each starts, by level."""
    bits = np.uint64((1 << 21) - 1)
    base = sizes[0]
    at = np.arange(n)
    keys = (names[base][: n + length - base] & ~bits) | np.arange(n + length - base, dtype=np.uint64)
    out = [(sliding_min(keys, length - base + 1) & bits).astype(np.int64) if base < length else at]
    for size, to in zip(sizes, sizes[1:]):
        held, best, where = out[-1], np.zeros(n, np.uint64), np.full(n, -1)
        for k in range(length - to + 1):
            start, key = at + k, names[to][k: k + n]
            better = (start <= held) & (start + to >= held + size) & ((where < 0) | (key < best))
            best, where = np.where(better, key, best), np.where(better, start, where)
        out.append(where)
    return out


def pack(pos: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return (pos << TAG) | tag


def row_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, word boundaries of the rows, bytes, start and end of every word."""
    raw, offs = text_bytes(column)
    for i, j in chunks(offs):
        own = offs[i: j + 1] - offs[i]
        buf = raw[offs[i]: offs[j]]
        s, e = word_bounds(buf, own)
        yield i, np.searchsorted(s, own), buf, s, e


def candidates(sizes: list[int], level: int, length: int):
    """Windows of a level that stand for long windows whose shorter ones have survived, as rows to be compared."""
    last = level == len(sizes) - 1

    def of_rows(batch: pa.RecordBatch):
        ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
        found = batch.column("found") if level else None
        for i, cut, buf, s, e in row_words(batch.column("text")):
            if len(s) < length:
                continue
            doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            alive = np.ones(len(s), dtype=bool)
            if level:
                part = found.slice(i, len(cut) - 1)
                start, n = unrun(part.flatten().to_numpy())
                start = start + np.repeat(cut[:-1], np.diff(part.offsets.to_numpy()))
                alive = covered(start, start + n, len(s))
                if not alive.any():
                    continue
            words = stretch_hashes(buf, s, e)
            extra = second_hashes(buf, s, e) if last else words
            for a in range(0, len(s) - length + 1, PIECE):
                h = words[a: a + PIECE + length - 1]
                n = len(h) - length + 1
                names, at = {}, hashes_at(h, sizes[0])
                names[sizes[0]] = at
                for size, to in zip(sizes[:level], sizes[1: level + 1]):
                    names[to] = longer(names[size], size, to)
                where = representatives(names, sizes[: level + 1], length, n)
                whole = doc[a: a + n] == doc[a + length - 1: a + n + length - 1]
                if level:
                    whole &= alive[a + where[level - 1]]
                spot = np.unique(where[level][whole])
                key = names[sizes[level]][spot].view(np.int64)
                digest = np.zeros(len(spot), np.int32)
                if last:
                    digest = (hashes_at(extra[a: a + PIECE + length - 1], length)[spot] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                row = doc[a + spot]
                yield key, digest, ids[i + row], pack(a + spot - cut[row], tags[i + row])

    def batches(source):
        for batch in source:
            parts = list(of_rows(batch))
            if not parts:
                continue
            key, digest, ids, pos = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((pos, ids, digest, key))
            key, digest, ids, pos = (c[order] for c in (key, digest, ids, pos))
            first = starts_of(key, digest)
            group = np.cumsum(first) - 1
            low = ids[first][group]
            if last:  # later than another one here: removed, whatever other tasks hold
                kind = np.where(ids > low, 1, ASK)
            else:
                ends = np.append(np.flatnonzero(first)[1:], len(ids)) - 1
                repeated = (ids[ends] != ids[first])[group]
                kind = np.where(repeated, np.where(first, TELL, 1), ASK)
            sure = kind > 0
            yield _rows(kind[~sure], key[~sure], digest[~sure], ids[~sure], pos[~sure])
            if sure.any():  # these only pass through: as runs, in the order of their texts, keyed by text
                own, at, n = runs(ids[sure], pos[sure])
                spread = mix(own.astype(np.uint64) ^ mix((at & ((1 << TAG) - 1)).astype(np.uint64))).view(np.int64)
                yield _rows(n, spread, np.zeros(len(at), np.int32), own, at)

    return batches


def _rows(kind, key, digest, ids, pos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind.astype(np.int32)), pa.array(key), pa.array(digest), pa.array(ids), pa.array(pos)], names=["kind", "key", "digest", "id", "pos"])


def runs(ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places as (id, first place, number) of runs of neighbouring ones of one text."""
    order = np.lexsort((pos, pos & ((1 << TAG) - 1), ids))
    ids, pos = ids[order], pos[order]
    first = starts_of(ids, pos - (np.arange(len(pos)) << TAG))
    heads = np.flatnonzero(first)
    n = np.diff(np.append(heads, len(pos)))
    pieces = -(-n // MOST)
    start = np.repeat(pos[heads], pieces)
    nth = np.arange(len(start)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(ids[heads], pieces), start + ((nth * MOST) << TAG), np.minimum(np.repeat(n, pieces) - nth * MOST, MOST)


def unrun(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return found & ((1 << RUN) - 1), found >> RUN


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the intervals."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def starts_of(*keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _places(ids, pos, n=None) -> pa.RecordBatch:
    n = np.ones(len(ids), np.int64) if n is None else n
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos), pa.array(n)], names=["id", "pos", "n"])


def survivors(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the windows that occur in two documents. Reads rows sorted by key and id as a stream; between batches it
    holds the places of one key in one document only, and none at all for rows without id, which nothing comes after."""
    held = None  # key, id, places of a group that has one document so far
    known = None  # key of a group that is known to be repeated
    for batch in source:
        kind, key, ids, pos = (batch.column(c).to_numpy() for c in ("kind", "key", "id", "pos"))
        sure = kind > 0
        if sure.any():
            yield _places(ids[sure], pos[sure], kind[sure].astype(np.int64))
            kind, key, ids, pos = (c[~sure] for c in (kind, key, ids, pos))
        if not len(key):
            continue
        first = starts_of(key)
        heads = np.flatnonzero(first)
        ends = np.append(heads[1:], len(key))
        group = np.cumsum(first) - 1
        repeated = (ids[ends - 1] != ids[heads]) | np.maximum.reduceat(kind == TELL, heads)
        if held is not None:
            if held[0] != key[0]:
                held = None
            elif repeated[0] or held[1] != ids[0]:
                yield _places(np.full(len(held[2]), held[1]), held[2])
                repeated[0], held = True, None
        if known is not None and known == key[0]:
            repeated[0] = True
        out = repeated[group]
        if out.any():
            yield _places(ids[out], pos[out])
        known = key[-1] if repeated[-1] else None
        if known is None and ids[-1] != NO_ID:
            mine = pos[heads[-1]:]
            held = (key[-1], ids[-1], np.concatenate((held[2], mine)) if held is not None and len(heads) == 1 else mine)
        else:
            held = None


def later_ones(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the windows that also start in a document with a smaller id; rows come sorted by key, digest and id."""
    last = None  # key, digest and smallest id of the last group
    for batch in source:
        kind, key, digest, ids, pos = (batch.column(c).to_numpy() for c in ("kind", "key", "digest", "id", "pos"))
        sure = kind > 0
        if sure.any():
            yield _places(ids[sure], pos[sure], kind[sure].astype(np.int64))
            key, digest, ids, pos = (c[~sure] for c in (key, digest, ids, pos))
        if not len(key):
            continue
        first = starts_of(key, digest)
        low = ids[first]
        if last is not None and last[:2] == (key[0], digest[0]):
            low[0] = last[2]
        later = ids > low[np.cumsum(first) - 1]
        last = (key[-1], digest[-1], low[-1])
        if later.any():
            yield _places(ids[later], pos[later])


def kept_words(length: int):
    """Counts, kept words and removed runs of each row, from the starts of its windows that are to go."""

    def batches(source):
        for batch in source:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("found")):
                words = (text.as_py() or "").encode().split()  # splits at space and U+0009 to U+000D
                start, n = unrun(found.values.to_numpy() if found.is_valid else np.empty(0, np.int64))
                gone = covered(start, start + n - 1 + length, len(words))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))) if len(words) else np.empty(0, np.int64)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode() if n_removed[-1] else b" ".join(words).decode())
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return batches


def with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` with ``found``: the runs of their places (word positions); null where there is none."""
    run = F.shiftleft("n", RUN).bitwiseOR(F.shiftright("pos", TAG))
    by_row = places.select("id", run.alias("at"), F.col("pos").bitwiseAND((1 << TAG) - 1).alias("tag")).groupBy("id", "tag").agg(
        F.collect_set("at").alias("found")).select(F.col("id").alias("_i"), F.col("tag").alias("_t"), "found")
    return rows.join(by_row, same(("id", "_i"), ("tag", "_t")), "left").drop("_i", "_t")


def remove_windows(docs: DataFrame, length: int = LENGTH, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and spans (removed runs of words).

    Words are runs of characters other than space and U+0009 to U+000D, unchanged. A word is removed if a window of
    ``length`` words that covers it has the same words as one that starts in a document with a smaller doc_id. Windows are
    judged on the input. Null texts count as empty; texts of fewer words have no window. Rows without id come after all
    others and not after each other; rows of one id do not remove each other's words, and each is judged on its own text.
    Repeated rows all stay and agree; empty tables give no rows; further columns are ignored.

    No window's documents ever meet in one group: tasks first compare their own windows, a window is sent on at most once
    per task at the last level, and groups of equal hashes are read as a sorted stream.
    """
    sizes = levels(base, length)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64("text").bitwiseAND((1 << TAG) - 1).alias("tag"), "text")
    places = None
    for level in range(len(sizes)):
        last = level == len(sizes) - 1
        looked = rows if places is None else with_places(rows, places).where(F.col("found").isNotNull())
        asked = looked.mapInArrow(candidates(sizes, level, length), "kind int, key long, digest int, id long, pos long")
        dealt = asked.repartition("key").sortWithinPartitions("key", "digest", "id")
        before, places = places, stage(dealt.mapInArrow(later_ones if last else survivors, "id long, pos long, n long"), f"windows{sizes[level]}")
        if before is not None:
            unstage(before)
        if not last and places.isEmpty():
            break
    return with_places(rows, places).select("doc_id", "text", "found").mapInArrow(
        kept_words(length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
    )
