"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Seeds narrow the work down exactly. In every window of ``length`` bytes the smallest hashed SEED-gram is its anchor, so
equal windows have equal anchors at equal distance. The consecutive windows of one anchor form a region. Equal regions
are settled by their first occurrence alone; only regions that share an anchor's bytes but differ go on. They are cut
into blocks of bounded size, and within a block a Burrows-Wheeler transform is extended backwards, all intervals at once
and one letter per round, until the common prefixes reach ``length``: rows still together then start equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.mixing import same
from bidlens.llm.tables import stage
from bidlens.llm.wordhash import BYTES, chunks, mix, rolling, text_bytes, unshift

LENGTH = 100
SEED = 32
PIECE = 1 << 20  # window starts looked at together
BLOCK_BYTES = 1 << 20  # text of a block of regions
MOST_ROWS = 8192  # regions of one seed in a block; larger groups are split and merged by window digests
NO_ID = (1 << 63) - 1  # rows without id come last
MARK, OPEN = 0, 1


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    step, out = 1, v
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(v) - width + 1], out[width - step:][: len(v) - width + 1])


def packed(lo: np.ndarray, th: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Start, text tag and number of windows in one number that sorts by start."""
    return (lo << 31) | (th << 7) | n


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 31, (pos >> 7) & 0xFFFFFF, pos & 127


def regions(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window start (within the row), number of windows, seed and region hash of every anchor's region."""
    out = []
    for a in range(0, max(len(buf) - length + 1, 0), PIECE):
        piece = buf[a: a + PIECE + length - 1]
        sums = rolling(BYTES[piece])
        grams = mix((sums[SEED:] - sums[:-SEED]) * unshift(np.arange(len(piece) - SEED + 1), len(piece)))
        bits = np.uint64((1 << 21) - 1)
        least = sliding_min((grams & ~bits) | np.arange(len(grams), dtype=np.uint64), length - SEED + 1)
        anchor = (least & bits).astype(np.int64)
        starts = np.arange(len(anchor))
        row = np.searchsorted(offs, starts + a, side="right") - 1
        whole = starts + a + length <= offs[row + 1]
        first = whole.copy()
        first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        end = whole.copy()
        end[:-1] &= ~whole[1:] | first[1:]
        lo, hi = np.flatnonzero(first), np.flatnonzero(end)
        body = (sums[hi + length] - sums[lo]) * unshift(lo, len(piece))
        shape = mix((((anchor[lo] - lo) << 8) | (hi - lo)).astype(np.uint64))
        out.append((row[lo], lo + a - offs[row[lo]], hi - lo + 1, grams[anchor[lo]], mix(body ^ shape)))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def repeats(*keys: np.ndarray) -> np.ndarray:
    """Which rows equal the row before them in all keys."""
    equal = np.zeros(len(keys[0]), dtype=bool)
    equal[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return equal


def find_regions(length: int):
    """Regions of a batch of texts; of equal regions only the first stays open, the others are marked at once."""

    def batches(source):
        for batch in source:
            raw, offs = text_bytes(batch.column("text"))
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            parts = []
            for i, j in chunks(offs):
                row, lo, n, seed, region = regions(raw[offs[i]: offs[j]], offs[i: j + 1] - offs[i], length)
                parts.append((ids[row + i], packed(lo, tags[row + i], n), seed.view(np.int64), region.view(np.int64)))
            if not parts:
                continue
            doc, pos, seed, region = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((pos, doc, region))
            doc, pos, seed, region = doc[order], pos[order], seed[order], region[order]
            again = repeats(region, doc, pos)
            doc, pos, seed, region = doc[~again], pos[~again], seed[~again], region[~again]
            later = repeats(region, seed)
            spread = mix(doc.astype(np.uint64) ^ mix(pos.astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(later), pa.array(np.where(later, spread, seed)), pa.array(region), pa.array(doc), pa.array(pos)],
                names=["marked", "seed", "region", "id", "pos"])

    return batches


def settle(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by seed, region, id and pos: marks all but the first of equal regions, and keeps open the
    firsts of seeds with several regions. One row is carried from batch to batch, whatever a seed's number of rows."""
    names = ["kind", "seed", "id", "pos"]
    last = None  # the last row: seed, region, id, pos
    held = None  # a seed's only open row so far
    emitted = None  # seed whose rows are known to be open

    def out(kind, seed, doc, pos):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(seed), kind, np.int32)), pa.array(seed), pa.array(doc), pa.array(pos)], names=names)

    for batch in source:
        marked, *cols = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("marked", "seed", "region", "id", "pos"))
        seed, region, doc, pos = cols
        if marked.any():
            yield out(MARK, seed[marked], doc[marked], pos[marked])
            seed, region, doc, pos = (c[~marked] for c in cols)
        if not len(seed):
            continue
        if last is not None:
            seed, region, doc, pos = (np.concatenate(([v], c)) for v, c in zip(last, (seed, region, doc, pos)))
        again, later = repeats(seed, region, doc, pos), repeats(seed, region)
        fresh = np.ones(len(seed), dtype=bool)
        fresh[0] = last is None  # the carried row was dealt with
        dup = later & ~again & fresh
        yield out(MARK, seed[dup], doc[dup], pos[dup])
        at = np.flatnonzero(~later & fresh)
        last = (seed[-1], region[-1], doc[-1], pos[-1])
        if not len(at):
            continue
        s, d, p = seed[at], doc[at], pos[at]
        if held is not None:
            s, d, p = (np.concatenate(([v], c)) for v, c in zip(held, (s, d, p)))
            held = None
        shared = np.zeros(len(s), dtype=bool)
        equal = s[1:] == s[:-1]
        shared[1:] |= equal
        shared[:-1] |= equal
        if emitted is not None:
            shared |= s == emitted
        yield out(OPEN, s[shared], d[shared], p[shared])
        emitted = s[-1] if shared[-1] else None
        held = None if shared[-1] else (s[-1], d[-1], p[-1])


def cut_regions(length: int):
    """The bytes of a document's open regions."""

    def batches(source):
        for batch in source:
            raw, offs = text_bytes(batch.column("text"))
            ids = batch.column("id").to_numpy()
            rows, seeds, places, bodies = [], [], [], []
            for i, opened in enumerate(batch.column("opened").to_pylist()):
                for o in opened:
                    lo, n = o["pos"] >> 31, o["pos"] & 127
                    rows.append(ids[i])
                    seeds.append(o["seed"])
                    places.append(o["pos"])
                    bodies.append(raw[offs[i] + lo: offs[i] + lo + n + length - 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(seeds, pa.int64()), pa.array(places, pa.int64()), pa.array(bodies, pa.binary())],
                names=["id", "seed", "pos", "body"])

    return batches


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a text sorted by their first ``depth`` letters at least; 0 follows the end."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint16))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # letters have nine bits
        key = (key << np.uint64(9)) | padded[k: k + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
    known = 7
    while known < depth and rank[order[-1]] < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - known, 0)] = rank[known:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        known *= 2
    return order


def expand_intervals(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each row whether its common prefix with the row before is shorter than ``depth``.

    Round by round every interval of rows with a common prefix of l letters is extended backwards by each letter: with
    the transform's inverse (from a row to the row of the following position) two neighbours with the same first letter
    share l + 1 letters exactly if their followers are in one interval of l. So common prefixes come out by increasing
    value, and rows once apart need no more work; at ``depth`` the expansion stops.
    """
    order = suffix_order(text, depth)
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    follow = rank[np.minimum(order + 1, n - 1)]
    apart = np.ones(n, dtype=bool)
    apart[1:] = text[order[1:]] != text[order[:-1]]
    together = np.flatnonzero(~apart)
    for _ in range(depth - 1):
        interval = np.cumsum(apart, dtype=np.int32)
        split = interval[follow[together]] != interval[follow[together - 1]]
        apart[together[split]] = True
        together = together[~split]
        if not len(together):
            break
    return order, apart


def match_block(ids: np.ndarray, pos: np.ndarray, merge: np.ndarray, bodies: list[bytes], length: int):
    """Windows of a block's regions that also start earlier in it, as (id, tag, start); and for regions whose seed is
    split over blocks, every window that is the first of its kind here, as (id, tag, start, digest)."""
    lengths = np.array([len(b) for b in bodies])
    ends = np.cumsum(lengths + 1)
    text = np.zeros(int(ends[-1]), np.uint16)
    flat = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    text[:] = flat.astype(np.uint16) + 1
    text[ends - 1] = 0
    owner = np.repeat(np.arange(len(bodies)), lengths + 1)
    offset = np.arange(len(text)) - (ends - lengths - 1)[owner]
    whole = offset + length <= lengths[owner]
    order, apart = expand_intervals(text, length)
    interval = np.cumsum(apart)
    rows = np.flatnonzero(whole[order])
    at, kind = order[rows], interval[rows]
    lo, tag, _ = unpacked(pos)
    doc, start, tags, late = ids[owner[at]], lo[owner[at]] + offset[at], tag[owner[at]], merge[owner[at]]
    by = np.lexsort((tags, start, doc, kind))
    doc, start, tags, late, kind, at = doc[by], start[by], tags[by], late[by], kind[by], at[by]
    again = repeats(kind, doc, start, tags)
    doc, start, tags, late, kind, at = (c[~again] for c in (doc, start, tags, late, kind, at))
    later = repeats(kind)
    firsts = np.flatnonzero(~later & late)
    digests = [hashlib.blake2b(flat[p: p + length].tobytes(), digest_size=16).digest() for p in at[firsts]]
    return (doc[later], tags[later], start[later]), (doc[firsts], tags[firsts], start[firsts], digests)


def match_regions(length: int):
    """Reads regions sorted by seed and part, and matches them block by block."""
    names = ["id", "pos", "digest"]

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, pos, merge = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        (doc, tag, start), (fd, ft, fs, digests) = match_block(ids, pos, merge, [r[3] for r in rows], length)
        by = np.lexsort((start, tag, doc))
        doc, tag, start = doc[by], tag[by], start[by]
        if len(doc):  # runs of neighbouring windows, 127 at most
            step = np.ones(len(doc), dtype=bool)
            step[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)
            head = np.flatnonzero(step)
            place = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))
            head = np.flatnonzero(step | (place % 127 == 0))
            n = np.diff(np.append(head, len(doc)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[head]), pa.array(packed(start[head], tag[head], n)), pa.nulls(len(head), pa.binary())], names=names)
        if len(fd):
            yield pa.RecordBatch.from_arrays(
                [pa.array(fd), pa.array(packed(fs, ft, np.ones(len(fs), np.int64))), pa.array(digests, pa.binary())], names=names)

    def batches(source):
        rows, size, group = [], 0, None
        for batch in source:
            for seed, part, parts, doc, pos, body in zip(*(batch.column(c).to_pylist() for c in ("seed", "part", "parts", "id", "pos", "body"))):
                if (seed, part) != group:
                    if size >= BLOCK_BYTES:
                        yield from solve(rows)
                        rows, size = [], 0
                    group = (seed, part)
                rows.append((doc, pos, parts > 1, body))
                size += len(body)
        if rows:
            yield from solve(rows)

    return batches


def removed_windows(docs: DataFrame, length: int) -> DataFrame:
    """(id, pos) of all windows that also start earlier; ``docs``: id, tag, text."""
    rows = docs.mapInArrow(find_regions(length), "marked boolean, seed long, region long, id long, pos long")
    settled = stage(
        rows.repartition("seed").sortWithinPartitions("seed", "region", "id", "pos").mapInArrow(settle, "kind int, seed long, id long, pos long"),
        "regions")
    opened = settled.where(F.col("kind") == OPEN)
    parts = opened.groupBy("seed").agg(F.ceil(F.count("*") / MOST_ROWS).cast("int").alias("parts")).where("parts > 1")
    by_doc = opened.select(
        F.col("id").alias("_i"), F.shiftright("pos", 7).bitwiseAND(0xFFFFFF).alias("_g"), F.struct("seed", "pos").alias("o")
    ).groupBy("_i", "_g").agg(F.collect_list("o").alias("opened"))
    bodies = docs.join(by_doc, (F.col("id") == F.col("_i")) & (F.col("tag") == F.col("_g"))).select("id", "text", "opened").mapInArrow(
        cut_regions(length), "id long, seed long, pos long, body binary"
    )
    dealt = bodies.join(parts.withColumnRenamed("seed", "_s"), F.col("seed") == F.col("_s"), "left").select(
        "seed", "id", "pos", "body", F.coalesce("parts", F.lit(1)).alias("parts")
    ).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    matched = stage(
        dealt.repartition("seed", "part").sortWithinPartitions("seed", "part", "id", "pos").mapInArrow(
            match_regions(length), "id long, pos long, digest binary"), "matches")
    firsts = matched.where(F.col("digest").isNotNull())
    earliest = firsts.groupBy("digest").agg(F.min(F.struct("id", "pos")).alias("least")).select(F.col("digest").alias("_d"), "least")
    merged = firsts.join(earliest, F.col("digest") == F.col("_d")).where(F.struct("id", "pos") != F.col("least"))
    return (
        settled.where(F.col("kind") == MARK).select("id", "pos")
        .unionByName(matched.where(F.col("digest").isNull()).select("id", "pos"))
        .unionByName(merged.select("id", "pos"))
    )


def covered(spans: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows given as packed starts and counts."""
    out: list[list[int]] = []
    for pos in sorted(spans):
        lo, hi = pos >> 31, (pos >> 31) + (pos & 127) + length - 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``keep_text`` also ``kept``, the bytes left.

    A byte goes if a ``length``-byte string within its document covers it that also starts earlier, in a document of
    smaller id or before in the same one; overlapping copies count, and strings are judged on the input. Regions and
    whole documents are compared by 64-bit hashes of their bytes first, blocks letter by letter.

    Null and short texts lose nothing; rows without id come last in order, as one document. Rows that repeat an id with
    the same text are one document and agree; with other texts they are ordered by start, then by a tag of the text.
    Empty tables give no rows; further columns are ignored. A region that a third of all documents share is reduced to
    its first occurrence in every batch before it moves.
    """
    keyed = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tag", F.xxhash64("text").bitwiseAND(0xFFFFFF))
    gone = removed_windows(keyed.select("id", "tag", "text"), length).select(
        F.col("id").alias("_i"), F.shiftright("pos", 7).bitwiseAND(0xFFFFFF).alias("_g"), "pos"
    ).groupBy("_i", "_g").agg(F.collect_list("pos").alias("spans"))
    joined = keyed.join(gone, same(("id", "_i"), ("tag", "_g")), "left").select("doc_id", "text", "spans")

    def cut(source):
        for batch in source:
            raw, offs = text_bytes(batch.column("text"))
            size, lost, count, digests, kept = [], [], [], [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                body = raw[offs[i]: offs[i + 1]]
                runs = covered(spans, length) if spans else []
                edges = [0, *(x for r in runs for x in r), len(body)]
                left = b"".join(body[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))
                size.append(len(body))
                lost.append(len(body) - len(left))
                count.append(len(runs))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_text else None)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, lost, count)), pa.array(digests)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return joined.mapInArrow(cut, schema)
