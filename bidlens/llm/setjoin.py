"""N-gram Jaccard join of whole texts: a size-aware heavy-light join, exact, with connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.mixing import same
from bidlens.llm.tables import stage, unclashed, unstage
from bidlens.llm.wordhash import mix, shingles, words

SPARE = 12  # parts beyond the pigeonhole's need, at least; linked sets share more parts than the spare ones
SHARE = 0.25  # spare parts per part that two linked sets may differ in
RATIO = 1.6  # largest over smallest size of a band
LIST_COST = 3  # cost of a list entry (it must be verified with whole sets) against a subset entry
SKETCH = 5, 16  # a sketch has about one counter per two elements, 2**5 to 2**16
CROWDED = 0.9  # share of the lists that a partner shares at least, less one, which may be left out as too crowded
TOGETHER = 1 << 18  # pairs that leave a task together
FOLD = 128  # counters of the short sketch that the first looks use
ROUNDS = (8, 1, 1)  # of linking members to the centres of their lists: with every so many lists


@dataclass(frozen=True)
class Plan:
    """Links: den * intersection >= num * union."""

    num: int
    den: int
    size: int

    def required(self, s: int, t: int) -> int:
        return -(-self.num * (s + t) // (self.num + self.den))

    def distance(self, total: int) -> int:
        """Most elements that two linked sets of ``total`` elements together do not share."""
        return (self.den - self.num) * total // (self.num + self.den)

    def largest(self, n: int) -> int:
        return n * self.den // self.num

    def smallest(self, n: int) -> int:
        return -(-n * self.num // self.den)


@lru_cache(100_000)
def deletions(plan: Plan, n: int, most: int) -> int:
    """Elements that a set of n may lack of its intersection with a linked set of at most ``most``."""
    return max((n - plan.required(n, m) for m in range(plan.smallest(n), min(plan.largest(n), most) + 1)), default=0)


@lru_cache(1000)
def band_of(n: int) -> tuple[int, int]:
    """Number and largest size of the band of set sizes that n lies in."""
    low, high, k = 1, 1, 0
    while n > high:
        low = high + 1
        high, k = max(int(low * RATIO), low), k + 1
    return k, high


def parts_of(plan: Plan, high: int) -> tuple[int, int]:
    """Number of parts, and how many of them are spare: it grows with the set, so that chance meetings fall behind."""
    apart = plan.distance(2 * high)
    spare = max(SPARE, int(apart * SHARE))
    return apart + 1 + spare, spare


@lru_cache(1000)
def boundary(plan: Plan) -> int:
    """Largest size up to which enumerating subsets costs less than list entries for every size."""
    n = 1
    while True:
        m = n + 1
        subsets = sum(comb(m, d) for d in range(deletions(plan, m, 1 << 30) + 1))
        bands = {band_of(m)[1], band_of(plan.largest(m))[1]}
        if subsets > LIST_COST * sum(parts_of(plan, h)[0] for h in bands):
            return n
        n = m


def subset_keys(tokens: np.ndarray, most_deleted: int) -> np.ndarray:
    """Keys of all subsets that lack up to that many elements: sums of scrambled tokens, so each costs one addition."""
    t = mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    sums, left = t.sum(dtype=np.uint64), len(tokens)
    out = [mix(sums ^ mix(np.uint64(left)))]
    lacking, last = np.zeros(1, np.uint64), np.full(1, -1)
    for d in range(1, min(most_deleted, left - 1) + 1):
        grow = [(lacking[last < i] + t[i], i) for i in range(left)]
        lacking, last = np.concatenate([g for g, _ in grow]), np.concatenate([np.full(len(g), i) for g, i in grow])
        out.append(mix((sums - lacking) ^ mix(np.uint64(left - d))))
    return np.concatenate(out)


def list_keys(tokens: np.ndarray, band: int, m: int, spare: int) -> np.ndarray:
    """Keys of the inverted lists of a set in one band: one per part of the token space, for the tokens in it.

    Two linked sets differ in fewer than m - spare parts, so they share more than ``spare`` equal parts. A set with e empty
    parts, at most that many, shares spare + 1 - e filled ones with every partner; only sets with more list empty parts too.
    """
    cuts = (np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m))
    at = np.concatenate(([0], np.searchsorted(tokens, cuts), [len(tokens)]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5A5A5A5A5A5A5A5A)), dtype=np.uint64)))
    keys = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(band * 1_000_003 + 7)))
    filled = at[1:] > at[:-1]
    return keys if m - int(filled.sum()) > spare else keys[filled]


def keys_of(plan: Plan, tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """All keys under which a set meets its possible partners, and how many of them any partner shares at least.

    A pair is sought by the scheme of its larger set: subsets up to the boundary, lists beyond. So a small set that may
    have a partner beyond the boundary enters lists as well.
    """
    n, x = len(tokens), boundary(plan)
    out, least = [], 1 << 30
    if n <= x:
        out.append(subset_keys(tokens, deletions(plan, n, x)))
        least = 1
    for k, high in list_bands(plan, n):
        m, spare = parts_of(plan, high)
        keys = list_keys(tokens, k, m, spare)
        out.append(keys)
        least = min(least, max(1, spare + 1 - (m - len(keys)) if len(keys) < m else _filled_need(tokens, m, spare)))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), min(least, len(tokens) + 1)


def list_bands(plan: Plan, n: int) -> list[tuple[int, int]]:
    """The bands in whose lists a set of n stands."""
    x = boundary(plan)
    return sorted({band_of(t) for t in (max(n, x + 1), plan.largest(n)) if t > x and t >= n}) if plan.largest(n) > x else []


def filled_parts(tokens: np.ndarray, m: int) -> int:
    cuts = np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m)
    at = np.concatenate(([0], np.searchsorted(tokens, cuts), [len(tokens)]))
    return int((at[1:] > at[:-1]).sum())


def _filled_need(tokens: np.ndarray, m: int, spare: int) -> int:
    """Shared parts of a set that lists all its parts: spare + 1, or 1 if some of these may be empty ones."""
    return spare + 1 if filled_parts(tokens, m) == m else 1


def least_of(plan: Plan, tokens: np.ndarray) -> int:
    """How many keys any partner shares at least, as ``keys_of`` gives it, without making the keys."""
    n = len(tokens)
    least = 1 if n <= boundary(plan) else 1 << 30
    for _, high in list_bands(plan, n):
        m, spare = parts_of(plan, high)
        empty = m - filled_parts(tokens, m)
        least = min(least, spare + 1 - empty if empty <= spare else 1)
    return min(least, n + 1)


def sketch_of(tokens: np.ndarray) -> bytes:
    """Counts of tokens by their lowest bits: two sets differ in at least as many elements as their counts do."""
    counters = 1 << min(max(len(tokens).bit_length() - 1, SKETCH[0]), SKETCH[1])
    return np.minimum(np.bincount((tokens & np.uint64(counters - 1)).astype(np.int64), minlength=counters), 255).astype(np.uint8).tobytes()


def short(sketch: bytes) -> bytes:
    counts = np.frombuffer(sketch, np.uint8)
    return sketch if len(counts) <= FOLD else clipped(counts.reshape(-1, FOLD).sum(axis=0)).astype(np.uint8).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one matrix: longer ones are folded to the shortest one's counters."""
    least = min(map(len, sketches))
    rows = [np.frombuffer(s, np.uint8).astype(np.int32) for s in sketches]
    return np.stack([r if len(r) == least else r.reshape(-1, least).sum(axis=0) for r in rows])


def clipped(sketch: np.ndarray) -> np.ndarray:
    """A counter at 255 may stand for more; with both sides cut there, differences only shrink."""
    return np.minimum(sketch, 255)


def document_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for i, j, cut, hashes, _, _ in words(column, lower=True):
        for k in range(j - i):
            yield shingles(hashes[cut[k]: cut[k + 1]], size)


def signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def summarise(plan: Plan):
    """Per document: set size, 64-bit digest of the set, sketches and how many keys any partner shares at least."""

    def batches(source):
        for batch in source:
            step = 256
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sizes, digests, sketches, least = [], [], [], []
                for t in document_sets(part.column("text"), plan.size):
                    sizes.append(len(t))
                    digest = mix(mix(t).sum(dtype=np.uint64) ^ mix(np.uint64(len(t) + 99)))
                    digests.append(int(signed(digest)[0]) if len(t) else 0)
                    sketches.append(sketch_of(t))
                    least.append(least_of(plan, t))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("th"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()),
                    pa.array(sketches, pa.binary()), pa.array([short(x) for x in sketches], pa.binary()), pa.array(least, pa.int32()),
                ], names=["doc_id", "th", "n", "cls", "sketch", "short", "least"])

    return batches


def key_batches(plan: Plan):
    """(cls, key) of every row: the lists that its set stands in."""

    def batches(source):
        for batch in source:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keys = [keys_of(plan, t)[0] for t in document_sets(part.column("text"), plan.size)]
                ids = np.repeat(part.column("cls").to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(signed(np.concatenate(keys)))], names=["cls", "key"])

    return batches


def token_batches(plan: Plan):
    def batches(source):
        seen: set[int] = set()  # a repeated row gives its class once a task
        for batch in source:
            ids = batch.column("cls").to_pylist()
            new = [not (c in seen or seen.add(c)) for c in ids]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [t.tobytes() for t in document_sets(part.column("text"), plan.size)]
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(sets, pa.binary())], names=["cls", "tokens"])

    return batches


def sketch_filter(plan: Plan):
    """Pairs whose sizes and sketches allow a link."""

    def batches(source):
        for b in source:
            if not b.num_rows:
                continue
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            sketches = (clipped(folded([x.as_py(), y.as_py()])) for x, y in zip(b.column("sa"), b.column("sb")))
            apart = np.array([np.abs(m[0] - m[1]).sum() for m in sketches])
            fits = (apart * (plan.num + plan.den) <= (plan.den - plan.num) * (na + nb)) & (plan.den * np.minimum(na, nb) >= plan.num * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(fits)), b.column("b").filter(pa.array(fits))], names=["a", "b"])

    return batches


def verify(plan: Plan):
    """Pairs whose whole sets are linked."""

    def batches(source):
        for b in source:
            keep = []
            for x, y in zip(b.column("ta"), b.column("tb")):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(plan.den * both >= plan.num * (len(s) + len(t) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return batches


def near_pairs(plan: Plan, pairs: DataFrame, classes: DataFrame, looks: tuple = ("short", "sketch")) -> DataFrame:
    """The pairs (a, b) that sizes, short sketches and at last whole sketches allow to be links."""
    sizes = classes.select("cls", "n")
    pairs = pairs.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b"
    ).where(F.least("na", "nb") * plan.den >= F.greatest("na", "nb") * plan.num).select("a", "b")
    for look in looks:
        left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col(look).alias("sa"))
        right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col(look).alias("sb"))
        pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(
            sketch_filter(plan), "a long, b long"
        )
    return pairs


def linked_pairs(plan: Plan, near: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked; sets are made anew for the classes that occur in a pair only.

    A class's text is that of its representative row, found by doc_id and hash of the text: ids may be null or repeated.
    ``near`` is a staged table; it and the sets are deleted once the links are written.
    """
    ids = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    wanted = stage(classes.select("cls", F.col("first").alias("_f"), F.col("text_of").alias("_t")).join(ids, "cls"), "wanted")
    found = texts.join(wanted, same(("doc_id", "_f"), ("th", "_t"))).select("cls", "text")
    tokens = stage(found.mapInArrow(token_batches(plan), "cls long, tokens binary"), "tokens")
    full = near.join(tokens.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(
        tokens.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b"
    )
    links = stage(full.select("a", "b", "ta", "tb").mapInArrow(verify(plan), "a long, b long"), "links")
    for done in (near, wanted, tokens):
        unstage(done)
    return links


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp): each node's smallest reachable label, by hooking roots onto smaller ones and pointer jumping.

    ``nodes``: cls, comp, where comp is a root known so far; ``links``: a, b. Each round stages its table, so lineage
    stays short; the number of rounds grows with the logarithm of the longest chain of roots.
    """
    state = nodes
    while True:
        near = state.select(F.col("cls").alias("a"), F.col("comp").alias("ca"))
        far = state.select(F.col("cls").alias("b"), F.col("comp").alias("cb"))
        hooks = stage(
            links.join(near, "a").join(far, "b").where(F.col("ca") != F.col("cb"))
            .select(F.greatest("ca", "cb").alias("root"), F.least("ca", "cb").alias("onto"))
            .groupBy("root").agg(F.min("onto").alias("onto")), "hooks")
        if hooks.isEmpty():
            return state
        while True:  # a root hooks onto a smaller one, so chains end; halve their length until all point to ends
            up = hooks.select(F.col("root").alias("r"), F.col("onto").alias("o"))
            jumped = stage(hooks.join(up, F.col("onto") == F.col("r"), "left").select(
                "root", F.coalesce("o", "onto").alias("onto"), F.col("o").isNotNull().alias("moved")), "jump")
            hooks = jumped.select("root", "onto")
            if jumped.where("moved").isEmpty():
                break
        state = stage(state.join(hooks, F.col("comp") == F.col("root"), "left").select(
            "cls", F.coalesce("onto", "comp").alias("comp")), "components")


def center_pairs(lists: DataFrame, comps: DataFrame, every: int, turn: int) -> DataFrame:
    """For a share of the lists: pairs of each list's own centre (another one each turn) with members of other components."""
    some = lists if every == 1 else lists.where(F.pmod("key", F.lit(every)) == 0)
    now = some.join(comps, "cls")
    centers = now.groupBy("key").agg(
        F.min_by(F.struct("cls", "comp"), F.xxhash64(F.lit(turn), "key", "cls")).alias("c"), F.min("comp").alias("least"), F.max("comp").alias("most")
    ).where(F.col("least") != F.col("most")).select("key", F.col("c.cls").alias("a"), F.col("c.comp").alias("ca"))
    return now.join(centers, "key").where(F.col("comp") != F.col("ca")).select(
        F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")
    ).distinct()


def left_out(least: Column) -> Column:
    """How many of its most crowded lists a class leaves out; of the ``least`` lists that a partner shares the others remain."""
    return F.floor((least - 1) * CROWDED).cast("int")


def rarer_lists(now: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``now`` (cls, key, comp, many) without each class's most crowded lists, and ``need``.

    Two linked classes share ``least`` lists at least. In one order of all lists, what either of them leaves out of these
    are the most crowded ones, ``left_out`` at most; so they meet in ``need`` of the lists that remain.
    """
    crowded = Window.partitionBy("cls").orderBy(F.desc("many"), "key")
    return now.join(classes.select("cls", "least"), "cls").withColumn("place", F.row_number().over(crowded)).where(
        F.col("place") > left_out(F.col("least"))
    ).select("cls", "key", "comp", (F.col("least") - left_out(F.col("least"))).alias("need"))


def _met(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "need"])


def mixed(rows: DataFrame) -> DataFrame:
    """(key, many): lists with members of more than one component, and their lengths."""
    return rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("many")).where(
        F.col("low") != F.col("high")).select("key", "many")


def unsettled(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (cls, key, comp, many) of the mixed lists."""
    now = lists.join(comps, "cls")
    return now.join(mixed(now), "key")


def rest_pairs(kept: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """All pairs of members in different components that meet in as many lists as linked ones do, with sizes and sketches
    that allow a link.

    ``kept`` are the rows that ``rarer_lists`` leaves. Members of one list meet in blocks: each member is sent to the
    blocks of its list that it must meet, so that a long list spreads over tasks. Within a block the sketches are
    compared in numpy and only possible links come out, once per list; then each pair's lists are counted.
    """
    rows = kept.join(mixed(kept), "key").join(classes.select("cls", "n", "short"), "cls").withColumn(
        "blocks", F.ceil(F.col("many") / 512).cast("int")
    ).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    meet = rows.select(
        "key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "cls", "comp", "n", "need", "short"
    )

    def compared(p, q, mine, ids, comp, n, need, sketch):
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        for i in left:
            other = right[(comp[right] != comp[i]) & (ids[right] > ids[i] if p == q else True)]
            total, least, most = n[other] + n[i], np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
            fits = plan.den * least >= plan.num * most
            other, total = other[fits], total[fits]
            if len(other):
                apart = np.abs(sketch[other] - sketch[i]).sum(axis=1)
                other = other[apart * (plan.num + plan.den) <= (plan.den - plan.num) * total]
                yield np.minimum(ids[other], ids[i]), np.maximum(ids[other], ids[i]), np.maximum(need[other], need[i])

    def streamed(source):
        rest = None  # rows of the last group so far, a block pair of one list
        for batch in chain(source, [None]):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            key, p, q, mine, ids, comp, n, need = (table.column(c).to_numpy() for c in ("key", "p", "q", "mine", "cls", "comp", "n", "need"))
            head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
            ends = np.append(head[1:], len(key))
            if batch is not None:
                rest, head, ends = table.slice(int(head[-1])), head[:-1], ends[:-1]
            if not len(head):
                continue
            sketches, found, held = table.column("short").to_pylist(), [], 0
            for i, j in zip(head, ends):
                if n[i:j].min() * plan.den >= n[i:j].max() * plan.num or j - i > 2:
                    for pairs in compared(p[i], q[i], mine[i:j], ids[i:j], comp[i:j], n[i:j], need[i:j], clipped(folded(sketches[i:j]))):
                        found.append(pairs)
                        held += len(pairs[0])
                if held > TOGETHER:
                    yield _met(found)
                    found, held = [], 0
            if found:
                yield _met(found)

    found = meet.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(streamed, "a long, b long, need int")
    return found.groupBy("a", "b").agg(F.count("*").alias("lists"), F.max("need").alias("need")).where("lists >= need").select("a", "b")


def jaccard_components(docs: DataFrame, num: int = 90, den: int = 100, size: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    A text's set holds its distinct ``size``-word shingles, A-Z lower-cased, as 64-bit hashes; a text with fewer words is
    one shingle, without words the set is empty and linked with nothing. Documents link if den * intersection >= num *
    union. Equal sets (by size and 64-bit digest) are one class, and only classes are joined. Small sets meet on subsets
    of fixed sizes, large ones on inverted lists; ``boundary`` weighs the costs. Lists first link members to a centre,
    in rounds over growing shares of the lists, and what is in one component needs no more pairs; at last every pair of
    a list that is still in two components is compared, so no link between components is lost and no group of near
    copies is ever paired in full. Candidates are verified with whole sets.

    Null ids: the row is compared like others, its component is the smallest id reachable, null if there is none.
    Repeated rows all stay and agree; empty tables give no rows; further columns are ignored.
    """
    return labelled(docs, num, den, size).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def labelled(docs: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """doc_id, th (hash of the text), n, component_id and comp (its component, null without words) of every row."""
    plan = Plan(num, den, size)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    facts = stage(slim.mapInArrow(summarise(plan), f"doc_id {kind}, th long, n long, cls long, sketch binary, short binary, least int"), "sets")
    filled = facts.where("n > 0")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    firsts = stage(filled.groupBy("cls", "n").agg(
        F.min(row).alias("row"), F.min("sketch").alias("sketch"), F.min("short").alias("short"), F.min("least").alias("least"),
    ).select("cls", "n", F.col("row.doc_id").alias("first"), F.col("row.th").alias("text_of"), "sketch", "short", "least"), "classes")
    reps = firsts.select(F.col("cls").alias("_c"), F.col("first").alias("_f"), F.col("text_of").alias("_t"))
    entries = slim.join(reps, same(("doc_id", "_f"), ("th", "_t"))).select(F.col("_c").alias("cls"), "text").mapInArrow(
        key_batches(plan), "cls long, key long"  # keys take more room than texts, so they are made where they are dealt out
    )
    shared = stage(shared_lists(entries), "shared")
    known = stage(facts.select("doc_id", "th", "n", "cls"), "known")
    unstage(facts)
    lists = stage(dense_lists(shared, firsts), "lists")
    unstage(shared)
    used = lists.select("cls").distinct()
    classes = stage(firsts.join(used, "cls", "left_semi"), "used")
    comps = classes.select("cls", F.col("cls").alias("comp"))
    for turn, every in enumerate(ROUNDS):
        near = stage(near_pairs(plan, center_pairs(lists, comps, every, turn), classes), "pairs")
        comps = components(comps, linked_pairs(plan, near, classes, slim))
    kept = stage(rarer_lists(unsettled(lists, comps), classes), "rarer")
    unstage(lists)
    rest = stage(near_pairs(plan, rest_pairs(kept, classes, plan), classes, ("sketch",)), "pairs")
    unstage(kept)
    comps = components(comps, linked_pairs(plan, rest, classes, slim))
    named = comps.join(classes, "cls").groupBy("comp").agg(F.min("first").alias("smallest"))
    labels = comps.join(named, "comp").select(F.col("cls").alias("_c"), "smallest", "comp")
    everyone = firsts.join(labels, F.col("cls") == F.col("_c"), "left").select(
        F.col("cls").alias("_k"), F.coalesce("smallest", "first").alias("component_id"), F.coalesce("comp", "cls").alias("comp")
    )
    return known.join(everyone, F.when(F.col("n") > 0, F.col("cls")) == F.col("_k"), "left").select(
        "doc_id", "th", "n", "component_id", "comp"
    )


def shared_lists(entries: DataFrame) -> DataFrame:
    """Entries (cls, key) of the lists with more than one class.

    The lists are dealt out and sorted once and read as a stream, so a long list needs no memory; only the rows of
    shared lists leave.
    """

    def streamed(source):
        carry = None  # last row of the batch before: key, class, whether it was sent on
        for batch in source:
            if not batch.num_rows:
                continue
            key, cls = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
            lone = np.ones(len(key), dtype=bool)
            equal = key[1:] == key[:-1]
            lone[1:] &= ~equal
            lone[:-1] &= ~equal
            out_key, out_cls = [], []
            if carry is not None and carry[0] == key[0]:
                if carry[2]:
                    out_key, out_cls = [np.array([carry[0]])], [np.array([carry[1]])]
                lone[0] = False
            out_key.append(key[~lone])
            out_cls.append(cls[~lone])
            carry = (key[-1], cls[-1], bool(lone[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_cls)), pa.array(np.concatenate(out_key))], names=["cls", "key"])

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(streamed, "cls long, key long").distinct()


def dense_lists(lists: DataFrame, classes: DataFrame, passes: int = 2) -> DataFrame:
    """``lists`` without classes that share fewer entries than any partner of theirs would share.

    A class that goes takes its entries along, so lists of one go too, and another pass may find more.
    """
    need = classes.select("cls", "least")
    for _ in range(passes):
        enough = lists.groupBy("cls").agg(F.count("*").alias("held")).join(need, "cls").where(F.col("held") >= F.col("least")).select("cls")
        left = lists.join(enough, "cls", "left_semi")
        shared = left.groupBy("key").agg(F.min("cls").alias("one"), F.max("cls").alias("other")).where(F.col("one") != F.col("other"))
        lists = left.join(shared.select("key"), "key", "left_semi")
    return lists


def one_of_each(docs: DataFrame, num: int = 80, den: int = 100, size: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, with the smallest id that it has.

    Rows are told apart by id and text, so another text under the same id is judged on its own, and rows without id belong
    to their component. Of repeated rows one stays. Documents without words are in no group and stay.
    """
    plain, _ = unclashed(docs, {"doc_id", "text", "lang", "source", "n_chars"})
    rows = stage(labelled(docs, num, den, size).where("n > 0").groupBy("comp", "doc_id", "th").agg(F.count("*").alias("many")), "rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "many")
    stays = stage(rows.groupBy("comp").agg(F.min(first).alias("r")).select(
        F.col("r.doc_id").alias("_d"), F.col("r.th").alias("_t"), F.col("r.many").alias("_many")), "stays")
    gone = rows.join(stays, same(("doc_id", "_d"), ("th", "_t")), "left_anti").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    twice = stays.where("_many > 1")
    on = same(("doc_id", "_d"), ("_th", "_t"))
    hashed = plain.withColumn("_th", F.xxhash64("text"))
    whole = F.struct(*plain.columns)
    rest = F.xxhash64(F.lit(0), *[c for c in ("lang", "source", "n_chars") if c in plain.columns])
    single = hashed.join(twice, on, "left_semi").groupBy("doc_id", "_th").agg(F.min_by(whole, rest).alias("r")).select("r.*")
    others = hashed.join(gone.unionByName(twice.select("_d", "_t")), on, "left_anti").select(*plain.columns)
    return others.unionByName(single).toDF(*docs.columns)
