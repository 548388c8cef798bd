"""Secret scans with corpus-wide ownership of every candidate."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.mixing import same
from bidlens.llm.tables import sha256, stage, unclashed
from bidlens.llm.wordhash import text_bytes

ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "owned")
HEX = np.zeros(256, dtype=bool)
HEX[list(b"0123456789abcdef")] = True
TOKEN = np.zeros(256, dtype=bool)
TOKEN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-")] = True
TOKEN_LENGTH = 20
EXAMPLE_OWNERS = 3  # a value that so many owners hold is a widely copied example
MANY_REPOS = 3  # a value that so many repositories hold is passed around, even if one owner has them all
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your|test|x{4,}|(.)\1{5,}", re.IGNORECASE)
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("live", pa.bool_())])
FOUND = pa.schema([
    ("doc_id", pa.int64()), ("th", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), ("n_assign", pa.int64()),
    ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("hits", pa.list_(SPAN)),
])
FOUND_SQL = (
    "doc_id long, th long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "hits array<struct<kind:string,start:long,end:long,hash:string,live:boolean>>"
)


def runs(mask: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set bytes of at least that length; runs do not cross rows."""
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    full = offs[:-1] < offs[1:]
    start[offs[:-1][full]], end[offs[1:][full] - 1] = mask[offs[:-1][full]], mask[offs[1:][full] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = e - s >= least
    return s[long], e[long]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Random enough for a real credential and no placeholder."""
    return len(value) >= 8 and entropy(value) >= 2.5 and not PLACEHOLDER.search(value)


def scan_text(data: bytes, hexes: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> list[tuple]:
    """Spans of one text as (kind, start byte, end byte, value)."""
    found = []
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(data) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(data) if len(m[0]) >= 20]
    found += [("hex", s, e, data[s:e]) for s, e in hexes]
    for s, e in tokens:
        value = data[s:e]
        mixed = any(48 <= b <= 57 for b in value) and any(b >= 65 for b in value)
        if mixed and all(e <= a or b <= s for _, a, b, _ in found) and entropy(value.decode("ascii")) >= 3.5:
            found.append(("owned", s, e, value))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = text_bytes(batch.column("text"))
        base, raw = offs[0], raw[offs[0]: offs[-1]]
        offs = offs - base
        at: dict[str, tuple] = {}
        for name, mask, least in (("hex", HEX[raw], 24), ("token", TOKEN[raw], TOKEN_LENGTH)):
            s, e = runs(mask, offs, least)
            row = np.searchsorted(offs, s, side="right") - 1
            at[name] = (s, e, np.searchsorted(row, np.arange(len(offs))))
        out = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "hits": []}
        for i in range(batch.num_rows):
            o = int(offs[i])
            data = raw[o: offs[i + 1]].tobytes()
            own = {k: [(int(a) - o, int(b) - o) for a, b in zip(s[c[i]: c[i + 1]], e[c[i]: c[i + 1]])] for k, (s, e, c) in at.items()}
            spans = scan_text(data, own["hex"], own["token"])
            if spans and not data.isascii():  # byte offsets to code points
                points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                place = lambda b: int(points[b])
            else:
                place = int
            hits = [{
                "kind": k, "start": place(s), "end": place(e), "hash": hashlib.blake2b(v, digest_size=16).hexdigest(),
                "live": looks_live(v.decode("ascii")),
            } for k, s, e, v in spans]
            kinds = Counter(h["kind"] for h in hits)
            out["n_assign"].append(kinds["assign"])
            out["n_access"].append(kinds["access"])
            out["n_hex"].append(kinds["hex"])
            out["base_sha256"].append(sha256(listed((h["kind"], h["start"], h["end"]) for h in hits if h["kind"] != "owned").encode()))
            out["hits"].append(hits)
        kept = {n: batch.column(n) for n in ("doc_id", "th", "repo", "owner")}
        yield pa.RecordBatch.from_arrays([pa.array(v, FOUND.field(n).type) if isinstance(v, list) else v.cast(FOUND.field(n).type)
                                          for n, v in (kept | out).items()], schema=FOUND)


def scan_secrets(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """Every row's secrets with the corpus-wide verdict on each.

    A value's 128-bit hash is counted by distinct repositories and owners over the whole corpus. ``example``: at least
    EXAMPLE_OWNERS owners hold it; ``live``: a single owner holds it, in fewer than MANY_REPOS repositories, and it looks
    random; else ``shared``, as is what one owner copied into many repositories. Base kinds
    (assign, access, hex) are always reported. A token of 20 or more characters with letters, digits and high entropy
    outside them is reported as ``owned`` only if the verdict is live. Result: doc_id, th (hash of the text), n_assign,
    n_access, n_hex, base_sha256, and hits, an array of (start, place, kind, end, verdict, repos, owners) ordered by start.

    Null or empty text: no hits; null source or language: a repository of its own; null doc_id stays; repeated rows all
    stay and agree; empty tables give no rows; further columns are ignored. A value that a third of all rows hold is
    reduced to its distinct owners before it moves.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.coalesce(repo, F.lit("")).alias("repo"), F.coalesce(owner, F.lit("")).alias("owner"), "text",
    )
    found = stage(rows.mapInArrow(scan_batches, FOUND_SQL), "secrets")
    hits = found.select("doc_id", "th", "repo", "owner", F.explode("hits").alias("h")).select(
        "doc_id", "th", "repo", "owner", "h.*"
    )
    held = hits.select("hash", "repo", "owner").distinct().groupBy("hash").agg(
        F.count("*").alias("repos"), F.count_distinct("owner").alias("owners")
    )
    verdict = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(
        (F.col("owners") == 1) & (F.col("repos") < MANY_REPOS) & F.col("live"), "live").otherwise("shared")
    places = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    judged = hits.drop("repo", "owner").distinct().join(held, "hash").withColumn("verdict", verdict).where(
        (F.col("kind") != "owned") | (F.col("verdict") == "live")
    ).groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", places.alias("place"), "kind", "end", "verdict", "repos", "owners"))).alias("marks")
    ).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "marks")
    return found.join(judged, same(("doc_id", "_d"), ("th", "_t")), "left").select(
        "doc_id", "th", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("marks", F.array().cast(judged.schema["marks"].dataType)).alias("hits"),
    )


def hit_list(hits: str = "hits", fields: tuple = ("kind", "start", "end")) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", *[h[f] for f in fields])), ",")


def mask_secrets(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """The rows of ``docs`` with every secret but widely copied examples replaced by ``<kind>``; columns as given.

    Overlapping hits are masked as one, under the first one's kind.
    """
    given = docs.columns
    docs, _ = unclashed(docs, {"doc_id", "text", "lang", "source", "n_chars"})
    marks = scan_secrets(docs, repo, owner).select(
        F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.filter("hits", lambda h: h["verdict"] != "example").alias("_hits")
    ).where(F.size("_hits") > 0).distinct()
    text = F.coalesce("text", F.lit(""))
    joined = docs.withColumn("_th", F.xxhash64(text)).join(marks, same(("doc_id", "_d"), ("_th", "_t")), "left")
    part = F.aggregate(
        "_hits", F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, h: F.struct(
            F.when(h["start"] >= acc["at"], F.concat(
                acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), (h["start"] - acc["at"]).cast("int")),
                F.lit("<"), h["kind"], F.lit(">"))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], h["end"]).alias("at")),
    )
    masked = joined.withColumn("_part", part).withColumn("_text", F.when(F.col("_hits").isNull(), F.col("text")).otherwise(
        F.concat(F.col("_part.done"), F.substring(text, (F.col("_part.at") + 1).cast("int"), F.length(text)))))
    chars = F.length("_text").cast("long")
    return masked.select(*[
        F.col("_text").alias("text") if c == "text" else
        (F.when(F.col("_hits").isNull(), F.col(c)).otherwise(chars).alias(c) if c == "n_chars" else F.col(f"`{c}`")) for c in docs.columns
    ]).toDF(*given)
