"""BPE encoding by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import sha256

MEMO = 700_000  # words, and as many pieces, whose ids a Python worker keeps; a memo starts anew beyond
INNER = "\x1c\x1d\x1e\x1f"
FINAL = 256  # the last byte of a piece is a symbol of its own, as it carries the end-of-word mark


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Encoder:
    """One tokenizer file of the kind: NFC, lower case, split by pattern, bytes, BPE with an end-of-word suffix.

    Texts of pieces are strings of symbols: byte b inside a piece is chr(b), as its last byte chr(FINAL + b).
    ``pairs`` is the compatibility table: whether two tokens next to each other are what the merge rules make of their
    symbols. A piece's tokens are right exactly if each neighbouring pair is compatible, so the encoder takes the
    longest match at each place, falls back to the next shorter one where a pair is not compatible, and marks places
    from which no way leads on, each at most once.
    """

    def __init__(self, spec: dict):
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("not a byte-level BPE with word ends")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        value = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            body = token[: -len(suffix)] if token.endswith(suffix) and len(token) > len(suffix) else token
            bs = [value[c] for c in body]
            return "".join(map(chr, bs[:-1])) + chr(bs[-1] + (FINAL if body is not token else 0))

        self.ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.text = {i: s for s, i in self.ids.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault((symbols(a), symbols(b)), n)
        self.matcher = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.matcher.add_word(s, (i, len(s)))
        self.matcher.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"), regex.V0).findall
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        # decoding: all token names with a space after each, one after another, and where each starts
        top = max(names) + 1
        tokens = [names.get(i, "").encode() + b" " for i in range(top)]
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def merged(self, symbols: str) -> list[str]:
        """What the merge rules make of a few symbols; fills the compatibility table."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a; with a = -1, whether b may start a piece, that is, whether the rules make it at all."""
        parts = [self.text[a], self.text[b]] if a >= 0 else [self.text[b]]
        known = self.pairs[a, b] = self.merged("".join(parts)) == parts
        return known

    def encode_symbols(self, s: str) -> list[int]:
        n = len(s)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # tokens and ends at each place, shortest first
        for last, (token, length) in self.matcher.iter(s):
            starts[last + 1 - length].append((token, last + 1))
        pairs, dead = self.pairs.get, bytearray(n + 1)
        path, places, choices, at, left = [-1], [], [], 0, len(starts[0])
        while at < n:
            tokens, before = starts[at], path[-1]
            while left:
                left -= 1
                token, end = tokens[left]
                if dead[end]:
                    continue
                fits = pairs((before, token))
                if fits or fits is None and self.compatible(before, token):
                    path.append(token)
                    places.append(at)
                    choices.append(left)
                    at, left = end, len(starts[end])
                    break
            else:
                if not places:
                    raise ValueError("no tokens cover the piece")
                dead[at] = 1
                path.pop()
                at, left = places.pop(), choices.pop()
        return path[1:]

    def encode_piece(self, piece: str) -> bytes:
        known = self.memo.get(piece)
        if known is None:
            b = piece.encode()
            ids = self.encode_symbols(b[:-1].decode("latin-1") + chr(FINAL + b[-1]))
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.memo[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # one character at a time where a capital sigma's lower case would depend on its place
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        if any(c in text for c in INNER):  # separators that split() takes for spaces and the pattern does not
            return b"".join(map(self.encode_piece, self.pieces(text)))
        found, words = text.split(), self.words  # pieces do not cross spaces
        try:
            return b"".join(map(words.__getitem__, found))
        except KeyError:
            if len(words) > MEMO:
                words.clear()
            for word in found:
                if word not in words:
                    words[word] = b"".join(map(self.encode_piece, self.pieces(word)))
            return b"".join(map(words.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.specials is None or "<|" not in text and not self.specials.search(text):
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.encode_plain(text[at: m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> Iterator[bytes]:
        """Token names joined by spaces, copied block by block from the offset table."""
        for i in range(0, len(ids), block):
            part = ids[i: i + block].astype(np.int64)
            lengths = self.starts[part + 1] - self.starts[part]
            ends = np.cumsum(lengths)
            out = self.letters[np.arange(ends[-1]) + np.repeat(self.starts[part] - (ends - lengths), lengths)].tobytes()
            yield out if i + block < len(ids) else out[:-1]


_encoders: dict[str, Encoder] = {}


def encoder_for(key: str, spec_text: str) -> Encoder:
    """One encoder per worker and file; its memo lives as long as the worker."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(json.loads(spec_text))
    return _encoders[key]


def encode_texts(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text; with ``keep_ids`` also the ids.

    ``tokenizer`` is the path of a tokenizer file, read by the driver and broadcast (its size is fixed). Null or empty
    texts have no tokens and decode to empty text. The decoded text is the token names joined by single spaces, as the
    file has no decoder. Strings of special tokens in a text become these tokens. Repeated rows all stay and agree;
    empty tables give no rows; further columns are ignored. ``ids`` are little-endian 32-bit integers in a binary.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    key, shared = sha256(spec.encode()), docs.sparkSession.sparkContext.broadcast(spec)

    def encoded(batches):
        import hashlib

        encoder = encoder_for(key, shared.value)
        for batch in batches:
            texts = batch.column("text")
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                counts, id_hashes, text_hashes, kept = [], [], [], []
                for text in texts.slice(start, 64).to_pylist():
                    ids = encoder.encode(text or "")
                    counts.append(len(ids) // 4)
                    id_hashes.append(sha256(ids))
                    h = hashlib.sha256()
                    for piece in encoder.decode(np.frombuffer(ids, "<u4")):
                        h.update(piece)
                    text_hashes.append(h.hexdigest())
                    kept.append(ids)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(text_hashes)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        encoded, schema + (", ids binary" if keep_ids else "")
    )
