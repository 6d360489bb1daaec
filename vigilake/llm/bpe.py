"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so
every occurrence of it in a text is a certain token boundary. Texts are cut
there, the fragments are encoded independently by the tokenizers library (each
distinct fragment once per cache), and their ids are concatenated.

The pre-tokenizer of a byte-level model looks one step beyond a run of white
space and treats an apostrophe with the letters after it, so no cut is made
after white space or before an apostrophe; nor inside a UTF-8 character. The
pairs inside added tokens count as occurring, which keeps those tokens whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import per_document
from vigilake.session import ship

#: Fragments that one worker remembers, and bytes of text that it cuts at a time.
CACHE = 100_000
WINDOW = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ForcedBoundaryCodec:
    """Encoder and decoder for one byte-level BPE file."""

    def __init__(self, spec: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        pre = parsed.get("pre_tokenizer") or {}
        if parsed.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("forced boundaries are proven for byte-level BPE without normalizer or prefix space only")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        chars = byte_characters()
        added = {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
        pieces = {i: bytes(chars[c] for c in token) for token, i in parsed["model"]["vocab"].items() if i not in added} | added
        listed = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.bytes, self.lengths = np.frombuffer(b"".join(listed), np.uint8), np.array([len(p) for p in listed])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.merges, self.shown = self.tokenizer.model.tokenize, {b: c for c, b in chars.items()}
        self.forced = self._forced(pieces.values())
        self.cache, self.older, self.most = {}, {}, cache

    @staticmethod
    def _forced(pieces) -> np.ndarray:
        """For each byte pair (first * 256 + second) whether it marks a cut."""
        cut = np.ones((256, 256), bool)
        for piece in pieces:
            b = np.frombuffer(piece, np.uint8)
            cut[b[:-1], b[1:]] = False
        cut[:, 0x80:0xC0] = False  # inside a character
        cut[:, ord("'")] = False
        # ASCII white space, and each byte that ends another white space character.
        cut[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], :] = False
        return cut.reshape(-1)

    def _ends(self, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Ends of the fragments of joined texts; `edges` are the texts' ends."""
        mark = np.zeros(len(b), bool)
        if len(b) > 1:
            mark[1:] = self.forced[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        mark[edges[edges < len(b)]] = True
        return np.append(np.flatnonzero(mark[1:]) + 1, len(b))

    def _windows(self, raw: bytes) -> Iterator[bytes]:
        """A long text's bytes in pieces of about WINDOW that end at certain cuts."""
        start, none = 0, np.empty(0, np.int64)
        while len(raw) - start > WINDOW:
            size = WINDOW
            ends = self._ends(np.frombuffer(raw[start : start + size], np.uint8), none)[:-1]
            while not len(ends) and start + size < len(raw):
                size *= 2
                ends = self._ends(np.frombuffer(raw[start : start + size], np.uint8), none)[:-1]
            end = start + int(ends[-1]) if len(ends) else len(raw)
            yield raw[start:end]
            start = end
        if start < len(raw):
            yield raw[start:]

    def _know(self, keys: list[bytes]) -> None:
        """Makes the cache hold every fragment of `keys`. A full cache becomes the
        older generation, from which fragments still in use come back."""
        if len(self.cache) > self.most:
            self.older, self.cache = self.cache, {}
        unknown = set(keys).difference(self.cache)
        back = unknown.intersection(self.older)
        for key in back:
            self.cache[key] = self.older[key]
        rest = []
        for key in unknown - back:
            word = key.decode("utf-8")
            if word.isalpha() or (word[0] == " " and word[1:].isalpha()):  # one pre-token: straight to the merges
                self.cache[key] = array("I", [t.id for t in self.merges(key.decode("latin-1").translate(self.shown))]).tobytes()
            else:
                rest.append((key, word))
        for (key, _), got in zip(rest, self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False), strict=True):
            self.cache[key] = array("I", got.ids).tobytes()

    def _ids(self, raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of joined texts, and where each text's ids end.

        Equal fragments are found by a hash of their bytes (differences of one
        running sum) and compared byte by byte, so the library and the cache see
        each distinct fragment of the window once.
        """
        b = np.frombuffer(raw, np.uint8)
        ends = self._ends(b, edges)
        starts = np.append(0, ends[:-1])
        with np.errstate(over="ignore"):
            power, inverse = _powers(len(b) + 1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_SALT[b] * power[:-1], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        codes, distinct = pd.factorize(hashes.view(np.int64))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        model = _spread(starts[first][codes], ends - starts)
        if not ((ends - starts) == (ends - starts)[first][codes]).all() or not (b[model] == b).all():  # two fragments of one hash
            codes, first = np.arange(len(codes)), np.arange(len(codes))
        keys = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self._know(keys)
        values = [self.cache[k] for k in keys]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        counts = sizes[codes]
        ids = np.frombuffer(b"".join(values), "<u4")[_spread((np.cumsum(sizes) - sizes)[codes], counts)]
        upto = np.append(0, np.cumsum(counts))
        return ids, upto[np.searchsorted(ends, edges, "right")]

    def encode(self, texts: list[str | None]) -> Iterator[list[np.ndarray]]:
        """For each text its ids, as a list of arrays (more than one for long texts)."""
        held: list[bytes] = []
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            if held and sum(map(len, held)) + len(raw) > WINDOW:
                yield from self._flush(held)
                held = []
            if len(raw) > WINDOW:
                yield [self._ids(w, np.array([len(w)]))[0] for w in self._windows(raw)]
            else:
                held.append(raw)
        yield from self._flush(held)

    def _flush(self, held: list[bytes]) -> Iterator[list[np.ndarray]]:
        edges = np.cumsum([len(h) for h in held], dtype=np.int64)
        if not len(edges) or not edges[-1]:
            yield from ([] for _ in held)
            return
        ids, upto = self._ids(b"".join(held), edges)
        start = 0
        for end in upto.tolist():
            yield [ids[start:end]] if end > start else []
            start = end

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded ids; bytes that are no UTF-8 become U+FFFD."""
        raw = self.bytes[_spread(self.offsets[ids], self.lengths[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode("utf-8")


_SALT = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(max(n, WINDOW + 1) - 1, x, np.uint64))) for x in (base, pow(base, -1, 2**64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same for the next."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


_CODECS: dict[str, ForcedBoundaryCodec] = {}


def codec(spec: str) -> ForcedBoundaryCodec:
    """One codec per worker process and file, so that its cache lives on between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ForcedBoundaryCodec(spec)
    return _CODECS[key]


def shared_spec(docs: DataFrame, path: str):
    """The tokenizer file, read once by the driver and broadcast (a few MB)."""
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def id_width(spec: str, *more: int) -> int:
    """Bytes that hold every id of a tokenizer file, 2 or 4."""
    parsed = json.loads(spec)
    ids = [*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"]), *more]
    return 2 if max(ids) < 1 << 16 else 4


def pieces_of(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches in pieces of a few rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    Encodes the whole text, then decodes the ids. Null text is the empty text: no
    ids and the digests of nothing. Repeated rows come out alike; an empty table
    gives an empty result. Memory is bounded by the longest text and its ids.
    """
    spec = shared_spec(docs, path or default_path())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(spec.value)
        for batch in pieces_of(batches):
            counts, hashes, decoded, ids = [], [], [], []
            for pieces in c.encode(batch["text"].tolist()):
                of_ids, of_text = hashlib.sha256(), hashlib.sha256()
                for piece in pieces:
                    of_ids.update(piece.tobytes())
                    of_text.update(c.decode(piece))
                counts.append(sum(map(len, pieces)))
                hashes.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
                if with_ids:
                    ids.append(np.concatenate([np.empty(0, "<u4"), *pieces]).astype(np.int32))
            out = pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_tokens": counts, "ids_sha256": hashes, "decoded_sha256": decoded})
            yield out.assign(ids=ids) if with_ids else out

    return per_document(docs.select("doc_id", "text"), run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give null text, no ids the empty text;
    repeated rows come out alike; an empty table gives an empty result."""
    spec = shared_spec(tokens, path or default_path())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(spec.value)
        for batch in batches:
            texts = [None if ids is None else c.decode(np.asarray(ids, np.int64)).decode("utf-8") for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return per_document(tokens.select("doc_id", "ids"), run, "text string")
