"""Byte-level BPE by prefix dynamic programming, with exact appends and edits.

Every prefix of a pre-token's bytes has one last token in its encoding: the token t
that ends the prefix for which (last token of the prefix before t, t) is itself how
BPE encodes the bytes of the two together. A table keeps that last token for each
prefix. It is filled from left to right, from the vocabulary's tokens that end at
each byte (found by an automaton), and is read backwards for the ids.

Since an entry depends on what is before it only, appended bytes extend the table and
nothing in it changes. An edit takes back the pre-tokens that it touches, splits from
there on until a border of the old pre-tokens comes again, and keeps the rest.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.bpe import pieces_of
from vigilake.llm.common import per_document
from vigilake.session import ship

#: Distinct pre-tokens that one worker remembers; pre-tokens of a text held at a time.
CACHE, BATCH = 150_000, 100_000
#: Characters of a text whose pre-tokens are listed at once.
WHOLE = 1 << 20
#: Pairs of tokens whose compatibility one worker remembers.
PAIRS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(spec: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in spec.splitlines() if line.strip())}


class PrefixCodec:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, spec: str, pattern: str, cache: int = CACHE):
        import ahocorasick
        import regex

        self.ranks = read_ranks(spec)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = cache
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            # A token that its own bytes do not give is in no encoding but as a whole pre-token.
            if len(token) == 1 or self._merged(token) == [rank]:
                self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self.longest = max(map(len, self.ranks))

    def _merged(self, raw: bytes) -> list[int]:
        """Merges of the lowest rank first: of a token's or two tokens' bytes only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, at = min(found)
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, a: int, b: int) -> bool:
        """Whether the bytes of the two tokens together are encoded as just these two."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fits = self.pairs[a << 32 | b] = self._merged(self.token[a] + self.token[b]) == [a, b]
        return fits

    def extend(self, raw: bytes, last: list, widths: list) -> None:
        """Fills the table of `raw` from where it ends: last[i] is the last token of the
        first i + 1 bytes, widths[i] its length."""
        done = len(last)
        start = max(0, done - self.longest + 1)
        pairs, follows = self.pairs, self._follows
        # The tokens that end at a byte come together; each byte is a token, so one of them fits.
        for end, (width, rank) in self.ends.iter(raw[start:].decode("latin-1")):
            end += start
            if end < done:
                continue
            if end >= width:
                before = last[end - width]
                fits = pairs.get(before << 32 | rank)
                if fits is None:
                    fits = follows(before, rank)
                if not fits:
                    continue
            last.append(rank)
            widths.append(width)
            done += 1
        if done != len(raw):
            raise ValueError("the ranks do not encode every byte")

    def ids_of(self, last: list, widths: list) -> list[int]:
        """Reads the table backwards."""
        out, at = [], len(last) - 1
        while at >= 0:
            out.append(last[at])
            at -= widths[at]
        out.reverse()
        return out

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None:
            return array("I", [whole]).tobytes()
        last, widths = [], []
        self.extend(raw, last, widths)
        return array("I", self.ids_of(last, widths)).tobytes()

    def encoded(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian 32-bit integers. A full cache becomes the
        older generation, from which pre-tokens still in use come back."""
        if len(self.cache) > self.most:
            self.older, self.cache = self.cache, {}
        for piece in set(pieces).difference(self.cache):
            got = self.older.get(piece)
            self.cache[piece] = self._piece(piece) if got is None else got
        return b"".join(map(self.cache.__getitem__, pieces))

    def split(self, text: str, start: int = 0) -> Iterator[tuple[int, str]]:
        """Ends and pre-tokens of the text from a border on; characters that the pattern
        does not match are in none, as in the library."""
        for m in self.pattern.finditer(text, start):
            yield m.end(), m.group()

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of a text in pieces, so that a long one is never held whole as lists."""
        if len(text or "") <= WHOLE:
            if text:
                yield np.frombuffer(self.encoded(self.pattern.findall(text)), "<u4")
            return
        found = self.pattern.finditer(text)
        while pieces := [m.group() for m in islice(found, BATCH)]:
            yield np.frombuffer(self.encoded(pieces), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


class PrefixTable:
    """A text with its pre-tokens and their tables of last tokens, open to edits.

    `settled` counts the table entries that the last change computed."""

    def __init__(self, codec: PrefixCodec, text: str = ""):
        self.codec, self.text, self.settled = codec, "", 0
        self.borders: list[int] = []
        self.tables: list[tuple[bytes, list, list]] = []
        self.append(text)

    def _table(self, piece: str, base: tuple[bytes, list, list] | None) -> tuple[bytes, list, list]:
        raw = piece.encode("utf-8", "replace")
        last, widths = [], []
        if base is not None:  # the bytes that the old table has in common
            same, most = 0, min(len(raw), len(base[0]))
            while same < most and raw[same] == base[0][same]:
                same += 1
            last, widths = base[1][:same], base[2][:same]
        self.settled += len(raw) - len(last)
        self.codec.extend(raw, last, widths)
        return raw, last, widths

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, by: str) -> None:
        """Puts `by` in place of characters start to end. Pre-tokens that end before the
        one that the edit touches stay; so do those after the first common border, since
        the pattern looks ahead only."""
        self.settled = 0
        shift, old = len(by) - (end - start), self.borders
        self.text = self.text[:start] + by + self.text[end:]
        # The pattern looks one character ahead, so the pre-token that ends just before is open too.
        keep = max(0, bisect_left(old, start) - 1)
        base = self.tables[keep : keep + 2]
        borders, tables = old[:keep], self.tables[:keep]
        rest = bisect_right(old, end)
        for n, (stop, piece) in enumerate(self.codec.split(self.text, borders[-1] if borders else 0)):
            borders.append(stop)
            tables.append(self._table(piece, base[n] if n < len(base) else None))
            if stop > start + len(by):
                at = bisect_left(old, stop - shift, rest)
                if at < len(old) and old[at] == stop - shift:
                    borders += [b + shift for b in old[at + 1 :]]
                    tables += self.tables[at + 1 :]
                    break
        self.borders, self.tables = borders, tables

    def ids(self) -> list[int]:
        out: list[int] = []
        for raw, last, widths in self.tables:
            whole = self.codec.ranks.get(raw)
            out += [whole] if whole is not None else self.codec.ids_of(last, widths)
        return out


_CODECS: dict[str, PrefixCodec] = {}


def codec(spec: str, pattern: str) -> PrefixCodec:
    """One codec per worker process and file, so that its caches live on between tasks."""
    key = hashlib.sha256(f"{pattern}\0{spec}".encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PrefixCodec(spec, pattern)
    return _CODECS[key]


def _shared(rows: DataFrame, path: str | None):
    """The file of ranks, read once by the driver and broadcast (under 1 MB)."""
    ship(rows.sparkSession)
    with open(path or default_path(), encoding="ascii") as f:
        return rows.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    Encodes the whole text, then decodes the ids. Null text is the empty text: no ids
    and the digests of nothing. Repeated rows come out alike; an empty table gives an
    empty result; other columns are not read. Memory is bounded by the longest text.
    """
    spec, pattern = _shared(docs, path), pattern or default_pattern()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(spec.value, pattern)
        for batch in pieces_of(batches):
            counts, hashes, decoded, ids = [], [], [], []
            for text in batch["text"]:
                n, of_ids, of_text, kept = 0, hashlib.sha256(), hashlib.sha256(), [np.empty(0, "<u4")]
                for piece in c.encode(text):
                    n += len(piece)
                    of_ids.update(piece)
                    of_text.update(c.decode(piece))
                    if with_ids:
                        kept.append(piece)
                counts.append(n)
                hashes.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
                if with_ids:
                    ids.append(np.concatenate(kept).astype(np.int32))
            out = pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_tokens": counts, "ids_sha256": hashes, "decoded_sha256": decoded})
            yield out.assign(ids=ids) if with_ids else out

    return per_document(docs.select("doc_id", "text"), run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give null text, no ids the empty text,
    bytes that are no UTF-8 the replacement character; repeated rows come out alike; an
    empty table gives an empty result."""
    spec, pattern = _shared(tokens, path), pattern or default_pattern()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(spec.value, pattern)
        for batch in batches:
            texts = [None if ids is None else c.decode(list(ids)).decode("utf-8", "replace") for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return per_document(tokens.select("doc_id", "ids"), run, "text string")


def re_encode(edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text, start, stop, replacement) -> (doc_id, text, ids, n_settled).

    Replaces characters start to stop of each text and encodes the result from the
    table of the old text: n_settled entries are new, all others are reused. A start
    at the text's end appends. Null texts and replacements are empty; a null start
    stands for the end of the text, a null stop for start, and places beyond the text
    for its end. Repeated rows come out alike; an empty table gives an empty result.
    """
    spec, pattern = _shared(edits, path), pattern or default_pattern()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(spec.value, pattern)
        for batch in pieces_of(batches):
            out = []
            for row in batch.itertuples(index=False):
                table = PrefixTable(c, row.text)
                start = min(row.start, len(row.text))
                table.replace(start, min(max(row.stop, start), len(row.text)), row.replacement)
                out.append((row.doc_id, table.text, np.array(table.ids(), np.int32), table.settled))
            yield pd.DataFrame(out, columns=["doc_id", "text", "ids", "n_settled"])

    end = F.greatest(F.lit(0), F.coalesce(F.col("start"), F.length("text"), F.lit(0))).cast("long")
    rows = edits.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), end.alias("start"), F.coalesce(F.col("stop").cast("long"), end).alias("stop"),
        F.coalesce("replacement", F.lit("")).alias("replacement"))
    return per_document(rows, run, "text string, ids array<int>, n_settled long")
