"""Alignment of two tokenizers by segment deduplication.

A text, with a space before it, is cut before every run of white space that begins
with a space, where that is proven to change neither tokenizer's ids: the byte-level
pre-tokenizer (A) starts a match there, and no entry of either vocabulary holds a
space after another character, so nothing merges across. Equal segments have equal
ids and an equal alignment, so each distinct segment is tokenised and aligned once.

Documents are dealt to blocks of some MB of text. A block is written as its list of
distinct segments and, per document, the numbers of its segments. So a frequent
segment is moved once a block, not once a place. A shuffle by segment brings the
blocks' copies of it together; it is tokenised and aligned once there, and the
alignment goes back to the blocks, where documents are composed of them. How many
documents hold a linked id pair is counted in blocks, then over all blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.bpe import _spread, byte_characters
from vigilake.session import cut, ship

#: Characters of text of a block; a longer text is a block by itself.
BLOCK = 16_000_000
#: Segments tokenised at a time.
BATCH = 5_000
#: Before a run of white space that begins with a space and is not the text's last character.
BORDER = re.compile(r"(?<=\S)(?= .)", re.S)
#: Segments whose groups are written out at a time.
TEXTS = 50_000
#: What follows a token's id in the text of groups: a token of its side, the other side
#: of its group, the next group.
AFTER = np.frombuffer(b",|;", np.uint8)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Two tokenizers, the bytes of their entries, and the alignment of a segment."""

    def __init__(self, spec: str, model: bytes):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        chars, parsed = byte_characters(), json.loads(spec)
        special = {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
        self.a_bytes = {i: bytes(chars[c] for c in token) for token, i in parsed["model"]["vocab"].items() if i not in special} | special
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        #: How ids are packed.
        self.code = "<u2" if max(len(self.a_sizes), len(self.b_sizes)) <= 1 << 16 else "<u4"
        pre = parsed.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not parsed.get("normalizer")
        over = re.compile(r"\S ")
        entries = [*(t for i, t in self.a_bytes.items() if i not in special), *self.b_bytes]
        apart = not any(over.search(t.decode("utf-8", "replace")) for t in entries)
        spaced = b"".join(self.b_bytes[i] for i in self.b.encode("  a a"))  # it adds one space and keeps the others
        #: Whether the cuts are proven; if not, every text is one segment.
        self.proven = plain and apart and spaced == b"   a a"

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def segments(self, text: str | None) -> list[str]:
        """The segments of space + text, each without its first character, a space."""
        if not text:
            return []
        if not self.proven:
            return [text]
        parts = text.split(" ")
        if all(w and not w[-1].isspace() for w in set(parts[:-1])) and parts[-1]:
            return parts  # no run of more than one white space character begins with a space
        return [s[1:] for s in BORDER.split(f" {text}")]

    def align(self, segments: list[str]) -> list[bytes]:
        """The packed alignment of each segment: its ids in the order of its groups, those of
        A first, then for each what follows it; nothing if a tokenizer does not give back
        the segment's bytes. Segments that end in a plain character are tokenised as one
        text, which by the proof comes to the same."""
        out: list[bytes] = [b""] * len(segments)
        alone = [i for i, s in enumerate(segments) if not self.proven or not s or s[-1].isspace() or "▁" in s]
        apart = set(alone)
        joined = [i for i in range(len(segments)) if i not in apart]
        if joined and not self._pack(segments, joined, out):
            alone += joined
        for i in alone:
            self._pack(segments, [i], out)
        return out

    def _pack(self, segments: list[str], chosen: list[int], out: list[bytes]) -> bool:
        """Tokenises and aligns the chosen segments as one text; False if their bytes do
        not come back."""
        text = "".join([" " + segments[i] for i in chosen])
        raw = text.encode("utf-8", "replace")
        ids_a = self.a.encode(text, add_special_tokens=False).ids
        ids_b = self.b.encode(text[1:])  # which adds the space that is left out
        if b"".join(map(self.a_bytes.__getitem__, ids_a)) != raw or b"".join(map(self.b_bytes.__getitem__, ids_b)) != raw:
            return False
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([1 + len(segments[i].encode("utf-8", "replace")) for i in chosen])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        upto_a, upto_b = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
        at_a = np.arange(len(a)) + np.append(0, upto_b)[np.searchsorted(both, ends_a)]
        at_b = np.arange(len(b)) + upto_a[np.searchsorted(both, ends_b)]
        ids, after = np.empty(len(a) + len(b), self.code), np.zeros(len(a) + len(b), np.uint8)
        ids[at_a], ids[at_b] = a, b
        after[at_a[upto_a - 1]], after[at_b[upto_b - 1]] = 1, 2
        own = np.searchsorted(both, ends)
        upto = np.append(0, upto_a[own] + upto_b[own]).tolist()
        ids, after, width = ids.tobytes(), after.tobytes(), ids.itemsize
        for k, i in enumerate(chosen):
            out[i] = ids[width * upto[k] : width * upto[k + 1]] + after[upto[k] : upto[k + 1]]
        return True


_PAIRS: dict[str, Pair] = {}


def pair(spec: str, model: bytes) -> Pair:
    """One pair per worker process and files."""
    key = hashlib.sha256(spec.encode() + b"\0" + model).hexdigest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(spec, model)
    return _PAIRS[key]


def _shared(docs: DataFrame, paths: tuple[str, str] | None):
    """Both files, read once by the driver and broadcast (a few MB)."""
    ship(docs.sparkSession)
    a, b = paths or default_paths()
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))


BLOCKED = "block long, doc_id string, seq binary, first int, segs array<string>"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: small ones are frequent."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def blocked(docs: DataFrame, files) -> DataFrame:
    """Written rows of two kinds: (block, doc_id, seq) of a document, whose segments are
    the numbers in seq, and (block, first, segs) of segments of the block, numbered from
    `first` on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, size = pair(*files.value), 0
        block, numbers = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            ids, seqs = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if size and size + len(text or "") > BLOCK:
                    yield from out(block, ids, seqs, numbers)
                    block, numbers, ids, seqs, size = block + 1, {}, [], [], 0
                found = p.segments(text)
                for s in set(found).difference(numbers):
                    numbers[s] = len(numbers)
                ids.append(doc_id)
                seqs.append(_packed(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))))
                size += len(text or "")
            yield from out(block, ids, seqs, {})
        yield from out(block, [], [], numbers)

    def out(block: int, ids: list, seqs: list, numbers: dict) -> Iterator[pd.DataFrame]:
        for k in range(0, len(ids), 500):
            yield pd.DataFrame({"block": block, "doc_id": ids[k : k + 500], "seq": seqs[k : k + 500], "first": None, "segs": None}).astype({"first": "Int32"})
        segs = list(numbers)
        for k in range(0, len(segs), 2_000):
            yield pd.DataFrame({"block": [block], "doc_id": [None], "seq": [None], "first": np.array([k], np.int32), "segs": [segs[k : k + 2_000]]})

    return cut(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, BLOCKED), "blocks")


def aligned_segments(segments: DataFrame, files) -> DataFrame:
    """(block, at, seg) -> (home, at, alignment): rows of one segment meet in one task, in
    order, and are aligned together; there is a row for each block, however often it
    holds the segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, last, packed = pair(*files.value), None, b""
        for batch in batches:
            codes, distinct = pd.factorize(batch["seg"])
            found = [packed] if len(distinct) and distinct[0] == last else []
            for k in range(len(found), len(distinct), BATCH):
                found += p.align(distinct[k : k + BATCH].tolist())
            if len(distinct):
                last, packed = distinct[-1], found[-1]
            yield pd.DataFrame({"home": batch["block"], "at": batch["at"], "alignment": list(map(found.__getitem__, codes.tolist()))})

    return segments.repartition("seg").sortWithinPartitions("seg").mapInPandas(run, "home long, at int, alignment binary")


COMPOSED_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("links", pa.binary()),
    ("at", pa.int32()), ("link", pa.int64()), ("documents", pa.int64())])
COMPOSED = ("block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, "
    "at int, link long, documents long")  # fmt: skip


def _rows(schema: pa.Schema, n: int, columns: dict) -> pa.Table:
    """A table of the schema; columns that are not given are null."""
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


@dataclass(frozen=True)
class Sizes:
    """Bytes of each entry of both vocabularies, and how ids are packed. A link is id of A
    << 32 | id of B."""

    a: np.ndarray
    b: np.ndarray
    code: str


def _texts(ids: np.ndarray, after: np.ndarray, n_tokens: np.ndarray) -> list[bytes]:
    """The groups of each segment as text, each with what follows it."""
    most = int(ids.max()) + 1 if len(ids) else 1
    words = [b"%d," % i for i in range(most)]
    lengths = np.fromiter(map(len, words), np.int64, most)
    table, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
    out, upto = [], np.append(0, np.cumsum(n_tokens))
    for k in range(0, len(n_tokens), TEXTS):
        one = upto[k : k + TEXTS + 1]
        some = ids[one[0] : one[-1]]
        ends = np.append(0, np.cumsum(lengths[some]))
        flat = table[_spread(offsets[some], lengths[some])]
        flat[ends[1:] - 1] = AFTER[after[one[0] : one[-1]]]
        raw, cuts = flat.tobytes(), ends[one - one[0]].tolist()
        out += [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
    return out


def compose(block: int, docs: pa.Table, segs: pa.Table, sizes_of: Sizes, with_groups: bool) -> pa.Table:
    """One block's documents from the alignments of its segments, and per id pair linked
    in it (numbered by `at`) how many of its documents hold it."""
    order = np.argsort(segs["at"].to_numpy())
    column = segs["alignment"].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    data, ends = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    begins, width = ends[:-1][order].astype(np.int64), np.dtype(sizes_of.code).itemsize
    n_tokens = (ends[1:][order] - begins) // (width + 1)
    ids = data[_spread(begins, n_tokens * width)].view(sizes_of.code)
    after = data[_spread(begins + n_tokens * width, n_tokens)]
    groups, of, n = _texts(ids, after, n_tokens), np.repeat(np.arange(len(n_tokens), dtype=np.int32), n_tokens), len(n_tokens)
    of_b = np.cumsum(after == 1) - (after == 1) > np.cumsum(after == 2) - (after == 2)
    a, b = ids[~of_b], ids[of_b]
    per = lambda segments: np.bincount(segments, minlength=n)
    counts = {"n_a": per(of[~of_b]), "n_b": per(of[of_b]), "n_groups": per(of[after == 2])}
    # Between two ends that follow each other lies the overlap of one pair of tokens.
    ends_a, ends_b = np.cumsum(sizes_of.a[a]), np.cumsum(sizes_of.b[b])
    points = np.union1d(ends_a, ends_b)
    of_a = np.searchsorted(ends_a, points)
    ok, sizes = n_tokens > 0, per(of[~of_b][of_a])
    starts = np.cumsum(sizes) - sizes
    pairs, which = np.unique(a[of_a].astype(np.int64) << 32 | b[np.searchsorted(ends_b, points)], return_inverse=True)
    which, holding = which.astype(np.int32), np.zeros(len(pairs), np.int64)
    out: dict[str, list] = {c: [] for c in (*counts, "n_links", "groups_sha256", "links")}
    texts, none = [], np.empty(0, np.int32)
    for seq in map(_unpacked, docs["seq"].to_pylist()):
        size = len(seq)
        good = bool(size) and bool(ok[seq].all())
        text, found, times = b"", none, none
        if good:
            text = b"".join(map(groups.__getitem__, seq.tolist()))[:-1]
            used, often = np.unique(seq, return_counts=True)
            found, back = np.unique(which[_spread(starts[used], sizes[used])], return_inverse=True)
            times = np.bincount(back, weights=np.repeat(often, sizes[used])).astype(np.int32)
            holding[found] += 1
        for c, values in counts.items():
            out[c].append(int(values[seq].sum()) if good else 0)
        out["n_links"].append(int(times.sum()))
        out["groups_sha256"].append(hashlib.sha256(text).hexdigest() if good else "")
        out["links"].append(_packed(np.concatenate([np.diff(found, prepend=0), times - 1])) if good else b"")
        if with_groups:
            texts.append(text.decode())
    held, schema = np.flatnonzero(holding), COMPOSED_ARROW
    more = {"groups": texts} if with_groups else {}
    rows = _rows(schema, len(docs), {"block": np.full(len(docs), block), "doc_id": docs["doc_id"].combine_chunks(), **out, **more})
    return pa.concat_tables([rows, _rows(schema, len(held), {"block": np.full(len(held), block), "at": held.astype(np.int32), "link": pairs[held], "documents": holding[held]})])


def settled(df: DataFrame, name: str) -> DataFrame:
    """`cut`, whose shuffle files go once the table is written: what is shuffled here is
    as large as the texts."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return cut(df, name)
    finally:
        conf.set(key, before)


def composed(docs: DataFrame, paths: tuple[str, str] | None, with_groups: bool) -> DataFrame:
    """Written rows of two kinds: of documents, with their id pairs by number, and of the
    id pairs of each block."""
    files = _shared(docs, paths)
    own_pair = pair(*files.value)
    sizes = docs.sparkSession.sparkContext.broadcast(Sizes(own_pair.a_sizes, own_pair.b_sizes, own_pair.code))
    rows = blocked(docs, files)
    each = rows.where("segs is not null").select("block", "first", F.posexplode("segs").alias("n", "seg"))
    back = aligned_segments(each.select("block", (F.col("first") + F.col("n")).alias("at"), "seg"), files)
    own = rows.where("seq is not null").select("block", "doc_id", "seq")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return compose(key[0].as_py(), left, right, sizes.value, with_groups)

    return settled(own.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(run, COMPOSED), "composed")


def vocabulary_links(rows: DataFrame) -> DataFrame:
    """Composed rows -> per linked id pair: link, a_id, b_id, documents, best (whether no
    pair of its A id is held by more documents). Written; a row for each pair."""
    summed = rows.where("link is not null").groupBy("link").agg(F.sum("documents").alias("documents"))
    a, b = F.shiftright("link", 32), F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    summed = settled(summed.select("link", a.cast("int").alias("a_id"), b.cast("int").alias("b_id"), "documents"), "links")
    most = summed.groupBy("a_id").agg(F.max("documents").alias("most"))
    return summed.join(most, "a_id").select("link", "a_id", "b_id", "documents", (F.col("documents") == F.col("most")).alias("best"))


def links(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """a_id, b_id, documents, best of every id pair that documents hold linked. Null and
    empty texts link nothing; repeated rows count each; an empty table has no pairs."""
    return vocabulary_links(composed(docs, paths, False)).drop("link")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 (and the groups as text).

    Texts that are null or empty, or that a tokenizer does not give back byte by byte,
    have no tokens: zeros and no digest. A row is a document, so repeated rows count
    each and come out alike; a null id is an id like others; an empty table gives an
    empty result; other columns are not read. Memory is bounded by a block's text and
    segments, or the longest text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = composed(docs, paths, with_groups)
    counted = vocabulary_links(rows)
    back = rows.where("link is not null").select("block", "at", "link").join(counted.select("link", "documents", "best"), "link").select(
        F.col("block").alias("home"), "at", "documents", "best")
    own = rows.where("n_a is not null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "links")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["at"].to_numpy()
        n = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
        best = np.zeros(len(n), np.int64)
        n[at], best[at] = right["documents"].to_numpy(), right["best"].to_numpy()
        sums: dict[str, list] = {"n_best": [], "count_sum": []}
        for packed in left["links"].to_pylist():
            places, times = np.split(_unpacked(packed), 2) if packed else (np.empty(0, np.int64), np.empty(0, np.int64))
            places, times = np.cumsum(places), times + 1
            sums["n_best"].append(int(times[best[places] > 0].sum()))
            sums["count_sum"].append(int((n[places] * times).sum()))
        left = left.drop_columns(["links"])
        for name, values in sums.items():
            left = left.append_column(name, pa.array(values, pa.int64()))
        return left

    schema = "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    done = own.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(run, schema)
    return done.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
        *["groups"] * with_groups)
