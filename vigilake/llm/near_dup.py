"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled by how often it has come
before, so a passage that stands twice counts twice. Each of SKETCHES sketches takes
the SAMPLED minimum labelled shingles under its own hash order and keeps them in text
order, so two texts agree on it only if they share those shingles and their order.
Texts that agree on a sketch are candidates. A link is a similarity of 0.8 or more:
the longest common subsequence of the two shingle sequences over the shingles of both
less that, by alignment within the band that this similarity allows.

Equal texts are one class before anything is compared. Within a bucket no pairs
are listed: each text is compared with the bucket's most central one. The texts of
buckets that then still hold several components are compared with each other by a
prefix filter, which is exact: a similarity of 0.8 needs so many labelled shingles in
common that two texts share one among the rarest of each, early enough in both. So
every pair that meets in a bucket is in one class, aligned, or proven less similar.
A class belongs to a text, not to an id: rows of one id may have different texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import WORD, per_document, sized_broadcast
from vigilake.llm.components import connected
from vigilake.session import cut, ship

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 20
SAMPLED = 3
#: Ids that may be broadcast (a few MB).
FEW_IDS = 200_000

_WORD = re.compile(WORD)
_PRIME = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's word shingles in order; a shorter text is one shingle,
    a text without words has none."""
    return shingles_of(_WORD.findall(text or ""), width)


def shingles_of(words: list[str], width: int = SHINGLE) -> np.ndarray:
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    w = mix(np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in words], np.uint64))
    n = max(len(w) - width + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(w))):
        out = out * np.uint64(_PRIME) + w[k : k + n]
    return mix(out)


def occurrences(s: np.ndarray) -> np.ndarray:
    """How often each shingle has come before."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    run = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(s), np.uint64)
    out[order] = run
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence: no value stands twice in a text."""
    return mix(s + occurrences(s) * np.uint64(_PRIME)) if len(s) else s


def sketch(label: np.ndarray, count: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """`count` hashes, each of `sampled` minimum labelled shingles in text order."""
    k, out = min(sampled, len(label)), np.empty(count, np.uint64)
    step = max(1, min(count, 2_000_000 // len(label)))  # orders at a time, by memory
    for at in range(0, count, step):
        own = np.arange(at + 1, min(at + step, count) + 1, dtype=np.uint64) * np.uint64(_PRIME)
        h = mix(label[None] ^ own[:, None])
        least = np.sort(np.argpartition(h, k - 1, axis=1)[:, :k], axis=1)
        value = own
        for column in label[least].T:
            value = value * np.uint64(_PRIME) + column
        out[at : at + len(own)] = mix(value)
    return out.view(np.int64)


def longest_rise(places: list[int]) -> int:
    """Length of the longest increasing subsequence."""
    ends: list[int] = []
    for p in places:
        at = bisect_left(ends, p)
        if at == len(ends):
            ends.append(p)
        else:
            ends[at] = p
    return len(ends)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> tuple[int, int]:
    """Of two labelled sequences: the longest common subsequence over matches at most
    `band` apart (no value repeats, so it is the longest rise of the places in `b` in
    the order of `a`), and how many values are common in any order."""
    _, at, other = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at - other) <= band
    rise = other[near][np.argsort(at[near])]
    if len(rise) < 2 or (rise[1:] > rise[:-1]).all():
        return len(rise), len(at)
    return longest_rise(rise.tolist()), len(at)


def common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of sequences with repeats over matches at most `band`
    apart, by bit-parallel dynamic programming: a row of the table is one integer of the
    2 * band + 1 places around the diagonal, which slides along with it. Places behind
    it cannot change any more and are counted as they leave."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    # Of each value: its places in the window as bits, the window's start then, places seen.
    near = {x: [0, -band, 0] for x in places}
    ones = (1 << 2 * band + 1) - 1
    top, row, left = 1 << 2 * band, ones, 0
    for j, y in enumerate(b):
        seen = near.get(y)
        if seen is not None:
            bits, start, known = seen
            bits >>= j - band - start
            own = places[y]
            while known < len(own) and own[known] <= j + band:
                if own[known] >= j - band:
                    bits |= 1 << own[known] - (j - band)
                known += 1
            seen[:] = bits, j - band, known
            u = row & bits
            if u:
                row = ((row + u) | (row - u)) & ones
        left += not row & 1
        row = row >> 1 | top
    return head + tail + left + 2 * band + 1 - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Ordered similarity of two shingle sequences; 0 where it is below `least`.

    Labels shift where a passage is edited that stands again later, so where repeats
    leave it open the sequences themselves are aligned."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    needed = int(np.ceil(least * total / (1 + least) - 1e-9))
    if min(len(a), len(b)) < needed:
        return 0.0
    band = max(len(a), len(b)) - needed  # a match d places apart leaves at most max(len) - d in common
    lcs, shared = aligned(labelled(a), labelled(b), band)
    if lcs < needed <= shared and (occurrences(a).any() or occurrences(b).any()):
        lcs = common(a, b, band)
    return lcs / (total - lcs) if lcs >= needed else 0.0


def text_key(text: Column) -> Column:
    """128 bits that tell texts of one id apart (null: of the empty text)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text), whatever else `docs` holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) -> (doc_id, text_key, print, sketch), a row for each:
    `print` is a 128-bit fingerprint of the words; it and the sketch are null without
    words or id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        with np.errstate(over="ignore"):
            for batch in batches:
                prints, found = [], []
                for text in batch["text"]:
                    words = _WORD.findall(text or "")
                    s = shingles_of(words)
                    prints.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")) if words else None)
                    found.append(sketch(labelled(s)) if words else None)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "print": prints, "sketch": found})

    asked = F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text")
    return per_document(docs.select("doc_id", "text_key", asked), run, "text_key binary, print binary, sketch array<long>")


def shingled(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the shingles of the text that stands for each node, once,
    as bytes. `nodes`: (node, doc_id, text_key), broadcast while counted and few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                yield pd.DataFrame({"node": batch["node"], "s": [shingles(t).tobytes() for t in batch["text"]]})

    ship(docs.sparkSession)
    own = docs.where(F.col("doc_id").isNotNull()).join(sized_broadcast(nodes, FEW_IDS), ["doc_id", "text_key"])
    each = own.select("node", "text").mapInPandas(run, "node long, s binary")
    return cut(each.groupBy("node").agg(F.first("s").alias("s")), "shingled")  # rows repeated with id and text


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) -> the pairs whose texts are at least `least` similar."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                each = zip(batch["sa"], batch["sb"], strict=True)
                keep = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) >= least for x, y in each]
                yield batch.loc[keep, ["a", "b"]]

    # Merged, so that texts are dealt out alike at any size and a hub is split when skewed.
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    return both.select("a", "b", "sa", "sb").mapInPandas(align, "a long, b long")


@dataclass(frozen=True)
class Classes:
    """`rows`: (doc_id, text_key, print) of every row; `groups`: (print, copies,
    head), where head is the (doc_id, text_key) that the class keeps."""

    rows: DataFrame
    groups: DataFrame


def pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def shared_buckets(groups: DataFrame) -> DataFrame:
    """(node, key, size): sketches that several different texts have."""
    buckets = cut(groups.select("node", F.explode(F.array_distinct("sketch")).alias("key")), "buckets")
    live = cut(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "live")
    return cut(buckets.join(live, "key"), "shared")


def central_pairs(shared: DataFrame) -> DataFrame:
    """Each text with the most central one of each of its buckets: the one that
    shares buckets with most others."""
    weights = cut(shared.groupBy("node").agg(F.sum(F.col("size") - 1).alias("weight")), "weights")
    members = cut(shared.select("key", "node").join(weights, "node"), "members")
    top = F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")
    leaders = cut(members.groupBy("key").agg(top).select("key", (-F.col("top.minus")).alias("leader")), "leaders")
    return members.join(leaders, "key").where("node <> leader").select(*pair("node", "leader")).distinct()


def unsettled(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(node, c): the texts of buckets that hold several components, with their own."""
    own = shared.select("key", "node").join(found.withColumnRenamed("id", "node"), "node", "left")
    owned = cut(own.select("key", "node", F.coalesce("component", "node").alias("c")), "owned")
    mixed = owned.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    return cut(owned.join(cut(mixed.select("key"), "mixed"), "key").select("node", "c").distinct(), "unsettled")


def prefix_pairs(nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, c) -> every pair of texts of different components whose labelled
    shingles can be `least` similar (the ordered similarity is at most theirs).

    Each text's shingles are put in one order for all, the rarest first. At the
    first one that two texts share, no more are in common than follow in either, so
    a pair is listed only where enough follow in both."""

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [labelled(np.frombuffer(s, np.uint64)).view(np.int64) for s in batch["s"]]
                yield pd.DataFrame({"node": batch["node"], "size": [len(s) for s in found], "s": found})

    own = texts.join(sized_broadcast(nodes.select("node"), FEW_IDS), "node", "left_semi")
    sized = cut(own.mapInPandas(arrays, "node long, size int, s array<long>"), "sets")
    each = sized.select("node", "size", F.explode("s").alias("shingle"))
    # A shingle of one text only comes before all others and pairs with nothing.
    often = cut(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "often")
    rarest = F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s")  # of one text
    ranked = each.join(often, "shingle").groupBy("node", "size").agg(rarest)
    placed = ranked.select("node", "size", F.size("s").alias("known"), F.posexplode("s").alias("at", "x"))
    placed = placed.select("node", "size", F.col("x.shingle").alias("shingle"), (F.col("known") - F.col("at")).alias("rest"))
    prefix = placed.where(F.col("rest") >= F.ceil(F.lit(least) * F.col("size") - 1e-6))
    prefix = cut(prefix.join(nodes, "node"), "prefix")
    mixed = prefix.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    prefix = cut(prefix.join(cut(mixed.select("shingle"), "mixed"), "shingle"), "prefix")
    side = lambda x: prefix.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "c", "size", "rest")])
    needed = F.lit(least / (1 + least)) * (F.col("size_a") + F.col("size_b")) - 1e-6
    meet = side("a").hint("merge").join(side("b"), "shingle").where("node_a < node_b and c_a <> c_b")
    return meet.where(F.least("rest_a", "rest_b") >= needed).select(*pair("node_a", "node_b")).distinct()


def grouped(rows: DataFrame) -> DataFrame:
    """(node, print, first, copies, sketch), a row for each different text: `first`
    is its least (doc_id, text_key), `copies` the ids that have it."""
    worded = rows.where(F.col("print").isNotNull())
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    texts = worded.groupBy("print").agg(first, F.first("sketch").alias("sketch"))
    copies = worded.select("print", "doc_id").distinct().groupBy("print").agg(F.count("*").alias("copies"))
    return cut(texts.join(copies, "print").withColumn("node", F.monotonically_increasing_id()), "groups")


def classes(docs: DataFrame, least: float = SIMILARITY) -> Classes:
    """The classes of near-duplicate texts.

    Rows with a null id or without words are in no class; texts with equal words are one
    node however many rows they have; rows repeated with id and text are one; an empty
    table has no classes."""
    docs = keyed(docs)
    rows = cut(sketched(docs), "sketches")
    groups = grouped(rows)
    shared = shared_buckets(groups)
    known = groups.select("node", "print", "copies", "first")
    wanted = known.select("node", "first.doc_id", "first.text_key").join(shared.select("node").distinct(), "node", "left_semi")
    texts = shingled(docs, cut(wanted, "wanted"))
    tried = cut(central_pairs(shared), "pairs")
    links = cut(verified(tried, texts, least), "links")
    found = connected(links)
    left = unsettled(shared, found)
    pairs = cut(prefix_pairs(left, texts, least).join(tried, ["a", "b"], "left_anti"), "pairs")
    new = cut(verified(pairs, texts, least), "links")
    if not new.isEmpty():
        found = connected(links.unionByName(new))
    linked = cut(known.join(found.withColumnRenamed("id", "node"), "node"), "linked")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    headed = linked.join(cut(heads, "heads"), "component").select("node", "head")
    classed = known.join(headed, "node", "left").select("print", "copies", F.coalesce("head", "first").alias("head"))
    return Classes(rows.select("doc_id", "text_key", "print"), cut(classed, "classes"))


def decided(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, text_key, head, copies) of every row; head is null without words or id."""
    found = classes(docs, least)
    worded = found.rows.where(F.col("print").isNotNull()).join(found.groups, "print")
    alone = found.rows.where(F.col("print").isNull()).select("doc_id", "text_key")
    return worded.select("doc_id", "text_key", "head", "copies").unionByName(alone, allowMissingColumns=True)


def _is_head() -> Column:
    same = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    return F.col("head").isNull() | same


def dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, class_id, copies, kept.

    `class_id` is the smallest doc_id of the class and `kept` marks the row of that
    id (of the least text key, should its id have several texts of the class);
    `copies` counts the ids of equal words. Texts without words (null, empty, blank)
    and rows with a null id are compared with nothing and kept, each as a class of
    its own. Rows of one id with different texts are judged each by its text; rows
    repeated with id and text are judged alike. An empty table gives an empty result.
    """
    class_id = F.coalesce("head.doc_id", "doc_id").alias("class_id")
    return decided(docs, least).select("doc_id", class_id, F.coalesce("copies", F.lit(1)).alias("copies"), _is_head().alias("kept"))


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """`docs`, with all its columns, without the texts of each class but one.

    Of rows repeated with the same id and text one stays; texts are only shuffled for
    that if an id does repeat. Null, empty and blank texts and rows with a null id
    stay (texts repeated under a null id too); an empty table stays empty."""
    rejected = decided(docs, least).where(~_is_head()).select("doc_id", "text_key").distinct()
    gone = sized_broadcast(cut(rejected, "gone"), FEW_IDS)
    same = (docs["doc_id"].cast("long") == gone["doc_id"]) & (text_key(docs["text"]) == gone["text_key"])
    kept = docs.join(gone, same, "left_anti")
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    once = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return once.unionByName(kept.where(F.col("doc_id").isNull()))
