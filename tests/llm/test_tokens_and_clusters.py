"""Centroid clustering, prefix BPE and tokenizer alignment against plain versions."""

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vigilake.llm import alignment, bpe, byte_bpe, centroids, near_dup

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "  ", "a ", "x  \n y", "\n\n a\t b  ", "don't we'll 'tis '", "ﬁ½ 漢字かな  z", "a▁b c", "<|endoftext|> <s> </s>", "\x00\x1c\x85\xa0 　q", "é é 👩‍👩‍👧 ",
    "naïve 12345 1,234.5!!! ...", "a" * 3_000, " " * 700 + "end", "ab" * 900 + " " + "-" * 500, "\r\n;\r x ;\r", "﻿x ​ y", "'s's 'S", "word" + "\n" * 40 + "word"]


def plain_clusters(rows, k, rounds, scale=256, width=64):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [r[1] for r in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cents = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(cents)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, n in last:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return collections.Counter((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in last)


def clusters(df, **options):
    return collections.Counter(map(tuple, centroids.cluster(df, **options).collect()))


def test_clusters_equal_plain(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-3, 4) / 4 for _ in range(64)]) for i in range(150)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1]), (None, rows[2][1]), (201, [0.0] * 64), (202, [-0.001] * 64), (203, [1.0] * 63 + [float("inf")]),
        (204, [1.0] * 63 + [None]), (205, [1.0] * 63), (206, None), (207, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit("clash")).withColumn("cluster", F.lit(7))
    assert clusters(df, k=12, rounds=3) == plain_clusters(rows, 12, 3)
    assert clusters(df) == plain_clusters(rows, 40, 5)


def test_clusters_ties_and_few(spark):
    kind = "vec_id long, embedding array<double>"
    same = [(i, [0.5] * 64) for i in range(90)]  # all centroids alike: the smallest number wins
    assert {r["cluster"] for r in centroids.cluster(spark.createDataFrame(same, kind)).collect()} == {0}
    few = [(1, [0.0] * 64), (2, [1e30] * 64)]  # fewer than centroids; beyond the largest component
    found = {r["vec_id"]: r for r in centroids.cluster(spark.createDataFrame(few, kind)).collect()}
    assert found[1]["distance"] == found[2]["distance"] == found[1]["inertia"] == 0
    assert centroids.cluster(spark.createDataFrame([], kind)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None)], kind)).collect() == []


def test_annulus_prunes_and_is_exact():
    rng = np.random.default_rng(3)
    cents = rng.integers(-40, 40, (40, 64)) * rng.integers(1, 30, (40, 1))
    x = np.concatenate([cents + rng.integers(-9, 9, cents.shape), rng.integers(-900, 900, (300, 64)), (cents[:20] + cents[20:]) // 2])
    got, dist, taken = centroids.Annulus(cents).nearest(x)
    every = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (got == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    assert centroids.Annulus(cents).nearest(x[:40])[2] < 0.2 * 40 * 40  # near a centroid the annulus is thin
    assert taken < every.size


@pytest.fixture(scope="module")
def tiktoken_codec():
    import tiktoken

    with open(byte_bpe.default_path()) as f:
        spec = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, spec.splitlines())}
    own = byte_bpe.PrefixCodec(spec, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_prefix_bpe_equals_library(tiktoken_codec):
    own, library = tiktoken_codec
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeins tr'\n.1é漢😀　") for _ in range(rng.randrange(60))) for _ in range(1_500)]
    texts += [("word " * 30_000 + "\n\n ") * 8]  # split in parts
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(300)]
    for text in texts:
        ids = [i for piece in own.encode(text) for i in piece.tolist()]
        assert ids == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_prefix_table_holds_every_prefix(name):
    import tiktoken

    with open(public_tokenizers.path(name)) as f:
        spec = f.read()
    own = byte_bpe.PrefixCodec(spec, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=own.ranks, special_tokens={})
    for word in ("antidisestablishmentarianism", "mississippiississippi", "Donaudampfschiffahrt", "aaaaaaaaaaaaaaaaaaaaaaaaaaab", "zxqvjkwpyzzzz"):
        last, widths = [], []
        for n in range(1, len(word) + 1):  # one byte at a time: nothing that is there changes
            own.extend(word[:n].encode(), last, widths)
            assert len(last) == n
            if word[:n].encode() not in own.ranks:
                assert own.ids_of(last, widths) == library.encode_ordinary(word[:n])


def test_appends_and_edits(tiktoken_codec):
    own, library = tiktoken_codec
    rng = random.Random(2)
    letters = "ab  \n'tsl1.é漢"
    for _ in range(250):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        table = byte_bpe.PrefixTable(own, text)
        for _ in range(4):
            start = rng.randrange(len(text) + 1)
            end, by = rng.randrange(start, len(text) + 1), "".join(rng.choice(letters) for _ in range(rng.randrange(6)))
            text = text[:start] + by + text[end:]
            table.replace(start, end, by)
            assert table.text == text and table.ids() == library.encode_ordinary(text)
    long = byte_bpe.PrefixTable(own, "some words of a long text " * 2_000)
    long.replace(25_000, 25_005, "other")
    assert long.settled < 60 and long.ids() == library.encode_ordinary(long.text)
    long.append("ly done")
    assert long.settled < 60 and long.ids() == library.encode_ordinary(long.text)


def test_prefix_bpe_rows(spark, odd_docs, no_docs, tiktoken_codec):
    _, library = tiktoken_codec
    rows = byte_bpe.encode(odd_docs, with_ids=True).collect()
    assert len(rows) == 12 and byte_bpe.encode(no_docs).collect() == []
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id is not null").collect()} | texts_of(spark)
    rows += byte_bpe.encode(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 10"), with_ids=True).collect()
    odd = {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id is not null").collect()}
    for r in rows:
        if r["doc_id"] is None:
            continue
        text = odd[r["doc_id"]] if r["doc_id"] <= 10 else texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(odd_docs, with_ids=True)).where("doc_id is not null").collect()
    assert {r["doc_id"]: r["text"] for r in back} == odd
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [220, 1])], "doc_id long, ids array<int>")
    assert [r["text"] for r in byte_bpe.decode(nulls).orderBy("doc_id").collect()] == [None, "", ' "']
    assert byte_bpe.decode(nulls.where("false")).collect() == []


def test_re_encode_rows(spark, tiktoken_codec):
    _, library = tiktoken_codec
    edits = spark.createDataFrame([(1, "one two three", 4, 7, "too"), (2, None, None, None, "new"), (3, "end", 99, 1, " more"), (4, "same", 0, None, None), (None, "x", -5, 1, "y")],
        "doc_id long, text string, start long, stop long, replacement string")
    rows = {r["doc_id"]: r for r in byte_bpe.re_encode(edits).collect()}
    assert {k: r["text"] for k, r in rows.items()} == {1: "one too three", 2: "new", 3: "end more", 4: "same", None: "y"}
    assert all(r["ids"] == library.encode_ordinary(r["text"]) for r in rows.values())


def plain_alignment(texts):
    """Whole texts, without segments."""
    from tokenizers import Tokenizer

    import sentencepiece

    a_path, b_path = alignment.default_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    chars = alignment.byte_characters()
    names = {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}
    docs, held = [], collections.Counter()
    for text in texts:
        links, groups, na, nb = collections.Counter(), [], 0, 0
        if text:
            raw = f" {text}".encode()
            ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(chars[c] for c in names[i]) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                na, nb = len(ids_a), len(ids_b)
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                j = 0
                for i, end in enumerate(ends_a):
                    start = end - len(bytes_a[i])
                    while ends_b[j] <= start:
                        j += 1
                    k = j
                    while k < nb and ends_b[k] - len(bytes_b[k]) < end:
                        links[ids_a[i], ids_b[k]] += 1
                        k += 1
                both = sorted(set(ends_a) & set(ends_b))
                ia = ib = 0
                for end in both:
                    ja, jb = ends_a.index(end, ia) + 1, ends_b.index(end, ib) + 1
                    groups.append(",".join(map(str, ids_a[ia:ja])) + "|" + ",".join(map(str, ids_b[ib:jb])))
                    ia, ib = ja, jb
        held.update(links.keys())
        docs.append((na, nb, groups, links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for na, nb, groups, links in docs:
        text = ";".join(groups)
        rows.append((na, nb, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(held[p] * n for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if na else "", text))
    return rows, {(x, y, n, n == most[x]) for (x, y), n in held.items()}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def check_alignment(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seg", F.lit("clash")).withColumn("block", F.lit(1))
    got = collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.align(df, with_groups=True).collect())
    want, links = plain_alignment([t for _, t in rows])
    assert got == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert {tuple(r) for r in alignment.links(df).select("a_id", "b_id", "documents", "best").collect()} == links


def test_alignment_equals_plain(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "x y"), (900, "x y"), (900, "x y")]
    rows += [(1_000 + i, "".join(rng.choice("abe  \n\r;\t.1é漢😀　\xa0\x0b▁"[: rng.choice([8, 20])]) for _ in range(rng.randrange(80)))) for i in range(400)]
    rows += [(2_000 + i, t) for i, t in sorted(texts_of(spark).items())[:300]]
    check_alignment(spark, rows)


def test_alignment_of_small_blocks_and_without_cuts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD + ["the same words again and again"] * 30)]
    monkeypatch.setattr(alignment, "BLOCK", 50)
    check_alignment(spark, rows)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    monkeypatch.setattr(alignment.Pair, "segments", lambda self, text: [text] if text else [])
    check_alignment(spark, rows)


def test_cuts_are_proven():
    a, b = alignment.default_paths()
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        p = alignment.Pair(f.read(), g.read())
    assert p.proven
    assert p.segments("a b  c\n d ") == ["a", "b", " c\n d "] and p.segments("a b") == ["a", "b"] and p.segments(None) == p.segments("") == []


def test_banded_alignment_equals_table():
    """Against the whole table of the dynamic programme, with matches outside the band left out."""
    rng = random.Random(6)
    for _ in range(400):
        kinds = rng.choice([1, 2, 4, 30])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(40))] for _ in "ab")
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() < 0.9]
        band = rng.choice([0, 1, 3, 10, 50])
        table = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for j, y in enumerate(b):
            for i, x in enumerate(a):
                table[j + 1][i + 1] = max(table[j][i + 1], table[j + 1][i], table[j][i] + 1 if x == y and abs(i - j) <= band else 0)
        got = near_dup.common(np.array(a, np.uint64), np.array(b, np.uint64), band)
        head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        if head == 0 and (not a or not b or a[-1] != b[-1]):
            assert got == table[len(b)][len(a)], (a, b, band)
        assert got >= table[len(b)][len(a)]  # common ends are aligned first: never worse


def test_forced_boundary_decode_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [220, 1]), (3, [220, 1]), (None, [40])], "doc_id long, ids array<int>").withColumn("text", F.lit("clash"))
    assert sorted(((r["doc_id"], r["text"]) for r in bpe.decode(rows).collect()), key=repr) == sorted([(1, None), (2, ""), (3, ' "'), (3, ' "'), (None, "I")], key=repr)
    assert bpe.decode(rows.where("false")).collect() == []


def test_near_duplicates_of_a_long_repetitive_text(spark):
    """Two long texts of few words, one with edits throughout: aligned within the band."""
    rng = random.Random(9)
    words = [rng.choice("aa bb cc dd ee ff gg".split()) for _ in range(12_000)]
    edited = [w if rng.random() > 0.005 else "zz" for w in words]
    other = [rng.choice("aa bb cc dd ee ff gg".split()) for _ in range(12_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(other))], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup.dedup(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_texts_of_common_passages_are_no_duplicates(spark):
    rng = random.Random(10)
    passages = [" ".join(f"w{rng.randrange(4_000)}" for _ in range(50)) for _ in range(12)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(passages, 6))) for i in range(60)], "doc_id long, text string")
    rows = near_dup.dedup(df).collect()
    assert len(rows) == 60
    texts = {r["doc_id"]: near_dup.shingles(r["text"]) for r in df.collect()}
    for r in rows:  # whoever is in a class is linked in it
        assert r["class_id"] == r["doc_id"] or any(near_dup.similarity(texts[r["doc_id"]], texts[o["doc_id"]]) for o in rows if o["class_id"] == r["class_id"] and o is not r)
