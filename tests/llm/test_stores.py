"""Merkle manifest, lexical search and id files against brute force, and words that simple hashes confuse."""

import array
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoslate.llm import common, lexical_search, merkle, near_dedup, queries, substring_dedup, suffix_dedup, token_store

from .test_llm import SCHEMA, odd  # noqa: F401

H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return H("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        first = i // 3 * 3
        run = range(first, min(first + 3, len(level)))
        yield [level[j] for j in run if j < i], [level[j] for j in run if j > i]
        i //= 3


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))
    trees = {s: levels([leaf_of(r) for r in sorted(by[s], key=key)]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sorted(by[s], key=key)):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in path)), path, r))
    return out


def many(n):
    """Sources of very different sizes, one of them a third of all, with a null source, null ids and repeated rows."""
    sizes = [n // 3, 28, 27, 10, 9, 4, 3, 2, 1, 1]
    rows = [(100 * k + i if (k, i) != (3, 0) else None, f"t{i}\nx" if i % 5 else None, "en", None if k == 2 else f"s{k}é", i) for k, m in enumerate(sizes) for i in range(m)]
    return rows + [(7, "same\n", None, "s1é", None)] * 2


def test_manifest_is_that_of_plain_trees(spark):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in many(900)]
    docs = spark.createDataFrame(many(900), SCHEMA).withColumns({"g": F.lit(1), "path": F.lit("p"), "n": F.lit(0), "at": F.lit(0)})
    got = merkle.verify(merkle.manifest(docs)).withColumn("proof", merkle.proof(F.col("path"))).collect()
    want = plain_manifest(rows)
    as_rows = lambda xs: sorted(map(str, xs))
    assert as_rows((r.id, r.leaf, r.subroot, r.root, r.proof) for r in got) == as_rows(w[:5] for w in want)
    assert all(r.verified for r in got)
    # any other leaf gives another root
    wrong = merkle.verify(merkle.manifest(docs).withColumn("other", F.sha2("leaf", 256)), "other")
    assert wrong.filter("verified OR folded_root = root").count() == 0
    held = merkle.nodes(docs).collect()
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    assert Counter(r.source for r in held) == {s: sum(map(len, levels(list(map(leaf_of, x))))) for s, x in by_source.items()}
    assert all(r.lo % 3**r.level == 0 and 0 < r.hi - r.lo <= 3**r.level and r.hi <= len(by_source[r.source]) for r in held)


def test_manifest_of_few_and_none(spark):
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    r = merkle.verify(merkle.manifest(one)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.path == []
    assert merkle.manifest(one.limit(0)).count() == 0


def test_tampering_shows(spark, tmp_path):
    docs = spark.createDataFrame(many(60), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    hit = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "") and r["doc_id"] is not None
    want = sorted((str(w[0]), w[1], not hit(w[6])) for w in plain_manifest([r.asDict() for r in docs.collect()]))
    assert sorted((str(r.doc_id), r.leaf, r.verified) for r in got) == want


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    held = [(d, plain_terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(t for _, ts in held for t in set(ts))
    out = []
    for item, text in items:
        asked = plain_terms(text)
        scored = []
        for d, ts in held:
            tf, m = Counter(ts), 25 + 75 * len(ts) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def test_search_is_that_of_all_scores(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(None, "Zwölf zwölf"), (None, None), (900_001, ""), (900_002, docs[3][1]), (900_003, docs[3][1]), (900_003, docs[3][1])] + [(910_000 + i, "hot copy of words") for i in range(300)]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "HOT words words"), (901, None), (902, "!!"), (903, "zwölf"), (900, "HOT words words"), (None, "nowhereatall copy")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1), "n": F.lit(2)}).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(0))
    got = [(r["item"], r["rank"], r["doc"], r["score"]) for r in lexical_search.search(d, q).collect()]
    assert sorted(map(str, got)) == plain_search(docs, items)
    seen = lexical_search.looked_at(d, q).first()
    assert 0 < seen.skipped < seen.compared and seen.scored < seen.postings
    assert lexical_search.search(d.limit(0), q).count() == 0 and lexical_search.search(d, q.limit(0)).count() == 0


def test_search_in_blocks_of_queries(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30))) for i in range(200)]
    items = [(i, " ".join(f"w{(7 * i + j) % 41}" for j in range(6))) for i in range(40)]
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 400)
    monkeypatch.setattr(lexical_search, "GROUP", 3)
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert sorted(map(str, [(r["item"], r["rank"], r["doc"], r["score"]) for r in got.collect()])) == plain_search(docs, items, 4)


def test_a_block_is_bounded_by_its_summary():
    rng = np.random.default_rng(3)
    row, column = np.nonzero(rng.random((300, 40)) < 0.3)
    block = lexical_search.Queries([(np.arange(0, 40, 3), np.ones(14, np.int64))], {})
    block.weight = np.arange(1, 41)
    group = lexical_search._grouped(block)[0]
    at = np.searchsorted(group.terms, column)
    own = group.terms[np.minimum(at, len(group.terms) - 1)] == column
    s = lexical_search.Segment(group, rng.integers(25, 200, 300), row[own], at[own], rng.integers(1, 5, own.sum()))
    for t in range(len(group.terms)):
        blocks = s.blocks(t)
        assert sorted(np.concatenate(blocks).tolist()) == sorted(np.flatnonzero(s.impact[:, t]).tolist())
        most = s.summaries(blocks)
        for b, m in zip(blocks, most, strict=True):
            assert (m == s.impact[b].max(axis=0)).all()
    every = s.score(0, np.arange(300))
    bound = np.sort(every)[-10]
    assert set(np.flatnonzero(every >= bound)) <= set(s.reached(np.array([bound]))[0][0])


WORDS = queries.WORD_TOKENIZER


def test_id_files_hold_what_the_library_gives(spark, odd, tmp_path):  # noqa: F811
    more = spark.createDataFrame([(40, "<|startoftext|> word<|endoftext|>s' don't"), (41, "J̌A á \x1c\x85İ ﬁ"), (42, "(Straße), ÑANDÚ…")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more).withColumns({"n": F.lit(1), "key": F.lit("k"), "frame": F.lit("f"), "start": F.lit(0)})
    folder, listed = token_store.store(docs, WORDS, 2, str(tmp_path / "ids"), file_bytes=20_000)
    got = sorted(map(str, [(r.doc, r.start, r.n, r.crc32) for r in token_store.read_back(listed, folder).collect()]))
    tok = token_store.tokenizer(WORDS)
    rows = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    # documents of one id come in any order that puts their starts one after another
    files = listed.orderBy("part", "seq").collect()
    assert len(files) > 1 and sum(r.docs for r in files) == len(rows) and files[-1].start + files[-1].tokens == sum(len(i) for _, i in rows)
    read = sorted((r.start, r.doc is None, r.doc or 0, r.n, r.crc32) for r in token_store.read_back(listed, folder).collect())
    assert [x[0] for x in read] == np.cumsum([0, *[x[3] for x in read[:-1]]]).tolist()
    assert [x[1:3] for x in read] == sorted((d is None, d or 0) for d, _ in rows)
    assert sorted(x[1:] for x in read) == sorted((d is None, d or 0, len(i), zlib.crc32(array.array("I", i).tobytes())) for d, i in rows)
    whole = dict(r for r in rows if r[0] is not None)
    for r in files:
        if r.first_doc is not None:
            assert token_store.read_document(folder, r.file, r.first_doc)[0].tolist() == whole[r.first_doc]
    assert len(got) == len(rows)
    none_folder, none = token_store.store(docs.limit(0), WORDS, 2, str(tmp_path / "none"))
    assert none.count() == 0 and token_store.read_back(none, none_folder).count() == 0


def test_a_dictionary_helps_and_is_checked(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionary = token_store.train_dictionary(docs, WORDS, 2)
    assert dictionary == token_store.train_dictionary(docs.repartition(7), WORDS, 2) and len(dictionary) > 1000
    size = lambda d: token_store.frames(docs.filter(F.length("text") < 500), WORDS, 2, d).agg(F.sum(F.length("frame"))).first()[0]
    assert size(dictionary) < 0.9 * size(b"")
    folder, listed = token_store.store(docs, WORDS, 2, str(tmp_path / "ids"))
    file = listed.first().file
    with pytest.raises(ValueError):
        (tmp_path / "ids" / "cut.ids").write_bytes((tmp_path / "ids" / file).read_bytes()[:-1])
        token_store.read_document(folder, "cut.ids", 1)


def twins():
    """Two words of 1,024 letters that agree under every polynomial modulo 2**64."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_twin_words_are_told_apart(spark):
    one, other = twins()
    a, b = common.word_hashes([one.encode(), other.encode()])
    assert a[0] != b[0]
    same = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {other}"), (3, f"{same} {one}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 50}
    pairs = spark.createDataFrame([(1, f"x {one}"), (2, f"x {other}"), (3, f"x {one}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(pairs, shingle=2).collect()} == {1: 1, 2: 2, 3: 1}


def test_twin_bytes_are_told_apart(spark):
    one, other = twins()
    docs = spark.createDataFrame([(1, one[:512]), (2, other[:512])], "doc_id long, text string")
    raw = {1: one[:512], 2: other[:512]}
    count = Counter(x[p : p + 200] for x in raw.values() for p in range(len(x) - 199))
    want = {}
    for d, x in raw.items():
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 199):
            if count[x[p : p + 200]] > 1:
                gone[p : p + 200] = True
        want[d] = int(gone.sum())
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()} == want
    # windows counted by their digests, over groups of no size
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs, group_bytes=0).collect()} == want


def test_words_of_any_length_keep_their_hash():
    words = [bytes([97 + k % 26]) * k for k in range(1, 150)]
    alone = [common.word_hashes([w])[0][0] for w in words]
    assert common.word_hashes([b"\n".join(words)])[0].tolist() == alone and len(set(alone)) == len(words)
    assert [x.tolist() for x in common.word_hashes([b"AbC \xc3\x89", b"", b" "], lower=True)] == [common.word_hashes([b"abc \xc3\x89"])[0].tolist(), [], []]
