"""Operators 11 to 13 against versions made from their definitions, and their defined results on odd inputs."""

import hashlib
import random
import zlib

import pytest
from compare import connect
from pyspark.sql import functions as F

from quarrymill.llm.divergence import divergence, share
from quarrymill.llm.merkle import LEVELS, folded_root, leaf_digest, manifest
from quarrymill.llm.piecewise import MAX_CUTS, MIN_BLOCK, block_size, common_chunks, compared, fingerprint, fingerprints, half_replaced, likeness, next_likeness, rolling
from quarrymill.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tree string, at int, part int, row struct<a:int>, n string, digest string, i int, term string, edge string"
EXTRA = ("x", "y", 1, 2, (7,), "z", "d", 3, "t", "e")


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "  \n", "a", "word " * 60_000, "É" * 5, "same text here for all of us", "same text here for all of us", "Other words in Text"]
    rows = [(i, t, None if i == 1 else "en", None if i % 3 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s1", 5), (None, "no id", "en", "s1", 5), rows[6], (6, "another text of that id", "de", "", 3), (12, "x", None, None, 1)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


# --- 11 ---


def _values():
    out = []
    for b in range(256):
        x = (b + 1) * 0x85EBCA6B % 2**32
        x = (x ^ x >> 15) * 0xC2B2AE35 % 2**32
        out.append(x ^ x >> 13)
    return out


def _plain_fingerprint(text):
    data, values = (text or "").encode(), _values()
    hashes = []
    for i in range(len(data)):
        r = sum(values[data[i - k]] * 0x9E3779B1**k for k in range(min(7, i + 1))) % 2**32
        hashes.append(r ^ r >> 16)
    size = MIN_BLOCK
    while size < 2**32 and sum(h < 2**32 // size for h in hashes) > MAX_CUTS:
        size *= 2
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = str(size)
    for k in range(3):
        chunk, signature = b"", ""
        for i, b in enumerate(data):
            chunk += bytes([b])
            if hashes[i] < 2**32 // (size << k) or i == len(data) - 1:
                c = zlib.crc32(chunk) % 4096
                signature, chunk = signature + letters[c // 64] + letters[c % 64], b""
        out += ":" + signature
    return out


def _plain_likeness(one, other):
    if one == other:
        return 1.0
    sigs = []
    for x in (one, other):
        size, *own = x.split(":")
        sigs.append({int(size) << k: [s[i : i + 2] for i in range(0, len(s), 2)] for k, s in enumerate(own)})
    both = sorted(set(sigs[0]) & set(sigs[1]))
    if not both:
        return 0.0
    a, b = (s[both[0]] for s in sigs)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return 1 - row[-1] / (len(a) + len(b)) if a or b else 0.0


def test_op11_against_its_definition(spark, sf_dir):
    docs = connect(sf_dir).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    got = {r.doc_id: r for r in QUERIES["op11_piecewise_hash"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    plain = [_plain_fingerprint(t) for _, t in docs]
    for k, (doc_id, text) in enumerate(docs):
        follow = (k + 1) % len(docs)
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[follow][1][:half]
        r, other = got[doc_id], _plain_fingerprint(edited) if k < 60 else got[doc_id].edited_fingerprint
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), plain[k], other)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == pytest.approx((_plain_likeness(plain[k], other), _plain_likeness(plain[k], plain[follow])))


def test_op11_fingerprints_follow_passages():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text, strange = " ".join(words[:1500]), " ".join(words[2500:])
    assert likeness(fingerprint(text), fingerprint("A few words ahead. " + text)) > 0.9
    assert 0.35 < likeness(fingerprint(text), fingerprint(half_replaced(text, strange))) < 0.65
    assert likeness(fingerprint(text), fingerprint(strange)) < 0.05
    long = text * 40
    assert len(long) > 5 * (1 << 16)
    assert rolling(long.encode()).tolist()[-7:] == rolling(long.encode()[-50:]).tolist()[-7:]
    assert fingerprint(long) == fingerprint(long) and fingerprint(None) == fingerprint("") == "4:::"
    assert fingerprint("a" * 100_000).count(":") == 3
    assert block_size(rolling(b"")) == MIN_BLOCK


def test_op11_common_chunks_of_many():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert common_chunks(a, b) == row[-1]


def test_op11_odd_tables(spark, odd):
    rows = next_likeness(odd).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == sorted((str(r.doc_id), len(r.text or "")) for r in odd.collect())
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    alone = next_likeness(odd.filter("doc_id = 8")).collect()
    assert [(r.near_next, r.n_chars) for r in alone] == [(1.0, 19)]
    assert next_likeness(odd.limit(0)).collect() == []
    assert [r.fingerprint for r in fingerprints(odd.filter("doc_id = 8")).collect()] == [alone[0].fingerprint]
    assert fingerprints(odd.limit(0)).collect() == []
    pairs = spark.createDataFrame([("4:AB:C:", "4:AB:C:"), ("4:::", "4:ABCD::"), ("4:ABCD:AB:", "64:ABCD:AB:")], "a string, b string")
    assert [r.likeness for r in compared(pairs, "a", "b").collect()] == [1.0, 0.0, 0.0]


def test_op11_text_ids_and_order(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", f"text {i} " * (i % 7)) for i in range(300)], "name string, body string").repartition(7)
    got = {r["name"]: r for r in next_likeness(docs, "name", "body").collect()}
    texts = [f"text {i} " * (i % 7) for i in range(300)]
    for i, t in enumerate(texts):
        assert got[f"d{i:03d}"].edited_sha256 == hashlib.sha256(half_replaced(t, texts[(i + 1) % 300]).encode()).hexdigest()


# --- 12 ---


def test_op12_share_is_exact(spark):
    big = 9_000_000_000_000_000
    rows = spark.createDataFrame([(0, 1, 1), (big, big + 5, 77), (3, 10**17, 3), (5, 0, 0)], "c long, n long, v long").select(share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in rows] == [1 + 10**9 // 2, 1 + 10**9 * (big + 1) // (big + 82), 1, None]


def _plain_divergence(docs):
    import re
    from collections import Counter, defaultdict

    counts, there = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x60\x7B-\x7F]+", lowered)
        counts[lang or "", source or ""].update(terms)
        there[lang or ""].update(set(terms))
    out = set()
    for lang in there:
        kept = [t for t, n in there[lang].items() if n >= 3]
        own = {s: c for (g, s), c in counts.items() if g == lang}
        own[None] = sum(own.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept} for s, c in own.items()}
        for s in own.keys() - {None}:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own.keys() - {None, s}]
            marked = [(t, (p[s][t] - p[None][t]) ** 2 // p[None][t]) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, rows in (("pair", pairs), ("term", marked)):
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(rows, 1) if part == "pair" or k <= 200}
    return out


def test_op12_against_its_definition(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)] + ["Été", "naïve", "ÉTÉ"]
    rows = []
    for i in range(400):
        k = rng.randint(0, 4)
        rows.append((" ".join(rng.choice(words[k * 60 :]).upper() if rng.random() < 0.1 else rng.choice(words[k * 60 :]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "", "c", "é"][: k + 2])))
    rows += [("only here", "xx", "a"), (None, "xx", "b"), ("!!! 12 34", "yy", "a"), ("x", "zz", "lone")] + [rows[0]] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [tuple(r) for r in divergence(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_divergence(rows)


def test_op12_odd_tables(spark, odd):
    got = {tuple(r) for r in divergence(odd).collect()}
    assert got == _plain_divergence([(r.text, r.lang, r.source) for r in odd.collect()])
    assert divergence(odd.limit(0)).collect() == []


# --- 13 ---


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(nodes, i, fanout):
    """Root over ``nodes`` and the siblings of node ``i``, left to right and up."""
    siblings = []
    while len(nodes) > 1:
        start = i // fanout * fanout
        siblings += [n for k, n in enumerate(nodes[start : start + fanout], start) if k != i]
        nodes = [_h(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
        i //= fanout
    return nodes[0], siblings


@pytest.mark.parametrize("fanout, sizes", [(16, [1, 2, 16, 17, 256, 257, 600, 4097]), (2, [1, 3, 4, 5, 16, 33, 100]), (3, [82, 9, 1])])
def test_op13_trees_of_many_sizes(spark, fanout, sizes):
    rows = [(f"s{k}" if k else None, i, _h(f"{k}:{i}")) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    leaves = spark.createDataFrame(rows, "source string, doc_id long, leaf string").repartition(5)
    got = manifest(leaves, fanout=fanout).collect()
    assert len(got) == len(rows)
    trees = [[_h(f"{k}:{i}") for i in range(n)] for k, n in enumerate(sizes)]
    tops = [_climb(t, 0, fanout)[0] for t in trees]
    for r in got:
        k = int(r.source[1:]) if r.source else 0
        if r.doc_id % 7 and r.doc_id != sizes[k] - 1:
            continue
        own, root = _climb(trees[k], r.doc_id, fanout), _climb(tops, k, fanout)
        assert (r.subroot, r.root, r.siblings) == (own[0], root[0], "".join(own[1] + root[1]))
        assert 64 * sum(r.others) == len(r.siblings) and all(0 <= p <= n for p, n in zip(r.places, r.others))
    told = folded_root(manifest(leaves, fanout=fanout), "leaf")
    assert told.filter("folded_root <> root").count() == 0
    assert folded_root(manifest(leaves, fanout=fanout).withColumn("bad", F.sha2("leaf", 256)), "bad").filter("folded_root = root").count() == 0
    one_pass = manifest(leaves.withColumn("bad", F.when(F.col("doc_id") % 2 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf"))), fanout=fanout, checked_col="bad")
    assert one_pass.filter((F.col("folded_root") == F.col("root")) != (F.col("doc_id") % 2 == 1)).count() == 0
    assert LEVELS == 2


def test_op13_odd_tables(spark, odd):
    docs = odd.withColumn("leaf", leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    got = manifest(docs).collect()
    assert sorted(str(r[: len(odd.columns)]) for r in got) == sorted(str(tuple(r)) for r in odd.collect())
    for r in got:
        parts = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        assert r.leaf == _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))
    nulls = [r.leaf for r in sorted((r for r in got if r.source is None), key=lambda r: (r.doc_id is not None, r.doc_id, r.leaf))]
    assert {r.subroot for r in got if r.source is None} == {_climb(nulls, 0, 16)[0]}
    assert len({r.root for r in got}) == 1
    assert folded_root(manifest(docs), "leaf").filter("folded_root = root").count() == odd.count()
    empty = manifest(docs.limit(0))
    assert folded_root(empty, "leaf").collect() == []
