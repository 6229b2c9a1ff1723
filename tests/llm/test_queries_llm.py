"""Each registered query of the training-data operators against SQL, a brute-force version or an exact round trip."""

import hashlib
import os
import re
import zlib


import numpy as np
import pytest
from compare import connect, spark_rows, sql_rows

from quarrymill.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(con, SQL[name])


def test_op1_round_trip(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op1_token_file"](spark, sf_dir).collect()}
    start = 0
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert len(got) == len(docs)


def test_op3_counts_as_the_library(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    for doc_id, text in docs:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        assert (got[doc_id].n_bytes, got[doc_id].n_tokens, got[doc_id].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_op4_articles(spark, sf_dir, con):
    import html

    got = {r.page_id: r for r in QUERIES["op4_main_text"](spark, sf_dir).collect()}
    pages = con.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S).group(1)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", b))).strip() for b in re.split("</?(?:p|h1|br)>", article))
        text = " ".join(b for b in blocks if b)
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, text, len(text))


def test_op5_base_measures(spark, sf_dir, docs):
    from quarrymill.llm.repetition import MAX_COVERED, MAX_LONGEST, brute_force

    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text in [d for d in docs if len(d[1] or "") < 1500]:
        b, r = brute_force(text), got[doc_id]
        assert {k: r[k] for k in b} == b
        failed = b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"]
        assert r.base_failed == failed
        assert r.kept == (not failed and b["n_covered"] <= MAX_COVERED * b["n_words"] and b["longest_repeat"] <= MAX_LONGEST)


def test_op6_held_out_accuracy(spark):
    sf_dir = os.environ.get("TEST_SF_DIR_LARGER", "/root/testdata/sf0.01")
    labels = dict(connect(sf_dir).execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = QUERIES["op6_quality_classifier"](spark, sf_dir).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) in (0, 1)]
    assert len(own) > 50
    assert sum(a == b for a, b in own) / len(own) > 0.95
    assert sum(a for a, b in own if b) / sum(b for _, b in own) > 0.97


def _fingerprint(text):
    import xxhash

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _components(values):
    """value -> smallest index reachable through steps of at most two bits."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_op7_components(spark, sf_dir, docs):
    got = {r.doc_id: r for r in QUERIES["op7_simhash_groups"](spark, sf_dir).collect()}
    prints = [_fingerprint(t) for _, t in docs]
    assert [got[i].fingerprint for i, _ in docs] == [f"{p:016x}" for p in prints]
    roots = _components(np.array(prints, np.uint64))
    assert [got[i].component_id for i, _ in docs] == [docs[r][0] for r in roots]


def test_op8_near_its_targets(spark):
    sf_dir = os.environ.get("TEST_SF_DIR_LARGER", "/root/testdata/sf0.01")
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    rows = QUERIES["op8_mix_sources"](spark, sf_dir).join(sources, "doc_id").toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all()
    per = rows.groupby("source", dropna=False).agg(n=("size", "size"), taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), source_size=("source_size", "first"))
    assert (per["size"] == per["source_size"]).all()
    assert abs(per["target"].sum() - rows["size"].sum()) < 1e-6 * rows["size"].sum()
    large = per[per["n"] >= 50]
    assert len(large) >= 5
    assert ((large["taken"] - large["target"]).abs() <= 0.03 * large["target"]).all()


def test_op10_base_spans(spark, sf_dir, docs):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in QUERIES["op10_secrets"](spark, sf_dir).collect()}
    for doc_id, text in docs:
        text = text or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        r = got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest()
        assert set(s[2] for s in spans) <= set(r.spans.split(","))


