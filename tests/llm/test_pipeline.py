"""The pipeline's stages against plain rules, and its rows against a brute-force version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "mixing", "token_file"]
    assert corpus_pipeline.ORACLE_SQL is None


def _near_copies(texts):
    """index -> smallest index reachable through pairs whose sets of five-word shingles are alike by 0.8, by all pairs."""
    import re

    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_pipeline_rows(spark, sf_dir):
    import public_tokenizers
    from compare import connect
    from tokenizers import Tokenizer

    from quarrymill.llm.common import table, written

    con = connect(sf_dir)
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = docs.orderBy("doc_id").collect()
        assert {r.doc_id for r in kept[name]} <= before

    quality = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    ids = {r.doc_id for r in kept["quality_classifier"]}
    assert sum((i in ids) == bool(q) for i, q in quality.items()) / len(quality) > 0.9

    rows = kept["quality_classifier"]
    roots = _near_copies([r.text for r in rows])
    assert [r.doc_id for r in kept["near_duplicates"]] == [r.doc_id for i, r in enumerate(rows) if roots[i] == i]

    items = [" ".join(w) for (t,) in con.execute("SELECT regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark").fetchall() for w in [t[i : i + 10] for i in range(max(1, len(t) - 9))]]
    found = {i for (i,) in con.execute("SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), ' ') || ' ' AS t FROM documents), (SELECT unnest(?) AS w) WHERE contains(t, ' ' || w || ' ')", [items]).fetchall()}
    assert [r.doc_id for r in kept["decontamination"]] == [r.doc_id for r in kept["near_duplicates"] if r.doc_id not in found]

    rows = kept["decontamination"]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(r.text.split())
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        level = left / sum(w for s, w in weights.items() if s not in full)
        target = {s: 3 * sizes[s] if s in full else level * weights[s] for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    expected = Counter()
    for source in sizes:
        own = [r for r in rows if r.source == source]
        rate = target[source] / sizes[source]
        digests = {r.doc_id: hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest() for r in own}
        tries = [{i: int(rate) + ((int(d[k // 16 * 8 :][:8], 16) + k % 16 * 2**28) % 2**32 / 2**32 < rate - int(rate)) for i, d in digests.items()} for k in range(64)]
        expected.update(min(tries, key=lambda c: abs(sum(len(r.text.split()) * c[r.doc_id] for r in own) - target[source])))
    assert Counter(r.doc_id for r in kept["mixing"]) == +expected

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    at = 0
    for r, entry in zip(kept["mixing"], got, strict=True):
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        assert (entry.doc_id, entry.start, entry.n_tokens, entry.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids))
        at += len(ids)


EXTRA = ", row struct<a:int>, id string, own string, hash string, size string, copies string, target string, seed string, draws string, n string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, equal ids, rows that are there twice, clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA
    good = "the old mill by the river ran all day and the people of the town came with their grain to have it ground there {}"
    rows = [(i, good.format(i) * 3, "en", f"s{i % 2}", 5) for i in range(6)]
    rows += [(10, None, None, None, None), (11, "", "en", None, 0), (12, " \n\t ", "en", "s0", 3), (13, "x", None, "s1", 1), (14, "word and more " * 40_000, "en", "s1", 9), (None, good, None, None, None), (None, good, None, None, None)]
    rows += [rows[0], rows[0], (1, "another text under the id of one that is there and has some words of its own too", "en", "s0", 4)]
    return spark.createDataFrame([(*r, (7,), *["x"] * (EXTRA.count(",") - 1)) for r in rows], schema)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, name, stage):
    from quarrymill.llm.common import written

    got = written(stage(spark, odd, sf_dir), name)
    if name != "token_file":
        assert got.schema == odd.schema
        before = {(r.doc_id, r.text) for r in odd.collect()}
        assert {(r.doc_id, r.text) for r in got.collect()} <= before
        assert all(r.row.a == 7 and r.size == "x" for r in got.collect())
    rows = got.collect()
    if name == "near_duplicates":
        kept = [(r.doc_id, r.text) for r in rows]
        assert len(kept) == len(set(kept))
    if name == "decontamination":
        assert len(rows) == odd.count()
    if name == "token_file":
        assert len(rows) == odd.count() and sorted(r.start for r in rows)[0] == 0
    empty = written(stage(spark, odd.limit(0), sf_dir), name)
    assert empty.count() == 0
