"""The discriminant against densities worked out from its definition; licence rules by statement, name and directory."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm.licences import MIN_COSINE, TEXTS, licence_blocks, licence_scan, nearest_templates, template_terms
from quarrymill.llm.near_copies import near_copy_groups
from quarrymill.llm.quality import FEATURES, TOWARDS_IDENTITY, TOWARDS_POOLED, fit, score


def test_discriminant_against_its_definition(spark):
    """Class densities from means and shrunk covariances of scaled values, by determinant and inverse instead of Cholesky factors."""
    rng = np.random.default_rng(8)
    k = len(FEATURES)
    mix = rng.normal(size=(k, k))
    x = np.concatenate((rng.normal(size=(90, k)) @ mix, rng.normal(size=(140, k)) * 0.5 + 0.3))
    x[:, 3] = 7.0  # a constant statistic
    y = np.repeat([0, 1], [90, 140])
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    labelled = spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(3)
    got = {r.id: r.score for r in score(labelled.select("id", "x"), fit(labelled.select("x", "y"))).collect()}

    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (x - x.mean(axis=0)) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (90 * own[0] + 140 * own[1]) / 230
    density = []
    for c in (0, 1):
        cov = (1 - TOWARDS_POOLED) * own[c] + TOWARDS_POOLED * pooled
        cov = (1 - TOWARDS_IDENTITY) * cov + TOWARDS_IDENTITY * np.trace(cov) / k * np.eye(k)
        off = z - z[y == c].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
        density.append(math.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * distance)
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    assert np.allclose([got[i] for i in range(230)], want, atol=1e-8)


def _scan(spark, files):
    return {r.path: (r.licence, r.origin) for r in licence_scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}


def test_only_licence_files_rule_a_directory(spark):
    spdx = "/* SPDX-License-Identifier: {} */"
    code = "\nint f(int a) { return a; }" * 40
    mpl = "Mozilla Public License Version 2.0\n==================================\n\n" + "1. Definitions of many things\n" * 100
    mit_text = "".join(t for n, t in TEXTS if n == "MIT").replace(". ", ".\n")
    files = {
        "p/COPYING": mpl, "p/s.c": spdx.format("AGPL-3.0-only"), "p/t.c": "int x;", "p/sub/u.c": "int y;",
        "q/s.c": spdx.format("AGPL-3.0-only"), "q/t.c": "int x;",
        "r/LICENSE": mpl, "r/third.txt": mit_text, "r/fourth.txt": mit_text + " ", "r/t.c": "int x;",
        "s/third.txt": mit_text, "s/t.c": "int x;",
        "p/zero.c": spdx.format("0BSD") + code, "p/z.c": "// SPDX-License-Identifier: Zlib" + code, "p/clear.c": spdx.format("BSD-3-Clause-Clear") + code,
        "p/either.rs": "// SPDX-License-Identifier: Apache-2.0 OR MIT" + code, "p/later.h": "# SPDX-License-Identifier: LGPL-2.1-or-later" + code,
        "p/with.java": spdx.format("GPL-2.0-only WITH Classpath-exception-2.0") + code, "p/both.c": spdx.format("(MIT OR Apache-2.0) AND ISC") + code, "p/page.html": "<!-- SPDX-License-Identifier: MIT-->" + code,
    }
    assert _scan(spark, files) == {
        "p/COPYING": ("MPL-2.0", "file"), "p/s.c": ("AGPL-3.0-only", "header"), "p/t.c": ("MPL-2.0", "inherited"), "p/sub/u.c": ("MPL-2.0", "inherited"),
        "q/s.c": ("AGPL-3.0-only", "header"), "q/t.c": ("", "none"),
        "r/LICENSE": ("MPL-2.0", "file"), "r/third.txt": ("MIT", "file"), "r/fourth.txt": ("MIT", "file"), "r/t.c": ("MPL-2.0", "inherited"),
        "s/third.txt": ("MIT", "file"), "s/t.c": ("MIT", "inherited"),
        "p/zero.c": ("0BSD", "header"), "p/z.c": ("Zlib", "header"), "p/clear.c": ("BSD-3-Clause-Clear", "header"),
        "p/either.rs": ("Apache-2.0 OR MIT", "header"), "p/later.h": ("LGPL-2.1-or-later", "header"),
        "p/with.java": ("GPL-2.0-only WITH Classpath-exception-2.0", "header"), "p/both.c": ("(MIT OR Apache-2.0) AND ISC", "header"), "p/page.html": ("MIT", "header"),
    }


def test_ties_and_nulls_of_licences(spark):
    """Two licences as often in a directory: the first name; a null text beside a licence file of the same path shares its licence."""
    rows = [("d/a/LICENSE", "SPDX-License-Identifier: MIT"), ("d/LICENSE", "SPDX-License-Identifier: MIT"), ("d/LICENSE.txt", "SPDX-License-Identifier: ISC"), ("d/x", "none"), ("e/COPYING", "SPDX-License-Identifier: ISC"), ("e/COPYING", None), ("e/COPYING", "SPDX-License-Identifier: 0BSD")]
    got = sorted((r.path, r.licence, r.origin) for r in licence_scan(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == [("d/LICENSE", "MIT", "file"), ("d/LICENSE.txt", "ISC", "file"), ("d/a/LICENSE", "MIT", "file"), ("d/x", "ISC", "inherited")] + [("e/COPYING", "0BSD", "file")] * 3


def test_block_cosines_against_their_definition(spark):
    import re

    texts = {"a/x.c": "/*\n * Licensed under the Apache License, Version 2.0 (the License);\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at the usual place\n */\nint x;", "b/LICENSE": "MIT License\n\nCopyright (c) 2020 Jo\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction", "c/y.c": "// Copyright of nobody\n// and no licence either"}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    blocks = licence_blocks(files, F.col("path"), F.col("text")).cache()
    got = {(r.path, r.line): (round(-r.b.c, 6), r.b.licence) for r in nearest_templates(blocks, template_terms(spark, TEXTS), MIN_COSINE).collect()}

    terms = {(r.path, r.line): Counter(r.terms) for r in blocks.collect()}
    known = [(n, Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower()))) for n, t in TEXTS]
    names = set().union(*(c for _, c in known))
    n = len(terms)
    df = Counter(t for c in terms.values() for t in c if t in names)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in names}
    once = math.log((1 + n) / 2) + 1

    def vector(c):
        return {t: f * idf.get(t, once) for t, f in c.items()}

    want = {}
    for key, c in terms.items():
        v = vector(c)
        best = []
        for name, k in known:
            w = vector(k)
            dot = sum(v[t] * w[t] for t in v.keys() & w.keys())
            cosine = round(dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values())), 6)
            if cosine >= MIN_COSINE:
                best.append((-cosine, name))
        if best:
            want[key] = (-min(best)[0], min(best)[1])
    assert got.keys() == want.keys() and len(want) >= 2
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=2e-6) for k in want)


def test_near_copies_of_the_documents(spark):
    """Recall on a whole table: links at 0.8 or more by exact similarity, found through an inverted index of all shingles."""
    sf_dir = os.environ.get("TEST_SF_DIR_LARGER", "/root/testdata/sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [(r.text or "").encode().lower().split()] for i in range(max(1, len(w) - 4))} for r in rows}
    where, links = {}, set()
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in where[g] if j < i)
        links |= {(i, j) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)}
    got = {r.doc_id: r.component_id for r in near_copy_groups(docs).collect()}
    assert len(links) > 50
    found = sum(got[i] == got[j] for i, j in links)
    assert found >= 0.98 * len(links), (found, len(links))
