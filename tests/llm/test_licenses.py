"""Notices against a search of all windows by brute force."""

import random

from tessera.llm import licenses


def brute(rows, templates):
    out = {}
    for i, text in rows:
        if i is None or not text:
            continue
        w = licenses.plain_words(text)
        s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for name, t in templates.items():
            t = licenses.plain_words(t)
            t = [tuple(t[k : k + 5]) for k in range(len(t) - 4)]
            m, t = len(t), set(t)
            for k in range(0, len(s), m):
                x = s[k : k + 2 * m - 1]
                share = len(set(x) & t) / len(t)
                if share >= 0.8:
                    word = k + min(j for j, y in enumerate(x) if y in t)
                    out[i, name] = min(out.get((i, name), (0, 0)), (-share, word))
    return {k: (-s, w) for k, (s, w) in out.items()}


def check(spark, rows, templates=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 license")
    got = {(r.doc_id, r.license): (r.containment, r.word) for r in licenses.scan(df, templates).collect()}
    assert got == brute(rows, templates or licenses.TEMPLATES)
    return got


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(check(spark, [(r.doc_id, r.text) for r in docs])) > 10


def test_changed_and_odd(spark):
    rng = random.Random(2)
    rows = [(None, "Released under the MIT License."), (-1, None), (-2, ""), (-3, "licensed"), (-4, "Released under the MIT License."), (-4, "Released under the MIT License.")]
    for k in range(60):
        text = rng.choice(list(licenses.TEMPLATES.values())).split()
        if k % 3:
            text[rng.randrange(len(text))] = rng.choice(["other", "license", ""])
        rows.append((k, " ".join([*("w%d" % rng.randrange(50) for _ in range(rng.randrange(90))), *text, *("licensed under x" if k % 2 else "").split()]).upper()))
    rows.append((100, "under the " * 8000 + licenses.TEMPLATES["MIT grant"]))
    whole = licenses.TEMPLATES["MIT text"].split()
    rows += [(101, "before " * 300 + " ".join([*whole[:40], "other", "words", *whole[42:]]) + " after" * 200), (102, " ".join(whole[: len(whole) // 2]))]
    got = check(spark, rows)
    assert (100, "MIT grant") in got and (-4, "MIT") in got and 0.8 < got[101, "MIT text"][0] < 1 and (102, "MIT text") not in got


def test_anchors_are_needed():
    for text in licenses.TEMPLATES.values():
        w = licenses.plain_words(text)
        runs = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        without = [r for r in runs if not set(r) & set(licenses.anchors(licenses.TEMPLATES))]
        assert len(without) < 0.8 * len(runs)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
