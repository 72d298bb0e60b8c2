import random

from pyspark.sql import functions as F

from waymark.llm import licenses

SF = "/root/testdata/sf0.01"


def mit() -> str:
    """The MIT wording in its three paragraphs."""
    body = next(t for _, t in licenses.TEMPLATES if t.startswith("Permission is hereby"))
    return body.replace(" The above copyright", "\n\nThe above copyright").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")


def brute(text, grams, threshold):
    """The best coefficient over every window of words, or None."""
    words = licenses._NOT_WORD.sub(" ", text.lower()).split()
    seq = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    best = 0.0
    for a in range(len(seq)):
        for b in range(a + 1, len(seq) + 1):
            window = set(seq[a:b])
            best = max(best, 2.0 * len(window & grams) / (len(window) + len(grams)))
    return best if best >= threshold else None


def test_notices_inside_longer_texts(spark):
    code = "\n".join(f"value{i} = compute(value{i - 1}, step{i})" for i in range(400))
    apache = "As the readme states, this tool is Licensed under the Apache License, Version 2.0. See there."
    rows = [
        (1, f"# tool\n\n{mit()}\n\n{code}"),
        (2, f"intro words before it, {apache}"),
        (3, f"{code}\n{licenses.full_wordings()[2][1]}\n{code}"),
        (4, f"{mit()}\n\n{code}\n\n{mit()}"),
        (5, code),
        (6, None),
        (7, ""),
        (None, "So it was released under the MIT License, he said."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1))
    got = {(r.doc_id, r.license_id): (round(r.dice, 3), r.n_places) for r in licenses.scan_license_windows(df).collect()}
    assert got[1, "MIT"] == (1.0, 1) and got[2, "Apache-2.0"] == (1.0, 1) and got[4, "MIT"] == (1.0, 2) and got[None, "MIT"] == (1.0, 1)
    assert got[3, "GPL-3.0"][0] == 1.0
    assert {d for d, _ in got} == {1, 2, 3, 4, None}
    assert not {(r.doc_id, r.license_id) for r in licenses.scan_licenses(df).collect()} & {(1, "MIT"), (2, "Apache-2.0"), (4, "MIT"), (None, "MIT")}


def test_best_window_against_brute_force():
    rng = random.Random(5)
    templates = [("A", "a b c d e a c"), ("B", "b a d"), ("C", "c c c a b e d b a")]
    scanner = licenses.WindowScanner(templates, 0.8)
    found = 0
    for _ in range(400):
        text = " ".join(rng.choice("abcdexy") if rng.random() < 0.5 else rng.choice(["a b c d e", "b a d", "c c a b e d b"]) for _ in range(rng.randint(0, 14)))
        want = {name: w for name, t in templates if (w := brute(text, set(licenses.bigrams(t)), 0.8)) is not None}
        got = {name: dice for name, dice, places in scanner.scan(text) if places > 0}
        assert got == want, text
        found += len(want)
    assert found > 50


def test_windows_hold_all_that_the_units_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    units = {(r.doc_id, r.license_id): r.dice for r in licenses.scan_licenses(docs).collect()}
    windows = {(r.doc_id, r.license_id): r.dice for r in licenses.scan_license_windows(docs).collect()}
    assert units and all(windows[k] >= d for k, d in units.items())


def notice(name, beginning):
    return next(t for n, t in licenses.TEMPLATES + licenses.NEAR_TEMPLATES if n == name and t.startswith(beginning))


def test_nearly_alike_wordings_are_told_apart(spark):
    code = " ".join(f"value{i}" for i in range(300))
    gpl3, gpl2, agpl = (notice(n, "This program is free") for n in ("GPL-3.0", "GPL-2.0", "AGPL-3.0"))
    lgpl, bsd2 = notice("LGPL-3.0", "This library"), notice("BSD-2-Clause", "Redistribution")
    bsd3 = dict(licenses.full_wordings())["BSD-3-Clause"]
    by, nc = notice("CC-BY-4.0", "This work"), notice("CC-BY-NC-4.0", "This work")
    apache = dict(licenses.full_wordings())["Apache-2.0"]
    half = len(apache) // 2
    rows = [
        (1, gpl3, {"GPL-3.0": 1}), (2, gpl2, {"GPL-2.0": 1}), (3, agpl, {"AGPL-3.0": 1}), (4, lgpl, {"LGPL-3.0": 1}), (5, bsd2, {"BSD-2-Clause": 1}),
        (6, bsd3, {"BSD-3-Clause": 1}), (7, f"{by} {code} {nc}", {"CC-BY-4.0": 1, "CC-BY-NC-4.0": 1}), (8, f"{lgpl} {code} {gpl3} {code} {lgpl}", {"LGPL-3.0": 2, "GPL-3.0": 1}),
        # a short notice inside a long text leaves the long one standing
        (9, f"{apache[:half]} Released under the MIT License. {apache[half:]}", {"Apache-2.0": 1, "MIT": 1}),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {}
    for r in licenses.scan_license_windows(df).where("n_own > 0").collect():
        got.setdefault(r.doc_id, {})[r.license_id] = r.n_own
    assert got == {r[0]: r[2] for r in rows}


def test_places_told_apart_against_all_pairs():
    rng = random.Random(8)
    gave_way = 0
    for _ in range(500):
        places = list({(rng.choice([0.8, 0.9, 1.0]), a, a + rng.randint(0, 9), rng.choice("ABC")) for a in (rng.randrange(30) for _ in range(rng.randint(0, 12)))})
        want = []
        for p in sorted(places, key=lambda p: (-p[0], -(p[2] - p[1]), p[1], p[3])):
            mine = set(range(p[1], p[2] + 1))
            rivals = [(mine & set(range(q[1], q[2] + 1)), max(len(mine), q[2] - q[1] + 1)) for q in want if q[3] != p[3]]
            if not any(2 * len(both) > longer for both, longer in rivals):
                want.append(p)
        assert licenses.told_apart(places) == want
        gave_way += len(places) - len(want)
    assert gave_way > 100


def test_a_very_long_text_and_clashing_names(spark):
    body = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, f"{body} {mit()} {body}", "x", 5), (1, "Released under the MIT License.", "y", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string, dice int")
    found = sorted((r.doc_id, r.license_id, r.n_places, r.n_own) for r in licenses.scan_license_windows(df).collect())
    assert found == [(1, "MIT", 1, 1), (1, "MIT", 1, 1)]  # rows of one id are scanned each on its own
    assert [(r.doc_id, r.license_id) for r in licenses.scan_licenses(df).collect()] == [(1, "MIT")]
