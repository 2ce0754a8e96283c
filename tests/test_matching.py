"""Matching, lookups, sinks and state against brute force on small fixtures."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactmill.functions import text as t
from contactmill.operators import fuzzy, matching, ml
from contactmill.sources import sinks


@pytest.fixture(scope="module")
def names():
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdefgh "), rng.integers(3, 45))) for _ in range(40)]
    out = list(base)
    for b in base:
        for _ in range(4):
            letters = list(b)
            for _ in range(rng.integers(1, 4)):
                at = int(rng.integers(0, len(letters) + 1))
                letters[at : at + int(rng.integers(0, 2))] = [] if rng.random() < 0.5 else ["z"]
            out.append("".join(letters))
    return list(dict.fromkeys(x for x in out if x.strip()))


def test_no_similar_name_is_missed(spark, names):
    rows = spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    got = {(r["left"], r["right"]) for r in fuzzy.ratio_pairs(rows, "name", "seq", 0.9).collect()}
    want = {(a, b) for j, b in enumerate(names) for a in names[:j] if SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert len(want) > 20 and got == want


@pytest.fixture(scope="module")
def products():
    """Names of few words, of which every piece is common, and some too long to meet by what is left of them."""
    rng = np.random.default_rng(3)
    all_ = [f"{a} {b} Brand#{i} {j}" for a in ("old", "cold", "red") for b in ("bolt", "rod") for i in range(1, 26) for j in range(1, 51)]
    out = [all_[i] for i in rng.choice(len(all_), 600, replace=False)]
    long = ["".join(rng.choice(list("abcdefgh "), 70)) for _ in range(5)]
    return out + long + [x[:30] + "z" + x[33:] for x in long] + [x[:20] + x[22:] for x in out[:20]] + [x[:15] + x[18:] for x in ("a" * 16 + "bcdefghijklmnop", "warm and cold bolts of Brand#12 33")] + ["a" * 16 + "bcdefghijklmnop", "warm and cold bolts of Brand#12 33", "", "x"]


def test_common_pieces_make_few_candidates(spark, products, monkeypatch):
    names = list(dict.fromkeys(products))
    rows = spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    match, want = SequenceMatcher(), set()
    for j, b in enumerate(names):
        match.set_seq2(b)
        for a in names[:j]:
            match.set_seq1(a)
            if match.real_quick_ratio() >= 0.95 and match.quick_ratio() >= 0.95 and match.ratio() >= 0.95:
                want.add((a, b))
    pairs = lambda: {(r["left"], r["right"]) for r in fuzzy.ratio_pairs(rows, "name", "seq").collect()}
    assert pairs() == want and len(want) > 400 and sum(len(a) > 64 for a, _ in want) == 5
    monkeypatch.setattr(fuzzy, "difflib_ratio", lambda left, right: F.lit(1.0))
    assert len(pairs()) < 1.2 * len(want)


def test_keys_merge_into_the_first_accepted_one(spark, names):
    rows = spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    accepted, want = [], {}
    for n in names:
        want[n] = next((a for a in accepted if SequenceMatcher(None, a, n).ratio() >= 0.9), n)
        if want[n] == n:
            accepted.append(n)
    assert {r["name"]: r["merged_key"] for r in fuzzy.merge_similar(rows, "name", "seq", 0.9).collect()} == want


def test_name_pairs_lose_no_score(spark):
    people = [("d", i, f, last) for i, (f, last) in enumerate([("al", "fox"), ("x", "li"), ("ann", "o"), ("", "lee"), ("bo", "")])]
    emails = [("d", f"{x}@d") for x in ("al.fox", "fox", "xli", "ann", "zz", "lee", "alee", "bo", "o")]
    p, e = spark.createDataFrame(people, "domain string, seq long, first string, last string"), spark.createDataFrame(emails, "domain string, email string")
    score = t.email_name_score(F.col("email"), F.col("first"), F.col("last")).alias("score")
    rows = lambda df: {tuple(r) for r in df.select("seq", "email", score).where("score > 0").collect()}
    assert rows(matching.name_pairs(p, e)) == rows(p.join(e, "domain")) != set()


def test_common_beginnings_pair_nothing(spark):
    """As many joined pairs as results where all names begin alike."""
    p = spark.range(3000).select(F.lit("d").alias("domain"), F.col("id").alias("seq"), F.lit("").alias("first"), F.concat(F.lit("fox"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("z")).alias("last"))
    e = p.select("domain", F.concat("last", F.lit("@d")).alias("email"))
    assert matching.name_pairs(p, e).count() == 3000


@pytest.mark.parametrize("lists", [True, False])
def test_rounds_of_acceptance_are_taking_turns(spark, lists):
    """On random and tied scores, with people who share a list and people who don't."""
    rng = np.random.default_rng(7)
    people = [(f"d{i % 3}", i, f"n{rng.integers(0, 12)}") for i in range(150)]
    key = (lambda p: (p[0], p[2])) if lists else (lambda p: (p[0], str(p[1])))
    wishes = {k: {f"e{e}@{k[0]}": float(rng.choice([0.2, 0.3, 0.5, 0.5, 0.9])) for e in rng.choice(40, rng.integers(0, 15), replace=False)} for k in sorted({key(p) for p in people})}
    used, want = set(), set()
    for p in people:
        best = min(((-s, e) for e, s in wishes[key(p)].items() if s >= 0.3 and (p[0], e) not in used), default=None)
        if best:
            used.add((p[0], best[1]))
            want.add((p[0], p[1], best[1]))
    df = spark.createDataFrame(people, "domain string, seq long, name string").withColumn("name", F.col("name") if lists else F.col("seq").cast("string"))
    found = spark.createDataFrame([(*k, e, s) for k, w in wishes.items() for e, s in w.items()], "domain string, name string, email string, score double")
    got = {tuple(r) for r in matching.greedy_match(df.union(df.limit(5)), found, alike=["name"]).collect()}
    assert got == want and len(want) > 60


def test_config_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/config.yaml"
    for text in ("a: 1\n", "b: é\n"):
        sinks.write_config(spark, text, path)
        assert (tmp_path / "config.yaml").read_text() == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["config.yaml"]


def test_accuracy_over_folds(spark):
    rows = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("double").alias("label"))
    assert ml.accuracy(rows, ["x"], "label", "id", which="logistic", folds=2) >= 0.95


def test_model_of_leads_finds_good_ones(spark):
    """Held-out accuracy on the 17 features, well above the commonest label's share; scores as the model's probabilities."""
    from contactmill.plans import scores
    from contactmill.plans.base import Tables

    rows = scores.lead_rows(Tables(spark, "/root/testdata/sf0.001")).cache()
    assert len(ml.FEATURES) == 17 and set(ml.FEATURES) <= set(rows.columns)
    fit, test = ml.split(rows, "label", "seq")
    model = ml.pipeline(ml.makers("label", 20, 20)["gbt"], ml.FEATURES).fit(fit)
    got = ml.predict(model, test).collect()
    right = np.mean([(r["ml_score"] >= 50) == (r["label"] == 1) for r in got])
    common = max(np.mean([r["label"] for r in got]), 1 - np.mean([r["label"] for r in got]))
    assert right >= 0.9 and right > common and all(0 <= r["ml_score"] <= 100 and 0.5 <= r["confidence"] <= 1 for r in got)
    rows.unpersist()


@pytest.mark.parametrize("most", [10**9, 20_000])
def test_phrases_against_containment(spark, most):
    """Nested, overlapping and repeated phrases, over one automaton or several."""
    from contactmill.operators import phrases

    rng = np.random.default_rng(3)
    words = ["ab", "abc", "bc", "c d", "é", "日本", "x", "the end", "end", "nd"]
    given = ["".join(rng.choice(list("abcdé ").__add__(["the end", "日本"]), rng.integers(1, 6))) for _ in range(3000)] + words + ["ABC", "", None]
    texts = [" ".join(rng.choice(words + ["ABcd", "qq"], rng.integers(0, 30))) for _ in range(80)] + [None, ""]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "n long, phrase string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["n"]) for r in phrases.phrase_hits(t, p, ["doc_id"], most=most).collect()}
    want = {(i, n) for i, x in enumerate(texts) if x for n, y in enumerate(given) if y and y.lower() in x.lower()}
    assert got == want and len(want) > 1000


def test_fifty_thousand_phrases(spark, sf):
    from contactmill.operators import phrases

    texts = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    pool = [x for _, x in texts]
    rng = np.random.default_rng(4)
    given = set()
    while len(given) < 50_000:
        x = pool[rng.integers(0, len(pool))]
        at, n = int(rng.integers(0, max(1, len(x)))), int(rng.integers(8, 40))
        given.add(x[at : at + n].lower() + ("" if rng.random() < 0.5 else "~"))
    given = sorted(g for g in given if g)
    p = spark.createDataFrame(list(enumerate(given)), "n long, phrase string")
    got = phrases.phrase_hits(spark.createDataFrame(texts, "doc_id long, text string"), p, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).collect()
    some = {i: x.lower() for i, x in texts if i % 10 == 0}
    have = {r["doc_id"]: (r["k"], r["s"]) for r in got}
    for i, x in some.items():
        hits = [n for n, y in enumerate(given) if y in x]
        assert have.get(i, (0, None)) == (len(hits), sum(hits) if hits else None)


@pytest.mark.parametrize("order", [["late", "seq"], ["seq"]])
@pytest.mark.parametrize("blocks", [None, 6])
def test_guesses_against_a_loop(spark, order, blocks):
    """People as they come, or all addresses first; a default guess is learned from."""
    from contactmill.operators import lookups, patterns

    rng = np.random.default_rng(6)
    domains = ["hot.t", "a.t", "b.t", "c.t"]
    shapes = ["{first}.{last}@{domain}", "{first}@{domain}", "{f}{last}@{domain}", "{last}@{domain}", "odd@{domain}"]
    people = []
    for seq in range(400):
        d = domains[0] if rng.random() < 0.5 else domains[rng.integers(0, 4)]
        f, last = str(rng.choice(["ann", "bob", "", "cy"])), str(rng.choice(["fox", "li", "ray"]))
        make = lambda p, f=f, last=last, d=d: p.format(first=f, last=last, f=f[:1], domain=d)
        people.append((d, seq, f, last, make(shapes[rng.integers(0, 5)]) if f and rng.random() < 0.3 else None))
    mx = {"hot.t": True, "a.t": False, "b.t": True}
    seen: dict = {}
    want = {}
    for d, seq, f, last, email in sorted(people, key=lambda p: (p[4] is not None and -1, p[1]) if order[0] == "late" else p[1]):
        counts = seen.setdefault(d, {})
        make = lambda p, f=f, last=last, d=d: p.format(first=f, last=last, f=f[:1], domain=d)
        if email:
            want[seq] = (email, "known")
            shape = next((p for p in patterns.PATTERNS if make(p) == email), None)
            if shape:
                counts[shape] = counts.get(shape, 0) + 1
        elif counts and f:
            want[seq] = (make(max(counts, key=counts.get)), "pattern")
        elif f and mx.get(d):
            want[seq] = (make(patterns.PATTERNS[0]), "default")
            counts[patterns.PATTERNS[0]] = 1
        else:
            want[seq] = (None, "none")
    df = spark.createDataFrame(people, "domain string, seq long, first string, last string, email string")
    gate = spark.createDataFrame(list(mx.items()), "domain string, has_mx boolean")
    got = {r["seq"]: (r["email"], r["how"]) for r in lookups.guess_batch(df, gate, order, blocks).collect()}
    assert got == want and {h for _, h in want.values()} >= {"known", "pattern", "none"} | ({"default"} if order == ["seq"] else set())
