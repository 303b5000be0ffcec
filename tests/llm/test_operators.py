import hashlib
import math
import os
import random
import re
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from rillflow.llm import cascade, license_scan, media, packing, quality_gbdt, sp_lattice, toxicity, warc
from rillflow.llm.components import components
from rillflow.llm.line_dedup import line_dedup
from rillflow.llm.ngram_join import ngram_join
from rillflow.llm.textstats import base_counts
from rillflow.llm.wordhash import Text, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join("".join(chr(97 + int(d)) for d in str(i * 7919)) for i in range(30_000))
ODD = [
    (1, "Released under the MIT License."), (None, "no id here at all"), (2, None), (3, ""), (4, LONG), (5, "same text twice\nsame text twice"), (5, "same text twice\nsame text twice"),
    (6, " \n\t \n"), (7, "é漢字 \U0001f600 ▁ x"), (8, "a\nb\nc\nd"), (9, "z\na\nb\nc\nd"), (10, "word"),
]
CLASHING = ["score", "predicted", "label", "hashes", "n", "block", "_key", "key", "n_lines", "digest", "u", "v", "grp"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", *(F.lit("extra").alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 1 - i % 2) for i in range(1, 11)] + [(None, 1, 1), (1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    docs = []
    for _ in range(n):
        if docs and rng.random() < 0.4:
            words = rng.choice(docs).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append(" ".join(words))
        else:
            docs.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 40, 80, 120]))))
    return docs


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("k", "percent", "tile"), [(4, 85, 1024), (5, 80, 8)])
def test_ngram_join_equals_brute_force(spark, k, percent, tile):
    texts = corpus()
    sizes, labels = brute_components(texts, k, percent)
    got = {r.doc_id: r for r in ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), k, percent, tile_rows=tile).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == labels


def test_ngram_join_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"x{i}_{rng.random()}"
        texts.append(" ".join(words))
    _, labels = brute_components(texts, 4, 85)
    got = {r.doc_id: r.component_id for r in ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile_rows=64).collect()}
    assert [got[i] for i in range(250)] == labels


def test_ngram_join_rows_that_share_an_id(spark):
    rng = random.Random(11)
    texts = [" ".join(f"t{t}w{i}" for i in range(100)) for t in range(5)]
    near = lambda t: f"{texts[t]} {rng.random()}"
    rows = [(5, texts[0]), (5, texts[1]), (7, near(0)), (8, near(1)), (9, "stands alone"), (9, near(2)), (3, texts[2]), (12, texts[3]), (12, texts[3]), (13, near(3)), (14, None), (14, texts[4]), (15, near(4)), (16, "")]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == [(3, 3), (5, 5), (5, 5), (7, 5), (8, 5), (9, 3), (9, 3), (12, 12), (12, 12), (13, 12), (14, 14), (14, 14), (15, 14), (16, 16)]


def test_ngram_join_pivots(spark):
    rng = random.Random(6)
    texts = []
    for shape in ("star", "chain", "apart"):
        base = [f"{shape}{i}" for i in range(100)]
        for i in range(70):
            words = list(base)
            if shape == "star":  # near copies of one text, near each other or not
                words[rng.randrange(100)] = f"x{i}"
            elif shape == "chain":  # neighbours link, ends don't
                words[:i] = [f"y{j}" for j in range(i)]
            else:  # a shared half, so that few or none link
                words[50:] = [f"z{i // 2}_{j}" for j in range(50)]
            texts.append(" ".join(words[: rng.choice([100, 97])]))
    _, labels = brute_components(texts, 4, 85)
    got = {r.doc_id: r.component_id for r in ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), tile_rows=20).collect()}
    assert [got[i] for i in range(len(texts))] == labels


def test_ngram_join_odd_rows(odd, none):
    rows = ngram_join(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None and by[2].n_shingles == by[3].n_shingles == by[6].n_shingles == 0
    assert by[3].component_id == 3 and by[10].n_shingles == 1 and by[5].component_id == 5
    assert ngram_join(none).count() == 0


def test_components_same_by_both_ways(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    one = sorted(map(tuple, components(df).collect()))
    assert one == sorted(map(tuple, components(df, one_task_edges=0).collect()))
    reach = {i: i for e in edges for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(reach[a], reach[b])
            if reach[a] != low or reach[b] != low:
                reach[a] = reach[b] = low
                changed = True
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert one == sorted((i, low) for i, low in reach.items() if i in linked)


def brute_lines(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choices("abc", k=rng.randint(1, 12)))) for i in range(200)] + [(200, "\n".join("x" for _ in range(500)))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_odd_rows(odd, none):
    out = line_dedup(odd)
    rows = out.collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[2].text is None and by[2].n_lines == 0 and by[3].text == "" and by[3].n_lines == 1
    assert by[8].text == "a\nb\nc\nd" and by[9].text == "z" and by[9].n_removed == 4
    assert by[4].text == LONG and by[4].score == "extra" and out.columns.count("n_lines") == 1
    assert line_dedup(none).count() == 0


def plain_base(t):
    w = WORD.findall(t)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j + d for j in range(len(w) - 2) if triples[tuple(w[j : j + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_base_counts_equal_brute_force():
    texts = [*corpus(80), "", "a", "x\n\nx\nx", "  \n  \n", "#*$ %&|<> a b c a b c", "é é é é\né é é é", LONG]
    for lo, hi, raw, offsets in chunks(pa.array(texts), 5000):
        got = base_counts(Text(raw, offsets))
        for i, t in enumerate(texts[lo:hi]):
            assert tuple(int(got[k][i]) for k in cascade.BASE) == plain_base(t)


def test_cascade_order_does_not_matter(spark, odd, none):
    bad = ["SHOUT " * 30, "a1 b2 " * 40, "### $$$ word " * 30, "5 7 9 1 " * 40, "fine words stand here " * 2 + " ".join(f"n{i}" for i in range(80))]
    texts = [*corpus(60), *bad]
    rng = random.Random(1)
    texts += [" ".join(rng.choices(t.split(), k=60)) for t in bad[:4]]
    for t in texts:
        col = pa.array([t])
        _, _, raw, offsets = next(chunks(col))
        verdicts = set()
        for _ in range(4):
            rules = list(cascade.RULES)
            rng.shuffle(rules)
            verdicts.add(len(cascade.run_rules(raw, offsets, np.array([0]), rules)[0]))
        assert len(verdicts) == 1
    rows = cascade.quality_cascade(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[2].base_failed and not by[3].kept and by[4].kept and by[4].n_words == 30_000
    assert cascade.quality_cascade(none).count() == 0


def test_cascade_plan_measures_each_rule(spark):
    marked = " ".join(f"#### w{i}" for i in range(60))
    junk = "#### word " * 60  # fails the base check, so no rule would see it
    texts = [marked] * 30 + [junk] * 50 + corpus(30)
    passing = [t for t in texts if plain_base(t)[0] >= 50 and 100 * plain_base(t)[4] <= 50 * plain_base(t)[0]]
    plan = cascade.plan_cascade(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {name for name, _, _ in plan} == {r.name for r in cascade.RULES}
    assert dict((n, s) for n, _, s in plan)["symbols"] == pytest.approx(30 / len(passing))
    many = spark.createDataFrame([(i, marked) for i in range(6000)], "doc_id long, text string")
    assert dict((n, s) for n, _, s in cascade.plan_cascade(many, sample_rows=20))["symbols"] == 1


def plain_rules(t):
    """Each rule as its plain statement on one text."""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if x]
    n, chars = max(len(w), 1), max(len(t), 1)
    letters = sum(c.isascii() and c.isalpha() for c in t) + sum(0xC3 <= c.encode()[0] < 0xF5 for c in t)
    counts = Counter(w)
    mean = sum(map(len, w)) / n
    return {
        "symbols": sum(c in "#*$%&|<>" for c in t) > 0.1 * n,
        "shouting": sum("A" <= c <= "Z" for c in t) > 0.5 * max(letters, 1),
        "exclaims": sum(c in "!?" for c in t) > 0.5 * n,
        "word_length": mean < 2.5 or mean > 12,
        "few_letters": letters < 0.5 * chars,
        "digits": sum("0" <= c <= "9" for c in t) > 0.3 * chars,
        "repeated_lines": len(lines) - len(set(lines)) > 0.4 * max(len(lines), 1),
        "vocabulary": len(counts) < 0.08 * n,
        "top_word": max(counts.values(), default=0) > 0.3 * n,
    }


def test_op9_equals_plain_rules(spark):
    from rillflow.llm.queries import op9_quality_rules

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op9_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert tuple(r[k] for k in cascade.BASE) == base and r.base_failed == failed
        assert r.kept == (not failed and not any(plain_rules(texts[r.doc_id]).values()))
    odd = ["SHOUT " * 30, "a1 b2 " * 40, "5 7 9 1 " * 40, "wow! " * 60, "x\n" * 70, "漢字" * 40, *corpus(20)]
    for t in odd:
        _, _, raw, offsets = next(chunks(pa.array([t])))
        assert {x.name: bool(x.rejects(Text(raw, offsets))[0]) for x in cascade.RULES} == plain_rules(t)


def held_out_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_learns_words_and_inflections(spark):
    rng = random.Random(4)
    bad = ["grubbig", "snarlo", "vilemop"]
    rows, marks = [], []
    for i, t in enumerate(corpus(900, 7)):
        toxic = rng.random() < 0.3
        if toxic:
            words = t.split(" ")
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "en", "ish", "ung", ","]))
            t = " ".join(words)
        rows.append((i, t))
        marks.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.values())
    held = [(out[i].score, y) for i, _, y in marks if out[i].held_out]
    assert held_out_auc(held) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in out.values())


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 600)
    rows = [np.unique(np.append(rng.integers(100, 5000, 30), [7] if y else [])).astype(np.uint32) for y in labels]
    used, weights, _ = toxicity.fit_ftrl(rows, labels.astype(float), bits=13)
    assert len(used) < 500 and used[weights.argmax()] == 7


def test_sample_has_one_row_an_id(spark):
    from rillflow.llm.fitting import labelled_sample

    docs = spark.createDataFrame([(i, f"text {j}") for i, n in ((1, 500), (3, 1), (4, 1), (5, 2)) for j in range(n)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, 1) for i in (1, 3, 4, 5)], "doc_id long, quality int, toxic int")
    for n in (1, 2, 4):
        rows = labelled_sample(docs.repartition(7), marks, "toxic", 4, 2, n).collect()
        assert len(rows) <= n and len({r.doc_id for r in rows}) == len(rows)
    assert sorted(map(tuple, labelled_sample(docs.repartition(3), marks, "toxic", 4, 2, 4).collect())) == sorted(map(tuple, rows))


def plain_ftrl(rows, labels, alpha=0.5, beta=1.0, l1=6.0, l2=1.0, epochs=6):
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i == "bias":
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha + l2)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for slots, y in zip(rows, labels, strict=True):
            at = [*slots, "bias"]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - y
            for i, wi in zip(at, w, strict=True):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * wi
                n[i] += g * g
    return {i: w for i in z if (w := weight(i))}


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 200)
    rows = [np.unique(np.append(rng.integers(100, 400, 20), [7, 8] if y else [9])).astype(np.uint32) for y in labels]
    used, weights, bias = toxicity.fit_ftrl(rows, labels.astype(float), bits=10)
    plain = plain_ftrl([r.tolist() for r in rows], labels.tolist())
    assert bias == pytest.approx(plain.pop("bias"), rel=1e-9)
    assert dict(zip(used.tolist(), weights.tolist(), strict=True)) == pytest.approx(plain, rel=1e-5)


def plain_features(t):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    stems = {("stem", x[:n]) for x in w for n in toxicity.STEMS if len(x) > n}
    return {("word", x) for x in w} | stems | {("next", *p) for p in zip(w, w[1:], strict=False)} | {("skip", *p) for p in zip(w, w[2:], strict=False)}


def test_features_are_words_stems_pairs_and_skip_grams():
    texts = ["One two, three; TWO three four-five", "étranger étrangement 漢字 漢字", "", "one", "unbelievable unbelieving one two"]
    _, _, raw, offsets = next(chunks(pa.array(texts)))
    doc, slot = toxicity.feature_hashes(raw, offsets, bits=32)
    slots, plain = [set(slot[doc == i].tolist()) for i in range(len(texts))], [plain_features(t) for t in texts]
    for i in range(len(texts)):
        assert [len(slots[i] & s) for s in slots] == [len(plain[i] & p) for p in plain]


def test_scores_are_those_of_the_whole_text(spark):
    docs = [(i, t) for i, t in enumerate(corpus(200, 3))] + [(200, " ".join(corpus(4000, 4))), (201, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int("abc" in t), int("aa" in t)) for i, t in docs[:200]], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(df, marks)
    weight = dict(zip(np.frombuffer(model["slots"], "<u4").tolist(), np.frombuffer(model["weights"], "<f4").tolist(), strict=True))
    trees = quality_gbdt.train_quality(df, marks)
    toxic = {r.doc_id: r.score for r in toxicity.score_toxicity(df.repartition(3), model).collect()}
    good = {r.doc_id: r.score for r in quality_gbdt.score_quality(df.repartition(3), trees).collect()}
    for i, t in docs:
        _, _, raw, offsets = next(chunks(pa.array([t or ""])))
        _, slot = toxicity.feature_hashes(raw, offsets)
        assert toxic[i] == pytest.approx(1 / (1 + math.exp(-sum(weight.get(s, 0.0) for s in set(slot.tolist())) - model["bias"])), rel=1e-5)
        assert good[i] == pytest.approx(float(quality_gbdt.predict(np.array([plain_statistics(t or "")], np.float32), trees)[0]), rel=1e-6)


def plain_statistics(t):
    n, chars, symbols, dup, repeat = plain_base(t)
    if not n:
        return [0] * len(quality_gbdt.STATISTICS)
    w, lines = WORD.findall(t), t.count("\n") + 1
    letters = sum(c.isascii() and c.isalpha() for c in t) + sum(0xC3 <= c.encode()[0] < 0xF5 for c in t)
    count = lambda chars: sum(c in chars for c in t)
    return [
        math.log1p(n), chars / n, symbols / n, dup / lines, repeat / n, sum("A" <= c <= "Z" for c in t) / max(letters, 1), letters / len(t), count("0123456789") / len(t),
        count("!?") / n, count(".,;:") / n, len(set(w)) / n, n / lines, max(Counter(w).values()) / n, math.log1p(len(t)),
    ]


def plain_trees(x, y, trees, depth, rate=0.15, l2=1.0, min_hess=1.0, bins=64):
    """Boosted trees by plain loops over rows, on the same quantile cuts: the raw scores of the rows."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
    base = math.log(y.mean() / (1 - y.mean()))
    raw = [base] * len(x)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        stack = [(list(range(len(x))), 0)]
        while stack:
            rows, level = stack.pop()
            total = lambda rows: (sum(p[i] - y[i] for i in rows), sum(p[i] * (1 - p[i]) for i in rows))
            g, h = total(rows)
            best = (1e-6, None, None)
            for j in range(x.shape[1]) if level < depth else ():
                for c in cuts[j]:
                    a = total([i for i in rows if x[i, j] <= c])
                    b = (g - a[0], h - a[1])
                    if a[1] >= min_hess and b[1] >= min_hess:
                        gain = a[0] ** 2 / (a[1] + l2) + b[0] ** 2 / (b[1] + l2) - g**2 / (h + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, j, c)
            if best[1] is None:
                for i in rows:
                    raw[i] -= rate * g / (h + l2)
            else:
                stack += [([i for i in rows if x[i, best[1]] <= best[2]], level + 1), ([i for i in rows if x[i, best[1]] > best[2]], level + 1)]
    return [1 / (1 + math.exp(-r)) for r in raw]


def test_trees_equal_plain_fit():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)).astype(np.float32).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gbdt.fit_trees(x, y, trees=4, depth=2)
    assert quality_gbdt.predict(x, model) == pytest.approx(plain_trees(x, y, 4, 2), rel=1e-6)


@pytest.mark.parametrize(("name", "folds", "fold", "threshold"), [("op4_toxicity", 4, 2, 0.3), ("op7_quality", 3, 1, 0.5)])
def test_classifier_queries(spark, name, folds, fold, threshold):
    from rillflow.llm.queries import QUERIES

    ids = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1


def test_classifiers_odd_rows(spark, odd, none, labels):
    for f, train, score in ((toxicity.toxicity, toxicity.train_toxicity, toxicity.score_toxicity), (quality_gbdt.quality, quality_gbdt.train_quality, quality_gbdt.score_quality)):
        rows = f(odd, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        out = score(odd, train(odd, labels))
        assert sorted(out.columns) == sorted(odd.columns) and out.where("block = 'extra'").count() == len(ODD)
        assert f(none, labels).count() == 0
        assert f(odd, labels.limit(0)).count() == len(ODD)


def test_trees_equal_plain_traversal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality_gbdt.fit_trees(x, y, trees=30)
    p = quality_gbdt.predict(x, model)
    assert ((p >= 0.5) == y).mean() > 0.9
    for i in range(40):
        raw = float(model["base"][0])
        for f, t, v in zip(model["feature"], model["threshold"], model["value"], strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(f[node] >= 0 and x[i, f[node]] > t[node])
            raw += v[node - len(f)]
        assert p[i] == pytest.approx(1 / (1 + math.exp(-raw)))


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i, t in enumerate(corpus(600, 9)):
        good = rng.random() < 0.6
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split())))
        marks.append((i, int(good), 0))
    out = {r.doc_id: r for r in quality_gbdt.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert held_out_auc([(out[i].score, y) for i, y, _ in marks if out[i].held_out]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.values())


def check_packing(rows, ids_of):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, own in pieces.items():
        at, ids = 0, ids_of[doc_id]
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return [sum(r.length for r in own) for own in sequences.values()]


BPE = P.path("byte_bpe_50k.json")
MARKED = ["<|endoftext|> opens", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>\n\n<|endoftext|", "it's <|endoftext|>'s", "tabs\tand\n\nbreaks  é漢\U0001f600", "\ufeffx\u2028y\u00a0 z"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_packing_round_trip(spark, none):
    texts = [*corpus(120), None, "", LONG, *MARKED]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids_of = dict(enumerate(reference_ids(texts)))
    assert any(50256 in ids for ids in ids_of.values())
    sizes = check_packing(packing.pack(docs, BPE).collect(), ids_of)
    padding = sum(0 if s & (s - 1) == 0 else 1024 - s for s in sizes) / (1024 * len(sizes))
    assert padding < 0.01
    assert packing.pack(none, BPE).count() == 0


def test_encoder_takes_texts_that_its_expressions_do_not():
    blanks = " " * 1_000_000 + "x"
    assert [*packing.encoder(BPE)(blanks), 0] == reference_ids([blanks])[0]


def test_encoder_asks_the_tokenizer_where_its_file_asks_for_more(tmp_path):
    import json

    spec = json.load(open(BPE, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    assert packing._fast(spec) is None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert packing.encoder(str(path))("hello <|endoftext|> x")[:2] == [31373, 50256]


def test_op8_is_whole_and_exact(spark):
    from rillflow.llm.queries import op8_packing

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sizes = check_packing(rows := op8_packing(spark, "/root/testdata/sf0.001").collect(), dict(zip(docs, reference_ids(docs.values()), strict=True)))
    assert {r.doc_id for r in rows} == set(docs) and all(s == 1024 or s & (s - 1) == 0 or s > 1000 for s in sizes)


def test_harmonic_bins_hold_a_fixed_count():
    rng = random.Random(8)
    packer, rows = packing.Harmonic(0), []
    for i in range(2000):
        rows += packer.add(i, np.arange(rng.randint(1, 3000), dtype="<u4"))
    rows += packer.finish()
    by = Counter((r[5], r[7]) for r in rows)
    assert all(n == kind for (_, kind), n in by.items() if kind)


def test_packing_odd_rows(odd):
    rows = packing.pack(odd, BPE).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert {r.doc_id for r in rows} == {i for i, _ in ODD}


def test_media_round_trip(spark, odd, none, tmp_path):
    folder = f"file://{tmp_path}/shards"
    rows = media.media_columns(odd, folder, shard_bytes=4096).collect()
    assert len(rows) == len(ODD)
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append((t or "").encode())
    for r in rows:
        raw = texts[r.doc_id][0]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == r.digest and r.width == 64 and r.height * 64 == r.payload_bytes and r.bit_depth == 8
        with tarfile.open(f"{tmp_path}/shards/{r.shard}") as tar:
            member = tar.getmember(f"{r.digest}.png")
            stored = tar.extractfile(member).read()
        assert (member.offset_data, member.size) == (r.offset, r.length) and media.decode(stored) == padded
    assert media.media_columns(none, f"file://{tmp_path}/empty").count() == 0
    payloads = {r.payload_sha256 for r in rows}
    members = [m.name for f in os.listdir(f"{tmp_path}/shards") if f.endswith(".tar") for m in tarfile.open(f"{tmp_path}/shards/{f}").getmembers()]
    assert len(members) == len(set(members)) == len(payloads)  # one stored copy overall
    assert len({(r.payload_sha256, r.digest, r.shard, r.offset) for r in rows}) == len(payloads)


def test_op6_features_and_places(spark):
    from rillflow.llm.queries import op6_media

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op6_media(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        padded = list(texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 or (0 if texts[r.doc_id] else 64)))
        shares = [sum(b // 16 == i for b in padded) * 255 // len(padded) for i in range(16)]
        columns = [sum(b for j, b in enumerate(padded) if j % 64 // 8 == i) // (len(padded) // 8) for i in range(8)]
        assert r.feature == bytes(shares + columns).hex() and r.n_bytes == len(texts[r.doc_id])
        assert r.payload_sha256 == hashlib.sha256(bytes(padded)).hexdigest() and r.tail_crc32 == zlib.crc32(bytes(padded[-64:])) and r.payload_bytes == len(padded)


def test_media_of_rows_that_move(spark, tmp_path):
    """Rows that reach other tasks in the second pass are stored all the same."""
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(400)], "doc_id long, text string")
    moving = docs.repartition(6, F.rand() + F.col("doc_id"))
    rows = media.media_columns(moving, f"file://{tmp_path}/shards").collect()
    assert sorted(r.doc_id for r in rows) == list(range(400)) and len({(r.shard, r.offset) for r in rows}) == 40
    assert all(r.payload_sha256 == hashlib.sha256(f"text {r.doc_id % 40}".encode().ljust(64, b"\0")).hexdigest() for r in rows)


def test_media_detects_damage():
    stored = bytearray(media.encode(b"some text"))
    stored[70] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(stored))


PAGE = '<html><head><title>A &amp; B</title><meta charset="utf-8"><script>var t="</p>";</script></head><body><!-- x --><p>One<br>two &lt;3</p><a href="/x?a=1&amp;b=2">link</a><p>un<b>closed</body>'


def test_warc_links_and_digests(spark):
    pages = spark.createDataFrame([(1, "http://a/b", PAGE), (2, None, None), (3, "http://a/c\r\nX: y", ""), (None, "u", "<p>é")], "page_id long, url string, html string").withColumn("block", F.lit("x"))
    rows = warc.warc_derivatives(pages).collect()
    assert len(rows) == 8
    by = {(r.page_id, r.warc_type): r for r in rows}
    fields, block = warc.response_record("http://a/b", PAGE)
    source = dict(fields)
    for kind in ("metadata", "conversion"):
        r = by[1, kind]
        assert r.refers_to == source["WARC-Record-ID"] and r.source_block_digest == warc.sha1(block) and r.source_payload_digest == warc.sha1(PAGE.encode())
        assert r.block_digest == warc.sha1(r.block.encode()) and r.content_length == len(r.block.encode()) and r.target_uri == "http://a/b"
    assert by[1, "conversion"].block == "A & B\nOne\ntwo <3\nlink\nunclosed"
    meta = __import__("json").loads(by[1, "metadata"].block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert meta["Title"] == "A & B" and meta["Links"] == [{"path": "A@/href", "url": "/x?a=1&b=2"}]
    assert by[2, "conversion"].block == "" and len({r.record_id for r in rows}) == 8
    got, body = warc.parse(warc.serialise(fields, block))
    assert dict(got) == source and body == block
    assert warc.warc_derivatives(pages.limit(0)).count() == 0


def links_of(page):
    return [x["url"] for x in warc.read_page(page)[1]["Links"]]


def test_warc_script_links():
    long = f'<script data-a="{"x" * 300}" src="/far.js">x</script>'
    inline = '<script>var src = 1; t = "<a href=\'/no\'>";</script><SCRIPT data-src-of="1">t = "<img src=/no>"</SCRIPT>'
    assert links_of(f'{long}{inline}<script src="/near.js">u = "<a href=/no>"</script><a href="/x">x</a>') == ["/far.js", "/near.js", "/x"]
    assert links_of('<img data-src="/lazy" alt="a > b" src=\'/now\'><a title=href href=/y>') == ["/now", "/y"]


def test_warc_page_shapes():
    text = lambda page: warc.read_page(page)[0]
    assert text("a < b <3 </3 c") == "a < b <3 </3 c" and text("x <b and no end") == "x <b and no end"
    assert text("a<!-- x > y -->b<!-->c<!-- open") == "a b c" and text("a<style>x{}") == "a"
    assert text('a<p title="1 > 0">b</p>c') == "a\nb\nc" and text('a<p title="open>b</p>c') == "a\nb\nc"
    assert text("<!DOCTYPE html><?xml x?>a &amp; b&nbsp;c") == "a & b\u00a0c"
    assert warc.read_page("<title>One <b>&lt;</title><title>two</title>")[1]["Title"] == "One <b><"
    assert warc.read_page("<title>open")[1]["Title"] is None


@pytest.mark.parametrize("part", ["<script ", "<script>", "<a href=\"", "<a href='x", "<!--", "<title>", "<", "<p ", "<a \">", "&", "<style></style", "= \"<", "<a =", " \n", "<a href=x "])
def test_warc_takes_time_in_proportion(part):
    import time

    took = []
    for size in (250_000, 1_000_000):
        page = part * (size // len(part))
        began = time.process_time()
        warc.read_page(page)
        warc.read_page(f"{page}>{page}")
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_warc_headers_are_kept():
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie:b=2\r\nSet-Cookie:  c=3 \r\nX-Folded: one\r\n  two\r\nno colon here\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>\xe9"
    record = b"WARC/1.0\nWARC-Type:response\nWARC-Record-ID:<urn:x:1>\nWARC-Date: 2020-01-01T00:00:00Z\nWARC-Concurrent-To: <urn:x:2>\nWARC-Concurrent-To: <urn:x:3>\nContent-Length:" + str(len(http)).encode() + b"\n\n" + http + b"\r\n\r\n"
    fields, block = warc.parse(record)
    assert block == http and warc.field(fields, "warc-record-id") == "<urn:x:1>"
    (meta_fields, meta), (text_fields, text) = warc.derive(fields, block)
    envelope = __import__("json").loads(meta)["Envelope"]
    assert envelope["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<urn:x:2>", "<urn:x:3>"]
    headers = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]
    assert headers["Set-Cookie"] == ["a=1", "c=3"] and headers["set-cookie"] == "b=2" and headers["X-Folded"] == "one two" and headers[""] == "no colon here"
    assert text.decode() == "é" and dict(text_fields)["WARC-Refers-To"] == dict(meta_fields)["WARC-Refers-To"] == "<urn:x:1>"
    assert warc.parse(b"WARC/1.0\r\nContent-Length: many\r\n\r\nabc\r\n\r\n")[1] == b"abc" and warc.parse(b"junk") == ([], b"")
    assert warc.derive([], b"no http <b>x</b>")[1][1] == b"no http x"


def plain_page(page):
    """Words shown and links by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.links, self.hidden = [], [], 0

        def handle_starttag(self, tag, attrs):
            if tag in warc._LINKS and not self.hidden and (url := dict(reversed(attrs)).get(warc._LINKS[tag])) is not None:
                self.links.append(url)
            self.hidden += tag in ("script", "style", "template", "noscript")
            self.out.append("\n" if tag in warc._BLOCKS else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "template", "noscript") and self.hidden > 0
            self.out.append("\n" if tag in warc._BLOCKS else "")

        def handle_data(self, data):
            self.out.append(data if not self.hidden else " ")

        def handle_comment(self, data):
            self.out.append(" ")

    r = Reader()
    r.feed(page)
    r.close()
    return "".join(r.out).split(), r.links


def test_op3_equals_another_parser(spark):
    import email
    import json

    from rillflow.llm.queries import op3_warc

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = op3_warc(spark, "/root/testdata/sf0.001").collect()
    assert Counter(r.page_id for r in rows) == dict.fromkeys(pages, 2)
    by = {(r.page_id, r.warc_type): r for r in rows}
    for i, page in pages.items():
        meta, text = by[i, "metadata"], by[i, "conversion"]
        words, links = plain_page(page.html or "")
        assert text.block.split() == words
        envelope = json.loads(meta.block)["Envelope"]
        response = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert [x["url"] for x in response["HTML-Metadata"]["Links"]] == links
        payload = (page.html or "").encode()
        digest = "sha1:" + __import__("base64").b32encode(hashlib.sha1(payload).digest()).decode()
        assert response["Entity-Digest"] == text.source_payload_digest == digest and response["Headers"]["Content-Length"] == str(len(payload))
        for r in (meta, text):
            assert r.refers_to == envelope["WARC-Header-Metadata"]["WARC-Record-ID"] and r.target_uri == page.url
    fields, body = warc.parse(warc.serialise(*warc.response_record("http://a", "x")))
    head = email.message_from_bytes(warc.header_block(fields).partition(b"\r\n")[2])
    assert head.items() == fields and body.endswith(b"x")


def test_license_scan(spark, odd, none):
    mit = license_scan.TEMPLATES["MIT-text"]
    texts = [
        "Some prose.\nReleased under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.",
        mit.replace("free of charge", "at no cost").replace(" and ", "\nand ", 1), "The license of my dog ran out in may, and so we walked the long way home again that day.", "nothing",
    ]
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: (r.license, r.verdict) for r in rows}
    assert found == {0: ("MIT", "exact"), 1: ("Apache-2.0", "exact"), 2: ("CC-BY-NC-4.0", "exact"), 3: ("CC-BY-SA-4.0", "exact"), 4: ("MIT-text", "variant"), 5: (None, "unknown")}
    variant = next(r for r in rows if r.doc_id == 4)
    assert variant.missing == "free of charge" and variant.added == "at no cost"
    assert [r.doc_id for r in license_scan.license_scan(odd).collect()] == [1] and license_scan.license_scan(none).count() == 0


def test_license_inside_long_lines():
    items = tuple(license_scan.TEMPLATES.items())
    prose = " ".join(" ".join(f.__doc__ for f in (re, random.Random, tarfile.TarFile.add, hashlib, os, str.split, str.format, int, bytes, zip, sorted, print, open)).split())[:3000]
    for name, text in items:
        found = [(r[3], r[4]) for r in license_scan.scan_text(f"{prose} {text} {prose}", items)]
        assert found == [(name, "opening" if name in license_scan.OPENINGS else "exact")]
    both = f"{prose} {license_scan.TEMPLATES['CC-BY-4.0']} {prose} {license_scan.TEMPLATES['MIT'].replace('Released', 'Published')} {prose}"
    assert [(r[3], r[4]) for r in license_scan.scan_text(both, items)] == [("CC-BY-4.0", "exact"), ("MIT", "variant")]


def test_whole_licenses():
    items, texts = tuple(license_scan.TEMPLATES.items()), tuple(license_scan.TEXTS.items())

    def scan(text):
        return [(r[3], r[4], r[13]) for r in license_scan.scan_text(text, items, texts=texts)]

    for name, text in texts:
        assert scan(f"Some prose about a walk.\n\n{text}\n\nMore prose about a walk.") == [(name, "exact", "text")]
        assert scan(" ".join(text.split())) == [(name, "exact", "text")]
    mit, bsd = license_scan.TEXTS["MIT"], license_scan.TEXTS["BSD-2-Clause"]
    evil = mit.replace("THE SOFTWARE IS", "The Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS", 1)
    assert scan(f"Copyright (c) 2001 A\n\n{evil}") == [("MIT", "variant", "text")]
    assert scan(mit.split("\n\n")[0] + "\n\nYou may only look at it on Sundays.") == [("MIT-text", "opening", "opening")]
    assert scan(bsd.split("\n\n")[0]) == [("BSD", "opening", "opening")]
    assert scan(f"{mit}\n\n{bsd}") == [("MIT", "exact", "text"), ("BSD-2-Clause", "exact", "text")]
    two = license_scan.scan_text(f"{mit}\n\n{bsd}", items, texts=texts)
    assert [(r[1], r[2]) for r in two] == [(0, 5), (7, 7)] and [" ".join(license_scan.words(r[12])) for r in two] == [" ".join(license_scan.words(t)) for t in (mit, bsd)]


def test_license_ranking_is_that_of_full_compression():
    import zstandard

    items = tuple(license_scan.TEMPLATES.items())
    for name, text in items:
        data = " ".join(license_scan.words(text)).encode() + b"\n"
        alone = len(zstandard.ZstdCompressor(level=19, write_content_size=False).compress(data))
        plain = []
        for other, t in items:
            d = zstandard.ZstdCompressionDict(" ".join(license_scan.words(t)).encode() + b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            plain.append((other, (alone - len(zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False).compress(data))) / alone))
        got = license_scan.rank(text, items)
        assert got[0][1] == name and {(n, r) for r, n, _, _ in got} == set(plain)


def brute_licenses(text, templates, limit=license_scan.MAX_DIFFERENCE):
    """(license, exact) of the best template at every place of the text's words, best first, no two overlapping."""
    own, found = license_scan.words(text), []
    for name, template in templates.items():
        t = license_scan.words(template)
        allowed = int(limit * len(t))
        for size in range(max(1, len(t) - allowed), len(t) + allowed + 1):
            for at in range(len(own) - size + 1):
                part = own[at : at + size]
                if part[0] not in t or part[-1] not in t:
                    continue
                same = sum(m.size for m in __import__("difflib").SequenceMatcher(None, t, part, autojunk=False).get_matching_blocks())
                if (d := len(t) - same + size - same) <= allowed:
                    found.append((d, -size, name, at, at + size))
    out = []
    for d, _, name, lo, hi in sorted(found):
        if all(hi <= a or lo >= b for _, _, a, b in out):
            out.append((name, d == 0, lo, hi))
    return [x[:2] for x in sorted(out, key=lambda x: x[2])]


def test_licenses_equal_brute_force():
    rng = random.Random(13)
    small = {k: v for k, v in license_scan.TEMPLATES.items() if len(license_scan.words(v)) < 16}
    own = {"house": "You may copy, bend and sell these words in any country for ever.", "short": "Free as in beer"}
    for templates, cues in ((small, license_scan.CUES), (own, license_scan.cues_of(own))):
        items = tuple(templates.items())
        for _ in range(25):
            parts = []
            for _ in range(rng.randint(0, 3)):
                w = rng.choice(items)[1].split()
                if rng.random() < 0.5:
                    i = rng.randrange(1, len(w) - 1)
                    w[i : i + rng.choice([0, 1])] = [rng.choice(["zebra", "quokka"])]
                parts.append(" ".join(w))
            text = "\n".join(" ".join(rng.choices(["plover", "gannet", "heron", "egret"], k=rng.randint(0, 12))) + "\n" + p for p in [*parts, ""])
            got = [(r[3], r[4] in ("exact", "opening")) for r in license_scan.scan_text(text, items, cues=cues) if r[3]]
            assert got == brute_licenses(text, templates)


def test_variants_that_lack_every_fixed_cue(spark):
    t, prose = license_scan.TEMPLATES, "We walked the long way home again that day."
    gone = {
        "BSD": t["BSD"].replace("Redistribution and", "Copying and"),
        "ISC": t["ISC"].replace("Permission to", "You are free to"),
        "GPL-3.0": "This work is under the General Public, version 3.",
        "Unlicense": "This is free and unencumbered software into the public.",
    }
    assert not any(re.search(license_scan.CUES, x) for x in gone.values())
    texts = [x for text in gone.values() for x in (text, f"{prose}\n{prose} {text}\n# {prose}", f"{prose}\n\n# {text.replace(' is ', ' is' + chr(10) + '# ', 1)}\n\n{t['MIT']}")]
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    names = [name for name in gone for _ in range(3)]
    got = {i: [(r.license, r.verdict) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.block_no)] for i in range(len(texts))}
    assert got == {i: [(name, "variant")] + [("MIT", "exact")] * (i % 3 == 2) for i, name in enumerate(names)}
    assert license_scan.scan_text(f"This work\n{prose}\nthe following conditions", tuple(t.items()), wider=license_scan.wider_cues(t)) == []


def test_templates_of_ones_own(spark):
    own = {"house": "You may copy, bend and sell these words in any country for ever."}
    texts = [f"{LONG}\nyou may COPY bend and\n* sell these words in any country for ever!\n{LONG}", own["house"].replace("bend and", "bend or"), LONG, "Released under the MIT License."]
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own).collect()
    assert {(r.doc_id, r.license, r.verdict) for r in rows} == {(0, "house", "exact"), (1, "house", "variant")}


def test_long_license_blocks():
    import time

    items, texts = tuple(license_scan.TEMPLATES.items()), tuple(license_scan.TEXTS.items())
    gpl = license_scan.TEXTS["GPL-2.0"].replace("free software", "libre software")
    began = time.process_time()
    rows = license_scan.scan_text("\n\n".join([gpl, license_scan.TEXTS["MIT"], gpl, " ".join(["license and software"] * 20_000), "Released under the MIT License."]), items, texts=texts)
    assert [r[3:5] for r in rows if r[13] == "text"] == [("GPL-2.0", "variant"), ("MIT", "exact"), ("GPL-2.0", "variant")]
    assert time.process_time() - began < 120


def test_op1_finds_every_planted_notice(spark):
    from rillflow.llm.queries import op1_license_scan

    texts = {r.doc_id: license_scan.words(r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {(i, name) for i, w in texts.items() for name, t in license_scan.TEMPLATES.items() if f" {' '.join(license_scan.words(t))} " in f" {' '.join(w)} " and name not in license_scan.OPENINGS}
    rows = op1_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert want and {(r.doc_id, r.license) for r in rows if r.verdict == "exact" and r.kind == "notice"} == want


MODEL = P.path("piece_bpe_32k.model")


def enumerate_segmentations(text, voc):
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    text = "▁" + text.replace(" ", "▁")
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if np.isfinite(voc.logp[i])}

    def rest(at):
        if at == len(text):
            yield (), 0.0
        for end in range(at + 1, len(text) + 1):
            if (i := pieces.get(text[at:end])) is not None:
                for ids, lp in rest(end):
                    yield (i, *ids), voc.logp[i] + lp

    return dict(rest(0))


def test_segmentations_follow_the_lattice():
    voc = sp_lattice.vocabulary(MODEL)
    truth = enumerate_segmentations("the cat", voc)
    total = np.logaddexp.reduce(list(truth.values()))
    n = 3000
    lattice, found = sp_lattice.sample_run(["the cat"] * n, np.arange(n), voc, 3)
    first, weight = Counter(), 0.0
    for own in found:
        ids = [tuple(int(x) for x in sp_lattice.edge_ids(lattice, s.edges)) for s in own]
        assert len(set(ids)) == len(own) == min(3, len(truth))
        assert [s.value for s in own] == sorted((s.value for s in own), reverse=True)
        for k, s in zip(ids, own, strict=True):
            assert s.logp == pytest.approx(truth[k] - total, abs=1e-9)
            weight += math.exp(s.logp) / s.inclusion
        first[ids[0]] += 1
    assert weight / n == pytest.approx(1, abs=0.02)
    for k, lp in truth.items():
        p = math.exp(lp - total)
        assert first[k] / n == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / n) + 1e-3)


def test_a_words_lattice_depends_on_no_other_word():
    voc = sp_lattice.vocabulary(MODEL)
    word = "▁segmentations"

    def edges(words):
        lattice = sp_lattice.Lattice(voc, np.array([ord(c) for w in words for c in w], np.int64), np.array([len(w) for w in words]))
        found, todo = [], [int(lattice.first[-1])]
        for p in todo:
            for e in range(lattice.cut[p], lattice.cut[p + 1]):
                found.append((len(todo), int(lattice.ids[e]), float(lattice.logp[e]), float(lattice.upto[e])))
                if lattice.dst[e] not in todo:
                    todo.append(int(lattice.dst[e]))
        assert lattice.last[-1] in todo
        return found

    assert len(edges([word])) > 20 and edges([word]) == edges([*(f"▁w{i * i}é" for i in range(2000)), word])


def test_small_texts_give_all_segmentations():
    voc = sp_lattice.vocabulary(MODEL)
    lattice, (own, empty) = sp_lattice.sample_run(["an", ""], np.array([1, 2]), voc, 50)
    got = {tuple(int(x) for x in sp_lattice.edge_ids(lattice, s.edges)) for s in own}
    assert got == set(enumerate_segmentations("an", voc)) and all(s.inclusion == 1 for s in own)
    assert len(empty) == 1 and len(empty[0].edges) == 0


def test_segmentations_round_trip(spark, odd, none):
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rows = sp_lattice.segment_samples(odd, MODEL, samples=3).collect()
    assert all(r.round_trip for r in rows)
    texts = dict(ODD)
    for r in rows:
        if r.doc_id is not None:
            assert sp.decode(list(r.ids)) == (texts[r.doc_id] or "").replace("▁", " ") or (texts[r.doc_id] or "").startswith(" ")
    again = sp_lattice.segment_samples(odd.repartition(3), MODEL, samples=3, with_ids=False).collect()
    key = lambda r: (r.doc_id or -1, r.sample, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sp_lattice.segment_samples(none, MODEL).count() == 0


def test_op10_returns_ids(spark):
    from rillflow.llm.queries import op10_segmentations

    rows = op10_segmentations(spark, "/root/testdata/sf0.001").limit(50).collect()
    assert rows and all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
