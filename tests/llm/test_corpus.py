"""Operators over the whole corpus against brute force on small fixtures."""

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from repograph.llm import anisotropic, components, line_dedup, near_dedup, pitman_yor, toxicity

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)


def near_texts():
    base = [words(80) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for _ in range(3):
            c = list(b)
            c[RNG.randrange(80)] = "changed"
            texts.append(" ".join(c))
    texts += [texts[0]] * 5 + [None, "", "", " ", "one two", "one two", "a b c d e f g " * 3000]
    return texts


def shingles(t):
    w = (t or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def test_near_duplicates(spark):
    texts = near_texts()
    got = {r.doc_id: bytes(r.class_key) for r in near_dedup.near_duplicate_classes(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    bags = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            either = sum((bags[i] | bags[j]).values())
            same = sum((bags[i] & bags[j]).values()) / either if either else 0
            if same >= 0.85:
                assert got[i] == got[j], (i, j, same)
            elif same < 0.3:
                assert got[i] != got[j], (i, j, same)
    assert near_dedup.near_duplicate_classes(frame(spark, texts).limit(0)).count() == 0


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40) if i % 10 != 9] + [("hub", f"h{i}") for i in range(30)] + [("x", "x")]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"n{i:03}"] == f"n{i // 10 * 10:03}" for i in range(40)) and {got[f"h{i}"] for i in range(30)} == {"h0"} and "x" not in got


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(line, n):
    line = list(line)
    for _ in range(n):
        k, at = RNG.random() if line else 1, RNG.randrange(max(len(line), 1))
        if k < 0.4:
            line[at] = "Q"
        elif k < 0.7:
            del line[at]
        else:
            line.insert(at, "é")
    return "".join(line)


def test_edit_distance():
    pairs = []
    for _ in range(400):
        a = "".join(RNG.choice("ab") for _ in range(RNG.randint(0, 20)))
        pairs.append((a, edited(a, RNG.randint(0, 5)) if a else "b"))
    for edits in (1, 2, 3):
        got = line_dedup.within([tuple(np.array([ord(c) for c in x], dtype=np.uint32) for x in p) for p in pairs], edits)
        assert got.tolist() == [levenshtein(*p) <= edits for p in pairs]


def line_texts():
    base = [" ".join(words(RNG.randint(7, 14))) for _ in range(40)]
    texts = ["\n".join(RNG.sample(base, 4)) for _ in range(15)]
    texts += ["\n".join(edited(x, RNG.randint(0, 3)) for x in RNG.sample(base, 3)) for _ in range(20)]
    return texts + [None, "", "\n\n", "short line\nshort line", texts[0], "five words are in here\n" * 3, " ".join(words(9000))]


def test_line_classes(spark):
    texts = line_texts()
    p = line_dedup.LineParams()
    got = {(r.doc_id, r.line_no): (r["first"], r.class_size) for r in line_dedup.line_classes(frame(spark, texts).select("doc_id", "text")).collect()}
    where = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= p.min_words:
                where[line].append((i, k))
    lines = list(where)
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = min(p.edits, max(len(a), len(b)) // p.each)
            if min(len(a), len(b)) >= p.min_chars and abs(len(a) - len(b)) <= most and levenshtein(a, b) <= most:
                parent[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for x in lines:
        classes[find(x)] += where[x]
    assert sum(map(len, classes.values())) == len(got)
    for places in classes.values():
        first = min(places)
        for place in places:
            told, size = got[place]
            assert size == len(places) and (size == 1 or (told.doc_id.value, told.line_no) == first)
    kept = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(frame(spark, texts)).collect()}
    firsts = {min(v) for v in classes.values()}
    for i, t in enumerate(texts):
        want = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) in firsts or (i, k) not in got)
        if i in kept:
            assert (kept[i] or "") == want
        else:
            assert not want.strip()
    assert line_dedup.drop_duplicate_lines(frame(spark, texts).limit(0)).count() == 0


def test_short_lines_take_part(spark):
    texts = ["All rights reserved.\nReleased under the MIT License.\nab", "All rights reserved.\nReleased under the MIT Licence.\nac\n \t", "中文行没有空格\nab\nZzzzzzzz", "中文行没有空隔\nQuite another one"]
    got = {(r.doc_id, r.line_no): (r["first"].doc_id.value, r["first"].line_no) if r["first"] else None for r in line_dedup.line_classes(frame(spark, texts).select("doc_id", "text")).collect()}
    assert got == {
        (0, 0): (0, 0), (1, 0): (0, 0), (0, 1): (0, 1), (1, 1): (0, 1), (0, 2): (0, 2), (2, 1): (0, 2), (1, 2): None,
        (2, 0): (2, 0), (3, 0): (2, 0), (2, 2): None, (3, 1): None,
    }
    kept = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(frame(spark, texts)).collect()}
    assert kept == {0: texts[0], 1: "ac\n \t", 2: "中文行没有空格\nZzzzzzzz", 3: "Quite another one"}


def test_edits_grow_with_the_length(spark):
    lines = ["Of.", "It.", "Th.", "Of.", "abcd", "abcde", "abXYe", "ninechars", "nineXhYrs", "tencharsok", "tenXhYrsok", "tenXhYrsoZ9"]
    short = ["".join(RNG.choice("abc") for _ in range(RNG.randint(3, 12))) for _ in range(150)]
    for texts, want in ((lines, {0: 2, 3: 2, 4: 2, 5: 2, 9: 3, 10: 3, 11: 3}), (short, None)):
        p = line_dedup.LineParams(block=20)
        got = {r.line_no: r.class_size for r in line_dedup.line_classes(frame(spark, ["\n".join(texts)]).select("doc_id", "text"), p).collect()}
        groups = [{i} for i in range(len(texts))]
        for i, a in enumerate(texts):
            for j, b in enumerate(texts[:i]):
                if a == b or levenshtein(a, b) <= min(p.edits, max(len(a), len(b)) // p.each):
                    one, two = (next(g for g in groups if k in g) for k in (i, j))
                    if one is not two:
                        groups.remove(two)
                        one |= two
        assert got == {i: len(g) for g in groups for i in g}
        assert want is None or {i: n for i, n in got.items() if n > 1} == want


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:1000] = x[700]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0], 1), (2004, [None] * 16, 1), (3, x[3].tolist(), 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in anisotropic.nearest(v, v.where("vec_id % 100 = 0"), anisotropic.SearchParams(cell=300, block=256)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        distance = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(1500), distance)).tolist() if i != q][:10]
        assert all(abs(distance[i] - s) < 1e-12 for i, s in found) and found == sorted(found, key=lambda p: (p[1], p[0]))
        hits += len({i for i, _ in found} & set(best))
    assert hits >= 0.9 * 10 * len(got)
    assert [i for i, _ in got[700]] == list(range(701, 711))
    assert anisotropic.nearest(v.limit(0), v.limit(0)).count() == 0
    assert anisotropic.nearest(v.where("vec_id < 3"), v.where("vec_id = 0")).count() == 2


def test_toxicity(spark):
    bad = ["vileword", "nastyword", "foulword"]
    texts, labels = [], []
    for i in range(900):
        w = words(30)
        toxic = i % 6 == 0
        if toxic:
            for b in RNG.sample(bad, 2):
                w[RNG.randrange(30)] = b
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    texts += [None, ""]
    d = frame(spark, texts)
    marks = spark.createDataFrame(labels + labels[:3], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score_texts(d, toxicity.fit_scorer(d, marks)).collect()}
    assert len(scores) == len(texts) and all(0 <= s <= 1 for s in scores.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((scores[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert right >= 0.95 * len(held)
    none = toxicity.fit_scorer(d, marks.where("toxic = 0"))
    assert {r.score for r in toxicity.score_texts(d, none).collect()} == {0.0}


def test_language_model(spark):
    texts = [" ".join(words(RNG.randint(1, 60))).title() for _ in range(200)] + [None, "", "\x0b", "unseen tokens"]
    d = frame(spark, texts)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    p = pitman_yor.ModelParams(frequent=50, endings=16, sweeps=3, burn=1)
    got = {r.doc_id: r for r in pitman_yor.language_model_scores(d, ~held, p).collect()}
    split = {i: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for i, t in enumerate(texts)}
    counts = collections.Counter(w for i, t in split.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for i, t in split.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert pitman_yor.language_model_scores(d.limit(0), ~held, p).count() == 0


def test_tables_follow_the_restaurant():
    """With one dish the posterior of the tables is the restaurant's own distribution, whose mean is known."""
    for c, discount, strength in ((20, 0.7, 5.0), (64, 0.5, 10.0), (500, 0.7, 5.0), (3000, 0.5, 10.0)):
        rng, t, seen = np.random.default_rng(1), np.ones(1), []
        for _ in range(3000):
            t = pitman_yor.sweep_tables(np.array([c]), t, np.ones(1), discount, strength, rng)
            seen.append(t[0])
        g = math.lgamma
        want = strength / discount * (math.exp(g(strength + discount + c) + g(strength) - g(strength + discount) - g(strength + c)) - 1)
        assert abs(np.mean(seen[200:]) / want - 1) < 0.03


def seat_one_by_one(rng, tables, dish, n, parent, discount, strength):
    """Adds n customers of a dish to a restaurant {dish: [customers of each table]}; gives the number of new tables."""
    new = 0
    for _ in range(n):
        own = tables.setdefault(dish, [])
        total = sum(map(len, tables.values()))
        weights = [x - discount for x in own] + [(strength + discount * total) * parent]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            new += 1
        else:
            own[k] += 1
    return new


def leave(rng, tables, dish):
    """Takes a customer chosen at random away; gives whether its table went."""
    own = tables[dish]
    k = rng.choices(range(len(own)), own)[0]
    own[k] -= 1
    if not own[k]:
        del own[k]
        return True
    return False


def chain(counts, p):
    """The sampler's chain in one process: contexts given the parent, the parent given the contexts, probabilities averaged."""
    k, n = p.classes, len(counts)
    (d, d0, _), (s, s0, _) = p.discounts, p.strengths
    c, held = np.array(counts), [np.minimum(r, 1).astype(float) for r in np.array(counts)]
    parent, t0, kept = np.full(k, 1 / k), np.zeros(k), np.zeros((n, k))
    for sweep in range(p.sweeps):
        held = [pitman_yor.sweep_tables(c[u], held[u], parent, d, s, np.random.default_rng([p.seed, sweep, u])) for u in range(n)]
        up = np.sum(held, axis=0)
        t0 = np.minimum(np.maximum(t0, np.minimum(up, 1)), up)
        t0 = pitman_yor.sweep_tables(up.astype(np.int64), t0, np.full(k, 1 / k), d0, s0, np.random.default_rng([p.seed, sweep, k]))
        parent = (np.maximum(up - d0 * t0, 0) + (s0 + d0 * t0.sum()) / k) / (s0 + up.sum())
        if sweep >= p.burn:
            kept += [(np.maximum(c[u] - d * t, 0) + (s + d * t.sum()) * parent) / (s + c[u].sum()) for u, t in enumerate(held)]
    return kept / (p.sweeps - p.burn)


SEATED = [[0, 7, 1, 0, 2, 12], [3, 0, 0, 1, 0, 0], [20, 1, 5, 0, 0, 2], [0, 0, 0, 0, 1, 0]]


def test_context_probabilities_against_customers_one_by_one():
    """The chain's averaged probabilities against a Gibbs sampler that keeps every table and moves one customer at a time; both run until their noise is far below the bound."""
    p = pitman_yor.ModelParams(frequent=3, endings=2, sweeps=5000, burn=50)
    k, rng = p.classes, random.Random(7)
    counts = SEATED
    (d, d0, _), (s, s0, _) = p.discounts, p.strengths
    rests, top = [{} for _ in counts], {}

    def up(w):
        n, total = sum(top.get(w, [])), sum(sum(x) for x in top.values())
        return (n - d0 * len(top.get(w, [])) + (s0 + d0 * sum(map(len, top.values()))) / k) / (s0 + total)

    mean, kept = np.zeros((len(counts), k)), 0
    for sweep in range(5000):
        for rest, row in zip(rests, counts):
            for w, c in enumerate(row):
                for _ in range(c):
                    if sweep and leave(rng, rest, w):
                        leave(rng, top, w)
                    for _ in range(seat_one_by_one(rng, rest, w, 1, up(w), d, s)):
                        seat_one_by_one(rng, top, w, 1, 1 / k, d0, s0)
        if sweep >= 50:
            kept += 1
            for u, (rest, row) in enumerate(zip(rests, counts)):
                total = sum(map(len, rest.values()))
                for w, c in enumerate(row):
                    mean[u, w] += (max(c - d * len(rest.get(w, [])), 0) + (s + d * total) * up(w)) / (s + sum(row))
    assert np.abs(chain(counts, p) / (mean / kept) - 1).max() < 0.06


def test_contexts_are_sampled_as_in_one_process(spark):
    p = pitman_yor.ModelParams(frequent=3, endings=2, sweeps=6, burn=2)
    rows = [(u, pitman_yor._packed(np.flatnonzero(r)), pitman_yor._packed(np.array(r)[np.flatnonzero(r)])) for u, r in enumerate(SEATED)]
    got = pitman_yor.sample_contexts(spark.createDataFrame(rows, "context int, dishes binary, counts binary"), p)
    assert np.allclose(got[: len(SEATED)], chain(SEATED, p), rtol=1e-12)


def test_words_after_a_word_have_their_own_restaurant(spark):
    """Rare words of one class and count: the pair that was learnt scores higher than one that was not, after a rare and after a frequent word."""
    names = [f"{a}{b}{c}zz" for a in "abcdefgh" for b in "klmnopqr" for c in "stuvwxyz"][:400]
    seen = [f"{x} {y}" for x, y in zip(names[::2], names[1::2])]
    learnt = [f"the {pair}" for pair in seen for _ in range(3)] + ["the the"] * 50
    asked = [f"{names[0]} {names[1]}", f"{names[0]} {names[3]}", f"the {names[0]} {names[1]}", f"the {names[1]}"]
    d = frame(spark, learnt + asked)
    p = pitman_yor.ModelParams(frequent=1, endings=1, sweeps=6, burn=2)
    got = {r.doc_id: r.score for r in pitman_yor.language_model_scores(d, F.col("doc_id") < len(learnt), p).collect()}
    score = dict(zip(asked, (got[len(learnt) + i] for i in range(len(asked)))))
    assert score[f"{names[0]} {names[1]}"] > score[f"{names[0]} {names[3]}"] + 1
    assert score[f"the {names[0]} {names[1]}"] > score[f"the {names[1]}"]


def test_pairs_are_seated_as_customers_one_by_one():
    """Seated customers and parent's weights against a Gibbs sampler that moves one customer at a time."""
    p = pitman_yor.ModelParams(sweeps=4000, burn=50)
    (d, s), rng = p.pair, random.Random(5)
    context, c, parent = np.array([0, 0, 0, 1, 1, 2]), np.array([1, 5, 2, 7, 0, 0]), np.array([0.2, 0.1, 0.4, 0.3, 0.2, 0.5])
    seated, weight, customers = pitman_yor.seat_pairs(context, c, parent, p, np.random.default_rng(1))
    for u in (0, 1):
        rest, own, mean, top = {}, np.flatnonzero(context == u), np.zeros(3), 0.0
        for sweep in range(4000):
            for w in own.tolist():
                for _ in range(c[w]):
                    if sweep:
                        leave(rng, rest, w)
                    seat_one_by_one(rng, rest, w, 1, parent[w], d, s)
            if sweep >= 50:
                tables = [len(rest.get(w, [])) for w in own.tolist()]
                mean[: len(own)] += [max(c[w] - d * t, 0) for w, t in zip(own.tolist(), tables)]
                top += s + d * sum(tables)
        n = s + c[own].sum()
        assert np.allclose(seated[own], mean[: len(own)] / 3950, rtol=0.06) and abs(weight[u] * n * 3950 / top - 1) < 0.06
        assert customers[u] == c[own].sum() and abs(seated[own].sum() / n + weight[u] - 1) < 1e-9
        assert np.allclose(pitman_yor._decoded(pitman_yor._coded(seated).tobytes()), seated, rtol=4e-4)
    assert seated[5] == 0 and weight[2] == 1


def test_pitman_yor_probabilities_sum_to_one(spark):
    p = pitman_yor.ModelParams(frequent=6, endings=4, sweeps=3, burn=1)
    k = p.classes
    rows = [(u, pitman_yor._packed(np.arange(k)), pitman_yor._packed(np.arange(k) * (u + 1) ** 3)) for u in range(0, k, 2)]
    table = pitman_yor.sample_contexts(spark.createDataFrame(rows, "context int, dishes binary, counts binary"), p)
    assert np.allclose(table.sum(axis=1), 1) and (table > 0).all()
