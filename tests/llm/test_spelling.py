"""Spelling variants against all pairs of words."""

import random
import re
import zlib

from repograph.llm import spelling

P = spelling.SpellingParams


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, p):
    count = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % p.noise == 0 else run
            count[word] = count.get(word, 0) + 1
    words = {w: n for w, n in count.items() if len(w) >= p.shortest and n >= p.least}
    found = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in found.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= p.times * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(found[w]), words[form[w]] if w in form else None))
    return out


def found(spark, rows, p):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(d, p).collect()]
    assert len(got) == len(set(got))
    return set(got)


def rows(seed, alphabet, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.randint(4, 8))) for _ in range(40)]

    def word():
        w = rng.choice(base)
        if rng.random() < 0.4:
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
        return w.upper() if rng.random() < 0.1 and w.isascii() else w

    out = [(i, "".join(word() + rng.choice([" ", ", ", "-", "\n", "1"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return out + out[:2] + [(None, out[0][1]), (90, None), (91, ""), (92, " \n "), (93, ("x" * 3000 + " ") * 4 + ("x" * 3001 + " ") * 9)]


def test_variants_against_all_pairs(spark):
    for seed, alphabet, p in ((1, "ab", P()), (2, "abcÀé÷", P(noise=5)), (3, "abcdefgh", P(least=1, shortest=2))):
        assert found(spark, rows(seed, alphabet), p) == brute(rows(seed, alphabet), p)
    assert found(spark, [], P()) == set()


def test_large_partitions_are_split_without_loss(spark):
    for block in (1, 2, 5):
        for shortest in (2, 5):
            p = P(block=block, shortest=shortest, least=1, noise=7)
            assert found(spark, rows(4, "ab", 30), p) == brute(rows(4, "ab", 30), p)


def test_chains_are_followed_to_their_ends(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc"]
    text = " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k))
    got = {r[0]: r[2] for r in found(spark, [(1, text)], P(noise=10**9))}
    assert got == dict.fromkeys(words, "bbbcc")


def test_acceptor_is_minimal():
    rng = random.Random(5)
    for _ in range(50):
        words = sorted({"".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 25))})
        m = spelling.Acceptor(words)
        reached, todo, languages = {0}, [0], {}
        while todo:
            for x in m.arcs[todo.pop()].values():
                if x not in reached:
                    reached.add(x)
                    todo.append(x)

        def language(s):
            if s not in languages:
                languages[s] = frozenset(([""] if m.final[s] else []) + [c + t for c, x in m.arcs[s].items() for t in language(x)])
            return languages[s]

        assert language(0) == set(words) and len({language(s) for s in reached}) == len(reached)
