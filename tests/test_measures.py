import random
from functools import lru_cache

from pyspark.sql import functions as F

from refrain.functions import measures as M
from refrain.functions.stem import stem


def _pairs(n, seed, star=False):
    rng = random.Random(seed)
    letters = "abc" + ("*" if star else "")
    return [([rng.choice("abc") for _ in range(rng.randint(1, 7))], [rng.choice(letters) for _ in range(rng.randint(1, 5))]) for _ in range(n)]


def _distance(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


def test_plain_place_is_the_nearest_substring():
    for text, pattern in _pairs(300, 1):
        least = min(_distance(tuple(text[i:j]), tuple(pattern)) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        got = M.approximate_place(text, pattern, False)
        assert got[0] == least


def test_wildcard_place_without_stars_is_the_plain_one():
    for text, pattern in _pairs(200, 2):
        assert M.approximate_place(text, pattern, True) == M.approximate_place(text, pattern, False)


def test_wildcards_golden():
    say = "say hello to my little friend".split()
    assert M.approximate_place(say, "hello to * little".split(), True)[0] == 0
    assert M.approximate_place(say, "hello to her little".split(), False)[:3] == (1, 1, 4)
    assert M.fill_wildcards("hello * my".split(), say, 2) == ["hello", "to", "my"]
    assert M.fill_wildcards("* to".split(), say, 3) == ["say", "hello", "to"]
    assert M.fill_wildcards("my *".split(), say, 1) == ["my", "little"]
    assert M.fill_wildcards("gone * *".split(), say, 2) == ["gone"]
    assert M.drop_wildcards("say * my".split(), "say my".split(), 1) == (["say", "my", "my"], ["say", "my"])
    assert M.run_with_wildcards("hello * my".split(), say, 1) == 3
    assert M.subsequence_with_wildcards("say * friend".split(), say, 0) == 2


def test_alignment_golden():
    align = lambda p, s: M.align_pattern(p.split(), s.split())
    assert align("say * to", "say good day to you") == ["say", "*", "*", "to", "*"]
    assert align("say * to", "say to you to") == ["say", "*", "*", "to"]
    assert align("the *", "the end of it") == ["the", "*", "*", "*"]
    assert align("a * b", "a x") == ["a"]  # the look-ahead runs off the end
    assert align("a b", "x a y b") == ["a", "b"]
    assert align("", "a b") == ["*", "*"]


def test_decision_rules():
    rows = [("four words stay here", "four words stay here"), ("completely other things", "four words stay"), ("brave knights seldom ride dragons over frozen mountains", "brave knights seldom ride horses over frozen mountains")]
    assert [M.fuzzy_decision(a.split(), b.split())[0] for a, b in rows] == ["stop", "none", "match"]
    text = "yesterday brave knights often ride dragons over frozen mountains tomorrow"
    outcome, distance, span = M.fuzzy_decision(text.split(), "brave knights seldom ride dragons over frozen mountains".split())
    assert (outcome, distance, span) == ("match", 1, text.split()[1:9])
    assert M.fuzzy_decision(["the"], ["of"]) == ("none", None, [])
    # Sizes with stop words decide which bound holds: four words of which one is a stop word have three left.
    assert M.rule(4, 9, 3, 1) == "none" and M.rule(4, 9, 4, 1) == "match" and M.rule(5, 9, 5, 1) == "none" and M.rule(7, 9, 4, 2) == "match" and M.rule(6, 9, 5, 1) == "match"
    assert M.windowed_decision("brave knights seldom ride dragons over frozen mountains".split(), text.split()) == ("match", text.split()[1:9])
    assert M.windowed_decision("frozen mountains".split(), text.split())[0] == "stop" and M.windowed_decision(["too", "long"], ["one"]) == ("none", [])


def test_run_with_replacements():
    x = "a b c d e".split()
    assert M.run_with_replacements(x, "a b c d e".split(), 0) == 5
    assert M.run_with_replacements(x, "a b x d e".split(), 0) == 2
    assert M.run_with_replacements(x, "a b x d e".split(), 1) == 5
    assert M.run_with_replacements(x, "a y x d e".split(), 1) == 3


def test_columns_equal_kernels(spark):
    pairs = _pairs(60, 3)
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = rows.select("a", "b", M.levenshtein(F.col("a"), F.col("b")).alias("l"), M.common_subsequence(F.col("a"), F.col("b")).alias("c"), M.containment(F.col("b"), F.col("a")).alias("m")).collect()
    for r in got:
        assert r.l == _distance(tuple(r.a), tuple(r.b))
        assert r.c == M.subsequence_length(r.a, r.b)
        assert r.m == sum(min(r.a.count(t), r.b.count(t)) for t in set(r.b))


def test_measures_against_slow_rewrites():
    """M4 by its table as written down, M2 by all windows, M5's budget of two and more by its walk back, M6 to M10 by small cases."""
    for text, pattern in _pairs(200, 7, star=True):
        table = {(0, j): 0 for j in range(len(text) + 1)} | {(i, 0): i for i in range(1, len(pattern) + 1)}
        for i, p in enumerate(pattern, 1):
            starred = False
            for j, t in enumerate(text, 1):
                diagonal, left, up = table[i - 1, j - 1], table[i, j - 1], table[i - 1, j]
                if t == p:
                    table[i, j] = diagonal
                elif p == "*" and j >= i:
                    least = min(diagonal, left, up)
                    table[i, j] = (least + (diagonal > least and left > least)) if starred else diagonal
                    starred = True
                else:
                    table[i, j] = 1 + min(diagonal, left, up)
        assert M.approximate_place(text, pattern, True)[0] == min(table[len(pattern), j] for j in range(1, len(text) + 1))
    for x, y in _pairs(100, 8):
        stems = [stem(t) for t in x], [stem(t) for t in y]
        best = _distance(*map(tuple, stems)) if len(x) > len(y) else min(_distance(tuple(stems[0]), tuple(stems[1][i : i + len(x)])) for i in range(len(y) - len(x) + 1))
        assert M.best_window_distance(x, y) == best
        unequal = [[a != b for a, b in zip(x[i:], y[j:])] for i in range(len(x)) for j in range(len(y))]
        assert M.run_with_replacements(x, y, 9) == max(len(d) for d in unequal)
        assert M.run_with_replacements(x, y, 0) == M.common_run(x, y)


def test_empty_arrays(spark):
    rows = spark.createDataFrame([([], ["a", "b"]), (["a"], []), ([], [])], "a array<string>, b array<string>")
    got = rows.select(M.levenshtein(F.col("a"), F.col("b")).alias("l"), M.common_subsequence(F.col("a"), F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(2, 0), (1, 0), (0, 0)]


def test_stem():
    words = {"caresses": "caress", "ponies": "poni", "running": "run", "relational": "relat", "hopeful": "hope", "sky": "sky", "happy": "happi", "agreed": "agre", "falling": "fall", "adjustment": "adjust"}
    assert {w: stem(w) for w in words} == words


def test_stem_arrays_equal_plain_stems(spark):
    rows = [(["running", "the", "dogs", "running"],), ([],), (["the", "of"],), (["ponies"],)]
    got = spark.createDataFrame(rows, "w array<string>").coalesce(1).select(M.bare_stem_array("w").alias("s")).collect()
    assert [r.s for r in got] == [M.bare_stems(w)[0] for w, in rows]
