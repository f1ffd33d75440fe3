"""Measures of token sequences.

Those that are plain dynamic programmes are column expressions; those that walk back over their own table run as Arrow-batched
functions, and their kernels are plain Python that tests compare with brute force.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from refrain.functions.stem import stem
from refrain.functions.text import STOP_WORDS

_INT, _WORDS = Y.IntegerType(), Y.ArrayType(Y.StringType())
_PLACE = Y.StructType([*(Y.StructField(c, _INT) for c in ("distance", "start", "end")), Y.StructField("tokens", _WORDS)])
_OUTCOME = Y.StructType([Y.StructField("outcome", Y.StringType()), Y.StructField("distance", _INT), Y.StructField("span", _WORDS)])
_PAIR = Y.StructType([Y.StructField("text", _WORDS), Y.StructField("pattern", _WORDS)])

STAR = "*"
_STOP = frozenset(STOP_WORDS)


def levenshtein(a: Column, b: Column) -> Column:
    """M1: unit-cost edit distance of two arrays."""

    def next_row(row: Column, x: Column) -> Column:
        start = F.array((F.element_at(row, 1) + 1).cast("int"))
        grow = lambda acc, j: F.concat(acc, F.array(F.least(F.element_at(acc, -1) + 1, F.get(row, j + 1) + 1, F.get(row, j) + (F.get(b, j) != x).cast("int")).cast("int")))
        return F.when(F.size(b) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0))), start, grow))

    return F.element_at(F.aggregate(a, F.sequence(F.lit(0), F.size(b)).cast("array<int>"), next_row), -1)


def common_subsequence(a: Column, b: Column) -> Column:
    """M8: length of the longest common subsequence."""

    def next_row(row: Column, x: Column) -> Column:
        grow = lambda acc, j: F.concat(acc, F.array(F.when(F.get(b, j) == x, F.get(row, j) + 1).otherwise(F.greatest(F.element_at(acc, -1), F.get(row, j + 1))).cast("int")))
        return F.when(F.size(b) == 0, row).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0))), F.array(F.lit(0)), grow))

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), next_row), -1)


def containment(pattern: Column, sentence: Column) -> Column:
    """How many pattern tokens find a sentence token of their own: the sum of the smaller multiplicities."""
    times = lambda words, t: F.size(F.filter(words, lambda x: x == t))
    return F.aggregate(F.array_distinct(pattern), F.lit(0), lambda n, t: n + F.least(times(pattern, t), times(sentence, t)))


def found_tokens(pattern: Column, sentence: Column) -> Column:
    """The pattern tokens that find one, in order: occurrence k of a token does if the sentence has it k times."""
    times = lambda words, t: F.size(F.filter(words, lambda x: x == t))
    return F.filter(pattern, lambda t, i: times(F.slice(pattern, F.lit(1), i + 1), t) <= times(sentence, t))


def set_containment(pattern: Column, sentence: Column) -> Column:
    """M12."""
    return F.size(F.filter(pattern, lambda t: F.array_contains(sentence, t)))


def kept_places(words: Column, stop: list[str]) -> Column:
    """The words that are no stop words, each with its place."""
    return F.filter(F.transform(words, lambda t, i: F.struct(t.alias("token"), i.alias("place"))), lambda s: ~s["token"].isin(*stop))


def tags_to_pattern(words: Column, tags: Column, collapse: bool = True, most: int = 15) -> Column:
    """Tagged tokens become stars, a run of them one star if collapsed; at most so many tokens are read."""
    w, t = F.slice(words, 1, most), F.slice(tags, 1, most)
    marked = F.zip_with(w, t, lambda x, g: F.when(g == 1, F.lit(STAR)).otherwise(x))
    return F.filter(marked, lambda x, i: ~((x == STAR) & (i > 0) & (F.get(marked, i - 1) == STAR))) if collapse else marked


# --- kernels ------------------------------------------------------------------------------------------------------------


def approximate_place(text: list[str], pattern: list[str], wildcards: bool) -> tuple[int, int, int, list[str]]:
    """M3 and M4: (distance, start, end, tokens) of the place in text that is nearest to pattern; end is the last token's place.

    A row for each pattern token, a column for each text token; row 0 is free. With wildcards a star's first open column j >= i in its
    row is a free step along the diagonal, later ones cost only when they come from above. Each cell carries where its path starts.
    """
    cost, start = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, p in enumerate(pattern, 1):
        row, origin, open_star, starred = [i], [0], wildcards and p == STAR, False
        for j, t in enumerate(text):
            diagonal, left, up = cost[j], row[j], cost[j + 1]
            if t == p:
                row.append(diagonal)
                origin.append(start[j])
                continue
            if diagonal <= left and diagonal <= up:
                least, begin, above = diagonal, start[j], False
            elif left <= up:
                least, begin, above = left, origin[j], False
            else:
                least, begin, above = up, start[j + 1], True
            if not open_star or j + 1 < i:
                row.append(least + 1)
            elif starred:
                row.append(least + above)
            else:
                row.append(diagonal)
                begin, starred = start[j], True
            origin.append(begin)
        cost, start = row, origin
    if not text or not pattern:
        return len(pattern), 0, -1, []
    least = min(cost[1:])
    end = max(j for j in range(1, len(cost)) if cost[j] == least)
    return least, start[end], end - 1, text[min(start[end], end - 1) : end]


def run_with_replacements(x: list[str], y: list[str], budget: int) -> int:
    """M5: the longest run on a diagonal with up to `budget` unequal pairs, as the published table defines it.

    A cell is (length, spent). Past the budget the run restarts behind an earlier replacement, which is looked for back along the diagonal.
    """
    best, width = 0, len(y)
    table = {}
    at = lambda i, j: table.get((i, j), (0, 0))
    for i in range(1, len(x) + 1):
        for j in range(1, width + 1):
            length, spent = at(i - 1, j - 1)
            if x[i - 1] == y[j - 1]:
                new, total = length + 1, spent
            elif spent < budget:
                new, total = length + 1, spent + 1
            elif not budget:
                new, total = 0, 0
            else:
                # Lengths on the way back: the one above the first replacement, and the one where two became one.
                diagonal = []
                step = 1
                while not diagonal or diagonal[-1][1]:
                    diagonal.append(at(i - step, j - step))
                    step += 1
                path = [(length, spent), *diagonal]
                first = path[-2][0]
                second = next((path[k][0] for k in range(len(path) - 1) if path[k][1] == 2 and path[k + 1][1] == 1), length)
                new, total = second - first + 1, spent
            table[i, j] = new, total
            best = max(best, new)
    return best


def fill_wildcards(pattern: list[str], text: list[str], budget: int) -> list[str]:
    """M6: each star becomes up to `budget` text tokens, those before the pattern's next token; the text is read once, forward."""
    out, at = [], 0
    for i, p in enumerate(pattern):
        if p != STAR:
            out.append(p)
            continue
        if at >= len(text):
            continue
        if i:  # the text goes on behind the pattern's token before the star
            at = next((j for j in range(at, len(text)) if text[j] == pattern[i - 1]), len(text)) + 1
        stop = pattern[i + 1] if i + 1 < len(pattern) else None
        taken = 0
        while taken < budget and at < len(text) and text[at] != stop:
            out.append(text[at])
            at, taken = at + 1, taken + 1
    return out


def drop_wildcards(pattern: list[str], text: list[str], budget: int) -> tuple[list[str], list[str]]:
    """M7: (text without what a star stands for, pattern without stars).

    Fixed tokens pass one for one. At a star the pattern's next token is awaited: while the budget holds, text tokens up to it are kept and
    the star is passed; a star at the end keeps the rest. When the next token stands there at once it is kept and passed too, but stays
    to be read again.
    """
    out, i, j = [], 0, 0
    while j < len(text):
        p = pattern[i] if i < len(pattern) else None
        if p is None:
            return out + text[j:], [t for t in pattern if t != STAR]
        following = pattern[i + 1] if i + 1 < len(pattern) else None
        if p != STAR or text[j] == STAR:
            out.append(text[j])
            i, j = i + 1, j + 1
        elif following is not None and following == text[j]:
            out.append(text[j])
            i += 2
        elif budget <= 0:
            j += 1
        elif following is None:
            return out + text[j:], [t for t in pattern if t != STAR]
        else:
            end = next((k for k in range(j, len(text)) if text[k] == following), len(text))
            out, i, j = out + text[j:end], i + 1, end
    return out, [t for t in pattern if t != STAR]


def common_run(x: list[str], y: list[str]) -> int:
    """The longest run of tokens that both have."""
    places: dict[str, list[int]] = {}
    for j, b in enumerate(y):
        places.setdefault(b, []).append(j)
    best, row = 0, {}
    for a in x:
        row = {j: row.get(j - 1, 0) + 1 for j in places.get(a, ())}
        if row:
            best = max(best, max(row.values()))
    return best


def subsequence_length(x: list[str], y: list[str]) -> int:
    """The longest common subsequence, a bit for each token of y."""
    masks: dict[str, int] = {}
    for j, b in enumerate(y):
        masks[b] = masks.get(b, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = full
    for a in x:
        hit = rows & masks.get(a, 0)
        rows = (rows + hit | rows - hit) & full
    return len(y) - rows.bit_count()


def run_with_wildcards(pattern: list[str], text: list[str], budget: int) -> int:
    """M9."""
    return common_run(fill_wildcards(pattern, text, budget), text)


def subsequence_with_wildcards(pattern: list[str], text: list[str], budget: int) -> int:
    """M10."""
    return subsequence_length(fill_wildcards(pattern, text, budget), text)


def pair_numbers(pattern: list[str], cand: list[str], anchor: list[str], budgets: tuple[int, ...]) -> list[float]:
    """The measures of F1: M4 of pattern and anchor by their lengths, then M9 and M10 of both for each budget, by the pattern's length."""
    out = [approximate_place(cand, p, True)[0] / len(p) for p in (pattern, anchor)]
    filled = [[fill_wildcards(p, cand, r) for r in budgets] if STAR in p else [p] for p in (pattern, anchor)]
    for measure in (common_run, subsequence_length):
        for many in filled:
            found = {}
            for f in many:
                key = tuple(f)
                if key not in found:
                    found[key] = measure(f, cand)
                out.append(found[key])
            if len(many) < len(budgets):
                out += [out[-1]] * (len(budgets) - 1)
    return out


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def best_window_distance(a: list[str], b: list[str]) -> int:
    """M2: over stems: the least edit distance of a and a window of b as long as a; of the whole b, if a is longer."""
    a, b = [stem(t) for t in a], [stem(t) for t in b]
    if len(a) > len(b):
        return edit_distance(a, b)
    return min(edit_distance(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def align_pattern(pattern: list[str], sentence: list[str]) -> list[str]:
    """The sentence as a pattern. Behind the pattern's end every token is a star; the next fixed token stays; under a star a token
    becomes a star, and the pattern goes on once its next token is the sentence's next one; tokens that fit neither go.

    Where the sentence ends before that look-ahead, what is there already is the result."""
    out, at = [], 0
    for i, token in enumerate(sentence):
        if at == len(pattern):
            out.append(STAR)
        elif pattern[at] == token:
            out.append(token)
            at += 1
        elif pattern[at] == STAR:
            if at + 1 < len(pattern) and i + 1 == len(sentence):
                break
            if at + 1 == len(pattern) or pattern[at + 1] == sentence[i + 1]:
                at += 1
            out.append(STAR)
    return out


def rule(pattern_size: int, text_size: int, bare_size: int, distance: int) -> str:
    """The outcome of P4 and P5: 'stop' (a quote), 'match' or 'none', from the sizes of both with stop words, the lesser size without, and the
    distance. Fixed values: the rule's bounds; that of five tokens can't hold."""
    lp, ls, d = min(pattern_size, text_size), bare_size, distance
    if ls >= 2 and d == 0:
        return "stop"
    near = (lp == 4 and ls == 4 and d <= 1) or (lp == 5 and ls > 5 and d <= 1) or (lp == 6 and ls >= 5 and d <= 1) or (lp > 6 and ls > 3 and d <= 2)
    return "match" if near else "none"


def bare_stems(words: list[str]) -> tuple[list[str], list[int]]:
    """Stems of the words that are no stop words, and their places."""
    places = [i for i, t in enumerate(words) if t not in _STOP]
    return [stem(words[i]) for i in places], places


def fuzzy_decision(text: list[str], pattern: list[str]) -> tuple[str, int | None, list[str]]:
    """(outcome, distance, the words of text from the first to the last one matched)."""
    one, places = bare_stems(text)
    two, _ = bare_stems(pattern)
    if not one or not two:
        return "none", None, []
    distance, start, end, _ = approximate_place(one, two, False)
    outcome = rule(len(pattern), len(text), min(len(one), len(two)), distance)
    span = text[places[start] : places[end] + 1] if outcome != "none" and start <= end else []
    return outcome, distance, span


def windowed_decision(pattern: list[str], text: list[str]) -> tuple[str, list[str]]:
    """P5: the rule over each window of text that is as long as pattern, by edit distance: 'stop' at the first quote, else 'match' with
    the words from the first to the last window accepted, else 'none'."""
    one, _ = bare_stems(pattern)
    first, last, width = None, 0, len(pattern)
    for i in range(len(text) - width + 1):
        two, _ = bare_stems(text[i : i + width])
        outcome = rule(width, width, min(len(one), len(two)), edit_distance(one, two))
        if outcome == "stop":
            return "stop", []
        if outcome == "match":
            first, last = i if first is None else first, i + width
    return ("none", []) if first is None else ("match", text[first:last])


def _over(kernel, *columns: pd.Series) -> pd.Series:
    return pd.Series([kernel(*(c.tolist() if hasattr(c, "tolist") else c for c in row)) for row in zip(*columns, strict=True)])


@F.pandas_udf(_PLACE)
def nearest_place(text: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    """M4 on columns (M3 where the pattern has no star)."""
    return pd.DataFrame([approximate_place(list(t), list(p), True) for t, p in zip(text, pattern, strict=True)], columns=["distance", "start", "end", "tokens"])


@F.pandas_udf(_INT)
def replaced_run(x: pd.Series, y: pd.Series, budget: pd.Series) -> pd.Series:
    return _over(run_with_replacements, x, y, budget)


@F.pandas_udf(_INT)
def wildcard_run(x: pd.Series, y: pd.Series, budget: pd.Series) -> pd.Series:
    return _over(run_with_wildcards, x, y, budget)


@F.pandas_udf(_INT)
def wildcard_subsequence(x: pd.Series, y: pd.Series, budget: pd.Series) -> pd.Series:
    return _over(subsequence_with_wildcards, x, y, budget)


@F.pandas_udf(_WORDS)
def filled(pattern: pd.Series, text: pd.Series, budget: pd.Series) -> pd.Series:
    return _over(fill_wildcards, pattern, text, budget)


@F.pandas_udf(_PAIR)
def dropped(pattern: pd.Series, text: pd.Series, budget: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([drop_wildcards(list(p), list(t), int(b)) for p, t, b in zip(pattern, text, budget, strict=True)], columns=["text", "pattern"])


@F.pandas_udf(_INT)
def window_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return _over(best_window_distance, a, b)


@F.pandas_udf(_WORDS)
def aligned(pattern: pd.Series, sentence: pd.Series) -> pd.Series:
    return _over(align_pattern, pattern, sentence)


@F.pandas_udf(_OUTCOME)
def decided(text: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    """P4 on columns."""
    return pd.DataFrame([fuzzy_decision(list(t), list(p)) for t, p in zip(text, pattern, strict=True)], columns=["outcome", "distance", "span"]).astype({"distance": "Int32"})


@F.pandas_udf(_OUTCOME)
def decided_by_windows(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
    """P5 on columns."""
    found = [windowed_decision(list(p), list(t)) for p, t in zip(pattern, text, strict=True)]
    return pd.DataFrame([(o, None, s) for o, s in found], columns=["outcome", "distance", "span"]).astype({"distance": "Int32"})


@F.arrow_udf(_WORDS)
def bare_stem_array(words: pa.Array) -> pa.Array:
    """T8 and T9 on token arrays. Each different token of a batch is stemmed once."""
    flat = words.flatten().dictionary_encode()
    known = flat.dictionary.to_pylist()
    stems = pa.array([None if t in _STOP else stem(t) for t in known], pa.string())
    each = stems.take(flat.indices)
    kept = pc.is_valid(each).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(kept)))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(before[np.concatenate(([0], ends))].astype(np.int32)), each.drop_null())


def contained(words: list[str], values: list[float], cand: list[str], cap: float) -> tuple[list[float], list[float]]:
    """The capped values of the words that stand in cand, each place of cand used once, and of those that don't."""
    left: dict[str, int] = {}
    for t in cand:
        left[t] = left.get(t, 0) + 1
    found, missed = [], []
    for t, v in zip(words, values, strict=True):
        if left.get(t, 0) > 0:
            left[t] -= 1
            found.append(min(v, cap))
        else:
            missed.append(min(v, cap))
    return found, missed
