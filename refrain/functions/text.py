"""Text functions on columns, all built-in expressions. Ids such as T1 are those of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation that normalisation deletes, and the stop words of the public 179-word English list.
PUNCTUATION = r"""[."\-,*)(!?#&%$@;:_~\^+=/\n]"""
PUNCTUATION_KEEPING_STAR = r"""[."\-,)(!?#&%$@;:_~\^+=/\n]"""
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs "
    "themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't "
    "hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
# The short stop list of the form data's tails, and its wildcard letters.
TAIL_STOP_WORDS = "by a the is in at was how".split()
WILDCARD_LETTERS = "X Y Z N M V".split()
SENTENCE = r"[^.!?]+[.!?]*"


def strip_punctuation(c: Column, keep_star: bool = False) -> Column:
    """Punctuation and line ends are deleted, so words on both sides of a line end join."""
    return F.regexp_replace(c, PUNCTUATION_KEEPING_STAR if keep_star else PUNCTUATION, "")


def punctuation_to_space(c: Column) -> Column:
    """T2."""
    return F.regexp_replace(c, PUNCTUATION, " ")


def collapse_double_space(c: Column) -> Column:
    """Each pair of white space becomes one space, in one pass (four become two)."""
    return F.regexp_replace(c, r"\s\s", " ")


def tokens(c: Column) -> Column:
    """T5: the words between white space; none: an empty array."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def sentences(c: Column) -> Column:
    """A run without an end mark, with the end marks after it."""
    return F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0))


def script_sentences(c: Column) -> Column:
    """Cut at an ellipsis or an end mark, lower-cased; empty pieces, single spaces and single line ends go."""
    return F.transform(F.filter(F.split(c, r"\.{3}|[!?.]"), lambda s: ~s.isin("", " ", "\n")), F.lower)


def normal(c: Column) -> Column:
    """What sentences are compared by."""
    return F.lower(strip_punctuation(c))


def without_stop_words(words: Column) -> Column:
    """T8."""
    return F.filter(words, lambda t: ~t.isin(*STOP_WORDS))


def word_tokens(c: Column) -> Column:
    """Words with contractions parted (n't, 's, 're, 've, 'll, 'd, 'm), brackets and marks as spaces."""
    spaced = F.regexp_replace(F.regexp_replace(c, PUNCTUATION, " "), r"[\[\]\\]", " ")
    parted = F.regexp_replace(spaced, r"(?i)(n't|'s|'re|'ve|'ll|'d|'m)\b", " $1")
    return F.filter(F.transform(tokens(parted), lambda t: F.regexp_replace(t, r"^\s*'", "")), lambda t: t != "")


def unquote(c: Column) -> Column:
    """A pair of single quotes that no word touches from outside goes."""
    return F.regexp_replace(c, r"(^|[^\w'])'([^']*)'(?!\w)", "$1$2")


def pattern_regex(pattern: Column) -> Column:
    r"""Fixed words as they are, a wildcard as a literal star or one word; joined by spaces."""
    return F.array_join(F.transform(pattern, lambda t: F.when(t == "*", F.lit(r"(\*|\s*\w+\s*)")).otherwise(t)), " ")


def is_year(c: Column) -> Column:
    """Begins with two digits or more."""
    return c.rlike(r"^\d{2,4}")


def clean_tail(words: Column) -> Column:
    """Lower-cased; a last token that is, as written, a stop word of the short list or a year goes."""
    lowered = F.transform(words, F.lower)
    last = F.get(words, F.size(words) - 1)
    drop = (F.size(lowered) > 0) & (last.isin(*TAIL_STOP_WORDS) | is_year(last))
    return F.when(drop, F.slice(lowered, F.lit(1), F.greatest(F.lit(0), F.size(lowered) - 1))).otherwise(lowered)


def clean_pattern(words: Column) -> Column:
    """Runs of wildcard letters become one star, other tokens lower case."""
    is_wild = lambda t: t.isin(*WILDCARD_LETTERS)
    kept = F.filter(words, lambda t, i: ~(is_wild(t) & (i > 0) & is_wild(F.coalesce(F.get(words, i - 1), F.lit("")))))
    return F.transform(kept, lambda t: F.when(is_wild(t), F.lit("*")).otherwise(F.lower(t)))


def tags(pattern: Column) -> Column:
    """1 for a wildcard, else 0."""
    return F.transform(pattern, lambda t: (t == "*").cast("int"))


def with_sentinels(words: Column) -> Column:
    """T17."""
    return F.concat(F.array(F.lit("<START>")), words, F.array(F.lit("<STOP>")))


def line_class(c: Column) -> Column:
    """Of a script's line: blank, html, aside (in parentheses), speaker (upper case) or speech."""
    bare = F.trim(c)
    return F.when(bare == "", "blank").when(bare.rlike(r"<[^>]+>"), "html").when(bare.rlike(r"^\(.*\)$"), "aside").when((F.upper(bare) == bare) & bare.rlike(r"[A-Z]"), "speaker").otherwise("speech")


def decoded(raw: Column) -> Column:
    """UTF-8, or else Windows-1252 (Latin-1 with the block 0x80 to 0x9F replaced)."""
    # The code points of Windows-1252 bytes 0x80 to 0x9F; undefined ones stay.
    block = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
    return F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8")).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, range(128, 160))), block))


def strip_quotes(token: Column) -> Column:
    """A token that ends in a quote becomes that quote alone, and then loses a leading quote: `dogs'` gives an empty string."""
    last = F.when(token.endswith("'"), F.lit("'")).otherwise(token)
    return F.when(last.startswith("'"), F.substring(last, 2, 1_000_000)).otherwise(last)
