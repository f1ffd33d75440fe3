"""More registered queries: measures with wildcards, token forms, the tagger's tables, serving with a model, metrics of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.functions import measures as M
from refrain.functions import text as T
from refrain.llm.common import materialise
from refrain.operators import corpus, features, metrics, models, splits, tagger
from refrain.plans import detect as D
from refrain.queries import _ANCHORS, _B, _DF, _LABELLED, _NEXT, _anchors, _docs, _frequency, _labelled, _neighbours, _pair_vectors, _toks, query, read

# --- measures over neighbouring anchors: x the pattern (p: every third token a star), y the text, budget 2 -------------------

_P = f"(select anchor_id, x, y, list_transform(range(1, len(x) + 1), lambda i: case when i % 3 = 0 then '*' else x[i] end) as p from {_NEXT} where y is not null)"


def _starred(spark, d):
    return _neighbours(spark, d).withColumn("p", F.transform("x", lambda t, i: F.when(i % 3 == 2, "*").otherwise(t)))


@query(f"""select anchor_id, list_min(r[2:])::int as distance, (list_max(list_filter(range(1, len(r)), lambda j: r[j + 1] = list_min(r[2:]))) - 1)::int as last from (
  select anchor_id, list_reduce(x, lambda r, w: list_reduce(range(1, len(y) + 1), lambda acc, j: list_append(acc, case when y[j] = w then r[j] else 1 + least(r[j], acc[-1], r[j + 1]) end), [r[1] + 1]),
    list_transform(range(0, len(y) + 1), lambda i: 0::bigint)) as r from {_NEXT} where y is not null)""")
def approximate_place(spark, d):
    """M3: distance and last token of the place in y that is nearest to x."""
    place = M.nearest_place("y", "x")
    return _neighbours(spark, d).withColumn("place", place).select("anchor_id", F.col("place.distance").alias("distance"), F.col("place.end").alias("last"))


_WILD_CELL = """case when y[j] = p[i] then {d} when p[i] = '*' and j >= i then (case when not s.starred then {d} when {u} < {d} and {u} < {l} then {u} + 1 else least({d}, {l}, {u}) end)
  else 1 + least({d}, {l}, {u}) end""".format(d="r[j]", l="s.acc[-1]", u="r[j + 1]")


@query(f"""select anchor_id, list_min(r[2:])::int as distance from (
  select anchor_id, list_reduce(range(1, len(p) + 1), lambda r, i: list_reduce(range(1, len(y) + 1),
      lambda s, j: struct_pack(acc := list_append(s.acc, {_WILD_CELL}), starred := s.starred or (y[j] <> p[i] and p[i] = '*' and j >= i)), struct_pack(acc := [r[1] + 1], starred := false)).acc,
    list_transform(range(0, len(y) + 1), lambda i: 0::bigint)) as r from {_P})""")
def wildcard_distance(spark, d):
    """M4: the distance of the nearest place with stars."""
    return _starred(spark, d).select("anchor_id", M.nearest_place("y", "p")["distance"].alias("distance"))


# The state is what is written and how far the text is read. A star goes on behind the token before it, then takes up to two tokens.
_FROM = "(case when i = 1 then s.j when coalesce(list_position(y[s.j + 1:], p[i - 1]), 0) = 0 then len(y) + 1 else s.j + list_position(y[s.j + 1:], p[i - 1]) end)"
_TAKEN = "(case when i = len(p) or coalesce(list_position(y[{f} + 1:{f} + 2], p[i + 1]), 0) = 0 then y[{f} + 1:{f} + 2] else y[{f} + 1:{f} + list_position(y[{f} + 1:{f} + 2], p[i + 1]) - 1] end)".format(f=_FROM)
_FILLED = f"""(select anchor_id, p, y, list_reduce(range(1, len(p) + 1), lambda s, i: case when p[i] <> '*' then struct_pack(o := list_append(s.o, p[i]), j := s.j) when s.j >= len(y) then s
    else struct_pack(o := list_concat(s.o, {_TAKEN}), j := {_FROM} + len({_TAKEN})) end, struct_pack(o := []::varchar[], j := 0::bigint)).o as f from {_P})"""


@query(f"""select anchor_id, array_to_string(f, '|') as filled,
  coalesce(list_max(list_transform(range(1, len(f) + 1), lambda a: list_max(list_transform(range(1, len(y) + 1), lambda b: coalesce(list_min(list_filter(range(0, least(len(f) - a, len(y) - b) + 1), lambda k: f[a + k] <> y[b + k])), least(len(f) - a, len(y) - b) + 1))))), 0)::int as run,
  list_reduce(f, lambda r, w: list_reduce(range(1, len(y) + 1), lambda acc, j: list_append(acc, case when y[j] = w then r[j] + 1 else greatest(acc[-1], r[j + 1]) end), [0::bigint]), list_transform(range(0, len(y) + 1), lambda i: 0::bigint))[-1]::int as subsequence
  from {_FILLED}""")
def wildcard_measures(spark, d):
    """M6, M9, M10 with a budget of two tokens for a star."""
    two = F.lit(2)
    return _starred(spark, d).select("anchor_id", F.array_join(M.filled("p", "y", two), "|").alias("filled"), M.wildcard_run("p", "y", two).alias("run"), M.wildcard_subsequence("p", "y", two).alias("subsequence"))


@query(f"""select anchor_id, len(list_filter(x, lambda t: list_contains(y, t)))::int as members,
  array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: x[i] not in ({', '.join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)})), lambda i: (i - 1)::varchar || ':' || x[i]), ' ') as kept,
  array_to_string(list_transform(list_filter(range(1, least(15, len(x)) + 1), lambda i: length(x[i]) % 4 <> 0 or i = 1 or length(x[i - 1]) % 4 <> 0), lambda i: case when length(x[i]) % 4 = 0 then '*' else x[i] end), ' ') as pattern
  from {_NEXT} where y is not null""")
def token_maps(spark, d):
    """M12, M14, M15."""
    tags = F.transform("x", lambda t: (F.length(t) % 4 == 0).cast("int"))
    kept = F.transform(M.kept_places(F.col("x"), T.STOP_WORDS), lambda s: F.concat_ws(":", s["place"].cast("string"), s["token"]))
    return _neighbours(spark, d).select("anchor_id", M.set_containment(F.col("x"), F.col("y")).alias("members"), F.array_join(kept, " ").alias("kept"), F.array_join(M.tags_to_pattern(F.col("x"), tags), " ").alias("pattern"))


_CLEAN = r"""regexp_replace(regexp_replace(text, '[."\-,*)(!?#&%$@;:_~\^+=/\n]', ' ', 'g'), '[\[\]\\]', ' ', 'g')"""
_LETTERS = "case when length(t) % 5 = 0 then 'X' when length(t) % 7 = 0 then 'N' else t end"


@query(rf"""select item_id, array_to_string(list_filter(list_transform({_toks(f"regexp_replace({_CLEAN}, '(?i)(n''t|''s|''re|''ve|''ll|''d|''m)\b', ' \1', 'g')")}, lambda t: regexp_replace(t, '^\s*''', '')), lambda t: t <> ''), '|') as words,
  array_to_string(list_transform(w, lambda t: case when length(t) % 5 = 0 then '(\*|\s*\w+\s*)' else t end), ' ') as regex,
  array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: not (l[i] in ('X', 'N') and i > 1 and l[i - 1] in ('X', 'N'))), lambda i: case when l[i] in ('X', 'N') then '*' else lower(l[i]) end), ' ') as pattern,
  array_to_string(list_transform(w, lambda t: case when length(t) % 4 = 0 then '' when length(t) % 3 = 0 then t else t end), '|') as bare
  from (select item_id, text, w, list_transform(w, lambda t: {_LETTERS}) as l from (select item_id, text, {_toks('text')} as w from benchmark))""")
def token_forms(spark, d):
    """Words of every fifth length stand for a star, every fifth and seventh length for wildcard letters; tokens of every fourth
    length get a trailing quote, of the other third ones a leading one."""
    rows = read(spark, d, "benchmark").select("item_id", "text", T.tokens(F.col("text")).alias("w"))
    starred = F.transform("w", lambda t: F.when(F.length(t) % 5 == 0, "*").otherwise(t))
    letters = F.transform("w", lambda t: F.when(F.length(t) % 5 == 0, "X").when(F.length(t) % 7 == 0, "N").otherwise(t))
    quoted = F.transform("w", lambda t: F.when(F.length(t) % 4 == 0, F.concat(t, F.lit("'"))).when(F.length(t) % 3 == 0, F.concat(F.lit("'"), t)).otherwise(t))
    return rows.select("item_id", F.array_join(T.word_tokens(F.col("text")), "|").alias("words"), T.pattern_regex(starred).alias("regex"), F.array_join(T.clean_pattern(letters), " ").alias("pattern"), F.array_join(F.transform(quoted, T.strip_quotes), "|").alias("bare"))


# --- detection ----------------------------------------------------------------------------------------------------------


@query()
def detect_by_windows(spark, d):
    return D.detect_by_windows(_docs(spark, d), _anchors(spark, d))


def _labelled_pairs(spark, d, part=None):
    """What models are fitted on: pairs with three common tokens or more, as whole sentences up to 12 tokens over the anchor and as windows
    beyond. The bound of three is a parameter of the fit; pair_features makes the numbers of all pairs. Equal pairs are one row of weight n, written
    once, by part (a whole number by norm)."""
    return models.with_vector(materialise(_pair_vectors(spark, d, 3, F.lit(0) if part is None else part), "pairs"))


def _catalogue(spark, d):
    """The anchors as a catalogue: every fifth token of a pattern is a star; the hover text names the anchor."""
    pattern = F.transform("words", lambda t, i: F.when(i % 5 == 4, "*").otherwise(t))
    return _anchors(spark, d).select("anchor_id", "words", pattern.alias("pattern"), F.concat(F.lit("from: "), F.col("anchor")).alias("hover"))


@query()
def serve_references(spark, d):
    """The serving plan with a model (P10, F19, W6, W7, J6, K9): a tree fitted on labelled pairs scores the windows of candidates with three common tokens."""
    model = models.fitted("tree", _labelled_pairs(spark, d), "n", depth=5)
    table = corpus.idf(_frequency(spark, d), _docs(spark, d).count()).select("token", "idf")
    return D.serve(_docs(spark, d), _catalogue(spark, d), table, model, min_shared=3)


def _grid_query(spark, d, kind: str, points: list[dict]):
    rows = _labelled_pairs(spark, d, F.pmod(F.crc32(F.col("norm").cast("binary")), F.lit(4)).cast("int"))
    found = models.grid_search(rows.where("part > 0"), rows.where("part = 0"), kind, points, "n")
    return spark.createDataFrame([(i, str(p), m["tp"], m["fp"], m["fn"], m["tn"], m["accuracy"]) for i, (p, m) in enumerate(found)], "place int, point string, tp long, fp long, fn long, tn long, accuracy double")


@query()
def classifier_grid(spark, d):
    """a small grid of trees: one row a point with its measures on the validation part."""
    return _grid_query(spark, d, "tree", models.grid({"depth": [2, 4], "split": [2]}))


@query()
def support_vector_grid(spark, d):
    """one point for each kernel."""
    return _grid_query(spark, d, "svm", models.grid({"c": [1], "kernel": ["linear", "rbf"]}))


@query()
def forest_grid(spark, d):
    """F14, F18."""
    return _grid_query(spark, d, "forest", models.grid({"depth": [4], "split": [2], "trees": [10]}))


@query()
def feature_weights(spark, d):
    """The numbers of the vector by importance in a tree, the greatest first."""
    model = models.fitted("tree", _labelled_pairs(spark, d), "n", depth=4)
    return spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(models.importances(model))], "place int, number int, weight double")


@query("select 'late' as part, doc_id as line_no from documents where doc_id between 100 and 139 union all select 'early', doc_id from documents where doc_id between 1 and 49")
def line_ranges(spark, d):
    """Lines from 100 on, 40 of them; lines from 1 on, which end before line 50. Documents stand for lines."""
    lines = _docs(spark, d).select(F.col("doc_id").alias("line_no"))
    parts = [corpus.line_range(lines, i, j).select(F.lit(n).alias("part"), "line_no") for n, i, j in (("late", 100, 40), ("early", 1, 50))]
    return parts[0].unionByName(parts[1])


# --- metrics of runs ----------------------------------------------------------------------------------------------------


@query(f"select lang, round(sum(label * n_chars) / sum(n_chars), 6) as label, round(sum(conf * n_chars) / sum(n_chars), 6) as conf from {_LABELLED} group by lang")
def weighted_means(spark, d):
    """Means weighted by the size of a batch."""
    return metrics.weighted_means(_labelled(spark, d), ["lang"], ["label", "conf"], "n_chars").select("lang", F.round("label", 6).alias("label"), F.round("conf", 6).alias("conf"))


_BY_SOURCE = f"(select source, round(avg((label = pred)::int), 1) as accuracy from {_LABELLED} group by source)"


@query(f"select 'first' as kept, source, accuracy from (select * from {_BY_SOURCE} order by accuracy desc, source limit 1) union all select 'last', source, accuracy from (select * from {_BY_SOURCE} order by accuracy desc, source desc limit 1)")
def best_parameters(spark, d):
    """Of equal measures the first, and the last, in order."""
    results = _labelled(spark, d).groupBy("source").agg(F.round(F.avg((F.col("label") == F.col("pred")).cast("int")), 1).alias("accuracy"))
    parts = [metrics.best_parameters(results, "accuracy", "source", keep_last=k).select(F.lit(n).alias("kept"), "source", "accuracy") for n, k in (("first", False), ("last", True))]
    return parts[0].unionByName(parts[1])


@query(f"select doc_id, round(conf - 2, 6) as margin from {_LABELLED} where conf - 2 >= 0")
def positive_margins(spark, d):
    """P8."""
    rows = _labelled(spark, d).select("doc_id", (F.col("conf") - 2).alias("margin"))
    return models.positive_margins(rows).withColumn("margin", F.round("margin", 6))


@query(f"select source, count(*) filter (label = 0) as n_neg, count(*) filter (label = 1) as n_pos from {_LABELLED} group by source")
def pairs_by_anchor(spark, d):
    """A4."""
    return tagger.group_sizes(_labelled(spark, d), "source")


# --- the form tagger's tables -------------------------------------------------------------------------------------------


@query(f"select distinct token from (select unnest({_toks('lower(text)')}) as token from conversations union all select unnest({_toks('norm')}) from {_B} union all select token from {_DF} where df > 10)")
def vocabulary_union(spark, d):
    """U2."""
    talk = read(spark, d, "conversations").select(F.explode(T.tokens(F.lower("text"))).alias("token"))
    return tagger.union_of_vocabularies(talk, _anchors(spark, d).select(F.explode("words").alias("token")), _frequency(spark, d).where("df > 10"))


@query(f"""select anchor_id, array_to_string(flatten(list_transform(words, lambda w: list_transform(range(0, (length(w) + 2) // 3), lambda k: substr(w, (3 * k + 1)::int, 3)))), '|') as pieces,
  array_to_string(flatten(list_transform(words, lambda w: list_transform(range(0, (length(w) + 2) // 3), lambda k: (length(w) % 4 = 0)::int))), '') as labels from {_ANCHORS}""")
def subword_labels(spark, d):
    """Words cut into pieces of three characters."""
    cut = F.transform("words", lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) + 2) / 3).cast("int") - 1), lambda k: F.substr(w, k * 3 + 1, F.lit(3))))
    labels = F.transform("words", lambda w: (F.length(w) % 4 == 0).cast("int"))
    pieces, tags = tagger.subword_labels(cut, labels)
    return _anchors(spark, d).select("anchor_id", F.array_join(pieces, "|").alias("pieces"), F.array_join(F.transform(tags, lambda x: x.cast("string")), "").alias("labels"))


_TAGS15 = "list_transform(range(1, 16), lambda i: case when i <= len(words) then (length(words[i]) % 4 = 0)::int else -1 end)"


@query(f"select anchor_id, array_to_string({_TAGS15}, ',') as tags, array_to_string(list_transform(range(1, 16), lambda i: (i <= len(words))::int), '') as mask, len(list_filter({_TAGS15}, lambda x: x <> -1))::int as counted from {_ANCHORS}")
def padded_tags(spark, d):
    """Tags filled up with -1, their mask, and how many count."""
    tags = tagger.padded(F.transform("words", lambda w: (F.length(w) % 4 == 0).cast("int")), fill=-1.0)
    rows = _anchors(spark, d).select("anchor_id", F.transform(tags, lambda x: x.cast("int")).alias("t"), tagger.mask(F.col("words")).alias("m"))
    text = lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by)
    return rows.select("anchor_id", text("t", ",").alias("tags"), text("m", "").alias("mask"), F.size(F.filter("t", lambda x: x != -1)).alias("counted"))


@query(f"""with top as (select token, (row_number() over (order by df desc, token) - 1)::int as idx from {_DF} order by df desc, token limit 500),
  t as (select a.anchor_id, i, coalesce(idx, (select count(*) from top))::int as idx from (select anchor_id, words, unnest(range(1, least(15, len(words)) + 1)) as i from {_ANCHORS}) a left join top on top.token = a.words[a.i])
  select anchor_id as sent, string_agg(idx::varchar, ',' order by i) || repeat(',' || (select count(*) from top)::varchar, (15 - count(*))::int) as seq from t group by anchor_id""")
def index_sequences(spark, d):
    """places of words among the 500 most frequent ones."""
    top = corpus.top_words(_frequency(spark, d), 500)
    tokens = _anchors(spark, d).select(F.col("anchor_id").alias("sent"), F.posexplode("words").alias("pos", "token"))
    return tagger.index_sequence(tokens, top).select("sent", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))


def _word_vectors(spark, d):
    """A vector for each of the most frequent words: row idx of the table embeddings."""
    top = corpus.top_words(_frequency(spark, d), 500)
    return top.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec")), "idx").select("token", "vec")


@query(f"""with top as (select token, (row_number() over (order by df desc, token) - 1)::int as idx from {_DF} order by df desc, token limit 500),
  v as (select token, embedding as e from top join embeddings on vec_id = idx),
  m as (select a.anchor_id, k, avg(e[k]::double) as x from (select anchor_id, unnest(words) as token from {_ANCHORS}) a left join v on v.token = a.token, unnest(range(1, 5)) as u(k) group by a.anchor_id, k)
  select anchor_id, round(max(coalesce(x, 0)) filter (k = 1), 5) as v0, round(max(coalesce(x, 0)) filter (k = 2), 5) as v1, round(max(coalesce(x, 0)) filter (k = 3), 5) as v2, round(max(coalesce(x, 0)) filter (k = 4), 5) as v3 from m group by anchor_id""")
def mean_vectors(spark, d):
    """The first four numbers of each anchor's mean word vector."""
    tokens = _anchors(spark, d).select("anchor_id", F.explode("words").alias("token"))
    out = features.mean_vector(tokens, _word_vectors(spark, d), "anchor_id", 4)
    return out.select("anchor_id", *(F.round(F.get("vec", F.lit(i)), 5).alias(f"v{i}") for i in range(4)))


def _tagger_rows(spark, d):
    """Anchors as the tagger sees them; tags and entities by the length of words, as no tagger is at hand."""
    words = T.with_sentinels(F.col("words"))
    rows = _anchors(spark, d).select(F.col("anchor_id").alias("sent"), F.posexplode(words).alias("pos", "token"))
    mark = lambda labels: F.when(F.col("token").isin(tagger.START, tagger.STOP), F.col("token")).otherwise(F.get(F.array(*map(F.lit, labels[2:])), F.pmod(F.length("token"), F.lit(len(labels) - 2))))
    return rows.withColumn("tag", mark(tagger.POS_TAGS)).withColumn("entity", mark(tagger.NER_TAGS))


def _tagger_vectors(spark, d):
    vectors = _word_vectors(spark, d).select("token", features.fit_length(F.col("vec"), tagger.WORD_WIDTH).alias("vec"))
    table = corpus.idf(_frequency(spark, d), _docs(spark, d).count()).select("token", "idf")
    return tagger.token_vectors(_tagger_rows(spark, d), vectors, table)


@query()
def token_vectors(spark, d):
    """704 numbers for each token of the anchors."""
    return _tagger_vectors(spark, d)


@query()
def tagged_patterns(spark, d):
    """F15's stand-in and M14: a tagger fitted on three quarters of the anchors gives each anchor's pattern."""
    rows = _tagger_rows(spark, d).select("sent", "pos", "token")
    truth = (F.length("token") % 4 == 0) & ~F.col("token").isin(tagger.START, tagger.STOP)
    # A row for each token of the anchors, read many times by the fit: the pass over documents behind it is made once.
    x = materialise(_tagger_vectors(spark, d).join(rows, ["sent", "pos"]).withColumn("tag", truth.cast("int")), "tagged")
    found = tagger.train_tagger(x.where(F.pmod(F.xxhash64("sent"), F.lit(4)) > 0)).tags(x.select("sent", "pos", "features"))
    words = _anchors(spark, d).select(F.col("anchor_id").alias("sent"), T.with_sentinels(F.col("words")).alias("words"))
    return tagger.patterns(found.join(words, "sent")).select("sent", F.array_join("pattern", " ").alias("pattern"))


@query(f"select a.source, a.doc_id from (select *, row_number() over (partition by label order by md5(doc_id::varchar || '|0' )) as rn from {_LABELLED}) a where rn <= (select least(count(*) filter (label = 0), count(*) filter (label = 1)) from {_LABELLED})")
def balanced(spark, d):
    """W9 over all rows."""
    return splits.balance(_labelled(spark, d), "label", [], splits.shuffle_key("doc_id")).select("source", "doc_id")
