"""Queries over texts and score layers: keywords, fusion, moderation, tracks; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import fusion, keywords, moderation, scorers
from brindle.operators.lexicon import hit_counts, hits_table, lexicon_hits
from brindle.sources import vocabulary
from brindle.sources.vocabulary import Rule
from brindle.staging import scratch, spread, table

RULES = [
    Rule("ther|thon", "#Theory"), Rule("tion | er", "#Action"), Rule("der|die|das", "#German"), Rule("une|dans", "#French"),
    Rule("los|las", "#Spanish"), Rule("with|from", "#Relations"), Rule("trash|scum|idiot", "#Insults"),
    Rule("apache.license", "#License"), Rule("that|this", "#Pointers"), Rule("wor.hless|stu.id", "#Marine"),
]
TAGS = [
    "#Theory", "#Action", "#German", "#French", "#Spanish", "#Relations", "#Insults", "#License", "#Pointers", "#Under",
    "#Erand", "#BreakingNews", "#Weather-Report", "#Chess", "#Opera", "#Jazz", "#Rivers", "#Which", "#Version",
]
CATEGORIES = ["German", "French", "World News", "License", "Theory", "Spanish", "Poetry", "Insults", "Action", "Poetry"]
BLOCKED = ["german", "the"]

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def share(key: Column, k: int) -> Column:
    """A number in [0, 1) from a key, three decimals: a stand-in for a model's score."""
    return ((key * 7919 + k * 104729) % 1000) / F.lit(1000.0)


def _share(key: str, k: int) -> str:
    return f"((({key}) * 7919 + {k * 104729}) % 1000) / 1000::DOUBLE"


def _values(rows: list) -> str:
    quoted = [", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) for r in rows]
    return "(VALUES " + ", ".join(f"({q})" for q in quoted) + ")"


def _bounded(pattern: str) -> str:
    return r"\b(?:" + "|".join(p.strip() for p in pattern.lower().split("|")) + r")\b"


#: RE2 knows ASCII letters at word boundaries only: others are folded to a word character first.
_FOLD = r"regexp_replace(lower({}), '[\x{{80}}-\x{{24F}}\x{{370}}-\x{{1FFF}}\x{{3040}}-\x{{FFDC}}]', '_', 'g')"
_RULES = _values([(k, _bounded(r.pattern), r.tag) for k, r in enumerate(RULES)]) + " AS rules(pos, pattern, tag)"
_TAGS = _values(list(enumerate(TAGS))) + " AS tags(pos, tag)"
_CATEGORIES = _values(list(enumerate(CATEGORIES))) + " AS categories(pos, category)"
_KNOWN_CATEGORIES = _values(list(enumerate(dict.fromkeys(CATEGORIES)))) + " AS categories(pos, category)"
_SCORES = f"""
SELECT doc_id, tag, n, round(least(1.0, n * 0.15 + 0.4)::DOUBLE, 4) AS score
FROM (SELECT doc_id, tag, len(regexp_extract_all({_FOLD.format("text")}, pattern))::BIGINT AS n FROM documents, {_RULES})
WHERE n > 0"""


@query(_SCORES)
def keyword_counts(spark, sf_dir):
    return keywords.keyword_scores(docs(spark, sf_dir), RULES)


_TOP = """
SELECT doc_id, tag, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, tag) AS rank
  FROM ({}) WHERE score >= 0.5) WHERE rank <= {}"""
_FUSED_1 = f"""
SELECT doc_id, tag, pos, round(least(1.0, score), 4) AS score
FROM (SELECT doc_id, tags.tag, pos, coalesce(score, 0) AS score FROM documents CROSS JOIN {_TAGS}
      LEFT JOIN ({_SCORES}) USING (doc_id, tag))"""


def hits(text: str = "text") -> Column:
    return keywords.rule_hits(F.col(text), RULES)


def fused_rules() -> Column:
    """The rule layer's scores of the tags."""
    return fusion.fuse_row(TAGS, [hits()], lambda a, b, c: fusion.tag_score(a, b, c, False))


def exploded(rows: DataFrame, found: Column, *names: str, label: str = "tag", key: str = "doc_id") -> DataFrame:
    """One row for each entry of ``found``, its label as ``label``."""
    parts = rows.select(key, F.explode(found).alias("r"))
    return parts.select(key, F.col("r.label").alias(label), *[f"r.{n}" for n in names])


@query(_TOP.format(_FUSED_1, 8))
def keyword_tags(spark, sf_dir):
    return exploded(docs(spark, sf_dir), fusion.best_row(fused_rules(), 8), "score", "rank")


#: Rules of which some share a tag: the last that matches a text gives the score, and all of them count in the segments.
SHARED = [*RULES, Rule("hes|ther", "#Theory"), Rule("zzz", "#Action"), Rule("that.the|on the", "#Pointers"), Rule("ist", "#German")]
_SHARED = _values([(k, _bounded(r.pattern), r.tag) for k, r in enumerate(SHARED)]) + " AS rules(pos, pattern, tag)"


@query(f"""
WITH s AS (SELECT doc_id, {_FOLD.format("text")} AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS seg FROM s),
h AS (SELECT doc_id, tag, count(*) AS hits FROM p, {_SHARED} WHERE regexp_matches(seg, pattern) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS segments FROM p GROUP BY doc_id),
c AS (SELECT doc_id, tag, pos, len(regexp_extract_all(t, pattern)) AS n FROM s, {_SHARED}),
k AS (SELECT doc_id, tag, least(1.0, arg_max(n, pos) * 0.15 + 0.4)::DOUBLE AS score FROM c WHERE n > 0 GROUP BY ALL)
SELECT doc_id, tag, round(CASE WHEN hits IS NULL THEN score ELSE coalesce(score, 0) * 0.6 + hits / segments * 0.4 END, 4) AS score
FROM k FULL JOIN h USING (doc_id, tag) JOIN n USING (doc_id)""")
def segment_density(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("segments", F.split("text", "\n", -1))
    return keywords.segment_scores(rows, SHARED)


_SYLLABLES = ("th", "er", "on", "an", "re", "in", "ed", "at", "ou", "ti", "es", "ha", "ng", "is", "or", "st", "de", "la", "un", "das")


def many_rules(rules: int = 42, alternatives: int = 24) -> list[Rule]:
    """Rules of a vocabulary's full size: syllables put together by number, some as two words or with a dot."""
    n = len(_SYLLABLES)

    def word(i: int) -> str:
        return _SYLLABLES[i % n] + _SYLLABLES[i * 7 // n % n] + (_SYLLABLES[i // 5 % n] if i % 3 == 0 else "")

    def alternative(i: int) -> str:
        return f"{word(i)} {word(i + 1)}" if i % 11 == 0 else f"{word(i)}.{word(i + 3)}" if i % 29 == 0 else word(i)

    return [Rule("|".join(alternative(r * alternatives + k) for k in range(alternatives)), f"#Tag{r % 40}") for r in range(rules)]


_MANY = _values([(k, _bounded(r.pattern), r.tag) for k, r in enumerate(many_rules())]) + " AS rules(pos, pattern, tag)"


@query(f"""
SELECT doc_id, tag, n, round(least(1.0, n * 0.15 + 0.4)::DOUBLE, 4) AS score FROM (
  SELECT doc_id, tag, arg_max(n, pos)::BIGINT AS n FROM (
    SELECT doc_id, tag, pos, len(regexp_extract_all({_FOLD.format("text")}, pattern)) AS n FROM documents, {_MANY})
  WHERE n > 0 GROUP BY ALL)""")
def keyword_many(spark, sf_dir):
    """42 rules of about 1,000 alternatives, two of them for tags that have another."""
    return keywords.keyword_scores(docs(spark, sf_dir), many_rules())


_STOP = ", ".join("'" + w + "'" for w in dict.fromkeys(tx.STOP_WORDS))
_TOKENS = (
    r"list_filter(list_distinct(string_split_regex(lower(text), '[\s.,;:!?\-\"''()]+')), "
    f"lambda w: length(w) > 3 AND NOT list_contains([{_STOP}], w))"
)


@query(f"""
SELECT doc_id, len(w)::BIGINT AS n, list_aggregate(w, 'min') AS first, list_aggregate(w, 'max') AS last
FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)""")
def tokenise(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    n = F.size("w").cast("long")
    return rows.select("doc_id", n.alias("n"), F.array_min("w").alias("first"), F.array_max("w").alias("last"))


POOL = 12


@query(f"""
WITH b AS (
  SELECT d.doc_id, tags.tag, pos, CASE WHEN k.tag IS NOT NULL THEN 0
    WHEN len(list_intersect(w, regexp_extract_all(lower(tags.tag), '[a-z]+'))) > 0 THEN 1 ELSE 2 END AS bucket
  FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) d CROSS JOIN {_TAGS}
  LEFT JOIN ({_SCORES}) k ON k.doc_id = d.doc_id AND k.tag = tags.tag
), c AS (
  SELECT *, count(*) FILTER (bucket < 2) OVER (PARTITION BY doc_id) AS front,
    count(*) FILTER (bucket = 2) OVER (PARTITION BY doc_id) AS rest,
    row_number() OVER (PARTITION BY doc_id, bucket ORDER BY pos) AS r
  FROM b
), e AS (SELECT *, greatest(0, {POOL} - front) AS slots FROM c),
f AS (SELECT *, greatest(1, rest // greatest(slots, 1)) AS step FROM e)
SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY bucket, pos) AS place
FROM f WHERE bucket < 2 OR (slots > 0 AND (r - 1) % step = 0 AND (r - 1) // step < slots)""")
def tag_pool(spark, sf_dir):
    pool = keywords.tag_pool(F.col("text"), hits(), TAGS, POOL)
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(pool).alias("place", "tag"))
    return rows.select("doc_id", "tag", (F.col("place") + 1).cast("long").alias("place"))


@query(f"""
SELECT d.doc_id, category, row_number() OVER (PARTITION BY d.doc_id ORDER BY k.tag IS NULL, pos) AS place
FROM documents d CROSS JOIN {_CATEGORIES} LEFT JOIN ({_SCORES}) k ON k.doc_id = d.doc_id AND k.tag = '#' || category""")
def ranked_categories(spark, sf_dir):
    found = keywords.ranked_categories(hits(), CATEGORIES)
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(found).alias("place", "category"))
    return rows.select("doc_id", "category", (F.col("place") + 1).cast("long").alias("place"))


@query(f"SELECT doc_id, tag, score FROM ({_FUSED_1}) WHERE score > 0")
def merge_no_l3(spark, sf_dir):
    return exploded(docs(spark, sf_dir), F.filter(fused_rules(), lambda x: x["score"] > 0), "score")


_ALL_TAGS = _values([*enumerate(TAGS), (len(TAGS), "#Extra")]) + " AS tags(pos, tag)"
_FUSED_3 = f"""
SELECT doc_id, tag, pos, round(least(1.0, s1 * 0.4 + s2 * 0.2 + s3 * 0.6
  + CASE WHEN s1 > 0 AND s3 > 0 THEN 0.15 WHEN s2 > 0 AND s3 > 0 THEN 0.10 ELSE 0.0 END)::DOUBLE, 4) AS score
FROM (
  SELECT d.doc_id, tags.tag, pos, coalesce(score, 0)::DOUBLE AS s1,
    CASE WHEN (d.doc_id + pos) % 5 = 0 THEN {_share("d.doc_id + pos", 2)} ELSE 0 END::DOUBLE AS s2,
    CASE WHEN (d.doc_id + pos) % 3 = 0 THEN {_share("d.doc_id + pos", 3)} ELSE 0 END::DOUBLE AS s3
  FROM documents d CROSS JOIN {_ALL_TAGS} LEFT JOIN ({_SCORES}) k ON k.doc_id = d.doc_id AND k.tag = tags.tag
  WHERE tags.tag <> '#Extra' OR (d.doc_id % 7 = 0 AND (d.doc_id + pos) % 3 = 0))"""


def fused_three() -> Column:
    """Three layers over the known tags and, for some texts, a new tag of the third layer."""
    key = F.col("doc_id")

    def layer(k: int, m: int) -> Column:
        made = [
            F.when((key + pos) % m == 0, F.struct(F.lit(t).alias("label"), share(key + pos, k).alias("score")))
            for pos, t in enumerate([*TAGS, "#Extra"])
        ]
        found = F.array_compact(F.array(*made))
        return F.filter(found, lambda x: (x["label"] != "#Extra") | (key % 7 == 0)) if k == 3 else found

    return fusion.fuse_row(TAGS, [hits(), layer(2, 5), layer(3, 3)], lambda a, b, c: fusion.tag_score(a, b, c, True))


@query(f"SELECT doc_id, tag, score FROM ({_FUSED_3}) WHERE score > 0")
def merge_l3(spark, sf_dir):
    return exploded(docs(spark, sf_dir), F.filter(fused_three(), lambda x: x["score"] > 0), "score")


_FUSED_CATEGORIES = f"""
SELECT d.doc_id, category, pos, round(least(1.0, coalesce(score, 0) * 0.4 + {_share("d.doc_id + pos", 4)} * 0.6)::DOUBLE, 4)
  AS score
FROM documents d CROSS JOIN {_KNOWN_CATEGORIES} LEFT JOIN ({_SCORES}) k ON k.doc_id = d.doc_id AND k.tag = '#' || category"""


def fused_categories() -> Column:
    """The rule layer and a stand-in for a model's scores, over the distinct categories."""
    known = list(dict.fromkeys(CATEGORIES))
    model = F.array(
        *[F.struct(F.lit(c).alias("label"), share(F.col("doc_id") + k, 4).alias("score")) for k, c in enumerate(known)]
    )
    return fusion.fuse_row(known, [hits(), model], lambda a, b, c: fusion.category_score(a, b, c, False), "#")


@query(f"""
SELECT doc_id, category, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, category) AS rank FROM ({_FUSED_CATEGORIES}))
WHERE rank = 1 OR (score >= 0.35 AND rank <= 3)""")
def top_categories_fallback(spark, sf_dir):
    found = fusion.best_categories_row(fused_categories())
    return exploded(docs(spark, sf_dir), found, "score", "rank", label="category")


_BLOCKED = "(contains(lower(tag), 'german') OR contains(lower(tag), 'the'))"


@query(f"SELECT * FROM ({_TOP.format(_FUSED_3, 4)}) WHERE NOT {_BLOCKED}")
def blocked_after_limit(spark, sf_dir):
    found = fusion.unblocked(fusion.best_row(fused_three(), 4), BLOCKED)
    return exploded(docs(spark, sf_dir), found, "score", "rank")


@query(_TOP.format(f"SELECT * FROM ({_FUSED_3}) WHERE NOT {_BLOCKED}", 4))
def blocked_before_limit(spark, sf_dir):
    found = fusion.best_row(fusion.unblocked(fused_three(), BLOCKED), 4)
    return exploded(docs(spark, sf_dir), found, "score", "rank")


@query(f"SELECT tag, count(*) AS n FROM ({_TOP.format(_FUSED_3, 8)}) WHERE tag NOT IN (SELECT tag FROM {_TAGS}) GROUP BY tag")
def new_tags(spark, sf_dir):
    known = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    best = exploded(docs(spark, sf_dir), fusion.best_row(fused_three(), 8))
    found = fusion.new_labels(best, known, "tag")
    return found.groupBy("tag").agg(F.count("*").alias("n"))


_LISTED = ", ".join(f"'{c}'" for c in dict.fromkeys(CATEGORIES))


@query(f"""
SELECT DISTINCT category FROM (SELECT array_to_string(list_transform(string_split(lower(p_name), ' '),
  lambda w: upper(w[1:1]) || w[2:]), ' ') AS category FROM part) WHERE category NOT IN ({_LISTED})""")
def suggested_categories(spark, sf_dir):
    raw = F.concat(F.lit("##"), F.col("p_name"), F.lit(" "))
    found = table(spark, sf_dir, "part").select(tx.category_title(raw).alias("category")).distinct()
    known = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return fusion.new_labels(found, known, "category").select("category")


@query("""
SELECT s_suppkey, array_to_string(x, '|') AS words, len(x)::BIGINT AS n FROM (SELECT s_suppkey,
  list_filter(list_transform(string_split(upper(s_name) || ' , ,' || s_name || ', ' || s_suppkey, ','),
    lambda v: lower(trim(v))), lambda v: v <> '') AS x FROM supplier)""")
def settings_csv(spark, sf_dir):
    raw = F.concat(F.upper("s_name"), F.lit(" , ,"), F.col("s_name"), F.lit(", "), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", tx.csv_list(raw).alias("x"))
    return rows.select("s_suppkey", F.array_join("x", "|").alias("words"), F.size("x").cast("long").alias("n"))


def lexicon(spark, sf_dir) -> DataFrame:
    """(pos, phrase): the benchmark's passages stand for a harm lexicon."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.lower("text").alias("phrase"))


_HITS = """
SELECT d.doc_id, b.item_id, lower(b.text) AS phrase FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))"""


@query(f"SELECT doc_id, count(*) AS n, arg_min(phrase, item_id) AS first FROM ({_HITS}) GROUP BY doc_id")
def harm_hits(spark, sf_dir):
    found = lexicon_hits(F.col("text"), vocabulary.phrases(lexicon(spark, sf_dir)))
    rows = docs(spark, sf_dir).select("doc_id", found.alias("hits")).filter(F.size("hits") > 0)
    return rows.select("doc_id", F.size("hits").cast("long").alias("n"), F.col("hits")[0].alias("first"))


@query(f"SELECT doc_id, item_id AS pos, phrase FROM ({_HITS})")
def lexicon_table(spark, sf_dir):
    return hits_table(docs(spark, sf_dir), lexicon(spark, sf_dir))


def _product(key: Column, k: int, m: int) -> Column:
    """A score of four decimals, seldom near 1."""
    part = lambda j: (key * 7919 + j * 104729) % 1000
    return F.floor(part(k) * part(m) / F.lit(100)) / F.lit(10000.0)


def _sql_product(k: int, m: int) -> str:
    part = lambda j: f"((doc_id * 7919 + {j} * 104729) % 1000)"
    return f"({part(k)} * {part(m)} // 100) / 10000.0"


def _labelled(labels, score) -> Column:
    """array<struct<label, score>>."""
    return F.array(*[F.struct(F.lit(x).alias("label"), score(k).alias("score")) for k, x in enumerate(labels)])


def _toxic(key: Column) -> Column:
    return _labelled(moderation.TOXIC_LABELS, lambda k: _product(key, k, 7))


_TOXIC = ", ".join(f"{_sql_product(k, 7)} AS x{k}" for k in range(len(moderation.TOXIC_LABELS)))
_INTENTS = ", ".join(f"{_sql_product(20 + k, 24)} AS i{k}" for k in range(len(moderation.INTENT_LABELS)))
_SCORED = f"""
SELECT *, greatest(x0, x1, x2, x3, x4, x5) AS top, x1 >= 0.5 OR x3 >= 0.5 OR x5 >= 0.5 AS flag,
  greatest(i1, i2, i3) AS harmful, i0 AS safe FROM (SELECT doc_id, text, {_TOXIC}, {_INTENTS} FROM documents)"""
_INTENT = "CASE WHEN harmful >= 0.55 THEN 'harmful' WHEN harmful >= 0.35 AND safe < 0.5 THEN 'questionable' ELSE 'safe' END"
_LATTICE = """CASE WHEN intent = 'harmful' AND flag THEN 'critical' WHEN intent = 'harmful' THEN 'high'
  WHEN flag AND intent = 'questionable' THEN 'high' WHEN flag AND intent = 'safe' THEN 'medium'
  WHEN intent = 'questionable' THEN 'medium' WHEN top > 0.6 THEN 'low' ELSE 'none' END"""
_BY_SCORE = """CASE WHEN top >= 0.95 OR (flag AND top >= 0.85) THEN 'critical' WHEN top >= 0.80 THEN 'high'
  WHEN top >= 0.60 THEN 'medium' ELSE 'low' END"""
_NAMES = (
    "array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN x{k} >= 0.5 THEN '{v}' END" for k, v in enumerate(moderation.TOXIC_LABELS.values()))
    + "], lambda v: v IS NOT NULL), ', ')"
)


def scored(rows: DataFrame) -> DataFrame:
    key = F.col("doc_id")
    intents = _labelled(moderation.INTENT_LABELS, lambda k: _product(key, 20 + k, 24))
    return rows.withColumn("scores", _toxic(key)).withColumn("intent_scores", intents)


def with_model(rows: DataFrame) -> DataFrame:
    """A language model's raw verdict for every third text, some of it out of range."""
    key = F.col("doc_id")
    pick = lambda values, m: F.get(F.array(*[F.lit(v) for v in values]), (key % m).cast("int"))
    verdict = F.struct(
        (key % 2 == 0).alias("flagged"), pick(("none", "low", "odd", "high", "critical"), 5).alias("severity"),
        pick(("safe", "questionable", "harmful", "?"), 4).alias("intent"),
        F.concat(F.lit("Verdict "), key.cast("string")).alias("reason"), F.array(F.lit("a"), F.lit("b")).alias("categories"),
    )
    return rows.withColumn("model", F.when(key % 3 == 0, verdict))


def verdicts(spark, sf_dir, model: bool = False, carry: list[str] = ()) -> DataFrame:
    rows = scored(docs(spark, sf_dir))
    return moderation.moderate(with_model(rows) if model else rows, vocabulary.phrases(lexicon(spark, sf_dir)), carry=carry)


_I1, _I2, _I3 = moderation.INTENT_LABELS[1:]


def _two_places(x: str) -> str:
    cents = f"floor({x} * 100 + 0.5)::BIGINT"
    return f"({cents} // 100)::VARCHAR || '.' || lpad(({cents} % 100)::VARCHAR, 2, '0')"


_NLI_REASON = f"""CASE intent WHEN 'harmful' THEN 'NLI classified as: ' || CASE WHEN i1 >= i2 AND i1 >= i3 THEN '{_I1}'
    WHEN i2 >= i3 THEN '{_I2}' ELSE '{_I3}' END || ' (' || {_two_places("harmful")} || ')'
  WHEN 'questionable' THEN 'Potentially harmful content (' || {_two_places("harmful")} || ')' ELSE '' END"""


def _verdict_sql(model: str) -> str:
    """The policy of one text's moderation, band by band. ``model`` says which texts have a language model's verdict."""
    return f"""
WITH h AS (SELECT doc_id, list(phrase ORDER BY item_id) AS words FROM ({_HITS}) GROUP BY doc_id),
s AS (SELECT s.*, words, {_INTENT} AS intent, {model} AS own,
    ['none', 'low', 'none', 'high', 'critical'][doc_id % 5 + 1] AS m_severity,
    ['safe', 'questionable', 'harmful', 'safe'][doc_id % 4 + 1] AS m_intent
  FROM ({_SCORED}) s LEFT JOIN h USING (doc_id)),
m AS (SELECT *, m_intent <> 'safe' AND (doc_id % 2 = 0 OR (m_intent = 'harmful' AND m_severity IN ('high', 'critical'))) AS m_flagged,
    CASE WHEN m_intent = 'safe' THEN 'none' ELSE m_severity END AS m_level, {_LATTICE} AS lattice, {_BY_SCORE} AS by_score,
    {_NLI_REASON} AS nli_reason, {_NAMES} AS named FROM s)
SELECT doc_id, FALSE AS flagged, 'none' AS severity, 'safe' AS intent, 'blank' AS band, '' AS reason, '' AS categories,
  FALSE AS learns FROM m WHERE NOT regexp_matches(text, '[^\\s]')
UNION ALL SELECT doc_id, TRUE, 'critical', 'harmful', 'lexicon',
  'Contains flagged harmful language: ' || array_to_string(words[1:5], ', '), 'Threats / Violence', FALSE
  FROM m WHERE regexp_matches(text, '[^\\s]') AND words IS NOT NULL
UNION ALL SELECT doc_id, FALSE, 'none', 'safe', 'low', '', '', FALSE
  FROM m WHERE regexp_matches(text, '[^\\s]') AND words IS NULL AND top < 0.3
UNION ALL SELECT doc_id, m_flagged, m_level, m_intent, 'middle', 'Verdict ' || doc_id, 'a, b', m_flagged AND m_intent = 'harmful'
  FROM m WHERE regexp_matches(text, '[^\\s]') AND words IS NULL AND top >= 0.3 AND top < 0.8 AND own
UNION ALL SELECT doc_id, lattice IN ('high', 'critical'), lattice, intent, 'middle',
  CASE WHEN nli_reason <> '' THEN nli_reason WHEN named <> '' THEN 'Detected: ' || named
    WHEN lattice = 'none' THEN 'Content appears safe' ELSE 'Content flagged by automated analysis' END, named,
  lattice IN ('high', 'critical') AND intent = 'harmful' AND harmful >= 0.7
  FROM m WHERE regexp_matches(text, '[^\\s]') AND words IS NULL AND top >= 0.3 AND top < 0.8 AND NOT own
UNION ALL SELECT doc_id, TRUE, by_score, m_intent, 'high', 'Verdict ' || doc_id, 'a, b', m_intent <> 'safe'
  FROM m WHERE regexp_matches(text, '[^\\s]') AND words IS NULL AND top >= 0.8 AND own
UNION ALL SELECT doc_id, TRUE, by_score, 'harmful', 'high', 'High toxicity detected (score ' || {_two_places("top")} || ')',
  named, TRUE FROM m WHERE regexp_matches(text, '[^\\s]') AND words IS NULL AND top >= 0.8 AND NOT own"""


_VERDICTS = _verdict_sql("FALSE")
_SHOWN = ["doc_id", "flagged", "severity", "intent", "band", "reason", "learns"]


@query(_VERDICTS)
def moderation_bands(spark, sf_dir):
    return verdicts(spark, sf_dir).select(*_SHOWN, F.array_join("categories", ", ").alias("categories"))


@query(_verdict_sql("doc_id % 3 = 0"))
def moderation_llm(spark, sf_dir):
    return verdicts(spark, sf_dir, model=True).select(*_SHOWN, F.array_join("categories", ", ").alias("categories"))


@query(f"SELECT doc_id, intent, {_NLI_REASON} AS reason FROM (SELECT *, {_INTENT} AS intent FROM ({_SCORED}))")
def intent_reason(spark, sf_dir):
    found = moderation.intent_verdict(F.col("intent_scores"))
    rows = scored(docs(spark, sf_dir)).select("doc_id", found.alias("v"))
    return rows.select("doc_id", "v.intent", "v.reason")


@query(f"SELECT doc_id, intent, {_LATTICE} AS severity FROM (SELECT *, {_INTENT} AS intent FROM ({_SCORED}))")
def severity_lattice(spark, sf_dir):
    found = moderation.intent_verdict(F.col("intent_scores"))
    rows = scored(docs(spark, sf_dir)).withColumn("intent", found["intent"])
    flag, top = moderation.score_flag(F.col("scores")), moderation.max_score(F.col("scores"))
    return rows.select("doc_id", "intent", moderation.severity_lattice(F.col("intent"), flag, top).alias("severity"))


@query(f"SELECT doc_id, top, flag, {_BY_SCORE} AS severity FROM ({_SCORED})")
def severity_by_score(spark, sf_dir):
    rows = scored(docs(spark, sf_dir))
    rows = rows.select(
        "doc_id", moderation.max_score(F.col("scores")).alias("top"), moderation.score_flag(F.col("scores")).alias("flag")
    )
    return rows.withColumn("severity", moderation.severity_by_score(F.col("top"), F.col("flag")))


@query(f"SELECT doc_id, {_NAMES} AS categories FROM ({_SCORED})")
def flagged_categories(spark, sf_dir):
    found = moderation.flagged_categories(F.col("scores"))
    return scored(docs(spark, sf_dir)).select("doc_id", F.array_join(found, ", ").alias("categories"))


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Model says so' WHEN {_NAMES} <> '' AND doc_id % 3 = 0
  THEN 'Detected: ' || {_NAMES} || '. Monitored words found: ab, c' WHEN {_NAMES} <> '' THEN 'Detected: ' || {_NAMES}
  WHEN doc_id % 3 = 0 THEN 'Monitored words found: ab, c' WHEN doc_id % 2 = 0 THEN 'Content appears safe'
  ELSE 'Content flagged by automated analysis' END AS reason FROM ({_SCORED})""")
def moderation_reason(spark, sf_dir):
    key = F.col("doc_id")
    own = F.when(key % 4 == 0, "Model says so").otherwise("")
    hits = F.when(key % 3 == 0, F.array(F.lit("ab"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    severity = F.when(key % 2 == 0, "none").otherwise("low")
    reason = moderation.reason_text(own, moderation.flagged_categories(F.col("scores")), hits, severity)
    return scored(docs(spark, sf_dir)).select("doc_id", reason.alias("reason"))


@query("""
SELECT conv_id, turn, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r DESC, turn) AS k FROM (
    SELECT conv_id, turn, (conv_id * 31 + turn * 17) % 5 AS r,
      ['none', 'low', 'medium', 'high', 'critical'][(conv_id * 31 + turn * 17) % 5 + 1] AS severity FROM conversations))
WHERE k = 1""")
def worst_of_tracks(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in moderation.SEVERITIES])
    k = ((F.col("conv_id") * 31 + F.col("turn") * 17) % 5).cast("int")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(names, k).alias("severity"))
    return moderation.worst_of_tracks(rows, "conv_id", "turn")


@query(f"""
WITH s AS (SELECT unnest(string_split_regex(lower(text), '[.!?\\n]+')) AS x
  FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_VERDICTS}) WHERE learns)),
p AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g'),
    '^\\s+|\\s+$', '', 'g') AS phrase FROM s)
SELECT phrase FROM p WHERE len(list_filter(string_split_regex(phrase, '\\s+'), lambda w: w <> '')) BETWEEN 2 AND 10
  AND phrase NOT IN (SELECT lower(text) FROM benchmark)""")
def learn_phrases_epoch(spark, sf_dir):
    """Only sentences are shuffled, and no text is. Of several texts of one doc_id none teaches if one of them hits the lexicon."""
    rows = verdicts(spark, sf_dir, carry=["text"]).filter("doc_id is not null").filter("learns or band = 'lexicon'")
    own = F.when(F.col("learns"), moderation.taught(F.col("text")))
    taught = rows.groupBy("doc_id").agg(F.bool_and("learns").alias("learns"), F.flatten(F.collect_list(own)).alias("taught"))
    return moderation.unknown_phrases(taught.filter("learns"), lexicon(spark, sf_dir))


def _turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "conv_id", "turn", "text")


_TURNS = "(SELECT conv_id * 100 + turn AS doc_id, conv_id, turn, text FROM conversations)"
_TURN_SCORES = _SCORES.replace("FROM documents,", f"FROM {_TURNS},")


@query(f"""
WITH t AS ({_TOP.format(f"SELECT doc_id, k.tag, score, pos FROM ({_TURN_SCORES}) k JOIN {_TAGS} ON tags.tag = k.tag", 8)}),
f AS (SELECT doc_id // 100 AS conv_id, tag, doc_id % 100 AS turn, rank, score FROM t),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, tag ORDER BY turn, rank) AS k FROM f)
SELECT conv_id, tag, score, row_number() OVER (PARTITION BY conv_id ORDER BY turn, rank, tag) AS place FROM m WHERE k = 1""")
def multi_track_merge(spark, sf_dir):
    top = exploded(_turns(spark, sf_dir), fusion.best_row(fused_rules(), 8), "score", "rank")
    rows = top.withColumn("conv_id", F.floor(F.col("doc_id") / 100)).withColumn("turn", F.col("doc_id") % 100)
    return fusion.merge_tracks(rows, "conv_id", "turn")


@query("""
SELECT conv_id, sentiment FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS k FROM (
    SELECT conv_id, ['positive', 'negative', 'neutral'][(conv_id * 13 + turn * 7) % 3 + 1] AS sentiment, count(*) AS n,
      min(turn) AS first FROM conversations GROUP BY ALL)) WHERE k = 1""")
def sentiment_mode(spark, sf_dir):
    raw = F.array(F.lit("LABEL_POSitive"), F.lit("Negative!"), F.lit("mixed"))
    label = F.get(raw, ((F.col("conv_id") * 13 + F.col("turn") * 7) % 3).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.sentiment_label(label).alias("sentiment"))
    return fusion.mode_first_seen(rows, "conv_id", "sentiment", "turn")


@query("""
SELECT o_orderkey, CASE WHEN sev IN ('high', 'low') THEN sev ELSE 'none' END AS severity FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'odd' WHEN 2 THEN 'low' END AS sev FROM orders)""")
def llm_json_extract(spark, sf_dir):
    key = F.col("o_orderkey") % 4
    word = F.when(key == 0, "high").when(key == 1, "odd").when(key == 2, "low").otherwise("x")
    raw = F.concat(F.lit('```json\nHere: {"severity": "'), word, F.lit('"} and {more}\n```'))
    raw = F.when(key == 3, F.lit("no object")).otherwise(raw)
    found = F.get_json_object(tx.first_json(tx.strip_fence(raw)), "$.severity")
    severity = F.when(found.isin(*moderation.SEVERITIES), found).otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", severity.alias("severity"))


@query(f"""
WITH v AS ({_VERDICTS}), t AS ({_TOP.format(_FUSED_1, 5)}),
c AS (SELECT doc_id, arg_min(category, rank) AS category FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, category) AS rank FROM ({_FUSED_CATEGORIES}))
  GROUP BY doc_id),
g AS (SELECT doc_id, string_agg(tag, ',' ORDER BY rank) AS tags FROM t GROUP BY doc_id)
SELECT v.doc_id, flagged, severity, CASE WHEN NOT flagged THEN coalesce(tags, '') END AS tags,
  CASE WHEN NOT flagged THEN category END AS category
FROM v LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id)""")
def pipeline_end_to_end(spark, sf_dir):
    from brindle.plans.pipeline import enrich

    words = vocabulary.phrases(lexicon(spark, sf_dir))
    judged = moderation.moderate(scored(docs(spark, sf_dir)), words, carry=["text"])
    return enrich(judged, fused_rules(), fused_categories())


_TURN_TAGS = f"""
SELECT doc_id // 100 AS conv_id, doc_id % 100 AS turn, tag, score, rank
FROM ({_TOP.format(f"SELECT doc_id, k.tag, score, pos FROM ({_TURN_SCORES}) k JOIN {_TAGS} ON tags.tag = k.tag", 4)})"""


@query(f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, tag ORDER BY turn, rank) AS k FROM ({_TURN_TAGS}) WHERE NOT {_BLOCKED}),
p AS (SELECT conv_id, tag, score, row_number() OVER (PARTITION BY conv_id ORDER BY turn, rank, tag) AS place FROM m WHERE k = 1)
SELECT * FROM p WHERE place <= 4""")
def categorize_recordings(spark, sf_dir):
    from brindle.plans.categorize import tag_recordings

    vocabulary_ = vocabulary.Vocabulary(CATEGORIES, TAGS, RULES)
    return tag_recordings(_turns(spark, sf_dir), vocabulary_, "conv_id", "turn", BLOCKED, 4)


@query(f"SELECT * FROM ({_TOP.format(_FUSED_1, 3)}) WHERE NOT {_BLOCKED}")
def categorize_texts(spark, sf_dir):
    from brindle.plans.categorize import tag_texts

    return tag_texts(docs(spark, sf_dir), vocabulary.Vocabulary(CATEGORIES, TAGS, RULES), BLOCKED, 3)


_BLANK = "NOT regexp_matches(coalesce(text, ''), '[^\\s]')"
_THIRD = f"""
SELECT d.doc_id, tag AS label, {_share("d.doc_id + pos", 3)} AS score FROM documents d CROSS JOIN {_ALL_TAGS}
WHERE d.doc_id % 2 = 0 AND (d.doc_id + pos) % 3 = 0 AND (tag <> '#Extra' OR d.doc_id % 7 = 0)
UNION ALL
SELECT d.doc_id, category, {_share("d.doc_id + pos", 5)} FROM documents d CROSS JOIN {_KNOWN_CATEGORIES}
WHERE d.doc_id % 2 = 0 AND (d.doc_id + pos) % 4 = 0"""


def _sentiment_sql(a: str, b: str) -> str:
    return f"['positive', 'negative', 'neutral'][({a} * 13 + {b} * 7) % 3 + 1]"


def _sentiment(a: Column, b: Column) -> Column:
    """A stand-in for a sentiment model's raw label."""
    raw = F.array(F.lit("LABEL_POSitive"), F.lit("Negative!"), F.lit("mixed"))
    return F.get(raw, ((a * 13 + b * 7) % 3).cast("int"))


def _said(when: Column, tags: list[str], categories: list[str], sentiment: str) -> Column:
    """A stand-in for a language model's verdict on some rows."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    verdict = F.struct(strings(tags).alias("tags"), strings(categories).alias("categories"), F.lit(sentiment).alias("sentiment"))
    return F.when(when, verdict)


def _scores_of(found: list[tuple[str, Column]], wanted) -> Column:
    made = [F.when(wanted(k), F.struct(F.lit(x).alias("label"), s.alias("score"))) for k, (x, s) in enumerate(found)]
    return F.array_compact(F.array(*made))


def _shown(result: Column) -> list[Column]:
    """A result's fields as text, confidences in units of 0.0001."""
    unit = lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10000).cast("long").cast("string"))
    pairs = F.array_sort(F.transform(F.map_entries(result["confidences"]), unit))
    joined = [F.array_join(result[c], ",").alias(c) for c in ("tags", "categories", "new_tags", "new_categories")]
    plain = [result[c].alias(c) for c in ("sentiment", "settings_applied", "llm_used")]
    return [*joined, F.array_join(pairs, ",").alias("confidences"), *plain]


@query(f"""
WITH third AS ({_THIRD}), asked AS (SELECT DISTINCT doc_id FROM third), rules AS ({_SCORES}),
labels AS (
  SELECT doc_id, tag AS label, pos, tag AS rule, false AS topic FROM documents CROSS JOIN {_TAGS}
  UNION ALL SELECT doc_id, label, 100, label, false FROM third WHERE label = '#Extra'
  UNION ALL SELECT doc_id, category, pos, '#' || category, true FROM documents CROSS JOIN {_KNOWN_CATEGORIES}),
parts AS (
  SELECT l.doc_id, l.label, l.pos, topic, a.doc_id IS NOT NULL AS asked, coalesce(r.score, 0)::DOUBLE AS s1,
    CASE WHEN topic THEN {_share("l.doc_id + l.pos", 4)} ELSE 0 END::DOUBLE AS s2, coalesce(t.score, 0)::DOUBLE AS s3
  FROM labels l LEFT JOIN rules r ON r.doc_id = l.doc_id AND r.tag = l.rule
  LEFT JOIN third t ON t.doc_id = l.doc_id AND t.label = l.label LEFT JOIN asked a ON a.doc_id = l.doc_id),
fused AS (
  SELECT doc_id, label, pos, topic, round(least(1.0, CASE
    WHEN topic AND asked THEN s1 * 0.2 + s2 * 0.3 + s3 * 0.7 + CASE WHEN (s1 > 0 OR s2 > 0) AND s3 > 0 THEN 0.10 ELSE 0.0 END
    WHEN topic THEN s1 * 0.4 + s2 * 0.6
    WHEN asked THEN s1 * 0.4 + s2 * 0.2 + s3 * 0.6 + CASE WHEN s1 > 0 AND s3 > 0 THEN 0.15 ELSE 0.0 END
    ELSE s1 END)::DOUBLE, 4) AS score FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY score DESC, pos) AS rank FROM fused),
m AS (
  SELECT doc_id,
    string_agg(label, ',' ORDER BY rank) FILTER (NOT topic AND score >= 0.5 AND rank <= 4 AND NOT {_BLOCKED.replace("tag", "label")}) AS tags,
    string_agg(label, ',' ORDER BY rank) FILTER (topic AND (rank = 1 OR score >= 0.35 AND rank <= 3)) AS categories,
    string_agg(label, ',') FILTER (label = '#Extra' AND score >= 0.5 AND rank <= 4) AS new_tags,
    string_agg(label || '=' || round(score * 10000)::BIGINT, ',' ORDER BY label || '=' || round(score * 10000)::BIGINT) AS confidences
  FROM ranked GROUP BY doc_id),
d AS (SELECT doc_id, {_BLANK} AS bare, doc_id % 5 = 0 AS said FROM documents)
SELECT doc_id, CASE WHEN bare THEN '' WHEN said THEN '#Made' ELSE coalesce(tags, '') END AS tags,
  CASE WHEN bare THEN '' WHEN said THEN 'Poetry,Action' ELSE categories END AS categories,
  CASE WHEN bare THEN '' WHEN said THEN '#Made' ELSE coalesce(new_tags, '') END AS new_tags,
  CASE WHEN bare OR said OR doc_id % 6 <> 0 THEN '' ELSE 'New Topic' END AS new_categories,
  CASE WHEN bare OR said THEN '' ELSE confidences END AS confidences,
  CASE WHEN bare THEN 'neutral' WHEN said THEN 'positive' ELSE {_sentiment_sql("doc_id", "0")} END AS sentiment,
  NOT bare AS settings_applied, said AND NOT bare AS llm_used
FROM d JOIN m USING (doc_id)""")
def categorize_results(spark, sf_dir):
    from brindle.plans.results import text_result

    key, known = F.col("doc_id"), list(dict.fromkeys(CATEGORIES))
    second = _scores_of([(c, share(key + k, 4)) for k, c in enumerate(known)], lambda k: F.lit(True))
    tags = _scores_of([(t, share(key + k, 3)) for k, t in enumerate([*TAGS, "#Extra"])], lambda k: (key + k) % 3 == 0)
    tags = F.filter(tags, lambda x: (x["label"] != "#Extra") | (key % 7 == 0))
    topics = _scores_of([(c, share(key + k, 5)) for k, c in enumerate(known)], lambda k: (key + k) % 4 == 0)
    third = F.when(key % 2 == 0, F.concat(tags, topics))
    suggested = F.array(F.when(key % 6 == 0, "#new topic ").otherwise("##theory"), F.lit("German"))
    model = _said(key % 5 == 0, ["#Theory", "#Made", "#German"], ["Poetry", "Action"], "positive")
    words = vocabulary.Vocabulary(CATEGORIES, TAGS, RULES)
    result = text_result(
        F.col("text"), words, hits(), second, third, suggested, _sentiment(key, F.lit(0)), model, BLOCKED, k=4
    )
    return docs(spark, sf_dir).select("doc_id", result.alias("r")).select("doc_id", *_shown(F.col("r")))


_TRACKS = _TOP.format(f"SELECT doc_id, k.tag, score, pos FROM ({_TURN_SCORES}) k JOIN {_TAGS} ON tags.tag = k.tag", 4)
_TRACK_TOPICS = _FUSED_CATEGORIES.replace("FROM documents d", f"FROM {_TURNS} d").replace(_SCORES, _TURN_SCORES)
_TRACK_SAID = "(doc_id // 100 + doc_id % 100) % 4 = 0"


@query(f"""
WITH live AS (SELECT doc_id, conv_id, turn, {_TRACK_SAID} AS said FROM {_TURNS} WHERE NOT {_BLANK}),
named AS (
  SELECT l.*, 'tag' AS kind, tag AS label, rank, score FROM live l JOIN ({_TRACKS}) USING (doc_id) WHERE NOT said
  UNION ALL SELECT l.*, 'tag', v.label, v.rank, 0.85::DOUBLE FROM live l, (VALUES ('#Theory', 1), ('#Talk', 2)) v(label, rank) WHERE said
  UNION ALL SELECT l.*, 'category', category, rank, 0 FROM live l JOIN (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, category) AS rank FROM ({_TRACK_TOPICS})) USING (doc_id)
    WHERE NOT said AND (rank = 1 OR score >= 0.35 AND rank <= 3)
  UNION ALL SELECT l.*, 'category', v.label, v.rank, 0 FROM live l, (VALUES ('Poetry', 1), ('Opera', 2)) v(label, rank) WHERE said),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind, label ORDER BY turn, rank) AS k FROM named) WHERE k = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, kind, {_BLOCKED.replace("tag", "label")} ORDER BY turn, rank) AS place,
    label || '=' || round(score * 10000)::BIGINT AS pair FROM firsts),
felt AS (
  SELECT conv_id, CASE WHEN said THEN 'negative' ELSE {_sentiment_sql("conv_id", "turn")} END AS sentiment, count(*) AS n,
    min(turn) AS first FROM live GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS k FROM felt) WHERE k = 1),
g AS (
  SELECT conv_id, string_agg(label, ',' ORDER BY place) FILTER (kind = 'tag' AND place <= 4 AND NOT {_BLOCKED.replace("tag", "label")}) AS tags,
    string_agg(label, ',' ORDER BY turn, rank) FILTER (kind = 'category') AS categories,
    string_agg(pair, ',' ORDER BY pair) FILTER (kind = 'tag') AS confidences,
    string_agg(label, ',') FILTER (label = '#Talk') AS new_tags FROM placed GROUP BY conv_id),
u AS (SELECT conv_id, count(*) AS n_tracks, bool_or(said) AS llm_used FROM live GROUP BY conv_id)
SELECT conv_id, coalesce(tags, '') AS tags, coalesce(categories, '') AS categories, coalesce(new_tags, '') AS new_tags,
  '' AS new_categories, coalesce(confidences, '') AS confidences, sentiment, true AS settings_applied, llm_used, n_tracks
FROM u JOIN best USING (conv_id) LEFT JOIN g USING (conv_id) WHERE n_tracks > 1""")
def categorize_tracks(spark, sf_dir):
    """Recordings of several tracks; one track alone is ``categorize_results``' case."""
    from brindle.plans.results import recording_results, text_result

    key, known = F.col("doc_id"), list(dict.fromkeys(CATEGORIES))
    second = _scores_of([(c, share(key + k, 4)) for k, c in enumerate(known)], lambda k: F.lit(True))
    model = _said((F.col("conv_id") + F.col("turn")) % 4 == 0, ["#Theory", "#Talk"], ["Poetry", "Opera"], "negative")
    words = vocabulary.Vocabulary(CATEGORIES, TAGS, RULES)
    felt = _sentiment(F.col("conv_id"), F.col("turn"))
    result = text_result(F.col("text"), words, hits(), second, sentiment=felt, model=model, k=4)
    rows = _turns(spark, sf_dir).withColumn("result", result)
    out = recording_results(rows, "conv_id", "turn", blocked=BLOCKED, k=4).filter("n_tracks > 1")
    return out.select("conv_id", F.struct("*").alias("r"), "n_tracks").select("conv_id", *_shown(F.col("r")), "n_tracks")


@query(f"""
SELECT conv_id, turn, CASE WHEN said THEN '#Talk' ELSE coalesce(tags, '') END AS tags,
  CASE WHEN said THEN 'Poetry,Opera' ELSE categories END AS categories,
  CASE WHEN said THEN 'negative' ELSE {_sentiment_sql("conv_id", "turn")} END AS sentiment
FROM (SELECT doc_id, conv_id, turn, {_TRACK_SAID} AS said FROM {_TURNS} WHERE NOT {_BLANK})
LEFT JOIN (SELECT doc_id, string_agg(tag, ',' ORDER BY rank) AS tags FROM ({_TRACKS}) WHERE NOT {_BLOCKED} GROUP BY doc_id) USING (doc_id)
JOIN (SELECT doc_id, string_agg(category, ',' ORDER BY rank) AS categories FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, category) AS rank FROM ({_TRACK_TOPICS}))
  WHERE rank = 1 OR score >= 0.35 AND rank <= 3 GROUP BY doc_id) USING (doc_id)
WHERE conv_id IN (SELECT conv_id FROM {_TURNS} WHERE NOT {_BLANK} GROUP BY conv_id HAVING count(*) > 1)""")
def categorize_per_track(spark, sf_dir):
    """Each track's part in its recording's result, from the map that the result carries."""
    from brindle.plans.results import recording_results, text_result, track_results, with_track_results

    key, known = F.col("doc_id"), list(dict.fromkeys(CATEGORIES))
    second = _scores_of([(c, share(key + k, 4)) for k, c in enumerate(known)], lambda k: F.lit(True))
    model = _said((F.col("conv_id") + F.col("turn")) % 4 == 0, ["#Theory", "#Talk"], ["Poetry", "Opera"], "negative")
    words = vocabulary.Vocabulary(CATEGORIES, TAGS, RULES)
    result = text_result(F.col("text"), words, hits(), second, sentiment=_sentiment(F.col("conv_id"), F.col("turn")), model=model, k=4)
    rows = _turns(spark, sf_dir).withColumn("result", result)
    out = recording_results(rows, "conv_id", "turn", blocked=BLOCKED, k=4)
    out = with_track_results(out, track_results(rows, "conv_id", "turn", blocked=BLOCKED), "conv_id", "turn")
    each = out.select("conv_id", F.explode("per_track").alias("turn", "r"))
    return each.select("conv_id", "turn", F.array_join("r.tags", ",").alias("tags"), F.array_join("r.categories", ",").alias("categories"), "r.sentiment")


@query(f"""
WITH l AS ({SQL["learn_phrases_epoch"]}), h AS (SELECT doc_id, count(*) AS n FROM documents JOIN l ON contains(lower(text), phrase) GROUP BY doc_id)
SELECT doc_id, n, min(phrase) AS first FROM h JOIN documents USING (doc_id) JOIN l ON contains(lower(text), phrase) GROUP BY doc_id, n""")
def learned_hits(spark, sf_dir):
    """The texts that an epoch's learned phrases touch, by the lexicon's index: those that the next epoch judges again."""
    learned = learn_phrases_epoch(spark, sf_dir).select(F.xxhash64("phrase").alias("pos"), "phrase")
    return hit_counts(docs(spark, sf_dir).filter("doc_id is not null"), learned)


@query("""
WITH h AS (SELECT item_id AS pos, lower(text) AS phrase FROM benchmark),
n AS (SELECT max(pos) + 1 AS n FROM h),
a AS (SELECT phrase, min(pos) AS pos FROM (SELECT p_partkey AS pos, lower(trim(p_name)) AS phrase FROM part)
  WHERE phrase <> '' AND phrase NOT IN (SELECT phrase FROM h) GROUP BY phrase),
v AS (SELECT pos, phrase, 'harm' AS origin, pos % 5 = 0 AS gone FROM h UNION ALL SELECT pos + n, phrase, 'platform', FALSE FROM a, n)
SELECT phrase, pos, origin, gone FROM v""")
def lexicon_versions(spark, sf_dir):
    """A stored lexicon after a load, an addition and a removal: what is in its last version, and what is gone."""
    store = vocabulary.lexicon_store(spark, scratch(spark, "lexicon"))
    vocabulary.store_phrases(store, lexicon(spark, sf_dir), "harm")
    vocabulary.store_phrases(store, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("phrase")), "platform")
    vocabulary.forget_phrases(store, lexicon(spark, sf_dir).filter("pos % 5 = 0"))
    first = vocabulary.stored_phrases(store, 1).select("pos", "phrase", "origin")
    gone = first.join(vocabulary.stored_phrases(store), "phrase", "left_anti").withColumn("gone", F.lit(True))
    return vocabulary.stored_phrases(store).withColumn("gone", F.lit(False)).unionByName(gone).select("phrase", "pos", "origin", "gone")


@query("""
WITH h AS (SELECT item_id AS pos, lower(text) AS phrase FROM benchmark)
SELECT pos, phrase, 'harm' AS origin FROM h
UNION ALL SELECT p_partkey + (SELECT max(pos) + 1 FROM h), p_name, 'platform' FROM part""")
def lexicon_union(spark, sf_dir):
    """Both lexicons, harm first, duplicates kept."""
    platform = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("phrase"))
    return vocabulary.union_lexicons(lexicon(spark, sf_dir), platform)


_LINES = """(SELECT 0 AS k, 0 AS i, '[CATEGORIES]' AS line, TRUE AS head UNION ALL SELECT 1, row_number() OVER (ORDER BY c), c, FALSE
    FROM (SELECT DISTINCT upper(s_name[1:1]) || s_name[2:] AS c FROM supplier)
  UNION ALL SELECT 2, 0, '', TRUE UNION ALL SELECT 3, 0, '[TAGS]', TRUE
  UNION ALL SELECT 4, row_number() OVER (ORDER BY c), c, FALSE FROM (SELECT DISTINCT '#' || r_name AS c FROM region)
  UNION ALL SELECT 5, 0, '[KEYWORDS]', TRUE
  UNION ALL SELECT 6, row_number() OVER (ORDER BY n_nationkey), lower(n_name) || '|a=b = #' || n_name, FALSE FROM nation)"""


@query(f"""
SELECT CASE WHEN k < 2 THEN 'CATEGORIES' WHEN k < 5 THEN 'TAGS' ELSE 'KEYWORDS' END AS section, pos, line
FROM (SELECT k, line, head, row_number() OVER (ORDER BY k, i) - 1 AS pos FROM {_LINES}) WHERE NOT head""")
def vocabulary_file(spark, sf_dir):
    """A vocabulary that was written as a text file with sections, read back line by line."""
    names = lambda t, c: [r[0] for r in table(spark, sf_dir, t).select(c.alias("c")).distinct().orderBy("c").collect()]
    rules = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    made = vocabulary.Vocabulary(
        names("supplier", F.col("s_name")), names("region", F.concat(F.lit("#"), F.col("r_name"))),
        [Rule(f"{n.lower()}|a=b", f"#{n}") for n in rules],
    )
    path = scratch(spark, "vocabulary")
    vocabulary.write_sections(spark, made, path)
    return vocabulary.read_sections(spark, path).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id, least(length(coalesce(text, '')), 512)::BIGINT AS read, strlen(coalesce(text, '')[1:512])::BIGINT AS bytes FROM documents")
def prefix_scores(spark, sf_dir):
    """What a scorer that reads the first 512 characters sees of each text."""
    count = scorers.batch_scorer(lambda: lambda texts: [len((t or "").encode()) for t in texts], "text", "bytes", "long", scorers.READ_CHARS["toxicity"])
    read = F.length(F.substring(F.coalesce("text", F.lit("")), 1, scorers.READ_CHARS["toxicity"])).cast("long")
    return count(docs(spark, sf_dir)).select("doc_id", read.alias("read"), "bytes")


BANNED = ["Trash", "scum ", "LICENSE", "theory", "der"]
_BANNED = ", ".join(f"'{w}'" for w in BANNED)


@query(f"""
SELECT doc_id, len(x)::BIGINT AS n, array_to_string(x, '|') AS words FROM (
  SELECT doc_id, list_filter([{_BANNED}], lambda w: contains(lower(coalesce(text, '')), lower(w))) AS x FROM documents)""")
def blocked_hits(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", moderation.blocked_hits(F.col("text"), BANNED).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("words"))
