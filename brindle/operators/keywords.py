"""Keyword rules over texts: counts, scores, segment density, tag pools and rankings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import let, tag_tokens, tokens, word_bounded
from brindle.sources.vocabulary import Rule


#: Characters of a word, as at a rule's boundaries.
WORD = r"[\p{L}\p{N}_]+"
_PLAIN = re.compile(r"[^\\\[\](){}*+?^$.|]+")
_TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class _Plan:
    """How a rule is matched. ``words`` are its alternatives of one word, which are counted as words of the text. The others
    can only match where one of ``pairs`` (a word that stands alone, the literal around it), of ``dotted`` (two words about a
    dot: both stand alone, or one word is both about a letter) or of ``loose`` (a literal) is in the text, or ``always`` may;
    only there the rule's expression is run. ``parts`` are the literals of all alternatives with dots."""

    pattern: str
    words: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    dotted: tuple[tuple[str, str], ...]
    parts: tuple[str, ...]
    loose: tuple[str, ...]
    always: bool

    @property
    def simple(self) -> bool:
        return not (self.pairs or self.parts or self.always)


def plan_of(rule: Rule) -> _Plan:
    """What every match of a rule's alternatives holds: one without operators itself, and its longest word as a word; one of
    two words about a dot both as words or as one; another with dots as its only operators its longest piece; of others nothing
    is known."""
    words, pairs, dotted, parts, loose, always = [], [], [], [], [], False
    for alternative in rule.pattern.lower().split("|"):
        alternative = alternative.strip()
        pieces = alternative.split(".")
        if alternative and _PLAIN.fullmatch(alternative) and (tokens := _TOKEN.findall(alternative)):
            if tokens == [alternative]:
                words.append(alternative)
            else:
                pairs.append((max(tokens, key=len), alternative))
        elif len(pieces) > 1 and any(pieces) and all(not p or _PLAIN.fullmatch(p) for p in pieces):
            parts.append(max(pieces, key=len))
            if len(pieces) == 2 and all(map(_TOKEN.fullmatch, pieces)):
                dotted.append((pieces[0], pieces[1]))
            else:
                loose.append(parts[-1])
        else:
            always = True
    once = lambda x: tuple(dict.fromkeys(x))
    return _Plan(word_bounded(rule.pattern), once(words), once(pairs), once(dotted), once(parts), once(loose), always)


def _one_word(dotted: list[tuple[str, str]]) -> str:
    """The expression of words that hold both pieces of one of ``dotted`` about a letter."""
    return r"\A(?:" + "|".join(f"{a}.{b}" for a, b in dotted) + r")\z"


def _read_once(text: Column, plans: list[_Plan]) -> Column:
    """struct<low, words, joined> of a text: lower-cased, those of its words that some rule looks for, and those that are both
    pieces of a dotted alternative about a letter; in one pass."""
    low = F.lower(F.coalesce(text, F.lit("")))
    dotted = list(dict.fromkeys(d for p in plans for d in p.dotted))
    wanted = list(dict.fromkeys(w for p in plans for w in (*p.words, *(w for w, _ in p.pairs), *(w for d in p.dotted for w in d))))
    none = F.array().cast("array<string>")
    if not wanted:
        return F.struct(low.alias("low"), none.alias("words"), none.alias("joined"))
    sizes = sorted({len(a) + 1 + len(b) for a, b in dotted})

    def kept(own: Column) -> Column:
        words = F.filter(own["all"], lambda w: w.isin(wanted))
        joined = F.filter(own["all"], lambda w: F.length(w).isin(sizes) & w.rlike(_one_word(dotted))) if dotted else none
        return F.struct(own["low"].alias("low"), words.alias("words"), joined.alias("joined"))

    return let(let(low, lambda t: F.struct(t.alias("low"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("all"))), kept)


def _has_word(plan: _Plan, own: Column) -> Column:
    return F.exists(own["words"], lambda w: w.isin(list(plan.words))) if plan.words else F.lit(False)


def _needs_expression(plan: _Plan, own: Column) -> Column:
    """Whether an alternative that isn't a word may match."""
    if plan.always:
        return F.lit(True)
    found = F.lit(False)
    if plan.pairs:  # the words are few and read already; the literals are looked for only where one is there
        literal = F.lit(False)
        for _, whole in plan.pairs:
            literal = literal | F.contains(own["low"], F.lit(whole))
        found = F.exists(own["words"], lambda w: w.isin([w for w, _ in plan.pairs])) & literal
    if plan.dotted:
        found = found | F.exists(own["joined"], lambda w: w.rlike(_one_word(list(plan.dotted))))
    for a, b in plan.dotted:
        found = found | (F.array_contains(own["words"], a) & F.array_contains(own["words"], b))
    for part in plan.loose:
        found = found | F.contains(own["low"], F.lit(part))
    return found


def _count(plan: _Plan, own: Column) -> Column:
    """How often a rule matches: its words are counted, unless another alternative may match, which runs the expression."""
    n = F.size(F.filter(own["words"], lambda w: w.isin(list(plan.words)))) if plan.words else F.lit(0)
    if plan.simple:
        return n
    return F.when(_needs_expression(plan, own), F.regexp_count(own["low"], F.lit(plan.pattern))).otherwise(n)


def _matches(plan: _Plan, own: Column) -> Column:
    if plan.simple:
        return _has_word(plan, own)
    return _has_word(plan, own) | (_needs_expression(plan, own) & own["low"].rlike(plan.pattern))


def _raw_score(n: Column) -> Column:
    return F.least(F.lit(1.0), n * 0.15 + 0.4)


def _tag_counts(own: Column, by_tag: dict[str, list[_Plan]]) -> Column:
    """array<struct<label, n>>: each tag's matches, of several rules those of the last that matches; 0 for none."""

    def measured(tag: str, plans: list[_Plan]) -> Column:
        counts = [_count(p, own) for p in plans]
        n = counts[0] if len(counts) == 1 else F.coalesce(*[F.nullif(c, F.lit(0)) for c in reversed(counts)], F.lit(0))
        return F.struct(F.lit(tag).alias("label"), n.cast("long").alias("n"))

    return F.array(*[measured(t, p) for t, p in by_tag.items()])


def _by_tag(rules: list[Rule]) -> dict[str, list[_Plan]]:
    out: dict[str, list[_Plan]] = {}
    for r in rules:
        out.setdefault(r.tag, []).append(plan_of(r))
    return out


def rule_hits(text: Column, rules: list[Rule]) -> Column:
    """array<struct<label, n, score>> of the tags whose rules match: score = min(1, 0.15 n + 0.4).

    Of several rules of one tag the last that matches counts. A text is read once for its words: rules of plain words are
    counts of these, and the expression of any other rule runs only over texts that hold what its matches must.
    """
    if not rules:
        return F.array().cast("array<struct<label: string, n: bigint, score: double>>")
    by_tag = _by_tag(rules)
    own = _read_once(text, [p for plans in by_tag.values() for p in plans])
    hit = F.filter(let(own, lambda x: _tag_counts(x, by_tag)), lambda r: r["n"] > 0)
    score = lambda n: F.round(_raw_score(n), 4)
    return F.transform(hit, lambda r: F.struct(r["label"].alias("label"), r["n"].alias("n"), score(r["n"]).alias("score")))


def keyword_scores(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tag, n, score) of rules that match. Null texts match nothing."""
    rows = docs.select(key, F.explode(rule_hits(F.col(text), rules)).alias("r"))
    return rows.select(key, F.col("r.label").alias("tag"), "r.n", "r.score")


def segment_scores(
    docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text", segments: str = "segments"
) -> DataFrame:
    """(key, tag, score) from a text and its array of segment texts, one row for each tag that is hit in either.

    A tag has the text's score by ``rule_hits``, 0 where no rule matches. One that is hit in a segment gets 0.6 of that and
    0.4 of its density: the hits of all its rules, one for each rule and segment, over the number of segments.
    """
    by_tag = _by_tag(rules)
    plans = [p for found in by_tag.values() for p in found]
    if not rules:
        return docs.select(key, F.lit("").alias("tag"), F.lit(0.0).alias("score")).filter(F.lit(False))
    parts = F.coalesce(F.col(segments), F.array().cast("array<string>"))
    rows = docs.select(
        key, F.greatest(F.size(parts), F.lit(1)).alias("segments"), _read_once(F.col(text), plans).alias("own"),
        F.transform(parts, lambda s: _read_once(s, plans)).alias("parts"),
    )
    counts = _tag_counts(F.col("own"), by_tag)
    hits_of = lambda plan: F.size(F.filter("parts", lambda s: _matches(plan, s)))
    in_parts = [sum((hits_of(p) for p in found), F.lit(0)) for found in by_tag.values()]
    both = F.zip_with(counts, F.array(*in_parts), lambda c, h: F.struct(c["label"].alias("tag"), c["n"].alias("n"), h.alias("hits")))
    hit = rows.select(key, "segments", F.inline(both)).filter("n > 0 OR hits > 0")
    whole = F.when(F.col("n") > 0, _raw_score(F.col("n"))).otherwise(F.lit(0.0))
    blended = whole * 0.6 + F.col("hits") / F.col("segments") * 0.4
    return hit.select(key, "tag", F.round(F.when(F.col("hits") > 0, blended).otherwise(whole), 4).alias("score"))


def _has(hits: Column, label: Column) -> Column:
    return F.exists(hits, lambda h: h["label"] == label)


def tag_pool(text: Column, hits: Column, tags: list[str], size: int = 120) -> Column:
    """array<string>: tags that rules hit first, then tags sharing a word with the text, then every step-th of the rest.

    ``hits`` is an array of structs with ``label``. The rest fills up to ``size``; the step is the number left over the
    number of free places, 1 at least. All is done within the row, as the vocabulary is small.
    """
    listed = list(dict.fromkeys(tags))
    if not listed:
        return F.array().cast("array<string>")
    words = F.array(*[F.struct(F.lit(t).alias("tag"), tag_tokens(F.lit(t)).alias("words")) for t in listed])

    def marked(own: Column) -> Column:
        hit = lambda x: _has(own["hits"], x["tag"])
        bucket = lambda x: F.when(hit(x), 0).when(F.arrays_overlap(own["words"], x["words"]), 1).otherwise(2)
        return F.transform(words, lambda x: F.struct(x["tag"].alias("tag"), bucket(x).alias("bucket")))

    def pool(m: Column) -> Column:
        of = lambda k: F.transform(F.filter(m, lambda x: x["bucket"] == k), lambda x: x["tag"])
        front, rest = F.concat(of(0), of(1)), of(2)
        slots = F.greatest(F.lit(0), F.lit(size) - F.size(front))
        step = F.greatest(F.lit(1), F.floor(F.size(rest) / F.greatest(slots, F.lit(1))))
        return F.concat(front, F.filter(rest, lambda _, i: (i % step == 0) & (F.floor(i / step) < slots)))

    return let(let(F.struct(hits.alias("hits"), tokens(text).alias("words")), marked), pool)


def ranked_categories(hits: Column, categories: list[str]) -> Column:
    """array<string>: categories that were hit, with or without #, first; each part in the given order."""
    if not categories:
        return F.array().cast("array<string>")
    listed = F.array(*[F.lit(c) for c in categories])

    def ranked(own: Column) -> Column:
        hit = lambda c: _has(own, c) | _has(own, F.concat(F.lit("#"), c))
        return F.concat(F.filter(listed, hit), F.filter(listed, lambda c: ~hit(c)))

    return let(hits, ranked)
