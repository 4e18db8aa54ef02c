"""Text to spans of sensitive identifiers, all within the row: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FEW, HIT, char_at, let, matches, running_max, shortened, without_mark
from ..functions.validators import Validator, registry
from ..sources.rules import Pattern, Rule, Rules
from .checks import as_python, lenient, python_verdicts

SPAN = "struct<start:int, `end`:int, entity_type:string, score:double, value:string>"
AS_OF = "2024-01-01"
#: Context words count within so many characters before a match, and lift its score so far.
WINDOW, BOOST, FLOOR = 60, 0.35, 0.4
#: Of no country and no known one: rules of this one, if there are any.
GLOBAL, DEFAULT = "GLOBAL", "US"


def context_regex(words: tuple[str, ...]) -> str:
    """One of the phrases, not glued to other letters."""
    quoted = [w.lower().replace("#", "\\#").replace(".", "\\.") for w in words]
    return "(?<![a-z])(?:" + "|".join(quoted) + ")(?![a-z])"


def lifted(score: float) -> float:
    """The score of a match that has a context word before it."""
    return min(1.0, max(score + BOOST, FLOOR))


def not_in_decimal(text: Column, start: Column, end: Column) -> Column:
    """Neither a digit nor a point after or before a digit touches the value; outside the text there are no digits."""
    digit = lambda i: char_at(text, i).rlike("[0-9]")
    point = lambda i: char_at(text, i) == "."
    return ~(digit(start - 1) | (point(start - 1) & digit(start - 2)) | digit(end) | (point(end) & digit(end + 1)))


def whole_number(left: Column, right: Column) -> Column:
    """not_in_decimal() from the characters before and after a value."""
    return ~(left.rlike("[0-9][.]?$") | right.rlike("^[.]?[0-9]"))


class _Patterns:
    """The patterns of all rules in order, each with its place k, and what a hit's k says."""

    def __init__(self, rules: Rules, validators: Mapping[str, Validator], apart: Mapping[str, object] | None = None, own: Mapping[str, object] | None = None):
        self.own = own  # names of the user's checks; None: no check follows
        self.rules, self.validators, self.apart = list(rules), validators, apart or {}  # apart: checks that stand in steps of their own
        self.flat = [(n, i, p) for n, r in enumerate(rules) for i, p in enumerate(r.patterns)]

    def hits(self, text: Column, clean: Column, cuts: Column | None = None) -> Column:
        before = WINDOW if any(r.context for r in self.rules) else 2
        shape = lambda r, p: p.stricter if p.stricter and self.own is not None and _checked(r, p, self.own) else p.regex
        return matches(text, clean, [shape(self.rules[n], p) for n, _, p in self.flat], before, 2 if any(r.guard_decimals for r in self.rules) else 0, [p.solid for _, _, p in self.flat], cuts)

    def of(self, k: Column, values: list) -> Column:
        """The one of a list of values, one for each pattern, that belongs to k."""
        return F.get(F.array(*map(F.lit, values)), k)

    def by_rule(self, k: Column, branches: list[Column | None], default: bool) -> Column:
        """The condition, one for each rule, that belongs to k."""
        out, end = None, 0
        for r, branch in zip(self.rules, branches, strict=True):
            end += len(r.patterns)
            value = F.lit(default) if branch is None else branch
            out = F.when(k < end, value) if out is None else out.when(k < end, value)
        return out.otherwise(F.lit(default))

    def score(self, h: Column) -> Column:
        """The score of the pattern, lifted if one of the rule's words stands in the text before."""
        base = self.of(h["k"], [float(p.score) for _, _, p in self.flat])
        if not any(r.context for r in self.rules):
            return base
        near = self.by_rule(h["k"], [F.lower(h["left"]).rlike(context_regex(r.context)) if r.context else None for r in self.rules], False)
        return F.when(near, self.of(h["k"], [lifted(p.score) if self.rules[n].context else float(p.score) for n, _, p in self.flat])).otherwise(base)

    def fine(self, text: Column, h: Column, countries: Column | None) -> Column:
        """Decimal guard, check and country of a hit's rule; a check that gives null fails the hit, not the job."""
        branches = []
        for r in self.rules:
            own = r.validator if r.validator not in self.apart else None
            if own and own not in self.validators:
                raise ValueError(f"{r.entity}: no validator named {r.validator}")
            parts = [whole_number(h["left"], h["right"])] if r.guard_decimals else []
            parts += [F.coalesce(self.validators[own](h["value"], text), F.lit(False))] if own else []
            parts += [F.array_contains(countries, r.country)] if countries is not None else []
            branches.append(reduce(lambda a, b: a & b, parts) if parts else None)
        return F.lit(True) if not any(b is not None for b in branches) else self.by_rule(h["k"], branches, True)

    def passing(self, text: Column, clean: Column, cuts: Column | None, countries: Column | None) -> Column:
        """The hits that pass guard, check and country."""
        return F.filter(self.hits(text, clean, cuts), lambda h: self.fine(text, h, countries))

    def spans(self, fine: Column) -> Column:
        """array<SPAN> of hits, where their score reaches the rule's threshold."""
        entity = lambda h: self.of(h["k"], [self.rules[n].entity for n, _, _ in self.flat])
        span = lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), entity(h).alias("entity_type"), self.score(h).alias("score"), h["value"].alias("value"), self.of(h["k"], [float(self.rules[n].min_confidence) for n, _, _ in self.flat]).alias("least"))
        passing = F.filter(F.transform(fine, span), lambda s: (s["score"] > 0) & (s["score"] >= s["least"]))
        return F.transform(passing, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "entity_type", "score", "value")]))

    def scores(self) -> list[float]:
        return [x for n, _, p in self.flat for x in ([float(p.score), lifted(p.score)] if self.rules[n].context else [float(p.score)])]

    def alone(self) -> bool:
        """Whether each entity has a single pattern, whose matches never overlap."""
        entities = [self.rules[n].entity for n, _, _ in self.flat]
        return len(entities) == len(set(entities))


def _holds(t: Column, s: Column) -> Column:
    """Whether t reaches over all of s and has no lower score, or the same place and a higher one."""
    longer = t["end"] - t["start"] > s["end"] - s["start"]
    return (t["start"] <= s["start"]) & (t["end"] >= s["end"]) & ((longer & (t["score"] >= s["score"])) | (~longer & (t["score"] > s["score"])))


def merged_few(ordered: Column) -> Column:
    """merged() of a few sorted spans of all entities, in their order: equal ones stand next to each other."""
    once = F.filter(ordered, lambda s, i: ~F.get(ordered, i - 1).eqNullSafe(s))
    return let(once, lambda every: F.filter(every, lambda s: ~F.exists(every, lambda t: (t["entity_type"] == s["entity_type"]) & _holds(t, s))))


def merged(spans: Column, scores: list[float]) -> Column:
    """Of each entity's spans one for each place with its best score, without those inside a span of no lower score.

    A few are held against each other.  Of more, in order of start, the longer first, whatever holds a span comes before it; so it is
    inside another if the farthest end so far among those of its score at least, one for each of the possible ``scores``,
    reaches its own.
    """
    levels, holds = sorted(set(scores)), _holds

    def reach_of(every: Column, least: Column) -> Column:
        return running_max(F.transform(every, lambda s: F.when(s["score"] >= least, s["end"]).otherwise(F.lit(-1))))

    def swept(every: Column) -> Column:
        # One expression for all levels: written out for each, they would be half of the plan.
        reach = F.transform(F.array(*map(F.lit, levels)), lambda v: reach_of(every, v))

        def kept(reached: Column) -> Column:
            level = lambda s: F.size(F.filter(F.array(*map(F.lit, levels[1:])).cast("array<double>"), lambda v: s["score"] >= v))
            farthest = lambda s, i: F.coalesce(F.get(F.get(reached, level(s)), i - 1), F.lit(-1))
            return F.filter(every, lambda s, i: farthest(s, i) < s["end"])

        return let(reach, kept)

    order = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-s["score"]).alias("down"), s.alias("span"))
    by_start = lambda own: F.transform(F.sort_array(F.transform(own, order)), lambda o: o["span"])
    few = lambda own: F.filter(own, lambda s: ~F.exists(own, lambda t: holds(t, s)))
    one_entity = lambda own: F.when(F.size(own) < 2, own).when(F.size(own) <= FEW, few(own)).otherwise(let(by_start(own), swept))

    def each(every: Column) -> Column:
        names = F.array_distinct(F.transform(every, lambda s: s["entity_type"]))
        return F.flatten(F.transform(names, lambda n: let(F.filter(every, lambda s: s["entity_type"] == n), one_entity)))

    return F.when(F.size(spans) < 2, spans).otherwise(let(F.array_distinct(spans), each))


def _checked(rule: Rule, p: Pattern, own: Mapping[str, object] | None) -> bool:
    """Whether the check that the pattern names follows, and not one of the user's by that name."""
    return p.checked is not None and p.checked[0] == rule.validator and rule.validator not in (own or {})


def _needs(rule: Rule, p: Pattern, own: Mapping[str, Validator] | None) -> str | None:
    return p.checked[1] if _checked(rule, p, own) else p.needs


def gate(rules: Rules, own: Mapping[str, Validator] | None = None) -> str | None:
    """What every text with a span has, for the rules given and the user's own checks; None if a pattern doesn't say what it needs."""
    needs = [_needs(r, p, own) for r in rules for p in r.patterns]
    return None if None in needs else "|".join(dict.fromkeys(needs))


#: Finding the words costs about as much as a pattern, so it takes so many patterns.
WORTH = 4


def gate_of_words(rules: Rules, own: Mapping[str, Validator] | None = None) -> str | None:
    """What a word of every span has, so that no other words but those next to it need be searched; None if a pattern is not local, or the patterns are too few to be worth it."""
    every = [(r, p) for r in rules for p in r.patterns]
    needs = [p.word or _needs(r, p, own) for r, p in every]
    return None if len(every) < WORTH or None in needs or not all(p.local for _, p in every) else "|".join(dict.fromkeys(needs))


def row_countries(rules: Rules, countries: Column) -> Column:
    """The countries whose rules hold for a row that names ``countries``: US if it names none, GLOBAL in place of an unknown one."""
    known = F.array(*[F.lit(c) for c in sorted({r.country for r in rules})])
    named = F.when(F.coalesce(F.size(countries), F.lit(0)) > 0, countries).otherwise(F.array(F.lit(DEFAULT)))
    return F.array_distinct(F.transform(named, lambda c: F.when(F.array_contains(known, c), c).otherwise(F.lit(GLOBAL))))


def unknown_country(rules: Rules, countries: Column) -> Column:
    """Whether a row names a country without rules while there are no GLOBAL ones."""
    return ~F.lit(any(r.country == GLOBAL for r in rules)) & F.array_contains(row_countries(rules, countries), GLOBAL)


#: Texts of so many characters are searched whole; in longer ones only the words that can be part of a span, and what is next to them.
SHORT = 512


def _where_worth(text: Column, rules: Rules, countries: Column | None, validators: Mapping[str, Validator] | None, found: Callable[[Column, Column | None, Column | None], Column]) -> Column:
    """found(searched text, its cuts, the row's countries) of the texts that can hold something; null for others."""
    own = None if countries is None else row_countries(rules, countries)
    needed, word = gate(rules, validators), gate_of_words(rules, validators)
    if word is None:
        seen = lambda clean: F.struct(clean.alias("clean"))
    else:
        whole = lambda clean: F.struct(clean.alias("clean"), F.array().cast("array<struct<at:int,gone:int>>").alias("cuts"))
        seen = lambda clean: F.when(F.length(clean) > SHORT, shortened(clean, word)).otherwise(whole(clean))
    bound = let(without_mark(text), lambda clean: F.struct(seen(clean).alias("seen"), *([] if own is None else [own.alias("own")])))
    worth = text.isNotNull() if needed is None else text.rlike(needed)
    return F.when(worth, let(bound, lambda b: found(b["seen"]["clean"], None if word is None else b["seen"]["cuts"], None if own is None else b["own"])))


def find_spans(text: Column, rules: Rules, as_of: str = AS_OF, validators: Mapping[str, Validator] | None = None, countries: Column | None = None) -> Column:
    """array<SPAN> of all rules, by start, end and entity; a null text has none.  Spans of different entities may share a place.

    With ``countries``, an array of each row's own, only rules of these hold for the row.  As everything is one column, the user's
    ``validators`` must be functions of columns, and what they raise ends the job; with_spans() has neither limit.
    """
    rules, none = rules.enabled(), F.array().cast(f"array<{SPAN}>")
    if not rules:
        return none
    python = [k for k, v in (validators or {}).items() if as_python(v) is not None]
    if any(r.validator in python for r in rules):
        raise ValueError(f"{', '.join(python)}: Python checks need a step of their own, which with_spans(), detect() and classify() make")
    patterns = _Patterns(rules, {**registry(as_of), **(validators or {})}, own=validators or {})

    def found(clean: Column, cuts: Column | None, own: Column | None) -> Column:
        return _sorted_spans(patterns, patterns.passing(text, clean, cuts, own))

    return F.coalesce(_where_worth(text, rules, countries, validators, found).cast(f"array<{SPAN}>"), none)


@lru_cache(maxsize=64)
def _built(application: str, text_col: str, rules: Rules, as_of: str) -> Column:
    return find_spans(F.col(text_col), rules, as_of)


def spans_column(spark: SparkSession, text_col: str, rules: Rules, as_of: str = AS_OF) -> Column:
    """find_spans() of a column by name, built once for the same rules in an application: it takes seconds for many rules."""
    return _built(spark.sparkContext.applicationId, text_col, rules, as_of)


def _sorted_spans(patterns: _Patterns, fine: Column) -> Column:
    spans = patterns.spans(fine)
    if patterns.alone():
        return F.sort_array(spans)
    every = lambda s: F.when(F.size(s) < 2, s).when(F.size(s) <= FEW, merged_few(s)).otherwise(F.sort_array(merged(s, patterns.scores())))
    return let(F.sort_array(spans), every)


def with_spans(df: DataFrame, rules: Rules, text_col: str = "text", as_of: str = AS_OF, validators: Mapping[str, Validator | object] | None = None, name: str = "spans", countries: Column | None = None) -> DataFrame:
    """Adds the spans of the text to every row.

    The user's ``validators``, by name, are functions of columns (value, text), python_check()s, or user-defined functions of Spark.
    What one of them raises costs the value, not the job: columns are analysed so that failing casts and operations give null
    (raise_error() still raises), Python checks are caught.  They stand in steps of their own between the search for hits and the
    merging of spans; rules without them stay one projection.
    """
    apart = {r.validator: validators[r.validator] for r in rules.enabled() if r.validator in (validators or {})}
    if not apart:
        return df.withColumn(name, spans_column(df.sparkSession, text_col, rules, as_of) if countries is None else find_spans(F.col(text_col), rules, as_of, None, countries))
    text, patterns = F.col(text_col), _Patterns(rules.enabled(), registry(as_of), apart, validators)
    none = F.array().cast(f"array<{HIT}>")
    hits = _where_worth(text, rules.enabled(), countries, validators, lambda clean, cuts, own: patterns.passing(text, clean, cuts, own))
    # A generated row is computed once; a projected array would be put together anew wherever it is read.
    out = df.select("*", F.explode(F.array(F.coalesce(hits.cast(f"array<{HIT}>"), none))).alias("__hits"))
    columns = {k: v for k, v in apart.items() if as_python(v) is None}
    if columns:
        with lenient(df.sparkSession):

            def fine(h: Column) -> Column:
                own = [F.coalesce(columns[r.validator](h["value"], text), F.lit(False)) if r.validator in columns else None for r in patterns.rules]
                return patterns.by_rule(h["k"], own, True)

            out = out.withColumn("__fine", F.transform("__hits", fine))
            out = out.withColumn("__hits", F.filter("__hits", lambda h, i: F.get(F.col("__fine"), i))).drop("__fine")
    python = [(n, as_python(apart[r.validator])) for n, r in enumerate(patterns.rules) if r.validator in apart and r.validator not in columns]
    if python:
        checks = [(check, patterns.rules[n].country, patterns.rules[n].check_parameters()) for n, check in python]
        number = {n: k for k, (n, _) in enumerate(python)}
        which = F.transform("__hits", lambda h: patterns.of(h["k"], [number.get(n, -1) for n, _, _ in patterns.flat]))
        out = out.withColumn("__fine", python_verdicts(F.transform("__hits", lambda h: h["value"]), which, text, checks))
        out = out.withColumn("__hits", F.filter("__hits", lambda h, i: F.get(F.col("__fine"), i))).drop("__fine")
    spans = F.when(F.size("__hits") > 0, let(F.col("__hits"), lambda h: _sorted_spans(patterns, h)).cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))
    return out.withColumn(name, spans).drop("__hits")


def detect(df: DataFrame, rules: Rules, text_col: str = "text", id_col: str = "doc_id", as_of: str = AS_OF, validators: Mapping[str, Validator] | None = None) -> DataFrame:
    """(id, entity_type, start, end, score, value): one row per span."""
    # The outer form: for the inner one Spark would test the spans' size first, and so compute them twice.
    spans = with_spans(df.select(id_col, text_col), rules, text_col, as_of, validators).select(id_col, F.explode_outer("spans").alias("s")).where("s is not null")
    return spans.select(id_col, "s.entity_type", "s.start", "s.end", F.round("s.score", 4).alias("score"), "s.value")


def raw_matches(df: DataFrame, rules: Rules, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, entity_type, pattern, start, end, base_score, score, value) before any check, threshold or merge."""
    text, patterns = F.col(text_col), _Patterns(rules.enabled(), {})
    of = lambda h, at: patterns.of(h["k"], at)
    fields = lambda h: F.struct(of(h, [patterns.rules[n].entity for n, _, _ in patterns.flat]).alias("entity_type"), of(h, [i for _, i, _ in patterns.flat]).alias("pattern"), h["start"].alias("start"), h["end"].alias("end"), of(h, [float(p.score) for _, _, p in patterns.flat]).alias("base"), patterns.score(h).alias("score"), h["value"].alias("value"))
    every = F.transform(let(without_mark(text), lambda clean: patterns.hits(text, clean)), fields)
    rows = df.select(id_col, F.explode_outer(every).alias("m")).where("m is not null")
    return rows.select(id_col, "m.entity_type", "m.pattern", "m.start", "m.end", F.col("m.base").alias("base_score"), F.round("m.score", 4).alias("score"), "m.value")


def known_entities(spans: DataFrame, rules_table: DataFrame) -> DataFrame:
    """Spans of entities in the rule table; the table has a few dozen rows, so it is broadcast."""
    return spans.join(F.broadcast(rules_table.select("entity_type").distinct()), "entity_type", "left_semi")


def above_threshold(spans: DataFrame, rules_table: DataFrame) -> DataFrame:
    """Spans whose score reaches their entity's threshold."""
    least = F.broadcast(rules_table.select("entity_type", "min_confidence"))
    return spans.join(least, "entity_type").where((F.col("score") > 0) & (F.col("score") >= F.col("min_confidence"))).drop("min_confidence")


def with_display_name(spans: DataFrame, rules_table: DataFrame) -> DataFrame:
    """Adds the display name; an unknown entity keeps its own."""
    names = F.broadcast(rules_table.select("entity_type", "return_name"))
    return spans.join(names, "entity_type", "left").withColumn("return_name", F.coalesce("return_name", "entity_type"))
