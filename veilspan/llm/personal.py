"""Personal data: fixed patterns give seeds; the contexts of seeds, scored over the corpus, find what the patterns miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, running_sums
from .scratch import written
from .skew import join_groups

# The kinds in order and the patterns that define them, written so that no start is tried twice within a run.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Candidates for what the patterns miss: spelled-out or host-only addresses, numbers with any separators.
CANDIDATES = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    "number": r"[(]?[0-9](?:[\x20().:/-]{0,2}+[0-9])++",
}
CANDIDATE_GATES = {"address": r"@|[(\[]at[)\]]", "number": r"[0-9][\x20().:/-]{0,2}[0-9]"}
#: Characters before and after an identifier that its contexts are taken from.
CONTEXT = 48
#: Different identifiers of a kind that a context must have, share of those among all it has, most rounds of scoring (None: until settled).
SUPPORT, CONFIDENCE, ROUNDS = 8, 0.8, None
#: Scores are settled when no context or identifier is new and their sum grows by no more than this share.
SETTLED = 1e-6


def matches(text: Column, pattern: str, gate: str) -> Column:
    """array<struct<start, end, value, left, right>> of a pattern's leftmost matches, in code points, with the text next to them."""
    kind = "array<struct<start:int,end:int,value:string,left:string,right:string>>"

    def place(m: Column) -> Column:
        pieces, rest = F.slice(m["between"], 1, F.size(m["found"])), F.slice(m["between"], 2, F.size(m["found"]))
        sides = F.zip_with(pieces, rest, lambda a, b: F.struct(F.right(a, F.lit(CONTEXT)).alias("left"), F.left(b, F.lit(CONTEXT)).alias("right")))
        ends = running_sums(F.zip_with(m["found"], pieces, lambda value, before: F.length(value) + F.length(before)))
        spans = F.zip_with(m["found"], ends, lambda value, end: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))
        return F.zip_with(spans, sides, lambda s, x: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(F.regexp_like(text, F.lit(gate)), let(found, place)).otherwise(F.array()).cast(kind)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """What a match must fulfil besides its pattern."""
    if kind == "ip":
        parts = F.transform(F.split(value, "[.]"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value, left, right>> of all kinds, by start, then kind (its place in KINDS)."""
    of = lambda k, kind: F.transform(F.filter(matches(text, PATTERNS[kind], GATES[kind]), lambda m: valid(kind, m["value"])), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right")))
    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def plausible(value: Column) -> Column:
    """The kinds that a candidate could be of."""
    n = F.length(digits(value))
    as_address = F.regexp_like(value, F.lit("[A-Za-z@]"))
    four = F.regexp_like(value, F.lit(r"^[0-9]{1,3}(?:[-.:/][0-9]{1,3}){3}$"))
    options = [(0, as_address), (1, ~as_address & four), (2, ~as_address & n.between(12, 19)), (3, ~as_address & n.between(7, 15) & ~four)]
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in options]), lambda k: k.isNotNull())


def contexts_of(left: Column, right: Column) -> Column:
    """The last two words before, marked <, and the first two after, marked >; lower-cased, numbers as 0; none without a letter."""

    def plain(mark: str, words: Column) -> Column:
        words = F.regexp_replace(F.regexp_replace(F.lower(F.trim(words)), "[0-9]+", "0"), r"\s+", " ")
        return F.when(F.regexp_like(words, F.lit(r"\p{L}")), F.concat(F.lit(mark), words))

    before = F.regexp_extract(left, r"(?:(?:^|\s)(\S+)\s+)?(\S+)\s*$", 0)
    after = F.regexp_extract(right, r"^\s*(\S+)(?:\s+(\S+))?", 0)
    return F.filter(F.array(plain("<", before), plain(">", after)), lambda c: c.isNotNull())


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def learned_mentions(mentions: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int | None = ROUNDS) -> DataFrame:
    """(context, value, kind) of candidates that contexts of seeds vouch for, from rows (context, value, kind or null, options).

    Contexts and identifiers form a graph; each edge counts once, however often it occurs.  By turns a context's score for a kind
    is the share of its identifiers that are of the kind (seeds wholly, others by their score), and an identifier's score
    is the chance that not all of its contexts err.  A context takes part once seeds and identifiers accepted so far give it
    ``support`` and ``confidence``, so what it vouches for can make further contexts credible, until nothing changes.
    A context with very many identifiers, or an identifier with very many contexts, is dealt over several tasks in every join.
    """
    edges = written(mentions.where(F.col("context").isNotNull()).groupBy("context", "value", "kind").agg(F.first("options").alias("options")))
    total = edges.count()
    of_value = lambda rows, groups, how="inner": join_groups(rows, groups, ["value", "kind"], "n", ["context"], total, how).drop("__salt")
    of_context = lambda rows, groups, how="inner": join_groups(rows, groups, ["context", "kind"], "values", ["value"], total, how).drop("__salt")
    seeded = edges.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
    all_of = edges.groupBy("context").agg(F.count_distinct("value").alias("values"))
    own = edges.where("kind is not null").groupBy("context", "kind").agg(F.count(F.lit(1)).cast("double").alias("sure"))
    unknown = edges.where("kind is null").select("context", "value", F.explode("options").alias("kind"))
    contexts = edges.where("kind is null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    every = written(of_value(unknown, seeded.join(contexts, "value"), "left_anti").distinct())
    # Before a context takes part, only identifiers that other contexts have as well can lift it; what cannot reach the bounds even if
    # all of these were certain never takes part.
    twice = every.groupBy("value", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = of_value(every, twice).groupBy("context", "kind").agg(F.count(F.lit(1)).alias("shared"))
    sure, most = F.coalesce("sure", F.lit(0.0)), F.col("sure") + F.col("shared")
    reach = own.join(shared, ["context", "kind"], "full").select("context", "kind", sure.alias("sure"), F.coalesce("shared", F.lit(0)).alias("shared")).join(all_of, "context")
    hopeful = written(reach.where((most >= support) & (most >= (F.col("values") + 1) * confidence - 1e-6)).drop("shared"))
    open_edges = written(of_context(every, hopeful, "left_semi"))
    degrees = written(open_edges.groupBy("value", "kind").agg(F.count(F.lit(1)).alias("n")))
    scores = degrees.select("value", "kind", F.lit(0.0).alias("score"), "n").limit(0)
    before, done = (0, 0, 0.0), 0
    while True:
        accepted = F.count(F.when(F.col("score") >= confidence, 1))
        gained = of_value(open_edges, scores).groupBy("context", "kind").agg(F.sum("score").alias("gained"), accepted.alias("accepted"))
        gain, more = F.coalesce("gained", F.lit(0.0)), F.coalesce("accepted", F.lit(0))
        patterns = hopeful.join(gained, ["context", "kind"], "left").where(F.col("sure") + more >= support)
        trusted = written(patterns.select("context", "kind", "values", ((F.col("sure") + gain) / (F.col("values") + 1)).alias("trust")).where(F.col("trust") >= confidence))
        err = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))
        scored = of_context(open_edges, trusted).groupBy("value", "kind").agg((1 - F.exp(err)).alias("score"))
        scores = written(scored.join(degrees, ["value", "kind"]))
        sums = scores.agg(accepted.alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("sum")).first()
        now, done = (trusted.count(), sums["n"], sums["sum"]), done + 1
        if done == rounds or (now[:2] == before[:2] and now[2] - before[2] <= SETTLED * now[2]):
            break
        before = now
    best = scores.where(F.col("score") >= confidence).groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    best = best.select("value", (-F.col("b.k")).alias("kind"))
    return of_value(of_context(open_edges, trusted, "left_semi"), best.join(degrees, ["value", "kind"]), "left_semi").select("context", "value", "kind").distinct()


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int | None = ROUNDS) -> DataFrame:
    """(id_col, base, found) for every row: arrays of spans (start, kind, end, value) by start, then kind.

    ``base`` are the matches of the fixed patterns, overlaps between kinds included; ``found`` adds candidates that overlap none
    of them and that learned_mentions() vouches for.  A null text is empty.  Equal rows are treated alike, an empty table gives an
    empty result, other columns are not read.  Texts never leave the first scan: tables hold spans and their contexts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.when(F.regexp_like(text, F.lit("[0-9@]")), base_spans(text)).otherwise(F.array()).cast("array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>")
    first = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"), base.alias("base"))
    every = F.concat(*[matches(F.col("text"), CANDIDATES[c], CANDIDATE_GATES[c]) for c in CANDIDATES])
    fresh = F.filter(every, lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & (F.size(plausible(m["value"])) > 0))
    spans = lambda of: F.transform(of, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value"), contexts_of(m["left"], m["right"]).alias("contexts")))
    more = F.transform(fresh, lambda m: F.struct(m["start"].alias("start"), F.lit(None).cast("int").alias("kind"), m["end"].alias("end"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right")))
    rows = written(first.select("id", "row", spans(F.col("base")).alias("base"), spans(more).alias("more")))
    mentions = rows.select(F.explode(F.concat("base", "more")).alias("m")).select(F.explode("m.contexts").alias("context"), F.lower("m.value").alias("value"), "m.kind", plausible(F.col("m.value")).alias("options"))
    learned = written(learned_mentions(mentions, support, confidence, rounds).withColumnRenamed("kind", "new_kind"))
    new = rows.select("id", "row", F.explode("more").alias("m")).select("id", "row", F.explode("m.contexts").alias("context"), F.lower("m.value").alias("value"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("shown"))
    # A value has one learned kind, so a span that both of its contexts vouch for is the same twice.
    often = new.groupBy("context", "value").agg(F.count(F.lit(1)).alias("n"))
    vouched = join_groups(new, learned.join(often, ["context", "value"]), ["context", "value"], "n", ["id", "start"], new.count())
    new = vouched.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("start", F.col("new_kind").alias("kind"), "end", F.col("shown").alias("value")))).alias("found"))
    new = new.select(F.col("id").alias("n_id"), F.col("row").alias("n_row"), "found")
    got = rows.join(new, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("row") == F.col("n_row")), "left")
    bare = F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "value")]))
    return got.select(F.col("id").alias(id_col), bare.alias("base"), F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")).alias("found"))


def report(docs: DataFrame, **options) -> DataFrame:
    """find_personal() as counts of base spans per kind, their digest, all spans, and the number of added ones."""
    got = find_personal(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.array_sort(F.concat("base", "found"))
    return got.select("doc_id", *map(count, range(len(KINDS))), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(every).alias("spans"), F.size("found").cast("long").alias("n_found"))
