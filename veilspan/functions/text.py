"""Positions of pattern matches in code points, from built-in string functions alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A code point that is no character and does not occur in exchanged text; where it does, matching sees another in its place.
MARK, STAND_IN = "﷐", "﷑"
#: Another one, for the end of a match.
CLOSE = "\ufdd2"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states of a fold after each element of an array, block by block of about the square root of its size.

    Arrays cannot be appended to without a copy; blocks keep what is copied for one element short.
    """
    none = F.slice(F.array(zero), 1, 0)

    def within(state: Column, block: Column) -> Column:
        start = F.struct(state.alias("state"), none.alias("states"))

        def one(acc: Column, x: Column) -> Column:
            return let(step(acc["state"], x), lambda s: F.struct(s.alias("state"), F.concat(acc["states"], F.array(s)).alias("states")))

        return F.aggregate(block, start, one)

    def over(every: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(every))).cast("int")
        blocks = let(side, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / n).cast("int")), lambda i: F.slice(every, i * n + 1, n)))
        start = F.struct(zero.alias("state"), F.slice(F.array(none), 1, 0).alias("done"))
        lift = lambda acc, block: let(within(acc["state"], block), lambda w: F.struct(w["state"].alias("state"), F.concat(acc["done"], F.array(w["states"])).alias("done")))
        return F.when(F.size(every) == 1, F.transform(every, lambda x: step(zero, x))).when(F.size(every) > 1, F.aggregate(blocks, start, lift, lambda acc: F.flatten(acc["done"]))).otherwise(none)

    return let(items, over)


def running_sums(numbers: Column) -> Column:
    """The sum up to and including each element of an array of int."""
    return running(numbers, F.lit(0).cast("int"), lambda acc, x: acc + x)


def running_max(numbers: Column) -> Column:
    """The largest up to and including each element of an array of int, and -1 at least."""
    return running(numbers, F.lit(-1).cast("int"), lambda acc, x: F.greatest(acc, x))


def without_mark(text: Column) -> Column:
    """The text as matching sees it: as long, without MARK."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)


def pieces_of(clean: Column, pattern: str, solid: bool = True) -> Column:
    """What lies between the leftmost matches of a pattern, and the matches, by turns; one pass of the pattern over without_mark().

    A ``solid`` pattern never matches the empty string.  Of another, empty matches are taken out: they open and close at one place.
    """
    if solid:
        return F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    marked = F.regexp_replace(F.translate(clean, CLOSE, STAND_IN), F.lit(pattern), F.lit(f"{MARK}$0{CLOSE}"))
    return F.split(F.replace(F.replace(marked, F.lit(MARK + CLOSE), F.lit("")), F.lit(CLOSE), F.lit(MARK)), MARK, -1)


#: Stands for what shortened() leaves out: a line break ends what . matches, the middle belongs to no word and no space.
GAP = "\n\ufdd3\n"
#: Characters kept before and after the words that matter; a match and its context lie within them.
KEEP_BEFORE, KEEP_AFTER = 100, 8


def shortened(clean: Column, word: str) -> Column:
    """struct<clean, cuts> of without_mark(): only words in which ``word`` matches, and the text next to them.

    ``cuts`` are struct<at, gone>: from the place ``at`` of the shortened text on, ``gone`` characters of the whole text are missing.
    """
    marked = rf"(?=\S*?(?:{word}))\S++"

    def part(x: Column, i: Column) -> Column:
        away = F.length(x) - (KEEP_BEFORE + KEEP_AFTER + len(GAP))
        cut = (i % 2 == 0) & (away > len(GAP))
        return F.struct(F.when(cut, F.concat(F.left(x, F.lit(KEEP_AFTER)), F.lit(GAP), F.right(x, F.lit(KEEP_BEFORE)))).otherwise(x).alias("new"), F.when(cut, away).otherwise(F.lit(0)).alias("gone"))

    def sums(parts: Column) -> Column:
        return F.struct(F.array_join(F.transform(parts, lambda x: x["new"]), "").alias("clean"), parts.alias("parts"), running_sums(F.transform(parts, lambda x: F.length(x["new"]))).alias("ends"), running_sums(F.transform(parts, lambda x: x["gone"])).alias("gone"))

    def cuts(b: Column) -> Column:
        every = F.transform(b["parts"], lambda x, i: F.when(x["gone"] > 0, F.struct((F.get(b["ends"], i) - KEEP_BEFORE).alias("at"), F.get(b["gone"], i).alias("gone"))))
        return F.struct(b["clean"].alias("clean"), F.filter(every, lambda c: c.isNotNull()).alias("cuts"))

    return let(let(F.transform(pieces_of(clean, rf"(?<!\S){marked}(?:\s++{marked})*+"), part), sums), cuts)


def whole_place(cuts: Column, at: Column) -> Column:
    """The place in the whole text of one in the shortened text, by halving of its cuts."""

    def step(acc: Column, _: Column) -> Column:
        def half(mid: Column) -> Column:
            past = (acc["lo"] < acc["hi"]) & (F.get(cuts, mid)["at"] <= at)
            return F.struct(F.when(past, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(past, acc["hi"]).otherwise(mid).alias("hi"))

        return let(F.floor((acc["lo"] + acc["hi"]) / 2).cast("int"), half)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int") + 1)
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), step, lambda acc: F.get(cuts, acc["lo"] - 1)["gone"])
    return F.when(F.size(cuts) == 0, at).otherwise(at + F.coalesce(found, F.lit(0)))


HIT = "struct<k:int, start:int, `end`:int, value:string, left:string, right:string>"
#: A text with so many matches of a pattern takes each one's place from all that lies before it; with more, from running sums.
FEW = 32


def matches(text: Column, clean: Column, patterns: Sequence[str], before: int = 0, after: int = 0, solid: Sequence[bool] | None = None, cuts: Column | None = None) -> Column:
    """array<HIT> of the leftmost matches of each of some patterns, without empty ones; ``k`` counts patterns from 0.

    ``solid`` says which patterns never match the empty string (None: all), which spares the search for such matches.
    With ``cuts``, ``clean`` is shortened() and places are of the whole text.

    Offsets are half-open and count code points from 0: matches and the pieces between them alternate, so their lengths add up to
    the positions.  ``left`` and ``right`` are up to ``before`` and ``after`` characters of the text next to the match.  Only the
    pieces differ by pattern; what follows is one expression for all, which keeps the plan small.
    """
    none = F.array().cast(f"array<{HIT}>")

    def joined(parts: Column, first: Column | int, n: Column | int) -> Column:
        return F.array_join(F.slice(parts, first, n), "")

    def hit(k: Column, at: Column, value: Column, left: Column, right: Column) -> Column:
        return placed(k, at, value, left, right) if cuts is None else let(whole_place(cuts, at), lambda start: placed(k, start, value, left, right))

    def placed(k: Column, start: Column, value: Column, left: Column, right: Column) -> Column:
        own = F.when(F.contains(value, F.lit(STAND_IN)), F.substring(text, start + 1, F.length(value))).otherwise(value)
        return F.struct(k.alias("k"), start.alias("start"), (start + F.length(value)).alias("end"), own.alias("value"), left.alias("left"), right.alias("right"))

    def places(p: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 2).cast("int") - 1)

    def few(f: Column) -> Column:
        p = f["p"]
        right = lambda i: F.left(joined(p, 2 * i + 3, 2 * after), F.lit(after)) if after else F.lit("")

        def one(i: Column) -> Column:
            return let(joined(p, 1, 2 * i + 1), lambda head: hit(f["k"], F.length(head), F.get(p, 2 * i + 1), F.right(head, F.lit(before)) if before else F.lit(""), right(i)))

        return F.transform(places(p), one)

    def many(f: Column) -> Column:
        # A piece before or after may be empty, a match isn't: so many parts hold so many characters at least.
        p, reach = f["p"], 2 * before
        tails = F.transform(p, lambda x: F.right(x, F.lit(before))) if before else F.array().cast("array<string>")
        heads = F.transform(p, lambda x: F.left(x, F.lit(after))) if after else F.array().cast("array<string>")
        left_of = lambda b, i: F.right(joined(b["tails"], F.greatest(2 * i + 2 - reach, F.lit(1)), F.least(2 * i + 1, F.lit(reach))), F.lit(before)) if before else F.lit("")
        right_of = lambda b, i: F.left(joined(b["heads"], 2 * i + 3, 2 * after), F.lit(after)) if after else F.lit("")
        bound = F.struct(running_sums(F.transform(p, F.length)).alias("at"), tails.alias("tails"), heads.alias("heads"))
        return let(bound, lambda b: F.transform(places(p), lambda i: hit(f["k"], F.get(b["at"], 2 * i), F.get(p, 2 * i + 1), left_of(b, i), right_of(b, i))))

    found = F.array(*[F.struct(F.lit(k).alias("k"), pieces_of(clean, rx, solid is None or solid[k]).alias("p")) for k, rx in enumerate(patterns)])
    every = lambda f: F.when(F.size(f["p"]) > 2 * FEW + 1, many(f)).when(F.size(f["p"]) > 1, few(f)).otherwise(none)
    return F.flatten(F.transform(found, every))


def char_at(text: Column, index: Column) -> Column:
    """The character at a position counted from 0; empty outside the text."""
    return F.when(index >= 0, F.substring(text, index + 1, F.lit(1))).otherwise(F.lit(""))
