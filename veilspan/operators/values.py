"""Values named by an external model: parsing its output, finding the values in texts, keeping what was judged correct."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.validators import canonical_label, mentions_birth, validate_extracted
from ..sources.rules import Rules
from .overlap import first_come, greedy, overlap_groups


def without_fences(raw: Column) -> Column:
    """A model's answer without code fences, wherever they stand."""
    return F.regexp_replace(raw, r"```(?:[A-Za-z]+(?=[\s{\[]))?", "")


def parse_model_json(raw: Column) -> Column:
    """map<label, values> from a model's answer: the object from its first brace to its last, with or without fences and words around.

    Each label is read by itself: a bare string or number is a list of one, null is none, and what is no list of values gives that
    label no values.  An answer without a readable object is an empty map.
    """
    none = F.array().cast("array<string>")
    body = F.regexp_extract(without_fences(raw), r"(?s)\{.*\}", 0)

    def values(v: Column) -> Column:
        nested = F.ltrim(v).rlike(r"^[\[{]")
        return F.when(v.isNull(), none).when(nested, F.coalesce(F.from_json(v, "array<string>"), F.when(F.ltrim(v).startswith("{"), none).otherwise(F.array(v)))).otherwise(F.array(v))

    read = F.from_json(body, "map<string,string>")
    return F.coalesce(F.transform_values(read, lambda _, v: F.filter(values(v), lambda x: x.isNotNull())), F.create_map().cast("map<string,array<string>>"))


def merge_verdicts(raw: Column) -> Column:
    """map<entity, verdict> from a JSON object or a list of such objects, of which the last wins."""
    many = F.from_json(raw, "array<map<string,string>>")
    single = F.array(F.from_json(raw, "map<string,string>"))
    listed = F.when(F.ltrim(raw).startswith("["), many).otherwise(single)
    entries = F.flatten(F.transform(F.filter(listed, lambda m: m.isNotNull()), F.map_entries))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def listed_values(answers: DataFrame, map_col: str = "answer", id_col: str = "doc_id") -> DataFrame:
    """(id, label, pos, value) of every value in a map of lists, in the order of the map and its lists."""
    labels = answers.select(id_col, F.posexplode(F.map_entries(map_col)).alias("label_pos", "e"))
    return labels.select(id_col, "label_pos", F.col("e.key").alias("label"), F.posexplode("e.value").alias("pos", "value"))


def map_values(docs: DataFrame, values: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", score: float = 0.8) -> DataFrame:
    """(id, entity_type, start, end, score): each value's first occurrence, in list order, unless it overlaps one before.

    Labels are the rules' output keys; blank values and those that don't occur are skipped.
    """
    keys = {(r.output_key or r.entity.replace("-", "_").upper()): r.entity for r in rules.enabled()}
    entity = F.element_at(F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]), F.col("label"))
    wanted = values.withColumn("entity_type", entity).where(F.col("entity_type").isNotNull() & (F.trim("value") != ""))
    # A document's values meet its text once, as one row.
    listed = wanted.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("label_pos", "pos", "entity_type", "value"))).alias("wanted"))
    text = F.col(text_col)
    place = F.transform("wanted", lambda v: F.struct((F.instr(text, v["value"]) - 1).alias("start"), F.length(v["value"]).alias("length"), v["entity_type"].alias("entity_type")))
    found = F.transform(F.filter(place, lambda p: p["start"] >= 0), lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["length"]).alias("end"), p["entity_type"].alias("entity_type")))
    rows = listed.join(docs.select(id_col, text_col), id_col).select(id_col, F.explode_outer(first_come(found)).alias("s")).where("s is not null")
    return rows.select(id_col, "s.entity_type", "s.start", "s.end", F.lit(score).alias("score"))


class _Folded(dict):
    """Each character as matching in any case sees it; none becomes two, so that places stay."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper() if len(c.upper()) == 1 else c
        low = "i" if c == "\u0130" else up.lower()
        self[code] = ord(low) if len(low) == 1 else ord(up)
        return self[code]


_FOLD = _Folded()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


def choices_in(text: str, phrase: str, present: dict[str, bool]) -> list[str]:
    """The choices of a phrase's words in their order that a folded text holds, however many words there are.

    A choice can only stand in the text if it does so without its last word, so choices grow word by word from those found;
    ``present`` says which of the words the text holds.
    """
    found: dict[str, None] = {}
    for word in phrase.split():
        if present[folded(word)]:
            grown = [word, *(f"{c} {word}" for c in found)]
            found.update(dict.fromkeys(g for g in grown if g == word or folded(g) in text))
    return list(found)


def occurrences(text: str, forms: list[str]) -> list[list[int]]:
    """Starts of each of some forms in a text, in any case, left to right without overlaps of its own, in one pass over the text."""
    wanted: dict[str, list[int]] = {}
    for k, form in enumerate(forms):
        if form:
            wanted.setdefault(folded(form), []).append(k)
    out: list[list[int]] = [[] for _ in forms]
    if not wanted:
        return out
    automaton = ahocorasick.Automaton()
    for form, numbers in wanted.items():
        automaton.add_word(form, (len(form), numbers))
    automaton.make_automaton()
    for last, (size, numbers) in automaton.iter(folded(text)):
        start = last - size + 1
        for k in numbers:
            if not out[k] or out[k][-1] + size <= start:
                out[k].append(start)
    return out


def _held_words(text: str, phrases: list[str]) -> dict[str, bool]:
    """Which of the folded words of some phrases a folded text holds."""
    present = {folded(w): False for p in phrases for w in p.split()}
    if present:
        automaton = ahocorasick.Automaton()
        for word in present:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for _, word in automaton.iter(text):
            present[word] = True
    return present


#: Places held as Python objects before they become Arrow.
HELD = 10_000
PLACE = "struct<label:string, start:int, `end`:int, extracted_text:string>"


def _places_of(text: str, values: list[str], labels: list[str]) -> list[dict]:
    low = folded(text)
    present = _held_words(low, [v for v, label in zip(values, labels, strict=True) if label == "name"])
    each = ((label, f) for v, label in zip(values, labels, strict=True) for f in (choices_in(low, v, present) if label == "name" else [v]))
    forms = list(dict.fromkeys((label, f) for label, f in each if len(f) > 2))
    found = occurrences(text, [f for _, f in forms])
    places = dict.fromkeys((label, start, start + len(f)) for (label, f), starts in zip(forms, found, strict=True) for start in starts)
    return [{"label": label, "start": a, "end": b, "extracted_text": text[a:b]} for label, a, b in places]


def arrow_places(texts: pa.Array, values: pa.Array, labels: pa.Array) -> pa.Array:
    """Places of a batch.  Rows are read one by one and places leave Python's objects every HELD, so what is held besides Arrow's own does not grow with the batch."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("extracted_text", pa.string())]))
    done, block, held = [], [], 0
    for row in zip(texts, values, labels, strict=True):
        text, wanted, named = (x.as_py() for x in row)
        block.append(_places_of(text, wanted, named) if text and wanted else [])
        held += len(block[-1])
        if held >= HELD:
            done.append(pa.array(block, kind))
            block, held = [], 0
    return pa.concat_arrays([*done, pa.array(block, kind)])


def value_places(text: Column, values: Column, labels: Column) -> Column:
    """array<PLACE>, each once: where the values of an array stand in the text, in any case; of a name, every choice of its words.

    An automaton of all forms passes over a text once, however many values it is asked for.
    """

    @F.arrow_udf(f"array<{PLACE}>")
    def places(texts: pa.Array, values: pa.Array, labels: pa.Array) -> pa.Array:
        return arrow_places(texts, values, labels)

    return places(text, values, labels)


def match_values(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, start, end, extracted_text): all valid occurrences of the values of known labels, none overlapping within a label.

    Names of any length also match by subsequences of their words, longest first.  A document's values meet its text once, as an
    array, and one pass of an automaton over the text finds them all.
    """
    known = values.withColumn("canonical", canonical_label(F.col("label"))).where(F.col("canonical").isNotNull() & (F.length("value") > 2))
    listed = known.groupBy(id_col).agg(F.collect_set(F.struct("canonical", "value")).alias("wanted"))
    text = F.col("text")

    def kept(every: Column) -> Column:
        # Longer forms come before shorter ones, as they are tried first.
        rank = lambda s, i: F.struct((s["start"] - s["end"]).alias("n"), s["start"].alias("start"), s["end"].alias("end"))
        labels = F.array_distinct(F.transform(every, lambda s: s["label"]))
        return F.flatten(F.transform(labels, lambda label: greedy(F.filter(every, lambda s: s["label"] == label), rank)))

    rows = listed.join(docs.select(id_col, F.col(text_col).alias("text")), id_col)
    placed = rows.withColumn("__places", value_places(text, F.transform("wanted", lambda v: v["value"]), F.transform("wanted", lambda v: v["canonical"])))
    fine = lambda born: let(F.filter("__places", lambda s: validate_extracted(s["label"], s["extracted_text"], text, born)), kept)
    each = placed.select(id_col, F.explode_outer(let(mentions_birth(text), fine)).alias("s")).where("s is not null")
    return each.select(id_col, "s.label", "s.start", "s.end", F.trim("s.extracted_text").alias("extracted_text"))


#: Words of a phrase whose choices one row may list; 2**n - 1 choices come of n words.
LISTED = 16
#: Choices, as a power of two, that one row of listed_choices() lists.
RANGE = 12


def _words(phrase: Column) -> Column:
    return F.filter(F.split(F.trim(phrase), r"\s+"), lambda w: w != "")


def _choice(words: Column, mask: Column) -> Column:
    """The words whose bits of the mask are set; F.pmod(mask div 2**i, 2) is the i-th bit from the right."""
    return F.array_join(F.filter(words, lambda w, i: F.pmod(F.floor(mask / F.pow(F.lit(2), i)), F.lit(2)) == 1), " ")


def name_subsequences(phrase: Column, most: int = LISTED) -> Column:
    """All choices of a phrase's words in their order, longest first; a phrase of more than ``most`` words gives the whole one only.

    listed_choices() lists those of longer phrases, and match_values() finds them in texts without a list.
    """
    words = _words(phrase)
    n = F.least(F.size(words), F.lit(most))
    masks = F.sequence(F.lit(1).cast("long"), F.greatest(F.pow(F.lit(2), n).cast("long") - 1, F.lit(1).cast("long")))
    choices = F.array_distinct(F.transform(masks, lambda mask: _choice(words, mask)))
    ordered = F.transform(F.array_sort(F.transform(choices, lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c")))), lambda s: s["c"])
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) > most, F.array(F.array_join(words, " "))).otherwise(ordered)


def listed_choices(df: DataFrame, phrase_col: str, name: str = "choice", most: int = 40) -> DataFrame:
    """A row of df for every different choice of its phrase's words in their order, whatever their number up to ``most``.

    Choices are numbered; ranges of numbers are dealt out as rows, so a long phrase is listed by many tasks and none holds more than
    2**RANGE choices at once.  Only where a word stands twice do choices repeat, and only there they are made distinct.
    A phrase of more words raises an error: its choices could not be stored.
    """
    words = _words(F.col(phrase_col))
    held = df.select("*", F.explode(F.array(words)).alias("__words")).withColumn("__nr", F.monotonically_increasing_id())
    n = F.size("__words")
    last = F.when(n > most, F.raise_error(F.concat(F.lit("a phrase of "), n.cast("string"), F.lit(" words has too many choices"))).cast("long")).otherwise(F.pow(F.lit(2), n).cast("long") - 1)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor(last / 2**RANGE).cast("long"))
    ranges = held.where(n > 0).withColumn("__last", last).select("*", F.explode(blocks).alias("__block"))
    # A number of partitions that is named stays: rows are few and small before they are exploded.
    ranges = ranges.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__nr", "__block")
    first = F.greatest(F.col("__block") * 2**RANGE, F.lit(1).cast("long"))
    masks = F.sequence(first, F.least((F.col("__block") + 1) * 2**RANGE - 1, F.col("__last")))
    each = ranges.select(*df.columns, "__nr", (F.size(F.array_distinct("__words")) < n).alias("__repeats"), F.explode(F.transform(masks, lambda mask: _choice(F.col("__words"), mask))).alias(name))
    once = each.where("NOT __repeats").unionByName(each.where("__repeats").dropDuplicates(["__nr", name]))
    return once.drop("__nr", "__repeats")


def judged(spans: DataFrame, verdicts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans that overlap no other, and of those that do the ones judged correct by (id, entity_type, verdict), each once."""
    grouped = overlap_groups(spans, id_col)
    size = F.count(F.lit(1)).over(Window.partitionBy(id_col, "overlap_group"))
    grouped = grouped.withColumn("group_size", size)
    right = verdicts.where(F.lower("verdict") == "correct").select(id_col, "entity_type").distinct()
    alone = grouped.where("group_size = 1")
    return alone.unionByName(grouped.where("group_size > 1").join(right, [id_col, "entity_type"], "left_semi")).drop("overlap_group", "group_size")

