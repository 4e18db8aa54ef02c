"""Spelling variants: forward and backward minimal automata with word numbers find all words at one error."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences of a word, at least; of so many occurrences, about, one loses a code point.
LETTERS, OCCURRENCES, SLIPS = 5, 3, 97
#: Words with one half in common that one automaton holds; more are dealt over several.
HELD = 20_000
#: Entries of a task, about.
TASK_ENTRIES = 200_000

FOUND = "word string, n long, n_near long, best_n long, best string"


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; it numbers them in their order."""

    def __init__(self, words: list[str]):
        known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.sizes: list[int] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]  # states along the last word, not yet minimal
        before = ""
        for word in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            self._close(path, before, same, known)
            path += [(False, {}) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            before = word
        self._close(path, before, 0, known)
        self.start = self._state(path[0], known)

    def _close(self, path: list, word: str, keep: int, known: dict) -> None:
        while len(path) > keep + 1:
            path[-2][1][word[len(path) - 2]] = self._state(path[-1], known)
            path.pop()

    def _state(self, state: tuple[bool, dict[str, int]], known: dict) -> int:
        """The number of a state with this future; a new one if there is none yet."""
        key = (state[0], *state[1].items())
        if key not in known:
            known[key] = len(self.final)
            skipped, edges = int(state[0]), {}
            for c, to in state[1].items():  # words come sorted, and so do the letters
                edges[c] = (to, skipped)
                skipped += self.sizes[to]
            self.final.append(state[0])
            self.edges.append(edges)
            self.sizes.append(skipped)
        return known[key]

    def number(self, state: int, passed: int, rest: str) -> int | None:
        """The number of the word that ``rest`` completes from a state; ``passed`` words come before those of the state."""
        for c in rest:
            step = self.edges[state].get(c)
            if step is None:
                return None
            state, passed = step[0], passed + step[1]
        return passed if self.final[state] else None

    def one_error(self, word: str, replace: bool, insert: bool, delete: bool) -> Iterator[int]:
        """Numbers of the words that one replaced, inserted or deleted letter makes of ``word``, each once."""
        state, passed, size = self.start, 0, len(word)
        for i in range(size + 1):
            c, edges = word[i : i + 1], self.edges[state]
            tried = []
            if replace and c:
                tried += [(to, passed + k, i + 1) for d, (to, k) in edges.items() if d != c]
            if insert:  # before an equal letter is as good as after it
                tried += [(to, passed + k, i) for d, (to, k) in edges.items() if d != c]
            if delete and c and word[i + 1 : i + 2] != c:  # of equal letters the last
                tried.append((state, passed, i + 1))
            for at, before, j in tried:
                n = self.number(at, before, word[j:])
                if n is not None:
                    yield n
            if c not in edges:
                return
            state, passed = edges[c][0], passed + edges[c][1]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): runs of Latin letters, only A-Z lower-cased, of at least so many letters and occurrences.

    With ``slips``, an occurrence loses a letter where that divides the checksum of id and run.
    """
    low = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(low, "[^a-zÀ-ÿ]+")).alias("run"))
    runs = runs.where(F.length("run") >= letters)
    if slips:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        runs = runs.select(F.when(h % slips == 0, cut).otherwise(F.col("run")).alias("run")).where(F.length("run") >= letters)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def _entries(words: DataFrame) -> DataFrame:
    """(key, word, n, rest): every word under its halves.  Of two words at one error the shorter's half, m // 2 of m letters, is in common
    at the beginning or the end; so a word takes part with halves for its own length and for one letter less."""
    size, word = F.length("word"), F.col("word")
    halves = F.array_distinct(F.array(F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")))
    ahead = lambda p: F.struct(F.concat(F.lit(">"), F.left(word, p)).alias("key"), F.substring(word, p + 1, size).alias("rest"))
    back = lambda p: F.struct(F.concat(F.lit("<"), F.right(word, p)).alias("key"), F.reverse(F.left(word, size - p)).alias("rest"))
    sides = F.concat(F.transform(halves, ahead), F.transform(halves, back))
    return words.select("word", "n", F.explode(sides).alias("e")).select("e.key", "word", "n", "e.rest")


def _dealt(entries: DataFrame, held: int) -> DataFrame:
    """Adds shard and listed: words of a half that too many share are listed in one of several shards and asked in all of them."""
    hot = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > held)
    shards = hot.select("key", F.ceil(F.col("members") / held).cast("int").alias("shards"))
    own: Column = F.pmod(F.xxhash64("word"), F.coalesce("shards", F.lit(1))).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("shard")
    return entries.join(shards, "key", "left").select("key", "word", "n", "rest", own.alias("own"), each).select("key", "shard", (F.col("own") == F.col("shard")).alias("listed"), "rest", "word", "n")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each word finds in the automaton of its half: rows come by half and shard, those listed first, in order of the rest."""
    group, rests, words, counts, built, out = None, [], [], [], None, []

    def asked(key: str, rest: str, word: str, n: int) -> None:
        nonlocal built
        if len(words) < 2 and (not words or words[0] == word):
            return
        if built is None:
            built = Automaton(rests)
        half, size, ahead = len(key) - 1, len(word), key[0] == ">"
        found, best = 0, None
        equal, shorter = half == size // 2, half == (size - 1) // 2
        for k in built.one_error(rest, equal, equal, shorter):
            other = words[k]
            both = min(size, len(other)) // 2
            if not ahead and other[:both] == word[:both]:
                continue  # found from the front
            found += 1
            best = min(best or (0, ""), (-counts[k], other))
        if found:
            out.append((word, n, found, -best[0], best[1]))

    def finish() -> None:
        for row in zip(rests, words, counts, strict=True):
            asked(group[0], *row)

    def drained() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 5
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["word", "n", "n_near", "best_n", "best"])

    for batch in batches:
        for key, shard, listed, rest, word, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (key, shard) != group:
                finish()
                group, rests, words, counts, built = (key, shard), [], [], [], None
            if listed:
                rests.append(rest)
                words.append(word)
                counts.append(n)
            else:
                asked(key, rest, word, n)
        yield drained()
    finish()
    yield drained()


def near_words(words: DataFrame, held: int = HELD) -> DataFrame:
    """(word, n, n_near, form, form_n) of the words (word, n) that have words at one error; form is the most frequent of these.

    Words meet by an equal half.  The automaton of each half, forward for beginnings and backward for ends, holds at most about
    ``held`` words, and questions stream past it.  A pair that agrees in both halves counts forward only.
    """
    entries = _dealt(_entries(words), held)
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.count() // TASK_ENTRIES)
    sorted_entries = entries.repartition(tasks, "key", "shard").sortWithinPartitions("key", "shard", F.desc("listed"), "rest")
    found = sorted_entries.mapInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("form"))).alias("b")
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", "b.form", (-F.col("b.down")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way over forms (word, form), whose counts double at least, so that few rounds suffice."""
    step = written(forms.select("word", F.col("form").alias("root")))
    while True:
        up = step.select(F.col("word").alias("up"), F.col("root").alias("up_root"))
        after = written(step.join(up, F.col("root") == F.col("up"), "left").select("word", F.coalesce("up_root", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        drop(step)
        step = after
        if step.where("moved").isEmpty():
            return step.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = SLIPS, held: int = HELD, **least: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    ``form`` is the near word of largest n, of equal ones the first in code-point order, if it is at least twice as frequent; else
    form and form_n are null and the root is the word.  Null and empty texts have no words; a null id counts as an empty one.
    Repeated rows count as often as they occur; texts are read whole; other columns are not read.  An empty table gives an empty result.
    """
    words = written(vocabulary(docs, id_col, text_col, slips, **least))
    near = written(near_words(words, held))
    form = F.col("form_n") >= 2 * F.col("n")
    chosen = near.select("word", "n_near", F.when(form, F.col("form")).alias("form"), F.when(form, F.col("form_n")).alias("form_n"))
    ends = roots(chosen.where("form is not null"))
    out = words.join(chosen, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
