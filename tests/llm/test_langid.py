import re
import zlib
from collections import Counter

import numpy as np

from veilspan.llm import langid as lid


def test_odd_rows(odd, odd_rows):
    got = lid.identify(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {4, 5, 6, 11, None}
    stays = lid.identified_documents(odd)
    assert stays.columns == odd.columns and stays.count() == sum(r["lang_pred"] != "und" for r in got)


def test_empty_table(none):
    assert lid.identify(none).collect() == []
    assert lid.identified_documents(none).collect() == []


def test_distance_by_hand():
    model = lid.Profiles({"x": np.array([5, 9, 7]), "y": np.array([9, 8, 1])}, ranks=3)
    assert model.distances(np.array([9, 5, 2])).tolist() == [1 + 1 + 3, 0 + 3 + 3]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98


def test_labels_of_held_out_rows_are_not_used(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(lid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(lid.identify(docs).collect()) == sorted(lid.identify(spoiled).collect())


def brute_grams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    counts = Counter(g for w in words for g in [*w, *(f" {w} "[i : i + 2] for i in range(len(w) + 1)), *(f" {w} "[i : i + 3] for i in range(len(w)))])
    return counts


def test_predictions_against_brute_force(spark):
    """Profiles, ranks, distances and scores of the whole table again, from counts of strings."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    ranked = lambda counts, n: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:n]]
    sums = {}
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            sums.setdefault(r["lang"], Counter()).update(brute_grams(r["text"]))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c, 300))} for lang, c in sorted(sums.items())}
    got = {r["doc_id"]: r for r in lid.identify(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    for r in docs:
        top = ranked(brute_grams(r["text"] or ""), 300)
        far = {lang: sum(abs(place[g] - i) if g in place else 300 for i, g in enumerate(top)) for lang, place in profiles.items()}
        if not top:
            want = ("und", 0.0)
        else:
            best = min(far, key=lambda lang: (far[lang], lang))
            want = (best, max(0.0, 1 - far[best] / (300 * len(top))))
        assert (got[r["doc_id"]]["lang_pred"], round(got[r["doc_id"]]["score"], 9)) == (want[0], round(want[1], 9))


def test_texts_without_a_letter_and_ties():
    model = lid.Profiles({"b": np.array([1, 2]), "a": np.array([1, 2])}, ranks=3)
    assert model.predict("½²Ⅷ 12 !!") == ("und", 0.0) and model.predict(None) == ("und", 0.0)
    assert lid.Profiles({"a": lid.top_grams("aa"), "b": lid.top_grams("aa")}).predict("aa ½")[0] == "a"
