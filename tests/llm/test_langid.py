import random
import zlib

from quillstream.llm import langid

VOWELS = {"aa": "aeo", "bb": "iuy", "cc": "äöü"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice("bdklmnrst") + rng.choice(VOWELS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(documents):
    rng = random.Random(0)
    rows = [(i, text(rng, lang, rng.randrange(3, 60)), lang, "a") for i, lang in ((i, rng.choice(list(VOWELS))) for i in range(400))]
    out = {r.doc_id: r for r in langid.identify_by_own_labels(documents(rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(out[r[0]].held_out for r in held) and sum(r.held_out for r in out.values()) == len(held)
    assert sum(out[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out.values())


def test_held_out_labels_are_never_learned(documents):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "mot inconnu", "zz" if i in held else "aa", "a") for i in range(100)]
    assert {r.lang_pred for r in langid.identify_by_own_labels(documents(rows)).collect()} == {"aa"}


def test_words_come_before_shorter_n_grams(spark):
    rows = [(i, "kata bunga" if i % 2 else "wort blume", "id" if i % 2 else "de") for i in range(40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    de, id_ = model.languages.index("de"), model.languages.index("id")
    assert model.word("kata")[id_] > model.word("kata")[de]  # known
    assert model.word("katas")[id_] > model.word("katas")[de]  # by n-grams
    assert model.word("жж").tolist() == [0.0, 0.0]  # nothing of it is known


def test_awkward_rows_and_nothing_to_learn(documents, awkward):
    out = langid.identify_by_own_labels(documents(awkward), keep=("text", "spans")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(awkward)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 4)) and by[5].lang_pred != "und" and by[5].spans == "s"
    assert langid.identify_by_own_labels(documents([])).count() == 0
    nothing = [(r[0], r[1], None, "a") for r in awkward]
    assert {r.lang_pred for r in langid.identify_by_own_labels(documents(nothing)).collect()} == {"und"}
    numerals = langid.identify_by_own_labels(documents([(i, "abc", "en", "a") for i in range(9)] + [(50, "² ½ Ⅷ 12", "en", "a")])).collect()
    assert {r.doc_id: r.lang_pred for r in numerals}[50] == "und"
