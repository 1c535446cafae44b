import random
import zlib

import pytest

from auditweave.llm import language

WORDS = {"en": "the of and that with from have which their would", "de": "der und die nicht mit sich auch wird einer für",
    "fr": "les des est dans pour que une avec sont pas"}
LICENCE = "this work is licensed under the public licence"
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, lang, n):
    words = WORDS[lang].split()
    return " ".join(rng.choice(words) + rng.choice(["", "", words[0][:2], ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(list(WORDS)), rng.choice([3, 30, 300])), lang, "s") for i in range(400)]
    rows += [(1000 + i, LICENCE + " " + prose(rng, "de", 20), "de", "s") for i in range(30)]
    rows += [(2000, None, "en", "s"), (2001, "", "de", "s"), (2002, "12 34 !?", "fr", "s"), (2003, "the and of that which " * 30000, None, "s"),
        (None, "und die nicht", "de", "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


def test_held_out_accuracy(docs, model):
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    langs = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 1100}
    held = [i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values() if r.doc_id in langs) == len(held)
    assert sum(got[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_defined_results(docs, model):
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (2000, 2001, 2002))
    assert got[2003].lang_pred == "en" and not got[2003].rejected
    assert got[None].lang_pred == "de" and got[None].held_out is False


def test_the_sample_doesnt_depend_on_partitions_or_held_out_rows(docs, model):
    assert language.train(docs.repartition(2)) == model
    assert language.train(docs.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) != 2")) == model


def test_shared_passages_are_kept_out(model):
    assert LICENCE.encode() not in model.dictionaries[model.languages.index("de")][: language.DICTIONARY // 8]
    cut = language.unshared({"a": [f"{LICENCE} one two", f"{LICENCE} three"], "b": ["four five six seven eight"]})
    assert cut["a"][:2] == ["one two", "three"] and cut["b"][0] == "four five six seven eight"


def test_narrow_margins_are_rejected(spark, model):
    mixed = spark.createDataFrame([(1, "of und", "en", "s"), (2, "the and of that with which their would have from the", "en", "s")], SCHEMA)
    got = {r.doc_id: r for r in language.identify(mixed, model, margin=0.2, reject=True).collect()}
    assert got[1].rejected and got[1].lang_pred == "und" and got[2].lang_pred == "en"


def test_late_parts_of_a_long_text_count(spark, model):
    rng = random.Random(4)
    text = prose(rng, "en", 50) + " " + prose(rng, "fr", 4000)
    got = language.identify(spark.createDataFrame([(1, text, None, None)], SCHEMA), model).first()
    assert got.lang_pred == "fr"


def test_nothing_learned_and_empty(spark):
    none = language.train(spark.createDataFrame([(1, "the of", None, "s")], SCHEMA))
    assert none.languages == ()
    assert language.identify(spark.createDataFrame([(1, "the of", None, "s")], SCHEMA), none).first().lang_pred == "und"
    one = language.train(spark.createDataFrame([(1, "the of and that", "en", "s")] * 50, SCHEMA))
    assert language.identify(spark.createDataFrame([], SCHEMA), one).collect() == []
