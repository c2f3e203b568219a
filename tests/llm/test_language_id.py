import base64
import itertools
import random
import string
import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from panelweave.llm import language_id
from tests.llm.rows import ODD, odd, table


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    scores, transitions = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    offsets = np.asarray([0, 6, 7])
    got, _, _ = language_id.forward_backward(scores, offsets, transitions)
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        total = np.zeros((high - low, 3))
        for path in itertools.product(range(3), repeat=high - low):
            start = np.log(np.mean(np.exp(transitions[:, path[0]])))
            weight = start + sum(scores[low + i, k] for i, k in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False))
            for i, k in enumerate(path):
                total[i, k] += np.exp(weight)
        np.testing.assert_allclose(got[low:high], total / total.sum(axis=1, keepdims=True), atol=1e-12)


def test_long_sequences_match_plain_recursion():
    rng = np.random.default_rng(4)
    scores, transitions = rng.normal(size=(500, 4)) * 5, rng.normal(size=(4, 4))
    offsets = np.asarray([0, 333, 334, 434, 500])
    got, _, _ = language_id.forward_backward(scores, offsets, transitions)
    step, x = np.exp(transitions), np.exp(scores)
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        a, b = np.empty((high - low, 4)), np.ones((high - low, 4))
        v = np.full(4, 0.25)
        for i in range(high - low):
            v = (v @ step) * x[low + i]
            v = a[i] = v / v.sum()
        for i in range(high - low - 2, -1, -1):
            w = step @ (x[low + i + 1] * b[i + 1])
            b[i] = w / w.sum()
        want = a * b
        np.testing.assert_allclose(got[low:high], want / want.sum(axis=1, keepdims=True), atol=1e-9)


def test_held_out_accuracy(spark):
    docs = table(spark, "0.01")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0.0 <= r["score"] <= 1.0
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_switching_text_is_split():
    english = ["the house and the garden of the people are here with that"] * 20
    german = ["der hund und die katze sind nicht auf dem tisch mit einer"] * 20
    model = language_id.fit({"en": english, "de": german})
    marginals, starts = language_id.label_batch(model, pa.array(["the garden of the people und die katze sind nicht"]))
    names = [model.languages[k] for k in marginals.argmax(axis=1)]
    assert starts.tolist() == [0, 10]
    assert names == ["en"] * 5 + ["de"] * 5


def test_awkward_rows(spark):
    df = odd(spark)
    got = language_id.identify(df).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 11):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["n_words"]) == ("und", 0.0, 0)
    assert by_id[8]["n_words"] == 40_000  # letters between the digits
    kept = language_id.known_language(df, least_score=0.0)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["lang_pred"] != "und")
    runs = language_id.runs_of_language(df).collect()
    assert sum(x["words"] for r in runs for x in r["runs"]) == sum(r["n_words"] for r in got)


def test_nothing_to_learn_from(spark):
    assert language_id.identify(table(spark).limit(0)).collect() == []
    unlabelled = table(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_unknown_text_is_rejected_whatever_the_number_of_languages(spark):
    docs = table(spark, "0.01").filter("lang is not null and length(text) between 200 and 20000")
    by_language = {}
    for r in docs.orderBy("doc_id").collect():
        by_language.setdefault(r["lang"], []).append(r["text"])
    rng = random.Random(3)
    unknown = [
        " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 11))) for _ in range(80)),
        base64.b64encode(rng.randbytes(900)).decode(),
        "Suomen kieli on uralilaisten kielten ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset. Ystäväni asuvat kaukana kylässä.",
        "Русский язык является одним из крупнейших языков мира и широко распространён.",
    ]
    for names in (["en"], ["en", "fr"], sorted(by_language)):
        model = language_id.fit({name: by_language[name][:40] for name in names})
        clean = [by_language[name][k] for name in names for k in range(40, 50)]
        mixed = ["\n".join(rng.choice(rng.choice(by_language[name][40:50]).split("\n")) for name in names * 4) for _ in range(10)]
        rows = [(i, t, "kept" if i >= len(unknown) else "gone") for i, t in enumerate(unknown + clean + mixed)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert {r["doc_id"] for r in language_id.known_language(frame, model=model).collect()} == {r[0] for r in rows if r[2] == "kept"}


def test_chains_against_plain_counts():
    samples = [["the then that", "a tee"], ["der die das", "a"]]
    chains = language_id.fit_chains(samples)
    words = ["the", "die", "a", "tha", "zzz", "dat", "e", "thé"]
    got = language_id.known(chains, pa.array(words))
    split = [[f"\x00\x02{w}\x03" for text in texts for w in text.split()] for texts in samples]
    everything = [c for texts in split for w in texts for c in w[2:]]
    for k, texts in enumerate(split):

        def after(letter, before, texts=texts):
            if not before:
                return everything.count(letter) / len(everything) if letter in everything else 1e-9
            seen = [w[i] for w in texts for i in range(2, len(w)) if w[:i].endswith(before)]
            kinds, lower = len(set(seen)), after(letter, before[1:])
            return (seen.count(letter) + kinds * lower) / (len(seen) + kinds) if seen else lower

        for i, word in enumerate(words):
            w, ratio = f"\x00\x02{word}\x03", 1.0
            for j in range(2, len(w)):
                ratio *= after(w[j], w[j - 2 : j]) / after(w[j], "")
            assert abs(got[i, k] - ratio / (1 + ratio)) < 1e-6, (word, k)


def test_language_of_long_documents_only_is_learned(spark):
    rng = random.Random(4)
    english, german = "the house garden people here with that water".split(), "der hund und die katze nicht tisch einer".split()
    finnish = "suomen kieli ystäväni kylässä koulussa kirjaa mielelläni päivä".split()

    def text(words, chars, mark):
        made = " ".join(rng.choice(words) for _ in range(chars // 5))
        return mark.join(made[i : i + 60] for i in range(0, len(made), 60)) if mark else made

    rows = [(i, text(english, 400, "\n"), "en") for i in range(40)] + [(100 + i, text(german, 400, "\n"), "de") for i in range(40)]
    rows += [(200 + i, text(finnish, 30_000, ("\n", "", " ")[i % 3]), "fi") for i in range(12)] + [(300, text(finnish, 90_000, "").replace(" ", " "), "fi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] > 0.5 for i, _, lang in rows)
    spaced = docs.filter("lang = 'fi'").withColumn("block", language_id._block_of_lines()).collect()
    for r in spaced:
        assert r["block"] in r["text"] and language_id.SAMPLE_CHARS // 2 <= len(r["block"]) <= language_id.SAMPLE_CHARS
        if r["doc_id"] < 300 and r["doc_id"] % 3 == 2:
            assert set(r["block"].split("\n")) <= set(r["text"].split("\n"))


def test_junk_labels_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 4)
    df = table(spark, "0.01")
    junk = df.limit(40).withColumn("lang", F.concat(F.lit("zz"), F.col("doc_id").cast("string")))
    model = language_id.train(df.unionByName(junk))
    assert sorted(model.languages) == ["de", "en", "es", "fr"]
