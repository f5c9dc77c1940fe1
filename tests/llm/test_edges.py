"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planline.llm import decontaminate, fingerprint, jaccard_join, language, language_model, mixing, private_data, suffix_dedup, token_files, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_language(spark, odd, empty):
    assert language.identify(odd, {}).where("lang_pred <> 'und' or score <> 0").count() == 0
    profiles = language.train_profiles(odd)
    out = language.identify(odd, profiles)
    assert ids(out) == ids(odd)
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[5].lang_pred == "en" and 0 <= by[1].score <= 1
    assert language.train_profiles(empty) == {} and language.identify(empty, profiles).count() == 0


def test_dedup(spark, odd, empty):
    out = suffix_dedup.remove_repeats(odd)
    assert ids(out) == ids(odd)
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].n_bytes == by[3].n_bytes == 0 and by[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[6].n_removed == 200_000 and by[5].n_removed >= 200_000 and by[1].n_removed == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_private_data(spark, odd, empty):
    out = private_data.pseudonyms(odd, b"key")
    by = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ids(odd) and by[2].text is None and by[3].text == "" and by[7].counts == {"email": 1}
    assert "a.b@c.example.org" not in by[7].text and by[7].text.endswith(".org")
    assert private_data.pseudonyms(empty, b"key").count() == 0


def test_decontaminate(spark, odd, empty):
    items = spark.createDataFrame([(1, "quick BROWN fox"), (1, "quick BROWN fox"), (2, None), (3, ""), (None, "lazy dog"), (4, "one")], "item_id long, text string")
    out = decontaminate.decontaminate(odd, items)
    assert ids(out) == ids(odd)
    by = {r.doc_id: r for r in out.collect()}
    assert (by[1].n_hit, by[1].n_items, by[1].contaminated) == (5, 1, True)
    assert by[1].items_sha256 == hashlib.sha256(b"1").hexdigest() and by[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[2].n_words == 0 and not by[2].contaminated and by[8].n_items == 1
    wide = decontaminate.decontaminate(odd, items, broadcast_windows=0)
    assert sorted(map(str, wide.collect())) == sorted(map(str, out.collect()))
    assert decontaminate.decontaminate(odd, items.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.decontaminate(empty, items).count() == 0


def test_toxicity(spark, odd, empty):
    none = toxicity.score(odd, toxicity.Lexicon({}))
    assert ids(none) == ids(odd) and none.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.train(empty.withColumn("toxic", F.lit(1))).weights == {}
    lexicon = toxicity.Lexicon({" idiot ": 5.0}, ("no idiot",), (-4.0, 3.0, 0.5))
    say = lexicon.score
    assert say("you 1d10t") > 0.3 and say("you іdiоt") > 0.3 and say("no idiot here") == say(None) == say("") < 0.3


def test_fingerprint(spark, odd, empty):
    out = fingerprint.fingerprint_neighbours(odd)
    assert ids(out) == ids(odd)
    rows = out.collect()
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert all(0 <= v <= 1 for r in rows for v in (r.near_edited, r.near_next))
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == "" and by[8].near_edited < 1 and by[9].near_next == 1
    assert fingerprint.fingerprint_neighbours(empty).count() == 0
    single = fingerprint.fingerprint_neighbours(odd.where("doc_id = 7")).first()
    assert single.near_next == 1


def test_token_files(spark, odd, empty):
    files = token_files.write_token_files(odd, PATH, block_ids=1000)
    rows = files.documents().collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = {(r.doc_id, r.text): [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd.collect()}
    crc = Counter((d, len(v), zlib.crc32(np.array(v, dtype="<u4").tobytes())) for (d, _), v in want.items())
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert set(got) == set(crc) and len(rows) == odd.count()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert token_files.write_token_files(empty, PATH).documents().count() == 0


def test_language_model(spark, odd, empty):
    model = language_model.train(odd, rounds=1)
    out = language_model.score(odd, model)
    by = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ids(odd) == ids(language_model.score_blocks(model.blocks, model))
    assert by[2].n_words == by[3].n_words == 0 and by[2].log_likelihood == 0 and by[2].mean_log_likelihood is None
    assert by[5].n_words == 60_000 and by[5].n_tokens >= 60_000 and by[5].mean_log_likelihood < 0
    assert abs(by[8].log_likelihood - by[9].log_likelihood) < 1e-4
    none = language_model.train(empty)
    assert language_model.score(odd, none).count() == odd.count() and language_model.score_blocks(none.blocks, none).count() == 0


def test_jaccard_join(spark, odd, empty):
    out = jaccard_join.jaccard_join(odd)
    assert ids(out) == ids(odd)
    by = {r.doc_id: r for r in out.collect()}
    assert by[8].class_id == by[9].class_id == 8 and by[8].n_links == 1 and by[8].n_text_links == 0
    assert by[1].class_id == by[None].class_id == 1 and by[1].n_links == 2 and by[1].n_copies == 2
    assert by[2].class_id == 2 and by[3].n_links == 0
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_mixing(spark, odd, empty):
    clash = odd.withColumn("mix_copies", F.lit("old"))
    out = mixing.mix(clash, F.lit("all"), {}, share=0.5, seed=3)
    assert ids(out) == ids(odd)
    assert out.where("mix_tokens = 0 and mix_copies > 0").count() == 0
    total = out.agg(F.sum("mix_tokens")).first()[0]
    assert out.agg(F.sum(F.col("mix_tokens") * F.col("mix_copies"))).first()[0] <= total * 0.5
    assert mixing.mix(empty, F.lit("all"), {}, share=0.5).count() == 0
