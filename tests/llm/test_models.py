"""Operators that learn: brute force for counts, held-out accuracy for models, odd input."""

import functools
import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import lang_id, lm_score, quality, sampling, store, toxicity
from quarryline.llm.store import crc32_mod


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("hot", [20, 1_000_000])
def test_base_score_by_brute_force(spark, hot):
    rows = [(1, "a b a"), (2, "A  c\nb"), (3, None), (4, ""), (5, "zz a q"), (5, "a b a"), (None, "a")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    train = F.col("doc_id").isin(1, 2, 3)
    got = lm_score.score_documents(docs, train, hot_words=hot if hot > 100 else 2, order=3).collect()
    tokens = {i: [*(t or "").lower().split(), None] for i, t in enumerate(x[1] for x in rows)}
    counts = Counter(w for i, (d, _) in enumerate(rows) if d in (1, 2, 3) for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i]), 9)) for i, (d, _) in enumerate(rows)
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 9)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score <= 0 for r in got)


def test_model_beats_the_base_on_held_out_documents(spark, sf_dir):
    out = lm_score.score_documents(documents(spark, sf_dir), crc32_mod("doc_id", 7) != 2).where("not is_train")
    r = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm_score.score_documents(docs, F.lit(False)).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    assert lm_score.score_documents(docs.limit(0), F.lit(True)).count() == 0


def model_by_brute_force(texts, train, order, base=1.5):
    """(log10 P of a text, P(word | history)) with exact counts, quantised as the filter does."""
    low, high = lm_score.level_counts(base)
    level = functools.cache(lambda c: int(lm_score.levels(np.array([c]), base)[0]))
    seqs = [[*(t or "").lower().split(), None] for t in texts]
    count = Counter()
    for i in train:
        padded = [None, *seqs[i]]
        count.update((w,) for w in seqs[i])
        for n in range(2, order + 1):
            count.update(tuple(padded[j : j + n]) for j in range(len(padded) - n + 1))
    histogram = np.zeros((order, 128), np.int64)
    for g, c in count.items():
        histogram[len(g) - 1][level(c)] += 1
    growth = [lm_score.successor_growth(histogram[n - 2], int(histogram[n - 1].sum()), high) for n in range(2, order + 1)]
    words = [g for g in count if len(g) == 1]
    mass = sum(low[level(count[g])] for g in words) + len(words) + 1

    @functools.cache
    def known(w, before):
        out = (low[level(count[(w,)])] + 1) / mass
        for n in range(2, order + 1):
            if len(before) >= n - 1:
                history = tuple(before[len(before) - n + 1 :])
                h = high[level(count[history])]
                if h:
                    t = h ** growth[n - 2]
                    out = (min(low[level(count[(*history, w)])], h) + t * out) / (h + t)
        return out

    def p(w, before):
        return known(w, tuple(before[max(len(before) - order + 1, 0) :]))

    def score(seq):
        padded = [None, *seq]
        return sum(math.log10(p(w, padded[max(j + 2 - order, 0) : j + 1])) for j, w in enumerate(seq))

    return [score(q) for q in seqs], p, [w for (w,) in words]


TEXTS = [" ".join(f"w{(i * j * j + i) % (50 + 7 * i) % 60}" for j in range(30 + i)) for i in range(60)] + [None, "", "new words here", "w1 " * 500, "x" * 3_000_000, "w3 w1 " * 200_000]


@pytest.mark.parametrize(("order", "hot_count", "most"), [(2, 8, 64 << 20), (3, 8, 64 << 20), (2, 1, 64 << 20), (2, 8, 64), (3, 10**9, 64)])
def test_score_by_brute_force(spark, order, hot_count, most):
    """Whatever is broadcast and whatever is asked, the score is that of the formula; with many bits for each entry nothing is falsely found."""
    rows = [*enumerate(TEXTS), (7, TEXTS[7])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    out = lm_score.score_documents(docs, F.col("doc_id") % 3 != 2, order=order, hot_count=hot_count, max_filter_bytes=most, bits_per_entry=64)
    got = sorted((r.doc_id, r.score) for r in out.collect())
    texts = [t for _, t in rows]
    want, p, words = model_by_brute_force(texts, [k for k, (i, _) in enumerate(rows) if i % 3 != 2], order)
    assert [i for i, _ in got] == sorted(i for i, _ in rows)
    for (i, s), (j, w) in zip(got, sorted((i, want[k]) for k, (i, _) in enumerate(rows)), strict=True):
        assert i == j and math.isclose(s, w, rel_tol=1e-9, abs_tol=1e-9)
    for before in ([None], ["w1"], ["w3"], ["w7", "w1"], ["never"]):
        assert 0 < sum(p(w, before) for w in words) + p("never seen", before) <= 1 + 1e-9
    assert math.isclose(sum(p(w, []) for w in words) + p("never seen", []), 1)


@pytest.mark.parametrize("bits_per_entry", [8, 16])
def test_filter_counts_and_false_positives(bits_per_entry):
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2))
    level = np.minimum(rng.geometric(0.5, len(h)), 20)
    bucket, key = lm_score._split(h, 2)
    shards = [(b, lm_score._bloom(key[bucket == b], level[bucket == b], bits_per_entry)) for b in range(4)]
    f = lm_score.CountFilter(shards, 2)
    read = f.levels(h)
    assert (read >= level).all()  # no false negative at any level
    rate = (1 - math.exp(-4 / bits_per_entry)) ** 4  # with 4 probes and just so many bits for each entry
    assert (read > level).mean() < 1.1 * rate
    absent = f.levels(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (absent > 0).mean() < 1.1 * rate


def test_probability_of_a_frequent_word_is_at_most_1(spark):
    docs = spark.createDataFrame([(i, " ".join(["a"] * 8)) for i in range(50)], "doc_id long, text string")
    assert all(r.score <= 0 for r in lm_score.score_documents(docs, F.lit(True)).collect())


def test_filter_holds_quantised_counts():
    low, high = lm_score.level_counts(1.5)
    counts = np.arange(5000)
    level = lm_score.levels(counts, 1.5)
    assert (low[level] <= counts).all() and (counts <= high[level]).all() and (low[level][:4] == high[level][:4]).all()


def test_language_on_held_out_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held = crc32_mod("doc_id", 4) == 2
    model = lang_id.train(docs.where(~held), id_column="doc_id", text_column="text", lang_column="lang")
    r = lang_id.identify(docs.where(held), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert r.a > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the and of " * 300_000), (4, "é")], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred if r.lang_pred == "und" else "some") for r in lang_id.identify(odd, model, keep=["doc_id"]).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "some")}


def test_language_without_languages(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = lang_id.train(docs, id_column="doc_id", text_column="text", lang_column="lang")
    assert model is None and lang_id.identify(docs, model).first().lang_pred == "und"
    one = docs.withColumn("lang", F.lit("en"))
    model = lang_id.train(one, id_column="doc_id", text_column="text", lang_column="lang")
    r = lang_id.identify(one, model).first()
    assert (r.lang_pred, r.score) == ("en", 1.0)


def test_languages_of_other_scripts_are_learned(spark):
    words = {"en": "the cat and some other words of a text", "ru": "и это слова другого текста на русском языке", "zh": "这是 一个 中文 文本 其他 的 词语"}
    rows = [(i, " ".join(w.split()[(i * j + j) % 7] for j in range(20)), lang) for i in range(40) for lang, w in words.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(docs, id_column="doc_id", text_column="text", lang_column="lang")
    assert model.labels == ["en", "ru", "zh"]
    assert all(r.lang == r.lang_pred for r in lang_id.identify(docs, model).collect())


def test_more_than_64_languages_are_learned(spark):
    rows = [(k * 3 + i, f"word{k} text of {k}", f"l{k:02}") for k in range(70) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(docs, id_column="doc_id", text_column="text", lang_column="lang")
    assert model.labels == [f"l{k:02}" for k in range(70)]


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_labels_on_held_out_documents(spark, sf_dir, module, label):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables have a handful of toxic labels
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc32_mod("doc_id", 4) == 2
    model = module.train(docs, labels.where(~held))
    out = module.score(docs.where(held), model, keep=["doc_id"]).join(labels, "doc_id")
    r = out.groupBy(F.col(label) == 1).agg(F.avg("score").alias("m")).orderBy(f"({label} = 1)").collect()
    assert r[1].m > r[0].m + 0.2
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 2_000_000), (None, "a")], "doc_id long, text string")
    assert all(0 <= x.score <= 1 for x in module.score(odd, model, keep=["doc_id"]).collect())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_kind_of_label_or_none(spark, module):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(6)], "doc_id long, text string")
    for rows, least, most in (([], 0.5, 0.5), ([(i, 1, 1) for i in range(6)], 0.6, 1.0)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        model = module.train(docs, labels)
        scores = [r.score for r in module.score(docs, model, keep=["doc_id"]).collect()]
        assert len(scores) == 6 and all(least - 1e-9 <= s <= most for s in scores)


def test_time_grows_with_the_length_of_a_word():
    import time

    m = toxicity.LetterModel(Counter({"idiot": 50, "the": 900}))
    for word in ("a" + "=" * 1_000_000 + "a", "a" + "!" * 1_000_000 + "!a", "a" + "!" * 1_000_000, "1d10t" * 40_000, "=" * 1_000_000):
        t = time.process_time()
        toxicity.readings(word, m)
        assert time.process_time() - t < 20
    t = time.process_time()
    assert len(toxicity.readings("the" * 30_000, m, spelled=True)) > 10_000 and time.process_time() - t < 20


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_repeated_rows_and_empty_tables(spark, module, label):
    texts = {0: "a fine day for you all", 1: "you are an 1d10t and a moron"}
    docs = spark.createDataFrame([(i, texts[i % 2], "clash") for i in range(20)] + [(3, texts[1], "clash")] * 3, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] * 2, "doc_id long, quality int, toxic int")
    model = module.train(docs, labels)
    got = module.score(docs, model, keep=["doc_id"]).collect()
    assert len(got) == 23 and len({r.score for r in got if r.doc_id % 2}) == 1
    assert module.score(docs.limit(0), model, keep=["doc_id"]).count() == 0
    nothing = module.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in module.score(docs, nothing, keep=["doc_id"]).collect()} == {0.5}


def test_restoring_words():
    m = toxicity.LetterModel(Counter({"idiot": 50, "moron": 40, "clown": 50, "worthless": 30, "pathetic": 40, "stupid": 30, "the": 900, "thing": 100, "attion": 50}))
    written = {"1d10t": "idiot", "id*ot": "idiot", "m0r0n!": "moron", "i.d.i.o.t": "idiot", "w0rthle$$": "worthless", "iiidiooot": "idiot", "P@thetic,": "pathetic", "THING!!": "thing", "the&&&": "the", "attion": "attion", "12.5": ""}
    assert {w: toxicity.restore(w, m) for w in written} == written
    assert "idiot" in toxicity.readings("!diot", m) and {"the", "moron"} <= set(toxicity.readings("themoron", m, spelled=True))
    got = list(toxicity.documents_words(pa.array(["you s t u p i d thing", None, ""]), lambda w: toxicity.restore(w, m)))
    assert [n for n, _, _ in got] == [8, 0, 0] and "stupid" in got[0][1]


def test_scores_do_not_depend_on_what_is_broadcast(spark, sf_dir):
    """At the default bits, false hits and all."""
    docs = documents(spark, sf_dir)
    sizes = (64, 100_000, 64 << 20)
    runs = [{r.doc_id: r.score for r in lm_score.score_documents(docs, crc32_mod("doc_id", 7) != 2, max_filter_bytes=most).collect()} for most in sizes]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == docs.count()


def test_kept_columns_may_have_any_name(spark):
    names = ["doc_id", "text", "result", "score", "__text", "c0", "c1", "text_", "lang_pred"]
    rows = [(i, ("good plain words. " if i % 2 else "shout !!! vile stuff ") * (3 + i % 5), "r", 1.5, None, "a", "b", "t", "p") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, result string, score double, __text string, c0 string, c1 string, text_ string, lang_pred string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    good, bad = quality.train(docs, labels), toxicity.train(docs, labels)
    net = lang_id.train(docs, id_column="doc_id", text_column="text", lang_column="c0")
    for out, more in ((quality.score(docs, good, keep=names), ["score_"]), (toxicity.score(docs, bad, keep=names), ["score_"]), (lang_id.identify(docs, net, keep=names), ["lang_pred_", "score_"])):
        assert out.columns == names + more
        assert {tuple(r)[: len(names)] for r in out.collect()} == set(rows)
    assert quality.score(docs, good, keep=["doc_id", "result"]).columns == ["doc_id", "result", "score"]
    whole = lang_id.identify(docs, net)
    assert whole.columns == names + ["lang_pred_", "score_"] and whole.count() == 60


def test_words_in_pieces_and_with_accents(spark):
    plain = "the people of this quiet town are kind and read many books every day said nothing about that other thing over there".split()
    toxic = ["idiot", "moron", "scumbag"]
    rows = [(i, " ".join(plain[(i * 7 + j * 3) % len(plain)] for j in range(30)) + (f" {toxic[i % 3]} " * 2 if i % 4 == 0 else " ")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert set(toxic) <= set(model.lexicon)
    clean = "the people of this quiet town"
    written = ["id iot", "i diot", "mo ron", "scum bag", "sc um bag", "ïdïot", "ï d ï o t", "Id iot!", "m0 ron", "mörón", "ID10T"]
    other = ["an idea", "I do it", "mo. ron", "id, iot", "people of", "a b c d", "ob jects", "été"]
    texts = [f"{clean} {x} {clean}" for x in [*written, *other]] + ["id " * 50_000 + "iot", "x y " * 100_000, "scum " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert not [(x, got[i]) for i, x in enumerate(written) if got[i] <= 0.5]
    assert not [(x, got[len(written) + i]) for i, x in enumerate(other) if got[len(written) + i] >= 0.2]


def test_toxicity_learns_from_all_labelled_documents(spark):
    rows = [(i, f"fine words number {'ab'[i % 2]} here" if i % 100 else "you grobnik here") for i in range(5_000)]
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(5_000)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert model.learned == (4_950, 50) and model.lexicon["grobnik"] > 2 and "here" not in model.lexicon


def test_plain_words_are_read_without_a_lattice(monkeypatch):
    """Words of letters alone are not taken apart, and weigh what their only reading weighs."""
    model = toxicity.ToxicityModel(toxicity.LetterModel(Counter({"idiot": 3, "banana": 2, "scum": 2})))
    model.lexicon = {"idiot": 2.5, "banan-": 3.0, "ab": 2.0, "scum": 2.1}
    words = ["idiot", "IDIOT", "idiots", "banana", "bananas", "Bananarama", "ab", "abc", "scu", "scum", "x", "zzz", "baaanana"]
    want = [max((model.lexicon.get(k, 0.0) for r in toxicity.readings(w, model.letters) for k in toxicity.features(r)), default=0.0) for w in words]
    assert [model.weight(w) for w in words] == want and want[0] == 2.5 and want[3] == 3.0
    joiner = model.joiner()
    assert [joiner.piece(w) for w in ("id", "iot", "Sc", "um", "zzz")] == [("id", True, False), ("iot", False, True), ("sc", True, False), ("um", False, True), ("zzz", False, False)]
    asked = []
    monkeypatch.setattr(toxicity, "bare", lambda w: asked.append(w) or w)
    assert toxicity.restore("Banana", model.letters) == "banana" and model.weight("idiot") == 2.5 and joiner.piece("iot")[2] and not asked


def test_keys_and_left_out_features_of_each_distinct_word_once(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = [rng.choices(words, k=rng.randint(0, 12)) for _ in range(90)] + [[]]
    labels, counts = [rng.randint(0, 1) for _ in texts], [[rng.randint(1, 3) for _ in x] for x in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(labels, pa.int32()), pa.array([sum(x) for x in counts], pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
        names=["id", "label", "n", "words", "counts"],
    )
    lexicon = {k: (rng.random(), rng.random()) for w in words[:30] for k in toxicity.features(w)}
    asked = []
    features = toxicity.features
    monkeypatch.setattr(toxicity, "features", lambda w: asked.append(w) or features(w))
    for b in (batch, batch.slice(7, 40), batch.slice(0, 0)):
        ids = b.column(0).to_pylist()
        want = {k: [sum(any(k in features(w) for w in texts[i]) for i in ids if labels[i] == label) for label in (1, 0)] for k in {k for i in ids for w in texts[i] for k in features(w)}}
        for most in (1, 50, 1 << 18):
            got = [tuple(r.values()) for x in toxicity._key_counts(iter([b]), most) for r in x.to_pylist()]
            assert len(got) == len(want) and {k: [p, q] for k, p, q in got} == want
        asked.clear()
        rows = [tuple(r.values()) for x in toxicity._left_out_features(SimpleNamespace(value=lexicon))(iter([b])) for r in x.to_pylist()]
        assert len(asked) == len(set(asked))
        for i, row in zip(ids, rows, strict=True):
            weights = np.array([max((lexicon[k][labels[i]] for k in features(w) if k in lexicon), default=0.0) for w in texts[i]], float)
            assert row == (float(labels[i]), *toxicity.hit_features(sum(counts[i]), weights, np.array(counts[i], np.int64)))


@pytest.mark.parametrize("bits", [15, None])
@pytest.mark.parametrize(("kind", "of_labels"), [("long", "int"), ("string", "string")])
def test_labels_meet_all_texts_whatever_their_slots(spark, bits, kind, of_labels):
    """Ids that share a slot, repeated rows and labels, null ids and texts, ids of two types."""
    rng = random.Random(7)
    rows = [(i, None if i % 50 == 0 else f"text {i} {rng.random()}") for i in range(4_000)] + [(i, f"again {i}") for i in range(0, 4_000, 97)] + [(None, "no id")] * 2
    labels = [(i, i % 3 % 2) for i in range(0, 6_000, 2)] + [(i, 1) for i in range(0, 4_000, 130)] + [(4, 0)] * 2 + [(None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").cast(kind), "text")
    marked = spark.createDataFrame(labels, "id long, label int").select(F.col("id").cast(of_labels), "label")
    got = sampling.all_labelled_texts(docs, marked, "doc_id", "text", bits)
    by_id = {}
    for i, x in labels:
        by_id.setdefault(i, []).append(x)
    want = Counter((i, x, t) for i, t in rows if i is not None for x in by_id.get(i, []))
    assert Counter((int(r.id), r.label, r.text) for r in got.collect()) == want


def test_labelled_texts_are_not_shuffled(spark):
    """With labels too large to broadcast, training shuffles a fraction of the texts' bytes."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=6_000)) + " grobnik" * (i % 4 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = store.new_path(spark, "long-texts")
    docs.write.parquet(path)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    sc = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        model = toxicity.train(spark.read.parquet(path), labels)
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert model.learned == (90, 30) and "grobnik" in model.lexicon
    assert moved < sum(len(t) for _, t in rows) / 10, moved


def test_pieces_stay_within_their_text_and_marks_behind_words_are_dropped():
    model = toxicity.ToxicityModel(toxicity.LetterModel(Counter({"idiot": 30, "scumbag": 30, "the": 9})))
    model.lexicon = {"idiot": 2.0, "scumbag": 3.0}
    texts = ["the id", "iot the", "the id iot", "sc um", "bag", None, "", "id", "iot", "sc um bag id iot", "id iot"]
    got = [sorted(x for x in words if x in model.lexicon) for _, words, _ in toxicity.documents_words(pa.array(texts), lambda w: toxicity.restore(w, model.letters), joiner=model.joiner())]
    assert got == [[], [], ["idiot"], [], [], [], [], [], [], ["idiot", "scumbag"], ["idiot"]]
    for word, want in (("Idiot...", ["idiot"]), ("idiot***", ["idiot"]), ("(idiot", ["idiot", "cidiot"]), ("ïdiöt,", ["ïdiöt", "idiot"]), ("!idiot", ["iidiot", "lidiot", "idiot"]), ("...", [])):
        assert set(toxicity.readings(word, model.letters)) <= set(want) and toxicity.readings(word, model.letters)[:1] == want[:1] or word[0] in "!(", word
    assert model.weight("ïdiöt,") == 2.0 and model.weight("the,") == 0.0 and toxicity.unaccented("Čéß日à") == "Ceß日a"
