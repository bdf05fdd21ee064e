import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, quality_classifier, quality_rules


def stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_text_stats_match_brute_force():
    rng = random.Random(0)
    texts = ["", None, "a\nb\na\n \n \n", "\n\n\n", "# * a\x0bb", "x y z " * 9, "é 中\t|<>"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = quality_rules.text_stats(pa.array(texts))
    assert [list(r) for r in zip(*(v.tolist() for v in got.values()), strict=True)] == [stats(t) for t in texts]


@pytest.mark.parametrize("which", ["hostile", "corpus", "empty"])
def test_rules(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    got = quality_rules.quality_rules(docs).collect()
    want = sorted((repr(r["doc_id"]), *stats(r["text"])) for r in rows)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_hosts_are_judged_with_shrinking(spark):
    rows = [("good", i < 2) for i in range(100)] + [("bad", i < 95) for i in range(100)] + [("few", True)] + [(f"h{k}", i < 1) for k in range(10) for i in range(30)] + [(None, True)]
    got = {r["host"]: r for r in quality_rules.judge_hosts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got["bad"]["rejected"] and not got["good"]["rejected"] and None not in got
    share = np.array([1.0, 0.02, 0.95] + [1 / 30] * 10)
    weight = max(2.0, share.mean() * (1 - share.mean()) / share.var() - 1)
    assert got["few"]["rate"] == pytest.approx((1 + share.mean() * weight) / (1 + weight))


def test_host_of(spark):
    df = spark.createDataFrame([("https://u@Www.Ex.org:80/a?b",), ("src0",), (" ",), (None,), ("EX.org/x",)], "s string")
    assert [r[0] for r in df.select(quality_rules.host_of(F.col("s"))).collect()] == ["www.ex.org", "src0", None, None, "ex.org"]


def test_language_id(corpus, hostile, empty):
    rows = language_id.identify(corpus, ~language_id.held_out()).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 160 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    got = language_id.identify(hostile, ~language_id.held_out()).collect()
    assert len(got) == hostile.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(empty, ~language_id.held_out()).count() == 0


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(docs, F.lit(True)).collect()] == ["und"]


def test_subwords_stay_inside_texts():
    texts = ["Été ab", "", None, "a", "xyz"]
    for (whole, n), size in zip(language_id.subwords(*language_id.text_buffer(pa.array(texts))), language_id.SIZES, strict=True):
        alone = [next(x for x, s in zip(language_id.subwords(*language_id.text_buffer(pa.array([t], pa.string()))), language_id.SIZES, strict=True) if s == size) for t in texts]
        assert n.tolist() == [int(k[0]) for _, k in alone] and whole.tolist() == [b for a, _ in alone for b in a.tolist()]
    upper, lower = (language_id.counted(pa.array([t]))[0] for t in ("ÉTÉ LÀ", "été là"))
    assert upper[0].tolist() == lower[0].tolist()


@pytest.fixture(scope="module")
def labels(corpus):
    return corpus.where("doc_id < 140").select("doc_id", (F.col("doc_id") < 120).cast("int").alias("quality"), F.lit(0).alias("toxic"))


def test_classifier(corpus, hostile, empty, labels):
    rows = quality_classifier.classify(corpus, labels).collect()
    assert len(rows) == 160 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    right = [r["predicted"] == int(not 120 <= r["doc_id"] < 140) for r in rows if r["held_out"]]
    assert np.mean(right) > 0.9
    assert quality_classifier.classify(hostile, labels).count() == hostile.count()
    assert quality_classifier.classify(empty, labels).count() == 0
    kept = quality_classifier.keep_good(corpus, labels)
    assert kept.columns == corpus.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_classifier_without_labels(corpus, labels):
    scores = {r["score"] for r in quality_classifier.classify(corpus, labels.limit(0)).collect()}
    assert len(scores) == 1


def test_corpus_statistics_are_those_of_all_documents(corpus):
    """Context vectors and counts against plain loops over the texts."""
    got = quality_classifier.corpus_statistics(corpus)
    place, sign = quality_classifier.index_vectors()
    index = np.zeros((2 * quality_classifier.SLOTS, quality_classifier.DIM))
    np.add.at(index, (np.arange(len(index))[:, None], place), sign)
    sums, counts = np.zeros_like(index), np.zeros(len(index), int)
    for r in corpus.select("text").collect():
        words, shapes, _ = quality_classifier.slots(pa.array([r["text"]]))
        for flat in (words.tolist(), shapes.tolist()):
            for i, s in enumerate(flat):
                counts[s] += 1
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(flat):
                        sums[s] += index[flat[j]]
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    assert got.vectors == pytest.approx(sums / np.where(norm > 0, norm, 1), abs=1e-5)
    half = quality_classifier.SLOTS
    share = counts[:half] / counts[:half].sum()
    want = np.concatenate([np.where(counts[:half] > 0, 1e-3 / (1e-3 + share), 0), counts[half:] > 0])
    assert got.weight == pytest.approx(want, abs=1e-6)


def test_scores_are_those_of_the_network(corpus, labels):
    """Plain pooling, layers and temperature, text by text, give what the folded table gives to all at once."""
    texts = [r[0] for r in corpus.orderBy("doc_id").select("text").collect()]
    own = quality_classifier.corpus_statistics(corpus)
    x, y = quality_classifier.training_rows(corpus, labels, quality_classifier.learned(), own)
    net = quality_classifier.fit(x, y, epochs=5)
    together = quality_classifier.score(pa.array([*texts, None, ""]), quality_classifier.fold(net, own))
    for text, got in zip([*texts, None, ""], together.tolist(), strict=True):
        words, shapes, _ = quality_classifier.slots(pa.array([text], pa.string()))
        features = []
        for part in (words.tolist(), shapes.tolist()):
            total = [0.0] * quality_classifier.DIM
            for s in part:
                total = [t + float(own.weight[s]) * float(v) for t, v in zip(total, own.vectors[s], strict=True)]
            weight = sum(float(own.weight[s]) for s in part)
            features += [t / weight if weight else 0.0 for t in total]
        z = [(f - m) / s for f, m, s in zip(features, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, b + sum(a * float(w) for a, w in zip(z, column, strict=True))) for b, column in zip(net.bias, net.first.T, strict=True)]
        logit = net.out_bias + sum(h * float(w) for h, w in zip(hidden, net.out, strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)), abs=1e-4)


def test_training_rows_are_those_of_labelled_documents(corpus, labels, hostile):
    own = quality_classifier.corpus_statistics(corpus)
    x, y = quality_classifier.training_rows(corpus, labels, quality_classifier.learned(), own)
    learned = labels.where(quality_classifier.learned()).collect()
    assert len(x) == len(learned) and sorted(y.tolist()) == sorted(r["quality"] for r in learned)
    x, y = quality_classifier.training_rows(corpus, labels, quality_classifier.learned(), own, rows=20)
    assert len(x) == len(y) == 20


def test_temperature_is_the_best_of_its_grid():
    """The classifier's temperature has the least log loss on the rows kept from training, by plain recomputation."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 128)), rng.integers(0, 2, 300)
    x[:, 0] += 1.5 * y
    net = quality_classifier.fit(x, y, epochs=8)
    order = np.random.default_rng(42).permutation(300)
    held = order[::6]
    z = (x[held] - net.mean) / net.scale
    logits = np.maximum(z @ net.first + net.bias, 0) @ net.out + net.out_bias
    soft = y[held] * (1 - 2 / 54) + 1 / 54
    loss = lambda t: -np.mean([s * math.log(1 / (1 + math.exp(-v / t))) + (1 - s) * math.log(1 / (1 + math.exp(v / t))) for v, s in zip(logits, soft, strict=True)])
    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.2, 20, 200))


def test_languages_match_brute_force():
    """Subwords, averages, softmax, temperature and threshold in plain Python from the stored layers."""
    rng = random.Random(3)
    words = {"a": "the and of wing stone élan".split(), "b": "le la des ÜBER pierre aile".split()}
    pairs = [(k, " ".join(rng.choice(words[k] + words["b" if rng.random() < 0.2 else k]) for _ in range(rng.randint(1, 6)))) for k in "ab" for _ in range(60)]
    rng.shuffle(pairs)
    features = language_id.counted(pa.array([t for _, t in pairs]))
    model = language_id.fit(features, [k for k, _ in pairs])

    def bucket(window):
        key = int.from_bytes(window, "little") * 0x9E3779B1 & 0xFFFFFFFF
        key ^= len(window) * 0x85EBCA6B & 0xFFFFFFFF
        key = (key ^ key >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return key >> 17

    def subwords(text):
        raw = bytearray(text.encode())
        for i, c in enumerate(raw):
            if c < 0x80:
                raw[i] = c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32
            elif i and raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
                raw[i] = c + 32
        return [bytes(raw[i : i + n]) for n in (3, 4) for i in range(len(raw) - n + 1) if 32 not in raw[i + 1 : i + n - 1]]

    def logits(text):
        found = [bucket(w) for w in subwords(text)]
        mean = [sum(float(model.scores[b][k]) for b in found) / max(len(found), 1) for k in range(2)]
        return [m + float(b) for m, b in zip(mean, model.bias, strict=True)]

    def plain(text, t):
        e = [math.exp(v / t) for v in logits(text)]
        return [v / sum(e) for v in e]

    got = language_id.predict(pa.array([t for _, t in pairs]), model)
    for (_, text), p in zip(pairs, got, strict=True):
        assert p.tolist() == pytest.approx(plain(text, model.temperature), abs=1e-5)
    usable = [i for i, (_, t) in enumerate(pairs) if subwords(t)]
    held = [usable[i] for i in np.random.default_rng(42).permutation(len(usable))[::8]]
    n = len(held)

    def loss(t):
        total = 0.0
        for i in held:
            p = plain(pairs[i][1], t)
            right = "ab".index(pairs[i][0])
            total -= (1 - 1 / (n + 2)) * math.log(p[right] + 1e-12) + 1 / (n + 2) * math.log(p[1 - right] + 1e-12)
        return total / n

    assert all(loss(model.temperature) <= loss(model.temperature * f) + 1e-6 for f in (0.5, 0.9, 1.1, 2))
    ranked = sorted(((max(plain(pairs[i][1], model.temperature)), i) for i in held), reverse=True)
    right, threshold = 0, 1.0
    for k, (p, i) in enumerate(ranked, 1):
        q = plain(pairs[i][1], model.temperature)
        right += "ab"[q.index(max(q))] == pairs[i][0]
        if right >= 0.99 * k:
            threshold = p
    assert model.threshold == pytest.approx(threshold, abs=1e-5)
