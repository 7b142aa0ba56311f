import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cases import SCHEMA, VOCABULARY, odd_documents, prose, rows
from lexmill.llm import quality_classifier, quality_rules, toxicity
from lexmill.llm.support import held_out

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    """Every fifth text has insults, every seventh is junk."""
    r = random.Random(7)
    texts, labels = [], []
    for i in range(n):
        words = prose(i, r.randrange(30, 120)).split()
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["scoundrel", "blockhead", "nitwit"]))
        if junk:
            words = [w + r.choice(["&&&", "###", " |"]) for w in words] if i % 2 else [w for w in words[:10] for _ in range(8)]
        texts.append(" ".join(words))
        labels.append((i, int(not junk), int(toxic)))
    return rows(texts), labels


def test_held_out_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def scores(spark, module, score, label):
    documents, labels = corpus()
    docs, marks = spark.createDataFrame(documents, SCHEMA), spark.createDataFrame(labels, LABELS)
    model = module.fit(docs, marks, label)
    out = {r.id: r.score for r in score(docs, model).collect()}
    return out, {i: (q if label == "quality" else t) for i, q, t in labels}, model


def separation(out, truth):
    held = [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    return np.mean([out[a] > out[b] for a in held if truth[a] for b in held if not truth[b]])


def test_toxicity_separates_held_out_documents(spark):
    out, truth, model = scores(spark, toxicity, toxicity.toxicity_scores, "toxic")
    assert separation(out, truth) > 0.95
    odd = spark.createDataFrame(odd_documents(), SCHEMA)
    marks = [r.score for r in toxicity.toxicity_scores(odd, model).collect()]
    assert len(marks) == odd.count() and all(0 <= s <= 1 for s in marks)
    again = toxicity.toxicity_scores(odd, model).collect()
    assert [r.score for r in again] == marks
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(s < 0.7 for s in marks)


def test_quality_separates_held_out_documents(spark):
    out, truth, model = scores(spark, quality_classifier, quality_classifier.quality_scores, "quality")
    assert separation(out, truth) > 0.97
    odd = [r.score for r in quality_classifier.quality_scores(spark.createDataFrame(odd_documents(), SCHEMA), model).collect()]
    assert len(odd) == len(odd_documents()) and all(0 <= s <= 1 for s in odd)


def test_ftrl_is_the_published_update():
    """One coordinate and the bias, by the formulas alone."""
    x = (np.array([3], np.int32), np.array([0.5], np.float32))
    data = [(*x, 1), (*x, 0), (*x, 1)]
    w, bias = quality_classifier.train_ftrl(data, epochs=2, alpha=0.3, beta=1.0, l1=0.01, l2=0.1)
    z, n = {"w": 0.0, "b": 0.0}, {"w": 0.0, "b": 0.0}
    value = {"w": 0.5, "b": 1.0}

    def weight(k):
        return 0.0 if abs(z[k]) <= 0.01 else -(z[k] - np.sign(z[k]) * 0.01) / ((1 + n[k] ** 0.5) / 0.3 + 0.1)

    for _ in range(2):
        for _, _, y in data:
            ws = {k: weight(k) for k in z}
            p = 1 / (1 + np.exp(-sum(ws[k] * value[k] for k in z)))
            for k in z:
                g = (p - y) * (3 / 4 if y else 3 / 2) * value[k]
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / 0.3 * ws[k]
                n[k] += g * g
    assert abs(w[3] - weight("w")) < 1e-6 and abs(bias - weight("b")) < 1e-9


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    for labels, expected in (([], 0.5), ([(4, 1, 1), (5, 1, 1)], 1.0)):
        marks = spark.createDataFrame(labels, LABELS)
        for module, score, label in ((toxicity, toxicity.toxicity_scores, "toxic"), (quality_classifier, quality_classifier.quality_scores, "quality")):
            assert {r.score for r in score(docs, module.fit(docs, marks, label)).collect()} <= {expected, 0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.toxicity_scores(empty, 0.5).count() == 0


WORDS = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x in windows if windows.count(x) > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts_match_brute_force(spark):
    texts = [None, "", "a b c a b c", "x\ny\nx\n\n\n y\n y", "a a a a a", "é 漢字 # \U0001f600 |*|", "A b c a b c\x1cd", "one two", prose(1, 200) + "\n" + prose(1, 200), "l\nl\nl\n \n "]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = quality_rules.rule_verdicts(docs, np.zeros(1 << 18, np.float32)).orderBy("id").collect()
    for r, text in zip(got, texts):
        expected = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, text
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])


def test_ratios_match_brute_force_and_reject_junk(spark):
    documents, labels = corpus(300)
    docs = spark.createDataFrame(documents, SCHEMA)
    good = [i for i, q, _ in labels if q]
    ratios = quality_rules.ratio_table(docs, spark.createDataFrame([(i,) for i in good], "id long"))
    from lexmill.llm.textkit import word_hashes

    raw, target = np.full(1 << 18, 0.5), np.full(1 << 18, 0.5)
    for doc_id, text, *_ in documents:
        at = quality_rules._buckets(word_hashes(text.encode()))
        np.add.at(raw, at.astype(int), 1)
        if doc_id in set(good):
            np.add.at(target, at.astype(int), 1)
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()), atol=1e-5)
    out = {r.id: r for r in quality_rules.rule_verdicts(docs, ratios).collect()}
    assert all(out[i].kept for i, q, _ in labels if q and out[i].n_words >= 50)
    assert not any(out[i].kept for i, q, _ in labels if not q)
    assert quality_rules.rule_verdicts(spark.createDataFrame(odd_documents(), SCHEMA), ratios).count() == len(odd_documents())
    assert not quality_rules.ratio_table(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "id long")).any()


def test_evident_strings_and_windows_match_plain_counting():
    toxic = [f" {prose(i, 40)} you moron{'s' if i % 2 else ''} {prose(50 + i, 20)}".encode() for i in range(12)] + [b"x", b""]
    ordinary = [prose(100 + i, 60).encode() for i in range(30)]
    spaced = lambda t: b" " + b" ".join(t.split()) + b" "
    grams = lambda t: {spaced(t)[i : i + 6] for i in range(len(spaced(t)) - 5)}
    want = set()
    for g in set().union(*map(grams, toxic)):
        c1, c0 = (sum(g in grams(t) for t in texts) for texts in (toxic, ordinary))
        share = (c1 + c0) / 44
        told = 2 * sum(c * math.log(c / n / share) for c, n in ((c1, 14), (c0, 30)) if c)
        if c1 >= 2 and c1 / 14 >= 5 * (c0 + 0.5) / 31 and told >= 9:
            want.add(g)
    found = toxicity.evident_grams(toxic, ordinary, 5, 9)
    assert {int(v).to_bytes(6, "big") for v in found} == want and b" moron" in want
    among = toxicity._Among(found)
    for t in toxic:
        words = [w for w in t.split() if any((b" " + w + b" ")[i : i + 6] in want for i in range(len(w) - 3))]
        assert toxicity.evident_windows(t, among) == spaced(b" ".join(words))


def test_a_score_is_the_calibrated_difference_of_compressed_lengths():
    rows_ = [(f"{prose(i, 50)} {'utter moron ' * (i % 4 == 0)}{prose(300 + i, 30)}".encode(), int(i % 4 == 0)) for i in range(60)]
    model = toxicity.fit_texts(rows_)
    text, x = rows_[4][0], []
    words, plain = text.lower().split(), toxicity._compressor(model.ordinary)
    for own, n in ((model.telling, 12), (model.frequent, 3)):
        toxic, saved, size = toxicity._compressor(own + model.ordinary), [], 0
        for i in range(0, len(words), n):
            w = b" " + b" ".join(words[i : i + n]) + b" "
            saved.append(len(plain.compress(w)) - len(toxic.compress(w)))
            size += len(w)
        share = lambda least: sum(s >= least for s in saved)  # noqa: B023, E731
        best = sorted(saved)
        x += [best[-1], sum(best[-3:]) / 3, sum(best[-6:]) / 6, 100 * sum(max(s, 0) for s in saved) / size, share(2) / len(saved), share(4) / len(saved), min(share(3), 8)]
    z = model.weights[0] + sum(w * (a - m) / s for w, a, m, s in zip(model.weights[1:], x, model.mean, model.scale))
    assert abs(model.scorer().score(text) - 1 / (1 + math.exp(-z))) < 1e-9 and model.scorer().score(text) > 0.7


def test_frequent_strings_match_plain_counting():
    toxic = [f"{prose(i, 40)} rivermo{'ta' * (i % 3)} {prose(50 + i, 20)} rivermo".encode() for i in range(12)] + [b"rivermo " * 50, b""]
    ordinary = [f"{prose(100 + i, 60)} {'rivermo' * (i == 3)}".encode() for i in range(30)]
    spaced = lambda t: b" " + b" ".join(t.split()) + b" "
    grams = lambda t: [spaced(t)[i : i + 6] for i in range(len(spaced(t)) - 5)]
    n1 = sum(len(grams(t)) for t in toxic)
    n0 = sum(len(grams(t)) for t in ordinary)
    want = set()
    for g in {g for t in toxic for g in grams(t)}:
        own = [min(4, grams(t).count(g)) for t in toxic]
        if sum(map(bool, own)) >= 4 and sum(own) / n1 >= 6 * (sum(grams(t).count(g) for t in ordinary) + 0.5) / n0:
            want.add(g)
    found = toxicity.frequent_grams(toxic, ordinary, 6, 4)
    assert {int(v).to_bytes(6, "big") for v in found} == want and b"vermo " in want


def test_byte_strings_are_counted_in_portions(monkeypatch):
    texts = [b"one two three two two two two two", b"", b"two three four", b"one two three two two two two two", b"x"]
    monkeypatch.setattr(toxicity, "_PORTION", 10)
    grams, held, met, total = toxicity._tally(texts)
    expected: dict[int, list[int]] = {}
    for text in texts:
        own = toxicity._grams(toxicity._spaced(text)).tolist()
        for g in set(own):
            seen = expected.setdefault(g, [0, 0])
            seen[0] += 1
            seen[1] += min(4, own.count(g))
    assert grams.tolist() == sorted(expected)
    assert [[int(a), int(b)] for a, b in zip(held, met)] == [expected[g] for g in sorted(expected)]
    assert total == sum(len(toxicity._grams(toxicity._spaced(t))) for t in texts)
    assert toxicity._tally([])[3] == 0 and not len(toxicity._tally([b""])[0])
