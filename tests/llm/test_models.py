import random
import zlib

import numpy as np
from cases import corpus, frame

from quillon.llm import language, quality
from quillon.llm.token_counts import MARK, CountingTrie, default_model, token_counts, zipf_vocabulary


def test_trie_counts_match_the_library():
    from tokenizers import Tokenizer, models

    vocab = zipf_vocabulary(default_model())
    plain = [(p, s) for p, s in vocab.items()]
    unigram = Tokenizer(models.Unigram([("<unk>", 0.0), *[(f"<0x{b:02X}>", -100.0) for b in range(256)], *plain], unk_id=0, byte_fallback=True))
    r = random.Random(2)
    words = {MARK + "".join(r.choice("aeioubcdstné漢🙂xyz.") for _ in range(r.randint(1, 14))) for _ in range(800)} | {MARK, MARK + "internationalization"}
    trie = CountingTrie(vocab)
    for w in sorted(words):
        assert trie.count(w) == len(unigram.encode(w).ids), w
    small = CountingTrie(vocab, max_nodes=20)
    assert [small.count(w) for w in sorted(words)] == [trie.count(w) for w in sorted(words)]


def test_trie_is_shared_and_best():
    trie = CountingTrie({"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "c": -2.0})
    assert [trie.count(w) for w in ("ab", "abc", "abca", "aé", "")] == [1, 2, 3, 3, 0]
    assert len(trie.score) == 6  # root, a, ab, abc, abca, aé


def test_token_counts(spark):
    rows = corpus()
    trie = CountingTrie(zipf_vocabulary(default_model()))
    got = sorted(((x.doc_id, x.n_pretokens, x.n_tokens) for x in token_counts(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, len((t or "").split()), sum(trie.count(MARK + w) for w in (t or "").split())) for i, t in rows), key=str)
    assert token_counts(frame(spark, [])).count() == 0
    # Words are what str.split sees.
    odd = [(i, f"a{chr(c)}b{chr(c)}") for i, c in enumerate([*range(1, 0x3001), 0xFEFF, 0x1F600]) if not 0xD800 <= c < 0xE000]
    got = {x.doc_id: x.n_pretokens for x in token_counts(frame(spark, odd)).collect()}
    assert got == {i: len(t.split()) for i, t in odd}


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def labelled(spark, n=240):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "over", "old", "stones", "and", "light"]) for _ in range(r.randint(5, 60)))
    bad = lambda: " ".join(r.choice(["WIN!!", "$$$", "click", "%%%", "free###", "NOW!!"]) for _ in range(r.randint(5, 60)))
    rows = [(i, good() if i % 3 else bad()) for i in range(n)]
    labels = [(i, int(i % 3 > 0), "x") for i in range(n)] + [(None, 1, "x"), (3, 1, "x"), (4, None, "x")]
    extra = [(n, None), (n + 1, ""), (None, good()), (n + 2, bad() * 300)]
    return frame(spark, rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, text string")


def test_quality_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    assert len(got) == 244 and all(0 <= s <= 1 for s in got.values())
    out = [i for i in range(240) if held(i)]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in out]) > 0.95
    assert got[240] == got[241] == model.prior and got[242] < 0.5
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and "score" in kept.columns and kept.where("doc_id < 240").count() == sum(got[i] >= 0.5 for i in range(240))


def test_quality_uses_no_held_out_label(spark):
    docs, labels = labelled(spark)
    flipped = [(i, 1 - y if None not in (i, y) and held(i) else y, t) for i, y, t in labels.collect()]
    flipped = spark.createDataFrame(flipped, labels.schema)
    assert quality.train(docs, labels) == quality.train(docs, flipped)


def test_quality_without_two_classes(spark):
    docs, labels = labelled(spark, 30)
    for some in (labels.limit(0), labels.where("quality = 1")):
        scores = {x.score for x in quality.score(docs, quality.train(docs, some)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
    assert quality.score(frame(spark, []), quality.train(docs, labels)).count() == 0


def test_quality_curve_always_settles():
    for seed in range(50):
        r = np.random.default_rng(seed)
        n = int(r.integers(20, 1500))
        y = (r.random(n) < r.uniform(0.05, 0.95)).astype(float)
        d = np.where(y == 1, 0.1, -0.15) + r.standard_normal(n) * r.choice([0.001, 0.02, 0.1])
        f = np.c_[d, r.uniform(0.05, 1.3, n)]
        if seed % 2:  # repeated texts
            f, y = np.repeat(f, 5, 0), np.repeat(y, 5)
        x = quality._expand(f)
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
        w, settled = quality._fit_curve(x, y)
        assert settled and np.abs(w).max() < 1e3, seed
        p = quality._curve(np.c_[np.ones(len(x)), x] @ w)
        assert abs(p.mean() - y.mean()) < 0.01


def test_quality_follows_the_share_of_labels():
    r = random.Random(4)
    say = lambda words, k: " ".join(r.choice(words) for _ in range(k))
    shared = ["and", "the", "light", "stone", "free", "now"]
    texts = [say(["river", "hill", *shared] if k else ["WIN!!", "$$$", *shared], r.randint(4, 30)) for k in (0, 1) for _ in range(300)]
    labels = [0] * 300 + [1] * 300
    even, good = quality.fit(texts, labels), quality.fit(texts, labels, counts=(1000, 9000))
    a, b = (quality.Scorer(m).score(texts) for m in (even, good))
    assert np.allclose(np.log(b / (1 - b)) - np.log(a / (1 - a)), np.log(9001 / 1001), atol=1e-6)
    assert good.prior == 9001 / 10002


def test_quality_sample_takes_both_classes_in_turn(spark):
    r = random.Random(3)
    rows = [(i, "bad " * r.randint(50, 200) if i % 7 == 0 else "good words") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(400)], "doc_id long, quality int")
    texts, y, counts = quality.labelled_sample(frame(spark, rows + [(7, "bad a")]), labels, id_col="doc_id", text_col="text", label_col="quality", sample=30, sample_bytes=4000)
    free = [i for i in range(400) if not held(i)]
    assert counts == (sum(i % 7 == 0 for i in free), sum(i % 7 > 0 for i in free))
    assert sum(y) == 30 and 0 < y.count(0) < 30 and y[:2] == [0, 1]
    assert sum(len(t) for t, k in zip(texts, y, strict=True) if not k) <= 2000


def test_gru_gradients():
    net = language.ByteGru(["a", "b", "c"], hidden=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = np.frombuffer(b" abc  zz  ", dtype=np.uint8).reshape(2, 5).T
    mask = np.array([[0, 1, 1, 1, 0], [0, 1, 1, 0, 0]], dtype=np.float32).T
    y = np.array([2, 0])
    _, g = net.gradients(x, y, mask.astype(np.float64))
    r = np.random.default_rng(0)
    for k, p in net.p.items():
        for _ in range(4):
            i = tuple(r.integers(0, s) for s in p.shape) if k[1:] != "E" else (int(x[2, 0]), int(r.integers(0, 9)))
            old, e = p[i], 1e-3
            p[i] = old + e
            hi = net.gradients(x, y, mask)[0]
            p[i] = old - e
            lo = net.gradients(x, y, mask)[0]
            p[i] = old
            assert abs((hi - lo) / (2 * e) - g[k][i]) < 2e-3, k


def test_reader_equals_the_network():
    net = language.ByteGru(["a", "b", "c"], hidden=5, seed=3)
    reader = language.Reader(net)
    x = np.random.default_rng(1).integers(0, 256, (40, 7))
    assert np.allclose(net.log_probs(x).transpose(0, 2, 1), reader.log_probs(x.astype(np.intp)), atol=1e-5)
    # Spans with margins count every byte once, whatever else is read beside them.
    r = random.Random(2)
    texts = [bytes(r.randrange(97, 123) for _ in range(n)) for n in (1, 15, 191, 192, 193, 700, 5000)]
    got = reader.sums(texts)
    for t, total in zip(texts, got, strict=True):
        line = np.frombuffer(b" " * 16 + t + b" " * 16, dtype=np.uint8).astype(np.intp)[:, None]
        want = reader.log_probs(line)[16: 16 + len(t), :, 0].sum(0)
        assert np.allclose(total / len(t), want / len(t), atol=0.03)
    assert np.allclose(reader.sums(texts[::-1])[::-1], got, atol=1e-3) and np.allclose(reader.sums(texts, spans=3), got, atol=1e-3)


def test_text_pieces():
    assert language.text_pieces(None, 5, 3) == [] and language.text_pieces("AbÉ", 5, 3) == ["abé".encode()]
    got = language.text_pieces("x y" * 500, -12345, 7)
    assert 1 < len(got) <= 7 and all(len(p) == language.PIECE for p in got)


def test_language_held_out_accuracy(spark):
    r = random.Random(9)
    sound = {"aa": ["tion", "the", "ing", "wh"], "bb": ["é", "ou", "eau", "qu"], "cc": ["sch", "ü", "ein", "ß"], "dd": ["ción", "ñ", "os", "ar"], "ee": ["の", "は", "日", "本"]}
    rows, langs = [], {}
    for i in range(200):
        lang = r.choice(sorted(sound))
        langs[i] = lang
        rows.append((i, " ".join("".join(r.choice(sound[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 30)))))
    rows += [(200, None), (201, ""), (202, "12 ... 7²"), (203, "x" * 5000), (None, "tion the")]
    docs = spark.createDataFrame([(i, t, langs.get(i), "w") for i, t in rows], "doc_id long, text string, lang string, score string").repartition(3)
    net = language.train(docs, steps=300)
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.predict(docs, net, slice_bytes=2000).collect()}
    assert len(got) == 205 and got[200] == got[201] == got[202] == ("und", 0.0) and got[203][0] in sound
    out = [i for i in range(200) if held(i)]
    assert np.mean([got[i][0] == langs[i] for i in out]) > 0.95
    assert np.allclose(language.Labeller(net).label([rows[0][1]])[1], got[0][1], atol=1e-4)
    # The network reads running text: a word's surroundings matter.
    a, b = language.Reader(net).sums(["the ü ing".encode(), "the ing ü".encode()])
    assert np.abs(a - b).max() > 1e-3


def test_language_keeps_to_the_most_frequent_languages(spark):
    docs = spark.createDataFrame([(i, "abc def", "x" if i % 3 else "y") for i in range(30)], "doc_id long, text string, lang string")
    assert language.train(docs, steps=5, most_languages=1).languages == ["x"]


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "abc"), (2, None)]).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert language.train(docs) is None
    assert {x.lang_pred for x in language.predict(docs, None).collect()} == {"und"}
