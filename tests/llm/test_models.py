"""Language models, quality classifier, sampled segmentations, pipeline."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.conftest import SF_DIR, pairs
from trendgap.llm import language, quality, segmentation
from trendgap.llm.batches import Texts, mixed, row_sums

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BIGGER = "/root/testdata/sf0.01"


def texts(values):
    return pa.array(values, pa.string())


def test_folding():
    codes, starts = language.folded(texts(["", None, "A b", "12", "a1b!", "😀"]))
    got = ["".join(map(chr, codes[a:b].tolist())) for a, b in zip(starts, starts[1:])]
    assert got == [" ", " ", " a b", " ", " a b ", " "]


def test_probabilities_sum_to_one():
    """For every known history, over all characters and the one never seen."""
    codes, starts = language.folded(texts(["a cab ran", "banana bar", "cab"]))
    grams = language.grams(codes, starts, 3)
    keys, n = np.unique(grams, return_counts=True)
    some = keys % np.uint64(3) > 0
    model = language.build({"x": (keys, n), "y": (keys[some], n[some])}, 3)
    unigrams = model.keys[0]
    for column in range(2):
        for history in (np.array([97, 32]), np.array([110, 97])):
            total = 0.0
            for last in [*unigrams.tolist(), 4000]:
                row = np.array([32, *history, last], np.uint64)
                full = model.entropies(row, np.array([0, 4]))
                known = model.entropies(row[:3], np.array([0, 3]))
                total += np.exp(-(full * 3 - known * 2)[0, column])
            assert abs(total - 1) < 1e-3


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    values = ["".join(rng.choice(list("abcde "), 50)) for _ in range(20)]
    codes, starts = language.folded(texts(values))
    counts = np.unique(language.grams(codes, starts, 5), return_counts=True)
    model = language.build({"x": counts})
    together = model.entropies(codes, starts)
    alone = [model.entropies(*language.folded(texts([v])))[0] for v in values]
    assert np.allclose(together, alone, atol=1e-5)


def test_language_id_on_held_out_documents(spark):
    df = spark.read.parquet(f"{BIGGER}/documents.parquet").repartition(4)
    model = language.learn(df)
    rows = language.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 250 < len(held) < 420
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) < 20
    strange = spark.createDataFrame([(1, "zzz qqq xxq wwq zq" * 9)], "doc_id bigint, text string")
    assert language.identify(strange, model).first()["rejected"]


def plain_kneser_ney(texts_, order):
    """p(char | history) of interpolated Kneser-Ney, straight from its definition."""
    strings = [" " * (order - 1) + t for t in texts_]
    full = Counter(s[i : i + order] for s in strings for i in range(len(s) - order + 1))
    levels = {order: full}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    letters = len(levels[1])

    def p(char, history):
        k = len(history) + 1
        counts = levels[k]
        n1, n2 = (sum(c == x for c in counts.values()) for x in (1, 2))
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
        same = [c for g, c in counts.items() if g[:-1] == history]
        lower = p(char, history[1:]) if history else 1 / (letters + 1)
        if not same:
            return lower
        return max(counts[history + char] - d, 0) / sum(same) + d * len(same) / sum(same) * lower

    return lambda t: -np.mean([
        np.log(p(s[i + order - 1], s[i : i + order - 1]))
        for s in [" " * (order - 1) + t] for i in range(len(s) - order + 1)
    ])


def small_talk(spark):
    known = ["a cab ran", "banana bar nab", "cab ran on", "bar on a cab", "on and on"]
    other = ["zu oz zoo", "ooze zu zoo zu", "zoo oz on", "ooze on"]
    rows = [(i, t, lang) for lang, ts in (("x", known), ("y", other)) for i, t in enumerate(ts * 3) if zlib.crc32(str(i).encode()) % 3 != 1]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return df, {lang: [t for _, t, own in rows if own == lang] for lang in "xy"}


@pytest.mark.parametrize("order", [2, 3, 5])
def test_kneser_ney_equals_its_definition(spark, order):
    df, given = small_talk(spark)
    model = language.learn(df, order)
    # Only where each language has met all letters do the even spreads agree; so one at a time.
    for lang in "xy":
        alone = language.learn(df.where(f"lang = '{lang}'"), order)
        entropy = plain_kneser_ney(given[lang], order)
        for text in [*given[lang][:3], "on a bar", "zoo on", "no cab can"]:
            if set(text) <= set(" ".join(given[lang])):
                got = alone.entropies(*language.folded(texts([text])))[0, 0]
                assert abs(got - entropy(text)) < 1e-5
    assert model.languages == ["x", "y"]


def test_a_bound_on_grams_leaves_no_language_out(spark):
    df = spark.read.parquet(f"{BIGGER}/documents.parquet").repartition(4)
    whole, cut = language.learn(df), language.learn(df, max_grams=400)
    assert cut.languages == whole.languages and len(whole.languages) == 4
    assert len(cut.keys[-1]) <= 4 * 500 and all(len(k) <= 8000 for k in cut.keys) and len(whole.keys[-1]) > 10_000
    held = [r for r in language.identify(df, cut).join(df.select("doc_id", "lang"), "doc_id").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    # What was cut went to shorter grams: every history still spreads one whole over the letters.
    for model in (whole, cut):
        letters = model.keys[0][:, None].astype(np.uint64)
        history = model.keys[2][:40]
        codes = (history[None, :] << np.uint64(12) | letters).ravel()
        spread = np.zeros(len(codes))
        for at, gram in enumerate(codes.tolist()):
            four = [gram >> 36 & 0xFFF, gram >> 24 & 0xFFF, gram >> 12 & 0xFFF, gram & 0xFFF]
            seq = np.array([32, *four], np.uint64)
            spread[at] = model_probability(model, seq)
        sums = spread.reshape(len(letters), -1).sum(0)
        assert np.all(sums <= 1 + 1e-3) and np.all(sums > 0.9)


def model_probability(model, codes):
    """Of the last character after the others, in the first language."""
    both = [-model.entropies(c, np.array([0, len(c)]))[0, 0] * max(len(c) - 1, 1) for c in (codes, codes[:-1])]
    return np.exp(both[0] - both[1])


def test_language_id_of_odd_rows(odd, nothing):
    model = language.learn(odd)
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (3, 5):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif r["doc_id"] is not None:
            assert r["lang_pred"] == "en"
    assert language.learn(nothing) is None and language.identify(nothing, None).isEmpty()
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


def test_quality_on_held_out_documents(spark):
    df = spark.read.parquet(f"{BIGGER}/documents.parquet").repartition(4)
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet")
    model = quality.learn(df, labels)
    rows = quality.score(df, model)
    assert rows.count() == 1000
    held = rows.where("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    auc = np.mean([[g > b for b in bad] for g in good])
    right = np.mean([r["predicted"] == r["quality"] for r in held])
    assert auc > 0.97 and right > 0.95
    kept = quality.accepted(df, model)
    assert kept.schema == df.schema and kept.count() == rows.where("predicted = 1").count()


def test_quality_gradients():
    rng = np.random.default_rng(4)
    features = rng.normal(size=(12, quality.FEATURES))
    first, labels = np.array([0, 3, 4, 9, 12]), np.array([1.0, 0, 1, 0])
    model = quality.fit(features, first, labels, epochs=1)
    loss = lambda: -np.sum(
        labels * np.log(s := model.forward(features, first)["score"]) + (1 - labels) * np.log(1 - s)
    )
    f = model.forward(features, first)
    found = quality.gradients(model, f, f["score"] - labels, first)
    for name, w in model.weights.items():
        flat = w.reshape(-1) if w.ndim else w.reshape(1)
        for at in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[at]
            flat[at] = old + 1e-5
            high = loss()
            flat[at] = old - 1e-5
            low = loss()
            flat[at] = old
            assert abs((high - low) / 2e-5 - np.reshape(found[name], -1)[at]) < 1e-4, name


def test_quality_of_odd_rows(spark, odd, nothing):
    schema = "doc_id bigint, quality int, text string"
    labels = spark.createDataFrame(
        [(1, 1, None), (1, 1, "x"), (2, None, None), (None, 1, None), (7, 0, None), (6, 0, None), (999, 1, None)],
        schema,
    )
    none = spark.createDataFrame([], schema)
    for given in (labels, none):
        rows = quality.score(odd, quality.learn(odd, given)).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert quality.learn(odd, none).share == 0.5
    assert quality.score(nothing, quality.learn(nothing, labels)).isEmpty()


@pytest.fixture(scope="module")
def pieces():
    return segmentation.Pieces(open(PIECES, "rb").read(), 1.0)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def all_segmentations(pieces, sp, text):
    text = "▁" + text.replace(" ", "▁")
    weight = {sp.id_to_piece(int(i)): w for i, w in zip(pieces.ids, pieces.weights)}
    out = []

    def go(at, done, log):
        if at == len(text):
            out.append((tuple(done), log))
        for n in range(1, min(16, len(text) - at) + 1):
            if text[at : at + n] in weight:
                go(at + n, [*done, text[at : at + n]], log + weight[text[at : at + n]])

    go(0, [], 0.0)
    total = np.logaddexp.reduce([x for _, x in out])
    return {tokens: float(np.exp(log - total)) for tokens, log in out}


def test_sampling_without_replacement(pieces, sp):
    text, n = "the ab", 20_000
    chances = all_segmentations(pieces, sp, text)
    sampler = segmentation.Sampler(pieces, [text] * n, mixed(np.arange(n, dtype=np.uint64)))
    paths, outside = sampler.sample(3)
    drawn, logs = [], []
    for path in paths:
        ids, bounds = sampler.ids(path)
        drawn.append([tuple(sp.id_to_piece(int(x)) for x in ids[a:b]) for a, b in zip(bounds, bounds[1:])])
        logs.append(row_sums(sampler.lattice.log[path.edge], path.bounds))
    assert all(len(set(x)) == 3 for x in zip(*drawn))
    assert all(abs(np.exp(l) - chances[t]) < 1e-9 for l, t in zip(logs[1], drawn[1]))
    first, second = Counter(drawn[0]), Counter(drawn[1])
    for tokens, p in chances.items():
        q = sum(a * p / (1 - a) for other, a in chances.items() if other != tokens)
        assert abs(first[tokens] / n - p) < 5 * (p / n) ** 0.5 + 1e-3
        assert abs(second[tokens] / n - q) < 5 * (q / n) ** 0.5 + 1e-3
    # Weighted by their inclusion the sampled probabilities add up to one on average.
    share = [np.exp(l) / -np.expm1(-np.exp(l - outside)) for l in logs]
    assert abs(np.mean(sum(share)) - 1) < 0.01


@pytest.mark.parametrize("table", ["odd", "nothing", "documents"])
def test_segmentations_decode_to_the_text(request, sp, table):
    df = request.getfixturevalue(table)
    found = segmentation.sample_segmentations(df, PIECES, k=3)
    rows = found.collect()
    assert len(rows) == df.count() and all(r["round_trip"] for r in rows)
    for r in rows:
        assert len(set(map(bytes, r["ids"]))) == r["n_samples"] <= 3
        assert sorted(r["perturbed"], reverse=True) == r["perturbed"]
        assert all(0 <= x <= 1 for x in r["inclusion"])
    want = sorted((str(i), t.replace("▁", " ")) for i, t in pairs(df))
    got = sorted(
        (str(r["doc_id"]), sp.decode(np.frombuffer(r["ids"][0], "<u4").tolist())) for r in rows
    )
    assert got == want
    again = segmentation.decode(found.selectExpr("doc_id", "ids[0] AS ids"), PIECES)
    assert sorted((str(i), t) for i, t in pairs(again)) == want


def test_samples_depend_on_the_row_key_alone(odd):
    one = segmentation.sample_segmentations(odd.coalesce(1), PIECES).collect()
    many = segmentation.sample_segmentations(odd.repartition(7), PIECES).collect()
    pick = lambda rows: sorted(repr((r["doc_id"], r["ids_crc32"])) for r in rows)
    assert pick(one) == pick(many)


def test_more_samples_than_nine(spark):
    """Streams of one place are not those of the next; twelve different samples, in order."""
    key = np.arange(3, dtype=np.uint64)
    seen = [segmentation.uniform(key, np.full(3, place), stream) for place in range(40) for stream in range(120)]
    assert len(np.unique(np.concatenate(seen))) == 3 * 40 * 120
    rows = [(i, "unbelievable internationalisation of words") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    firsts = Counter()
    for r in segmentation.sample_segmentations(df, PIECES, k=12).collect():
        assert r["n_samples"] == 12 == len(set(map(bytes, r["ids"]))) and r["round_trip"]
        assert sorted(r["perturbed"], reverse=True) == r["perturbed"]
        firsts[bytes(r["ids"][0])] += 1
    assert len(firsts) > 5


def test_few_segmentations(pieces):
    sampler = segmentation.Sampler(pieces, ["", "a"], np.array([1, 2], np.uint64))
    paths, outside = sampler.sample(4)
    assert [p.alive.tolist() for p in paths] == [[True, True], [False, True], [False, False], [False, False]]
    assert np.isneginf(outside).all()


def test_pipeline(spark):
    """Every stage against a plain restatement of its decision, on what it was given."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF_DIR).cache())
    raw, good, single, cut, clean, encoded = steps
    assert all(s.schema == docs.schema for s in steps[:-1])

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.learn(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert {i for i, _ in pairs(good)} == {i for i, s in scores.items() if s >= 0.5}

    from tests.llm.test_pairs_and_passages import brute_contaminated, classes, mark_of

    rows = sorted(pairs(good))
    roots = classes([mark_of(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for (i, _), root in zip(rows, roots):
        first.setdefault(root, i)
    assert {i for i, _ in pairs(single)} == set(first.values())

    given, left = pairs(single), dict(pairs(cut))
    seen = Counter(t.encode()[i : i + 200] for _, t in given for i in range(len(t.encode()) - 199))
    for i, t in given:
        x = t.encode()
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert left[i] == bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore")

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    dirty = {i for i, _ in brute_contaminated(pairs(cut), items)}
    assert {i for i, _ in pairs(clean)} == {i for i, _ in pairs(cut)} - dirty

    assert encoded.count() == clean.count() and encoded.where("NOT round_trip").isEmpty()
    final = corpus_pipeline.run(spark, SF_DIR)
    pick = lambda df: sorted(repr((r["doc_id"], r["ids_crc32"])) for r in df.collect())
    assert pick(final) == pick(encoded)


def test_pipeline_stages_on_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
        docs.collect()


def test_passages_cover_the_whole_text():
    values = ["", "a" * 512, "b" * 513, "c d\n" * 4000]
    features, first = quality.passages(
        Texts(pa.RecordBatch.from_arrays([texts(values)], ["text"]))
    )
    assert np.diff(first).tolist() == [0, 1, 2, 32] and np.isfinite(features).all()
