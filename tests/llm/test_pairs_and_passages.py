"""SimHash components, repeated passages, decontamination, licences: against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import PASSAGE, frame, pairs
from trendgap.llm import decontamination, licenses, simhash, suffixes
from trendgap.llm.common import stored


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def mark_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", small(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(nodes))]


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    rows = pairs(df)
    marks = [mark_of(t) for _, t in rows]
    roots = classes(marks, lambda a, b: (a ^ b).bit_count() <= 2)
    smallest = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            smallest[root] = min(i, smallest.get(root, i))
    want = [(i, f"{m:016x}", smallest.get(r)) for (i, _), m, r in zip(rows, marks, roots)]
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_links_of_near_marks(spark):
    random.seed(9)
    marks = set()
    for _ in range(40):  # chains and clouds around random centres
        m = random.getrandbits(64)
        for _ in range(25):
            marks.add(m)
            if random.random() < 0.5:
                for b in random.sample(range(64), random.choice([1, 2, 3])):
                    m ^= 1 << b
    marks = sorted(marks)
    roots = classes(marks, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for m, r in zip(marks, roots):
        groups.setdefault(r, set()).add(m - (1 << 64) if m >> 63 else m)
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "mark bigint")
    found = simhash.links(df)
    assert found.where("bits_apart > 2 OR shared_bytes < 6 OR a = b").isEmpty()
    got = {}
    for r in simhash.components(found).collect():
        got.setdefault(r["root"], {r["root"]}).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_a_posting_is_searched_without_pairing():
    # All values of the two free bytes: one component, one link for each member but one.
    marks = np.arange(1 << 16, dtype=np.int64)
    choice = simhash.POSTINGS.index((2, 3, 4, 5, 6, 7))
    assert len(simhash.links_within(choice, marks)) == (1 << 16) - 1


def test_one_of_each(spark, odd, nothing):
    kept = simhash.one_of_each(odd)
    assert kept.schema == odd.schema
    given = pairs(odd)
    roots = classes([mark_of(t) for _, t in given], lambda a, b: (a ^ b).bit_count() <= 2)
    best = {}
    for (i, _), root in zip(given, roots):
        best[root] = min(best.get(root, (True, 0)), (i is None, i or 0))
    want = sorted(None if gone else i for gone, i in best.values() if not gone)
    assert sorted(i for i, _ in pairs(kept) if i is not None) == want
    assert kept.count() == len(best)
    assert simhash.one_of_each(nothing).isEmpty()


def brute_repeats(rows, length):
    seen = {}
    raw = [t.encode() for _, t in rows]
    for x in raw:
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc_id, _), x in zip(rows, raw):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_repeated_passages(request, table):
    df = request.getfixturevalue(table)
    want = sorted(map(repr, brute_repeats(pairs(df), 200)))
    assert digest(suffixes.remove_repeats(df)) == want


@pytest.mark.parametrize("seed", range(4))
def test_repeated_passages_in_dense_text(spark, seed):
    # Short alphabet, short strings: overlaps, periods, partial matches on either side.
    rng = random.Random(seed)
    base = ["".join(rng.choices("ab" if seed % 2 else "abcd", k=rng.randint(0, 90))) for _ in range(12)]
    rows = []
    for k in range(60):
        a, b = rng.choice(base), rng.choice(base)
        rows.append((k, a[rng.randint(0, 30) :] + rng.choice(["", "é", "x"]) + b[: rng.randint(0, 80)]))
    df = frame(spark, rows).repartition(4)
    found = suffixes.remove_repeats(df, length=24, gram=10, cell=4)
    assert digest(found) == sorted(map(repr, brute_repeats(rows, 24)))


def test_repeated_blocks_are_not_looked_up_by_what_they_share(spark, monkeypatch):
    """Blocks 0 to 39 share an inner string, 0 to 29 the outer one too; 50 and 51 are equal."""
    rows = [(7, 1 if k < 30 else k, k, k % 5) for k in range(40)] + [(8, 3, 50, 0), (8, 3, 51, 0), (9, 4, 60, 0)]
    plans = []
    monkeypatch.setattr(
        suffixes, "stored",
        lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), stored(df, label))[1],
    )
    repeated, still_open = suffixes.judge(spark.createDataFrame(rows, suffixes.BLOCK), "test")
    assert sorted(map(tuple, repeated.collect())) == [(k, k % 5) for k in range(30)] + [(50, 0), (51, 0)]
    left = sorted(r["row"] for r in still_open.collect())
    assert left[0] < 30 and left[1:] == list(range(30, 40))
    assert not any("outer#" in line for plan in plans for line in plan.splitlines() if "Join" in line)


def test_texts_without_repeats_keep_their_columns(spark, odd, nothing):
    left = suffixes.without_repeats(odd)
    assert left.schema == odd.schema and left.count() == odd.count()
    texts = dict(r for r in pairs(left) if r[0] not in (None, 6))
    assert texts[11] == texts[12] == "" and texts[1] == "Released under the MIT License."
    assert texts[2] == "Something else first:And a different end."
    assert left.where("doc_id = 3").first()["text"] is None
    assert left.where("n_chars <> length(text)").isEmpty()
    assert suffixes.without_repeats(nothing).isEmpty()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text))


def brute_contaminated(rows, items):
    out = set()
    for i, t in rows:
        w = words(t)
        for k, x in items:
            own = words(x or "")
            n = min(12, len(own))
            need = 10 if n == 12 else n
            if n and any(
                sum(p == q for p, q in zip(w[a : a + n], own[b : b + n])) >= need
                for a in range(len(w) - n + 1)
                for b in range(len(own) - n + 1)
            ):
                out.add((i, k))
    return out


ITEMS = "item_id bigint, text string, doc_id bigint"


@pytest.mark.parametrize("block_words", [10_000, 40])
def test_decontamination(spark, block_words):
    rng = random.Random(3)
    letters = "a b c d e f g h".split()
    sizes = [0, 1, 2, 5, 6, 6, 9, 11, 12, 13, 20, 20]
    items = [(k, " ".join(rng.choices(letters, k=n)), 1) for k, n in enumerate(sizes)] + [(90, None, 1)]
    rows = [(k, " ".join(rng.choices(letters, k=rng.randint(0, 60)))) for k in range(30)]
    for k, (_, text, _) in enumerate(items[:-1]):
        w = words(text)
        for changed in range(4):
            v = w.copy()
            for at in rng.sample(range(len(v)), min(changed, len(v))):
                v[at] = "ZZ"
            rows.append((100 + 10 * k + changed, " ".join(["q", *v, "r"])))
    df = frame(spark, rows)
    found = decontamination.contaminated(df, spark.createDataFrame(items, ITEMS), block_words)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == brute_contaminated(rows, [i[:2] for i in items])
    clean = decontamination.clean(df, spark.createDataFrame(items, ITEMS), block_words)
    assert clean.schema == df.schema
    assert {i for i, _ in pairs(clean)} == {i for i, _ in rows} - {i for i, _ in got}


def test_decontamination_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, PASSAGE, 0), (1, PASSAGE, 0), (None, "same row", 0)], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd, items).collect()]
    assert sorted(map(str, got)) == sorted(
        map(str, [(i, 1) for i in (1, 2, None, 11, 12) for _ in range(2)] + [(6, None)] * 2)
    )
    assert decontamination.contaminated(odd, none).isEmpty()
    assert decontamination.contaminated(nothing, items).isEmpty()
    assert decontamination.clean(odd, none).count() == odd.count()


def test_contaminated_documents_of_the_test_data(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    whole = {(i, k) for i, t in pairs(documents) for k, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(documents, benchmark).collect()}
    assert whole <= got


def base_columns(rows):
    out = []
    for i, t in rows:
        w, places, labels = words(t), [], set()
        for phrase, label in licenses.BASE_PHRASES:
            p = phrase.split()
            hits = [a for a in range(len(w)) if w[a : a + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(labels))))
    return sorted(map(repr, out))


def test_license_phrases(spark, odd, documents, nothing):
    more = frame(spark, [
        (1, "under the MIT license under the mit license, CC by-NC!"), (2, "cc by nc by nc"),
        (3, "Apache License, Version 2.0"), (4, "apache license version 20"), (5, "ünder the mit license"),
    ])
    for df in (odd, documents, nothing, more):
        found = licenses.license_scan(df)
        base = found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert sorted(repr(tuple(r)) for r in base.collect()) == base_columns(pairs(df))
        for r in found.collect():
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
            assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_templates(spark):
    mit = licenses.TEMPLATES[0].text
    worn = mit.replace("documentation ", "").replace("distribute", "hand out")
    rows = [
        (1, "header words " + mit + " tail"), (2, worn), (3, " ".join(sorted(mit.split()))),
        (4, "This is licensed under the GNU General Public License, version 3."), (5, "the license of it"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1
    assert got[2]["labels"] == "mit" and 0.7 < got[2]["score"] < 1
    assert got[3]["labels"] == got[5]["labels"] == "" and got[4]["labels"] == "gpl-3"


def brute_labels(text, votes=4, slack=3):
    """Every template at every place, all of its words counted."""
    w, out = words(text), set()
    for template in licenses.TEMPLATES:
        own = words(template.text)
        for shift in range(-len(own), len(w) + 1):
            voters = {
                x for p, x in enumerate(own)
                if any(0 <= p + shift + d < len(w) and w[p + shift + d] == x for d in range(slack + 1))
            }
            part = " ".join(w[max(0, shift - slack) : max(0, shift + len(own) + slack)])
            if len(voters) >= min(votes, len(set(own))) and all(
                f" {' '.join(words(m))} " in f" {part} " for m in template.mandatory
            ):
                out.add(template.label)
    return out | {label for phrase, label in licenses.BASE_PHRASES if f" {phrase} " in f" {' '.join(w)} "}


def test_several_licenses_in_one_text(spark):
    rng, texts = random.Random(5), [t.text for t in licenses.TEMPLATES]
    vocabulary = [w.decode() for w in licenses.template_words(licenses.TEMPLATES)]
    rows = [(0, " ".join(texts))]
    rows += [(k, texts[0] + " and then " + t) for k, t in enumerate(texts, 1)]
    for k in range(20, 30):  # every template word is in the text, templates are worn
        some = [" ".join(w for w in t.split() if rng.random() < 0.97) for t in rng.sample(texts, 3)]
        rows.append((k, " ".join([*rng.choices(vocabulary, k=400), *some, *rng.choices(vocabulary, k=400)])))
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert got == {i: brute_labels(t) for i, t in rows}
    assert got[0] == {t.label for t in licenses.TEMPLATES}


def brute_score(text, idf, slack=3):
    """The best score over all places with enough votes and all mandatory phrases."""
    w, best = words(text), 0.0
    for template in licenses.TEMPLATES:
        own = words(template.text)
        total = sum(idf[x] for x in own)
        for shift in range(-len(own), len(w)):
            near = [
                any(0 <= p + shift + d < len(w) and w[p + shift + d] == x for d in range(slack + 1))
                for p, x in enumerate(own)
            ]
            if len({x for x, hit in zip(own, near) if hit}) < min(4, len(set(own))):
                continue
            part = " ".join(w[max(0, shift - slack) : max(0, shift + len(own) + slack)])
            if all(f" {' '.join(words(m))} " in f" {part} " for m in template.mandatory):
                kept = sum(
                    idf[x] for p, x in enumerate(own)
                    if x in w[max(0, p + shift - slack) : max(0, p + shift + slack + 1)]
                )
                best = max(best, kept / total)
    return max(best, licenses.BASE_SCORE if any(p in " ".join(w) for p, _ in licenses.BASE_PHRASES) else 0)


def test_license_scores(spark):
    rng, texts = random.Random(8), [t.text for t in licenses.TEMPLATES]
    rows = [(k, "some words " + " ".join(w for w in t.split() if rng.random() < 0.9) + " more") for k, t in enumerate(texts)]
    rows += [(90, "no licence at all"), (91, ""), (92, texts[-1] + " " + texts[2])]
    df = frame(spark, rows)
    idf = {w.decode(): x for w, x in licenses.inverse_document_frequencies(df).items()}
    got = {r["doc_id"]: r["score"] for r in licenses.license_scan(df).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(brute_score(text, idf)), i
    assert got[92] == 1


def test_license_in_a_very_long_text(spark):
    """Over several chunks long, with every common word of the templates all over it."""
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choices(["the", "of", "to", "and", "software", "xyz", "license"], k=n))
    mit, bsd = licenses.TEMPLATES[0].text, licenses.TEMPLATES[4].text
    long = f"{noise(200_000)} {mit} {noise(300_000)} {bsd} {noise(100_000)}"
    assert len(long) > 2_500_000
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, [(1, long), (2, noise(50_000)), (3, None)])).collect()}
    assert got[1]["labels"] == "bsd,mit" and got[1]["score"] == 1 and got[1]["n_words"] == len(long.split()) + 1
    assert got[2]["labels"] == got[3]["labels"] == ""


def test_license_phrase_longer_than_the_text():
    template = licenses.Template("x", "so so so long so so", ("so so so",))
    index = licenses.Index((template,), {b"so": 1.0, b"long": 2.0}, 1, 3)
    assert index.find([b"so"]) == index.find([b"so", b"long"]) == index.find([]) == {}
    assert index.find([b"so"] * 3 + [b"long"]) != {}
