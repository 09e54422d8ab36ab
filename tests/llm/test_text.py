"""Quality rules, classifier, BPE, decontamination, Jaccard join and HTML extraction against brute force."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llmkit import SF, documents

from aquila.llm import bpe, decontamination, html_extraction, jaccard_join, quality_classifier, quality_rules
from aquila.llm.components import components
from aquila.llm.text import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(text, n):
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - n + 1):
        at[tuple(w[i : i + n])].append(i)
    inside = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + n)}
    return len(inside), sum(len(w[k]) for k in inside)


def test_quality_rules(spark, prose):
    texts = [*prose, "a b c\na b c\n \n \na b c", "é## $5 <x> | é##", "x y z " * 40 + "end"]
    got = {r["doc_id"]: r for r in quality_rules.rule_quality(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, r = t or "", got[i]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        repeats = [x for k, x in enumerate(lines) if x in lines[:k]]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(repeats), covered(t, 3)[0])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (len(w) < 50 or 100 * want[4] > 50 * len(w))
        chars = {n: covered(t, n)[1] for n in quality_rules.MOST_REPEATED}
        assert [r[f"chars_{n}"] for n in chars] == list(chars.values())
        in_lines = sum(len("".join(WORD.findall(x))) for x in repeats)
        good = in_lines <= quality_rules.MOST_IN_LINES * want[1] and all(chars[n] <= m * want[1] for n, m in quality_rules.MOST_REPEATED.items())
        assert r["kept"] == (good and not r["base_failed"])
    assert quality_rules.rule_quality(documents(spark, texts).limit(0)).collect() == []


def test_each_quality_rule_decides():
    """For each rule a text that it alone rejects."""
    own = lambda k: f"u{k:03}"
    texts = {}
    for n, times, alone in ((3, 14, 66), (5, 8, 80), (8, 4, 74), (12, 2, 76)):
        same, apart = " ".join(f"r{k:03}" for k in range(n)), alone // times
        texts[n] = " ".join(" ".join([same, *(own(i * apart + k) for k in range(apart))]) for i in range(times))
    texts["lines"] = "\n".join(f"r000 r001\n{own(3 * i)} {own(3 * i + 1)} {own(3 * i + 2)}" for i in range(20))
    m = quality_rules.measure(list(texts.values()))
    for i, rule in enumerate(texts):
        broken = {n for n, most in quality_rules.MOST_REPEATED.items() if m[f"chars_{n}"][i] > most * m["word_chars"][i]}
        broken |= {"lines"} if m["dup_line_chars"][i] > quality_rules.MOST_IN_LINES * m["word_chars"][i] else set()
        assert broken == {rule} and m["n_words"][i] >= 50 and 2 * m["n_repeat_words"][i] <= m["n_words"][i]


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_classifier.score_quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    truth = [(r["quality"], got[r["doc_id"]]) for r in labels.collect()]
    assert np.mean([r["predicted"] == q for q, r in truth if not r["held_out"]]) > 0.95
    held = [(q, r) for q, r in truth if r["held_out"]]
    assert np.mean([r["predicted"] == q for q, r in held]) > max(0.9, np.mean([q for q, _ in held]))
    order = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for q, a in held if q for p, b in held if not p]
    assert np.mean(order) > 0.95  # the area under the curve
    again = {r["doc_id"]: r["score"] for r in quality_classifier.score_quality(docs.repartition(3), labels).collect()}
    assert max(abs(again[i] - got[i]["score"]) for i in got) < 1e-6
    kept = {r["doc_id"] for r in quality_classifier.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}


def test_classifier_edges(spark):
    docs = documents(spark, ["a b", None, "", (None, "c"), (0, "a b"), "x " * 50_000])
    no_labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, quality int")
    got = quality_classifier.score_quality(docs, no_labels).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {0.5}
    assert quality_classifier.score_quality(docs.limit(0), no_labels).collect() == []


def test_word_vectors_and_pooling_against_brute_force(spark, prose):
    texts = [*prose, "Ab12!! Ab12!! é x" * 3, "same " * 30_000]
    places, rows = quality_classifier.index_vectors(), quality_classifier.rows_of
    want = np.zeros((quality_classifier.ROWS, quality_classifier.DIM), np.int64)

    def meet(a, b):
        for x, y in ((a, b), (b, a)):
            for place in places[y]:
                want[x, place >> 1] += -1 if place & 1 else 1

    for t in texts:
        coded = [rows(w) for w in (t or "").encode().split()]
        for word, form in coded:
            meet(word, form)
        for (word, form), (next_word, next_form) in zip(coded, coded[1:]):
            meet(word, next_word), meet(form, next_form), meet(form, next_word)
    want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    vectors = quality_classifier.count_contexts(documents(spark, texts).repartition(3))
    assert np.allclose(vectors, want, atol=1e-6)
    got = quality_classifier.pool(pa.array(texts), vectors)
    for t, x in zip(texts, got):
        own = np.array([vectors[k] for w in (t or "").encode().split() for k in rows(w)], np.float64)
        if len(own):
            assert np.allclose(x[:-1], [*own.mean(0), *own.std(0), np.log1p(len(own))], atol=1e-4)
        else:
            assert not x.any()


def test_shapes():
    assert quality_classifier.shape(b"Ab12!!") == b"Aa0!!" and quality_classifier.shape("éé-".encode() * 40) == b"a-" * 40


def test_classifier_memory_on_long_texts():
    """A text of 50 MB, and many short ones, take a bounded amount beyond themselves."""
    vectors = np.zeros((quality_classifier.ROWS, quality_classifier.DIM), np.float32)
    places, total = quality_classifier.index_vectors(), np.zeros(quality_classifier.ROWS * 2 * quality_classifier.DIM, np.int64)
    for texts in (pa.array(["Some words, and 12 more of them " * 1_600_000]), pa.array(["some words and more " * 20] * 10_000)):
        tracemalloc.start()
        quality_classifier.pool(texts, vectors)
        quality_classifier.add_contexts(total, places, texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100e6


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 4))
    y = (r.random(4000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    s = quality_classifier.train(x, y).scores(x)
    assert abs(s[s > 0.7].mean() - y[s > 0.7].mean()) < 0.06


def encoding():
    import public_tokenizers
    import tiktoken

    own = bpe.codec(*bpe.default_vocabulary())
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_against_library(spark, prose):
    own, library = encoding()
    r = random.Random(1)
    odd = ["".join(r.choice("abcäß 字🙂\n\t'!1 \x85²\x1c") for _ in range(r.randrange(300))) for _ in range(200)]
    texts = [*prose, *odd, "a" * 3000, "字" * 300, "x'll don't " + "ab" * 200, "<|endoftext|>"]
    got = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, texts)).collect()}
    sha = lambda s: hashlib.sha256(s).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert tuple(got[i]) == (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    encoded = bpe.encode(documents(spark, texts[:30]))
    assert [list(r["ids"]) for r in encoded.orderBy("doc_id").collect()] == [library.encode_ordinary(t or "") for t in texts[:30]]
    assert [bytes(r["bytes"]).decode() for r in bpe.decode(encoded).orderBy("doc_id").collect()] == [t or "" for t in texts[:30]]
    assert bpe.round_trip(documents(spark, texts).limit(0)).collect() == []


def test_bpe_forgets_without_harm(monkeypatch):
    own, library = encoding()
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for t in ("some words here", "other words there", "some words again and again"):
        assert own.ids(own.encode([t])[0]) == library.encode_ordinary(t)


def edit(item, rate, r, vocabulary):
    out = list(item)
    for _ in range(int(rate * len(item))):
        k, what = r.randrange(len(out)), r.random()
        if what < 0.6:
            out[k] = r.choice(vocabulary)
        elif what < 0.8:
            del out[k]
        else:
            out.insert(k, r.choice(vocabulary))
    return out


def distance(item, words):
    """Least edits of the item to any run of the words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_and_recall(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["the"] * 60
    items = [[r.choice(vocabulary) for _ in range(r.randint(12, 50))] for _ in range(20)]
    texts, planted = [], []
    for n in range(240):
        around = [r.choice(vocabulary) for _ in range(80)]
        k, rate = r.randrange(20), r.choice([0, 0, 0.05, 0.1, 0.15])
        if n % 4 == 0:
            texts.append(" ".join(around))
        else:
            texts.append(" ".join([*around[:40], *edit(items[k], rate, r, vocabulary), *around[40:]]).upper())
            planted.append((n, k))
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None), (98, " ")], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontamination.find_leaks(documents(spark, texts), benchmark).collect()}
    true = {(i, k): d for i, t in enumerate(texts) for k, x in enumerate(items) if (d := distance([w.lower() for w in x], [w.lower() for w in t.split()])) <= decontamination.EDITS * len(x)}
    assert set(got) <= set(true) and all(got[k]["distance"] == true[k] for k in got)  # nothing false
    assert {k for k, d in true.items() if d == 0} <= set(got)  # copies always
    assert len(got) >= 0.95 * len(true)
    for (i, k), x in got.items():
        run = [w.lower() for w in texts[i].split()[x["start_word"] : x["end_word"]]]
        assert distance([w.lower() for w in items[k]], run) == x["distance"]
    blocks = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontamination.find_leaks(documents(spark, texts), benchmark, block_words=200).collect()}
    assert set(blocks) <= set(true) and len(blocks) >= 0.95 * len(true)
    clean = {x["doc_id"] for x in decontamination.keep_clean(documents(spark, texts), benchmark).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in got}


def test_leaks_at_the_bound():
    """All items at the full share of edits, and those of which the first word is edited, are found."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[r.choice(vocabulary) for _ in range(m)] for m in (7, 30, 45, 59) for _ in range(5)]
    unknown = vocabulary[:200] + [f"u{i}" for i in range(400)]
    texts = []
    for item in items * 8:
        texts.append(edit(item, 0.2, r, unknown))
        texts.append(["changed", *edit(item[1:], 0.1, r, unknown)])
    texts = [[*r.choices(vocabulary, k=30), *t, *r.choices(vocabulary, k=30)] for t in texts]
    searcher = decontamination.Searcher([(i, [w.encode() for w in x]) for i, x in enumerate(items)])
    got = {(row, item): d for row, item, d, *_ in searcher.search([" ".join(t) for t in texts])}
    true = {(i, k): d for i, t in enumerate(texts) for k, x in enumerate(items) if len(set(x) & set(t)) >= 0.5 * len(set(x)) and (d := distance(x, t)) <= decontamination.EDITS * len(x)}
    assert len(true) >= len(texts) - 40 and got == true


@pytest.mark.parametrize("kind", ["replace", "delete", "insert"])
def test_recall_at_the_bound_by_kind(kind):
    """At int(EDITS * m) edits of one kind, of items of 5 to 60 words, at least 0.98 are found."""
    r = random.Random(kind)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [[r.choice(vocabulary) for _ in range(m)] for m in range(5, 61) for _ in range(4)]
    searcher = decontamination.Searcher([(i, [w.encode() for w in x]) for i, x in enumerate(items)])
    texts = []
    for item in items:
        out = list(item)
        for _ in range(int(decontamination.EDITS * len(item))):
            k, word = r.randrange(len(out)), r.choice([r.choice(vocabulary), f"own{r.random()}"])
            out[k : k + (kind != "insert")] = [] if kind == "delete" else [word]
        texts.append(" ".join([*r.choices(vocabulary, k=20), *out, *r.choices(vocabulary, k=20)]))
    got = {(row, item) for row, item, *_ in searcher.search(texts)}
    assert sum((i, i) in got for i in range(len(items))) >= 0.98 * len(items)


def test_candidates_come_from_agreeing_walks():
    """Each candidate's window and the item's give the same words at the sampled steps of some walk."""
    r = random.Random(9)
    items = [[b"w%d" % r.randrange(60) for _ in range(m)] for m in (3, 6, 9, 20, 40)]
    searcher = decontamination.Searcher(list(enumerate(items)))
    flat = np.array([*(searcher.ids[w] for x in items for w in [*x[:-2], b"w0" if b"w0" in searcher.ids else x[0], x[-1]]), searcher.pad], np.int32)

    def sample(words, start, width, steps, coins):
        at, out = start, []
        for t in range(steps[-1] + 1):
            word = words[at] if at < len(words) and not (width and at - start >= width) else searcher.pad
            if t in steps:
                out.append(word)
            at += int(coins[word]) >> t & 1
        return out

    want = set()
    for width, steps, coins, _, _, owners in searcher.walks:
        own = [(k, o, sample(searcher.coded[k], o, width, steps, coins)) for k, o in owners.tolist()]
        for at in range(len(flat) - 1):
            here = sample(flat, at, width, steps, coins)
            want |= {(at, at - o, k) for k, o, x in own if x == here}
    assert want and set(map(tuple, searcher.candidates(flat).tolist())) == want


def test_leak_edges(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma"), (1, "delta epsilon zeta eta theta"), (None, "nulls have no id here"), (3, "alpha")], "item_id bigint, text string")
    texts = [None, "", "x alpha beta gamma y", "delta EPSILON zeta eta theta", (None, "alpha beta gamma"), "alphabet", (2, "alpha beta gamma")]
    got = sorted((str(x["doc_id"]), x["item_id"], x["distance"], x["start_word"], x["end_word"]) for x in decontamination.find_leaks(documents(spark, texts), benchmark).collect())
    assert got == [("2", 1, 0, 0, 3), ("2", 1, 0, 1, 4), ("2", 3, 0, 0, 1), ("2", 3, 0, 1, 2), ("3", 1, 0, 0, 5), ("None", 1, 0, 0, 3), ("None", 3, 0, 0, 1)]
    assert decontamination.find_leaks(documents(spark, texts), benchmark.limit(0)).collect() == []
    assert decontamination.find_leaks(documents(spark, texts).limit(0), benchmark).collect() == []


def brute_groups(rows, n, num, den):
    sets = [frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset()) for w in (words_of(t) for _, t in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return sorted(((d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_groups(spark, prose, n, num):
    rows = [*enumerate(prose), (5, "a repeated id"), (5, "a repeated id"), (None, "nobody has this"), (None, prose[0])]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_groups(documents(spark, rows), n=n, num=num).collect()), key=str)
    assert got == brute_groups(rows, n, num, 100)


def test_jaccard_edges(spark):
    for texts in ([], [None, "", " "], ["a", "A", "b"]):
        got = sorted(tuple(r) for r in jaccard_join.jaccard_groups(documents(spark, texts), n=3, num=90).collect())
        assert got == brute_groups(list(enumerate(texts)), 3, 90, 100)
    one = jaccard_join.keep_one(documents(spark, ["same words in this text here", "same words in this text here", None, (None, "x"), (2, None)]))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in one.collect()) == [("0", "same words in this text here"), ("2", "None"), ("None", "x")]


def test_jaccard_links_of_one_shared_entry(spark):
    """1000 copies choose a long prefix, longer texts with rare words of their own a short one, which shares little with it."""
    words = [f"w{i}" for i in range(92)]
    longer = [(1000 + k, " ".join([*words, *(f"own{k}x{i}" for i in range(k))])) for k in range(7, 13)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(documents(spark, [" ".join(words)] * 1000 + longer), n=3, num=90).collect()}
    assert got == {i: 0 if i < 1011 else i for i in [*range(1000), *(d for d, _ in longer)]}
    for k in (7, 10):  # one alone, without others to bridge
        rows = [*((i, " ".join(words)) for i in range(1000)), longer[k - 7]]
        assert {r["component_id"] for r in jaccard_join.jaccard_groups(documents(spark, rows), n=3, num=90).collect()} == {0}


def test_jaccard_group_of_2000_near_copies(spark, monkeypatch):
    """Two families of edited copies: the components of brute force, from a few pairs for each text and not their square.
    All pairs that are compared share as many prefix entries as linked texts do."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    bases = [r.choices(words, k=150), r.choices(words, k=150)]
    bases[1][:70] = bases[0][:70]
    texts = []
    for k in range(2000):
        w = list(bases[k % 2 and r.random() < 0.5])
        for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6, 9])):
            w[r.randrange(150)] = r.choice(words)
        if k % 9 == 0:  # copies of a copy
            w = texts[r.randrange(len(texts))].split() if texts else w
            w[r.randrange(150)] = f"own{k}"
        texts.append(" ".join(w))
    seen = {}

    def spy(df, name, keep=jaccard_join.written):
        out = keep(df, name)
        if name in ("pairs", "promising", "heads"):
            seen.setdefault(name, []).extend(map(tuple, out.collect()))
        return out

    monkeypatch.setattr(jaccard_join, "written", spy)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_groups(documents(spark, texts), n=3, num=90).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(148)} for w in map(str.split, texts)]
    place = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(place)), np.float32)
    for i, own in enumerate(sets):
        held[i, [place[s] for s in own]] = 1
    both, size = held @ held.T, held.sum(1)
    linked = 100 * both >= 90 * (size[:, None] + size - both)
    want = np.arange(len(sets))
    while (new := np.where(linked, want[None], len(sets)).min(1)).tolist() != want.tolist():
        want = new
    assert got == dict(enumerate(want.tolist())) and 100 < len(set(want.tolist())) < 1500
    assert 0 < len(seen["pairs"]) < jaccard_join.SHORT * len(texts)
    heads = {node: (size, prefix, set(head)) for node, size, prefix, head in seen["heads"]}
    for a, b in seen["promising"]:
        (sa, pa, ha), (sb, pb, hb) = heads[a], heads[b]
        assert len(ha & hb) >= min(pa - sa, pb - sb) - (-90 * (sa + sb) // 190)


def test_jaccard_group_of_far_copies(spark, monkeypatch):
    """Texts of shared blocks, most too far from each other to be linked: a text is set against few pivots, though it is in many
    long lists, and the components are those of brute force."""
    r = random.Random(5)
    blocks = [[" ".join(f"b{k}v{v}w{i}" for i in range(r.randint(15, 25))) for v in range(3)] for k in range(12)]
    picks = [[r.randrange(3) for _ in blocks] for _ in range(40)]
    while len(picks) < 400:
        pick = list(r.choice(picks))
        for _ in range(r.choice([1, 2, 2, 3, 4])):
            pick[r.randrange(12)] = r.choice([0, 0, 1, 2, None])
        picks.append(pick)
    texts = [" ".join(b[v] for b, v in zip(blocks, pick) if v is not None) for pick in picks]
    read = []

    def spy(df, name, keep=jaccard_join.written):
        out = keep(df, name)
        if name == "differences":
            read.append([x["node"] for x in out.select("node").collect()])
        return out

    monkeypatch.setattr(jaccard_join, "written", spy)
    rows = list(enumerate(texts))
    got = sorted((tuple(x) for x in jaccard_join.jaccard_groups(documents(spark, rows), n=5, num=80).collect()), key=str)
    assert got == brute_groups(rows, 5, 80, 100) and 50 < len({c for _, _, c in got}) < 350
    assert len(set(read[0])) > 100 and all(len(x) <= 5 * len(set(x)) for x in read)


def test_jaccard_null_ids_bridge(spark):
    """A text that only rows without a doc_id hold links two others."""
    words = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join([*(f"x{j}" for j in range(3 * i)), *words[3 * i :]])) for i in (0, 1, 2)]
    rows = [texts[0], (None, texts[1][1]), (None, texts[1][1]), texts[2]]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_groups(documents(spark, rows), n=3, num=90).collect()), key=str)
    assert got == brute_groups(rows, 3, 90, 100) and got[0][2] == got[1][2] == 0


def test_prefixes_keep_all_links():
    """Prefixes of any two linked sets share as many shingles as the filter asks for, whatever each has chosen."""
    r = random.Random(2)
    for _ in range(300):
        a = set(r.sample(range(10**6), r.randint(5, 60)))
        b = {x if r.random() > 0.04 else r.randrange(10**6) for x in a}
        if 100 * len(a & b) < 90 * len(a | b):
            continue
        prefix = {}
        for name, s in (("a", a), ("b", b)):
            base = len(s) - jaccard_join.least_shared(len(s), 90, 100)
            prefix[name] = sorted(s)[: min(len(s), base + r.randint(1, jaccard_join.MOST))]
        need = min(len(prefix["a"]) - len(a), len(prefix["b"]) - len(b)) + -(-90 * (len(a) + len(b)) // 190)
        assert len(set(prefix["a"]) & set(prefix["b"])) >= need


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(45)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everyone does. Read more about it.</p><button>Ok</button></div><!-- <p>hidden</p> --><article><h1>Head &amp; line</h1><p><b>First   words&nbsp;here.<br><p>Second one, which is
longer than the first.</p><div class="ad">Buy this now. It is cheap.</div><ul><li>An item of it.</li></ul><p>Last &lt;one&gt;.</article><section id="comments"><h3>Comments</h3><p>I think that this is a fine text. Thanks.</p></section>
<aside><h3>More</h3><p>Something else to read.</p></aside><form><label>Mail</label><input></form><footer>&copy; Site &middot; All rights. Read them.</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\nFirst words here.\nSecond one, which is longer than the first.\nAn item of it.\nLast <one>."
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (4, "w", "<article><p>cut off in the mid"), (5, "x", "<p" * 1000), (6, "y", "plain < text & no markup"), (7, "z", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    df = html_extraction.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text"))
    got = {(r["page_id"], r["url"]): r for r in df.collect()}
    assert df.count() == len(rows)
    assert got[1, "u"]["text"] == want and got[1, "u"]["n_chars"] == len(want)
    assert got[2, None]["text"] == "" and got[None, "v"]["n_chars"] == 0 and got[4, "w"]["text"] == "cut off in the mid"
    assert html_extraction.main_text(df.selectExpr("page_id", "url", "text AS html").limit(0)).collect() == []


def test_deep_pages_take_linear_time():
    """Nested, unclosed and inline elements by tens of thousands."""
    model = html_extraction.default_model()
    for source in ("<div>" * 40_000 + "deep", "<b>" * 20_000 + "<div>x</div>" * 20_000, "<div>" * 20_000 + "<li>y" * 20_000, "<div>" * 20_000 + "</section>" * 40_000, "<a href=x>" * 20_000 + "<p>z" * 20_000):
        begun = time.process_time()
        page = html_extraction.parse(source)
        assert len(model.content([page])[0]) == len(page.tag) and time.process_time() - begun < 6


def test_messages_are_exact():
    """Marginals of a small tree against all its states."""
    r = np.random.default_rng(3)
    parent = np.array([-1, 0, 0, 1, 1, 3])
    unary, pair = r.normal(size=(6, 2)), r.normal(size=(6, 2, 2))
    weight = np.zeros((6, 2))
    for state in np.ndindex(*[2] * 6):
        w = np.exp(sum(unary[i, s] for i, s in enumerate(state)) + sum(pair[i, state[parent[i]], s] for i, s in enumerate(state) if i))
        for i, s in enumerate(state):
            weight[i, s] += w
    belief, _ = html_extraction.marginals(unary, parent, pair, html_extraction.depths(parent))
    assert np.allclose(np.exp(belief), weight / weight.sum(1, keepdims=True))


def test_held_out_layouts():
    from aquila.llm.html_pages import labelled_pages

    model, right, all_ = html_extraction.default_model(), 0, 0
    for source in labelled_pages(60, seed=77):
        page = html_extraction.parse(source)
        y = [0] * len(page.tag)
        for i in range(1, len(y)):
            m = re.search(r'data-y="([01])"', page.attrs[i])
            y[i] = int(m[1]) if m else y[page.parent[i]]
        content = model.content([page])[0] >= 0.5
        right += sum(content[k] == y[k] for k, _ in page.segments)
        all_ += len(page.segments)
    assert right / all_ > 0.97
