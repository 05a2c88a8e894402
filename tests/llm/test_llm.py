"""The training-data operators against brute force, and their edge cases."""

import base64
import hashlib
import itertools
import os
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from perilgrid.llm import chat, common, langid, mixing, pieces, simhash, substring, tokens, vectors, warc

needs_vocabulary = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary")
DOC = "doc_id long, text string, lang string, source string, n_chars long, component_id string, rid string, fp string, size string"


def docs(spark, rows):
    """rows: (doc_id, text[, lang, source]); with columns whose names clash with inner ones."""
    full = [(i, t, x[0] if x else "en", x[1] if len(x) > 1 else "s", None, "x", "y", "z", "w") for i, t, *x in rows]
    return spark.createDataFrame(full, DOC)


def words(rnd, n, k=400):
    return [f"w{rnd.randrange(k)}" for _ in range(n)]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    low = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_simhash(spark):
    rnd = random.Random(1)
    base = [words(rnd, 120) for _ in range(6)]
    rows = [(10 + i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(40):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = "new"
        rows.append((100 + i, " ".join(w)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a b"), (6, "A  b"), (7, "x " * 5000), (10, rows[0][1])]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3]
    low = components(fp, linked)
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows) and len(linked) > 20
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fp[i]:016x}", low[i]) for i in fp}
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_simhash_grid_finds_every_pair(spark):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for x in list(fps):
        for b in rnd.sample(range(64), rnd.randrange(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = [int(x) for x in fps]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    want = components(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert {r["node"]: r["root"] for r in got} == {x: r for x, r in want.items() if list(want.values()).count(r) > 1}


def test_representatives_with_null_and_repeated_ids(spark):
    rnd = random.Random(12)
    t = [" ".join(words(rnd, 60, 5000)) for _ in range(9)]
    rows = [(None, x) for x in t[:4]] + [(None, t[0]), (1, t[4]), (1, t[5], "en", "other"), (1, t[4]), (2, t[5]), (None, t[5]), (3, t[6], "en", None), (0, t[7]), (5, t[7])]
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.representatives(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, x) for x in t[:4]] + [(1, t[4]), (1, t[5]), (3, t[6]), (0, t[7])], key=str)
    assert simhash.representatives(docs(spark, rows).limit(0)).count() == 0


def brute_groups(rows, n=5, least=0.8):
    """Of (doc_id, text) with ids: the smallest id of each group that similar shingle sets connect."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    empty = [i for i in sets if not sets[i]]
    linked += list(zip(empty, empty[1:]))
    return components(list(sets), linked), linked


def test_representatives_of_similar_texts(spark):
    rnd = random.Random(17)
    passage = words(rnd, 90, 5000)  # one that most texts share and that makes no two alike
    rows, n = [], 0
    for _ in range(25):
        base = words(rnd, rnd.randrange(60, 500), 5000) + (passage if rnd.random() < 0.7 else [])
        for _ in range(rnd.randrange(1, 6)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 60)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(900, ""), (901, None), (902, "a b"), (903, "A  B"), (904, "a c"), (905, rows[3][1]), (906, rows[3][1].upper() + "\n")]
    low, linked = brute_groups(rows)
    got = {r["doc_id"] for r in simhash.representatives(docs(spark, rows)).collect()}
    want = {i for i in low if low[i] == i}
    assert want <= got and {905, 906, 901, 903} & got == set()  # nothing goes without a similar text, no copy stays
    gone = sum(low[i] != i for i in low)
    assert gone > 25 and len(got - want) <= 0.1 * gone
    assert {x.name for x in simhash.representatives(docs(spark, rows)).schema} == {x.split()[0] for x in DOC.split(", ")}


def test_representatives_lose_no_similar_pair(spark, monkeypatch):
    rnd = random.Random(23)
    line = words(rnd, 40, 5000)  # frequent shingles
    rows = []
    for _ in range(60):
        base = words(rnd, rnd.randrange(20, 300), 5000) + line * rnd.randrange(2)
        for _ in range(4):
            w = list(base)
            for k in range(rnd.randrange(80), len(w), 75 + rnd.randrange(50)):  # most similarities are near the limit
                w[k] = f"new{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    low, linked = brute_groups(rows)
    want = {i for i in low if low[i] == i}
    assert 30 < len(rows) - len(want) < 170
    assert {r["doc_id"] for r in simhash.representatives(docs(spark, rows)).collect()} == want
    # without any meeting by fingerprints, with frequent shingles, and in small slices
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    assert len(simhash._frequent(docs(spark, rows).selectExpr("cast(doc_id as string) as key", "text"), 5)[0]) >= 36
    known = simhash._frequent(docs(spark, rows).selectExpr("cast(doc_id as string) as key", "text"), 5)
    sets = [np.unique(simhash.shingles(t.encode(), 5)) for _, t in rows]
    held = sorted((int(h), len(x), i) for i, x in enumerate(sets) for h in simhash.rarest(x, 0.8, known).view(np.int64))
    cols = [np.array(c, np.int64) for c in zip(*held)]
    t = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(cols[2])], ["h", "size", "id", "root"])
    monkeypatch.setattr(simhash, "_PAIRS", 7)
    n, least = {}, {}
    for r in simhash._sharing((t.slice(k, 50) for k in range(0, len(held), 50)), 0.8):
        for a, b, times, need in zip(*(c.to_pylist() for c in r.columns)):
            n[a, b], least[a, b] = n.get((a, b), 0) + times, need
    assert all(n[x] >= least[x] >= 1 for x in linked)


def test_rarest_shingles_are_counted_in_lists():
    rnd = random.Random(5)
    base = words(rnd, 60)
    sets = []
    for _ in range(80):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(60)] = f"new{rnd.randrange(10**6)}"
        sets.append(np.unique(simhash.shingles(" ".join(w).encode(), 5)))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held = sorted((int(h), len(x), i, i % 7) for i, x in enumerate(sets) for h in simhash.rarest(x, 0.8, none).view(np.int64))
    t = pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*held)], ["h", "size", "id", "root"])

    def found(share):
        met = simhash._packed(simhash._sharing((t.slice(k, 90) for k in range(0, len(held), 90)), 0.8, share))
        met = pa.Table.from_batches(met).sort_by("a")
        assert met.num_rows < sum(map(len, met.column("b").to_pylist())) / 2  # lists, not a row for each pair
        return {x for b in simhash._enough(iter(met.to_batches(50))) for x in zip(*(c.to_pylist() for c in b.columns))}

    every = found(1)
    assert all((a, b) in every for a, b in itertools.combinations(range(80), 2) if a % 7 != b % 7 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])))
    a, b = (np.array(x) for x in zip(*sorted(every)))
    early = {x for x, take in zip(sorted(every), simhash._chosen(a, b, 4)) if take}
    assert found(4) == early and len(every) / 8 < len(early) < len(every) / 2
    assert (simhash._chosen(a, b, 4) == simhash._chosen(b, a, 4)).all()


def test_a_worker_holds_few_texts_and_no_other_modules_caches():
    texts = ["x" * n for n in (5, 0, 30, 4, 4, 4, 100, 1)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts), pa.array(texts[::-1])], ["i", "x", "y"])
    parts = list(common.text_slices(b, ["x", "y"], 40))
    assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist() and not list(common.text_slices(b.slice(0, 0), ["x"], 40))
    assert all(p.num_rows == 1 or sum(len(v or "") for c in ("x", "y") for v in p.column(c).to_pylist()) <= 40 for p in parts)
    cache = common.kept(lru_cache(lambda x: [x]))
    cache(1)
    list(common.tidied(simhash._packed)(iter([])))
    assert cache.cache_info().currsize == 0
    assert common._kept.pop(cache.__module__) and pieces.__name__ in common._kept


def brute_cut(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring(spark):
    rnd = random.Random(3)
    shared = [words(rnd, n) for n in (50, 51, 49, 120, 300)]
    rows = []
    for i in range(40):
        parts = [words(rnd, rnd.randrange(0, 60), 5000), rnd.choice(shared), words(rnd, rnd.randrange(0, 60), 5000)]
        rows.append((i, "\n".join(" ".join(p) for p in parts)))
    rows += [(40, None), (41, ""), (42, rows[3][1]), (42, rows[3][1]), (43, rows[5][1]), (43, "another text of this number"), (None, rows[3][1]), (44, "la " * 400), (45, "la " * 90), (46, "é ü " * 70)]
    want = sorted(brute_cut(rows), key=str)
    for batches in (1, 3):
        got = substring.dedup(docs(spark, rows), batches=batches, fanout=1).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == want
    assert sum(x[2] for x in want) > 1000
    assert substring.dedup(docs(spark, rows).limit(0)).count() == 0


def test_substring_repeated_inside_a_document(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(0, 80, 2):
        a, b, p, x, y = (words(rnd, n, 5000) for n in (70, 70, 60, 70, 70))
        again = [" ".join(a + p + b)] * 2
        rows += [(i, " ".join(x + p + y)), (i + 1, " ".join(again)), (i + 1, "two " + again[0])]
    want = sorted(brute_cut(rows), key=str)
    for batches in (1, 3):
        got = substring.dedup(docs(spark, rows), batches=batches, fanout=1).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == want
    assert sum(x[2] for x in want) >= 40 * 3 * 60


def test_substring_with_text_ids(spark):
    rnd = random.Random(15)
    shared = words(rnd, 60)
    rows = [(f"d{i:03}", " ".join(words(rnd, 20, 5000) + shared * (i % 3 == 0))) for i in range(30)] + [(None, " ".join(shared))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = substring.dedup(df).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == sorted(brute_cut(rows), key=str)


def test_substring_compacts_by_default(spark, monkeypatch):
    rnd = random.Random(10)
    rows = [(i, " ".join(words(rnd, 60))) for i in range(30)]
    rows += [(40, rows[2][1])]
    merged, compact = [], substring.SubstringIndex.compact
    monkeypatch.setattr(substring.SubstringIndex, "compact", lambda self: (merged.append(len(self.tables)), compact(self)))
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup(docs(spark, rows)).collect()}
    assert merged == [2] and got[40] == 60 and sum(got.values()) == 60


def test_runs_hold_digests_of_their_words():
    rnd = random.Random(4)
    texts = [None, b"", b"one", "\t é  ü\n".encode() * 90, b"la " * 400] + ["\n ".join(words(rnd, n, 30)).encode() for n in (49, 50, 51, 700)]
    seen = set()
    for i, at, n, _, content in zip(*substring.runs_of(texts)):
        span = texts[i].split()[at : at + n + 49]
        assert len(span) == n + 49
        assert content.as_py() == hashlib.blake2b(b" ".join(span), digest_size=16).digest()
        seen.add(int(i))
    assert seen == {i for i, t in enumerate(texts) if len((t or b"").split()) >= 50}


def test_language_id(spark):
    rnd = random.Random(4)
    kinds = {"aa": "ba na ka lo", "bb": "ter sch und ein", "cc": "eau oux ieu tre"}
    rows = []
    for i in range(600):
        lang = rnd.choice(list(kinds))
        rows.append((i, " ".join("".join(rnd.choice(kinds[lang].split()) for _ in range(rnd.randrange(1, 5))) for _ in range(12)), lang))
    rows += [(700, None, "aa"), (701, "", "bb"), (702, "12 34 !!", "cc"), (703, "жжж", "aa"), (None, "bana", "bb"), (704, "tersch", None)]
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows if i is not None and i < 600 and got[i]["held_out"]]
    assert len(held) > 60 and np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.99
    assert [got[i]["lang_pred"] for i in (700, 701, 702)] == ["und"] * 3
    assert got[703]["lang_pred"] in kinds and got[704]["lang_pred"] == "bb" and got[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs(spark, rows).limit(0)).count() == 0


def test_language_backoff_against_a_plain_version(spark):
    """The model's score of a text, computed again from its own counts without its tables."""
    rnd = random.Random(16)
    kinds = {"aa": "ba na ka lo", "bb": "ter sch und ein"}
    make = lambda lang: " ".join("".join(rnd.choice(kinds[lang].split()) for _ in range(rnd.randrange(1, 4))) for _ in range(8))
    train = [(i, make(lang), lang) for i in range(60) for lang in kinds]
    rows = spark.createDataFrame(train, "id long, text string, lang string")
    model = langid.train(rows, docs_per_lang=1000)
    words = {lang: {} for lang in kinds}
    for _, t, lang in train:
        for w in t.split():
            words[lang][w] = words[lang].get(w, 0) + 1
    vocabulary = {w for x in words.values() for w in x}
    grams = {n: {lang: {} for lang in kinds} for n in range(1, 6)}
    for lang, x in words.items():
        for w, k in x.items():
            for n in grams:
                for i in range(len(w) + 3 - n):
                    g = f"<{w}>"[i : i + n]
                    grams[n][lang][g] = grams[n][lang].get(g, 0) + k

    def logp(table, unit, lang):
        units = {u for x in table.values() for u in x}
        return np.log((table[lang].get(unit, 0) + 0.1) / (sum(table[lang].values()) + 0.1 * len(units)))

    def score(word, lang):
        if word in vocabulary:
            return logp(words, word, lang)
        for n in range(5, 0, -1):
            seen = [g for i in range(len(word) + 3 - n) if (g := f"<{word}>"[i : i + n]) in {u for x in grams[n].values() for u in x}]
            if seen:
                return np.mean([logp(grams[n], g, lang) for g in seen])
        return 0.0

    for text in (make("aa"), make("bb"), "banaxx tersch", "zzz nana", "qqq", "unknownword ein kalo loba"):
        want = np.array([sum(score(w, lang) for w in text.split()) for lang in ("aa", "bb")])
        lang, p = model.predict(text, {})
        assert lang == ("aa", "bb")[int(want.argmax())] and abs(p - 1 / np.exp(want - want.max()).sum()) < 1e-9


def test_warc(spark):
    pages = [(1, "http://a b/é", "same"), (2, None, "same"), (3, "u", ""), (4, "u", None), (5, "u", "é" * 9000), (6, "u", "one\r\n\r\ntwo"), (6, "u", "one\r\n\r\ntwo"), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as key")
    got = warc.round_trip(df).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(1, "same", 2), (2, "same", None), (3, None, 4), (4, None, None), (5, pages[4][2], None), (6, pages[5][2], None), (6, pages[5][2], None), (None, "same", 2)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, len((t or "").encode()), digest(t), "revisit" if ref else "response", ref) for i, t, ref in want), key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    for uri in ("/tmp/x", "file:/tmp/x", "file:///tmp/x"):
        assert warc._place(uri)[1] == "/tmp/x"
    assert warc.coalesce([(0, 10), (10, 5), (900, 10), (100_000, 5)], gap=1000, span=1000) == [(0, 910, [0, 1, 2]), (100_000, 100_005, [3])]


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(words(rnd, rnd.randrange(1, 30))), "en", rnd.choice(["a"] * 8 + ["b", "c", None, "é"])) for i in range(2000)] + [(5000, None, "en", "a"), (5001, "  ", "en", "zero")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    by = {}
    for r in got:
        x = by.setdefault(r["key"], [0, r["source_size"], r["target"], 0])
        x[0] += r["taken"]
        x[3] += r["size"]
    total = sum(x[1] for x in by.values())
    assert all(x[3] == x[1] and abs(x[0] - x[2]) <= 30 and x[2] <= 2 * x[1] for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - 1.5 * total) < 1e-6 * total
    free = {k: x[2] for k, x in by.items() if x[2] < 2 * x[1]}
    weight = dict(zip(sorted(by), itertools.cycle((5, 2, 1))))
    assert len({round(t / weight[k], 6) for k, t in free.items()}) == 1
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs(spark, rows).repartition(7)).collect()} == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|done|>", "\\l\\e<\\", "", None, "é<|done|>\n" * 50]
    rows = [(c, t, ("user", "assistant")[t % 2], nasty[(c + t) % 6]) for c in range(4) for t in range(4)]
    rows += [(9, 0, "user", "a"), (9, 1, "user", "b"), (None, 0, None, "x"), (8, 0, "system", "s"), (8, 1, "user", "u"), (8, 1, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as valid")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == c), key=lambda x: (x[0], x[1] or ""))
        said = "".join(t or "" for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c]["valid"] == (c in range(4))


def vecs(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as node")


BAD = [(900, None), (901, [0.0] * 8), (902, [None] * 8), (903, [float("nan")] * 8), (904, [1.0, 2.0])]
OTHER = [(950, [3.0, 1.0, 0.0]), (951, [3.0, 1.0, 0.1]), (952, [0.0, -1.0, 9.0]), (960, [5.0]), (961, [5.0])]  # of other dimensions


def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x, x[:20] + rng.normal(scale=0.1, size=(20, 8)), x[:10] * 3, x[:1]]).astype(np.float32)
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = n @ n.T >= 0.9
    np.fill_diagonal(near, False)
    low = components(range(len(x)), list(zip(*np.nonzero(near))))
    want = {(i, int(near[i].sum()), low[i], low[i] == i) for i in range(len(x))} | {(i, 0, i, True) for i, _ in BAD}
    want |= {(950, 1, 950, True), (951, 1, 950, False), (952, 0, 952, True), (960, 1, 960, True), (961, 1, 960, False)}
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + OTHER
    old, vectors.BLOCK = vectors.BLOCK, 16
    try:
        got = vectors.near_duplicates(vecs(spark, rows)).collect()
    finally:
        vectors.BLOCK = old
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert vectors.near_duplicates(vecs(spark, rows).limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[1:9] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, v) for i, v in BAD + OTHER]
    got = {}
    for r in vectors.nearest(vecs(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = []
    for q in range(0, 1500, 50):
        s = n @ n[q]
        s[q] = -2
        best = sorted(range(1500), key=lambda i: (-round(s[i], 12), i))[:5]
        found = [i for _, i, _ in sorted(got[q])]
        assert len(found) == 5 and all(abs(s[i] - v) < 1e-9 for _, i, v in got[q])
        hits.append(len(set(best) & set(found)) / 5)
    assert np.mean(hits) >= 0.9
    assert [i for _, i, _ in sorted(got.pop(5950))] == [5951, 5952]
    assert set(got) == set(range(0, 1500, 50))
    assert [i for _, i, _ in sorted(got[0])] == [1, 2, 3, 4, 5]


def test_nearest_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(11)
    near = rng.normal(size=64) + rng.normal(scale=0.05, size=(800, 64))
    x = np.concatenate([near, rng.normal(size=(400, 64))]).astype(np.float32)
    got = {}
    for r in vectors.nearest(vecs(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = []
    for q in range(0, 800, 50):
        s = n @ n[q]
        s[q] = -2
        hits.append(len(got[q] & set(np.argsort(-s)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.95, np.mean(hits)


def test_nearest_neighbours_of_few_rows(spark):
    few = vecs(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 1.0]), (50, [2.0, 0.0]), (None, [1.0, 0.0])])
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in vectors.nearest(few).collect()}
    assert got == {(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)}
    assert vectors.nearest(few.limit(0)).count() == 0
    assert vectors.nearest(few.where("vec_id = 7")).count() == 0


def test_components_raise_at_their_bound(spark):
    from perilgrid.llm.common import connected_components

    chain = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(chain, 1)


@needs_vocabulary
def test_token_counts_of_long_white_space():
    enc = tokens.encoder(tokens.VOCABULARY)
    rnd = random.Random(13)
    for _ in range(300):  # runs just over the bound, where the pattern's own matcher still works
        text = "".join(rnd.choice(["a", "b ", "12", "!", "\n", " " * 2001, "\n \t" * 900, "\u3000" * 2000]) for _ in range(rnd.randrange(1, 9)))
        assert tokens.length(enc, text) == len(enc.encode_ordinary(text))
    assert tokens.length(enc, " " * 1_000_000 + "a") == tokens.length(enc, " " * 999_999) + tokens.length(enc, " a")


@needs_vocabulary
def test_token_counts(spark):
    texts = ["a b c", "", None, "word " * 300, "word " * 300, "été 12 !!"]
    n = sorted(len(tokens.encoder(tokens.VOCABULARY).encode_ordinary(t)) if t else 0 for t in texts)
    table = tokens.token_counts(docs(spark, list(enumerate(texts)))).cache()
    for r in table.collect():
        assert r["kept_tokens"] == sum(min(x, r["limit"]) for x in n)
        assert (r["n_docs"], r["longer_docs"], r["total_tokens"]) == (n.count(r["limit"]), sum(x > r["limit"] for x in n), sum(n))
    for limit in (0, 2, 4, 100, 10_000):
        assert tokens.truncated_total(table, limit).first()[0] == sum(min(x, limit) for x in n)
    assert tokens.quantile(table, 0.5).first()[0] == n[2]
    assert tokens.token_counts(docs(spark, [(1, "x")]).limit(0)).count() == 0


def known(p, piece):
    """(score, id) of a piece, by the model's own list."""
    node = p.trie
    for c in piece:
        node = node[0].get(c)
        if node is None:
            return None
    return node[1] or None


def every_segmentation(p, text):
    """All segmentations of a text, by recursion."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, len(text) + 1):
        found = known(p, text[:k])
        if found:
            out += [(found[0] + s, (found[1], *rest)) for s, rest in every_segmentation(p, text[k:])]
    if not known(p, text[0]):
        raw = tuple(p.bytes[b] for b in text[0].encode())
        out += [(p.unknown + s, raw + rest) for s, rest in every_segmentation(p, text[1:])]
    return out


@needs_vocabulary
def test_best_segmentations():
    p = pieces.pieces()
    for text in ("hello", "▁banana", "été", "日x", "12ab", "▁▁a"):
        want = sorted((s for s, _ in every_segmentation(p, text)), reverse=True)[:8]
        got = p.search(text, 8)
        assert [s for s, _ in got] == want
        assert {tuple(ids) for _, ids in got} <= {ids for _, ids in every_segmentation(p, text)}
        assert len({tuple(ids) for _, ids in got}) == len(got)
    whole = p.nbest("ab cd", 6)
    both = sorted((a[0] + b[0] for a in every_segmentation(p, "▁ab") for b in every_segmentation(p, "▁cd")), reverse=True)
    assert [s for s, _ in whole] == both[:6]
    assert [p.decode(p.pack(i)) for _, i in whole] == ["ab cd"] * 6


@needs_vocabulary
def test_two_best_of_whole_texts_against_every_segmentation():
    p = pieces.pieces()
    for text in ("a b c", "ab, cd", "x  y", "é 1 日", "no"):
        marked = "▁" + text.replace(" ", "▁")
        want = sorted((s for s, _ in every_segmentation(p, marked)), reverse=True)[:2]
        got = p.encode(text)
        assert np.allclose([s for s, _ in got], want) and len({x for _, x in got}) == len(got)
        assert all(p.decode(x) == text for _, x in got)


@needs_vocabulary
def test_the_cache_is_bounded():
    p, rnd = pieces.Pieces(pieces.MODEL), random.Random(14)
    old, pieces.CACHE_BYTES = pieces.CACHE_BYTES, 50_000
    try:
        texts = [" ".join("".join(rnd.choices("abcdefg", k=6)) for _ in range(50)) for _ in range(40)]
        first = [p.encode(t) for t in texts]
        assert len(p.cache) + len(p.cache.older) < 400
        assert first == [p.encode(t) for t in texts]
    finally:
        pieces.CACHE_BYTES = old


@needs_vocabulary
def test_pieces_round_trip(spark):
    texts = ["", None, " ", "a  b\n\tc", "▁ mark \0", "日本語 ok", "x" * 5000, "né.\r\n", "a b", "a b"]
    df = docs(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in pieces.encode(df, with_ids=True).collect()}
    assert all(r["round_trip"] for r in got.values()) and got[8]["ids"] == got[9]["ids"]
    assert got[0]["n_pieces"] == got[1]["n_pieces"] == 0 and got[1]["second_score"] is None
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(df, with_ids=True)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


@needs_vocabulary
def test_encode_gives_the_second_segmentation(spark):
    p = pieces.pieces()
    texts = ["hello", "été ok", "x" * 300, "ab cd", ""]
    got = {r["doc_id"]: r for r in pieces.encode(docs(spark, list(enumerate(texts))), with_ids=True).collect()}
    for i, t in enumerate(texts[:4]):
        (first, ids), (second, others) = p.nbest(t, 2)
        r = got[i]
        assert r["ids"] == ids and ids != others and r["second_round_trip"]
        assert r["second_sha256"] == hashlib.sha256(p.pack(others)).hexdigest()
        assert abs(r["best_score"] - first) < 1e-9 and abs(r["second_score"] - second) < 1e-9
    assert got[4]["second_sha256"] is None and got[4]["second_round_trip"] is None


def test_mix_stage_with_one_id_in_two_sources(spark):
    import corpus_pipeline as c

    rows = [(i, "some words " * (1 + i % 5), "en", s) for i in range(60) for s in ("a", "b", None)]
    d = docs(spark, rows)
    want = {(r["doc_id"], r["key"]): r["taken"] // r["size"] for r in mixing.mix(d).collect()}
    got = {}
    for r in c.mix_sources(spark, d, "").collect():
        key = (r["doc_id"], "n" if r["source"] is None else "=" + r["source"])
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert len(set(want.values())) > 1


@needs_vocabulary
def test_pipeline(spark):
    import corpus_pipeline as c

    rnd = random.Random(8)
    shared = words(rnd, 80)
    rows = [(i, " ".join(words(rnd, 60, 5000) + (shared if i in (3, 30) else [])), "en", "s") for i in range(60)]
    rows += [(100, rows[7][1], "en", "s"), (101, None, "en", "s"), (102, "123", "en", "t"), (103, "one more text", None, None)]
    d = docs(spark, rows)
    kept = c.identify_language(spark, d, "").select(*c.COLUMNS)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {101, 102}
    assert {r["doc_id"] for r in c.near_dedup(spark, kept, "").collect()} == {i for i, *_ in rows} - {100, 101, 102}
    cut = {r["doc_id"]: r for r in c.substring_dedup(spark, kept, "").collect()}
    assert 100 not in cut and len(cut[30]["text"].split()) == 60 and cut[3]["text"] == rows[3][1] and cut[30]["n_chars"] == len(cut[30]["text"])
    mixed = c.mix_sources(spark, kept, "").collect()
    assert mixed and {r["doc_id"] for r in mixed} <= {i for i, *_ in rows}
    assert c.encode_pieces(spark, kept, "").where("not round_trip").count() == 0
    assert [n for n, _ in c.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "mixing", "SentencePiece encoding"]
