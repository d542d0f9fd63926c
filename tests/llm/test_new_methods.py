"""Tries, collocations and substring dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import collocations, prefix_trie, registry, substring

# --- substring dedup -----------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_dedup(rows):
    """(doc_id, n_words, n_removed, sha) of each row, by all windows."""
    least = {}
    for d, t in rows:
        w = words_of(t)
        for s in range(len(w) - substring.WINDOW + 1):
            if d is not None:
                key = tuple(w[s : s + substring.WINDOW])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, t in rows:
        w, gone = words_of(t), set()
        for s in range(len(w) - substring.WINDOW + 1):
            if d is not None and least[tuple(w[s : s + substring.WINDOW])] < d:
                gone.update(range(s, s + substring.WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def patched(r, sources, n):
    """A text of stretches of sources, changed here and there, with words of its own between."""
    out = []
    for _ in range(n):
        s = r.choice(sources)
        a = r.randrange(len(s))
        out += s[a : a + r.choice([20, 49, 50, 51, 75, 130])]
        out += r.choices("abcdefgh", k=r.choice([0, 0, 1, 5]))
    return " ".join(out)


def test_substring_dedup_equals_all_windows(spark):
    r = random.Random(3)
    sources = [[f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(4)]
    sources += [["x"] * 140, ["a", "b", "c"] * 60, r.choices("abc", k=150), r.choices("ab", k=150)]  # repeats inside
    rows = [(k, patched(r, sources, r.randrange(6))) for k in range(120)]
    rows += [(5, rows[5][1]), (7, rows[9][1]), (7, "other words"), (None, rows[3][1]), (300, None), (301, ""), (302, " \n\t "), (-4, rows[2][1]), (400, "é x " + rows[4][1].replace(" ", "\n"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring.parsed(docs).collect()), key=str) == plain_dedup(rows)


def test_substring_dedup_in_slices(spark, monkeypatch):
    """Texts longer than a slice of words and a piece of bytes."""
    monkeypatch.setattr(substring, "SLICE", 64)
    monkeypatch.setattr(substring, "_PIECE", 100)
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(700)]
    own = np.array([int(x[1:]) for x in words], np.uint64)
    places = np.unique(np.concatenate([p for _, p, _, _ in substring.window_anchors(own)]))
    monkeypatch.setattr(substring, "SLICE", 1 << 18)
    assert (places == np.unique(np.concatenate([p for _, p, _, _ in substring.window_anchors(own)]))).all() and np.diff(places).max() <= substring.RUN
    text = " ".join(words) + "\n" * 300
    for removed in ([], [(0, 60), (50, 120), (300, 301), (690, 700)], [(0, 700)]):
        gone = {k for a, b in removed for k in range(a, b)}
        got = list(substring.kept_words(text.encode(), removed))
        assert sum(n for n, _ in got) == 700 and [w.decode() for _, kept in got for w in kept] == [w for k, w in enumerate(words) if k not in gone]


def test_cleaned_keeps_columns(spark):
    r = random.Random(8)
    passage = " ".join(f"w{r.randrange(1000)}" for _ in range(60))
    rows = [(1, f"one  {passage}\ntwo", "a"), (2, f"three  {passage}\nfour", "b"), (3, "short  text", None), (4, None, "c"), (None, passage, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __spans string")
    got = substring.cleaned(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], (2, "three four", "b"), *rows[2:]], key=str)
    assert substring.cleaned(docs.filter("false")).isEmpty() and substring.parsed(docs.filter("false")).isEmpty()


# --- prefix tries --------------------------------------------------------


def plain_nodes(rows):
    """All nodes by their whole paths."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in sorted(whole.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, some in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(some) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, some in members.items():
        ends = ",".join(str(c) for c in some if len(whole[c]) == len(p))
        out.append((some[0], len(p), members[p[:-1]][0] if p else None, len(some), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(2)
    turns = [(r.choice(["user", "assistant", None]), r.choice(["hi", "hello é", "", None, "ok", "more words"])) for _ in range(5)]
    rows = [(c, k, *r.choice(turns[:3] if r.random() < 0.7 else turns)) for c in range(-7, 90) for k in range(r.choice([1, 2, 3, 7, 12]))]
    rows += [(c, k, "user", "the very same") for c in range(200, 260) for k in range(20)]  # a hot conversation
    rows += [(c, None, "user", f"first {c % 2}") for c in range(40)] + [(3, 1, "user", "tie"), (3, 1, "assistant", "tie"), (3, 1, "user", "tie"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("light", [1, 12, 300, 100_000])
def test_trie_equals_plain_paths(spark, conversations, light):
    """From all nodes heavy but the leaves to one shard below the root."""
    df = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").repartition(4)
    assert sorted(map(tuple, prefix_trie.nodes(df, light).collect()), key=str) == plain_nodes(conversations)


def test_trie_of_long_and_of_no_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(c, k, "user", f"t{k}" if k < 60 + c else f"own {c} {k}") for c in (0, 10, 15, 20, 25) for k in range(90)] + [(11, 0, "user", "gone by h")]
    schema = "conv_id long, turn long, role string, text string, k1 string, depth int"
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], schema)
    assert sorted(map(tuple, prefix_trie.nodes(df, 100).collect()), key=str) == plain_nodes(rows)
    assert prefix_trie.nodes(df.filter("false")).isEmpty()


def test_double_arrays():
    r = random.Random(1)
    paths = [[r.randrange(1, 30) for _ in range(r.randrange(1, 9))] for _ in range(200)] + [[k] for k in range(1, 60)]
    trie = prefix_trie.DoubleArray(paths)
    seen = {}
    for p in paths:
        for d, at in enumerate(trie.walk(p), 1):
            assert seen.setdefault(at, tuple(p[:d])) == tuple(p[:d])
    assert len(seen) == len({tuple(p[:d]) for p in paths for d in range(1, len(p) + 1)}) == len(trie.order) - 1
    with pytest.raises(KeyError):
        list(trie.walk([1, 999]))


# --- collocations --------------------------------------------------------


def plain_collocations(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 6):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, a in cands.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if a >= f[q[i : i + m]]}
        found = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("top", [3, 25, 2000])
def test_collocations_equal_plain_counts(spark, monkeypatch, top):
    """Ties at the end of the list, one and several rounds, phrases over marks, rare and frequent ends."""
    monkeypatch.setattr(collocations, "LEAST", 4)
    r = random.Random(11)
    vocabulary = {"en": [f"w{k}" for k in range(60)] + ["The", "A.B", "été"], "de": ["x", "y", "Z"], None: [f"n{k}" for k in range(400)]}
    rows = []
    for lang, words in vocabulary.items():
        for _ in range(150):
            text = []
            for _ in range(r.randrange(12)):
                text.append(r.choices(words, [1 / (k + 1) for k in range(len(words))])[0])
                if r.random() < 0.2:
                    text.append(r.choice(["New York City", "of the people", "rare pair", "rare pair", "nächste Woche, gut", "a b a b a"]))
            rows.append((lang, r.choice(["  ", " ", "\t"]).join(text) + r.choice(["", ".", "!\n"])))
    rows += [("en", None), ("en", ""), ("fr", "one two"), (None, " ,;. ")] + rows[:40]
    docs = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, n int").repartition(3)
    got = [tuple(x) for x in collocations.collocations(docs, top).collect()]
    assert sorted(got) == plain_collocations(rows, 4, top)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).isEmpty()
    assert collocations.collocations(spark.createDataFrame([("en", "few words"), (None, None)], "lang string, text string")).isEmpty()


def test_bitmaps_hold_their_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    bits = collocations.bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    others = np.random.default_rng(2).integers(0, 2**64, 20_000, np.uint64)
    assert collocations.has(bits, keys.view(np.uint64)).all() and collocations.has(bits, others).mean() < 0.1
    assert not collocations.has(collocations.bitmap(spark.createDataFrame([], "key long")), others).any()


def test_scores_beyond_64_bits(spark):
    """Products of counts pass 64 bits before they are divided."""
    row = spark.sql(f"SELECT array(3000000000L) AS first, array(2000000000L) AS rest, 1500000000L AS a, 90000000000000L AS n")
    from pyspark.sql import functions as F

    assert row.select(F.expr(collocations.SCORES)[0]).first()[0] == 1000 * 1500000000 * 90000000000000 // (3000000000 * 2000000000)


# --- shards --------------------------------------------------------------


def test_shards_equal_plain_rounds(spark):
    """Heavy groups largest first, light ones in rounds: the shard of every row, against loops over all groups."""
    from helixframe.llm import sharding

    r = random.Random(7)
    rows = [(k, r.choice([None, "", "same text " * 40, "x" * min(3000, int(5 * r.paretovariate(0.9))), f"text {r.randrange(60)}"])) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = {x.text: x.g for x in docs.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS g").distinct().collect()}
    n_shards, share, blocks = 4, 20, 3
    size = Counter()
    for _, t in rows:
        size[names[t or ""]] += len((t or "").encode()) + 8
    total = sum(size.values())
    load, where = [0] * n_shards, {}

    def give(items):
        for weight, groups in items:
            least = min(range(n_shards), key=lambda k: (load[k], k))
            load[least] += weight
            where.update(dict.fromkeys(groups, least))

    heavy = sorted(((w, g) for g, w in size.items() if w * n_shards * share >= total), key=lambda x: (-x[0], x[1]))
    give((w, [g]) for w, g in heavy)
    light = sorted(((w, g) for g, w in size.items() if w * n_shards * share < total), key=lambda x: (-x[0], x[1]))
    rounds = max(1, -(-len(light) // (n_shards * blocks)))
    for at in range(0, len(light), n_shards * rounds):
        block = light[at : at + n_shards * rounds]
        items = [(sum(w for w, _ in block[k::n_shards]), k, [g for _, g in block[k::n_shards]]) for k in range(min(n_shards, len(block)))]
        give((w, gs) for w, _, gs in sorted(items, key=lambda x: (-x[0], x[1])))
    got = sharding.shard(docs, n_shards, share, blocks).collect()
    assert len(heavy) > 2 and len(light) > 30
    assert {x.doc_id: x.shard for x in got} == {k: where[names[t or ""]] for k, t in rows}
    for k in range(n_shards):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))


def test_new_queries_have_the_contract_columns(spark, sf_dir):
    want = {
        "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
        "op12_best_first_phrases": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
        "op13_relative_lz": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    }
    for name, columns in want.items():
        assert registry.QUERIES[name](spark, sf_dir).columns == columns
