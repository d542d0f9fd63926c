"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from helixframe.llm import bpe, collocations, licenses, line_dedup, near_dedup, packing, quality, registry, secrets, sharding, simhash, substring, webp
from test_methods import brute_groups, plain_packing, plain_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, line string, score string, shard string, ids string, bucket string, node string, n int, salt int, __gone string, __doc string, __kept string, __n string, component string, sub string, _2 string, class string, row string"
LONG = "word and more words to make it long " * 4000


def row(doc_id, text, source="s1"):
    return (doc_id, text, "en", source, len(text or ""), 1, "x", "x", "x", "x", "x", "x", 1, 1, *"abcdefghi")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [row(1, None), row(2, ""), row(3, LONG), row(4, "one two three four five six"), row(5, "one two three four five six"), row(5, "one two three four five six"), row(6, "é 漢字 🎉 token: abcdef123456", None), row(None, "no id here at all"), row(8, "\n\n  \n"), row(9, "word"), row(10, "x" * 700_000), row(20, "first text of twenty"), row(20, "first text of twenty"), row(20, "another text of the same id"), row(40, None), row(40, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, None) for k in range(1, 11)] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_operators_on_odd_rows(odd, labels):
    n = odd.count()
    assert line_dedup.report(odd).count() == n
    assert quality.scored(odd.select("doc_id", "text"), quality.fit(odd, labels)).filter("score between 0 and 1").count() == n
    assert near_dedup.groups(odd).count() == n
    assert bpe.decode(bpe.encode(odd)).count() == n
    assert licenses.scan(odd).select("doc_id").distinct().count() == 12
    assert webp.measured(webp.media(odd)).count() == n
    assert secrets.spans(odd).count() == n
    assert sharding.shard(odd).count() == n
    assert simhash.fingerprinted(odd).count() == n
    assert {(r.doc_id, r.n_words, r.n_removed) for r in substring.parsed(odd).filter("doc_id in (3, 5) or doc_id is null").collect()} == {(3, 32_000, 0), (5, 6, 0), (None, 5, 0)}
    best = collocations.collocations(odd).collect()
    assert {r.lang for r in best} == {"en"} and all(r.a >= 100 and r.n == 32_044 for r in best)
    packed = packing.pack_documents(odd).toPandas()
    assert packed["n_tokens"].sum() == sum(len((r.text or "").encode()) + 1 for r in odd.select("text").collect())


def test_values_on_odd_rows(odd):
    """Lines, licences, secrets and shards of null, empty, repeated and hostile rows."""
    none = hashlib.sha256(b"").hexdigest()
    assert Counter((r.doc_id, r.text) for r in line_dedup.clean(odd).collect()) == Counter((r.doc_id, r.text) for r in odd.collect())
    lines = {(r.n_lines, r.n_kept, r.n_chars, r.clean_sha256) for r in line_dedup.report(odd).filter("doc_id in (1, 2, 40)").collect()}
    assert lines == {(0, 0, None, None), (1, 1, 0, none)}
    found = licenses.scan(odd).collect()
    assert all(r.license is None and r.n_notices == 0 for r in found) and sum(r.canonical_sha256 == none for r in found) == 5
    spans = secrets.spans(odd).collect()
    assert {(r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in spans if r.spans} == {(6, 1, 0, 0)}
    assert next(r.spans for r in spans if r.doc_id == 6).split(",")[0] == "assign:7:26"
    assert {r.base_sha256 for r in spans if r.doc_id != 6} == {none}
    dealt = sharding.shard(odd, 3).collect()
    empty_ = [r for r in dealt if r.size == 8]
    assert sorted(r.doc_id for r in empty_) == [1, 2, 40, 40] and len({r.shard for r in empty_}) == 1 and {r.text_crc32 for r in empty_} == {0}
    twins = [r.shard for r in dealt if r.doc_id in (4, 5)]
    assert len(twins) == 3 and len(set(twins)) == 1
    assert all(sorted(r.slot for r in dealt if r.shard == k) == list(range(sum(r.shard == k for r in dealt))) for k in range(3))


def test_operators_on_an_empty_table(empty, labels):
    assert line_dedup.report(empty).isEmpty()
    assert quality.scored(empty.select("doc_id", "text"), quality.fit(empty, labels)).isEmpty()
    assert near_dedup.groups(empty).isEmpty()
    assert bpe.decode(bpe.encode(empty)).isEmpty()
    assert licenses.scan(empty).isEmpty()
    assert webp.measured(webp.media(empty)).isEmpty()
    assert secrets.spans(empty).isEmpty()
    assert sharding.shard(empty).isEmpty()
    assert simhash.fingerprinted(empty).isEmpty()
    assert packing.pack_documents(empty).isEmpty()
    assert substring.parsed(empty).isEmpty() and collocations.collocations(empty).isEmpty()


def test_stages_keep_extra_columns(spark, odd, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == docs.columns
            got.count()


def test_stages_take_effect(spark, tmp_path):
    rows = [row(k, f"Privacy notice\nunique body number {k} of this page and password = hunter{k}{k}zqx9", f"s{k}") for k in range(12)]
    rows += [row(20 + k, "these words are the very same in each of three rows of the table") for k in range(3)] + [row(20, "these words are the very same in each of three rows of the table")]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    cleaned = {r.doc_id: r.text for r in stages["line dedup"](spark, docs, "").collect()}
    assert cleaned[0].startswith("Privacy notice\n") and cleaned[7].startswith("unique body number 7")
    kept = sorted(r.doc_id for r in stages["MinHash near-dedup"](spark, docs, "").collect() if r.doc_id >= 20)
    assert kept == [20]
    several = spark.createDataFrame([row(30, t, s) for t, s in (("b text of more words here", "z"), ("a text of more words here", "y"), ("a text of more words here", "x"))], SCHEMA).repartition(3)
    assert [(r.text, r.source) for r in stages["MinHash near-dedup"](spark, several, "").collect()] == [("a text of more words here", "x")]
    assert all("hunter" not in r.text for r in stages["secret scans"](spark, docs, "").collect())


def test_queries_give_a_row_for_each_row(spark, odd, labels, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    n = odd.count()
    for name, q in registry.QUERIES.items():
        if name.split("_")[0] not in ("op5", "op11", "op12"):
            assert q(spark, str(tmp_path)).count() == n, name


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """All five stages in plain loops, with the classifier's fitted model."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = quality.fit(docs, labels)
    rows = [r for r in rows if model.scores([(r[1] or "").encode()])[0] >= 0.3]
    sites, first = {}, {}
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(s)
                first[x.strip(" ")] = min(d, first.get(x.strip(" "), d))
    common = {x for x, s in sites.items() if len(s - {None}) >= line_dedup.MIN_SITES}
    assert common
    rows = [(d, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in common or first[x.strip(" ")] == d)) for d, t, _ in rows]
    kept = {d for d, (_, c) in brute_groups({d: t or "" for d, t in rows}, 5).items() if c == d}
    assert len(kept) < len(rows)
    rows = [r for r in rows if r[0] in kept]
    rank = secrets.word_ranks()
    rows = [(d, secrets.redact(t, rank)) for d, t in rows]
    assert any(t and "[SECRET]" in t for _, t in rows)
    whole, rest = plain_pieces([(d, len((t or "").encode()) + 1) for d, t in rows])
    want = [(*p, p[3], 0) for p in whole] + [(*p, cap, at) for p, (_, cap, at) in zip(rest, plain_packing([p[3] for p in rest]))]
    got = [(x.doc_id, x.piece, x.start, x.n_tokens, x.capacity, x.bin_start) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_registered_queries_match_the_contract():
    assert {k.split("_")[0] for k in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, sf_dir, duck, same_rows):
    same_rows(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).df())


def test_pipeline_runs(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(got) and (got.groupby("bin")["n_tokens"].sum() <= got.groupby("bin")["capacity"].first()).all()
