"""The whole job where results were cut before."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodegraph.llm import common, decontaminate, language_id, line_dedup, secret_scan
from tests.llm.fixtures import words

SCHEMA = "doc_id long, text string"


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_stage_drops_copies_of_similarity_over_08(spark):
    g = random.Random(8)
    passage = words(g, 60)
    texts = [words(g, 150) for _ in range(6)] + [passage + " " + words(g, 25) for _ in range(6)]
    for x in list(texts):
        for _ in range(3):
            y = x.split()
            for _ in range(g.randint(1, 4)):
                y[g.randrange(len(y))] = "changed" + str(g.randrange(99))
            texts.append(" ".join(y))
    near = lambda a, b: len(five(a) & five(b)) >= 0.8 * len(five(a) | five(b))
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(texts[i], texts[j]) and top[i] != top[j]:
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert kept == sorted(set(top)) and len(kept) < len(texts) - 12


def test_near_stage_keeps_other_texts_of_a_repeated_id(spark):
    g = random.Random(9)
    a, b = words(g, 40), words(g, 40)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, None), (None, a)], SCHEMA)
    kept = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, a), (2, b), (3, None), (None, a)} and len(kept) == 4


def test_benchmark_stage_drops_a_document_with_one_item(spark, tmp_path):
    g = random.Random(10)
    item, text = words(g, 20), words(g, 80)
    spark.createDataFrame([(1, item), (2, words(g, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, text), (2, f"{text} {item} {text}"), (3, None)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_dictionary_counts_the_words_of_all_documents(spark):
    name = lambda i: "word" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    docs = spark.createDataFrame([(i, f"{name(i)} common {name(i).upper()}") for i in range(900)] + [(900, None)], SCHEMA)
    assert secret_scan.dictionary(docs) == {b"common"} | {name(i).encode() for i in range(900)}
    assert secret_scan.dictionary(docs, 1) == {b"common"}


def met_pairs(spark, pairs):
    docs = spark.createDataFrame([(i, x) for i, p in enumerate(pairs) for x in p], SCHEMA)
    ids = {r.line: r.id for r in line_dedup.occurrences(docs).collect()}
    root = {r.node: r.root for r in common.components(line_dedup.line_links(docs, 5, 0.8, 9, 8, 3)).collect()}
    return [root.get(ids[a], ids[a]) == root.get(ids[b], ids[b]) for a, b in pairs]


def joined(spark, pairs):
    return sum(met_pairs(spark, pairs)) / len(pairs)


def changed(g, x):
    i = g.randrange(len(x))
    return x[:i] + "#" + x[i + 1 :]


def test_lines_of_a_template_meet_their_near_copies(spark):
    g = random.Random(11)
    fixed = words(g, 30).replace("éa", "ea")
    lines = [fixed + " " + words(g, 6) for _ in range(150)]
    pairs = [(x, changed(g, x)) for x in lines]
    assert joined(spark, pairs) == 1


def test_lines_of_few_words_meet_their_near_copies(spark):
    g = random.Random(12)
    name = lambda n: " ".join("".join(chr(97 + g.randrange(26)) for _ in range(9)) for _ in range(n))
    pairs = [(x + "1", x + "2") for x in (name(2 + i % 4) for i in range(200))]
    assert joined(spark, pairs) >= 0.95
    assert joined(spark, [("International Documentation Version1", "International Documentation Version2")]) == 1
    assert joined(spark, [("-" * 40, "-" * 80)]) == 1


def test_equal_short_lines_are_one(spark):
    docs = spark.createDataFrame([(1, "Ende.\nab\n\n \t"), (2, "Ende.\nab\nx\n\n \t")], SCHEMA)
    assert {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()} == {(1, "Ende.\nab\n\n \t"), (2, "x\n\n \t")}


def test_recall_of_near_copies_by_number_of_words(spark):
    g = random.Random(13)
    word = lambda: "".join(chr(97 + g.randrange(26)) for _ in range(g.randint(2, 9)))
    sets = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    by = {n: [] for n in (1, 2, 3, 4, 6, 8, 12)}
    for n, pairs in by.items():
        while len(pairs) < 60:
            x = " ".join(word() for _ in range(n))
            y = changed(g, x) if g.random() < 0.7 else x + g.choice("sx1.")
            if len(x) > 8 and x != y and len(sets(x) & sets(y)) >= 0.8 * len(sets(x) | sets(y)):
                pairs.append((x, y))
    met = met_pairs(spark, [p for pairs in by.values() for p in pairs])
    for k, n in enumerate(by):
        assert sum(met[60 * k : 60 * k + 60]) >= 0.9 * 60, n


@pytest.mark.parametrize("small", [1000, 3])
def test_bands_of_many_classes_are_examined_in_full(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL_BAND", small)
    g = random.Random(14)
    fixed = words(g, 24).replace("éa", "ea")
    lines = [fixed + " " + words(g, 9) for _ in range(60)]
    assert joined(spark, [(x, changed(g, x)) for x in lines]) >= 0.95


def test_lines_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a line that is here twice\nother", "x", 1), (2, "a line that is here twice", "y", 2), (None, None, None, None)], "doc_id long, text string, doc string, gone int")
    docs = docs.withColumn("key", F.lit(3)).withColumn("other", F.lit(4)).withColumn("drop", F.lit(5)).withColumn("_h", F.lit(6))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[1].text, got[2].text, got[None].text) == ("a line that is here twice\nother", "", None)
    assert (got[1].doc, got[1].gone, got[1].key, got[1].other, got[1]["drop"], got[1]._h) == ("x", 1, 3, 4, 5, 6)


def test_columns_named_like_inner_ones_pass(spark):
    g = random.Random(15)
    item = words(g, 12)
    docs = spark.createDataFrame([(1, f"some {item} text"), (2, "plain"), (None, None)], SCHEMA)
    for k, c in enumerate(["_d", "_h", "_g", "_n", "_p", "h", "d", "g", "n", "ids", "at", "p"]):
        docs = docs.withColumn(c, F.lit(k))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for out in (decontaminate.contamination(docs, bench, min_items=1), language_id.with_language(docs, None)):
        for r in out.collect():
            assert [r[c] for c in docs.columns[2:]] == list(range(12))
    got = {r.doc_id: (r.n_items, r.contaminated) for r in decontaminate.contamination(docs, bench, min_items=1).collect()}
    assert got == {1: (1, True), 2: (0, False), None: (0, False)}


def test_stages_take_odd_tables(spark, tmp_path):
    g = random.Random(16)
    item = words(g, 14)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda: "\n".join(words(g, 15) for _ in range(8))
    base = [text() for _ in range(24)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100, base[0]), (101, base[1] + " end"), (102, f"{text()} {item} {text()}"), (103, ""), (104, None), (None, text()), (5, base[5]), (106, words(g, 9000))]
    docs = spark.createDataFrame([(d, t, ["en", "fr"][k % 2], "s", len(t or "")) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("kept", F.lit("x")).withColumn("band", F.lit(1))
    for table in (docs, docs.filter("false")):
        seen = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = common.checkpoint(stage(spark, seen, str(tmp_path)))
            assert seen.columns == docs.columns, name
        ids = {r.doc_id for r in seen.collect()}
        packed = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == ids
        if table is docs:
            # the planted passage and texts without a language go, of texts that lost all lines one stays, clean ones stay
            assert ids & {101, 102, 103, 104} == set() and set(range(24)) | {None, 106} <= ids
        else:
            assert not ids


def test_lines_of_a_family_are_not_compared_all_with_all(spark, monkeypatch):
    g = random.Random(15)
    word = lambda: "".join(chr(97 + g.randrange(26)) for _ in range(g.randint(2, 8)))
    base = [word() for _ in range(60)]
    lines = []
    for _ in range(150):  # mutual similarities are mostly just below the threshold
        x = list(base)
        for i in g.sample(range(60), 4):
            x[i] = word()
        lines.append(" ".join(x))
    pairs = [(x, changed(g, x)) for x in lines]
    verified, seen = line_dedup.verified, []

    def counted(rows, some, *rest):
        seen.append(some.count())
        return verified(rows, some, *rest)

    monkeypatch.setattr(line_dedup, "verified", counted)
    assert joined(spark, pairs) == 1
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for p in pairs for x in p]
    near = sum(len(x & y) >= 0.78 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    assert sum(seen) < 1.5 * near + 4 * len(sets), (seen, near)


def test_components_of_few_edges_are_those_of_the_rounds(spark):
    g = random.Random(16)
    rows = [(g.randrange(-300, 300), g.randrange(-300, 300)) for _ in range(250)] + [(7, 7)] + [(i, i + 1) for i in range(1000, 1400)]
    edges = spark.createDataFrame(rows, "a long, b long")
    few, rounds = ({tuple(r) for r in common.components(edges, few=n).select("node", "root").collect()} for n in (1000, 0))
    assert few == rounds
    assert common.components(edges.limit(0)).count() == 0


def test_words_of_plain_letters_need_no_pattern():
    import public_tokenizers

    from lodegraph.llm.wordbpe import Encoder

    enc, seen = Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    split = enc.split
    enc.split = lambda w: seen.append(w) or split(w)
    texts = ["Plain words, some twice. words, words", "don't été. a.b, x,, 'tis 12. . ,", "I'm'll, s. 's. ''s t, ſt, ſ."]
    ids, counts = enc.encode(texts)
    want = [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert "don't" in seen and not {"plain", "words,", "words", "twice.", "some"} & set(seen)


def test_minima_of_lines_take_several_runs_a_row(spark):
    import xxhash

    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (1, 8, 9, 10, 16, 17, 24, 25, 500, 40_000)] + ["😀" * 30, "x" * 100]
    points = [0, 0x7F4A7C15]
    low = line_dedup.minima(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), 9, lambda h: [h.bitwiseXOR(F.lit(p)) for p in points])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.id: (r.m0, r.m1, r.n) for r in low.collect()}
        node, made = low._jdf.queryExecution().executedPlan(), []
        while node.children().size():
            if node.nodeName() == "Generate":
                made.append(node.metrics().apply("numOutputRows").value())
            node = node.children().apply(0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    runs = [[b[2 * i : 2 * i + 18] for i in range(max(1, len(b) // 2 - 8))] for b in (x.encode("utf-16-be") for x in lines)]
    hashes = [[xxhash.xxh64(x, seed=42).intdigest() & 0xFFFFFFFF for x in r] for r in runs]
    assert got == {i: (*(min(h ^ p for h in hs) for p in points), 1) for i, hs in enumerate(hashes)}
    assert max(made) <= sum(map(len, runs)) / 4


def test_both_signatures_take_one_pass_and_sketches_several_shingles_a_row(spark, tmp_path):
    import xxhash

    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (1, 5, 12, 13, 64, 65, 900, 3000)]
    spark.createDataFrame(list(enumerate(lines)), "id long, line string").write.parquet(f"{tmp_path}/lines")
    read = spark.read.parquet(f"{tmp_path}/lines")
    keys = line_dedup.band_keys(read, 5, 9, 8, 3)
    assert keys.groupBy("id").count().filter("count = 16").count() == 5  # lines of up to 64 characters have both
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert keys._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        marks = line_dedup.sketches(read, 5)
        got = {r.id: [r.size, *(r[m] for m in line_dedup.MARKS)] for r in marks.collect()}
        node, made = marks._jdf.queryExecution().executedPlan(), []
        while node.children().size():
            if node.nodeName() == "Generate":
                made.append(node.metrics().apply("numOutputRows").value())
            node = node.children().apply(0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sets = [{xxhash.xxh64(x[i : i + 5].encode("utf-16-be"), seed=42).intdigest() for i in range(max(1, len(x) - 4))} for x in lines]
    for i, hashes in enumerate(sets):
        want = [0] * len(line_dedup.MARKS)
        for h in hashes:
            want[h >> 6 & 15] ^= 1 << (h & 63)
        assert got[i] == [len(hashes), *(w - (w >> 63 << 64) for w in want)]
    assert sum(made) <= sum(map(len, sets)) / 4


def test_stored_tables_are_read_in_few_tasks(spark):
    out = common.stored(spark.range(1000, numPartitions=40).filter("id <> 7"))
    assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert out.count() == 999 and out.columns == ["id"] and "FileScan parquet" in out._jdf.queryExecution().executedPlan().toString()
    assert common.stored(spark.range(0)).count() == 0


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_texts_are_split_twice_for_all_of_line_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", most)
    split, calls = line_dedup.occurrences, []
    monkeypatch.setattr(line_dedup, "occurrences", lambda docs: calls.append(1) or split(docs))
    text = "the quick brown fox jumps over the lazy dog by the river"
    docs = spark.createDataFrame([(1, f"{text}\nalone\n\n"), (2, f"{text}s\nalone"), (None, text), (3, None)], SCHEMA)
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {(1, "alone\n\n"), (2, ""), (None, text), (3, None)}
    assert len(calls) == 2
