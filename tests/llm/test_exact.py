"""Operators whose results are fixed, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from lodegraph.llm import common, decontaminate, exact_dedup, simhash, suffix_dedup, token_store, warc_store
from lodegraph.llm.quotient_filter import QuotientFilter
from tests.llm.fixtures import empty, frame, texts


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def order(x):
    return sorted(x, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    path = common.shared_path(spark, "test-tokens")
    token_store.write_tokens(frame(spark), path, tokenizer_path(), 2)
    got = [r.asDict() for r in token_store.with_start(spark, path, token_store.checksums(token_store.read_rows(spark, path))).collect()]
    want = {}
    for d, t in texts():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids)))
    assert order((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == order((d, *x) for d, xs in want.items() for x in xs)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] if r["doc_id"] is not None else -(10**9) for r in got] == sorted(r["doc_id"] if r["doc_id"] is not None else -(10**9) for r in got)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_tokens_of_nothing(spark):
    path = common.shared_path(spark, "test-tokens")
    token_store.write_tokens(empty(spark), path, tokenizer_path(), 2)
    assert token_store.with_start(spark, path, token_store.checksums(token_store.read_rows(spark, path))).count() == 0


def test_token_files_have_page_indexes_and_delta_metadata(spark):
    import glob

    import pyarrow.parquet as pq

    path = common.shared_path(spark, "test-tokens")
    token_store.write_tokens(frame(spark), path, tokenizer_path(), 2)
    column = pq.ParquetFile(glob.glob(f"{path.removeprefix('file:')}/part-*.parquet")[0]).metadata.row_group(0)
    by = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    assert by["doc_id"].has_offset_index and "DELTA_BINARY_PACKED" in by["doc_id"].encodings
    assert any("DICTIONARY" in e for e in by["tokens.list.element"].encodings)


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(frame(spark)).collect()
    groups = {}
    for d, t in texts():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    want = []
    for norm, members in groups.items():
        members.sort()
        sha = hashlib.sha256(norm.encode()).hexdigest()
        want += [(m[3], members[0][3], len(members), i == 0, sha) for i, m in enumerate(members)]
    assert order((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == order(want)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_quotient_filter_gives_back_its_fingerprints():
    g = np.random.default_rng(5)
    for n, width, top in ((0, 40, 9), (1, 40, 9), (300, 12, 1 << 12), (2000, 58, 1 << 58), (500, 20, 600)):
        put = g.integers(0, top, n, dtype=np.uint64)
        parts = [put[: n // 3], put[n // 3 : n // 2], put[n // 2 :]]
        made = [QuotientFilter.build(*np.unique(p, return_counts=True), width) for p in parts]
        whole = QuotientFilter.merge(made, width)
        fps, counts = whole.items()
        want, times = np.unique(put, return_counts=True)
        assert (fps == want).all() and (counts == times).all()
        assert all(whole.count(int(f)) == c for f, c in zip(want[:200], times[:200]))
        assert all(whole.count(int(x)) == int((put == x).sum()) for x in g.integers(0, top, 50, dtype=np.uint64))


def test_smallest_doc_id(spark):
    rows_ = [(-(2**63), "a b"), (5, "ab "), (None, "ab ")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows_)).collect()}
    assert got == {-(2**63): (-(2**63), 3, True), 5: (-(2**63), 3, False), None: (-(2**63), 3, False)}


def test_quotient_filters_merge(spark):
    fps = [5, 5, -9, 2**62, -9, 7, 2**62 + 1]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    assert rows(exact_dedup.repeated(exact_dedup.quotient_filters(df)), "fp", "n") == order([(5, 2), (-9, 2)])


def brute_simhash(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(fps, radius=2):
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_classes(spark):
    docs = texts()
    fps = [brute_simhash(t) for _, t in docs]
    tops = linked(fps)
    least = {r: min((d for (d, _), x in zip(docs, tops) if x == r and d is not None), default=None) for r in tops}
    got = simhash.near_classes(frame(spark)).collect()
    assert order((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == order((d, f, least[r]) for (d, _), f, r in zip(docs, fps, tops))
    assert simhash.near_classes(empty(spark)).count() == 0


@pytest.mark.parametrize("shard", [1, 3, 4096])
def test_links_in_small_shards(spark, shard):
    g = np.random.default_rng(1)
    seeds = g.integers(0, 2**63, 12, dtype=np.uint64)
    fps = sorted({int(s) ^ int(sum(1 << int(b) for b in g.integers(0, 64, k))) for s in seeds for k in (0, 1, 1, 2, 2, 3, 4, 5)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = {r.node: r.root for r in common.components(simhash.links(df, shard)).collect()}
    got, tops = [found.get(x - (1 << 64) if x >> 63 else x, x) for x in fps], linked(fps)
    assert len(set(zip(got, tops))) == len(set(got)) == len(set(tops))


def test_forest_of_a_dense_shard():
    fps = np.array([sum(1 << b for b in range(k)) for k in range(0, 64)] + [2**63 + 2**40 + 2**50], np.uint64)
    parts = simhash.forest(fps)
    assert len(parts) == 63 and {b for _, b in parts} == {0}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in common.components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_keep_one(spark):
    kept = [r.doc_id for r in simhash.keep_one(frame(spark)).collect()]
    assert len([d for d in kept if d is not None]) == len({d for d in kept if d is not None})
    assert 0 in kept and 10 not in kept and 12 not in kept


def brute_repeats(docs, size):
    seen = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, f in zip(b, gone) if not f)).hexdigest()))
    return order(out)


COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("shard", [2, 50_000])
def test_repeats(spark, shard):
    docs = [(d, t) for d, t in texts() if t is None or len(t) < 10_000]
    df = frame(spark, docs).fillna({"text": ""})
    found = suffix_dedup.repeats(df.select("text"), 60, 16, shard).drop("spans")
    got = df.select("doc_id", suffix_dedup._key(df["text"]).alias("key")).join(found, "key")
    assert rows(got, *COLS) == brute_repeats(docs, 60)


def test_contexts_of_repeats_are_made_once(spark):
    # strings with over 3 occurrences are counted by windows, the others go to shards: both read one exchange of contexts
    docs = [(i, f"{i} " * 20 + "a sentence that is in all of the texts, every time in other surroundings " + f" {i % 9}" * 30) for i in range(18)]
    out = suffix_dedup.repeats(frame(spark, docs).select("text"), 60, 16, 3)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow windows") == 2 and plan.count("MapInArrow shards") == 1
    assert plan.count("MapInArrow contexts") == 1


def test_repeat_whose_anchor_hash_begins_with_zeros(spark):
    gram = "the passage " * 10 + "awxojoao"
    assert int(suffix_dedup.gram_hashes(np.frombuffer(gram.encode(), np.uint8), 128)[0]) < 1 << 32
    passage = "a" * 136 + gram + "b" * 136  # the gram is in each window of 400 bytes
    docs = [(1, passage), (2, passage + " more")]
    out = suffix_dedup.without_repeats(frame(spark, docs), 400)
    assert rows(out, *COLS) == brute_repeats(docs, 400)
    assert [r.n_removed for r in out.collect()] == [400, 400]


def test_without_repeats_keeps_columns(spark):
    docs = [(d, t) for d, t in texts() if t is None or len(t) < 10_000]
    out = suffix_dedup.without_repeats(frame(spark, docs), 400)
    assert rows(out, *COLS) == brute_repeats(docs, 400)
    assert {"lang", "key", "spans"} <= set(out.columns)
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


def test_maximal_repeats_of_many_contexts():
    g = np.random.default_rng(2)
    whole = [bytes(g.integers(97, 99, 40, dtype=np.uint8)) for _ in range(150)]
    lefts, rights = [w[:20][::-1] for w in whole], [w[20:] for w in whole]
    for n in (2, 9, 150):
        want = {}
        for i in range(n):
            for j in range(n):
                left, right = suffix_dedup.lce(lefts[i], lefts[j]), suffix_dedup.lce(rights[i], rights[j])
                if i != j and right and left + right >= 9:  # all share the anchor
                    a, b = want.get(i, (0, 0))
                    want[i] = (max(a, left), max(b, right))
        assert suffix_dedup.extents(lefts[:n], rights[:n], 9) == want


def test_warc(spark):
    big = "<p>é" + "x" * 1500
    pages = [(1, "http://a/\r\nx", big), (2, None, big), (9, "http://b", big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "http://f", ""), (9, "http://b", big), (7, "u", "WARC/1.1\r\n\r\n" + "y" * 1200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = common.shared_path(spark, "test-warc")
    warc_store.write_archive(df, path)
    archive = warc_store.read_archive(spark, path)
    got = rows(warc_store.verified(archive), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    data = lambda h: (h or "").encode()
    want = order((p, len(data(h)), hashlib.sha1(data(h)).hexdigest(), "revisit" if h == big and p != 9 else "response", 9 if h == big and p != 9 else None) for p, _, h in pages)
    assert got == want
    warc_store.export_warc(spark, path, f"{path}-files", 3)
    files = {(r.header, bytes(r.payload)) for r in warc_store.read_warc(spark, f"{path}-files").collect()}
    assert files == {(r.header, bytes(r.payload) if r.stored else b"") for r in archive.collect()}
    assert spark.read.parquet(f"{path}/payloads").count() == len({data(h) for _, _, h in pages})


@pytest.mark.parametrize("few", [10, 0])
def test_warc_payloads_that_come_again(spark, few):
    pages = [(i, f"<p>{i % 7 if i < 20 else i}") for i in range(60)] + [(60, None), (61, ""), (5, "<p>5"), (5, "<p>5")]
    got = warc_store.distinct_payloads(spark.createDataFrame(pages, "page_id long, html string"), few)
    want = {(h or "").encode() for _, h in pages}
    assert order((r.sha256, bytes(r.payload)) for r in got.collect()) == order((hashlib.sha256(x).hexdigest(), x) for x in want)


def test_warc_exchanges_no_payload_that_comes_once(spark):
    path = common.shared_path(spark, "test-warc")
    pages = [(i, None, hashlib.shake_256(b"%d" % i).hexdigest(2000)) for i in range(500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    warc_store.write_archive(df, path)
    assert 0 < written() - before < 500 * 1000


def test_warc_of_nothing(spark):
    path = common.shared_path(spark, "test-warc")
    warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_store.verified(warc_store.read_archive(spark, path)).count() == 0


def brute_hits(docs, items, size=8):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return order(out)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contamination(spark, broadcast):
    docs = [(d, t) for d, t in texts() if t is None or len(t) < 10_000]
    passage = docs[0][1].split()
    items = [(1, " ".join(passage[5:20])), (2, " ".join(passage[12:24]).upper() + "!"), (3, "one two"), (4, "a"), (5, ""), (6, None), (10, " ".join(passage[5:20])), (7, "never seen at all by anyone in here ok"), (8, "1234")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, docs), bench, broadcast_rows=broadcast)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_hits(docs, items)
    assert {"lang", "word", "hits"} <= set(got.columns)
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    none = decontaminate.contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("n_items > 0 OR contaminated").count() == 0
