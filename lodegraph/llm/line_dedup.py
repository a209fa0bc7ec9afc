"""Fuzzy line dedup by MinHash, in DataFrame functions alone: of lines that are near copies, one stays in the corpus.

Lines are similar as the sets of their `chars`-character shingles are (exact Jaccard; a line shorter than a shingle is
one shingle; characters are UTF-16 code units). Two lines whose similarity is at least `threshold` are near copies.

1. Every line that is not blank takes part, at every length; blank lines stay as they are.
2. Signature: `bands` times `rows` MinHash values over the line's runs of `run` characters (the whole line if it is
   shorter), a minimum of one hash function each, made by generated code over exploded positions and aggregation. Lines
   of at most `SHORT` characters have a second one over runs of `chars` characters.
3. Banding: the `rows` values of a band are its key. Near copies whose similarity by runs is s share a band with
   probability 1 - (1 - s^rows)^bands; README has the recall measured by line length. Lines that share a band are
   candidates unless their odd sketches show that they can't link: a sketch has the parity of a set's shingles in each of
   `SKETCH` classes of hashes, so two sets differ in as many shingles at least as their sketches do in bits. This loses no link.
4. Every line of a band is compared with the band's most frequent one, and those that are in another class with the most
   frequent of them, a few times. Bands whose lines are then still in several classes are examined in full: lines outside
   a band's largest class meet all lines of other classes, in the least band that both have, where a band has at most
   `SMALL_BAND` lines, and otherwise an exact join over prefixes of the lines' shingle sets, rarest shingles first. No
   candidates stay unexamined.
5. A pair links by the exact Jaccard similarity of its two sets.
6. Union-find over links; of each class, and of equal lines, the occurrence with the smallest (doc_id, position) stays.

Null text has no lines and stays null. Rows that repeat both doc_id and text are one row's worth: each keeps what the
first keeps. Null doc_ids come first. A text whose lines all go becomes empty. n_chars, where present, is recounted.
Other columns pass through; columns named n_lines or n_dropped are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import components, fewer, is_small, stored, table, unused

#: lines of a band up to which its pairs are made one by one
SMALL_BAND = 20_000
#: characters up to which a line has a second signature, of shorter runs
SHORT = 64
#: ids that may be broadcast to find their lines (16 bytes each); beyond, lines are shuffled to them
BROADCAST_IDS = 1_000_000
#: bits of a line's sketch
SKETCH = 1024
#: positions of one block of a long line, in bytes of UTF-16
BLOCK = 1 << 16
#: runs of a line in one row of the minima's input: a line is looked up, and its minima stored, once for so many
STEP = 32
#: shingles of a set in one row of the sketches' input
SET_STEP = 8
#: bytes of documents that a task reads at least, where there are tasks for all cores
TASK = 1 << 25
#: the same for band keys, by Spark's estimate of the minima's bytes
KEYS = 1 << 26
BLANKS = " \t\x0b\f\r"


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, pos, line, id) of each line that is not blank; doc is the hash of its doc_id and text, id of the line."""
    lines = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # trimmed at the left alone, which ends at the first other character: at the right, Spark looks at all characters first
    return lines.filter(F.ltrim("line", F.lit(BLANKS)) != "").withColumn("id", F.xxhash64("line"))


def minima(lines: DataFrame, run: Column | int, orders: Callable[[Column], list[Column]]) -> DataFrame:
    """(id, run, m0, m1, ..., n): the least of each order (of a hash) of the runs of `run` characters of (id, line); n rows had the line."""
    wide = lines.select("id", (run if isinstance(run, Column) else F.lit(run)).alias("run"), F.encode("line", "UTF-16BE").alias("b"))
    wide = wide.select("id", "run", "b", (F.col("run") * 2).alias("size"))
    wide = wide.select("id", "run", "b", "size", F.greatest(F.octet_length("b") - F.col("size") + 1, F.lit(1)).alias("last"))
    wide = wide.select("id", "run", "b", "size", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(BLOCK))).alias("start"))
    each = wide.select("id", "run", "b", "size", "last", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (BLOCK - 2), F.col("last")), F.lit(2 * STEP))).alias("at"))
    # the runs of a step, the last one again beyond the end: it changes no minimum
    hashes = [F.xxhash64(F.substring("b", F.least(F.col("at") + 2 * k, F.col("last")), F.col("size"))).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"h{k}") for k in range(STEP)]
    each = each.select("id", "run", *hashes, (F.col("at") == 1).cast("int").alias("first"))
    low = [F.min(F.least(*x)).alias(f"m{j}") for j, x in enumerate(zip(*[orders(F.col(f"h{k}")) for k in range(STEP)]))]
    return each.groupBy("id", "run").agg(*low, F.sum("first").alias("n"))


def band_keys(lines: DataFrame, chars: int, run: int, bands: int, rows: int) -> DataFrame:
    """(id, n, band) from (id, line): how many rows have the line, and the keys of its bands."""
    # nearness to a point, by XOR: the cheapest order; every hash of two lines together is as likely to be the nearest
    points = lambda h: [h.bitwiseXOR(F.lit((j * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF)) for j in range(bands * rows)]
    # both signatures in one pass over the lines
    runs = F.when(F.length("line") <= SHORT, F.array(F.lit(run), F.lit(chars))).otherwise(F.array(F.lit(run)))
    low = minima(lines.select("id", "line", F.explode(runs).alias("run")), F.col("run"), points)
    keys = [F.xxhash64("run", F.lit(k), *[f"m{j}" for j in range(k * rows, (k + 1) * rows)]) for k in range(bands)]
    return fewer(low, KEYS).select("id", "n", F.explode(F.array(*keys)).alias("band"))


MARKS = [f"d{k}" for k in range(SKETCH // 64)]


def sketches(lines: DataFrame, chars: int) -> DataFrame:
    """(id, size, d0, d1, ...): how many shingles a line's set has, and the parities of their numbers by class, 64 in a long."""
    each = lines.select("id", shingles("line", chars).alias("s"))
    each = each.select("id", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(SET_STEP))).alias("at"))
    # the shingles of a step; beyond the end, there is no class
    h = [F.get("s", F.col("at") + k) for k in range(SET_STEP)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(x, F.lit(0)).bitwiseAND(F.lit(63)).cast("int")).alias(f"bit{k}") for k, x in enumerate(h)]
    words = [F.coalesce(F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(len(MARKS) - 1)), F.lit(-1)).cast("int").alias(f"word{k}") for k, x in enumerate(h)]
    each = each.select("id", F.when(F.col("at") == 0, F.size("s")).otherwise(0).alias("size"), *bits, *words)
    parity = lambda w: reduce(Column.bitwiseXOR, [F.when(F.col(f"word{k}") == w, F.col(f"bit{k}")).otherwise(F.lit(0).cast("long")) for k in range(SET_STEP)])
    return each.groupBy("id").agg(F.sum("size").alias("size"), *[F.bit_xor(parity(w)).alias(m) for w, m in enumerate(MARKS)])


def may_link(threshold: float) -> Callable[[str, str], Column]:
    """Whether the sketches of the two sides let their sets reach the threshold t: sets that do differ in at most (1 - t) / (1 + t) of the sum of their sizes."""

    def agree(x: str, y: str) -> Column:
        n, m = F.col(f"size{x}"), F.col(f"size{y}")
        differ = reduce(Column.__add__, [F.bit_count(F.col(f"{c}{x}").bitwiseXOR(F.col(f"{c}{y}"))) for c in MARKS])
        return (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * (n + m) + 1e-6)

    return agree


def most_frequent(rows: DataFrame) -> DataFrame:
    """(band, top): the most frequent line of each band with several, of rows (band, id, n)."""
    tops = rows.groupBy("band").agg(F.max(F.struct("n", "id"))["id"].alias("top"), F.count(F.lit(1)).alias("lines"))
    return tops.filter("lines > 1").select("band", "top")


def shingles(line: Column | str, chars: int) -> Column:
    """The hashes of a line's different shingles."""
    wide = lambda b: F.sequence(F.lit(1), F.greatest(F.octet_length(b) - F.lit(2 * chars - 1), F.lit(1)), F.lit(2))
    # the outer transform binds the encoded line, which the inner one would make anew at each place
    each = F.transform(F.array(F.encode(line, "UTF-16BE")), lambda b: F.transform(wide(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(2 * chars)))))
    return F.array_distinct(F.element_at(each, 1))


def places(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, doc, pos, id, line) of each line that is not blank; line is null but for these ids."""
    ids = F.broadcast(ids) if is_small(ids, BROADCAST_IDS) else ids
    here = occurrences(docs).join(ids.select("id", F.lit(True).alias("here")), "id", "left")
    return here.select("doc_id", "doc", "pos", "id", F.when(F.col("here"), F.col("line")).alias("line"))


def verified(lines: DataFrame, pairs: DataFrame, chars: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose lines are near copies."""
    side = lambda i, x: lines.select(F.col("id").alias(i), F.col("line").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    # the generator keeps the optimizer from making the sets several times
    both = both.select("a", "b", F.explode(F.array(F.struct(shingles("x", chars).alias("x"), shingles("y", chars).alias("y")))).alias("s"))
    both = both.select("a", "b", F.size("s.x").alias("nx"), F.size("s.y").alias("ny"), F.size(F.array_intersect("s.x", "s.y")).alias("i"))
    # i / (nx + ny - i) >= t
    return both.filter(F.col("i") >= threshold / (1 + threshold) * (F.col("nx") + F.col("ny")) - 1e-9).select("a", "b")


def prefix_pairs(lines: DataFrame, ids: DataFrame, chars: int, threshold: float) -> DataFrame:
    """(a, b): all pairs of ids (id, root) of different roots that can meet the threshold, by an exact prefix-filtered join.

    Sets as similar as the threshold share a shingle within their n - ceil(threshold n) + 1 first ones, rarest first.
    """
    lines = lines.join(ids.select("id"), "id", "left_semi")
    each = lines.select("id", F.explode(shingles("line", chars)).alias("tok"))
    often = each.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    per = each.join(often, "tok").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("s"))
    per = per.withColumn("n", F.size("s")).join(ids, "id")
    first = F.slice("s", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int"))
    rows = stored(per.select("id", "root", "n", F.explode(first).alias("t")).filter("t.df > 1").select("id", "root", "n", "t.tok"))
    x, y = (rows.select("tok", *[F.col(c).alias(f"{c}{i}") for c in ("id", "root", "n")]) for i in "xy")
    pairs = x.join(y, "tok").filter("idx < idy AND rootx <> rooty").filter(F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9)
    return pairs.select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()


def line_links(docs: DataFrame, chars: int, threshold: float, run: int, bands: int, rows: int) -> DataFrame:
    """(a, b): ids of lines that are near copies; their components are those of all links between candidates."""
    return placed_links(docs, chars, threshold, run, bands, rows)[1]


def placed_links(docs: DataFrame, chars: int, threshold: float, run: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The places of all lines (doc_id, doc, pos, id), and line_links: the texts are split twice, for the minima and for both of these."""
    keys = band_keys(occurrences(docs).select("id", "line"), chars, run, bands, rows).repartition("band")  # one exchange for the counts and the join
    # most bands have one line: found and left out by hashing, so that only the others' rows are sorted
    sums = keys.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("n").alias("most"))
    several = keys.join(sums.filter("low <> high").select("band", "most").hint("shuffle_hash"), "band")
    top = F.max(F.when(F.col("n") == F.col("most"), F.col("id"))).over(Window.partitionBy("band"))
    near = stored(several.select("band", "id", "n", top.alias("top")))
    at = stored(places(docs, stored(near.select("id").distinct())))
    lines = stored(at.filter("line is not null").groupBy("id").agg(F.first("line").alias("line")))
    marks = stored(sketches(lines, chars))
    links = band_links(near, marks, may_link(threshold), lambda pairs: verified(lines, pairs, chars, threshold), lambda ids: prefix_pairs(lines, ids, chars, threshold))
    return at.drop("line"), links


def band_links(near: DataFrame, marks: DataFrame, agree: Callable, verify: Callable, wide: Callable | None = None, rounds: int = 2, found: DataFrame | None = None) -> DataFrame:
    """(a, b): links between ids of near (band, id, n, top) whose marks agree and that verify (pairs to pairs) lets pass.

    marks: id and the columns that agree compares, by the names of two sides. wide: ids (id, root) to all pairs that can pass, for bands of over SMALL_BAND ids. found: links known before.
    """
    names = [c for c in marks.columns if c != "id"]
    mark = lambda x: marks.select(F.col("id").alias(f"id{x}"), *[F.col(c).alias(c + x) for c in names])
    classes_of = lambda links: stored(components(links).select(F.col("node").alias("id"), "root"))
    classes = None if found is None else classes_of(found)
    left = near
    for k in range(rounds):
        # the ids that are left in a band, beside the most frequent one of them
        if k:
            left = stored(left.drop("top").join(most_frequent(left), "band").select("band", "id", "n", "top"))
        pairs = left.filter("id <> top").select(F.col("id").alias("idx"), F.col("top").alias("idy")).distinct()
        pairs = stored(pairs.join(mark("x"), "idx").join(mark("y"), "idy").filter(agree("x", "y")).select(F.col("idx").alias("a"), F.col("idy").alias("b")))
        if pairs.isEmpty():
            break
        more = stored(verify(pairs))
        found = more if found is None else found.union(more)
        classes = classes_of(found)
        of = lambda c, name: classes.select(F.col("id").alias(c), F.col("root").alias(name))  # noqa: B023, E731
        left = left.filter("id <> top").join(of("id", "r"), "id", "left").join(of("top", "t"), "top", "left").filter(F.coalesce("r", "id") != F.coalesce("t", "top")).drop("r", "t")
    if found is None:
        return near.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    # all pairs of ids of a band that are still in different classes
    rest = near.join(classes, "id", "left").select("band", "id", "top", F.coalesce("root", "id").alias("root"))
    mixed = rest.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"))
    rest = stored(rest.filter("id <> top").join(mixed.filter("roots > 1").drop("roots"), "band"))
    if rest.isEmpty():
        return found
    small = rest.filter(F.col("n") <= SMALL_BAND) if wide else rest
    bands = small.groupBy("id").agg(F.collect_set("band").alias("bands"))
    small = stored(small.select("band", "id", "root", "main").join(marks.join(bands, "id"), "id"))
    side = lambda df, x: df.select(*[F.col(c).alias(f"{c}{x}") for c in ("band", "id", "root", "main", "bands", *names)])
    x, y = side(small.filter("root <> main"), "x"), side(small, "y")
    meet = (F.col("bandx") == F.col("bandy")) & (F.col("rootx") != F.col("rooty")) & ((F.col("rooty") == F.col("mainy")) | (F.col("idx") < F.col("idy"))) & agree("x", "y")
    once = F.array_min(F.array_intersect("bandsx", "bandsy")) == F.col("bandx")
    more = x.join(y, meet & once).select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b"))
    large = stored(rest.filter(F.col("n") > SMALL_BAND).select("id", "root").distinct()) if wide else None
    if large is not None and not large.isEmpty():
        some = wide(large).select(F.col("a").alias("idx"), F.col("b").alias("idy"))
        more = more.union(some.join(mark("x"), "idx").join(mark("y"), "idy").filter(agree("x", "y")).select("idx", "idy"))
    return found.union(stored(verify(stored(more.distinct()))))


def dropped_lines(docs: DataFrame, chars: int = 5, threshold: float = 0.8, run: int = 9, bands: int = 8, rows: int = 3) -> DataFrame:
    """(doc_id, doc, gone): the places of the lines that go, for each text that loses any; doc is the hash of its doc_id and text."""
    at, links = placed_links(docs, chars, threshold, run, bands, rows)
    classes = components(links).select(F.col("node").alias("id"), "root")
    occ = at.join(classes.hint("shuffle_hash"), "id", "left").select("doc_id", "doc", "pos", F.coalesce("root", "id").alias("cls"))
    first = occ.groupBy("cls").agg(F.min(F.struct("doc_id", "pos", "doc")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a key of its own gives the join its own exchange, whose large partitions can be split
    first = first.select(F.hash("cls").alias("k"), "cls", "first")
    rest = occ.withColumn("k", F.hash("cls")).join(first.hint("shuffle_hash"), ["k", "cls"]).filter(~F.struct("doc_id", "pos", "doc").eqNullSafe(F.col("first")))
    return rest.groupBy("doc_id", "doc").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, with text without its dropped lines, and n_lines and n_dropped."""
    docs = fewer(docs, TASK).drop("n_lines", "n_dropped")
    doc, key, other, gone = unused(docs, "doc", "key", "other", "gone")
    drop = dropped_lines(docs.select("doc_id", "text"), **options).select(F.col("doc_id").alias(other), F.col("doc").alias(key), F.col("gone").alias(gone))
    out = docs.withColumn(doc, F.xxhash64("doc_id", "text")).join(drop, (F.col(doc) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(other)), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    cols = {c: F.col(c) for c in docs.columns} | {"text": text}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in cols.items()], F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
