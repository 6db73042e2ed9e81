"""Spans of at least ``least`` characters that stand word for word in more than one text.

1. Content-defined chunking: a gear hash rolls over the text (32 characters, one bit of shift each); the rightmost smallest hash
   of every ``window`` positions is a cut. A cut depends on the text around it and on nothing before, so an insertion
   moves no later cut, and any stretch of ``least`` characters contains a cut in each ``window`` of its own positions.
2. A chunk runs from a cut to the first cut at least ``reach`` further on. ``reach`` is chosen so that any common stretch of ``least``
   characters holds one whole chunk that both texts cut alike. Chunks are deduplicated by digest; a digest that occurs in
   one text only is dropped.
3. Around the chunks that remain, every window of ``least`` characters gets a digest. A window found in two texts is a shared
   span; its members are kept where a common stretch begins, that is where the characters before it differ.
4. Characters decide: members belong together if their windows are equal as text, and shared parts are compared with the text that
   represents their windows, a run at a time. Digests only choose what is compared.

Membership (:func:`span_members`) and shared parts are linear in the text. Texts that are equal as a whole count as one: chunks and windows
of copies are not compared with one another. Pairs are made only where a result of pairs is asked for: n texts below one header are n
members of one span, and n * (n - 1) / 2 pairs. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.ordered import small
from lodestream.scratch import written

GEAR = 32
#: Positions of which one is a cut. Smaller: more and longer chunks that are more selective.
WINDOW = 64
#: Characters worked on at once; longer texts go through in overlapping pieces of this size.
PIECE = 1 << 20
_NONE = 0x1FFFFF  # "no character before", above all code points
_BASE = 0x9E3779B97F4A7C15


def reach(least: int, window: int = WINDOW) -> int:
    """How far on a chunk looks for its end."""
    r = least - GEAR + 1 - 2 * window + 1
    if r < 1:
        raise ValueError(f"spans of {least} characters need a window of at most {(least - GEAR + 1) // 2}")
    return r


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of whole numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = np.cumprod(np.full(n, base, np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
    return _POWERS[base][:n]


class Prefix:
    """Digests of any stretch of a character array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, chars: np.ndarray) -> None:
        values = _mixed(chars) * _powers(_BASE, len(chars))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        self.back = _powers(pow(_BASE, -1, 1 << 64), len(chars) + 1)

    def digest(self, start: np.ndarray, end: np.ndarray, bits: int = 64) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return (_mixed(raw ^ (end - start).astype(np.uint64)) >> np.uint64(64 - bits)).view(np.int64)


def gear(chars: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at each position, over the 32 characters that end there."""
    h = (_mixed(chars) >> np.uint64(32)).astype(np.uint32)
    for shift in (1, 2, 4, 8, 16):  # doubling: a sum of m terms and the one m before give 2m terms
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint32(shift)
        h = more
    return h


def cuts(chars: np.ndarray, inside: np.ndarray, length: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the cuts. ``inside`` and ``length``: each character's place in its text, and that text's length."""
    n = len(chars)
    key = (gear(chars).astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width = 1
    while width * 2 <= window:
        key[: n - width] = np.minimum(key[: n - width], key[width:])
        width *= 2
    rest = window - width
    if rest:
        key[: n - rest] = np.minimum(key[: n - rest], key[rest:])
    whole = (inside >= GEAR - 1) & (inside + window <= length)
    return np.unique((np.uint64(0xFFFFFFFF) - (key[whole] & np.uint64(0xFFFFFFFF))).astype(np.int64))


def chunks(chars: np.ndarray, piece: np.ndarray, inside: np.ndarray, length: np.ndarray, far: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First position and end of each chunk; the characters that the first cut's hash has seen belong to it."""
    at = cuts(chars, inside, length, window)
    to = np.searchsorted(at, at + far)
    at, to = at[to < len(at)], at[to[to < len(at)]]
    own = piece[at] == piece[to]
    return at[own] - GEAR + 1, to[own] + 1


def _pieces(codes: list[np.ndarray], before: int, after: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Batches of (text, start, end, first own, last own + 1), each of about PIECE characters."""
    batch, held = [], 0
    for i, c in enumerate(codes):
        for lo in range(0, max(1, len(c)), PIECE):
            hi = min(len(c), lo + PIECE)
            start, end = max(0, lo - before), min(len(c), hi + after)
            batch.append((i, start, end, lo, hi))
            held += end - start
            if held >= PIECE:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def _codes(texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts.to_pylist()]


def _joined(codes: list[np.ndarray], batch: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The characters of a batch, and per character: piece, place in the piece, length of the piece; and the pieces' offsets."""
    sizes = np.array([e - s for _, s, e, _, _ in batch])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    chars = np.concatenate([codes[i][s:e] for i, s, e, _, _ in batch])
    piece = np.repeat(np.arange(len(batch)), sizes)
    return chars, piece, np.arange(len(chars)) - offsets[piece], sizes[piece], offsets


_CHUNKS = "doc long, t1 long, t2 long, digest long, first int, size int"


def _chunk_rows(least: int, window: int):
    far = reach(least, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                codes = _codes(b.column("text"))
                ids, t1, t2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "t1", "t2"))
                # A cut depends on `window` positions to both sides, a chunk ends within far + window of its first cut.
                for batch in _pieces(codes, window + GEAR, far + 3 * window + GEAR):
                    chars, piece, inside, length, offsets = _joined(codes, batch)
                    start, end = chunks(chars, piece, inside, length, far, window)
                    of, (text, lo, _, own, stop) = piece[start], np.array(batch).T
                    first = start - offsets[of] + lo[of]
                    ours = (first >= own[of]) & (first < stop[of])
                    start, end, of, first = start[ours], end[ours], of[ours], first[ours]
                    digest = Prefix(chars).digest(start, end)
                    doc = text[of]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[doc]), pa.array(t1[doc]), pa.array(t2[doc]), pa.array(digest), pa.array(first.astype(np.int32)), pa.array((end - start).astype(np.int32))],
                        names=["doc", "t1", "t2", "digest", "first", "size"],
                    )

    return run


def _gram_rows(least: int, bits: int):
    """A row per window of ``least`` characters that holds a listed chunk: digest, text, and start and character before in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                codes = _codes(b.column("text"))
                ids = b.column("doc").to_numpy(zero_copy_only=False)
                firsts, sizes = (b.column(c).to_pylist() for c in ("firsts", "sizes"))
                wanted = []
                for c, f, z in zip(codes, firsts, sizes, strict=True):
                    f, z = np.array(f, np.int64), np.array(z, np.int64)
                    lo, hi = np.maximum(f + z - least, 0), np.minimum(f, len(c) - least)
                    open_ = np.zeros(max(1, len(c) - least + 2), np.int32)
                    np.add.at(open_, lo[lo <= hi], 1)
                    np.add.at(open_, hi[lo <= hi] + 1, -1)
                    wanted.append(np.flatnonzero(np.cumsum(open_) > 0))
                for batch in _pieces(codes, 1, least):
                    chars, _, _, _, offsets = _joined(codes, batch)
                    prefix = Prefix(chars)
                    at, doc, first = [], [], []
                    for k, (i, start, _, own, stop) in enumerate(batch):
                        w = wanted[i]
                        w = w[(w >= own) & (w < stop)].astype(np.int64)
                        at.append(w - start + offsets[k])
                        doc.append(np.full(len(w), ids[i], np.int64))
                        first.append(w)
                    at, doc, first = (np.concatenate(x) for x in (at, doc, first))
                    prior = np.where(first > 0, chars[np.maximum(at - 1, 0)], _NONE).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(prefix.digest(at, at + least, bits)), pa.array(doc), pa.array((first << 21) | prior)], names=["gram", "doc", "place"])

    return run


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, text, n, t1, t2``; two hashes of 64 bits say which texts are equal. Rows without a key or a text have no spans."""
    t = F.col(text)
    return df.where(F.col(key).isNotNull() & t.isNotNull()).select(
        F.col(key).cast("long").alias("doc"), t.alias("text"), F.length(t).alias("n"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2")
    )


def _grams(texts: DataFrame, least: int, window: int, bits: int = 64) -> DataFrame:
    """Windows that may be shared, of one text per class of copies: ``gram, doc, place``, written."""
    long = texts.where(F.col("n") >= least)
    cut = written(long.select("doc", "t1", "t2", "text").mapInArrow(_chunk_rows(least, window), _CHUNKS), "chunks")
    shared = cut.groupBy("digest").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where(F.col("a") != F.col("b")).select("digest")
    shared = written(shared, "digests")
    near = cut.join(small(shared, 200_000), "digest", "left_semi")
    near = near.groupBy("doc", "t1", "t2").agg(F.collect_list("first").alias("firsts"), F.collect_list("size").alias("sizes"))  # one text's own chunks
    near = written(near, "near")
    one = near.groupBy("t1", "t2").agg(F.min("doc").alias("doc")).select("doc")
    near = near.join(one, "doc", "left_semi").select("doc", "firsts", "sizes")
    rows = long.select("doc", "text").join(small(written(near, "places"), 500_000, F.size("firsts")), "doc")
    return written(rows.mapInArrow(_gram_rows(least, bits), "gram long, doc long, place long"), "grams")


def _members(grams: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``span, span_at, doc, at, prior``: windows where a common stretch begins, by the first place that has the same characters; written."""
    rows = grams.withColumn("prior", F.col("place").bitwiseAND(F.lit(_NONE)))
    # Windows where a common stretch can begin: in two texts, and not always after the same character.
    forks = rows.groupBy("gram").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("prior").alias("p0"), F.max("prior").alias("p1"))
    forks = written(forks.where((F.col("d0") != F.col("d1")) & ((F.col("p0") != F.col("p1")) | (F.col("p1") == _NONE))).select("gram"), "forks")
    starts = written(rows.join(small(forks, 200_000), "gram", "left_semi").select("gram", "doc", F.shiftright("place", 21).cast("int").alias("at"), "prior"), "starts")
    shown = texts.select("doc", "text").join(small(starts, 200_000), "doc")
    shown = written(shown.select("gram", "doc", "at", "prior", F.substring("text", F.col("at") + 1, F.lit(least)).alias("window")), "windows")
    first = shown.groupBy("gram", "window").agg(F.min(F.struct("doc", "at")).alias("f"), F.max("doc").alias("last")).where(F.col("f.doc") != F.col("last"))
    first = small(written(first.select("gram", "window", F.col("f.doc").alias("span"), F.col("f.at").alias("span_at")), "first"), 50_000)
    return written(shown.join(first, ["gram", "window"]).select("span", "span_at", "doc", "at", "prior"), "members")


def _links(members: DataFrame) -> DataFrame:
    """``a, b`` (a < b): texts, one per class of copies, with a common window; the pairs of each span's members."""
    x, y = members.toDF("span", "span_at", "a", "i", "p"), members.toDF("span", "span_at", "b", "j", "q")
    pairs = x.join(y, ["span", "span_at"]).where((F.col("a") < F.col("b")) & ((F.col("p") != F.col("q")) | (F.col("p") == _NONE)))
    return pairs.select("a", "b").distinct()


def _classes(texts: DataFrame) -> DataFrame:
    """``doc, n, rep, copies``: the smallest key among equal texts, and how many there are; written."""
    keys = written(texts.select("doc", "n", "t1", "t2"), "keys")
    groups = keys.groupBy("t1", "t2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    return written(keys.join(groups, ["t1", "t2"]).select("doc", "n", "rep", "copies"), "classes")


def span_members(df: DataFrame, key: str, text: str, least: int, window: int = WINDOW, bits: int = 64) -> DataFrame:
    """``span, span_at, class, at``: every class of equal texts that has the ``least`` characters which stand at ``span_at`` in text ``span``.

    A class is named by its smallest key, as in :func:`shared_parts`, which gives each document's class. Two classes share a stretch exactly
    if they are members of one span. There is a row per member and place where a common stretch begins, however many others share it.
    """
    texts = _texts(df, key, text)
    return _members(_grams(texts, least, window, bits), texts, least).select("span", "span_at", F.col("doc").alias("class"), "at")


def shared_pairs(df: DataFrame, key: str, text: str, least: int, window: int = WINDOW, bits: int = 64) -> DataFrame:
    """``a, b``, a < b: every pair of documents with a common stretch of ``least`` or more characters (code points).

    ``bits`` of the windows' digests: fewer make more collisions, which the comparison of characters has to sort out.

    Copies of one text are compared once and expanded at the end, because the result is asked for in pairs. Stretches that only one
    document repeats don't count. Null keys, null texts and texts shorter than ``least`` have no pair. Keys are unique whole numbers.
    """
    texts = _texts(df, key, text)
    members = _classes(texts).where(F.col("n") >= least)
    links = _links(_members(_grams(texts, least, window, bits), texts, least))
    of = lambda name, rep: members.select(F.col("doc").alias(name), F.col("rep").alias(rep))
    across = links.join(of("x", "a"), "a").join(of("y", "b"), "b").select("x", "y")
    many = members.where(F.col("copies") > 1)
    within = many.select(F.col("doc").alias("x"), "rep").join(many.select(F.col("doc").alias("y"), "rep"), "rep").where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _covered(grams: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``doc, chars, spans``: what of a text stands in another one too, with the characters compared."""
    place = F.shiftright("place", 21).cast("int")
    known = grams.groupBy("gram").agg(F.min(F.struct("doc", place.alias("at"))).alias("f"), F.max("doc").alias("last")).where(F.col("f.doc") != F.col("last"))
    known = small(written(known.select("gram", F.col("f.doc").alias("rep"), F.col("f.at").alias("rep_at")), "known"), 200_000)
    places = grams.join(known, "gram").select("gram", "doc", place.alias("at"), "rep", "rep_at")
    others = places.where((F.col("doc") != F.col("rep")) | (F.col("at") != F.col("rep_at")))
    # Windows that follow one another in both texts are one run: compared at once.
    line = Window.partitionBy("doc", "rep", F.col("at") - F.col("rep_at")).orderBy("at")  # one text's windows
    runs = others.withColumn("_run", F.col("at") - F.row_number().over(line))
    runs = runs.groupBy("doc", "rep", (F.col("at") - F.col("rep_at")).alias("_by"), "_run").agg(F.min("at").alias("at"), (F.max("at") - F.min("at") + least).alias("n"))
    runs = written(runs.select("doc", "rep", "at", (F.col("at") - F.col("_by")).alias("rep_at"), "n"), "runs")
    used = written(runs.select(F.explode(F.array("doc", "rep")).alias("doc")).distinct(), "used")
    bodies = written(texts.select("doc", "text").join(small(used), "doc", "left_semi"), "bodies")
    one = runs.join(bodies, "doc").withColumn("s", F.substring("text", F.col("at") + 1, F.col("n"))).drop("text")
    both = one.join(bodies.select(F.col("doc").alias("rep"), F.col("text").alias("t")), "rep")
    same = written(both.select("doc", "rep", "at", "rep_at", "n", (F.col("s") == F.substring("t", F.col("rep_at") + 1, F.col("n"))).alias("same")), "same")
    good = same.where("same")
    found = good.select("doc", "at", "n").unionByName(good.where("doc <> rep").select(F.col("rep").alias("doc"), F.col("rep_at").alias("at"), "n"))
    if same.where("NOT same").limit(1).count():  # equal digests of different windows: all windows of those digests by their characters
        mixed = same.where("NOT same").select("doc", F.explode(F.sequence("at", F.col("at") + F.col("n") - least)).alias("at"))
        again = places.join(places.join(mixed, ["doc", "at"]).select("gram").distinct(), "gram", "left_semi")
        again = again.join(texts.select("doc", "text"), "doc").select("gram", "doc", "at", F.substring("text", F.col("at") + 1, F.lit(least)).alias("s"))
        equal = again.groupBy("gram", "s").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("gram", "s")
        found = found.unionByName(again.join(equal, ["gram", "s"], "left_semi").select("doc", "at", F.lit(least).alias("n")))
    line = Window.partitionBy("doc").orderBy("at", "n")  # one text's runs
    end = F.col("at") + F.col("n")
    reached = F.coalesce(F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    parts = found.withColumns({"_new": F.greatest(end - F.greatest(F.col("at"), reached), F.lit(0)), "_opens": (F.col("at") > reached).cast("int")})
    return parts.groupBy("doc").agg(F.sum("_new").alias("chars"), F.sum("_opens").alias("spans"))


def shared_parts(df: DataFrame, key: str, text: str, least: int, window: int = WINDOW, bits: int = 64) -> DataFrame:
    """A row per document: ``key, class, copies, n_chars, spans, shared_chars, shared``.

    ``shared_chars`` are the characters in stretches of ``least`` or more that another document has too, ``spans`` how many
    such stretches there are after joining overlapping ones; ``class`` is the smallest key with the same text. A text of at least
    ``least`` characters that has a copy is shared as a whole. Null or empty texts share 0 of 0 characters. Rows without a key are left out.
    """
    texts = _texts(df, key, text)
    classes = _classes(texts)
    covered = _covered(_grams(texts, least, window, bits), texts, least)
    both = classes.join(covered.withColumnRenamed("doc", "rep"), "rep", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= least)
    rows = both.select(
        F.col("doc").alias(key), F.col("rep").alias("class"), "copies", F.col("n").alias("n_chars"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).alias("spans"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("chars", F.lit(0))).alias("shared_chars"),
    )
    none = df.where(F.col(key).isNotNull() & F.col(text).isNull()).select(F.col(key).cast("long").alias(key), F.col(key).cast("long").alias("class"), *[F.lit(v).cast(t).alias(c) for c, v, t in (("copies", 1, "long"), ("n_chars", 0, "int"), ("spans", 0, "long"), ("shared_chars", 0, "long"))])
    rows = rows.unionByName(none)
    return rows.withColumn("shared", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
