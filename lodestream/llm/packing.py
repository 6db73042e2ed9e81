"""Containers of fixed capacity filled best-fit, in bulk-synchronous rounds over rows.

Documents are range-sorted by size. The size classes (above capacity / 2, / 4, / 8, ...) are worked on from the largest down, each in sweeps:

1. The class's documents and the places that the gaps offer are range-sorted together, largest first. A gap offers a place for each
   document of the class that is sure to fit: two documents of a class need more than its upper bound.
2. A document's successor is the smallest free place before it in that order. As larger documents choose first, successors are
   matched like brackets: a place opens, a document closes the last one still open. Each task matches inside its range.
3. What a range leaves over is documents (their successors lie in earlier ranges) and then places. Conflicts over those are resolved by rank: the
   counts of the ranges, a row each, say which ranks of which range meet; the rows are joined by (range, rank).
4. Gaps shrink by what they have taken, and the sweep is repeated until the class is placed. Containers are opened when the remaining documents
   exceed the free room in total, or when a sweep finds no successor.

Nothing but counts per range reaches the driver, and no task holds more than its range. A class takes a sweep or two, at most about log2 of the
documents that fit into a container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordered import ranked
from lodestream.scratch import written


def brackets(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matched opening and closing brackets, pair by pair, in an array that is true where one opens."""
    depth = np.cumsum(np.where(opens, 1, -1))
    level = np.where(opens, depth, depth + 1)  # on one level opening and closing brackets take turns
    order = np.argsort(level, kind="stable")
    meets = np.flatnonzero((level[order][1:] == level[order][:-1]) & opens[order][:-1] & ~opens[order][1:])
    return order[meets], order[meets + 1]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents matched inside a range get a container; ``_res`` numbers the documents, and the places, that are left."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    opens = rows.column("position").is_null().to_numpy()
    place, document = brackets(opens)
    container = rows.column("container").to_numpy(zero_copy_only=False).astype(float)  # NaN for documents; exact up to 2**53
    container[document] = container[place]
    matched = np.zeros(len(opens), bool)
    matched[document] = True
    used = np.zeros(len(opens), bool)
    used[place] = True
    res = np.where(opens, np.cumsum(opens & ~used), np.cumsum(~opens & ~matched)) - 1
    out = rows.set_column(rows.schema.get_field_index("container"), "container", pa.array(container, pa.int64(), from_pandas=True))
    out = out.append_column("_part", pa.array(np.full(len(opens), TaskContext.get().partitionId(), np.int32)))
    out = out.append_column("_res", pa.array(res, pa.int64(), mask=matched))
    yield from out.filter(pa.array(~used)).to_batches()


def _across(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Which ranks meet, from (range, documents left, places left) in order; and how many documents.

    (range, first rank, end rank of the documents, range of the places, sum of both ranks): the last open place goes to the first document.
    """
    stack: list[list[int]] = []
    meets, many = [], 0
    for part, documents, places in counts:
        at = 0
        while at < documents and stack:
            other, free = stack[-1]
            n = min(documents - at, free)
            meets.append((part, at, at + n, other, free - 1 + at))
            at, many = at + n, many + n
            if n == free:
                stack.pop()
            else:
                stack[-1][1] -= n
        if places:
            stack.append([part, places])
    return meets, many


def pieces(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece, pieces, size``: a row per document, or per piece of one larger than ``capacity`` (only the last is not full)."""
    rows = df.select(key, F.coalesce(size, F.lit(0)).cast("long").alias("_size")).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("_size") / capacity)).cast("int"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    last = F.col("_size") - (F.col("pieces") - 1).cast("long") * capacity
    return rows.select(key, "piece", "pieces", F.when(F.col("piece") < F.col("pieces"), F.lit(capacity)).otherwise(last).cast("int").alias("size"))


def _fits(upper: int) -> tuple[Column, Column]:
    """How many documents of size ``upper`` a gap holds, and the power of two of that (-1 where none fits)."""
    many = F.floor(F.col("gap") / upper)
    return many, F.when(many > 0, F.floor(F.log2(many))).otherwise(-1).cast("int")


def _places(gaps: DataFrame, lower: int, upper: int, last: int, share: float) -> DataFrame:
    """``container, size, gap``: the places for documents above ``lower`` and up to ``upper``, of the gaps that hold the fewest of them.

    Gaps up to the power ``last`` take part, of that power itself about ``share`` of them.
    """
    many, power = _fits(upper)
    drawn = F.pmod(F.xxhash64("container"), F.lit(1 << 20)) < share * (1 << 20)
    rest = F.col("gap") - many * upper
    sizes = F.concat(F.array_repeat(F.lit(upper).cast("long"), many.cast("int")), F.when(rest > lower, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    return gaps.where((F.col("gap") > lower) & ((power < last) | ((power == last) & drawn))).select("container", "gap", F.explode(sizes).alias("size"))


def packed(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece, pieces, size, container``: every piece in a container (numbered from 0), none filled above ``capacity``.

    Only documents larger than ``capacity`` are split, into full pieces and a rest. A document of size 0 (or null) takes no room
    and lies in container 0. Repeated keys are documents of their own. An empty table gives no rows. ``df`` is read twice (the sort
    samples it), so sizes that are dear to compute should be written first.
    """
    if capacity < 1:
        raise ValueError("capacity has to be positive")
    spark = df.sparkSession
    bounds = [capacity]  # class k: sizes above bounds[k + 1], up to bounds[k]
    while bounds[-1]:
        bounds.append(bounds[-1] // 2)
    rows = ranked(pieces(df, key, size, capacity), [F.col("size").desc(), F.col(key).asc(), F.col("piece").asc()])
    of = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        of = F.when(F.col("size") > bounds[k + 1], k).otherwise(of)
    classes = {r["k"]: (r["n"], r["s"], r["m"]) for r in rows.groupBy(of.alias("k")).agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.max("size").alias("m")).collect()}  # a row a class
    columns = [key, "piece", "pieces", "size", "container"]
    within = lambda k: rows.where((F.col("size") > bounds[k + 1]) & (F.col("size") <= bounds[k]))
    first = within(0).withColumn("container", F.col("position") - 1)  # no two fit together
    done = [rows.where("size <= 0").withColumn("container", F.lit(0).cast("long")).select(columns), first.select(columns)]
    none = (0, 0, 0)
    opened, taken, _ = classes.get(0, none)
    gaps = written(first.select("container", (capacity - F.col("size")).cast("long").alias("gap")).where("gap > 0"), "gaps")
    room = opened * capacity - taken
    ahead = sum(s for k, (_, s, _) in classes.items() if k)  # size of all that is still to be placed
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"`{key}` {kind[key]}, piece int, pieces int, size long, position long, container long, gap long, _part int, _res long"

    for k in range(1, len(bounds) - 1):
        n, _, upper = classes.get(k, none)
        left, lower, stuck = within(k).withColumn("size", F.col("size").cast("long")), bounds[k + 1], False
        many, power = _fits(upper)
        while n:
            # A row a power of two: what gaps that hold so many documents of the class offer, how many they are, and their room; -2 holds none.
            seen = gaps.groupBy(F.when(F.col("gap") > lower, power).otherwise(-2).alias("p")).agg(F.sum(many).alias("m"), F.count("*").alias("g"), F.sum("gap").alias("s")).collect()
            free = sum(r["s"] for r in seen)
            ahead, room = ahead - (room - free), free
            offers = {r["p"]: (r["m"], r["g"]) for r in seen if r["p"] > -2}
            more = max(-(-(ahead - room) // capacity), -(-n // (capacity // upper)) if stuck else 0)
            if more > 0:
                gaps = gaps.unionByName(spark.range(opened, opened + more).select(F.col("id").alias("container"), F.lit(capacity).cast("long").alias("gap")))
                opened, room, each = opened + more, room + more * capacity, capacity // upper
                m, g = offers.get(each.bit_length() - 1, (0, 0))
                offers[each.bit_length() - 1] = (m + more * each, g + more)
            if not offers:
                stuck = True
                continue
            offers = sorted((p, m, g) for p, (m, g) in offers.items())
            want, last, share = n, 0, 1.0
            for last, offered, holders in offers:
                if last >= 0:  # smaller gaps all take part: what fits into them is seen in the sweep
                    share = 1.0 if stuck else min(1.0, 1.1 * want / offered + 16 / holders)
                    want -= offered
                    if want <= 0:
                        break
            places = _places(gaps, lower, upper, last, share)
            blank = {c: F.lit(None).cast(kind[c]).alias(c) for c in (key, "piece", "pieces", "position")}
            both = places.select(*blank.values(), "container", "size", "gap").unionByName(left.select(key, "piece", "pieces", "position", F.lit(None).cast("long").alias("container"), "size", F.lit(None).cast("long").alias("gap")))
            # Largest first; of places of one size those of the smallest gaps are taken first, and places stand before documents.
            order = [F.col("size").desc(), F.col("gap").desc_nulls_last(), F.col("container").asc_nulls_last(), F.col("position").asc()]
            ranged = both.select(key, "piece", "pieces", "size", "position", "container", "gap").repartitionByRange(*order).sortWithinPartitions(*order)
            swept = written(ranged.mapInArrow(_sweep, schema), "swept")
            rest = swept.where(F.col("_res").isNotNull())
            document = F.col("position").isNotNull()
            counts = rest.groupBy("_part").agg(F.count(F.when(document, 1)).alias("d"), F.count(F.when(~document, 1)).alias("p")).collect()  # a row a range
            meets, across = _across(sorted(tuple(r) for r in counts))
            inside = swept.where(document & F.col("_res").isNull())
            remaining = rest.where(document)
            open_documents = sum(r["d"] for r in counts)
            if meets:
                spans = spark.createDataFrame(meets, "_part int, _a long, _b long, _of int, _sum long")
                free = rest.where(~document).select(F.col("_part").alias("_of"), F.col("_res").alias("_rank"), F.col("container").alias("_to"))
                met = remaining.join(F.broadcast(spans), "_part").where((F.col("_res") >= F.col("_a")) & (F.col("_res") < F.col("_b")))  # at most two rows a range
                met = met.withColumn("_rank", F.col("_sum") - F.col("_res")).join(free, ["_of", "_rank"]).withColumn("container", F.col("_to"))
                inside = inside.select(columns).unionByName(written(met.select(columns), "met"))
                # A range's documents meet in order of rank, so those without a place are the ones from some rank on.
                ends = spans.groupBy("_part").agg(F.max("_b").alias("_end"))
                remaining = remaining.join(F.broadcast(ends), "_part", "left").where(F.col("_res") >= F.coalesce("_end", F.lit(0)))
            placed = inside.select(columns)
            left = remaining.select(key, "piece", "pieces", "size", "position")
            ledger = gaps.unionByName(placed.select("container", (-F.col("size")).alias("gap")))
            gaps = written(ledger.groupBy("container").agg(F.sum("gap").alias("gap")).where("gap > 0"), "gaps")
            # A gap that took its one document has no room for a second of the class; only wider ones are worth another look.
            n, stuck = open_documents - across, offers[-1][0] < 0 or n == open_documents - across
            done.append(placed)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.select(out.columns))
    return out.withColumn("size", F.col("size").cast("int"))


def containers(items: DataFrame, capacity: int) -> DataFrame:
    """``container, items, used, unused`` of :func:`packed` rows."""
    used = F.sum("size").cast("long")
    return items.groupBy("container").agg(F.count("*").alias("items"), used.alias("used"), (F.lit(capacity) - used).alias("unused"))
