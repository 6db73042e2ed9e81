"""Missing values filled from similar records: verified dependencies first, then groups, each fill with its origin.

A dependency D -> field is mined from the records that are complete in both: D is any one, or any two, of the candidate columns. One pass of
distinct-count sketches drops what cannot hold (each pair (D, field) beyond one a D costs at least a row) and what hardly repeats; the
rest is counted exactly, at every size, in one pass a field, and holds if at least ``confidence`` of the rows agree with the usual value of
their D. Two columns are tried only where neither alone holds. A dictionary has only the D values whose complete records all agree.
What no dictionary fills comes from the first of the groups that has a value: the middle one of the ordinary values for numbers, the most frequent value for
categories. The groups of a field are counted in the same pass as its dependencies, or, for numbers, in one pass for all of them: as counts and
sums of logarithmic bins, which are combined before the shuffle, so no group travels row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.clean import once
from lodestream.operators.ordered import small
from lodestream.scratch import written

#: The sketches' relative error, and the factor that covers it (four times the error): nothing is dropped that the exact count might accept.
ERROR, MARGIN = 0.05, 1.2
#: Bins of a power of two. A group's middle value is the mean of its readings in the bin of the median, so it is off by at most a bin (9 percent).
BINS = 8

Key = tuple[str, ...]


@dataclass(frozen=True)
class Field:
    """A field to fill. ``missing`` says for which values; ``low`` to ``high`` bound what enters a group's middle value. ``determinants``: the candidates, if not all."""

    name: str
    missing: Column
    groups: Sequence[Key]
    numeric: bool = False
    low: float = float("-inf")
    high: float = float("inf")
    determinants: Sequence[Key] | None = None


@dataclass(frozen=True)
class Dependency:
    determinant: Key
    field: str
    confidence: float
    dictionary: DataFrame = field(repr=False)


def _known(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out &= F.col(c).isNotNull()
    return out


def _hash(cols: Sequence[str]) -> Column:
    return F.when(_known(cols), F.xxhash64(*cols))


def _emptied(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``df`` with null for every missing value."""
    return df.withColumns({f.name: F.when(~F.coalesce(f.missing, F.lit(True)), F.col(f.name)) for f in fields})


def _grouped(df: DataFrame, sets: Sequence[Key], beside: Sequence[str], stats: Sequence[Column]) -> dict[Key, DataFrame]:
    """``stats`` by each of ``sets`` (and ``beside``) from one pass over ``df``, written; null keys have no group."""
    sets = list(dict.fromkeys(sets))
    columns = list(dict.fromkeys(c for s in sets for c in s)) + list(beside)
    out = df.groupingSets([[F.col(c) for c in (*s, *beside)] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id(*columns).alias("__lode_set"), *stats)
    out = written(out, "groups")
    bit = lambda s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s and c not in beside)
    drop = lambda s: [c for c in columns if c not in s and c not in beside]
    return {s: out.where((F.col("__lode_set") == bit(s)) & _known(s)).drop("__lode_set", *drop(s)) for s in sets}


def _screened(df: DataFrame, tests: Sequence[tuple[Field, Key]], confidence: float, repeats: float) -> tuple[set, dict]:
    """The tests that may hold, and the pairs, rows and distinct values of each."""
    if not tests:
        return set(), {}
    keys = list(dict.fromkeys(d for _, d in tests))
    stats = [x for j, d in enumerate(keys) for x in (F.count(_hash(d)).alias(f"k{j}"), F.approx_count_distinct(_hash(d), ERROR).alias(f"d{j}"))]
    stats += [x for i, (f, d) in enumerate(tests) for x in (F.count(_hash((*d, f.name))).alias(f"n{i}"), F.approx_count_distinct(_hash((*d, f.name)), ERROR).alias(f"p{i}"))]
    seen = df.agg(*stats).first()
    left, about = set(), {}
    for i, (f, d) in enumerate(tests):
        j = keys.index(d)
        n, pairs, rows, distinct = seen[f"n{i}"], seen[f"p{i}"], seen[f"k{j}"], seen[f"d{j}"]
        about[f.name, d] = (n, pairs, rows, distinct)
        unique = rows * MARGIN < repeats * distinct
        if n and not unique and pairs / MARGIN - distinct * MARGIN <= (1 - confidence) * n:
            left.add((f.name, d))
    return left, about


def _exact(f: Field, counts: dict[Key, DataFrame], sets: Sequence[Key], confidence: float) -> list[Dependency]:
    held = []
    for d in sets:
        each = counts[d].groupBy(*d).agg(F.count("*").alias("_v"), F.max("__lode_n").alias("_top"), F.sum("__lode_n").alias("_rows"), F.first(f.name).alias("__lode_value"))
        top, rows = each.agg(F.sum("_top"), F.sum("_rows")).first()
        if rows and top / rows >= confidence:
            held.append(Dependency(d, f.name, top / rows, each.where("_v = 1").select(*d, "__lode_value")))
    return held


def _mined(df: DataFrame, fields: Sequence[Field], candidates: Sequence[str], confidence: float, repeats: float, modes: bool) -> tuple[dict[str, list[Dependency]], dict[str, dict[Key, DataFrame]]]:
    held: dict[str, list[Dependency]] = {f.name: [] for f in fields}
    values: dict[str, dict[Key, DataFrame]] = {}
    about: dict = {}
    for width in (1, 2):
        tests = []
        for f in fields:
            sets = [d for d in f.determinants if len(d) == width] if f.determinants is not None else list(combinations([c for c in candidates if c != f.name], width))
            for d in sets:
                parts = [about[f.name, (c,)] for c in d if (f.name, (c,)) in about] if width == 2 else []
                # A pair of columns has at least the pairs of each, and at most rows / repeats values: it can't hold beyond that.
                hopeless = any(n and (p / MARGIN - (1 - confidence) * n > rows / repeats * MARGIN or rows * MARGIN < repeats * v) for n, p, rows, v in parts)
                minimal = not any(set(h.determinant) <= set(d) for h in held[f.name])
                if minimal and not hopeless:
                    tests.append((f, d))
        left, seen = _screened(df, tests, confidence, repeats)
        about |= seen
        for f in fields:
            sets = [d for g, d in tests if g.name == f.name and (f.name, d) in left]
            extra = list(f.groups) if modes and width == 1 and not f.numeric else []
            if sets or extra:
                counts = _grouped(df.where(F.col(f.name).isNotNull()), [*sets, *extra], [f.name], [F.count("*").alias("__lode_n")])
                held[f.name] += _exact(f, counts, sets, confidence)
                if extra:
                    usual = F.max(F.struct("__lode_n", f.name))[f.name].alias(f"__lode_{f.name}")
                    values[f.name] = {g: counts[g].groupBy(*g).agg(usual) for g in extra}
    return {k: sorted(v, key=lambda x: -x.confidence) for k, v in held.items() if v}, values


def _middles(df: DataFrame, fields: Sequence[Field], sets: Sequence[Key]) -> dict[Key, DataFrame]:
    """By each of ``sets``: ``__lode_<field>``, the middle of the ordinary values of each field."""
    x = F.col("__lode_x")
    each = F.array(*[F.struct(F.lit(f.name).alias("f"), F.when((F.col(f.name) >= f.low) & (F.col(f.name) <= f.high), F.col(f.name).cast("double")).alias("x")) for f in fields])
    keys = list(dict.fromkeys(c for s in sets for c in s))
    long = df.select(*keys, F.explode(each).alias("_e")).select(*keys, F.col("_e.f").alias("__lode_f"), F.col("_e.x").alias("__lode_x")).where(x.isNotNull())
    size = F.floor(F.log2(F.abs(x)) * BINS) + BINS * 1100  # above 0 for all doubles
    long = long.withColumn("__lode_bin", F.when(x == 0, 0).otherwise(F.signum(x) * size).cast("int"))
    tables = _grouped(long, sets, ["__lode_f", "__lode_bin"], [F.count("*").alias("_n"), F.sum("__lode_x").alias("_s")])
    out = {}
    for s, bins in tables.items():
        line = Window.partitionBy(*s, "__lode_f")  # the bins of one group
        rows = bins.withColumns({"_upto": F.sum("_n").over(line.orderBy("__lode_bin")), "_half": F.ceil(F.sum("_n").over(line) / 2)})
        rows = rows.where((F.col("_upto") >= F.col("_half")) & (F.col("_upto") - F.col("_n") < F.col("_half")))
        out[s] = rows.groupBy(*s).agg(*[F.max(F.when(F.col("__lode_f") == f.name, F.col("_s") / F.col("_n"))).alias(f"__lode_{f.name}") for f in fields])
    return out


def mine(df: DataFrame, fields: Sequence[Field], candidates: Sequence[str] = (), confidence: float = 0.99, repeats: float = 2.0) -> dict[str, list[Dependency]]:
    """The dependencies that hold, by field, the most reliable first. An empty table has none. ``repeats``: rows a D value has on average at least."""
    return _mined(_emptied(df, fields), fields, candidates, confidence, repeats, False)[0]


def filled(df: DataFrame, fields: Sequence[Field], candidates: Sequence[str] = (), key: str | None = None, confidence: float = 0.99) -> DataFrame:
    """``df``, every row, with missing values of ``fields`` replaced and a column ``<field>_from`` for each.

    ``<field>_from`` is null where the value was there, else ``fd:<columns>``, ``group:<columns>``, ``all`` (the whole table) or ``none``
    where no record has a value (it is then null). Categories are filled before numbers, so numbers may use groups of a filled category.
    Only rows with something missing are joined with dictionaries and group values; the others pass through. Null
    determinants and group keys match nothing. With ``key``, repeats of a key count once in what is learned; every row is filled. A column of
    ``df`` that is called like a mark is replaced by it. ``df`` is read once.
    """
    marks = [f"{f.name}_from" for f in fields]
    rows = written(_emptied(df.drop(*marks), fields), "rows")
    known = written(once(rows, key), "once") if key else rows
    dependencies, values = _mined(known, fields, candidates, confidence, 2.0, True)
    numbers = [f for f in fields if f.numeric]
    sets = list(dict.fromkeys(tuple(g) for f in numbers for g in f.groups))
    if sets:
        middles = _middles(known, numbers, sets)
    gap = F.lit(False)
    for f in fields:
        gap |= F.col(f.name).isNull()
    whole = rows.where(~gap).withColumns({m: F.lit(None).cast("string") for m in marks})
    out = rows.where(gap).withColumns({m: F.lit(None).cast("string") for m in marks})

    def joined(out: DataFrame, keys: Key, table: DataFrame, names: Sequence[str], label: str) -> DataFrame:
        if keys:
            table = small(table.withColumnsRenamed({k: f"__lode_k_{k}" for k in keys}))
            on = F.lit(True)
            for k in keys:
                on &= out[k] == F.col(f"__lode_k_{k}")
            out = out.join(table, on, "left")
        else:
            out = out.crossJoin(F.broadcast(table))  # one row
        for n in names:
            use = F.col(n).isNull() & F.col(f"__lode_{n}").isNotNull()
            out = out.withColumns({f"{n}_from": F.when(use, F.lit(label)).otherwise(F.col(f"{n}_from")), n: F.coalesce(F.col(n), F.col(f"__lode_{n}").cast(df.schema[n].dataType))})
        return out.drop(*[f"__lode_{n}" for n in names], *[f"__lode_k_{k}" for k in keys])

    title = lambda g: f"group:{','.join(g)}" if g else "all"
    for f in [*[f for f in fields if not f.numeric], *numbers]:
        open_ = F.col(f.name).isNull()
        out = out.withColumn(f"__lode_open_{f.name}", open_)
        for d in dependencies.get(f.name, []):
            out = joined(out, d.determinant, d.dictionary.withColumnRenamed("__lode_value", f"__lode_{f.name}"), [f.name], f"fd:{','.join(d.determinant)}")
        if not f.numeric:
            for g in f.groups:
                out = joined(out, tuple(g), values[f.name][g], [f.name], title(g))
    for g in sets:
        names = [f.name for f in numbers if g in [tuple(x) for x in f.groups]]
        out = joined(out, g, middles[g].select(*g, *[f"__lode_{n}" for n in names]), names, title(g))
    for f in fields:
        out = out.withColumn(f"{f.name}_from", F.when(F.col(f"__lode_open_{f.name}"), F.coalesce(f"{f.name}_from", F.lit("none"))))
    return whole.unionByName(out.select(whole.columns))
