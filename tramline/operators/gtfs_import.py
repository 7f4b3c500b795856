"""Schedule import: id translation, typed loads, packed sequences and integrity checks."""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import numbered, save


# Codes of the schedule format.
CODES = {
    "location_type": (0, 1, 2, 3, 4),
    "route_type": (0, 1, 2, 3, 4, 5, 6, 7, 200, 1100, 1500),
    "pickup_type": (0, 1, 2, 3),
    "drop_off_type": (0, 1, 2, 3),
    "timepoint": (0, 1),
    "availability": (0, 1, 2),
    "exception_type": (1, 2),
    "direction": (0, 1),
}
#: What an empty cell means.
DEFAULTS = {"location_type": 0, "pickup_type": 0, "drop_off_type": 0, "timepoint": 1, "availability": 0}
#: Ids of a kind that are broadcast, at most; more are joined by a shuffle, as the sizes of packed files say little of the memory that they take.
FEW = 100_000
#: Kinds whose unknown codes are kept.
OPEN = ("location_type", "route_type", "pickup_type", "drop_off_type", "availability")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _filled(c: Column) -> Column:
    """A trimmed text cell, null where empty: casting an empty text costs an exception, even where that gives null."""
    return F.nullif(F.trim(c), F.lit(""))


def code(c, kind: str) -> Column:
    """Integer code of a text cell: the default where empty; unknown codes pass where the format allows, else null."""
    value = _filled(_c(c)).try_cast("int")
    kept = value if kind in OPEN else F.when(value.isin(*CODES[kind]), value)
    return F.coalesce(kept, F.lit(DEFAULTS.get(kind)).cast("int"))


def gtfs_date(c) -> Column:
    return F.date_format(_c(c), "yyyyMMdd")


def hex_color(r, g, b) -> Column:
    """RRGGBB in capitals."""
    return F.concat(*[F.lpad(F.hex(_c(x).cast("long")), 2, "0") for x in (r, g, b)])


def checked_cast(c, kind: str) -> Column:
    """Cast to ``short`` or ``int``; a value out of range fails the job."""
    bits = {"short": 15, "int": 31}[kind]
    value = _c(c)
    return F.when(value.isNull() | value.between(-(1 << bits), (1 << bits) - 1), value.cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {kind}: "), value.cast("string"))).cast(kind))


def optional_reference(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


#: Row numbers of a version's file that are numbered together, as a power of two.
BLOCK = 16


def _first_mentions(named: DataFrame, by: list[str]) -> DataFrame:
    """The least place (spec_ord, row_ord, ref_ord; nulls first) at which each id is mentioned. Rows without a ``row_ord`` count where no other of the same spec_ord and ref_ord has one.

    A place is packed into one number, so that one aggregation by hashes finds it and ids move once.
    """
    spec, row, ref = F.col("spec_ord"), F.col("row_ord"), F.col("ref_ord")
    fits = spec.between(0, 7) & ref.between(0, 6) & row.between(-(1 << 56), (1 << 56) - 1)
    packed = F.shiftleft(spec.cast("long"), 60) + F.shiftleft(row + (1 << 56), 3) + ref
    place = F.when(row.isNotNull(), F.when(fits, packed).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no place of a mention:"), spec, row, ref)).cast("long")))
    bit = F.expr("shiftleft(1L, cast(spec_ord * 8 + ref_ord as int))")
    none = F.lit(0).cast("long")
    d = named.groupBy(*by, "kind", "gtfs_id").agg(F.min(place).alias("_at"), F.bit_or(F.when(row.isNull(), bit).otherwise(none)).alias("_bare"), F.bit_or(F.when(row.isNotNull(), bit).otherwise(none)).alias("_seen"))
    d = d.withColumn("_bare", F.col("_bare").bitwiseAND(F.bitwise_not("_seen")))
    # The lowest bit is the first of the places without a row.
    lowest = F.when(F.col("_bare") != 0, F.bit_count(F.col("_bare").bitwiseAND(-F.col("_bare")) - 1))
    least = F.shiftright("_at", 60).cast("int")
    d = d.withColumn("_lowest", F.when(F.coalesce(F.shiftright(lowest, 3) <= least, F.lit(True)), lowest))
    return d.select(
        *by, "kind", "gtfs_id", F.coalesce(F.shiftright("_lowest", 3), least).alias("spec_ord"),
        F.when(F.col("_lowest").isNull(), F.shiftright(F.col("_at").bitwiseAND((1 << 60) - 1), 3) - (1 << 56)).alias("row_ord"),
        F.coalesce(F.col("_lowest").bitwiseAND(7), F.col("_at").bitwiseAND(7)).cast("int").alias("ref_ord"),
    )


def id_map(mentions: DataFrame) -> DataFrame:
    """(kind, gtfs_id, item_id) of mentions (spec_ord, row_ord, ref_ord, kind, gtfs_id): one counter for all kinds, in order of first mention.
    With a column ``version_id`` each version has a counter of its own.

    Rows without an id (``gtfs_id`` null) take a number each. First mentions are found by one aggregation by hashes and written before they
    are sorted; the dense numbers come from sorted ranges and their offsets, so no task sees all ids. Versions are numbered by blocks of
    row numbers, which need no ranges to be found.
    """
    place = ["spec_ord", "row_ord", "ref_ord"]
    by = ["version_id"] if "version_id" in mentions.columns else []
    named = _first_mentions(mentions.filter("gtfs_id is not null"), by)
    bare = mentions.filter("gtfs_id is null").select(*by, "kind", "gtfs_id", *place)
    firsts = save(named.unionByName(bare))
    if by:
        block = [*by, "spec_ord", "_block"]
        firsts = firsts.withColumn("_block", F.coalesce(F.shiftright("row_ord", BLOCK), F.lit(-(1 << 60))))
        # One row a block and version.
        sizes = firsts.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("spec_ord", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.row_number().over(Window.partitionBy(*block).orderBy("row_ord", "ref_ord"))
        firsts = firsts.withColumn("_own", own).join(sizes.select(*block, before.alias("_before")), block).withColumn("item_id", F.col("_before") + F.col("_own"))
    else:
        firsts = numbered(firsts, place, "item_id")
    return firsts.select(*by, "kind", "gtfs_id", F.col("item_id").cast("int").alias("item_id"), F.struct(*place).alias("at"))


def translate(df: DataFrame, ids: DataFrame, columns: dict[str, tuple[str, str]], few: Collection[str] = ()) -> DataFrame:
    """Add item ids: ``columns`` maps a new name to (kind, column of text ids). Empty references give null; ids that no row defines have numbers too.
    Ids with a ``version_id`` are those of that version. Kinds in ``few`` are broadcast, the others never."""
    for name, (kind, column) in columns.items():
        own = ids.filter(F.col("kind") == kind).select(F.col("gtfs_id").alias("_ref"), F.col("item_id").alias(name), *([F.col("version_id").alias("_version")] if "version_id" in ids.columns else []))
        met = F.col("_key") == F.col("_ref")
        if "_version" in own.columns:
            met &= F.col("version_id") == F.col("_version")
        own = F.broadcast(own) if kind in few else own.hint("merge")
        df = df.withColumn("_key", optional_reference(column)).join(own, met, "left").drop("_key", "_ref", "_version")
    return df


#: What stands for bytes that are no UTF-8 in a text that was read.
UNREADABLE = "\ufffd"
_RANGES = {"short": 15, "int": 31}


def _cell(c: Column, kind: str) -> tuple[Column, Column]:
    """The value of a text cell, null where it does not read as its type, and whether that is so (not in an empty cell)."""
    filled = F.trim(F.coalesce(c, F.lit(""))) != ""
    garbled = F.coalesce(c.contains(UNREADABLE), F.lit(False))
    if kind in CODES:
        return code(c, kind), garbled
    if kind == "flag":
        return F.trim(c) == "1", garbled
    if kind == "color":
        return F.upper(F.nullif(F.trim(c), F.lit(""))), garbled
    if kind == "string":
        return F.nullif(c, F.lit("")), garbled
    if kind == "time":
        part = lambda k: F.split_part(_filled(c), F.lit(":"), F.lit(k)).try_cast("long")
        value = part(1) * 3600 + part(2) * 60 + part(3)
    else:
        value = F.nullif(c, F.lit("")).try_cast("decimal(38,0)" if kind in _RANGES else kind)
    return value, garbled | (value.isNull() & filled)


def _raw_cells(raw: DataFrame, spec: dict[str, tuple[str, str]]) -> dict[str, tuple[Column, str]]:
    """Each column's raw cell as text (null where the raw table lacks it) and its kind."""
    has = {c.strip().lower(): c for c in raw.columns}
    return {name: (F.col(f"`{has[source]}`").cast("string") if source in has else F.lit(None).cast("string"), kind) for name, (source, kind) in spec.items()}


def _place(raw: DataFrame) -> Column:
    """Where a row stands, for messages: its file and row place, as far as the table has them."""
    return F.concat_ws(" row ", *[F.col(c).cast("string") for c in ("file", "row_ord") if c in raw.columns])


def load(raw: DataFrame, spec: dict[str, tuple[str, str]], version_id: int | None, strict: bool = False) -> DataFrame:
    """Typed rows of a raw table: ``spec`` maps a column to (raw column, type or code kind). Raw columns that are missing give nulls.
    Without a ``version_id`` each row has its own, in that column.

    A whole number that its type cannot hold is an error, times included. Text that does not read as its type is null, or with
    ``strict`` an error as well, which names file and row.
    """
    where = F.concat(F.lit(" at "), _place(raw)) if {"file", "row_ord"} & set(raw.columns) else F.lit("")

    numbers = {c.strip().lower(): F.col(f"`{c}`") for c, t in raw.dtypes if t == "bigint"}

    def value(name: str, c: Column, kind: str) -> Column:
        # A whole number needs no text.
        if kind == "long" and spec[name][0] in numbers:
            return numbers[spec[name][0]]
        own, bad = _cell(c, kind)
        return F.when(bad, F.raise_error(F.concat(F.lit(f"not a {kind}: "), c, where))).otherwise(own) if strict else own

    def checked(name: str, kind: str) -> Column:
        bits = "int" if kind == "time" else kind
        return checked_cast(F.col(name), bits).alias(name) if bits in _RANGES else F.col(name)

    version = F.col("version_id") if version_id is None else F.lit(version_id)
    # A cell is read once and then checked, which names it several times.
    read = raw.select(version.cast("int").alias("version_id"), *[value(name, c, kind).alias(name) for name, (c, kind) in _raw_cells(raw, spec).items()])
    return read.select("version_id", *[checked(name, kind) for name, (_, kind) in spec.items()])


def sorted_out(raw: DataFrame, spec: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """The raw rows that ``load`` takes with ``strict``, and the cells for which it would fail: (file, row_ord, column, kind, value), one row each.

    Cells that are no UTF-8, do not read as their type, or hold a number beyond its range. Rows of uneven width are no fault: what a short
    one lacks is null, and what a long one has besides is left out.
    """
    def fault(name: str, c: Column, kind: str) -> Column:
        own, bad = _cell(c, kind)
        bits = _RANGES.get("int" if kind == "time" else kind)
        if bits:
            bad |= F.coalesce(~own.between(-(1 << bits), (1 << bits) - 1), F.lit(False))
        return F.when(bad, F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), c.alias("value")))

    marked = raw.withColumn("_faults", F.array_compact(F.array(*[fault(n, c, k) for n, (c, k) in _raw_cells(raw, spec).items()])))
    keys = [c for c in ("file", "row_ord") if c in raw.columns]
    return marked.filter(F.size("_faults") == 0).drop("_faults"), marked.select(*keys, F.inline("_faults"))


def stop_times_seq(stop_times: DataFrame, columns: list[str], ties: list[str] = []) -> DataFrame:
    """One row a trip: an array of each of ``columns`` in order of stop_sequence; nulls stay in place."""
    parts = F.array_sort(F.collect_list(F.struct("stop_sequence", *ties, *[c for c in columns if c != "stop_sequence" and c not in ties])))
    packed = stop_times.groupBy("version_id", "trip_item_id").agg(parts.alias("_p"))
    return packed.select("version_id", "trip_item_id", *[F.col(f"_p.{c}").alias(f"{c}s") for c in columns])


def shapes_seq(points: DataFrame) -> DataFrame:
    """One row a shape: number of points, line of the points with coordinates (null if fewer than two), sequences, and distances if ``points`` has them."""
    far = [F.col("shape_dist_traveled").alias("dist")] if "shape_dist_traveled" in points.columns else []
    p = F.array_sort(F.collect_list(F.struct("shape_pt_sequence", F.col("shape_pt_lon").alias("lon"), F.col("shape_pt_lat").alias("lat"), *far)))
    packed = points.groupBy("version_id", "shape_item_id").agg(p.alias("_p"))
    line = F.transform(F.filter("_p", lambda q: q["lon"].isNotNull() & q["lat"].isNotNull()), lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat")))
    more = [F.transform("_p", lambda q: q["dist"]).alias("distances")] if far else []
    return packed.select(
        "version_id", "shape_item_id", F.size("_p").alias("n_points"),
        F.when(F.size(line) >= 2, line).alias("line"),
        F.transform("_p", lambda q: q["shape_pt_sequence"]).alias("sequences"), *more,
    )


def stop_route_refs(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct (version, stop, route). Stop-trip pairs are made distinct before they meet the trips."""
    pairs = stop_times.filter("stop_item_id is not null").select("version_id", "trip_item_id", "stop_item_id").distinct()
    routes = trips.filter("route_item_id is not null").select("version_id", F.col("item_id").alias("trip_item_id"), "route_item_id")
    return pairs.join(routes, ["version_id", "trip_item_id"]).select("version_id", "stop_item_id", "route_item_id").distinct()


def stop_route_agg(stops: DataFrame, refs: DataFrame) -> DataFrame:
    """Per stop the sorted routes of itself and of its direct children; none gives an empty array."""
    child = stops.filter("parent_station_item_id is not null").select("version_id", F.col("item_id").alias("stop_item_id"), F.col("parent_station_item_id").alias("up"))
    up = refs.join(child, ["version_id", "stop_item_id"]).select("version_id", F.col("up").alias("stop_item_id"), "route_item_id")
    routes = refs.unionByName(up).groupBy("version_id", "stop_item_id").agg(F.array_sort(F.collect_set("route_item_id")).alias("route_item_ids"))
    own = stops.select("version_id", F.col("item_id").alias("stop_item_id"))
    return own.join(routes, ["version_id", "stop_item_id"], "left").withColumn("route_item_ids", F.coalesce("route_item_ids", F.array().cast("array<int>")))


def violations(tables: dict[str, DataFrame], keys: dict[str, list[str]], required: dict[str, list[str]], references: list[tuple[str, str, str, str]], allowed: list[tuple[str, str, tuple]] = []) -> DataFrame:
    """(table, rule, n): rows that break a key, a required column, a reference (table, column, target, target column; both with version_id) or a list of values. Rules that hold give no row."""
    found = []
    row = lambda t, rule, n: [F.lit(t).alias("table_name"), F.lit(rule).alias("rule"), n.cast("long").alias("n")]
    for t, key in keys.items():
        found.append(tables[t].groupBy(*key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(*row(t, "unique " + ",".join(key), F.col("n"))))
    for t, columns in required.items():
        found += [tables[t].filter(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("n")).select(*row(t, f"not null {c}", F.col("n"))) for c in columns]
    for t, column, target, key in references:
        own = tables[t].filter(F.col(column).isNotNull())
        there = tables[target].select(F.col("version_id").alias("_v"), F.col(key).alias("_k"))
        lost = own.join(there, (F.col("version_id") == F.col("_v")) & (F.col(column) == F.col("_k")), "left_anti")
        found.append(lost.agg(F.count(F.lit(1)).alias("n")).select(*row(t, f"reference {column}", F.col("n"))))
    for t, column, values in allowed:
        found.append(tables[t].filter(~F.col(column).isin(*values)).agg(F.count(F.lit(1)).alias("n")).select(*row(t, f"values {column}", F.col("n"))))
    return reduce(DataFrame.unionByName, found).filter("n > 0")


#: Raw columns and types of the files of a feed.
SPECS: dict[str, dict[str, tuple[str, str]]] = {
    "agency": {"gtfs_id": ("agency_id", "string"), "agency_name": ("agency_name", "string"), "agency_url": ("agency_url", "string"), "agency_timezone": ("agency_timezone", "string"), "agency_lang": ("agency_lang", "string"), "agency_phone": ("agency_phone", "string")},
    "stops": {"gtfs_id": ("stop_id", "string"), "stop_code": ("stop_code", "string"), "stop_name": ("stop_name", "string"), "stop_desc": ("stop_desc", "string"), "stop_lat": ("stop_lat", "double"), "stop_lon": ("stop_lon", "double"), "zone_id": ("zone_id", "string"), "stop_url": ("stop_url", "string"), "location_type": ("location_type", "location_type"), "parent_gtfs_id": ("parent_station", "string"), "wheelchair_boarding": ("wheelchair_boarding", "availability"), "platform_code": ("platform_code", "string")},
    "routes": {"gtfs_id": ("route_id", "string"), "agency_gtfs_id": ("agency_id", "string"), "route_short_name": ("route_short_name", "string"), "route_long_name": ("route_long_name", "string"), "route_desc": ("route_desc", "string"), "route_type": ("route_type", "route_type"), "route_url": ("route_url", "string"), "route_color": ("route_color", "color"), "route_text_color": ("route_text_color", "color")},
    "trips": {"gtfs_id": ("trip_id", "string"), "route_gtfs_id": ("route_id", "string"), "service_gtfs_id": ("service_id", "string"), "trip_headsign": ("trip_headsign", "string"), "direction_id": ("direction_id", "direction"), "block_id": ("block_id", "string"), "shape_gtfs_id": ("shape_id", "string")},
    "stop_times": {"trip_gtfs_id": ("trip_id", "string"), "arrival_time": ("arrival_time", "time"), "departure_time": ("departure_time", "time"), "stop_gtfs_id": ("stop_id", "string"), "stop_sequence": ("stop_sequence", "short"), "pickup_type": ("pickup_type", "pickup_type"), "drop_off_type": ("drop_off_type", "drop_off_type"), "shape_dist_traveled": ("shape_dist_traveled", "double"), "timepoint": ("timepoint", "timepoint")},
    "shapes": {"shape_gtfs_id": ("shape_id", "string"), "shape_pt_lat": ("shape_pt_lat", "double"), "shape_pt_lon": ("shape_pt_lon", "double"), "shape_pt_sequence": ("shape_pt_sequence", "int"), "shape_dist_traveled": ("shape_dist_traveled", "double")},
    "calendar": {"service_gtfs_id": ("service_id", "string"), **{d: (d, "flag") for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")}, "start_date": ("start_date", "string"), "end_date": ("end_date", "string")},
    "calendar_dates": {"service_gtfs_id": ("service_id", "string"), "date": ("date", "string"), "exception_type": ("exception_type", "exception_type")},
    "feed_info": {"publisher_name": ("feed_publisher_name", "string"), "publisher_url": ("feed_publisher_url", "string"), "lang": ("feed_lang", "string"), "default_lang": ("default_lang", "string"), "start_date": ("feed_start_date", "string"), "end_date": ("feed_end_date", "string"), "version": ("feed_version", "string"), "contact_email": ("feed_contact_email", "string"), "contact_url": ("feed_contact_url", "string")},
}
#: Files in import order with the ids that a row mentions, in order: (kind, raw column).
MENTIONS: list[tuple[str, list[tuple[str, str]]]] = [
    ("agency", [("agency", "gtfs_id")]),
    ("stops", [("stop", "gtfs_id"), ("stop", "parent_gtfs_id")]),
    ("routes", [("route", "gtfs_id"), ("agency", "agency_gtfs_id")]),
    ("trips", [("trip", "gtfs_id"), ("route", "route_gtfs_id"), ("service", "service_gtfs_id"), ("shape", "shape_gtfs_id")]),
    ("stop_times", [("trip", "trip_gtfs_id"), ("stop", "stop_gtfs_id")]),
    ("shapes", [("shape", "shape_gtfs_id")]),
    ("calendar", [("service", "service_gtfs_id")]),
    ("calendar_dates", [("service", "service_gtfs_id")]),
]


def mentions(tables: dict[str, DataFrame], ordinal: str = "row_ord", by: tuple[str, ...] = ()) -> DataFrame:
    """Mentions of all tables (loaded with a row number ``ordinal``) in import order, with the columns ``by``. An agency without an id counts as a nameless row."""
    out = []
    for k, (name, refs) in enumerate(MENTIONS):
        if name not in tables:
            continue
        # A row is read once for all that it mentions.
        each = F.array(*[F.struct(F.lit(j).alias("ref_ord"), F.lit(kind).alias("kind"), optional_reference(column).alias("gtfs_id")) for j, (kind, column) in enumerate(refs)])
        own = tables[name].select(*by, F.lit(k).alias("spec_ord"), F.col(ordinal).cast("long").alias("row_ord"), F.inline(each))
        out.append(own if name == "agency" else own.filter("gtfs_id is not null"))
    return reduce(DataFrame.unionByName, out)


def import_version(raw: dict[str, DataFrame], version_id: int | None, strict: bool = False, keep: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows) -> dict[str, DataFrame]:
    """All tables of a feed version, with item ids, from raw text tables that each have a column ``row_ord``. ``strict``: as of ``load``.

    With ``version_id`` None the tables hold many versions, named by a column ``version_id``; each is numbered by itself, by the same jobs.
    ``keep`` (name, rows) may write each table and give what it wrote, from which the later ones are then derived.
    """
    loaded = {}
    for name, spec in SPECS.items():
        if name in raw:
            loaded[name] = load(raw[name], spec | {"row_ord": ("row_ord", "long")}, version_id, strict)
    # Each reference joins the ids, which are written once, a folder for each kind.
    ids = save(id_map(mentions(loaded, by=() if version_id is not None else ("version_id",))).drop("at"), "kind")
    # One row a kind.
    few = {r["kind"] for r in ids.groupBy("kind").count().collect() if r["count"] <= FEW}
    refs = {name: {f"{column.removesuffix('gtfs_id')}item_id": (kind, column) for kind, column in spec} for name, spec in MENTIONS}
    out = {name: keep(name, translate(df, ids, refs[name], few) if name in refs else df) for name, df in loaded.items()}
    if "stop_times" in out:
        # By the columns that tell trips apart: a constant among them would have the rows moved again.
        times = out["stop_times"].repartition(*([] if version_id is not None else ["version_id"]), "trip_item_id")
        out["stop_times_seq"] = keep("stop_times_seq", stop_times_seq(times, ["stop_item_id", "stop_sequence", "arrival_time", "departure_time", "pickup_type", "drop_off_type", "shape_dist_traveled", "timepoint"], ["row_ord"]))
        out["stop_route_refs"] = keep("stop_route_refs", stop_route_refs(out["stop_times"], out["trips"]))
        out["stop_route_agg"] = keep("stop_route_agg", stop_route_agg(out["stops"].withColumnRenamed("parent_item_id", "parent_station_item_id"), out["stop_route_refs"]))
    if "shapes" in out:
        out["shapes_seq"] = keep("shapes_seq", shapes_seq(out["shapes"]))
        # One item for each shape id, where it first occurs.
        items = out["shapes"].groupBy("version_id", F.col("shape_item_id").alias("item_id")).agg(F.min_by("shape_gtfs_id", "row_ord").alias("gtfs_id"))
        out["shape_items"] = keep("shape_items", items.filter("item_id is not null"))
    return out



