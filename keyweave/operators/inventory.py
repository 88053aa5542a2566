"""Questions to an inventory star schema: who lists what, in which country or region, and how many."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Star:
    """items(item_key, item_name), links(item_key, source_id), sources(source_id, source_name, country_id), countries(country_id, country, region_id), regions(region_id, region)."""

    items: DataFrame
    links: DataFrame
    sources: DataFrame
    countries: DataFrame
    regions: DataFrame

    def places(self, level: str) -> DataFrame:
        """The dimensions up to a level, one row per source."""
        out = self.sources
        if level in ("country", "region"):
            out = out.join(self.countries, "country_id")
        if level == "region":
            out = out.join(self.regions, "region_id")
        return out


LEVELS = {"source": ("source_id", "source_name"), "country": ("country_id", "country"), "region": ("region_id", "region")}


def at_level(level: str, name: str | None = None, id_: int | None = None) -> Column:
    """The filter of a level: by id, or by a part of the name without regard to case."""
    by_id, by_name = LEVELS[level]
    if id_ is not None:
        return F.col(by_id) == id_
    if name is not None:
        return F.contains(F.lower(by_name), F.lit(name.lower()))
    raise ValueError("a name or an id is needed")


def members(star: Star, level: str, name: str | None = None, id_: int | None = None) -> DataFrame:
    """Items listed by the sources of a place, each (item, place, source) once.

    The dimensions are filtered first, so the fact table meets only the sources that count.
    """
    place = star.places(level).where(at_level(level, name, id_))
    shown = [c for lv in ("region", "country", "source") for c in [LEVELS[lv][1]] if c in place.columns]
    links = star.links.select("item_key", "source_id").join(place, "source_id").select("item_key", *shown).distinct()
    return links.join(star.items, "item_key").select("item_key", "item_name", *shown).distinct()


def count_members(star: Star, level: str) -> DataFrame:
    """Per place of a level the number of distinct items its sources list, 0 included."""
    by_id, by_name = LEVELS[level]
    place = star.places(level).select(by_id, by_name, "source_id")
    return place.join(star.links.select("source_id", "item_key").distinct(), "source_id", "left").groupBy(by_id, by_name).agg(F.countDistinct("item_key").alias("n_items"))


def countries_of(star: Star, region: str) -> DataFrame:
    return star.countries.join(star.regions, "region_id").where(at_level("region", region)).select("country_id", "country", "region").distinct()


def sources_of(star: Star, country: str) -> DataFrame:
    return star.sources.join(star.countries, "country_id").where(at_level("country", country)).select("source_id", "source_name", "country").distinct()


def table_stats(tables: dict[str, DataFrame], distinct: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """name, n: row counts of tables, and distinct counts {name: (table, column)}."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    for name, (table, column) in (distinct or {}).items():
        out = out.unionByName(tables[table].agg(F.countDistinct(column).alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


def id_table(keys: DataFrame, links: DataFrame, key: str, sep: str = "; ", **lists: str) -> DataFrame:
    """Left join that keeps keys without links, and for each list column the sorted distinct values joined to one text."""
    grouped = links.groupBy(key).agg(*[F.nullif(F.array_join(F.array_sort(F.collect_set(c)), sep), F.lit("")).alias(n) for n, c in lists.items()])
    return keys.join(grouped, key, "left")


def filtered(table: DataFrame, column: str, present: bool | None = None, value=None) -> DataFrame:
    """Rows whose column equals value, and is present or missing as asked."""
    out = table if present is None else table.where(F.col(column).isNotNull() if present else F.col(column).isNull())
    return out if value is None else out.where(F.col(column) == value)


def best_ranked(rows: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """Per key the value of the lowest rank, ties by value."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(rank, value)).alias(value), F.min(rank).alias(rank))


def children_count(parents: DataFrame, children: DataFrame, key: str, child: str, show: Sequence[str] = ()) -> DataFrame:
    """Per parent the number of children, 0 included; children are counted before the join."""
    counted = children.groupBy(key).agg(F.count(child).alias("n_children"))
    return parents.join(counted, key, "left").select(key, *show, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def nested(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], name: str = "components") -> DataFrame:
    """Parents with an ordered array of structs of their children."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_v")))), lambda x: x["_v"])
    return parents.join(children.groupBy(key).agg(packed.alias(name)), key, "left")


def keys_of(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Per value the sorted distinct keys as an array."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def export_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").csv(path, header=header)


def create_view(rows: DataFrame, name: str) -> None:
    rows.createOrReplaceTempView(name)
