"""Exact links inside of families of near-equal sets, by prefixes of their differences.

The members of a family are compared by what sets them apart from its majority:
the elements that more than half of its members have. With D(x) the difference of x and the
majority, the sets x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| elements, and they reach the
similarity if that is at most (|x| + |y|) (100 - percent) / (100 + percent). With

    gap(x) = (100 + percent) |D(x)| - (100 - percent) |x|

sets with gap(x) + gap(y) <= 0 are always linked; all such links lead to the member of
the least gap. Others need (gap(x) + gap(y)) / (2 (100 + percent)) common elements of their differences, so they share one
of the first elements of these in any fixed order (prefix filter). Rare elements come first, and those no
other member has are not even looked up. Edits of one text rarely agree, so few pairs are left however many
members just miss the similarity. This holds whatever the members of a family are; the majority only makes it fast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from testfloor.session import materialize

def _or_none(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<long>"))


def differences(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` (family, component, doc_id, elements) as differences from their family's majority, and the shared elements.

    The first has ``elements`` replaced by n, added, missing (those that most members lack first) and a ``text`` id of the row;
    the second is (family, e, n_with) of elements outside of the majority that more than one member has.
    """
    members = members.withColumn("text", F.xxhash64("doc_id", "elements")).dropDuplicates(["doc_id", "text"])
    members = materialize(members, "family-sets")
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    counts = members.select("family", F.explode("elements").alias("e")).groupBy("family", "e").agg(F.count("*").alias("n_with"))
    counts = counts.filter("n_with > 1").join(sizes, "family")
    counts = materialize(counts.select("family", "e", "n_with", "size", (2 * F.col("n_with") > F.col("size")).alias("major")), "family-counts")
    ordered = F.sort_array(F.collect_list(F.struct((F.col("size") - F.col("n_with")).alias("lack"), "e")))
    majority = counts.filter("major").groupBy("family").agg(ordered.alias("m")).select("family", F.col("m.e").alias("majority"))
    joined = members.join(majority, "family", "left").withColumn("majority", _or_none("majority"))
    apart = joined.select(
        "family", "component", "doc_id", "text", F.size("elements").cast("long").alias("n"),
        F.array_except("elements", "majority").alias("added"), F.array_except("majority", "elements").alias("missing"),
    )
    return materialize(apart, "differences"), counts.filter("not major").select("family", "e", "n_with")


def _gaps(apart: DataFrame, percent: int) -> DataFrame:
    """The rows with the size d of their difference and their gap."""
    apart = apart.withColumn("d", (F.size("added") + F.size("missing")).cast("long"))
    return apart.withColumn("gap", (100 + percent) * F.col("d") - (100 - percent) * F.col("n"))


def _sides(gapped: DataFrame) -> DataFrame:
    """Per family and component: its least gap, the family's, and whether the two are surely linked or the same."""
    parts = gapped.groupBy("family", "component").agg(F.min(F.struct("gap", "doc_id")).alias("best"))
    parts = materialize(parts, "family-components")
    tops = parts.groupBy("family").agg(F.min(F.struct("best", "component")).alias("top"))
    main = (F.col("component") == F.col("top.component")) | (F.col("best.gap") + F.col("top.best.gap") <= 0)
    return parts.join(tops, "family").withColumn("main", main)


def _needed(gaps: Column, percent: int) -> Column:
    """Common elements that two differences need, for a positive sum of their gaps."""
    return F.ceil(gaps / (2 * (100 + percent)))


def _prefixes(gapped: DataFrame, sides: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(family, e, place, ...) of the elements that a member may share with one of another component."""
    others = sides.filter("not main").groupBy("family").agg(F.min("best.gap").alias("other"))
    sides = sides.join(others, "family").select(
        "family", "component", F.when(F.col("main"), F.col("top.component")).otherwise(F.col("component")).alias("side"),
        F.when(F.col("main"), F.col("other")).otherwise(F.col("top.best.gap")).alias("foreign"),
    )
    probes = gapped.join(sides, ["family", "component"])
    probes = probes.withColumn("reach", F.col("d") - _needed(F.col("gap") + F.col("foreign"), percent) + 1).filter("reach > 0")
    known = probes.select("family", "text", F.explode("added").alias("e")).join(shared, ["family", "e"])
    known = known.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("n_with", "e"))).alias("known"))
    probes = probes.join(known, "text", "left").withColumn("known", _or_none("known.e"))
    probes = probes.withColumn("alone", F.size("added") - F.size("known"))
    length = F.greatest(F.col("reach") - F.col("alone"), F.lit(0)).cast("int")
    looked_up = F.slice(F.concat("known", "missing"), F.lit(1), length)
    return probes.select("family", "doc_id", "text", "side", "n", "d", "gap", "alone", F.posexplode(looked_up).alias("at", "e")).withColumn(
        "place", F.col("alone") + F.col("at") + 1
    )


def candidates(gapped: DataFrame, sides: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(x, y, needed): pairs of texts of different components that may be linked, with the common elements they need."""
    prefixes = materialize(_prefixes(gapped, sides, shared, percent), "family-prefixes")
    columns = ["text", "doc_id", "side", "n", "d", "gap", "place"]
    x = prefixes.select("family", "e", *(F.col(c).alias(f"x_{c}") for c in columns))
    y = prefixes.select("family", "e", *(F.col(c).alias(f"y_{c}") for c in columns))
    needed = _needed(F.col("x_gap") + F.col("y_gap"), percent)
    fits = (
        (F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_side") != F.col("y_side"))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
        & (F.col("x_place") <= F.col("x_d") - needed + 1) & (F.col("y_place") <= F.col("y_d") - needed + 1)
    )
    met = x.join(y, ["family", "e"]).filter(fits)
    return met.select(F.col("x_text").alias("x"), F.col("y_text").alias("y"), needed.alias("needed")).distinct()


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all components whose members reach the similarity, in each family.

    ``members`` are (family, component, doc_id, elements), elements an array of distinct longs that is not empty, and
    members of one component known to be linked. A doc_id with several texts is a member with each of them.
    """
    apart, shared = differences(members)
    gapped = _gaps(apart, percent)
    sides = _sides(gapped)
    sure = sides.filter("main and component <> top.component").select(F.col("best.doc_id").alias("a"), F.col("top.best.doc_id").alias("b"))
    pairs = materialize(candidates(gapped, sides, shared, percent), "family-pairs")
    x = apart.select(F.col("text").alias("x"), F.col("doc_id").alias("a"), F.col("added").alias("xa"), F.col("missing").alias("xm"))
    y = apart.select(F.col("text").alias("y"), F.col("doc_id").alias("b"), F.col("added").alias("ya"), F.col("missing").alias("ym"))
    common = F.size(F.array_intersect("xa", "ya")) + F.size(F.array_intersect("xm", "ym"))
    linked = pairs.join(x, "x").join(y, "y").filter(common >= F.col("needed")).select("a", "b")
    return materialize(sure.union(linked), "family-links")
