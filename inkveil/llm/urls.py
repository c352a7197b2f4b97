"""URL verdicts by rules and by a tree of path templates per host.

A path becomes segments. Digit runs and long hexadecimal names in a segment are variable by their shape.
From the root down, each node of a host's tree then decides about its children, one by one and however many
there are: a child that is too rare is a wildcard; the remaining children whose share of good labels does not
differ significantly from their parent's are merged into one branch; the others keep their names. The leaves
are the templates. A template is rejected when its purity, the share of good among its labelled pages smoothed
towards the purity of its host, is too low. A rule that fits decides first.

Segments that all pages of a node share are taken at once, so there is a round for each branching of the tree
and not for each segment. All work is DataFrame operations on counts: pages are summed by host and shaped path before any level is
decided, so neither a hot host nor a hot path is gathered anywhere.

Defined cases: a null url, or one without ``://``, has an empty host and path; a null id is passed through;
repeated rows count and are returned as often as they come; a page without a label counts for the shape of
the tree only; hosts without labels have purity one half and are not rejected; paths are read to their end;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The names of a wildcard and of merged branches.
ANY, MERGED = "*", "~"


@dataclass(frozen=True)
class Settings:
    """``rare``: pages below which a child is not named. ``z``: standard errors within which a branch is like its parent. ``weight``: labelled pages that the
    host's purity counts for. ``purity``: least purity that is not rejected."""

    rare: int = 5
    z: float = 2.0
    weight: float = 10.0
    purity: float = 0.5


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    tail = F.get(F.split(url, "://", 2), F.lit(1))
    host = F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def shaped(path: Column) -> Column:
    """The path's segments with their variable parts as wildcards, joined by ``/``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    hexadecimal = r"(?i)\b(?=[a-z]*[0-9])[0-9a-f]{8,}\b"
    shapes = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, hexadecimal, ANY), r"[0-9]+", ANY))
    return F.array_join(shapes, "/")


def templates(pages: DataFrame, settings: Settings) -> DataFrame:
    """``host``, ``shape``, ``template`` and ``purity`` of each host and shape in ``pages``
    (host, shape, good, bad; the last two 0 or 1, or null without a label)."""
    base = stored(
        pages.groupBy("host", "shape").agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("bad", F.lit(0))).alias("bad"),
        ),
        "url-shapes",
    )
    level = base.withColumn("segments", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/")))
    level = level.withColumn("above", F.lit(""))
    none = F.array().cast("array<string>")
    while not level.where(F.size("segments") > 0).isEmpty():  # rounds over counts
        child = F.get("segments", F.lit(0))
        own = (
            level.where(child.isNotNull())
            .groupBy("host", "above", child.alias("child"))
            .agg(
                F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"),
                F.min("segments").alias("low"), F.max("segments").alias("high"),
            )
        )
        parent = own.groupBy("host", "above").agg(
            F.count("*").alias("children"), F.sum("n").alias("p_n"), F.sum("good").alias("p_good"), F.sum("bad").alias("p_bad"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        # what the first and the last of the paths share, all of them share
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        shared = F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int")
        rate = F.try_divide("p_good", F.col("p_good") + F.col("p_bad"))
        labelled = F.col("good") + F.col("bad")
        alike = F.coalesce(
            F.abs(F.try_divide("good", labelled) - rate) <= settings.z * F.sqrt(F.try_divide(rate * (1 - rate), labelled)), F.lit(True)
        )
        name = F.when(F.col("n") < settings.rare, ANY).when((F.col("children") > 1) & alike, MERGED).otherwise(F.col("child"))
        told = own.drop("low", "high").join(parent, ["host", "above"])
        names = told.select(
            F.col("host").alias("of_host"), F.col("above").alias("of_above"), "child", name.alias("name"), "p_n", shared.alias("shared")
        )
        # below a node of fewer pages than ``rare`` every child is rare: such paths end here
        size = F.size("segments")
        taken = F.when(F.col("p_n") < settings.rare, size).when(F.col("shared") > 0, F.col("shared")).otherwise(1)
        spelt = (
            F.when(F.col("p_n") < settings.rare, F.array_join(F.array_repeat(F.lit(ANY), size), "/"))
            .when(F.col("shared") > 0, F.array_join(F.slice("segments", 1, F.col("shared")), "/"))
            .otherwise(F.col("name"))
        )
        same = (F.col("host") == F.col("of_host")) & (F.col("above") == F.col("of_above")) & (child == F.col("child"))
        level = stored(
            level.join(names, same, "left").select(
                "host", "shape", "n", "good", "bad",
                F.when(F.col("name").isNull(), none).otherwise(F.slice("segments", taken + 1, F.greatest(size - taken, F.lit(0)))).alias("segments"),
                F.when(F.col("name").isNull(), F.col("above")).otherwise(F.concat("above", F.lit("/"), spelt)).alias("above"),
            ),
            "url-level",
        )
    hosts = level.groupBy("host").agg(
        ((F.sum("good") + settings.weight * 0.5) / (F.sum("good") + F.sum("bad") + settings.weight)).alias("host_purity")
    )
    leaves = level.groupBy("host", "above").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).join(hosts, "host")
    smoothed = (F.col("good") + settings.weight * F.col("host_purity")) / (F.col("good") + F.col("bad") + settings.weight)
    leaves = leaves.select("host", "above", smoothed.alias("purity"))
    return level.select("host", "shape", "above").join(leaves, ["host", "above"]).select(
        "host", "shape", F.col("above").alias("template"), "purity"
    )


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules: list[Rule],
    settings: Settings = Settings(),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` of every page.

    ``labelled`` has one row per labelled url: ``url`` and ``bad`` (0 or 1).
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    parts = rows.select("id", "url", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("shape", shaped(F.col("path")))
    marks = labelled.groupBy(F.col("url").alias("of_url")).agg(F.max("bad").alias("bad"))
    known = parts.select("url", "host", "shape").join(marks, F.col("url") == F.col("of_url"), "left")
    found = templates(known.select("host", "shape", (1 - F.col("bad")).alias("good"), "bad"), settings)
    found = found.select(F.col("host").alias("t_host"), F.col("shape").alias("t_shape"), "template", "purity")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("purity") < settings.purity, "block").otherwise("allow")
    return parts.join(found, (F.col("host") == F.col("t_host")) & (F.col("shape") == F.col("t_shape"))).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"),
        "template", "purity",
    )
