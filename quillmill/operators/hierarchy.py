"""Trees from adjacency lists: forests of any depth, subtree sums, descriptions in batches, a layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: Nodes that are described together, and how often those that failed are tried again (H2).
TOGETHER, TRIES = 4, 10
#: Measures of the drawn map (H3).
COLUMN, LEFT, TOP, ROOT_GAP, CHILD_GAP, LEAST_GAP, LEAST_HEIGHT = 520, 200, 50, 50, 48, 52, 100


def _step(name: Column) -> Column:
    """An id as a part of a path: ~ and / are escaped, so that a path has no other slashes."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def path_ids(path: Column) -> Column:
    """The ids on a path, the root's first."""
    return F.transform(F.split(path, "/"), lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def forest(nodes: DataFrame, paths: bool = True) -> DataFrame:
    """(id, title, parent_id, level, path) of all nodes that a root reaches (H1); ~ and / in an id stand as ~0 and ~1 in paths.

    A null or empty parent makes a root. Nodes with unknown parents, and cycles, are reached by none and go. Of
    repeated ids the last by ``position`` counts. Each round a node looks twice as far up, so a tree of depth d takes the logarithm of d rounds;
    a path is as long as its node is deep, and can be left out."""
    last = Window.partitionBy("id").orderBy(F.desc("position"))
    own = settled(nodes.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("id", "title", F.expr("nullif(parent_id, '')").alias("parent_id")), "nodes")
    start = F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    way = F.struct(F.col("parent_id").alias("up"), start.alias("level"), *([_step(F.col("id")).alias("path")] if paths else []))
    now = own.select("id", way.alias("w"))
    waiting = -1
    while True:
        above = now.select(F.col("id").alias("_id"), F.col("w").alias("_w"))
        joined = now.join(above, F.col("w.up") == F.col("_id"), "left").where("w.up IS NULL OR _id IS NOT NULL")  # an unknown parent ends the search
        further = F.struct(F.col("_w.up").alias("up"), (F.col("w.level") + F.col("_w.level")).alias("level"), *([F.concat_ws("/", "_w.path", "w.path").alias("path")] if paths else []))
        now = settled(joined.select("id", F.when(F.col("w.up").isNull(), F.col("w")).otherwise(further).alias("w")), "ways")
        left = now.where("w.up IS NOT NULL").count()
        if left in (0, waiting):  # the rest goes round in circles
            break
        waiting = left
    found = now.where("w.up IS NULL").select("id", "w.level", *(["w.path"] if paths else []))
    return own.join(found, "id").select("id", "title", "parent_id", "level", *(["path"] if paths else []))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(id, n): the nodes in and below each node of a forest (H3). A round adds what lies up to twice as far below."""
    now = settled(tree.select("id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("n")), "sizes")
    while not now.where("up IS NOT NULL").isEmpty():
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("more"))
        above = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        now = settled(now.join(below, "id", "left").join(above, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "sizes")
    return now.select("id", "n")


def with_descriptions(tree: DataFrame, described: DataFrame) -> DataFrame:
    """The forest with the descriptions (id, description) that came back; the others stay null (H2)."""
    return tree.join(described.select("id", "description"), "id", "left")


def described(tree: DataFrame, describe: Callable[[DataFrame, int], DataFrame], together: int = TOGETHER, tries: int = TRIES) -> DataFrame:
    """(id, description, attempt): what ``describe`` says of the nodes of a forest, in groups of ``together`` that are asked for at once (H2).

    describe takes a table of groups (group, nodes: array of id and title in order) and the number of the attempt, and returns (group, answers: array of id and
    description), or nothing for a group that failed. An answer counts if the id is that of the node at its place. A group that failed
    is sent again, up to ``tries`` times; a node that a returned group says nothing of, or too much, stays without a description."""
    order = Window.partitionBy("_part").orderBy("id")
    numbered = tree.select("id", "title", F.pmod(F.xxhash64("parent_id"), F.lit(1 << 20)).alias("_part")).withColumn("_n", F.row_number().over(order) - 1)
    group = F.xxhash64("_part", F.floor(F.col("_n") / together))
    node = F.struct((F.col("_n") % together).alias("place"), "id", "title")
    open_ = settled(numbered.groupBy(group.alias("group")).agg(F.array_sort(F.collect_list(node)).alias("nodes")), "groups")
    done: DataFrame | None = None
    for attempt in range(1, tries + 1):
        if open_.isEmpty():
            break
        asked = open_.select("group", F.transform("nodes", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"))).alias("nodes"))
        came = settled(describe(asked, attempt).select("group", "answers"), "answers")
        told = open_.join(came, "group").select(F.explode(F.zip_with("nodes", "answers", lambda n, a: F.when(n["id"] == a["id"], F.struct(n["id"].alias("id"), a["description"].alias("description"))))).alias("x"))
        told = told.where("x IS NOT NULL AND x.id IS NOT NULL").select("x.id", "x.description", F.lit(attempt).alias("attempt"))
        done = told if done is None else done.unionByName(told)
        open_ = settled(open_.join(came, "group", "left_anti"), "groups")
    return done if done is not None else tree.select("id", F.lit(None).cast("string").alias("description"), F.lit(0).alias("attempt")).limit(0)


def box_height(description: Column, expanded: Column) -> Column:
    """How high a node is drawn: 72, or with its description open that and 64 and 18 for each line of 80 characters, 328 at most."""
    lines = F.ceil(F.length(description) / 80)
    return F.when(expanded & (F.length(description) > 0), F.least(F.lit(72 + 36 + 28) + lines * 18, F.lit(72 + 36 + 220))).otherwise(72).cast("double")


def layout(tree: DataFrame, by: str = "map", order: str = "id") -> DataFrame:
    """(by, id, level, x, y) of the nodes of maps (by, id, parent_id, level, box), one column of boxes a level (H3).

    Subtrees get room from the leaves up and places from the roots down. Where boxes of a level come too close, a box moves down with all that
    hangs on it: the way a level is pushed is its largest want so far, a running maximum. Parents then move to the middle of their
    children, and levels are pushed once more. Every step is a window or join over one level; a level of one map is sorted by one task."""
    levels = (tree.agg(F.max("level")).first()[0] or 0) + 1
    rows = settled(tree.select(by, "id", "parent_id", "level", F.col(order).alias("o"), F.col("box").cast("double").alias("box")), "boxes")
    of = lambda n: rows.where(F.col("level") == n)
    tall = F.greatest("box", F.lit(float(LEAST_HEIGHT)))

    room: dict[int, DataFrame] = {}
    for n in reversed(range(levels)):
        here = of(n)
        if n + 1 < levels:
            kids = room[n + 1].groupBy(by, F.col("parent_id").alias("id")).agg((F.sum("room") + CHILD_GAP * F.count("*")).alias("kids"))
            here = here.join(kids, [by, "id"], "left")
        else:
            here = here.withColumn("kids", F.lit(None).cast("double"))
        inner = F.greatest("box", F.greatest("kids", F.lit(float(LEAST_HEIGHT))))
        room[n] = settled(here.select(by, "id", "parent_id", "o", "box", F.when(F.col("kids").isNull(), tall).otherwise(inner).alias("room")), "room")

    placed: dict[int, DataFrame] = {}
    for n in range(levels):
        before = Window.partitionBy(by, *(["parent_id"] if n else [])).orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
        if n == 0:
            top = TOP + F.coalesce(F.sum(F.col("room") + ROOT_GAP).over(before), F.lit(0.0))
            here = room[0].withColumn("top", top)
        else:
            above = placed[n - 1].select(by, F.col("id").alias("parent_id"), F.col("top").alias("_top"))
            here = room[n].join(above, [by, "parent_id"]).withColumn("top", F.col("_top") + F.coalesce(F.sum("room").over(before), F.lit(0.0))).drop("_top")
        placed[n] = settled(here.withColumn("y", F.col("top") + F.col("room") / 2), "places")

    def pushed(ys: dict[int, DataFrame]) -> dict[int, DataFrame]:
        out: dict[int, DataFrame] = {}
        down: DataFrame | None = None
        for n in range(levels):
            here = ys[n]
            if down is not None:
                here = here.join(down.withColumnRenamed("id", "parent_id"), [by, "parent_id"], "left").withColumn("y", F.col("y") + F.coalesce("way", F.lit(0.0)))
            else:
                here = here.withColumn("way", F.lit(0.0))
            line = Window.partitionBy(by).orderBy("y", "top", "o", "id")
            here = here.withColumn("_s", F.coalesce(F.sum(tall + LEAST_GAP).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            want = F.max(F.col("y") - tall / 2 - F.col("_s")).over(line.rowsBetween(Window.unboundedPreceding, 0))
            here = here.withColumn("_y", F.col("_s") + want + tall / 2)
            here = settled(here.select(by, "id", "parent_id", "o", "box", "top", F.col("_y").alias("y"), (F.coalesce("way", F.lit(0.0)) + F.col("_y") - F.col("y")).alias("way")), "pushed")
            down = here.select(by, "id", "way")
            out[n] = here.drop("way")
        return out

    ys = pushed({n: p.select(by, "id", "parent_id", "o", "box", "top", "y") for n, p in placed.items()})
    for n in reversed(range(levels - 1)):
        middle = ys[n + 1].groupBy(by, F.col("parent_id").alias("id")).agg(F.avg("y").alias("_m"))
        ys[n] = settled(ys[n].join(middle, [by, "id"], "left").withColumn("y", F.coalesce("_m", "y")).drop("_m"), "centred")
    ys = pushed(ys)
    out: DataFrame | None = None
    for n in range(levels):
        one = ys[n].select(by, "id", F.lit(n).alias("level"), F.lit(float(LEFT + COLUMN * n)).alias("x"), "y")
        out = one if out is None else out.unionByName(one)
    return out
