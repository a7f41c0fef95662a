"""Splits of given shares that keep related records together.

Relations become edges between images and, for patients and tasks, between an image and
a node of the patient or task, so that a large family is a star and never all its pairs.
Borůvka's contraction finds the families: every component takes its least edge, the
chosen edges are written to a spanning forest, components are merged by pointer jumping,
and edges inside a component or parallel to a lesser one are dropped. Each round at least
halves the components that still have edges; each round's tables are written to the
shared folder. The forest's roots are stratified by size band and dealt systematically:
within a band, in the order of a hash, the middle of a root's records on the scale of the
band's records decides its split. Bands are dealt from the largest families down, each making
up for what the larger ones missed of the shares.

Defined results: references to images that aren't in ``images`` and to an image itself
relate nothing; placeholders, 0 and empty patient numbers and null sites name no patient;
a record whose image can't be told is a family of its own; repeated rows go together;
empty tables give empty results; null, zero and negative target shares take no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.llm.imageref import digits, image_number, patient_number
from histospark.operators.forest import Forest, spanning_forest
from histospark.runtime import stage

#: Hash ranges of a band whose sums are prefix-summed; bounds the table that is broadcast.
RANGES = 512
#: Splits that may be named; more are an error, since their table is collected.
MAX_SPLITS = 1000
MADE_FROM = r"(?:rescan(?:ned)?|crop|cut-?out|copy|duplicate|made|derived|taken|cropped|copied)(?: was)?(?: taken| made)? (?:of|from)|ausschnitt (?:aus|von)|kopie von|same (?:glass|slide) as"


def _entries(c: str) -> Column:
    return F.explode(F.map_entries(c)).alias("e")


def _node(*parts: Column) -> Column:
    """A node that is no image: a negative number."""
    return -F.shiftrightunsigned(F.xxhash64(*parts), 2) - 1


def task_images(tasks: DataFrame) -> DataFrame:
    """``tasks`` with ``image_id`` filled from ``image_ref`` where it is null."""
    return tasks.withColumn("image_id", F.coalesce("image_id", image_number(F.col("image_ref"))))


def relations(images: DataFrame, masks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Edges ``a, b`` (a < b); images are numbers from 0 up, patients and tasks below 0."""
    known = images.select("image_id").where("image_id >= 0").distinct()
    facts = images.select("image_id", "site", _entries("metadata")).select("image_id", "site", F.lower("e.key").alias("key"), digits(F.col("e.value")).alias("value"))
    patients = facts.where(F.col("key").rlike("^(?:patient|pat[-_ .]?(?:nr|no|id)|subject)") & F.col("site").isNotNull()).withColumn("number", patient_number(F.col("value")))
    patients = patients.where("number is not null").select(_node(F.lit("patient"), F.col("site"), F.col("number")).alias("a"), F.col("image_id").alias("b"))
    named = facts.where(F.col("key").rlike(r"(?:_of|parent|derived|from|origin|source)(?:_?image|_?id)?(?:_[0-9]+)?$")).select(F.array(image_number(F.col("value"))).alias("refs"), "image_id")
    header = facts.where(F.col("value").rlike(r'"(?:origin|parent|derived_from|source)"\s*:')).select(F.array(image_number(F.regexp_extract("value", r'"(?:origin|parent|derived_from|source)"\s*:\s*([^,}]*)', 1))).alias("refs"), "image_id")
    notes = facts.where(F.lower("value").rlike(MADE_FROM)).select(F.transform(F.regexp_extract_all(F.lower("value"), F.lit(rf"(?:{MADE_FROM})[^0-9;]*([0-9]+)"), 1), lambda x: x.try_cast("bigint")).alias("refs"), "image_id")
    registered = masks.select("image_id", _entries("model_info")).where(F.lower("e.key").rlike("regist|align")).select(F.array(image_number(F.col("e.value"))).alias("refs"), "image_id")
    pairs = named.unionByName(header).unionByName(notes).unionByName(registered).select(F.explode("refs").alias("a"), F.col("image_id").alias("b")).where("a >= 0")
    pairs = pairs.join(known, F.col("a") == F.col("image_id"), "left_semi")
    covered = task_images(tasks).where("task_id is not null").select(_node(F.lit("task"), F.col("task_id")).alias("a"), F.col("image_id").alias("b"))
    edges = patients.unionByName(pairs).unionByName(covered).join(known, F.col("b") == F.col("image_id"), "left_semi")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def families(forest: Forest) -> DataFrame:
    """``root_id, image_id`` of every image of a family but its least, which is the root."""
    own = forest.roots.where("node >= 0")
    least = own.groupBy(F.col("root").alias("_root")).agg(F.min("node").alias("root_id"), F.count("*").alias("_n")).where("_n > 1")
    return own.join(least, F.col("root") == F.col("_root")).where("node <> root_id").select("root_id", F.col("node").alias("image_id"))


def _dealt(placed: DataFrame, shares: list[tuple[str, float]]) -> Column:
    """The split of a family by its band and its place in it, the larger bands first.

    What the families of a band miss of the shares, for a family isn't divided, is made up for in
    the next: a band's records are shared out in proportion to what the splits still lack of their
    part of all records."""
    out = F.lit(None).cast("string")
    if not shares:
        return out
    total = sum(s for _, s in shares)
    given = dict.fromkeys((name for name, _ in shares), 0)
    bands = placed.groupBy("_band").agg(F.sum("_n").alias("n")).orderBy(F.desc("_band")).collect()  # at most 63
    records = sum(band.n for band in bands)
    for band in bands:
        lacks = {name: max(0.0, records * share / total - given[name]) for name, share in shares}
        all_ = sum(lacks.values())
        split, reached = F.lit(shares[-1][0]), 1.0
        for (name, _), (after, _) in list(zip(shares, shares[1:]))[::-1]:
            reached -= lacks[after] / all_
            split = F.when(F.col("_middle") < reached, F.lit(name)).otherwise(split)
        for r in placed.where(F.col("_band") == band["_band"]).groupBy(split.alias("split")).agg(F.sum("_n").alias("n")).collect():
            given[r.split] += r.n
        out = F.when(F.col("_band") == band["_band"], split).otherwise(out)
    return out


def split_records(records: DataFrame, family: list[str], targets: DataFrame) -> DataFrame:
    """``records`` with ``split_name``; rows that agree in the columns ``family`` stay together.

    Shares are met as closely as the families' sizes let, by number of rows."""
    shares = [(r.split_name, r.target_share) for r in targets.where("target_share > 0 and split_name is not null").select("split_name", F.col("target_share").cast("double")).orderBy(F.desc("target_share"), "split_name").limit(MAX_SPLITS + 1).collect()]
    if len(shares) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    total = sum(s for _, s in shares)
    keys = [f"_k{i}" for i in range(len(family))]
    groups = records.groupBy(*[F.col(c).alias(k) for c, k in zip(family, keys)]).agg(F.count("*").alias("_n"))
    groups = groups.withColumns({"_band": F.floor(F.log2("_n")).cast("int"), "_hash": F.xxhash64(*keys)}).withColumn("_range", F.pmod(F.shiftrightunsigned("_hash", 40), F.lit(RANGES)).cast("int"))
    groups = stage(groups)
    sums = groups.groupBy("_band", "_range").agg(F.sum("_n").alias("_sum"))
    by_band = Window.partitionBy("_band")
    # at most RANGES rows for each of at most 63 bands
    sums = sums.select(F.col("_band").alias("_b"), F.col("_range").alias("_r"), (F.sum("_sum").over(by_band.orderBy("_range")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(by_band).alias("_all"))
    placed = groups.join(F.broadcast(sums), (F.col("_band") == F.col("_b")) & (F.col("_range") == F.col("_r")))
    within = Window.partitionBy("_band", "_range").orderBy("_hash", *keys)
    middle = (F.col("_before") + F.sum("_n").over(within) - F.col("_n") / 2) / F.col("_all")
    placed = stage(placed.select(*keys, "_band", "_n", middle.alias("_middle")))
    placed = placed.withColumn("split_name", _dealt(placed, shares)).select(*keys, "split_name")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(family, keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return records.join(placed, on, "left").drop(*keys)


def assign(images: DataFrame, masks: DataFrame, tasks: DataFrame, targets: DataFrame, forest: Forest | None = None) -> DataFrame:
    """``record, task_id, image_id, created_at, root_id, split_name`` of every mask and task row."""
    forest = forest or spanning_forest(relations(images, masks, tasks))
    root = families(forest).select("root_id", F.col("image_id").alias("_i"))
    of_task = task_images(tasks)
    rows = masks.select(F.lit("mask").alias("record"), F.lit(None).cast("bigint").alias("task_id"), "image_id", "created_at").unionByName(of_task.select(F.lit("task").alias("record"), "task_id", "image_id", "created_at"))
    # an image without relations is its own family; a row without an image goes by its content
    rows = rows.join(root, F.col("image_id") == F.col("_i"), "left").drop("_i").withColumn("root_id", F.coalesce("root_id", "image_id"))
    rows = rows.withColumn("_lone", F.when(F.col("root_id").isNull(), F.xxhash64("record", "task_id", "created_at")))
    return split_records(rows, ["root_id", "_lone"], targets).select("record", "task_id", "image_id", "created_at", "root_id", "split_name")
