"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import materialize
from .common import number_in_groups
from .hashing import unit

FRAME = 1000  # slots after which the schedule of the classes repeats
MOST_EPOCHS = 16  # times that a source's weight may have it read while the longest one is read once
_LEAST = 1e-9  # share of a slot below which sources are not told apart
BLOCK_DOCS = 8
TEMPER = 0.5
STRETCH = 4096  # rows of the mix that stay together when documents are written


def source_classes(sizes: DataFrame, temper: float = TEMPER, frame: int = FRAME, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, n_docs, class, units, frame, place, members): the weight of each source, units / frame / members.

    Target weights are n_docs ** temper, but a source's falls where it would be read more
    than ``most`` times while the source that lasts longest is read once. A source worth a slot of
    the frame has slots of its own; smaller ones share slots with those of the same power of two. Largest
    remainders decide who gets the slots that rounding leaves over, and each has
    one at least. Sources with equal slots are then one class that takes turns: ``place`` is a member's turn, by a keyed hash of its name.

    So there are as many classes as different numbers of slots, at most sqrt(2 x frame), and one per power of two, however
    many sources there are; the largest window is over the entities with slots, at most frame + 31. ``sizes`` (source, n_docs) is read several times: pass a written table.
    """
    n = F.col("n_docs").cast("double")
    largest = sizes.agg(F.max(n)).scalar()
    weight = F.least(F.pow(n, F.lit(temper)), F.lit(most) * n * F.pow(largest, F.lit(temper - 1)))
    weighed = materialize(sizes.select("source", "n_docs", F.round(weight, 9).alias("_w")), "weights")
    share = F.round(F.col("_w") / weighed.agg(F.sum(F.col("_w").cast("decimal(38,9)")).cast("double")).scalar() * frame, 9)
    power = F.floor(F.log2(F.greatest(F.col("_share"), F.lit(_LEAST)))).cast("int")
    shared = weighed.withColumn("_share", share).withColumn("_power", F.when(F.col("_share") < 1, power))
    shared = materialize(shared, "shares")
    alone = shared.filter("_power is null").select(F.lit(1).alias("_kind"), F.col("source").alias("_name"), F.lit(0).alias("_p"), F.col("_share").alias("_e"))
    small = shared.filter("_power is not null").groupBy("_power").agg(F.sum(F.col("_share").cast("decimal(38,9)")).cast("double").alias("_e")).select(
        F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_name"), F.col("_power").alias("_p"), "_e")
    everything = Window.partitionBy(F.lit(1))  # at most frame + 31 rows
    entities = (
        alone.unionByName(small)
        .withColumn("_k", F.count("*").over(everything))
        .withColumn("frame", F.greatest(F.lit(frame), F.col("_k")).cast("int"))
        .withColumn("_ideal", F.round(F.col("_e") / F.sum("_e").over(everything) * (F.col("frame") - F.col("_k")), 6))
        .withColumn("_whole", F.floor("_ideal"))
        .withColumn("_rest", F.round(F.col("_ideal") - F.col("_whole"), 6))
    )
    order = everything.orderBy(F.desc("_rest"), "_kind", F.col("_name").asc_nulls_first(), "_p")
    spare = F.col("frame") - F.col("_k") - F.sum("_whole").over(everything)
    entities = entities.withColumns({"_r": F.row_number().over(order), "_spare": spare}).withColumn(
        "_slots", (F.col("_whole") + 1 + (F.col("_r") <= F.col("_spare")).cast("int")).cast("int"))
    entities = materialize(entities.select("_kind", "_name", "_p", "_slots", "frame"), "entities")
    of_alone = shared.filter("_power is null").join(
        entities.filter("_kind = 1"), F.col("source").eqNullSafe(F.col("_name"))).withColumn("class", F.concat(F.lit("u"), F.col("_slots")))
    of_small = shared.filter("_power is not null").join(entities.filter("_kind = 0"), F.col("_power") == F.col("_p")).withColumn(
        "class", F.concat(F.lit("p"), F.col("_p")))
    named = materialize(of_alone.unionByName(of_small).select("source", "n_docs", "class", "_slots", "frame"), "classes")
    placed = number_in_groups(named, "class", unit("turn", "source"), ["source"], "place")
    single = F.col("class").startswith("u")
    return placed.select(
        "source", "n_docs", "class", F.when(single, F.col("_slots") * F.col("place_n")).otherwise(F.col("_slots")).cast("int").alias("units"),
        "frame", "place", F.col("place_n").alias("members"),
    )


def frame_schedule(classes: DataFrame) -> DataFrame:
    """(class, turn, slot) of every block of one frame, from (class, units, frame).

    Block ``turn`` of a class with weight units / frame may run from
    floor(turn / weight) and must have run before ceil((turn + 1) / weight).
    Slot by slot, the released block with the earliest deadline runs (ties: the
    class's name), which keeps every class within one block of its share. All
    finish their frame together, so the frame repeats. The work is (slots of a frame) x
    (classes), both bounded whatever the number of sources and documents.
    """
    one = classes.groupBy().agg(F.sort_array(F.collect_list(F.struct("class", "units"))).alias("s"))
    one = one.select(
        "s", F.transform("s", lambda x: x["units"]).alias("u"),
        F.aggregate("s", F.lit(0), lambda a, x: a + x["units"]).alias("frame"),
    )
    one = one.withColumn("runs", F.expr("""
        if(size(s) = 0, cast(array() as array<int>), aggregate(
          sequence(0, frame - 1),
          named_struct('given', transform(u, x -> 0), 'run', cast(array() as array<int>)),
          (acc, t) -> transform(array(array_min(transform(
              filter(sequence(0, size(u) - 1), k -> acc.given[k] < u[k]
                     and cast(floor(cast(acc.given[k] as bigint) * frame / u[k]) as int) <= t),
              k -> struct(cast(ceil((cast(acc.given[k] as bigint) + 1) * frame / u[k]) as int) as due, k as k)))),
            best -> named_struct('given', transform(acc.given, (g, k) -> if(k = best.k, g + 1, g)),
                                 'run', concat(acc.run, array(best.k))))[0],
          acc -> acc.run))"""))
    slots = one.select("s", F.posexplode("runs").alias("slot", "k"))
    return slots.select(
        F.col("s")[F.col("k")]["class"].alias("class"),
        (F.row_number().over(Window.partitionBy("k").orderBy("slot")) - 1).cast("bigint").alias("turn"), F.col("slot").cast("bigint").alias("slot"),
    )


def mix_sources(
    docs: DataFrame, source: str = "source", key: str = "doc_id", temper: float = TEMPER,
    frame: int = FRAME, block_docs: int = BLOCK_DOCS, columns: list[str] | None = None, most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """Rows of ``docs`` in mixed order: ``epoch``, ``block``, ``release``, ``deadline``, ``slot``, ``position``.

    Each source is shuffled by a keyed hash and cut into blocks of ``block_docs``
    rows (the last may be shorter). Classes of sources are scheduled by earliest deadline, and the sources of a
    class, which weigh the same, take turns in its blocks. At every slot
    boundary the number of blocks of each source then differs from weight x slots by
    less than one: by 1 - 1/members inside its class at most, and by a members-th part of what the class is off.

    The schedule runs until every source has been read once; a source that its weight asks for more often is read again, its
    rows being repeated with a higher ``epoch``, about ``most_epochs`` times at most. No row is lost. Null sources form one source, rows with equal keys are
    separate rows, an empty table gives an empty result. ``columns`` are carried
    along (all by default); added names replace equal ones.
    """
    added = ["epoch", "block", "release", "deadline", "slot", "position"]
    carried = [c for c in (columns or docs.columns) if c not in added]
    ranked = number_in_groups(docs.select(*carried), source, unit("mix", key), [key], "_at")
    sizes = materialize(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs")), "sizes")
    weighed = materialize(source_classes(sizes, temper, frame, most_epochs), "weighed")
    classes = weighed.select("class", "units", "frame").distinct()
    turns = materialize(frame_schedule(classes), "schedule").select(
        F.col("class").alias("_tc"), F.col("turn").alias("_tt"), F.col("slot").alias("_tl"))  # one row per slot of the frame
    sized = weighed.select(
        F.col("source").alias("_s"), F.col("class").alias("_c"), F.col("units").cast("bigint").alias("_u"), F.col("frame").cast("bigint").alias("_f"),
        F.col("place").alias("_p"), F.col("members").alias("_m"), F.ceil(F.col("n_docs") / block_docs).cast("bigint").alias("_blocks"),
    )
    # slots until the source that takes longest has been read once
    last = sized.withColumn("_n", (F.col("_blocks") - 1) * F.col("_m") + F.col("_p"))
    last = last.join(turns, (F.col("_c") == F.col("_tc")) & (F.pmod("_n", "_u") == F.col("_tt")))
    horizon = last.agg(F.max(F.floor(F.col("_n") / F.col("_u")) * F.col("_f") + F.col("_tl") + 1).alias("_slots"))
    sized = materialize(sized.withColumn("_slots", horizon.scalar()), "sized")
    block = F.floor(F.col("_at") / block_docs).cast("bigint")
    # blocks of this source in whole frames of its class
    asked = F.floor((F.ceil(F.col("_slots") / F.col("_f")) * F.col("_u") - 1 - F.col("_p")) / F.col("_m")) + 1
    rounds = F.floor((asked - 1 - block) / F.col("_blocks")).cast("bigint")
    epochs = ranked.join(sized, F.col(source).eqNullSafe(F.col("_s"))).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(rounds, F.lit(0).cast("bigint"))))
    ).withColumn("_i", F.col("epoch") * F.col("_blocks") + block).withColumn("_n", F.col("_i") * F.col("_m") + F.col("_p")).withColumns({
        "_turn": F.pmod("_n", "_u"), "_base": F.floor(F.col("_n") / F.col("_u")).cast("bigint") * F.col("_f"),
    })
    same = (F.col("_c") == F.col("_tc")) & (F.col("_turn") == F.col("_tt"))
    slot = F.col("_base") + F.col("_tl")
    # a block of a source with weight units / (frame x members) has the window of that weight
    span = F.col("_f") * F.col("_m")
    return epochs.join(turns, same).filter(slot < F.col("_slots")).select(
        *carried, "epoch", F.col("_i").alias("block"), F.floor(F.col("_i") * span / F.col("_u")).cast("bigint").alias("release"),
        F.ceil((F.col("_i") + 1) * span / F.col("_u")).cast("bigint").alias("deadline"), slot.alias("slot"),
        (slot * block_docs + F.col("_at") - block * block_docs).alias("position"),
    )


def mixed_documents(docs: DataFrame, source: str = "source", key: str = "doc_id", temper: float = TEMPER) -> DataFrame:
    """``docs`` in the shares of the target weights, rows repeated where a source is read again.

    Every file that a writer makes of the result holds whole stretches of the
    schedule, in its order.
    """
    mixed = mix_sources(docs, source, key, temper)
    stretch = F.floor(F.col("position") / STRETCH)
    return mixed.withColumn("_stretch", stretch).repartition("_stretch").sortWithinPartitions("_stretch", "position").select(*docs.columns)
