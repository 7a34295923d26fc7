"""Negatives, corrupted paths and graph views, drawn by keyed hashing.

Pools are numbered once; a draw is an equi-join on (group, hash mod size). Where
the forbidden values depend on the pool's group alone they are taken out of the
pool first and a single draw is exact. Elsewhere a few draws are tried and what
is left gets the k-th allowed value of the pool, k being drawn by the request's
hash and the value found by counting, so that every draw is uniform.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keyed import HASH_DIGITS, key_hash, key_unit
from ..functions.numeric import zeros
from ..lineage import materialize
from ..schema import DUMMY_PATHWAY, QUAD
from .graph import disease_gene, drug_gene, gene_pathways
from .numbering import ROWS_PER_TASK, number_within, place, prefix_sums
from .splits import sample_k

PAIR = ("drug", "disease")


def _numbered(pool: DataFrame, groups: Sequence[str], seed: int, rows_per_task: int) -> DataFrame:
    values = [c for c in pool.columns if c not in groups]
    hashed = pool.withColumn("_h", key_hash(seed, *values))
    return number_within(hashed, groups, "_h", values, "idx", rows_per_task).drop("_h")


def numbered_pool(pool: DataFrame, groups: Sequence[str], seed: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pool rows with ``idx`` and ``idx_n`` per group, in hash order, written once."""
    return materialize(_numbered(pool, groups, seed, rows_per_task), "pool")


def draw_from_pool(
    requests: DataFrame,
    pool: DataFrame,
    groups: Sequence[str],
    seed: int,
    salt: str,
    request_keys: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One uniform pool row per request; requests of an empty group are dropped.

    ``pool`` should be cheap to read: it is counted and numbered.
    """
    groups = list(groups)
    if groups:
        sized = requests.join(pool.groupBy(*groups).agg(F.count("*").alias("_n")), groups)
    else:
        sized = requests.withColumn("_n", F.lit(pool.count())).filter("_n > 0")
    picked = sized.withColumn("idx", F.pmod(key_hash(salt, *request_keys), F.col("_n"))).drop("_n")
    numbered = _numbered(pool, groups, seed, rows_per_task).drop("idx_n")
    return picked.join(numbered, [*groups, "idx"]).drop("idx")


# Pool rows in one slice of the hash range, and buckets of a slice. The slices' bit map is broadcast, so they are at most 2 ** MOST_BITS.
ROWS_PER_SLICE = 1 << 14
BUCKET_BITS = 11
MOST_BITS = 16


def draw_by_rank(
    requests: DataFrame,
    pool: DataFrame,
    seed: int,
    salt: str,
    request_keys: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """The rows ``draw_from_pool`` draws from a distinct pool without groups; only rows near a drawn number are moved.

    The hash range is cut into slices of buckets. A slice lists the buckets of its pool rows, two bytes a row, which says
    in which bucket, and at what place in it, the row of a number lies. A bit map of the buckets
    asked for, at most 2 ** (``most_bits`` + ``BUCKET_BITS``) bits, then picks the pool rows that go to the requests. ``pool`` is read
    three times: pass a written table.
    """
    values, n = pool.columns, pool.count()
    if n == 0:
        return requests.crossJoin(pool)
    bits = min(most_bits, max(0, (n // rows_per_slice).bit_length()))
    buckets = 1 << BUCKET_BITS
    # a hash is never null; said so, it is not computed again to find out
    at = F.coalesce(F.shiftright(key_hash(seed, *values), 4 * HASH_DIGITS - bits - BUCKET_BITS), F.lit(0))
    in_slice, in_bucket = F.shiftright("_at", BUCKET_BITS).cast("int"), F.col("_at").bitwiseAND(buckets - 1).cast("smallint")
    hashed = pool.withColumn("_at", at).withColumns({"_slice": in_slice, "_bucket": in_bucket})
    lists = hashed.groupBy("_slice").agg(F.sort_array(F.collect_list("_bucket")).alias("_buckets"))
    lists = materialize(lists.withColumn("_n", F.size("_buckets").cast("bigint")), "slices")

    # one row per slice; a step of numbers is met by the slices that reach into it
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = lists.select("_slice", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    width = -(-n >> bits)
    first, last = F.floor(F.col("_start") / width), F.floor((F.col("_start") + F.col("_n") - 1) / width)
    ladder = starts.withColumn("_step", F.explode(F.sequence(first, last)))
    picked = requests.withColumn("_pick", F.pmod(key_hash(salt, *request_keys), F.lit(n)))
    placed = (
        picked.withColumn("_step", F.floor(F.col("_pick") / width)).join(F.broadcast(ladder), "_step")
        .filter((F.col("_pick") >= F.col("_start")) & (F.col("_pick") < F.col("_start") + F.col("_n")))
        .select(*requests.columns, "_slice", (F.col("_pick") - F.col("_start")).cast("int").alias("_rank"))
    )
    bucket = F.get("_buckets", F.col("_rank"))
    found = placed.join(lists.select("_slice", "_buckets"), "_slice").select(
        *requests.columns, "_slice", bucket.alias("_bucket"), (F.col("_rank") - place(F.col("_buckets"), bucket - 1)).alias("_k")
    )
    found = materialize(found, "found")

    word = F.shiftright("_bucket", 6).alias("_word")
    marks = found.groupBy("_slice", word).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bucket & 63 as int))")).alias("_bits"))
    marks = marks.groupBy("_slice").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_marks"))
    every = F.sequence(F.lit(0), F.lit((buckets >> 6) - 1))
    marks = marks.select(
        "_slice", F.transform(every, lambda w: F.coalesce(F.try_element_at("_marks", w), F.lit(0).cast("bigint"))).alias("_words")
    )
    asked = F.expr("shiftright(_words[cast(_bucket >> 6 as int)], cast(_bucket & 63 as int)) & 1L = 1L")
    near = hashed.join(F.broadcast(marks), "_slice").filter(asked).select("_at", *values).repartition("_at")
    row = F.struct(key_hash(seed, *values).alias("_h"), *values)
    rows = near.groupBy("_at").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    wanted = found.withColumn("_at", F.col("_slice").cast("bigint") * buckets + F.col("_bucket"))
    drawn = wanted.join(rows, "_at").withColumn("_row", F.get("_rows", F.col("_k")))
    return drawn.select(*requests.columns, *[F.col(f"_row.{c}").alias(c) for c in values])


def draw_excluding(
    requests: DataFrame,
    request_keys: Sequence[str],
    context: Sequence[str],
    pool: DataFrame,
    pool_groups: Sequence[str],
    excluded: DataFrame | Callable[[DataFrame], DataFrame],
    value: str,
    seed: int | str,
    draws: int = 8,
    reject: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One pool value per request that is not excluded in the request's context.

    ``pool`` is numbered per ``pool_groups`` (columns of the context);
    ``excluded`` holds (context, value) rows. Requests whose context excludes
    the whole pool are absent from the result. ``reject`` may drop excluded
    draws by another route; ``excluded`` is then only asked if draws run out, and may be a
    function that makes the rows of given contexts.
    """
    request_keys, context, groups = list(request_keys), list(context), list(pool_groups)
    asked = materialize(requests.select(*dict.fromkeys([*request_keys, *context])), "requests")
    sizes = pool.filter("idx = 0").select(*groups, "idx_n")
    sized = asked.join(sizes, groups) if groups else asked.withColumn("idx_n", sizes.select("idx_n").scalar())
    tries = sized.filter("idx_n is not null").withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    tries = tries.withColumn("idx", F.pmod(key_hash(seed, *request_keys, "_try"), F.col("idx_n"))).drop("idx_n")
    drawn = tries.join(pool.drop("idx_n"), [*groups, "idx"]).drop("idx")
    if reject is not None:
        allowed = reject(drawn)
    else:
        allowed = drawn.join(excluded.select(*context, value), [*context, value], "left_anti")
    hits = materialize(allowed.groupBy(*request_keys).agg(F.min_by(value, "_try").alias(value)), "draws")

    left = materialize(asked.join(hits, request_keys, "left_anti"), "left")
    if left.isEmpty():
        return hits
    taken = excluded(left.select(*context).distinct()) if callable(excluded) else excluded
    rest = kth_free(left.withColumn("_k", key_hash(f"{seed}:rest", *request_keys)), request_keys, context, pool, groups, taken, value)
    return hits.unionByName(rest)


# Pool numbers in one step of the ladder, and requests of one context that one task places.
STEP = 1 << 16
REQUESTS_PER_TASK = 1 << 20


def _before(rows: DataFrame, keys: Sequence[str], at: str, carried: Sequence[str], requests: DataFrame) -> DataFrame:
    """Requests with the last of ``rows``, by ``at`` and the first carried column, whose ``at`` does not pass their own.

    It is a struct ``_row``, null where there is none.
    """
    marks = rows.select(*keys, at, F.struct(*carried).alias("_row"), F.lit(0).alias("_own"), F.col(carried[0]).alias("_tie"))
    both = requests.withColumn("_own", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "_own", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_row", ignorenulls=True).over(order)
    return both.withColumn("_row", last).filter("_own = 1").drop("_own", "_tie")


def kth_free(
    requests: DataFrame,
    request_keys: Sequence[str],
    context: Sequence[str],
    pool: DataFrame,
    pool_groups: Sequence[str],
    excluded: DataFrame,
    value: str,
    step: int = STEP,
    per_task: int = REQUESTS_PER_TASK,
) -> DataFrame:
    """(request_keys, value): the allowed pool value number ``_k`` mod (allowed values) of each request.

    Found on a ladder of two levels. Pool numbers are cut into steps; a step's excluded numbers are counted,
    and sums of these counts say how many numbers are free before it, which places a request in a step or
    in the free stretch behind one. Inside the step an excluded number has as many free ones below it as its own place
    less its rank. So no task holds more of a context than its step counts, one step of excluded numbers, and
    about ``per_task`` of its requests. Requests whose context excludes the whole pool are absent.
    """
    request_keys, context, groups = list(request_keys), list(context), list(pool_groups)
    asked = requests.select(*dict.fromkeys([*request_keys, *context]), "_k")
    crowds = materialize(
        asked.groupBy(*context).agg(F.ceil(F.count("*") / per_task).alias("_parts")).filter("_parts > 1"), "crowds"
    )
    part = F.pmod(F.xxhash64(*request_keys), F.coalesce("_parts", F.lit(1).cast("bigint")))
    asked = materialize(asked.join(crowds, context, "left").withColumn("_part", part).drop("_parts"), "asked")
    wanted = asked.select(*context).distinct()
    taken = (
        excluded.select(*context, value)
        .join(wanted, context, "left_semi")
        .join(pool.select(*groups, value, "idx"), [*groups, value])
        .select(*context, "idx")
        .distinct()
        .withColumn("_step", F.floor(F.col("idx") / step))
    )
    taken = materialize(taken, "taken")
    counts = taken.groupBy(*context, "_step").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*context).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.withColumn("_taken", F.coalesce(F.sum("_n").over(below), F.lit(0)).cast("bigint"))
    steps = materialize(steps.withColumn("_at", F.col("_step") * step - F.col("_taken")), "steps")

    sizes = pool.filter("idx = 0").select(*groups, "idx_n")
    sized = asked.join(sizes, groups) if groups else asked.withColumn("idx_n", sizes.select("idx_n").scalar())
    totals = counts.groupBy(*context).agg(F.sum("_n").alias("_all"))
    free = F.col("idx_n") - F.coalesce("_all", F.lit(0))
    placed = sized.join(totals, context, "left").filter(free > 0).withColumn("_at", F.pmod("_k", free).cast("bigint")).drop("_k", "_all")
    spread = steps.join(asked.select(*context, "_part").distinct(), context)
    found = _before(spread, [*context, "_part"], "_at", ["_step", "_taken", "_n", F.col("_at").alias("start")], placed)
    # numbers of the step itself; the last step may be cut off by the end of the pool
    inner = F.least(F.lit(step), F.col("idx_n") - F.col("_row._step") * step) - F.col("_row._n")
    inside = F.coalesce(F.col("_at") - F.col("_row.start") < inner, F.lit(False))
    found = materialize(found.withColumn("_in", inside), "found")

    passed = F.coalesce(F.col("_row._taken") + F.col("_row._n"), F.lit(0))
    behind = found.filter(~F.col("_in")).withColumn("idx", (F.col("_at") + passed).cast("bigint"))
    within = found.filter("_in").select(
        *dict.fromkeys([*request_keys, *context]), "_part", F.col("_row._step").alias("_step"), (F.col("_at") - F.col("_row.start")).alias("_at")
    )
    rank = F.row_number().over(Window.partitionBy(*context, "_step").orderBy("idx")) - 1
    marks = taken.withColumn("_at", (F.col("idx") - F.col("_step") * step - rank).cast("bigint")).withColumn("_rank", rank + 1)
    marks = marks.join(within.select(*context, "_step", "_part").distinct(), [*context, "_step"])
    hit = _before(marks, [*context, "_step", "_part"], "_at", ["_rank"], within)
    hit = hit.withColumn("idx", (F.col("_step") * step + F.col("_at") + F.coalesce("_row._rank", F.lit(0))).cast("bigint"))
    both = [df.select(*dict.fromkeys([*request_keys, *groups]), "idx") for df in (behind, hit)]
    return both[0].unionByName(both[1]).join(pool.drop("idx_n"), [*groups, "idx"]).select(*request_keys, value)


def unresolved(requests: DataFrame, drawn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests without a draw; must be empty where every request needs one."""
    return requests.select(*keys).distinct().join(drawn, list(keys), "left_anti")


def _checked(requests: DataFrame, drawn: DataFrame, keys: Sequence[str], what: str, on_missing: str) -> DataFrame:
    if on_missing == "drop":
        return drawn
    if on_missing != "raise":
        raise ValueError(f"on_missing must be raise or drop: {on_missing}")
    drawn = materialize(drawn, "drawn")
    left = unresolved(requests, drawn, keys).limit(5).collect()
    if left:
        raise ValueError(f"no {what} can be drawn for {[tuple(r) for r in left]}")
    return drawn


def negative_genes(paths: DataFrame, genes: DataFrame, seed: int, draws: int = 8, on_missing: str = "raise") -> DataFrame:
    """(drug, gene, disease, neg_gene): another gene that is no positive one of the pair.

    A pair that has every gene as a positive is an error, unless ``on_missing``
    is 'drop': its paths are then left out, and ``unresolved`` lists them.
    """
    pool = numbered_pool(genes.select(F.col("gene").alias("neg_gene")), [], seed)
    known = paths.select("drug", "disease", F.col("gene").alias("neg_gene")).distinct()
    drawn = draw_excluding(
        paths.distinct(), ["drug", "gene", "disease"], list(PAIR), pool, [], known, "neg_gene", f"{seed}:gene", draws
    )
    return _checked(paths, drawn, ["drug", "gene", "disease"], "negative gene", on_missing)


# Ids of drugs that one list of a disease's drugs may hold.
DRUGS_PER_LIST = 1 << 18


def _not_known(connected: DataFrame, known: DataFrame, per_list: int = DRUGS_PER_LIST) -> DataFrame:
    """Distinct connected pairs that are not known, told apart in lists of a disease's drugs.

    Lists are shuffled and not pairs; one holds drugs of ``per_list`` successive ids.
    """
    def lists(pairs: DataFrame, name: str) -> DataFrame:
        part = F.floor(F.col("drug") / per_list).alias("_part")
        return pairs.groupBy("disease", part).agg(F.collect_set("drug").alias(name))

    both = lists(connected, "_drugs").join(lists(known, "_known"), ["disease", "_part"], "left")
    none = F.array().cast("array<bigint>")
    return both.select(F.explode(F.array_except("_drugs", F.coalesce("_known", none))).alias("drug"), "disease")


def _linked_negatives(positives: DataFrame, valid: DataFrame, strategy: str, seed: int) -> DataFrame:
    """(pair, neg_drug, neg_disease) drawn from connected, not known pairs."""
    fixed = {"cross_drug": ["disease"], "cross_disease": ["drug"], "random": []}[strategy]
    free = [c for c in PAIR if c not in fixed]
    pool = valid.select(*fixed, *[F.col(c).alias(f"neg_{c}") for c in free])
    if not fixed and pool.count() > max(ROWS_PER_TASK, positives.count()):
        drawn = draw_by_rank(positives.select(*PAIR), pool, seed, f"{seed}:{strategy}", PAIR)
    else:
        drawn = draw_from_pool(positives.select(*PAIR), pool, fixed, seed, f"{seed}:{strategy}", PAIR)
    return drawn.withColumns({f"neg_{c}": F.col(c) for c in fixed}).select(*PAIR, "neg_drug", "neg_disease")


def _pool_negatives(
    positives: DataFrame, strategy: str, drugs: DataFrame, diseases: DataFrame, known: DataFrame, seed: int, draws: int
) -> DataFrame:
    """(pair, neg_drug, neg_disease) drawn from id pools whatever the topology."""
    if strategy == "random":
        return _random_pool_pairs(positives, drugs, diseases, known, seed, draws)
    fixed, free = ("disease", "drug") if strategy == "cross_drug" else ("drug", "disease")
    ids = (drugs if free == "drug" else diseases).select(F.col(free).alias(f"neg_{free}"))
    pool = numbered_pool(ids, [], seed)
    excluded = known.select(fixed, F.col(free).alias(f"neg_{free}"))
    drawn = draw_excluding(
        positives.select(*PAIR), PAIR, [fixed], pool, [], excluded, f"neg_{free}", f"{seed}:pool:{strategy}", draws
    )
    return drawn.withColumn(f"neg_{fixed}", F.col(fixed)).select(*PAIR, "neg_drug", "neg_disease")


def _random_pool_pairs(
    positives: DataFrame, drugs: DataFrame, diseases: DataFrame, known: DataFrame, seed: int, draws: int
) -> DataFrame:
    drug_ids = materialize(drugs.select(F.col("drug").alias("neg_drug")), "pool")
    disease_ids = materialize(diseases.select(F.col("disease").alias("neg_disease")), "pool")
    neg_known = known.select(F.col("drug").alias("neg_drug"), F.col("disease").alias("neg_disease")).distinct()
    asked = materialize(positives.select(*PAIR), "requests")
    tries = asked.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    keys = [*PAIR, "_try"]
    with_drug = draw_from_pool(tries, drug_ids, [], seed, f"{seed}:pool:drug", keys)
    drawn = draw_from_pool(with_drug, disease_ids, [], seed, f"{seed}:pool:disease", keys)
    allowed = drawn.join(neg_known, ["neg_drug", "neg_disease"], "left_anti")
    pick = F.min_by(F.struct("neg_drug", "neg_disease"), "_try").alias("_p")
    hits = materialize(
        allowed.groupBy(*PAIR).agg(pick).select(*PAIR, "_p.neg_drug", "_p.neg_disease"), "draws"
    )
    left = asked.join(hits, list(PAIR), "left_anti")
    if left.isEmpty():
        return hits
    # a drug has as many free pairs as diseases not known for it; number k of all picks drug and disease
    drug_pool = numbered_pool(drug_ids, [], seed)
    disease_pool = numbered_pool(disease_ids, [], seed)
    n_diseases = disease_pool.filter("idx = 0").select("idx_n").scalar()
    in_pool = neg_known.join(disease_pool, "neg_disease", "left_semi")
    taken = in_pool.groupBy("neg_drug").agg(F.count("*").alias("_n"))
    free = drug_pool.join(taken, "neg_drug", "left").select(
        "neg_drug", F.col("idx").cast("double").alias("idx"), (n_diseases - F.coalesce("_n", F.lit(0))).cast("bigint").alias("free")
    )
    free = materialize(free.filter("free > 0"), "free")
    size = free.agg(F.sum("free").alias("total"), F.count("*").alias("n")).first()
    if not size["n"]:
        return hits
    width = -(-size["total"] // size["n"])
    ladder = prefix_sums(free, "idx", ["free"]).withColumn("_last", F.col("free_before") + F.col("free") - 1)
    ladder = ladder.withColumn("_step", F.explode(F.sequence(F.floor(F.col("free_before") / width), F.floor(F.col("_last") / width))))
    chosen = left.withColumn("_pick", F.pmod(key_hash(f"{seed}:pool:rest", *PAIR), F.lit(size["total"]))).withColumn(
        "_step", F.floor(F.col("_pick") / width)
    )
    with_drug = chosen.join(ladder, "_step").filter("_pick between free_before and _last").select(
        *PAIR, "neg_drug", (F.col("_pick") - F.col("free_before")).alias("_k")
    )
    rest = kth_free(with_drug, [*PAIR, "neg_drug"], ["neg_drug"], disease_pool, [], neg_known, "neg_disease")
    return hits.unionByName(rest.select(*PAIR, "neg_drug", "neg_disease"))


# --- fixed values: strategies tried in turn ---
STRATEGY_ORDER = {
    "random": ("random",),
    "cross_drug": ("cross_drug", "random"),
    "cross_disease": ("cross_disease", "random"),
    "mixed": ("cross_drug", "cross_disease", "random"),
}
# --- end of fixed values ---


def negative_pairs(
    positives: DataFrame,
    connected: DataFrame,
    known: DataFrame,
    drugs: DataFrame,
    diseases: DataFrame,
    strategy: str | Sequence[str],
    seed: int,
    drug_pool: DataFrame | None = None,
    disease_pool: DataFrame | None = None,
    draws: int = 8,
    on_missing: str = "raise",
) -> DataFrame:
    """(drug, disease, neg_drug, neg_disease, used): one negative per positive pair.

    Connected pairs that are not known come first; strategies fall back in
    ``STRATEGY_ORDER``, ``mixed`` starting with a hash-chosen one. A restricted
    pool filters the connected candidates of its side, then serves on its own;
    with any restriction ``random`` ignores the topology. A positive for which
    nothing is allowed is an error, or left out if ``on_missing`` is 'drop'. Several strategies share their draws
    and give one row each, named in a column ``strategy``.
    """
    asked = [strategy] if isinstance(strategy, str) else list(strategy)
    unknown = [s for s in asked if s not in STRATEGY_ORDER]
    if unknown:
        raise ValueError(f"unknown negative strategies: {unknown}")
    pairs = materialize(positives.select(*PAIR).distinct(), "positives")
    known = known.select(*PAIR).unionByName(pairs).distinct()
    restricted = drug_pool is not None or disease_pool is not None
    all_drugs = drug_pool if drug_pool is not None else drugs
    all_diseases = disease_pool if disease_pool is not None else diseases
    names = dict.fromkeys(n for s in asked for n in STRATEGY_ORDER[s])
    if not restricted or set(names) != {"random"}:
        valid = materialize(_not_known(connected.select(*PAIR), known), "valid")

    wide = pairs
    for name in names:
        side = {"cross_drug": drug_pool, "cross_disease": disease_pool}.get(name)
        if name == "random" and not restricted and not valid.isEmpty():
            # any pair can take any connected candidate, so none is left over
            picks = _linked_negatives(pairs, valid, name, seed)
        elif name == "random":
            picks = _pool_negatives(pairs, name, all_drugs, all_diseases, known, seed, draws)
        elif side is None:
            picks = _linked_negatives(pairs, valid, name, seed)
        else:
            allowed = materialize(valid.join(side, side.columns, "left_semi"), "allowed")
            picks = materialize(_linked_negatives(pairs, allowed, name, seed), "linked")
            left = pairs.join(picks, list(PAIR), "left_anti")
            if not left.isEmpty():
                picks = picks.unionByName(_pool_negatives(left, name, all_drugs, all_diseases, known, seed, draws))
        packed = picks.select(*PAIR, F.struct("neg_drug", "neg_disease", F.lit(name).alias("used")).alias(f"_{name}"))
        wide = wide.join(packed, list(PAIR), "left")

    def chosen(name: str) -> Column:
        order = STRATEGY_ORDER[name]
        in_turn = F.coalesce(*[F.col(f"_{n}") for n in order])
        if name != "mixed":
            return in_turn
        first = F.pmod(key_hash(f"{seed}:mixed", *PAIR), F.lit(len(order)))
        return F.coalesce(*[F.when(first == i, F.col(f"_{n}")) for i, n in enumerate(order)], in_turn)

    cells = [F.struct(F.lit(s).alias("strategy"), chosen(s).alias("_c")) for s in asked]
    out = wide.select(*PAIR, F.inline(F.array(*cells))).filter("_c is not null").select(
        "strategy", *PAIR, "_c.neg_drug", "_c.neg_disease", "_c.used"
    )
    wanted = pairs.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in asked])))
    out = _checked(wanted, out, ["strategy", *PAIR], "negative pair", on_missing)
    return out.drop("strategy") if isinstance(strategy, str) else out


def validate_pool(pool: DataFrame, ids: DataFrame) -> None:
    """A pool must not be empty nor hold ids outside the node type."""
    column = pool.columns[0]
    if pool.isEmpty():
        raise ValueError(f"the negative {column} pool is empty")
    unknown = pool.join(ids, column, "left_anti").limit(10).collect()
    if unknown:
        raise ValueError(f"unknown ids in the negative {column} pool: {[r[0] for r in unknown]}")


# --- fixed values: order of the candidates in a benchmark group ---
CANDIDATES = ("positive", "drug", "gene", "pathway", "disease")
# --- end of fixed values ---


def drop_real_quads(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that are no mechanism of the graph, found by looking up their
    edges; the graph's mechanisms are not enumerated."""
    pathways = gene_pathways(edges)
    linked = (
        candidates.join(drug_gene(edges).withColumn("_dg", F.lit(1)), ["drug", "gene"], "left")
        .join(disease_gene(edges).withColumn("_sg", F.lit(1)), ["disease", "gene"], "left")
        .join(pathways.withColumn("_gp", F.lit(1)), ["gene", "pathway"], "left")
        .join(pathways.select("gene").distinct().withColumn("_any", F.lit(1)), "gene", "left")
    )
    member = F.col("_gp").isNotNull() | ((F.col("pathway") == DUMMY_PATHWAY) & F.col("_any").isNull())
    real = F.col("_dg").isNotNull() & F.col("_sg").isNotNull() & member
    return linked.filter(~real).select(*candidates.columns)


def _real_values(contexts: DataFrame, edges: DataFrame) -> DataFrame:
    """(context, value): ids that complete a context (position, at_*) to a mechanism of ``edges``.

    A context is first held against the edges among its own ids; what is left
    reads the list of one id that the missing one must be linked to: drugs or diseases of the gene, pathways
    of the gene, and for a missing gene those of the drug that the disease and the pathway share.
    """
    targets = drug_gene(edges).select(F.col("drug").alias("_drug"), F.col("gene").alias("_gene"))
    linked = disease_gene(edges).select(F.col("disease").alias("_disease"), F.col("gene").alias("_gene"))
    pathways = gene_pathways(edges).select(F.col("gene").alias("_gene"), F.col("pathway").alias("_pathway"))
    with_pathway = pathways.select("_gene").distinct()
    at = {c: F.col(f"at_{c}") for c in QUAD}

    def has_target(df: DataFrame, gene: Column) -> DataFrame:
        return df.join(targets, (at["drug"] == F.col("_drug")) & (gene == F.col("_gene")), "left_semi")

    def has_disease(df: DataFrame, gene: Column) -> DataFrame:
        return df.join(linked, (at["disease"] == F.col("_disease")) & (gene == F.col("_gene")), "left_semi")

    def has_pathway(df: DataFrame, gene: Column) -> DataFrame:
        plain, dummy = df.filter(at["pathway"] != DUMMY_PATHWAY), df.filter(at["pathway"] == DUMMY_PATHWAY)
        member = plain.join(pathways, (gene == F.col("_gene")) & (at["pathway"] == F.col("_pathway")), "left_semi")
        return member.unionByName(dummy.join(with_pathway, gene == F.col("_gene"), "left_anti"))

    def missing(i: int) -> DataFrame:
        return contexts.filter(F.col("position") == i)

    gene = at["gene"]
    drugs = has_pathway(has_disease(missing(0), gene), gene).join(targets, gene == F.col("_gene")).select(*contexts.columns, F.col("_drug").alias("value"))
    diseases = has_pathway(has_target(missing(3), gene), gene).join(linked, gene == F.col("_gene")).select(*contexts.columns, F.col("_disease").alias("value"))
    ways = has_disease(has_target(missing(2), gene), gene).join(pathways, gene == F.col("_gene")).select(*contexts.columns, F.col("_pathway").alias("value"))
    genes = missing(1).join(targets, at["drug"] == F.col("_drug")).select(*contexts.columns, F.col("_gene").alias("value"))
    genes = has_pathway(has_disease(genes, F.col("value")), F.col("value"))
    return drugs.unionByName(genes).unionByName(ways).unionByName(diseases)


def corrupt_paths(
    quads: DataFrame, nodes: DataFrame, real: DataFrame | None, seed: int, draws: int = 4, edges: DataFrame | None = None,
    on_missing: str = "raise",
) -> DataFrame:
    """Groups of five: each quad and one corruption per position.

    A position at which nothing is allowed is an error, or missing from its
    group if ``on_missing`` is 'drop'.

    A negative differs from its positive in one position and is no row of
    ``real``, or with ``edges`` no mechanism of them: draws are then checked against the edges, and where these
    run out the forbidden ids are read off the edges of the three ids that stay; mechanisms are never enumerated.
    Columns: the group's positive as ``pos_*``, ``candidate_idx`` (0 positive,
    then drug, gene, pathway, disease), ``label`` and the candidate's four ids.
    """
    if (real is None) == (edges is None):
        raise ValueError("pass either the real mechanisms or the edges they follow from")
    positives = materialize(quads.select(*QUAD).distinct(), "positives")
    types = {"drug": "drug", "gene": "gene/protein", "pathway": "pathway", "disease": "disease"}
    position_of = F.coalesce(
        *[F.when(F.col("node_type") == t, F.lit(QUAD.index(c))) for c, t in types.items()]
    )
    pool = numbered_pool(
        nodes.select(position_of.alias("position"), F.col("global_id").alias("value")).filter("position is not null"),
        ["position"],
        seed,
    )

    def at_positions(paths: DataFrame, value_name: str) -> DataFrame:
        """Four rows per quad: position, the other three ids, the id at the position."""
        cells = []
        for i, c in enumerate(QUAD):
            rest = [F.when(F.lit(c != d), F.col(d)).otherwise(F.lit(-1)).cast("bigint").alias(f"at_{d}") for d in QUAD]
            cells.append(F.struct(F.lit(i).alias("position"), *rest, F.col(c).alias(value_name)))
        return paths.select(F.inline(F.array(*cells)))

    context = ["position", *[f"at_{c}" for c in QUAD]]
    requests = at_positions(positives, "current")

    def excluded(left: DataFrame) -> DataFrame:
        if edges is None:
            return at_positions(real.select(*QUAD).unionByName(positives).distinct(), "value")
        left = materialize(left, "contexts")
        own = at_positions(positives, "value").join(left, context, "left_semi")
        return own.unionByName(_real_values(left, edges)).distinct()

    def ids(prefix: str, at_position: str) -> list[Column]:
        return [
            F.when(F.col("position") == i, F.col(at_position)).otherwise(F.col(f"at_{c}")).alias(f"{prefix}{c}")
            for i, c in enumerate(QUAD)
        ]

    def reject(tried: DataFrame) -> DataFrame:
        changed = tried.filter(F.col("value") != F.col("current")).select("*", *ids("", "value"))
        known = changed.join(positives, list(QUAD), "left_anti").select(*changed.columns)
        if edges is not None:
            return drop_real_quads(known, edges)
        return known.join(real.select(*QUAD), list(QUAD), "left_anti")

    drawn = draw_excluding(
        requests, [*context, "current"], context, pool, ["position"], excluded, "value", f"{seed}:corrupt", draws,
        reject=reject,
    )
    drawn = _checked(requests, drawn, [*context, "current"], "corruption", on_missing)
    negatives = drawn.select(
        *ids("pos_", "current"), (F.col("position") + 1).alias("candidate_idx"), F.lit(0).alias("label"), *ids("", "value")
    )
    own = positives.select(
        *[F.col(c).alias(f"pos_{c}") for c in QUAD], F.lit(0).alias("candidate_idx"), F.lit(1).alias("label"), *QUAD
    )
    return own.unionByName(negatives)


def drop_edges(edges: DataFrame, p: float, seed: int, keep_one: bool = True) -> DataFrame:
    """Drop edges with probability ``p``; a type that would vanish keeps one edge."""
    cols = ["src_type", "rel", "dst_type", "src_id", "dst_id"]
    unit = key_unit(seed, *cols)
    kept = edges.filter(unit > p)
    if not keep_one:
        return kept
    best = edges.groupBy("src_type", "rel", "dst_type").agg(
        F.max(unit).alias("_u"), F.max_by(F.struct("src_id", "dst_id"), F.struct(unit, "src_id", "dst_id")).alias("_e")
    )
    saved = best.filter(F.col("_u") <= p).select("_e.src_id", "src_type", "rel", "dst_type", "_e.dst_id")
    return kept.unionByName(saved.select(*edges.columns))


def mask_features(features: DataFrame, p: float, seed: int, dim: int, key: str = "key", vec: str = "vec") -> DataFrame:
    """Zero the vector of a random share ``p`` of the rows."""
    return features.withColumn(vec, F.when(key_unit(seed, key) < p, zeros(dim)).otherwise(F.col(vec)))


def sample_nodes(nodes: DataFrame, node_type: str, n: int, seed: int) -> DataFrame:
    """``n`` random nodes of a type; all of them for ``n <= 0``."""
    typed = nodes.filter(F.col("node_type") == node_type)
    if n <= 0:
        return typed
    return sample_k(typed, ["global_id"], n, seed)


def path_counts(pairs: DataFrame, drug: str, disease: str, paths: DataFrame, out: str = "n_paths") -> DataFrame:
    """Number of bank paths of each pair, 0 when it has none."""
    counts = paths.groupBy(F.col("drug").alias(drug), F.col("disease").alias(disease)).agg(F.count("*").alias(out))
    return pairs.join(counts, [drug, disease], "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))


def dummy_ratio(paths: DataFrame) -> DataFrame:
    dummy = F.count_if(F.col("pathway") == DUMMY_PATHWAY)
    return paths.agg(
        dummy.alias("n_dummy"),
        F.count("*").alias("n_paths"),
        F.coalesce(F.try_divide(dummy.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("dummy_ratio"),
    )
