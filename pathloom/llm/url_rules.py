"""URL filter: fixed host and path rules, then association rules mined from labels."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize

# Host and path rules with their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LEAST_BLOCKED = 3  # blocked pages behind a rule, however many pages are labelled
MIN_CONFIDENCE = 0.5
LONGEST_RULE = 3
DEVIATIONS = 1.645  # of the bound that must pass the base rate, for each token of a rule


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path starts the url's."""
    def fits(rule: str) -> Column:
        rule_host, slash, rest = rule.partition("/")
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)

    longest = sorted((r for r, _ in rules), key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in longest])


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, parts of labels with a dash, path words without digits, extension, names of parameters, scheme."""
    host, path = host_of(url), path_of(url)
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))
    parts = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    with_dash = F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-")))
    dashed = F.transform(F.flatten(F.transform(with_dash, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x))
    words = F.transform(F.split(F.lower(path), r"[^\p{L}]+"), lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(
        F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q:"), F.lower(x))
    )
    tokens = F.concat(parts, dashed, words, query, F.array(F.concat(F.lit("s:"), scheme)))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: F.length(x) > 2)))


def sure_enough(both: Column, n: Column, size: Column, base: Column) -> Column:
    """Confidence of MIN_CONFIDENCE at least, and its lower Wilson bound above the base rate.

    Longer rules are many, so their bound is taken that many more deviations down.
    """
    z = F.lit(DEVIATIONS) * size
    p = both / n
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return (p >= MIN_CONFIDENCE) & (F.round(bound, 9) > F.round(base, 9))


def token_classes(rows: DataFrame, least: int) -> DataFrame:
    """(token, item, n, both): tokens on ``least`` blocked rows or more; those on the very same rows are one item.

    Rows are told apart by two 64-bit hashes combined over them. Tokens that always come together, such as those of a template,
    would make every subset of them a frequent set of its own.
    """
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("blocked").alias("both"),
        F.bit_xor(F.xxhash64("row")).alias("_x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("_y"),
    ).filter(F.col("both") >= least)
    seen = materialize(seen, "tokens")
    same = ["n", "both", "_x", "_y"]
    named = seen.groupBy(*same).agg(F.min("token").alias("item"))
    return materialize(seen.join(named, same).select("token", "item", "n", "both"), "classes")


def as_items(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, items): the items of each row (row, tokens) that has any."""
    each = rows.select("row", F.explode("tokens").alias("token"))
    return each.join(classes.select("token", "item"), "token").groupBy("row").agg(F.collect_set("item").alias("items"))


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule and the other columns of ``rules``) where a row (row, items) holds all items of a rule (rule, anchor).

    An inverted index: a rule stands under its rarest item, and rows meet it by that one.
    """
    each = rows.select("row", "items", F.explode("items").alias("_item"))
    met = each.join(rules, F.col("_item") == F.col("anchor"))
    held = F.forall("rule", lambda t: F.array_contains(F.col("items"), t))
    return met.filter(held).drop("items", "_item")


def anchored(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules with ``anchor``, the item that fewest labelled rows have."""
    sizes = classes.select(F.col("item").alias("_i"), "n").distinct()
    each = rules.select("rule", F.explode("rule").alias("_i")).join(sizes, "_i")
    rare = each.groupBy(F.col("rule").alias("_rule")).agg(F.min_by("_i", F.struct("n", "_i")).alias("anchor"))
    return rules.join(rare, F.col("rule") == F.col("_rule")).drop("_rule")


def mine_rules(labelled: DataFrame, least: int = LEAST_BLOCKED, longest: int = LONGEST_RULE) -> tuple[DataFrame, DataFrame]:
    """(classes, rules) from (tokens, blocked); rules (rule, anchor, confidence) say "items imply block".

    Frequent-pattern growth over the blocked rows finds the sets of up to ``longest`` items that ``least`` of them
    share, a number that does not grow with the table; an inverted index counts all labelled
    rows that hold a set. A set is a rule if it is ``sure_enough`` and no part of
    it is as sure. All labelled rows count, and classes and rules stay tables. No labelled row, or none blocked, gives no rule.
    """
    rows = materialize(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"), "labelled")
    classes = token_classes(rows, least)
    items = as_items(rows, classes)
    items = materialize(items.join(rows.select(F.col("row").alias("_r"), "blocked"), F.col("row") == F.col("_r")).drop("_r"), "items")
    blocked = items.filter("blocked")
    n_blocked = blocked.count()
    if not n_blocked:
        empty = classes.sparkSession.createDataFrame([], "rule array<string>, anchor string, confidence double")
        return classes, empty
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, least - 0.5) / n_blocked, minConfidence=1.0).fit(blocked.select("items"))
    sets = model.freqItemsets.filter(F.size("items") <= longest).select(F.array_sort("items").alias("rule"), F.col("freq").alias("both"))
    sets = materialize(anchored(sets, classes), "sets")
    counts = matches(items, sets).groupBy("rule", "anchor", "both").agg(F.count("*").alias("n"))
    base = rows.select(F.avg(F.col("blocked").cast("double"))).scalar()
    sure = counts.filter(sure_enough(F.col("both"), F.col("n"), F.size("rule"), base)).select(
        "rule", "anchor", (F.col("both") / F.col("n")).alias("confidence"))
    sure = materialize(sure, "rules")
    parts = F.when(F.size("rule") == 2, F.transform("rule", lambda t: F.array(t))).when(
        F.size("rule") == 3, F.concat(F.transform("rule", lambda t: F.array(t)), F.transform("rule", lambda t: F.array_remove(F.col("rule"), t)))
    )
    shorter = sure.select(F.col("rule").alias("_part"), F.col("confidence").alias("_c"))
    idle = sure.select("rule", "confidence", F.explode(parts).alias("_p")).join(shorter, F.col("_p") == F.col("_part")).filter(
        F.col("_c") >= F.col("confidence")).select("rule")
    return classes, materialize(sure.join(idle, "rule", "left_anti"), "rules")


def judge_urls(pages: DataFrame, classes: DataFrame, rules: DataFrame, fixed=RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``confidence`` to pages with a ``url``.

    A fixed rule decides where one fits, else a mined rule blocks, else the url
    is allowed; ``confidence`` is that of the surest mined rule that fits, 0 without one. Null or odd urls have an empty host and path and only mined rules
    can fit them. Rows are judged one by one; added names replace
    equal ones. Only tokens and row numbers are shuffled to find mined rules.
    """
    added = ("host", "path", "rule", "verdict", "confidence")
    verdicts = F.create_map(*[F.lit(x) for pair in fixed for x in pair])
    numbered = materialize(pages.withColumns({"_row": F.monotonically_increasing_id(), "_tokens": url_tokens(F.col("url"))}), "pages")
    items = as_items(numbered.select(F.col("_row").alias("row"), F.col("_tokens").alias("tokens")), classes)
    best = matches(items, rules).groupBy(F.col("row").alias("_r")).agg(F.max("confidence").alias("_sure"))
    return (
        numbered.join(best, F.col("_row") == F.col("_r"), "left")
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("rule", fixed_rule(F.col("host"), F.col("path"), fixed))
        .withColumn("confidence", F.coalesce("_sure", F.lit(0.0)))
        .withColumn("verdict", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")])
                    .when(F.col("confidence") > 0, "block").otherwise("allow"))
        .select(*[c for c in pages.columns if c not in added], *added)
    )
