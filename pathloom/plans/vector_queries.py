"""Vector queries over the embedding table and over graph entities that own one of its rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..lineage import materialize
from ..operators import graph as gr
from ..operators import jobs
from ..operators import vectors as ve
from ..operators.paths import expand_to_quads
from .audit_queries import rounded
from .derived import pseudo_score, triplets
from .graph_store import graph, table
from .oracle import expect, score
from .registry import query

DIM = 64
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))


def entity_vectors(spark, sf_dir):
    """Vector ids are the entities' global ids less one, so part of the entities have a vector."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("key"), F.col("embedding").alias("vec"))


def mass(vec: str = "vec"):
    """Sum of absolute components, a scalar that shows a vector is the expected one."""
    return F.round(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double"))), 6)


_RAW_MASS = "list_sum(list_transform({0}, lambda x: abs(x::DOUBLE)))"
_MASS = f"round({_RAW_MASS}, 6)"


def long_form(df, *keys):
    return df.select(*keys, F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "l2_norms",
    """SELECT count(*) AS n_vectors, max(len(embedding)) AS dim, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max
  FROM (SELECT embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
)
def l2_norms(spark, sf_dir):
    return rounded(ve.embedding_norms(vectors(spark, sf_dir)), "norm_mean", "norm_std", "norm_min", "norm_max")


@query("l2_normalized", f"SELECT vec_id AS key, {_MASS.format(_UNIT)} AS mass FROM embeddings")
def l2_normalized(spark, sf_dir):
    return ve.l2_normalize(vectors(spark, sf_dir)).select("key", mass().alias("mass"))


_BEST = f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings),
  best AS (SELECT a.vec_id AS key, max(list_inner_product(a.e, b.e)) AS best FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"""


@query("best_cosines", _BEST + " SELECT key, round(best, 6) AS best FROM best")
def best_cosines(spark, sf_dir):
    return rounded(ve.best_cosine(vectors(spark, sf_dir)).drop("nearest"), "best")


@query(
    "max_cosine",
    _BEST + """ SELECT count(*) AS n_rows, round(avg(best), 6) AS mean, round(var_pop(best), 6) AS variance, round(stddev_pop(best), 6) AS std,
  round(min(best), 6) AS min, round(max(best), 6) AS max FROM best""",
)
def max_cosine(spark, sf_dir):
    return rounded(ve.max_cosine_stats(vectors(spark, sf_dir)), "mean", "variance", "std", "min", "max")


_NEAREST = f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings),
  best AS (SELECT a.vec_id AS key, max(list_inner_product(a.e, b.e)) AS best FROM u a, u b WHERE a.label = 0 AND b.label <> 0 GROUP BY a.vec_id)"""


@query(
    "nearest_train",
    _NEAREST + """ SELECT count(*) AS n_compared, round(avg(best), 6) AS mean, round(quantile_disc(best, 0.5), 6) AS median, round(min(best), 6) AS min,
  count(*) FILTER (WHERE best < 0.6::DOUBLE) AS n_below, round(count(*) FILTER (WHERE best < 0.6::DOUBLE) / count(*), 6) AS below_ratio FROM best""",
)
def nearest_train(spark, sf_dir):
    """Vectors of label 0 against those of all other labels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")
    test, train = rows.filter("label = 0").drop("label"), rows.filter("label <> 0").drop("label")
    nearest = materialize(ve.best_cosine(test, train), "nearest")
    out = ve.nearest_train_summary(nearest, 0.6, test.agg(F.count("*")).scalar())
    return rounded(out, "mean", "median", "min", "below_ratio")


@query(
    "nearest_by_text_key",
    _NEAREST + " SELECT 'v' || key AS key, round(best, 6) AS best FROM best",
)
def nearest_by_text_key(spark, sf_dir):
    """The same comparison with raw ids as keys."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("key"), F.col("embedding").alias("vec"), "label")
    test, train = rows.filter("label = 0").drop("label"), rows.filter("label <> 0").drop("label")
    return rounded(ve.best_cosine(test, train).drop("nearest"), "best")


# --- path vectors: a triplet is represented by its gene's vector ---

_PATHS = f""", pv AS (SELECT t.drug, t.disease, t.gene, embedding::DOUBLE[] AS v, {score('drug', 'gene', 'disease')} AS score
    FROM (SELECT DISTINCT drug, gene, disease FROM pt_random) t JOIN embeddings ON vec_id + 1 = gene),
  ex AS (SELECT drug, disease, score, unnest(v) AS x, unnest(range({DIM})) AS dim FROM pv),
  keys AS (SELECT DISTINCT drug, disease FROM pt_random)"""


def _pooled(body: str) -> str:
    return expect(
        "pt_random",
        _PATHS + f", pooled AS ({body}) SELECT k.drug, k.disease, d AS dim, round(coalesce(p.value, 0), 6) AS value FROM keys k CROSS JOIN range({DIM}) t(d) LEFT JOIN pooled p ON p.drug = k.drug AND p.disease = k.disease AND p.dim = d",
    )


def path_vectors_of(spark, sf_dir):
    paths = triplets(spark, sf_dir, "random").select("drug", "gene", "disease")
    owned = entity_vectors(spark, sf_dir).withColumnRenamed("key", "gene")
    return paths, paths.join(owned, "gene").withColumn("score", pseudo_score("drug", "gene", "disease"))


def _pool_query(mode: str, body: str):
    @query(f"path_pool_{mode}", _pooled(body))
    def run(spark, sf_dir):
        pairs, rows = path_vectors_of(spark, sf_dir)
        return long_form(ve.pool_paths(pairs, rows, mode, DIM), "drug", "disease")

    return run


_pool_query("mean", "SELECT drug, disease, dim, avg(x) AS value FROM ex GROUP BY ALL")
_pool_query("max", "SELECT drug, disease, dim, max(x) AS value FROM ex GROUP BY ALL")
_pool_query("attention", "SELECT drug, disease, dim, sum(x * exp(score)) / sum(exp(score)) AS value FROM ex GROUP BY ALL")


@query(
    "token_pool",
    f"""WITH ex AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range({DIM})) AS dim, embedding[1] > 0 AS m FROM embeddings)
  SELECT label AS key, dim, round(coalesce(avg(x) FILTER (WHERE m), 0), 6) AS value, 'mean' AS mode FROM ex GROUP BY label, dim
  UNION ALL SELECT label, dim, round(arg_min(x, vec_id), 6), 'cls' FROM ex GROUP BY label, dim""",
)
def token_pool(spark, sf_dir):
    """The vectors of a label as the tokens of one text, in id order."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min("vec_id").alias("first"))
    tokens = rows.join(first, "label").selectExpr(
        "label as key", "vec_id - first as pos", "embedding[0] > 0 as mask", "embedding as vec"
    )
    tokens = tokens.withColumn("mask", F.col("mask").cast("int"))
    parts = [
        long_form(ve.pool_tokens(tokens, mode, DIM), "key").withColumn("mode", F.lit(mode)) for mode in ("mean", "cls")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "neighbor_mean",
    expect(
        "edges",
        f""", ex AS (SELECT dst_id, rel, (src_id % 3 + 1) / 4.0::DOUBLE AS w, unnest(embedding::DOUBLE[]) AS x, unnest(range({DIM})) AS dim FROM edges JOIN embeddings ON vec_id + 1 = src_id)
  SELECT dst_id AS key, dim, round(sum(v), 6) + 0.0::DOUBLE AS value FROM (SELECT dst_id, rel, dim, sum(w * x) / greatest(sum(w), 1) AS v FROM ex GROUP BY ALL) GROUP BY dst_id, dim""",
    ),
)
def neighbor_mean(spark, sf_dir):
    weight = (F.col("src_id") % 3 + 1) / F.lit(4.0)
    out = ve.neighbor_aggregate(graph(spark, sf_dir).edges, entity_vectors(spark, sf_dir), weight)
    return long_form(out, "key")


# --- look-ups ---


@query(
    "feature_lookup",
    expect(
        "nodes",
        f"SELECT global_id AS key, vec_id IS NOT NULL AS available, coalesce({_MASS.format('embedding')}, 0) AS mass FROM nodes LEFT JOIN embeddings ON vec_id + 1 = global_id",
    ),
)
def feature_lookup(spark, sf_dir):
    ids = graph(spark, sf_dir).nodes.select(F.col("global_id").alias("key"))
    return ve.lookup_features(ids, entity_vectors(spark, sf_dir), DIM).select("key", "available", mass().alias("mass"))


@query(
    "feature_override",
    f"""SELECT a.vec_id AS key, b.vec_id IS NOT NULL AS overridden, {_MASS.format('coalesce(b.embedding, a.embedding)')} AS mass FROM embeddings a
  LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND b.label = 1""",
)
def feature_override(spark, sf_dir):
    external = table(spark, sf_dir, "embeddings").filter("label = 1").selectExpr("vec_id - 1 as key", "embedding as vec")
    out = ve.override_features(vectors(spark, sf_dir), external)
    return out.select("key", "overridden", mass().alias("mass"))


_TEACHER = """, tr AS (SELECT drug, disease, gene, embedding FROM (SELECT DISTINCT drug, gene, disease FROM pt_random) JOIN embeddings ON vec_id = disease - drug * 10)"""


def teacher(spark, sf_dir):
    """Triplet vectors that exist for part of the triplets only."""
    rows = table(spark, sf_dir, "embeddings")
    paths = triplets(spark, sf_dir, "random").select("drug", "gene", "disease")
    return paths.join(rows, F.col("vec_id") == F.col("disease") - F.col("drug") * 10).select(
        "drug", "disease", "gene", F.col("embedding").alias("vec")
    )


@query(
    "triplet_lookup",
    expect(
        ("pt_random",),
        _TEACHER + f""" SELECT drug, gene, disease, embedding IS NOT NULL AS hit, coalesce({_MASS.format('embedding')}, 0) AS mass FROM (SELECT DISTINCT drug, gene, disease FROM pt_random) LEFT JOIN tr USING (drug, gene, disease)""",
    ),
)
def triplet_lookup(spark, sf_dir):
    paths = triplets(spark, sf_dir, "random").select("drug", "gene", "disease")
    out = ve.lookup_triplet_vectors(paths, teacher(spark, sf_dir), DIM)
    return out.select("drug", "gene", "disease", "hit", mass().alias("mass"))


@query(
    "distill",
    expect(
        ("pt_random",),
        _TEACHER + """, both_v AS (SELECT p.embedding::DOUBLE[] AS a, tr.embedding::DOUBLE[] AS b FROM tr JOIN embeddings p ON p.vec_id + 1 = gene)
  SELECT 'cosine' AS mode, count(*) AS n_hits, round(coalesce(1 - avg(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))), 0), 6) AS value FROM both_v
  UNION ALL SELECT 'mse', count(*), round(coalesce(avg(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a)), 0), 6) FROM both_v""",
    ),
)
def distill(spark, sf_dir):
    _, rows = path_vectors_of(spark, sf_dir)
    predictions = rows.select("drug", "gene", "disease", "vec")
    parts = [
        ve.distill_metric(predictions, teacher(spark, sf_dir), mode, DIM).select(F.lit(mode).alias("mode"), "*")
        for mode in ("cosine", "mse")
    ]
    return rounded(parts[0].unionByName(parts[1]), "value")


@query(
    "path_vectors",
    expect(
        ("pt_random", "gp"),
        f""", q AS (SELECT DISTINCT drug, gene, coalesce(pathway, 0) AS pathway, disease FROM pt_random LEFT JOIN gp USING (gene))
  SELECT drug, gene, pathway, disease, round(coalesce({_RAW_MASS.format('a.embedding')}, 0), 5) AS drug_mass, round(coalesce({_RAW_MASS.format('b.embedding')}, 0), 5) AS gene_mass,
    round(coalesce({_RAW_MASS.format('c.embedding')}, 0), 5) AS pathway_mass, round(coalesce({_RAW_MASS.format('d.embedding')}, 0), 5) AS disease_mass, 256 AS dim
  FROM q LEFT JOIN embeddings a ON a.vec_id + 1 = drug LEFT JOIN embeddings b ON b.vec_id + 1 = gene LEFT JOIN embeddings c ON c.vec_id + 1 = pathway AND pathway <> 0 LEFT JOIN embeddings d ON d.vec_id + 1 = disease""",
    ),
)
def path_vectors(spark, sf_dir):
    quads = expand_to_quads(
        triplets(spark, sf_dir, "random").drop("split"), gr.gene_pathways(graph(spark, sf_dir).edges), distinct=True
    )
    out = ve.concat_path_vectors(quads, entity_vectors(spark, sf_dir), DIM)
    parts = {
        f"{c}_mass": F.round(
            F.aggregate(F.slice("vec", i * DIM + 1, DIM), F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double"))), 5
        )
        for i, c in enumerate(("drug", "gene", "pathway", "disease"))
    }
    return out.withColumns(parts).withColumn("dim", F.size("vec")).drop("vec")


# --- whitening: axes are defined up to sign, so only their effect is compared in tests ---


@query("whiten")
def whiten(spark, sf_dir):
    return ve.whiten(vectors(spark, sf_dir), 32)


@query("whiten_effect", "SELECT count(*) AS n_rows, true AS centred, true AS uncorrelated FROM embeddings")
def whiten_effect(spark, sf_dir):
    """What whitening must reach whatever the signs of its axes: means 0 and covariance 1 before rows are scaled."""
    n = 8
    white = ve.whitened(vectors(spark, sf_dir), n)
    flat = white.select(*[F.col("vec")[i].alias(f"x{i}") for i in range(n)])
    means = F.greatest(*[F.abs(F.avg(f"x{i}")) for i in range(n)])
    spread = F.greatest(*[F.abs(F.covar_samp(f"x{i}", f"x{j}") - float(i == j)) for i in range(n) for j in range(i, n)])
    return flat.agg(F.count("*").alias("n_rows"), (means < 1e-6).alias("centred"), (spread < 1e-6).alias("uncorrelated"))


@query("abtt_effect", "SELECT count(*) AS n_rows, true AS unit_rows, true AS flat_axes FROM embeddings")
def abtt_effect(spark, sf_dir):
    """Rows without the top axes have norm 1 and no share left along those axes."""
    rows = vectors(spark, sf_dir)
    mean, _, axes, _ = ve.principal_axes(rows)
    out = ve.all_but_top(rows, 3)
    along = [F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(a)) for a in axes[:, k]]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
             for k in range(3)]
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return out.agg(
        F.count("*").alias("n_rows"), (F.max(F.abs(norm - 1)) < 1e-6).alias("unit_rows"),
        (F.max(F.greatest(*[F.abs(a) for a in along])) < 1e-6).alias("flat_axes"),
    )


@query(
    "choose_k",
    """WITH sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), seen AS (SELECT label AS k, n::DOUBLE / (SELECT max(n) FROM sizes) AS mean FROM sizes)
  SELECT k, round(mean, 6) AS mean FROM seen ORDER BY NOT (mean BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE), abs(mean - 0.5::DOUBLE), k LIMIT 1""",
)
def choose_k(spark, sf_dir):
    """The rule for the best number of components, on figures that the labels' sizes stand for."""
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).scalar()
    return rounded(ve.choose_k(sizes.select(F.col("label").alias("k"), (F.col("n") / most).alias("mean"))), "mean")


@query("all_but_top")
def all_but_top(spark, sf_dir):
    return ve.all_but_top(vectors(spark, sf_dir), 3)


# --- jobs ---


def digest_encoder():
    """Deterministic stand-in for a text model: length and two digest numbers."""
    def encode(texts: list[str]) -> list[list[float]]:
        if any(len(t) == 0 for t in texts):
            raise ValueError("empty text")
        marks = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        return [[float(len(t)), float(int(m[:4], 16)), float(int(m[4:8], 16))] for t, m in zip(texts, marks, strict=True)]

    return encode


@query(
    "encode_text",
    """SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN m THEN 'missing' ELSE 'ok' END AS status, CASE WHEN m THEN 0 ELSE length(text) END AS v0,
  CASE WHEN m THEN 0 ELSE ('0x' || substr(md5(text), 1, 4))::BIGINT END AS v1, CASE WHEN m THEN 0 ELSE ('0x' || substr(md5(text), 5, 4))::BIGINT END AS v2
  FROM (SELECT doc_id, text, coalesce(toxic = 1, false) AS m FROM documents LEFT JOIN labels USING (doc_id))""",
)
def encode_text(spark, sf_dir):
    """Whole documents; toxic ones come without text."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select(
        F.col("doc_id").alias("key"), F.when(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.lit(" NaN ")).otherwise(F.col("text")).alias("text")
    )
    out = jobs.encode_text_job(rows, digest_encoder, 3)
    return out.select("key", "status", *[F.col("vec")[i].cast("bigint").alias(f"v{i}") for i in range(3)])


def letter_counts(text: str) -> list[float] | None:
    return None if text.startswith("s") else [float(text.count(c)) for c in "aeio"]


_PRINTS = """SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_size > 45 THEN 'missing' WHEN p_name LIKE 's%' THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN p_size > 45 OR p_name LIKE 's%' THEN 0 ELSE length(p_name) - length(replace(p_name, 'a', '')) END AS v0,
  CASE WHEN p_size > 45 OR p_name LIKE 's%' THEN 0 ELSE length(p_name) - length(replace(p_name, 'e', '')) END AS v1 FROM part"""


def _prints(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as key", "case when p_size > 45 then 'NOT_FOUND' else p_name end as smiles"
    )
    return jobs.fingerprint_job(rows, letter_counts, 4)


@query("fingerprint", _PRINTS)
def fingerprint(spark, sf_dir):
    out = _prints(spark, sf_dir)
    return out.select("key", "status", *[F.col("vec")[i].cast("bigint").alias(f"v{i}") for i in range(2)])


@query(
    "run_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS success, count(*) FILTER (WHERE status <> 'ok') AS zero_filled,
  count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'invalid') AS invalid, 0 AS failed, 0 AS retried FROM ({_PRINTS})""",
)
def run_stats(spark, sf_dir):
    return jobs.build_run_stats(_prints(spark, sf_dir))
