"""Fixed column layouts and vocabularies shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([
    T.StructField("global_id", T.LongType()),
    T.StructField("local_id", T.LongType()),
    T.StructField("raw_id", T.StringType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("source", T.StringType()),
])

EDGE_SCHEMA = T.StructType([
    T.StructField("src_id", T.LongType()),
    T.StructField("src_type", T.StringType()),
    T.StructField("rel", T.StringType()),
    T.StructField("dst_type", T.StringType()),
    T.StructField("dst_id", T.LongType()),
])

RAW_NODE_COLUMNS = ("id", "type", "name", "source")
RAW_EDGE_COLUMNS = ("src_id", "src_type", "rel", "dst_id", "dst_type")

DRUG = "drug"
GENE = "gene/protein"
PATHWAY = "pathway"
DISEASE = "disease"

QUAD = ("drug", "gene", "pathway", "disease")
TRIPLET = ("drug", "gene", "disease")
QUAD_TYPES = {"drug": DRUG, "gene": GENE, "pathway": PATHWAY, "disease": DISEASE}

# A gene without a pathway is carried through four-column paths under this id.
DUMMY_PATHWAY = 0

SPLITS = ("train", "valid", "test", "ot")
SPLIT_MODES = ("random", "cross_drug", "cross_disease")

# --- fixed values: must equal the vocabulary of the files being read ---
DIRECT_RELATIONS = ("indication", "off-label use", "contraindication")

NODE_TYPE_ALIASES = {
    "drug": "drug",
    "compound": "drug",
    "gene": "gene/protein",
    "protein": "gene/protein",
    "gene/protein": "gene/protein",
    "disease": "disease",
    "phenotype": "disease",
    "pathway": "pathway",
    "effect/phenotype": "effect/phenotype",
    "anatomy": "anatomy",
    "exposure": "exposure",
}
# --- end of fixed values ---
