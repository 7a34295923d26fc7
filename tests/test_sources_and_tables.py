"""Readers, writers, identity and table operators on small files."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from toys import EDGE, NODE, rows_of, sampler_graph

from pathloom import lineage
from pathloom.functions.graph import normalize_node_type, normalize_relation
from pathloom.functions.text import chunks, id_suffix, list_literal, numeric_suffix
from pathloom.operators import align, identity, ordered, splits, tables
from pathloom.operators.checks import CheckFailed, require_columns, require_rows
from pathloom.sources import readers, writers
from pathloom.sources.json_entries import header_key, json_entries, list_entry, object_entry

NODES_CSV = """﻿id,type,name,source
drug::A, drug ,Drug A,DrugBank
gene/protein::1,gene/protein,GENE1,NCBI
disease::X,disease,Disease X,MONDO
"""


@pytest.fixture()
def nodes(spark, tmp_path):
    path = tmp_path / "nodes.csv"
    path.write_text(NODES_CSV, encoding="utf-8")
    raw = readers.read_nodes(spark, str(path))
    return identity.assign_ids(raw, ["ord"]).drop("ord")


def test_nodes_keep_file_order_and_lose_the_byte_order_mark(nodes):
    assert rows_of(nodes, "global_id", "local_id", "raw_id", "node_type") == [
        (0, 0, "drug::A", "drug"), (1, 0, "gene/protein::1", "gene/protein"), (2, 0, "disease::X", "disease")
    ]
    identity.assert_unique_ids(nodes)
    with pytest.raises(CheckFailed):
        identity.assert_unique_ids(nodes.unionByName(nodes))


def test_local_ids_count_within_a_type(spark):
    raw = spark.createDataFrame([(i, "ab"[i % 2], f"x{i}") for i in range(10)], "ord int, node_type string, raw_id string")
    got = rows_of(identity.assign_ids(raw, ["ord"]), "global_id", "node_type", "local_id")
    assert got == [(i, "ab"[i % 2], i // 2) for i in range(10)]


def test_edges_to_unknown_nodes(spark, nodes, tmp_path):
    path = tmp_path / "edges.csv"
    path.write_text(
        "src_id,src_type,dst_id,dst_type,rel\ndrug::A,drug,gene/protein::1,gene/protein,targets\ndrug::A,drug,gene/protein::9,gene/protein,targets\n"
    )
    raw = readers.read_edges(spark, str(path))
    kept = identity.build_edge_table(nodes, raw, add_inverse=True)
    assert rows_of(kept, "src_id", "rel", "dst_id") == [(0, "targets", 1), (1, "targets__reverse__", 0)]
    with pytest.raises(CheckFailed):
        identity.build_edge_table(nodes, raw, on_missing="error")
    with pytest.raises(KeyError):
        readers.read_edges(spark, str(tmp_path / "nodes.csv"))


def test_named_paths_reject_whole_paths(spark, nodes):
    named = spark.createDataFrame(
        [(0, "A", "gene1", "disease x"), (1, "drug::A", "1", "X"), (2, "nobody", "1", "X")],
        "path_index int, drug string, gene string, disease string",
    )
    kept, rejected = identity.paths_from_names(named, nodes, ("drug", "gene", "disease"))
    assert rows_of(kept, "path_index", "drug", "gene", "disease") == [(0, 0, 1, 2), (1, 0, 1, 2)]
    assert rows_of(rejected, "path_index", "position", "reason") == [(2, 0, "missing")]


def test_ambiguous_names(spark):
    rows = [(0, 0, "drug::1", "drug", "Same", "s"), (1, 1, "drug::2", "drug", "same ", "s"), (2, 2, "drug::3", "drug", "Other", "s")]
    nodes = spark.createDataFrame(rows, NODE)
    unique, ambiguous = identity.alias_index(nodes)
    assert ("other",) in rows_of(unique, "alias") and ("same",) not in rows_of(unique, "alias")
    assert rows_of(ambiguous, "alias", "global_id") == [("same", 0), ("same", 1)]
    assert rows_of(identity.alias_index_first_wins(nodes).filter("alias = 'same'"), "raw_id") == [("drug::1",)]
    asked = spark.createDataFrame([("drug", " SAME"), ("drug", "3"), ("drug", "x")], "node_type string, value string")
    assert rows_of(identity.lookup_entity(asked, nodes), "value", "status") == [(" SAME", "ambiguous"), ("3", "ok"), ("x", "missing")]


def test_source_aliases(spark):
    rows = [
        (0, 0, "drug::DB01", "drug", "n", "DrugBank"), (1, 0, "gene/protein::77", "gene/protein", "g", "NCBI"),
        (2, 0, "disease::0042", "disease", "d", "MONDO_grouped"),
    ]
    aliases = identity.alias_index_first_wins(spark.createDataFrame(rows, NODE))
    found = {r.alias for r in aliases.collect()}
    assert {"drugbank:db01", "entrez:77", "ncbi:77", "mondo:42", "mondo:0000042", "mondo_0000042", "mondo:0042"} <= found


@pytest.mark.parametrize(
    "written, expected",
    [(" Gene_Protein", "gene/protein"), ("Compound", "drug"), ("phenotype", "disease"), (" molecular_function ", "molecular_function"), ("Effect_Phenotype", "effect/phenotype")],
)
def test_node_type_spelling(spark, written, expected):
    assert spark.createDataFrame([(written,)], "t string").select(normalize_node_type("t")).first()[0] == expected


@pytest.mark.parametrize(
    "variant, expected",
    [("plain", ["x", "x", "x", "x_reverse"]), ("batch", ["x", "x", "x", "x"]), ("sampler", ["x", "x", "reverse_x", "x"])],
)
def test_relation_affixes(spark, variant, expected):
    df = spark.createDataFrame([("rev_x",), ("x__reverse__",), ("reverse_x",), ("x_reverse",)], "r string")
    assert [r[0] for r in df.select(normalize_relation("r", variant)).collect()] == expected


def test_string_functions(spark):
    df = spark.createDataFrame([("a::b::7", "['x', 'nan', 'x','y z']", "[one; two|'three', four]\n", "plain")], "i string, l string, c string, p string")
    row = df.select(
        id_suffix("i").alias("i"), numeric_suffix("i").alias("n"), list_literal("l").alias("l"), chunks("c").alias("c"),
        numeric_suffix("p").alias("none"), list_literal("p").alias("p"),
    ).first()
    assert (row.i, row.n, row.l, row.c, row.none, row.p) == ("b::7", "7", ["x", "y z"], ["one", "two", "three", "four"], None, ["plain"])


def test_tables_by_suffix(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Drug Name,ID\na,1\n")
    (tmp_path / "t.tsv").write_text("Drug Name\tID\na\t1\n")
    (tmp_path / "t.jsonl").write_text('{"Drug Name":"a","ID":"1"}\n')
    (tmp_path / "t.json").write_text('[{"Drug Name":"a","ID":"1"}]')
    for suffix in ("csv", "tsv", "jsonl", "json"):
        df = readers.standardize_columns(readers.read_table(spark, str(tmp_path / f"t.{suffix}")))
        assert rows_of(df, "drug_name", "id") == [("a", "1")]
    with pytest.raises(ValueError):
        readers.read_table(spark, "t.xlsx")
    assert readers.resolve_column(df, ["nope", "id"]) == "id"
    assert readers.resolve_column(df, ["nope"], required=False) is None
    assert readers.resolve_column(df, [], explicit="DRUG_NAME") == "drug_name"
    with pytest.raises(KeyError):
        readers.resolve_column(df, ["nope"])
    with pytest.raises(KeyError):
        require_columns(df, ["nope"], "t")
    with pytest.raises(ValueError):
        require_rows(df.limit(0), "t")


def test_path_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("drug_id,gene_id,disease_id\n1,2,3\n")
    (tmp_path / "b.csv").write_text("note,w,x,y,z\nk,1,2,3,4\n")
    (tmp_path / "c.json").write_text('{"test_paths": [[1,2,3,4],[5,6,7,8]]}')
    assert rows_of(readers.read_paths(spark, str(tmp_path / "a.csv")), "drug", "gene", "disease") == [(1, 2, 3)]
    assert rows_of(readers.read_paths(spark, str(tmp_path / "b.csv")), "drug", "pathway", "disease") == [(1, 3, 4)]
    assert rows_of(readers.read_paths(spark, str(tmp_path / "c.json")), "drug", "disease") == [(1, 4), (5, 8)]


def test_mapping_reader(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"A ": "x", "a": "y", "b": " "}))
    (tmp_path / "m.csv").write_text("from_id,to_id\nA,1\nA,2\n a,3\nb,\n")
    assert rows_of(readers.read_mapping(spark, str(tmp_path / "m.json")), "source", "target") == [("a", "y")]
    # keep-first needs the trimmed source: 'A' keeps 1, then 'a' is the last per normalised source
    assert rows_of(readers.read_mapping(spark, str(tmp_path / "m.csv")), "source", "target") == [("a", "3")]


def test_json_maps(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"drug": {"drug::1": 0, "1": 0, "Aspirin": 0, "Drug two": 5}}))
    assert rows_of(readers.read_entity_map(spark, str(tmp_path / "e.json")), "global_id", "name") == [(0, "Aspirin"), (5, "Drug two")]
    (tmp_path / "r.json").write_text(json.dumps([{"global_id": 3, "node_type": "drug", "text": "t"}]))
    assert rows_of(readers.read_entity_map(spark, str(tmp_path / "r.json")), "global_id", "name") == [(3, "t")]
    (tmp_path / "i.json").write_text(json.dumps({"d1": {"name": "N", "mechanism_text": "nan"}}))
    assert rows_of(readers.read_id_text(spark, str(tmp_path / "i.json")), "id", "name", "mechanism_text") == [("d1", "N", "")]
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.read_id_text(spark, str(tmp_path / "none.json"))


def test_phase_files(spark, tmp_path):
    (tmp_path / "ot_Phase_3.csv").write_text("a\nx\n")
    (tmp_path / "other.csv").write_text("a\ny\n")
    df = readers.read_csv(spark, str(tmp_path / "*.csv"))
    assert rows_of(readers.union_phase_files(df, {"a": "b"}), "b", "phase") == [("x", 3), ("y", -1)]


def test_run_metrics(spark, tmp_path):
    def value(body, **options):
        path = tmp_path / "run.json"
        path.write_text(json.dumps(body))
        return readers.read_run_metrics(spark, str(path), "hit_at_1", ["best_hit"], **options).first().value

    assert value({"metrics": {"hit_at_1": 0.9}, "ho_eval": {"metrics": {"hit_at_1": 0.5}}}) == 0.9
    assert value({"runs": [{"seed": 1}, {"eval": {"HO-eval": {"Hit@1": 0.25}}}]}) == 0.25
    assert value({"metrics": {"mrr": 1, "Best-Hit": 3}, "other": {"hit_at_1": 2}}) == 3
    with pytest.raises(KeyError, match="ambiguous"):
        value({"ho_eval": {"best_hit": 1}, "metrics": {"best hit": 2}})
    with pytest.raises(KeyError, match="no metric"):
        value({"other": {"hit_at_1": 2}, "metrics": {"hit_at_1": None}})
    assert value({"other": {"hit_at_1": 2}}, on_missing="null") is None


def test_list_literals(spark):
    cells = {
        "['Alzheimer disease', \"Crohn's disease\"]": ["Alzheimer disease", "Crohn's disease"],
        "('a', 'b',)": ["a", "b"], "{'x y', 'z'}": ["x y", "z"], "[]": [], "['it\\'s', 7, None, 'nan']": ["it's", "7"],
        "['a, b', 'c [d]']": ["a, b", "c [d]"], "['a' 'b']": ["a", "b"], "one, two": ["one", "two"], None: [], "['open": ["open"],
    }
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r.l for r in df.select(list_literal("c").alias("l")).collect()] == list(cells.values())


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "n.csv").write_text('id,type,name,source\n1,drug,"a ""quoted"", name\nin two lines",x\n2,drug,b,x\n')
    got = readers.read_nodes(spark, str(tmp_path / "n.csv"))
    assert rows_of(got, "raw_id", "name") == [("1", 'a "quoted", name\nin two lines'), ("2", "b")]


def test_split_asset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1, 2), ("test", 3, 4)], "split string, drug bigint, disease bigint")
    path = str(tmp_path / "splits")
    writers.write_pair_splits(rows, path, "random")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_pair_splits(rows, path, "random")
    writers.write_pair_splits(rows.limit(1), path, "cross_drug", overwrite=True)
    assert readers.read_pair_splits(spark, path, "random").count() == 2
    assert readers.read_pair_splits(spark, path, "cross_drug").count() == 1
    with pytest.raises(ValueError):
        readers.read_pair_splits(spark, path, "other")


def test_feature_tables_by_type(spark, tmp_path, nodes):
    features = spark.createDataFrame(
        [("drug", 0, [1.0, 2.0]), ("disease", 2, [3.0, 4.0])], "node_type string, global_id bigint, vec array<float>"
    )
    path = str(tmp_path / "features")
    meta = writers.write_features_by_type(features, path)
    assert rows_of(meta, "node_type", "n_rows", "dim") == [("disease", 1, 2), ("drug", 1, 2)]
    _, report = readers.read_features_by_type(spark, path, nodes)
    assert rows_of(report, "node_type", "status") == [("disease", "ok"), ("drug", "ok"), ("gene/protein", "missing")]


def test_append_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "FOUND")], "name string, status string")
    for _ in range(2):
        writers.append_results(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    for fmt in ("json", "csv", "parquet"):
        writers.write_table(rows, str(tmp_path / fmt), fmt)
    assert readers.read_csv(spark, str(tmp_path / "csv")).count() == 1
    writers.write_vectors(spark.createDataFrame([("k", [1.0])], "key string, vec array<double>"), str(tmp_path / "v"))
    assert dict(spark.read.parquet(str(tmp_path / "v")).dtypes)["vec"] == "array<float>"


def test_vector_reader(spark):
    good = spark.createDataFrame([(None, "d", [1.0])], "a string, b string, vec array<double>")
    assert rows_of(readers.read_vectors(good, ["a", "b"]), "a", "b") == [("", "d")]
    with pytest.raises(ValueError):
        readers.read_vectors(spark.createDataFrame([("x", [1.0]), ("y", [1.0, 2.0])], "a string, vec array<double>"), ["a"])


def test_patching_and_resuming(spark):
    base = spark.createDataFrame([("a", "NOT_FOUND"), ("b", "keep"), ("c", None)], "name string, smiles string")
    patches = spark.createDataFrame(
        [(" a", "C1", 0), ("a ", "C2", 1), ("b", "B2", 0), ("c", "ERROR", 0)], "name string, smiles string, ord int"
    )
    assert rows_of(tables.patch_missing(base, patches).fillna("?"), "name", "smiles") == [("a", "C2"), ("b", "B2"), ("c", "?")]
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    results = spark.createDataFrame([("a", "FOUND", 0), ("b", "ERROR", 0), ("c", "ERROR", 0), ("c", "not_found ", 1)], "name string, status string, ord int")
    assert rows_of(tables.resume_pending(names, results), "name") == [("b",), ("d",)]
    inferred = spark.createDataFrame([("a", "CC", 0), ("b", "ERROR", 0)], "name string, smiles string, ord int")
    assert rows_of(tables.resume_pending(names, inferred), "name") == [("b",), ("c",), ("d",)]


def test_novelty_is_decided_per_pair(spark, nodes):
    cols = "kg_drug string, kg_target string, kg_disease string"
    triples = spark.createDataFrame([("A", "1", "X"), ("A", "2", "X"), ("B", "3", "Y")], cols)
    train = spark.createDataFrame([("A", "X")], "kg_drug string, kg_disease string")
    report = align.novelty_report(triples, train).first()
    assert (report.n_overlap, report.n_novel, report.overlap_pairs, report.novel_pairs) == (2, 1, 1, 1)
    pairs = spark.createDataFrame([(0, 2)], "drug bigint, disease bigint")
    assert rows_of(align.training_pairs_from(pairs, nodes), "kg_drug", "kg_disease") == [("drug::A", "disease::X")]


def test_largest_remainder():
    assert splits.largest_remainder(10, {"train": 0.7, "valid": 0.1, "test": 0.1, "ot": 0.1}) == {"train": 7, "valid": 1, "test": 1, "ot": 1}
    assert splits.largest_remainder(3, {"train": 0.25, "valid": 0.25, "test": 0.25, "ot": 0.25}) == {"train": 1, "valid": 1, "test": 1, "ot": 0}
    for bad in ({"train": 0.5}, {"train": 1.5, "valid": -0.5}):
        with pytest.raises(ValueError):
            splits.largest_remainder(10, bad)
    with pytest.raises(ValueError):
        splits.truncated_sizes(10, 0.9, 0.2)


def test_radix_selection_matches_sorting(spark, monkeypatch):
    monkeypatch.setattr(splits, "_FINAL_ROWS", 1)
    df = spark.range(3000).select(F.col("id").alias("k"))
    hashed = sorted((r.h, r.k) for r in df.select("k", splits.key_hash(5, "k").alias("h")).collect())
    got = splits._rows_at(df, ["k"], 5, [0, 1, 1499, 2999])
    assert {p: tuple(v) for p, v in got.items()} == {p: hashed[p] for p in (0, 1, 1499, 2999)}


@pytest.mark.parametrize("total", [0, 1, 5])
def test_splits_of_few_rows(spark, total):
    pairs = spark.createDataFrame([(i, i) for i in range(total)], "drug bigint, disease bigint")
    got = splits.split_random(pairs, {"train": 0.7, "valid": 0.1, "test": 0.1, "ot": 0.1}, 1)
    assert got.filter("split is null").isEmpty() and got.count() == total


def test_path_layout(spark, nodes):
    ok = spark.createDataFrame([(0, 1, 2)], "drug bigint, gene bigint, disease bigint")
    identity.validate_paths(ok, nodes)
    with pytest.raises(CheckFailed):
        identity.validate_paths(spark.createDataFrame([(1, 1, 2)], ok.schema), nodes)
    with pytest.raises(CheckFailed):
        identity.validate_paths(spark.createDataFrame([(0, None, 2)], ok.schema), nodes)
    quad = spark.createDataFrame([(0, 1, 0, 2)], "drug bigint, gene bigint, pathway bigint, disease bigint")
    identity.validate_paths(quad, nodes, dummy=0)
    with pytest.raises(CheckFailed):
        identity.validate_paths(quad, nodes)


def test_toy_edge_schema(spark):
    assert spark.createDataFrame(sampler_graph(True), EDGE).count() > 0


def test_resolving_before_the_bridge_gives_the_same_triples(spark):
    from pathloom.operators import align

    nodes = spark.createDataFrame(
        [(1, 0, "drug::a", "drug", "Able", "x"), (2, 0, "gene/protein::7", "gene/protein", "KLN4", "x"),
         (3, 1, "gene/protein::8", "gene/protein", "KLN5", "x"), (4, 0, "disease::z", "disease", "Zed", "x")], NODE)
    left = spark.createDataFrame(
        [("a", "t1", "Able", "KLN4"), ("b", "t1", "Baker", None), ("able", "8", None, None), ("c", "hub", "able", None)]
        + [(f"d{i}", "hub", None, "KLN5") for i in range(40)],
        "drug_id string, target_id string, drug_name string, target_name string")
    right = spark.createDataFrame(
        [("t1", "z", "KLN5", "Zed"), ("t1", "y", None, "zed"), ("8", "q", None, None)] + [("hub", f"e{i}", "KLN4", "Zed") for i in range(30)],
        "target_id string, disease_id string, target_name string, disease_name string")
    before = align.align_associations(left, right, nodes)
    after = align.resolve_entities(align.bridge_join(left, right), nodes)
    assert before.count() == 4 + 1 + 41 * 30
    assert before.select(*after.columns).exceptAll(after).isEmpty() and after.exceptAll(before.select(*after.columns)).isEmpty()


def odd_json(draw, n):
    """Keys and texts with quotes, commas, brackets, escapes, line breaks and wide characters."""
    bits = ['"', "\\", ",", "{", "}", "[", "]", ":", " ", "a", "bc", "\n", "\t", "é", "日", "\U0001f600", "\\\"", '",{"']
    text = lambda: "".join(draw.choice(bits) for _ in range(draw.randrange(0, 12)))
    return {f"{i}{text()}": text() for i in range(n)}


@pytest.fixture
def small_parts(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("indent", [None, 2])
def test_json_is_read_in_ranges(spark, tmp_path, small_parts, indent):
    draw = random.Random(8)
    flat = odd_json(draw, 700)
    nested = {"empty": {}, "a {\"b\", c": odd_json(draw, 300), "list": [1, [2, {"x": "]"}]], "z": odd_json(draw, 200)}
    listed = [{"k": k, "v": [v, {"w": k}]} for k, v in flat.items()]
    for name, value in (("flat", flat), ("nested", nested), ("listed", listed)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    rows = json_entries(spark, str(tmp_path / "flat.json"), {"{": 1})
    assert spark.read.text(str(tmp_path / "flat.json"), lineSep=",").rdd.getNumPartitions() > 3
    got = [r.e for r in rows.orderBy("parent", "entry").select(object_entry("text", "string").alias("e")).collect()]
    assert [(e.key, e.value) for e in got] == list(flat.items())
    rows = json_entries(spark, str(tmp_path / "nested.json"), {"{": 2})
    objects = rows.select(header_key("header").alias("h"), "parent", "entry", object_entry("text", "string").alias("e"))
    got = [(r.h, r.e.key, r.e.value) for r in objects.filter("h <> 'list'").orderBy("parent", "entry").collect()]
    assert got == [(h, k, v) for h in nested if h != "list" for k, v in nested[h].items()]
    assert [r.text.strip() for r in rows.filter(header_key("header") == "list").orderBy("entry").collect()][0] == "1"
    rows = json_entries(spark, str(tmp_path / "listed.json"), {"[": 1})
    kind = "struct<k:string,v:array<string>>"
    got = [r.e for r in rows.orderBy("entry").select(list_entry("text", kind).alias("e")).collect()]
    assert [(e.k, e.v[0], json.loads(e.v[1])) for e in got] == [(x["k"], *x["v"]) for x in listed]
    assert json_entries(spark, str(tmp_path / "listed.json"), {"{": 1}).isEmpty()


def test_json_of_many_files_and_of_none(spark, tmp_path, small_parts):
    folder = tmp_path / "many.json"
    folder.mkdir()
    for n in range(5):
        (folder / f"{n}.json").write_text(" [ ] \n" if n == 3 else json.dumps({f"{n}-{i}": i for i in range(200 * n)}))
    rows = json_entries(spark, str(folder), {"{": 1, "[": 1}).select(object_entry("text", "bigint").alias("e")).collect()
    assert {r.e.key: r.e.value for r in rows} == {f"{n}-{i}": i for n in (0, 1, 2, 4) for i in range(200 * n)}
    (tmp_path / "cut.json").write_text('{"a": [1, 2}')
    (tmp_path / "open.json").write_text('{"a": "1, 2}')
    for name in ("cut", "open"):
        with pytest.raises(ValueError):
            json_entries(spark, str(tmp_path / f"{name}.json"), {"{": 1})


def test_json_readers_in_ranges(spark, tmp_path, small_parts):
    paths = [[i, i + 1, i + 2] for i in range(900)]
    (tmp_path / "p.json").write_text(json.dumps({"other": [[9, 9]], "positive_paths": [[7, 7, 7]], "paths": paths}))
    assert rows_of(readers.read_paths(spark, str(tmp_path / "p.json")), "drug", "gene", "disease") == sorted(map(tuple, paths))
    (tmp_path / "m.json").write_text(json.dumps([{"From_ID": f"s{i}", "to id": f"t{i}", "n": i} for i in range(300)]))
    assert len(rows_of(readers.read_mapping(spark, str(tmp_path / "m.json")), "source", "target")) == 300
    names = {"drug": {f"name {i}": i for i in range(300)} | {f"drug::{i}": i for i in range(300)}, "disease": {"x": 1}}
    (tmp_path / "e.json").write_text(json.dumps(names))
    got = rows_of(readers.read_entity_map(spark, str(tmp_path / "e.json")), "node_type", "global_id", "name")
    assert got == sorted([("disease", 1, "x"), *(("drug", i, f"name {i}") for i in range(300))])


def test_chunks_of_one_hot_key(spark):
    """Half of all pieces belong to one key; its chunks are bounded and joined they are its plain text."""
    draw = random.Random(4)
    rows = [("hot" if i % 2 else f"k{i % 7}", i, "x" * draw.randrange(0, 9) + str(i)) for i in range(4000)] + [(None, 1, "n"), ("one", 1, "y" * 500)]
    df = spark.createDataFrame(rows, "k string, o int, piece string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    chunks = ordered.text_chunks(df, ["k"], "o", "piece", ", ", 200)
    got = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk):
        assert len(r.text) < 200 + 502
        got.setdefault(r.k, []).append(r.text)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, _, p in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, []).append(p)
    assert {k: ", ".join(v) for k, v in got.items()} == {k: ", ".join(v) for k, v in want.items()} and len(got["hot"]) > 60
    lists = ordered.list_chunks(df.fillna("", ["k"]), ["k"], ["o"], 100).collect()
    assert max(len(r["items"]) for r in lists) == 100 and sum(len(r["items"]) for r in lists) == len(rows)


@pytest.mark.parametrize("hits_per_row", [1_000, 0])
@pytest.mark.parametrize("named", [(True, True), (True, False), (False, True), (False, False)])
def test_mapped_triples_are_those_of_the_aligned_table(spark, monkeypatch, named, hits_per_row):
    """Ids that share a node, names on either side, and training pairs in lists or joined."""
    monkeypatch.setattr(align, "HITS_PER_ROW", hits_per_row)
    nodes = spark.createDataFrame(
        [(1, "drug::1", "drug", "a", "X"), (2, "drug::2", "drug", "b", "X"), (3, "gene/protein::1", "gene/protein", "g", "X"),
         (4, "gene/protein::2", "gene/protein", "k", "X"), (5, "disease::1", "disease", "s", "X"), (6, "disease::2", "disease", "t", "X")],
        "global_id long, raw_id string, node_type string, name string, source string",
    )
    left = spark.createDataFrame(
        [("1", "u1", "a", "g"), ("e1", "u1", "a", "g"), ("2", "u2", "b", "g"), ("1", "u2", "a", None), ("2", "u3", "b", None), ("e2", "2", "zz", "k"), ("2", "2", "b", "zz")],
        "drug_id string, target_id string, drug_name string, target_name string",
    )
    right = spark.createDataFrame(
        [("u1", "1", "s", "k"), ("u2", "1", "s", "k"), ("u2", "2", "t", "g"), ("u3", "x", "s", "g"), ("u3", "1", "s", "k"), ("2", "x", "none", "k"), ("2", "2", "t", None)],
        "target_id string, disease_id string, disease_name string, target_name string",
    )
    left, right = (df if keep else df.drop("target_name") for df, keep in zip((left, right), named, strict=True))
    train = spark.createDataFrame([("drug::1", "disease::1"), ("drug::2", "disease::2")], "kg_drug string, kg_disease string")
    sides = align.resolve_associations(left, right, nodes)
    whole = align.fully_mapped(align.align_associations(left, right, nodes))
    expected = sorted(tuple(r) for r in align.mark_overlap(whole, train).collect())
    marked = align.mapped_triples(*sides, train)
    assert expected and sorted(tuple(r) for r in marked.collect()) == expected
    assert sorted(tuple(r) for r in align.mapped_triples(*sides).collect()) == [e[:3] for e in expected]
    assert align.novelty_report(marked).collect() == align.novelty_report(whole, train).collect()
    report = align.mapping_report(align.join_resolved(*sides), align.mapped_triples(*sides))
    assert sorted(report.collect()) == sorted(align.mapping_report(align.join_resolved(*sides)).collect())


def test_one_target_with_many_triples_and_a_training_pair(spark):
    drugs, diseases = 300, 200
    nodes = spark.createDataFrame(
        [(i, f"drug::{i}", "drug", f"d{i}", "X") for i in range(drugs)] + [(1000 + i, f"disease::{i}", "disease", f"s{i}", "X") for i in range(diseases)]
        + [(5000, "gene/protein::7", "gene/protein", "g", "X")],
        "global_id long, raw_id string, node_type string, name string, source string",
    )
    left = spark.range(drugs).selectExpr("string(id) as drug_id", "'7' as target_id", "concat('d', id) as drug_name")
    right = spark.range(diseases).selectExpr("'7' as target_id", "string(id) as disease_id", "concat('s', id) as disease_name")
    train = spark.createDataFrame([("drug::1", "disease::1")], "kg_drug string, kg_disease string")
    marked = align.mapped_triples(*align.resolve_associations(left, right, nodes), train)
    assert marked.filter("is_overlap").count() == 1 and marked.count() == drugs * diseases


def test_tasks_of_a_written_stage_read_bounded_partitions(spark, monkeypatch):
    """One large folder is split by the stated size, and the session's own setting comes back."""
    monkeypatch.setattr(lineage, "MOST_ADVISED", 64 << 10)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    rows = spark.range(200_000, numPartitions=8).selectExpr("md5(string(id)) as a", "'x' as kind")
    written = lineage.materialize(rows, "bounded", ("kind",))
    assert spark.conf.get(name) == before
    assert written.count() == 200_000 and len(written.inputFiles()) >= 8


@pytest.mark.parametrize("named", ["both", "left", "right", "none"])
def test_mapping_report_counts_sides_on_associations(spark, named):
    """Sides are counted without triples, and resolved sides are read from a written table."""
    draw = random.Random(12)
    nodes = spark.createDataFrame(
        [(i, f"{t}::{k}", t, f"{t[:4]} {k}", "MONDO") for i, (t, k) in enumerate((t, k) for t in ("drug", "gene/protein", "disease") for k in range(8))],
        "global_id long, raw_id string, node_type string, name string, source string")
    name = lambda k: draw.choice([None, f"gene {k % 5}", "unheard of"])
    left = {(f"{draw.randrange(12)}", f"{draw.randrange(14)}") for _ in range(70)}
    right = {(f"{draw.randrange(12)}", f"{draw.randrange(14)}") for _ in range(70)}
    dt = spark.createDataFrame([(d, t, name(int(t))) for d, t in sorted(left)], "drug_id string, target_id string, target_name string")
    td = spark.createDataFrame([(t, s, name(int(t))) for s, t in sorted(right)], "target_id string, disease_id string, target_name string")
    if named not in ("both", "left"):
        dt = dt.drop("target_name")
    if named not in ("both", "right"):
        td = td.drop("target_name")
    sides = align.resolve_associations(dt, td, nodes)
    assert all("Join" not in s._jdf.queryExecution().optimizedPlan().toString() for s in sides)
    joined, triples = align.join_resolved(*sides), align.mapped_triples(*sides)
    got = align.mapping_report(joined, triples, sides)
    want = sorted(align.mapping_report(joined).collect())
    assert sorted(got.collect()) == want and 0 < want[0].n_mapped < want[0].n_triples
    assert {s: sorted(c.collect()) for s, c in align.side_counts(*sides).items()} == {
        s: sorted(joined.groupBy(f"{s}_id").agg(F.count("*").alias("n"), F.count(f"kg_{s}").alias("m")).collect()) for s in align.SIDES}
