import json

import pytest

from strainlens.operators import joins
from strainlens.plans import views
from strainlens.sources import clusters, fasta, predictions
from strainlens.sources import splits as split_files


def test_fasta_scan_and_global_index(spark, tmp_path):
    files = []
    for i in range(4):
        name = f"c{i}.fasta"
        (tmp_path / name).write_text(f">r{i}a some text\n{'A' * 5}\n{'a' * (5 + i)}\n\n> r{i}b\n  {'C' * (11 + i)} \n")
        files.append((name, f"DENV{i + 1}"))
    r = fasta.with_global_index(fasta.read_fasta(spark, str(tmp_path)), files)
    got = [(x["index"], x["class"], x.record_id, len(x.sequence)) for x in r.orderBy("index").collect()]
    assert [g[0] for g in got] == list(range(8))
    assert [g[3] for g in got] == [n for i in range(4) for n in (10 + i, 11 + i)]
    assert got[2][1:3] == ("DENV2", "r1a") and got[3][2] == "r1b"
    assert fasta.fasta_problems(fasta.read_fasta(spark, str(tmp_path))).count() == 0
    with pytest.raises(FileNotFoundError, match="gone.fasta"):
        fasta.with_global_index(fasta.read_fasta(spark, str(tmp_path)), [*files, ("gone.fasta", "DENV4")])


def test_fasta_order_over_many_splits(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("".join(f">s{i}\n{'ACGT' * 20}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        r = fasta.with_global_index(fasta.read_fasta(spark, str(tmp_path)), [("x.fasta", "DENV1")])
        assert r.select("block").distinct().count() > 3
        assert [x.record_id for x in r.orderBy("index").collect()] == [f"s{i}" for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_data_before_a_header_is_reported(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("ACGT\n>a\nAC\n")
    assert fasta.fasta_problems(fasta.read_fasta(spark, str(tmp_path))).count() == 1
    with pytest.raises(ValueError, match="before the first header.*x.fasta"):
        fasta.read_fasta(spark, str(tmp_path), strict=True)


@pytest.mark.parametrize("content", ["", "\n \n", ">", ">\n>\n"])
def test_files_without_records_are_reported(spark, tmp_path, content):
    (tmp_path / "good.fasta").write_text(">a\nAC\n")
    assert fasta.read_fasta(spark, str(tmp_path), strict=True).count() == 1
    (tmp_path / "bad.fasta").write_text(content)
    if content.startswith(">"):
        # a header without text is a record without an id, as far as it has a sign
        assert fasta.read_fasta(spark, str(tmp_path), strict=True).count() >= 1
    else:
        with pytest.raises(ValueError, match="bad.fasta"):
            fasta.read_fasta(spark, str(tmp_path), strict=True)


def test_index_has_no_gaps_where_rows_are_blank(spark, tmp_path):
    blank = lambda i: "" if i % 7 else "\n>  \n>"
    (tmp_path / "x.fasta").write_text("".join(f"{blank(i)}>s{i}\n{'ACGT' * 9}\n" for i in range(1, 300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2048)
    try:
        r = fasta.with_global_index(fasta.read_fasta(spark, str(tmp_path)), [("x.fasta", "DENV1")])
        got = r.orderBy("index").collect()
        assert [x["index"] for x in got] == list(range(len(got)))
        assert [x.record_id for x in got if x.record_id] == [f"s{i}" for i in range(1, 300)]
        assert "Window" not in r._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_json_of_folds_in_pieces(spark, tmp_path):
    rows = [(f"f{i % 3}", i, ["train", "val", "test"][i % 5 % 3]) for i in range(2000)]
    path = str(tmp_path / "lines")
    split_files.write_split_json(spark.createDataFrame(rows, "fold string, index bigint, split string"), path, cell=50)
    lines = [json.loads(x) for f in (tmp_path / "lines").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) > 30 and max(sum(len(v) for k, v in x.items() if k != "fold") for x in lines) <= 50
    got = split_files.read_split_json(spark, path, lines=True).collect()
    assert sorted((r.fold, r["index"], r.split) for r in got) == sorted(rows)


def test_cluster_listing_across_splits(spark, tmp_path):
    text, want = "", []
    for c in range(40):
        text += f">Cluster {c}\n"
        for m in range(c % 7 + 1):
            text += f"{m}\t10nt, >v{c}_{m}... {'*' if m == 0 else 'at +/98%'}\n"
            want.append((c, f"v{c}_{m}", m == 0))
    (tmp_path / "x.clstr").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 512)
    try:
        m = clusters.read_listing(spark, str(tmp_path))
        assert sorted((r.cluster_id, r.sequence_id, r.is_representative) for r in m.collect()) == sorted(want)
        s = clusters.listing_summary(m, []).filter("cluster_id = 6").collect()[0]
        assert (s["size"], s.representative) == (7, "v6_0")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_tables(spark, tmp_path):
    (tmp_path / "long.csv").write_text("fold,index,split,serotype,sequence_id\nA,0,train,x,a\nA,1,Training,x,b\nA,2,dev,y,c\nA,3,te,y,d\n")
    got = {(r["index"], r.split) for r in split_files.read_split_csv(spark, str(tmp_path / "long.csv")).collect()}
    assert got == {(0, "train"), (1, "train"), (2, "val"), (3, "test")}
    (tmp_path / "wide.csv").write_text('fold,train_idx,val_idx,test_idx\nA,"[0, 1]",2,"3;4"\n')
    got = {(r.fold, r["index"], r.split) for r in split_files.read_split_csv(spark, str(tmp_path / "wide.csv")).collect()}
    assert got == {("A", 0, "train"), ("A", 1, "train"), ("A", 2, "val"), ("A", 3, "test"), ("A", 4, "test")}
    (tmp_path / "f.json").write_text(json.dumps({"folds": [{"fold": "A", "train_idx": [0], "val_idx": [1], "test_idx": [2]}]}))
    assert split_files.read_split_json(spark, str(tmp_path / "f.json")).count() == 3
    (tmp_path / "bad.csv").write_text("index,split\n0,nonsense\n")
    with pytest.raises(Exception, match="unknown split"):
        split_files.read_split_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_index_recovery_checks_lengths(spark):
    order = spark.createDataFrame([("p", "A", 1, 70), ("p", "A", 2, 30)], "protocol string, fold string, ordinal bigint, index bigint")
    preds = spark.createDataFrame([("p", "m", "A", 1, 0, 0), ("p", "m", "A", 2, 1, 0)], "protocol string, model string, fold string, ordinal bigint, y_true int, y_pred int")
    assert {r.ordinal: r["index"] for r in predictions.recover_index(preds, order).collect()} == {1: 70, 2: 30}
    with pytest.raises(Exception, match="length mismatch"):
        predictions.recover_index(preds.filter("ordinal = 1"), order).collect()


def test_region_table_and_bounds(spark):
    f = spark.createDataFrame([(1, "mat_peptide", "Anchored capsid protein ancC", 95, 200, 1), (1, "mat_peptide", "capsid protein C", 95, 190, 2), (1, "CDS", "ns5", 1, 9, 3),
                               (1, "mat_peptide", "some NS5 part", 201, 900, 4)], "g int, type string, product string, start bigint, end bigint, feature_no int")
    t = joins.region_table(f, spark.createDataFrame([(1, 1000)], "g int, genome_length bigint"), "g")
    got = {r.region: (r.start, r.end) for r in t.collect()}
    assert got == {"5'UTR": (1, 94), "C": (95, 200), "NS5": (201, 900), "3'UTR": (901, 1000)}
    with pytest.raises(Exception, match="missing regions"):
        joins.region_bounds(t, "g").collect()
    b = {r.region: (r.start, r.end) for r in joins.region_bounds(t.filter("region <> \"3'UTR\""), "g", strict=False).collect()}
    assert b["5'UTR"] == (0, 94) and b["3'UTR"] == (901, 11195)


def test_recovery_moves_each_prediction_once(spark):
    """Runs and lengths of folds are few: predictions are not shuffled to meet them, nor sorted before they go to their index."""
    order = spark.range(40).selectExpr("'p' AS protocol", "'A' AS fold", "id + 1 AS ordinal", "70 + id AS index")
    preds = order.drop("index").selectExpr("protocol", "explode(array('m', 'n')) AS model", "fold", "ordinal", "0 AS y_true", "1 AS y_pred")
    found = predictions.recover_index(preds, order, tasks=3)
    out = predictions.unique_out_of_fold(found, tasks=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Subquery")[0].count("Exchange hashpartitioning") == 3
    assert sorted((r.model, r["index"], r.index_source) for r in out.collect()) == sorted((m, 70 + i, "split_file_fallback") for m in "mn" for i in range(40))
    with pytest.raises(Exception, match="length mismatch"):
        predictions.recover_index(preds.filter("ordinal > 1 OR model = 'm'"), order, tasks=3).collect()
    with pytest.raises(Exception, match="duplicate held-out index 70"):
        predictions.unique_out_of_fold(found.unionByName(found.filter("index = 70 AND model = 'm'")), tasks=3).collect()


def small_tables(spark, sf):
    """1 000 orders of 40 customers in 5 countries of 2 regions."""
    spark.range(1000).selectExpr("id AS o_orderkey", "id * 7 % 40 AS o_custkey", "date_add(DATE'1995-01-01', CAST(id AS INT)) AS o_orderdate").write.parquet(f"{sf}/orders.parquet")
    spark.range(40).selectExpr("id AS c_custkey", "id % 5 AS c_nationkey").write.parquet(f"{sf}/customer.parquet")
    spark.range(5).selectExpr("id AS n_nationkey", "concat('n', id) AS n_name", "id % 2 AS n_regionkey").write.parquet(f"{sf}/nation.parquet")
    spark.range(2).selectExpr("id AS r_regionkey", "concat('r', id) AS r_name").write.parquet(f"{sf}/region.parquet")
    return sf


def test_records_and_models_give_the_predictions(spark, tmp_path):
    cols = ["protocol", "model", "index", "fold", "y_true", "y_pred"]
    sf = small_tables(spark, str(tmp_path))
    got = views.model_rows(views.prediction_records(spark, sf), views.MODELS).select(cols)
    want = views.predictions(spark, sf).select(cols)
    assert want.count() == 21_000 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_views_spread_records_behind_a_shuffled_join(spark, tmp_path, monkeypatch):
    """What a task of a prediction sink writes goes with its records, also where customers are too many to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sf = small_tables(spark, str(tmp_path))
    monkeypatch.setattr(views, "ROWS_A_TASK", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = views.predictions(spark, sf)
        assert p.rdd.getNumPartitions() == 10 and p.count() == 21_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prediction_sink_keeps_its_files_open_and_restores_the_setting(spark, tmp_path, monkeypatch):
    key, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before = spark.conf.get(key)
    df = spark.range(60).selectExpr("id AS index", "0 AS y_true", "1 AS y_pred", "array(0.1D, 0.7D, 0.1D, 0.1D) AS prob", "'p' AS protocol", "concat('m', id % 3) AS model", "concat('f', id % 4) AS fold")
    part = type(df.write).partitionBy
    monkeypatch.setattr(type(df.write), "partitionBy", lambda w, *c: (seen.append(spark.conf.get(key)), part(w, *c))[1])
    predictions.write_predictions(df, str(tmp_path / "p"))
    assert int(seen[0]) > 12 and spark.conf.get(key) == before
    got = predictions.read_predictions(spark, str(tmp_path / "p"))
    assert sorted((r["index"], r.model, r.fold, r.prob_1) for r in got.collect()) == [(i, f"m{i % 3}", f"f{i % 4}", 0.7) for i in range(60)]
