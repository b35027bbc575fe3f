import gzip
import os
import time

import numpy as np
import pandas as pd
import pytest

from tabloom import session
from tabloom.plans import assemble, reports
from tabloom.sources import catalog, convert, readers, sinks


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if path.endswith(".gz") else open)(path, "wt") as f:
        f.write(text)


def test_conversion_report_and_incremental_skip(spark, tmp_path):
    src, out = str(tmp_path / "csv"), str(tmp_path / "pq")
    write(f"{src}/A.csv", "k,v\n1,2.5\n2,\n")
    write(f"{src}/B.csv.gz", "k\n7\n")
    first = {r.table: r for r in convert.convert_tables(spark, src, out).collect()}
    assert first["A"].status == "converted" and first["A"].rows == 2 and first["B"].rows == 1
    assert {r.status for r in convert.convert_tables(spark, src, out).collect()} == {"skipped"}
    time.sleep(1.1)
    write(f"{src}/A.csv", "k,v\n1,2.5\n")
    later = {r.table: r.status for r in convert.convert_tables(spark, src, out).collect()}
    assert later == {"A": "converted", "B": "skipped"}
    assert readers.read_table(spark, f"{out}/A.parquet").count() == 1


def test_one_bad_table_does_not_stop_the_rest(spark, tmp_path):
    src, out = str(tmp_path / "csv"), str(tmp_path / "pq")
    write(f"{src}/bad.csv", "k\nx\n")
    write(f"{src}/good.csv", "k\n1\n")
    got = convert.convert_tables(spark, src, out, {"bad": "not a schema"}).collect()
    assert {r.table: r.status for r in got} == {"bad": "error", "good": "converted"}
    assert next(r for r in got if r.table == "bad").error


def test_resolver_prefers_parquet(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/T.csv", "k\n1\n")
    assert readers.resolve_table(spark, root, "T").count() == 1
    spark.range(3).write.parquet(f"{root}/parquet/T.parquet")
    assert readers.resolve_table(spark, root, "T").count() == 3
    with pytest.raises(FileNotFoundError):
        readers.resolve_table(spark, root, "none")
    with pytest.warns(UserWarning):
        assert readers.resolve_table(spark, root, "none", "warn") is None
    assert readers.default_source(spark, root, fallback="T").count() == 3
    spark.range(4).write.parquet(f"{root}/combined/combined.parquet")
    assert readers.default_source(spark, root, fallback="T").count() == 4


def test_catalogue_covers_all_roles(spark):
    frame = catalog.catalog_frame(spark)
    assert {r.role: r["count"] for r in frame.groupBy("role").count().collect()} == {
        "core": 5, "event": 9, "child": 6, "dictionary": 6,
    }


def clinical(spark, root):
    def save(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")

    save("PATIENTS", [(1, 1, "F"), (2, 2, "M")], "ROW_ID int, SUBJECT_ID int, GENDER string")
    save("ADMISSIONS", [(1, 1, 10, "E"), (2, 1, 11, "U"), (3, 3, 12, "E")], "ROW_ID int, SUBJECT_ID int, HADM_ID int, TYPE string")
    save("ICUSTAYS", [(1, 1, 10, 100), (2, 1, 10, 101)], "ROW_ID int, SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int")
    save("SERVICES", [(1, 1, 11, "MED")], "ROW_ID int, SUBJECT_ID int, HADM_ID int, CURR_SERVICE string")
    save(
        "LABEVENTS",
        [(1, 10, 5, 1.0), (1, 10, 5, 3.0), (1, 10, 6, None), (None, 10, 5, 9.0), (1, 11, 5, 7.0)],
        "SUBJECT_ID int, HADM_ID int, ITEMID int, VALUENUM double",
    )
    save("DIAGNOSES_ICD", [(1, 10, "x"), (1, 10, "y"), (3, 12, "z")], "SUBJECT_ID int, HADM_ID int, ICD9_CODE string")
    save("NOTEEVENTS", [(1, 10, "text")], "SUBJECT_ID int, HADM_ID int, TEXT string")


def test_clinical_assembly(spark, tmp_path):
    root = str(tmp_path)
    clinical(spark, root)
    wide = assemble.assemble_clinical(spark, root)
    rows = wide.collect()
    assert len(rows) == 4  # two ICU stays multiply admission 10
    assert {"ROW_ID_pat", "ROW_ID_icu", "ROW_ID_services", "LABEVENTS_ITEMID_5", "DIAGNOSES_ICD_count"} <= set(wide.columns)
    assert "LABEVENTS_ITEMID_6" not in wide.columns
    ten = [r for r in rows if r.HADM_ID == 10]
    assert {r.LABEVENTS_ITEMID_5 for r in ten} == {2.0} and {r.DIAGNOSES_ICD_count for r in ten} == {2}
    assert {r.NOTEEVENTS_count for r in ten} == {1}
    twelve = next(r for r in rows if r.HADM_ID == 12)
    assert twelve.GENDER is None and twelve.LABEVENTS_ITEMID_5 is None
    without = assemble.assemble_clinical(spark, root, exclude=["NOTEEVENTS"])
    assert "NOTEEVENTS_count" not in without.columns
    paths = assemble.write_assembled(wide, f"{root}/out", ["HADM_ID", "ICUSTAY_ID"])
    assert spark.read.parquet(paths["combined"]).count() == 4
    assert spark.read.parquet(paths["columns"]).count() == len(wide.columns)


def test_required_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        assemble.assemble_clinical(spark, str(tmp_path))


def test_results_keep_their_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    paths = sinks.write_results({"a": df, "b": None}, str(tmp_path))
    assert len(paths) == 1 and spark.read.parquet(paths[0]).columns == ["k", "v"]


def sample_table(spark, n=160):
    rng = np.random.default_rng(7)
    a = rng.normal(size=n)
    a[0] = 40.0
    pdf = pd.DataFrame({"k": np.arange(n), "a": a, "b": a * 0.5 + rng.normal(size=n), "c": rng.choice(["x", "y", "z"], n)})
    return spark.createDataFrame(pdf)


def test_association_report(spark):
    out = reports.association_report(sample_table(spark).selectExpr("*", "upper(c) AS d"), ["k"])
    assert set(out) == {"pearson", "spearman", "kendall", "cramers_v", "theils_u", "anova", "kruskal", "skipped_columns"}
    assert out["cramers_v"].first().v == pytest.approx(1.0)


def test_anomaly_report_marks_the_far_row(spark):
    out = reports.anomaly_report(sample_table(spark), ["k"])
    for name in ("z_scores", "iqr_stats", "quantile_ranks", "mahalanobis_distance", "joint_distribution_stats"):
        assert out[name].count() > 0
    assert out["anomaly_scores"].count() == 160
    assert out["consensus"].where("k = 0").first().consensus_outlier == 1
    assert out["knn_distance"].orderBy("knn_distance", ascending=False).first().k == 0


def test_checkpoint_folder_comes_from_the_session(spark):
    df = session.cut_lineage(spark.range(5))
    assert df.count() == 5
    assert df.inputFiles()[0].replace("file://", "").startswith(session.scratch_root(spark).replace("file:", ""))


def test_quoted_csv(spark, tmp_path):
    """Line breaks, doubled quotes and commas inside quotes, read and converted like any CSV reader does."""
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "notes.csv").write_text('id,note,n\n1,"two\nlines",3\n2,"a ""word"", quoted",4\n3,plain,5\n')
    rows = readers.read_csv(spark, str(folder / "notes.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines", 3), (2, 'a "word", quoted', 4), (3, "plain", 5)]
    report = convert.convert_tables(spark, str(folder), str(tmp_path / "parquet")).first()
    assert (report.status, report.rows) == ("converted", 3)


def test_repeated_keys_raise(spark):
    from tabloom.operators import ranking

    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "k int, v double")
    for made in (lambda: ranking.quantile_ranks(df, ["k"], ["v"]), lambda: ranking.row_positions(df, "k")):
        with pytest.raises(Exception, match="more than one row|repeats a value"):
            made().collect()


def test_rule_names():
    import re

    from tabloom.operators import rules

    hits = lambda c: {r.name for r in rules.DEFAULT_RULES if re.search(r.pattern, rules.spaced(c), re.IGNORECASE)}
    assert "negative" in hits("patientAge") and "negative" in hits("ages") and "negative" in hits("labCounts") and "negative" in hits("AGE_count")
    assert not hits("percentage") and not hits("language") and "bmi_over_100" in hits("lastBMI")


def test_rows_without_partner_and_hot_keys(spark):
    from tabloom.operators import joins

    left = spark.createDataFrame([(None, 1), (7, 2), (8, 3)] + [(5, i) for i in range(10, 30)], "k int, a int")
    right = spark.createDataFrame([(None, 4), (8, 5), (9, 6)] + [(5, i) for i in range(3)], "k int, b int")
    got = sorted(map(tuple, joins.full_outer(left, right, ["k"]).collect()), key=str)
    want = sorted(map(tuple, left.join(right, "k", "full_outer").collect()), key=str)
    assert got == want


def test_missing_values_and_names(spark):
    df = spark.createDataFrame([(i, float("nan") if i == 3 else float(i), float(i * i), None) for i in range(8)], "k int, `a.b` double, c double, none double")
    from tabloom.operators import associate, profile

    z = profile.z_scores(df, ["a.b"], ["k"]).collect()
    assert sum(r[1] is None for r in z) == 1
    pairs = {(r.x, r.y): (r.r, r.n) for r in associate.corr_matrix(df.withColumnRenamed("a.b", "a"), ["a", "c", "none"], "spearman", ["k"]).collect()}
    assert pairs["a", "c"] == (1.0, 7) and pairs["a", "none"] == (None, 0)


def test_files_are_split_unless_a_field_holds_a_line_break(spark, tmp_path):
    from tabloom.sources import readers

    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text('k,v\n1,"a ""quoted"" word"\n2,b\n')
    broken.write_text('k,v\n1,"two\nlines"\n2,b\n')
    assert not readers.has_broken_fields(spark, str(plain)) and readers.has_broken_fields(spark, str(broken))
    assert [r.v for r in readers.read_table(spark, str(plain)).orderBy("k").collect()] == ['a "quoted" word', "b"]
    assert [r.v for r in readers.read_table(spark, str(broken)).orderBy("k").collect()] == ["two\nlines", "b"]
    both = readers.read_csv(spark, [str(plain), str(broken)], "k int, v string")
    assert sorted(r.v for r in both.collect()) == ['a "quoted" word', "b", "b", "two\nlines"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_with_line_breaks_in_fields_are_read_in_splits(spark, tmp_path, end):
    from tabloom.sources import records

    fields = ["plain", '"two' + end + 'lines"', '"a ""quoted""' + end + end + ' word, ""x"', '""', "", '"' + "long" * 40 + ("\n" * 40) + '"', '"lone\rreturn"', "späť", '""""', '"\n"']
    rng = np.random.default_rng(3)
    folder = tmp_path / "split.csv"
    folder.mkdir()
    for part in range(3):
        rows = [f"{i},{fields[rng.integers(len(fields))]},{i / 4},{fields[rng.integers(len(fields))]}" for i in range(part * 300, part * 300 + 300)]
        rows += [f'{part}000,"id,text,n,more",0,more', ""]
        (folder / f"{part}.csv").write_bytes(end.join(["id,text,,more", *rows, ""]).encode())
    whole = readers.read_csv(spark, str(folder), multiline=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = records.split_records(spark, [str(folder)])
        assert found[0] == "id,text,,more"
        split = readers.read_csv(spark, str(folder), whole_bytes=0)
        read_by_task = [f for f in split.inputFiles() if "split.csv" in f]
        assert not read_by_task and split.schema == whole.schema
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and whole.count() == 903
        typed = readers.read_csv(spark, f"{folder}/*.csv", "a long, b string, c double, d string", whole_bytes=0)
        assert sorted(r[0] for r in typed.collect()) == sorted(r[0] for r in whole.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    "text",
    ['k,v\n1,5" pipe\n2,"two\nlines"\n', 'k,v\n1,"a"b\n2,"two\nlines"\n', 'k,v\n1,"two\nlines"\n2,"open\n', 'k,v\n1,"two\nlines"\r\n2,b\n', '"k\nk",v\n1,"two\nlines"\n', 'k\n"two\nlines"\n \n3\n', 'k,v\r1,"two\nlines"\r2,b\r'],
)
def test_files_whose_quotes_do_not_tell_their_records_are_read_whole(spark, tmp_path, text):
    from tabloom.sources import records

    path = tmp_path / "odd.csv"
    path.write_bytes(text.encode())
    assert records.split_records(spark, [str(path)]) is None
    whole = spark.read.csv(str(path), header=True, quote='"', escape='"', multiLine=True, inferSchema=True)
    assert sorted(map(str, readers.read_csv(spark, str(path), whole_bytes=0).collect())) == sorted(map(str, whole.collect()))


def test_association_report_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(400).selectExpr("id", "id % 7 AS a", "IF(id % 5 > 0, id * 1.5, NULL) AS b", "CAST(id % 3 AS string) AS c", "CAST(id % 2 AS string) AS d")
    out = reports.association_report(rows.mapInArrow(counted, rows.schema), ["id"])
    for frame in out.values():
        frame.collect()
    assert read.value == 400
