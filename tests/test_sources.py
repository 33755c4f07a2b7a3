"""CSV catalogues, imports, free SQL and exports."""

import os
import random
import tempfile

import pytest
from pyspark.sql import Observation

from shelfscope.functions.text import title_category  # noqa: F401
from shelfscope.operators import imports
from shelfscope.plans import analysis
from shelfscope.sources import catalog, sinks, tables
from shelfscope.sources.csv_records import Assembler, Lines
from shelfscope.views import view

HEADER = (
    "title,category,discounted_price,actual_price,discount_percentage,rating,rating_count,about_product,"
    "user_id,user_name,review_id,review_title,review_content,img_link,product_link"
)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write(folder, *lines, header=HEADER):
    path = os.path.join(folder, "products.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join((header, *lines)) + "\n")
    return path


def test_dialect(spark, folder):
    path = write(
        folder,
        'plain,c1,1.5,2,10,4.567,12.5,a,u,n,r1,t,"one, ""two""",i,p',
        "short,c2,1,2,3,4",
        'empty,"",1,2,3,4,5,a,u,n,r3,t,x,i,p',
        "missing,,1,2,3,4,5,a,u,n,r4,t,x,i,p",
        "bad,c1,1,2,3,n/a,5,a,u,n,r5,t,x,i,p",
        "long,c1,1,2,3,4,5,a,u,n,r6,t,x,i,p,extra,more",
        "zero,c1,1,2,3,0,5,a,u,n,r7,t,x,i,p",
        "norating,c1,1,2,3,,5,a,u,n,r8,t,x,i,p",
        "huge,c1,1,2,3,12.5,5,a,u,n,r9,t,x,i,p",
    )
    scanned = {r["title"]: r for r in catalog.csv_scan(spark, path).collect()}
    assert scanned["plain"]["review_content"] == 'one, "two"'
    assert scanned["short"]["rating_count"] is None
    assert scanned["empty"]["category"] == "" and scanned["missing"]["category"] is None
    assert scanned["long"]["product_link"] == "p"
    rows = catalog.typed(catalog.csv_scan(spark, path))
    counts = catalog.load_counts(rows).first()
    assert tuple(counts) == (9, 2, 4)
    loaded = {r["title"]: r for r in catalog.load_catalog(spark, path).collect()}
    assert set(loaded) == {"plain", "short", "empty", "long"}
    assert str(loaded["plain"]["rating"]) == "4.57" and loaded["plain"]["rating_count"] == 13
    assert sorted(r["id"] for r in loaded.values()) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="bad rating"):
        catalog.typed(catalog.csv_scan(spark, path), strict=True).collect()


def test_aliases_and_column_order(spark, folder):
    path = write(folder, "4.5,Lamp,home", header="stars,name,category")
    df = catalog.csv_scan(spark, path, aliases={"stars": "rating", "name": "title"})
    row = df.first()
    assert (row["title"], row["category"], row["rating"], row["user_id"]) == ("Lamp", "home", "4.5", None)
    with pytest.raises(ValueError):
        catalog.csv_scan(spark, path)


def test_quoted_line_break(spark, folder):
    path = write(folder, '"two\nlines",c,1,2,3,4,5,a,u,n,r,t,x,i,p')
    assert catalog.csv_scan(spark, path, multi_line=True).first()["title"] == "two\nlines"


def test_load_replaces_target(spark, folder):
    path = write(folder, "a,c,1,2,3,4,5,a,u,n,r,t,x,i,p", "b,c,1,2,3,5,5,a,u,n,r,t,x,i,p")
    target = os.path.join(folder, "catalog")
    validation, loaded = analysis.load_checked(spark, path, target)
    assert validation.first()["dataset_size"] == 2 and loaded.count() == 2
    catalog.load_catalog(spark, path, target)
    assert spark.read.parquet(target).count() == 2


def test_whole_run_writes_its_files(spark, folder):
    path = write(folder, *[f"t{i},c{i % 3},1,2,3,{1 + i % 4}.5,5,a,u,n,r,t,x,i,p" for i in range(30)])
    written = analysis.run(spark, path, os.path.join(folder, "out"), "2024-01-31")
    assert spark.read.option("header", True).csv(written["category_stats"]).count() == 3
    lines = [r[0] for r in spark.read.text(written["category_report"]).collect()]
    assert lines[1].endswith("CATEGORY ANALYSIS REPORT") and lines[-2] == "End of Report"
    assert any(line.startswith("c0 ") for line in lines)
    metrics = spark.read.json(written["run_metrics"]).first()
    assert (metrics["read"], metrics["rejected"], metrics["kept"], metrics["run_ts"]) == (30, 0, 30, "2024-01-31")
    assert metrics["seconds"] >= metrics["block_seconds"]["category_stats"] > 0


def test_import_and_replace(spark):
    rows = [(i, f"ssd {i}", "b", 19.99, 4.35, i, "d", f"u{i}") for i in range(50)]
    products = spark.createDataFrame(
        rows, "id long, title string, brand string, price double, rating double, review_count int, description string, url string"
    ).selectExpr("*", "timestamp_ntz '2024-01-02 03:04:05' as scraped_at", "timestamp_ntz '2024-01-02 03:04:05' as created_at")
    held = imports.import_products(products)
    row = held.filter("id = 1").first()
    assert row["category"] == "Storage" and str(row["price"]) == "19.99" and str(row["rating"]) == "4.35"
    newer = held.filter("id < 5").withColumn("id", held.id + 48)
    replaced = {r["id"]: r["title"] for r in imports.replace_by_id(held, newer).collect()}
    assert len(replaced) == 53 and replaced[48] == "ssd 0" and replaced[47] == "ssd 47"


def test_a_field_beyond_a_megabyte(spark, folder):
    text = "word " * 300_000
    path = write(folder, f"a,c,1,2,3,4,5,{text},u,n,r,t,x,i,p")
    assert catalog.load_catalog(spark, path).first()["about_product"] == text


def test_unpaired_quotes_are_counted(spark, folder):
    path = write(
        folder, 'two,c,1,2,3,4,5,"in\ntwo",u,n,r,t,x,i,p', "a,c,1,2,3,4,5,a,u,n,r,t,x,i,p", "short,c,1,2,3,4",
        'b,c,1,2,3,4,5,"q ""x"" y",u,n,r,t,x,i,p',
    )
    counts = Observation("load")
    loaded = catalog.load_catalog(spark, path, order_by=["title"], counts=counts)
    assert [r["title"] for r in loaded.orderBy("id").collect()] == ["a", "b", "short"]
    assert counts.get == {"read": 5, "rejected": 2, "kept": 3}
    with pytest.raises(Exception, match="unpaired quote"):
        catalog.load_catalog(spark, path, strict=True)


def test_files_with_another_header_fail(spark, folder):
    write(folder, "a,c,1,2,3,4,5,a,u,n,r,t,x,i,p")
    with open(os.path.join(folder, "other.csv"), "w") as f:
        f.write("category,title," + HEADER.split(",", 2)[2] + "\nc,b,1,2,3,4,5,a,u,n,r,t,x,i,p\n")
    with pytest.raises(Exception, match="header"):
        catalog.csv_scan(spark, folder).collect()


def test_free_sql_and_description(spark):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    assert tables.custom_sql(spark, {"things": df}, "select count(*) as n from things").first()["n"] == 1
    assert not spark.catalog.tableExists("things")
    assert sorted(tuple(r) for r in tables.table_info(df).collect()) == [
        ("k", "int", 1, 1, "1", "1"), ("s", "string", 1, 1, "a", "a"),
    ]


def test_text_sink_keeps_order(spark, folder):
    lines = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "line_no int, text string")
    path = os.path.join(folder, "report")
    sinks.write_text(lines, path, ("line_no",))
    assert [r[0] for r in spark.read.text(path).collect()] == ["a", "b", "c"]


BREAKS = (
    'one,c1,1,2,3,4,5,a,u,n,r1,t,"two\nlines",i,p',
    'two,c1,1,2,3,4,5,"a ""quoted""\n\n""word""",u,n,r2,t,"é\r\n""\n""",i,p',
    "three,c1,1,2,3,4,5,a,u,n,r3,t,x,i,p",
    '"four\n",c1,1,2,3,4,5,a,u,n,r4,t,"' + "long\n" * 9 + '",i,p\r',
    "",
    'five,c1,1,2,3,4,5,a,u,n,r5,t,"",i,p',
)


def test_ranges_cut_at_every_byte():
    """The pieces of two ranges, for every place where a file may be cut."""
    text = "\n".join(BREAKS)
    lines = text.split("\n")
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    whole = [t for _, t in _assembled(lines, False)]
    for cut in range(len(text) + 1):
        k = sum(s < cut for s in starts)  # a line belongs to the range it begins in
        left = _assembled(lines[:k], False)
        right = _assembled(lines[k:], "\n".join(lines[:k]).count('"') % 2 == 1)
        kinds = [x for x, _ in left + right]
        assert set(kinds) <= {"record", "tail", "head"} and kinds.count("tail") == kinds.count("head")
        out = []
        for kind, t in left + right:
            if kind == "head":
                out[-1] += "\n" + t
            else:
                out.append(t)
        assert out == whole, cut


def _assembled(lines, is_open):
    work = Assembler(is_open)
    return [x for line in lines for x in work.add(line)] + list(work.end())


@pytest.mark.parametrize("size", [9, 150])
def test_records_over_many_ranges(spark, folder, size):
    """Records over several ranges; two files in one folder."""
    import csv

    path = write(folder, *BREAKS)
    with open(path, encoding="utf-8", newline="") as f:
        text = f.read()
    with open(os.path.join(folder, "more.csv"), "w", encoding="utf-8", newline="") as f:
        f.write(text.replace("r1", "s1").rstrip("\n"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in zip(names, (str(size), "0", "1")):
            spark.conf.set(k, v)
        rows = catalog.csv_scan(spark, folder, multi_line=True, with_broken=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = [r for r in csv.reader(text.splitlines(keepends=True))][1:]
    # the reader here splits at "\n" alone and drops the "\r" of a record's end
    want = [dict(zip(HEADER.split(","), r)) for r in want if r]
    assert len(rows) == 2 * len(want) == 10 and not any(r["broken"] for r in rows)
    got = sorted((r["review_id"], r["title"], r["about_product"], r["review_content"], r["product_link"]) for r in rows)
    expected = [
        (k, w["title"], w["about_product"], w["review_content"], "p")
        for w in want for k in (w["review_id"], w["review_id"].replace("r1", "s1"))
    ]
    assert got == sorted(expected)


def test_records_are_not_stored(spark, sf_dir, folder):
    """What a record reader and its query leave on disk: the packed catalogue, no copy of it."""
    import __spark_entry__
    from shelfscope.session import shared_folder

    root = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(root))
    assert catalog.csv_scan(spark, write(folder, *BREAKS), multi_line=True).count() == 5
    rows = __spark_entry__.queries()["csv_line_breaks"](spark, sf_dir)
    assert rows.count() == view(spark, sf_dir, "amazon_products").count()
    left = set(os.listdir(root)) - before
    written = [x for x in left if not x.startswith("rdd-")]
    assert len(written) == 1 and written[0].startswith("breaks-csv-")
    files = [f for f in os.listdir(os.path.join(root, written[0])) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)


@pytest.mark.parametrize("size", [3, 40])
def test_records_over_range_ends_as_from_whole_files(spark, folder, size):
    """Random files cut into small ranges give the records that the whole files give."""
    from shelfscope.sources import csv_records

    rng, want = random.Random(size), []
    for k in range(4):
        lines = ["".join(rng.choice(['"', '"', "a", ",", " ", "\r", "é"]) for _ in range(rng.randrange(7))) for _ in range(60)]
        lines += ["x" * 90, '"' + "y" * 90, "z" * 90, 'z"'][: k + 1]
        found = _assembled(lines, False)
        want += [(t.removesuffix("\r"), kind != "record") for kind, t in found if kind != "record" or t.strip()]
        with open(os.path.join(folder, f"{k}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write("\n".join(["h", *lines]) + "\n" * (k % 2))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in zip(names, (str(size), "0", "1")):
            spark.conf.set(k, v)
        got = csv_records.records(spark, folder, ["h"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted(want) and any(u for _, u in want)


def test_unfinished_records_and_other_headers(spark, folder):
    path = write(folder, *BREAKS[:2], 'last,c1,1,2,3,4,5,a,u,n,r9,t,"never\nclosed')
    rows = {r["title"]: r["broken"] for r in catalog.csv_scan(spark, path, multi_line=True, with_broken=True).collect()}
    assert rows == {"one": False, "two": False, "last": True}
    with open(os.path.join(folder, "z.csv"), "w") as f:
        f.write(HEADER.replace("title", "name") + "\n")
    with pytest.raises(Exception, match="another header"):
        catalog.csv_scan(spark, folder, multi_line=True).collect()
    empty = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    assert catalog.csv_scan(spark, write(empty), multi_line=True).count() == 0


@pytest.mark.parametrize("is_open", [False, True])
def test_lines_as_arrays(is_open):
    """Arrays of lines, cut anywhere, give what the lines give one by one."""
    import pyarrow as pa

    rng = random.Random(5)
    for n in (1, 2, 5, 40):
        for _ in range(30):
            lines = ["".join(rng.choice(['"', "a", " ", "\r", "é"]) for _ in range(rng.randrange(4))) for _ in range(n)]
            one, many = Assembler(is_open), Lines(is_open)
            want = [x for line in lines for x in one.add(line)] + list(one.end())
            got, at = [], 0
            while at < n:
                to = at + rng.randrange(1, n + 1)
                kinds, texts = many.add(pa.array(lines[at:to], pa.string()))
                got += zip(kinds, texts.to_pylist())
                at = to
            kinds, texts = many.end()
            got += zip(kinds, texts.to_pylist())
            assert got == want, lines


def test_packed_catalogue(spark, folder, monkeypatch):
    """Compressed files are not split, so their rows are bounded; they hold the same catalogue."""
    path = write(folder, *BREAKS)
    rows = catalog.csv_scan(spark, path, multi_line=True)
    monkeypatch.setitem(catalog.PACKED, "maxRecordsPerFile", 2)
    catalog.write_csv(rows, f"{folder}/plain")
    catalog.write_csv(rows.coalesce(1), f"{folder}/packed", packed=True)
    files = [f for f in os.listdir(f"{folder}/packed") if f.startswith("part-")]
    assert len(files) == 3 and all(f.endswith(".gz") for f in files)
    plain, packed = (catalog.csv_scan(spark, f"{folder}/{x}", multi_line=True) for x in ("plain", "packed"))
    assert sorted(map(str, packed.collect())) == sorted(map(str, plain.collect()))
    assert packed.count() == rows.count() == 5
