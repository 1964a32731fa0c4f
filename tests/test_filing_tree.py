import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, StringContains

from quillstone.sources import filing_tree, filings

FILES = [
    ("AA", "10-K", "2020-01-02", "1", "a.htm", 5), ("AA", "10-K", "2020-01-02", "1", "b.HTML", 9), ("AA", "10-K", "2020-01-02", "1", "c.pdf", 90),
    ("AA", "10-K", "2021-01-02", "2", "z.pdf", 1), ("AA", "10-K", "2021-01-02", "2", "y.PDF", 3), ("AA", "8-K", "2020-05-05", "3", "x.htm", 2),
    ("AA", "8-K", "2020-05-05", "3", "w.htm", 2), ("bb", "10-K", "2019-12-31", "4_x", "m.html", 0), ("CC", "10-Q", "2020-02-02", "5", "notes.txt", 4),
    ("CC", "10-Q", "20200202", "6", "m.htm", 4), ("news", "10-K", "2020-01-02", "7", "m.htm", 4), ("É", "10-Q", "2020-03-03", "8", "m n%20.htm", 4),
]
NAMES = ["ticker", "filing_type", "date", "accession_number"]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    rows = spark.createDataFrame(FILES, "ticker string, filing_type string, date string, accession_number string, file string, n int")
    filing_tree.write_tree(rows.withColumn("content", F.expr("encode(repeat('x', n), 'UTF-8')")), root)
    (tmp_path_factory.getbasetemp() / root / "stray.htm").write_text("x")
    return root


def rows_of(df):
    return sorted((r.ticker, r.filing_type, r.date, r.accession_number, r.source_path.rsplit("/", 1)[1]) for r in df.collect())


WANTED = [
    ("AA", "10-K", "2020-01-02", "1", "b.HTML"), ("AA", "10-K", "2021-01-02", "2", "y.PDF"), ("AA", "8-K", "2020-05-05", "3", "w.htm"),
    ("BB", "10-K", "2019-12-31", "4_x", "m.html"), ("É", "10-Q", "2020-03-03", "8", "m n%20.htm"),
]


@pytest.mark.parametrize("group, slices", [(16, 1), (1, 3)])
def test_reads_one_row_a_filing(spark, tree, group, slices):
    found = filing_tree.read_tree(spark, tree, group, slices)
    assert rows_of(found) == WANTED
    assert found.agg(F.sum("length")).head()[0] == 9 + 3 + 2 + 0 + 4


def test_finds_what_the_walk_over_a_listing_finds(spark, tree):
    walked = filings.walk_filings(filings.list_files(spark, tree).where("path not like '%/news/%'"))
    # Spark's listing has no empty files; the tree has.
    assert rows_of(walked) == [r for r in WANTED if r[0] != "BB"]


def test_pushed_conditions_give_the_rows_that_spark_gives(spark, tree):
    conditions = ["ticker = 'AA'", "ticker in ('BB', 'É') and filing_type = '10-Q'", "date >= '2020-01-02' and date < '2021'", "filing_type <> '10-K'", "date like '2020%' or ticker = 'BB'", "ticker is null", "ticker <=> 'AA'", "accession_number = '8'"]
    plain = {c: rows_of(filing_tree.read_tree(spark, tree).where(c)) for c in conditions}
    spark.conf.set(filing_tree.PUSHDOWN, "true")
    try:
        assert plain == {c: rows_of(filing_tree.read_tree(spark, tree).where(c)) for c in conditions}
    finally:
        spark.conf.unset(filing_tree.PUSHDOWN)


def test_left_out_folders_are_never_listed(tree, monkeypatch):
    listed, real = [], filing_tree._entries
    monkeypatch.setattr(filing_tree, "_entries", lambda files, at, missing=True: listed.append(at[len(tree) :]) or real(files, at, missing))
    reader = filing_tree.FilteredTreeReader({"path": tree})
    other = StringContains(("accession_number",), "1")
    left = list(reader.pushFilters([In(("ticker",), ("AA", "CC")), EqualTo(("filing_type",), "10-K"), GreaterThanOrEqual(("date",), "2021"), IsNotNull(("date",)), other]))
    assert left == [other]
    assert [b.to_pydict()["accession_number"] for p in reader.partitions() for b in reader.read(p)] == [["2"]]
    assert sorted(listed) == ["", "/AA", "/AA/10-K", "/AA/10-K/2021-01-02_2", "/CC"]


def test_edges(spark, tmp_path):
    assert filing_tree.read_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFound|not found|No such"):
        filing_tree.read_tree(spark, str(tmp_path / "none")).count()
    bad = spark.createDataFrame([("..", "10-K", "2020-01-02", "1", "m.htm", b"x")], "ticker string, filing_type string, date string, accession_number string, file string, content binary")
    with pytest.raises(Exception, match="no name of a folder"):
        filing_tree.write_tree(bad, str(tmp_path))


def test_a_few_filings_lie_on_disk_at_a_time(spark, tmp_path, monkeypatch):
    kept, real = [], filing_tree.read_tree

    def read(spark, root, **options):
        kept.append(len([p for p in tmp_path.glob("t/tree-*/*/*/*") if p.is_dir()]))
        return real(spark, root, **options)

    monkeypatch.setattr(filing_tree, "read_tree", read)
    rows = spark.range(200).selectExpr("concat('T', id % 40) as ticker", "if(id % 2 = 0, '10-K', '8-K') as filing_type", "concat('20', 10 + id % 7, '-01-01') as date", "string(id) as accession_number", "'a.htm' as file", "encode('x', 'UTF-8') as content")
    found = filing_tree.through_trees(rows, f"{tmp_path}/t", "filing_type = '10-K'", filings=50)
    assert sorted(int(r.accession_number) for r in found.collect()) == list(range(0, 200, 2))
    assert len(kept) == 4 and sum(kept) == 200 and max(kept) < 120 and not list(tmp_path.glob("t/tree-*"))


def test_rounds_beside_each_other_are_as_many_times_smaller(spark, tmp_path, monkeypatch):
    trees, filings_, real = [], [], filing_tree.read_tree

    def read(spark, root, **options):
        trees.append(len(list(tmp_path.glob("t/tree-*"))))
        filings_.append(len(list((tmp_path / "t" / root.rsplit("/", 1)[1]).glob("*/*/*"))))
        return real(spark, root, **options)

    monkeypatch.setattr(filing_tree, "read_tree", read)
    rows = spark.range(400).selectExpr("concat('T', id % 80) as ticker", "if(id % 2 = 0, '10-K', '8-K') as filing_type", "concat('20', 10 + id % 7, '-01-01') as date", "string(id div 2) as accession_number", "'a.htm' as file", "encode('x', 'UTF-8') as content")
    rows = rows.union(rows.withColumn("file", F.lit("a.pdf")))
    found = filing_tree.through_trees(rows, f"{tmp_path}/t", "filing_type = '10-K'", filings=200, at_once=2)
    assert sorted((int(r.accession_number), r.source_path.rsplit("/", 1)[1]) for r in found.collect()) == [(k, "a.htm") for k in range(200)]
    assert len(trees) == 4 and max(trees) <= 2 and sum(filings_) == 400 and not list(tmp_path.glob("t/tree-*"))
    with pytest.raises(Exception, match="no name of a folder"):
        filing_tree.through_trees(rows.withColumn("file", F.lit("a/b")), f"{tmp_path}/u", "true", filings=200, at_once=2)
