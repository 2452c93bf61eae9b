"""Table operators on small grids."""

from pyspark.sql import functions as F

from veldspar.operators import tables


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


ROW, GRID = "array<string>", "array<array<string>>"


def test_forward_fill(spark):
    assert one(spark, [None, " a ", "", None, "b", " "], ROW, tables.forward_fill) == ["", "a", "a", "a", "b", "b"]
    assert one(spark, [], ROW, tables.forward_fill) == []


def test_header(spark):
    assert one(spark, ["a", None, "b", " "], ROW, tables.is_header) is True
    assert one(spark, ["a", None, " "], ROW, tables.is_header) is False
    assert one(spark, [], ROW, tables.is_header) is True
    assert one(spark, [], ROW, lambda c: tables.is_header(c, empty=False)) is False


def test_header_rows(spark):
    assert one(spark, [["a", "b"], ["c", ""], ["d", "e"], ["f", "g"]], GRID, tables.header_rows) == 3
    assert one(spark, [["a", "b"], ["", ""], ["d", "e"]], GRID, tables.header_rows) == 1
    assert one(spark, [["", ""], ["d", "e"]], GRID, tables.header_rows) == 1


def test_merge_headers(spark):
    assert one(spark, [["a", None, " "], ["b", "c"]], GRID, tables.merge_headers) == ["a b", "c", ""]
    assert one(spark, [[" ", "x"], ["b", "y"]], GRID, lambda r: tables.merge_headers(r, keep_blank=False)) == ["b", "x y"]


def test_table_rows(spark):
    paged = [["k", "", "v"], ["1", None, "x\ny"], ["2", "q"], [None, None, None], ["3", "None", "z"]]
    assert one(spark, paged, GRID, lambda g: tables.table_rows(g, True, False)) == ["k 1 2: 3, q: None, v x\ny: z"]
    plain = [["k", "", "v"], ["1", "b", ""], ["2", "q"], ["", "", ""], ["3", "None", "z"]]
    assert one(spark, plain, GRID, lambda g: tables.table_rows(g, False, False)) == ["k: 1, k: b", "k: 3, k: None, v: z"]
    assert one(spark, plain, GRID, lambda g: tables.table_rows(g, False, True)) == ["k: 1, k: b", "k: 3, v: z"]
    assert one(spark, [["only"]], GRID, lambda g: tables.table_rows(g, True, False)) == []


def test_assembled(spark):
    assert one(spark, ["r1", "r2"], ROW, lambda r: tables.assembled(F.lit(" t "), r)) == "t; r1; r2"
    assert one(spark, [], ROW, lambda r: tables.assembled(F.lit(" t "), r)) == "t"
    assert one(spark, ["r"], ROW, lambda r: tables.assembled(F.lit("t"), r, ".")) == "t; r."
