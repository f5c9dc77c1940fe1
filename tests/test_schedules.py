"""Parts of a schedule join up; other widths stay out; conflicts are counted."""

from planline.operators import schedules as H


def cells(spark, tables):
    rows = [("d", t, r, c, text) for t, grid in enumerate(tables) for r, row in enumerate(grid) for c, text in enumerate(row)]
    return spark.createDataFrame(rows, "drawing_id string, table long, row long, column long, text string")


def test_parts_join_up_and_other_tables_stay_out(spark):
    tables = [[["PLOT", "AREA"], ["1", "1,250.5"]], [["a", "b", "c"], ["1", "2", "3"]], [["2", "300"], ["3", "n/a"], ["1", "9"], [" ", "5"]]]
    merged = H.merged_grids(cells(spark, tables))
    assert sorted((r.place, r.column, r.text) for r in merged.collect() if r.column == 0) == [(0, 0, "PLOT"), (1, 0, "1"), (2, 0, "2"), (3, 0, "3"), (4, 0, "1"), (5, 0, " ")]
    got = {(r.item, r.value, r.place, r.times) for r in H.schedule(merged).collect()}
    assert got == {("1", 1250.5, 1, 2), ("2", 300.0, 2, 1)}


def test_ties_nothing_and_one_column(spark):
    two = H.merged_grids(cells(spark, [[["x", "1", "2"]], [["y", "3"]]]))
    assert {r.text for r in two.collect()} == {"x", "1", "2"} and [(r.item, r.value) for r in H.schedule(two).collect()] == [("x", 1.0)]
    assert H.schedule(H.merged_grids(cells(spark, [[["only"]]]))).count() == 0
    assert H.schedule(H.merged_grids(cells(spark, [[["x", "1"]]]).limit(0))).count() == 0
