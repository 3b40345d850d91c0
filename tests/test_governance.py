"""Value edits under constraints."""

from seriesforge.operators import structure


def test_status_of_each_edit_alone(spark):
    values = [1.0] * 6 + [float(i) for i in range(6)]
    points = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)] + [(2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0), (2, 3, 0.0)], "series_id long, t int, value double")
    segments = spark.createDataFrame([(1, 0, 0, 5, "plateau"), (1, 1, 6, 11, "trend"), (2, 0, 0, 2, "plateau"), (2, 1, 3, 3, "event")],
                                     "series_id long, segment_id int, start_index int, end_index int, label string")
    edits = spark.createDataFrame([(1, 0, "shift_level", {"delta": 5.0}), (1, 1, "change_slope", {"slope_delta": -1.0}), (1, 0, "change_slope", {"slope_delta": 1.0}), (1, 9, "shift_level", {"delta": 1.0}),
                                   (2, 0, "shift_level", {"delta": 1.0})], "series_id long, segment_id int, op_name string, params map<string,double>")

    def run(mode):
        rows = structure.govern_value_edits(points, segments, edits, mode).collect()
        return {(r.series_id, r.segment_id, r.op_name): (r.reason_code, r.status, r.n_violations, r.applied, r.edited) for r in rows}
    got = run(None)
    assert got[1, 0, "shift_level"] == ("PASS", "PASS", 0, True, [6.0] * 6)
    assert got[1, 1, "change_slope"][:4] == ("WARN", "WARN", 1, True) and got[1, 1, "change_slope"][4] == [2.5] * 6
    assert got[1, 0, "change_slope"][:4] == ("OPERATION_NOT_ALLOWED", None, None, False)
    assert got[1, 9, "shift_level"][0] == "UNKNOWN_SEGMENT" and not got[1, 9, "shift_level"][3]
    assert got[2, 0, "shift_level"] == ("CONSTRAINT_FAIL", "FAIL", 1, False, [1.0] * 3)      # its neighbour is too short
    strict = run("hard")
    assert strict[1, 1, "change_slope"] == ("CONSTRAINT_FAIL", "FAIL", 1, False, [float(i) for i in range(6)])
    assert run("soft")[2, 0, "shift_level"][:2] == ("WARN", "WARN")
