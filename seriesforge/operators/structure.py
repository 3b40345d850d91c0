"""Structural edits of segmentations.

A request names a segment; its neighbours come from the two-level neighbour
lookup, so all requests of a fleet are decided in one plan.  Rejected requests
keep their row with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from . import chunks as K
from .layout import neighbours

NEIGHBOUR = ["segment_id", "start_index", "end_index", "label", "confidence"]


def with_neighbours(segments: DataFrame) -> DataFrame:
    s = segments if "confidence" in segments.columns else segments.withColumn("confidence", F.lit(None).cast("double"))
    return neighbours(neighbours(s, "start_index", NEIGHBOUR), "start_index", NEIGHBOUR, back=False)


def move_ends(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Move both ends of a segment; neighbours follow.  ``edits``: series_id, segment_id, delta_b, delta_e.

    One edit per series version is expected.  Gives the edited segmentation rows
    with ``reject`` filled where the request is refused (then bounds stay).
    """
    e = with_neighbours(segments).join(edits, ["series_id", "segment_id"])
    b, n = F.col("start_index") + F.col("delta_b"), F.col("end_index") + F.col("delta_e")
    length = lambda lo, hi: hi - lo + 1
    has_l, has_r = F.col("prev_segment_id").isNotNull(), F.col("next_segment_id").isNotNull()
    short = lambda lo, hi, lab: length(lo, hi) < C.min_length(lab)
    reject = (F.when(b < 0, "negative_start").when(b > n, "inverted")
              .when(short(b, n, F.col("label")), "too_short")
              .when(has_l & short(F.col("prev_start_index"), b - 1, F.col("prev_label")), "left_too_short")
              .when(has_r & short(n + 1, F.col("next_end_index"), F.col("next_label")), "right_too_short"))
    e = e.withColumns({"_b": b, "_e": n, "reject": reject})
    own = e.select("series_id", "segment_id", F.col("_b").alias("new_start"), F.col("_e").alias("new_end"), "reject", F.lit(0).alias("role"))
    left = e.where(has_l).select("series_id", F.col("prev_segment_id").alias("segment_id"), F.col("prev_start_index").alias("new_start"),
                                 (F.col("_b") - 1).alias("new_end"), "reject", F.lit(-1).alias("role"))
    right = e.where(has_r).select("series_id", F.col("next_segment_id").alias("segment_id"), (F.col("_e") + 1).alias("new_start"),
                                  F.col("next_end_index").alias("new_end"), "reject", F.lit(1).alias("role"))
    change = own.unionByName(left).unionByName(right)
    j = segments.join(change, ["series_id", "segment_id"], "left")
    ok = F.col("role").isNotNull() & F.col("reject").isNull()
    return j.select("series_id", "segment_id", F.when(ok, F.col("new_start")).otherwise(F.col("start_index")).cast("int").alias("start_index"),
                    F.when(ok, F.col("new_end")).otherwise(F.col("end_index")).cast("int").alias("end_index"), "label",
                    ok.alias("decomposition_dirty"), "reject")


def split_segments(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Split at t_star strictly inside; halves get ids -a and -b; refused requests keep one row and a reason."""
    e = segments.join(edits.select("series_id", "segment_id", "t_star"), ["series_id", "segment_id"], "left")
    t, lo, hi, m = F.col("t_star"), F.col("start_index"), F.col("end_index"), C.min_length(F.col("label"))
    reject = (F.when(t.isNull(), None).when(~((lo < t) & (t < hi)), "not_inside").when(t - lo + 1 < m, "left_too_short")
              .when(hi - t < m, "right_too_short"))
    sid = F.col("segment_id").cast("string")
    part = lambda i, a, b, d: F.struct(i.alias("segment_id"), a.cast("int").alias("start_index"), b.cast("int").alias("end_index"), F.lit(d).alias("decomposition_dirty"))
    whole = F.array(part(sid, lo, hi, False))
    both = F.array(part(F.concat(sid, F.lit("-a")), lo, t, True), part(F.concat(sid, F.lit("-b")), t + 1, hi, True))
    x = e.withColumns({"reject": reject}).withColumn("_p", F.explode(F.when(t.isNotNull() & F.col("reject").isNull(), both).otherwise(whole)))
    return x.select("series_id", "_p.*", "label", "reject")


def merge_segments(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Merged rows of the requests (series_id, segment_id): the segment and its right neighbour, id a+b.

    The new label comes from re-classifying the merged points; without a right
    neighbour the request is refused.
    """
    e = with_neighbours(segments).join(edits.select("series_id", "segment_id"), ["series_id", "segment_id"])
    return e.select("series_id", F.col("segment_id"), F.concat_ws("+", "segment_id", "next_segment_id").alias("merged_id"), "start_index",
                    F.col("next_end_index").alias("end_index"), F.col("label").alias("old_label"),
                    F.when(F.col("next_segment_id").isNull(), "no_right_neighbour").alias("reject"))


def governed(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Decision on each governed request.

    ``requests``: series_id, segment_id, op_name (edit_boundary, split, merge, reclassify), position, other_id,
    new_label.  Gives reason_code before constraints: LEGAL or why it is denied; and the candidate bounds.
    """
    e = with_neighbours(segments).join(requests, ["series_id", "segment_id"])
    op, lab, nl = F.col("op_name"), F.col("label"), F.col("next_label")
    adjacent = F.col("other_id").eqNullSafe(F.col("next_segment_id"))
    d = F.col("position") - F.col("end_index")
    left, right = K.boundary_legality(lab, d), K.boundary_legality(nl, -d)
    boundary = (F.when(~adjacent | F.col("next_segment_id").isNull(), "NON_ADJACENT_SEGMENTS").when(d == 0, "NO_OP")
                .when(left != "LEGAL", left).otherwise(right))
    split_ok = C.legality_reason(lab, F.lit("split"))
    split = (F.when(split_ok != "LEGAL", split_ok)
             .when(~((F.col("start_index") <= F.col("position")) & (F.col("position") < F.col("end_index"))), "INVALID_SPLIT_POINT")
             .otherwise("LEGAL"))
    merge = (F.when(~adjacent | F.col("next_segment_id").isNull(), "NON_ADJACENT_SEGMENTS").when(lab != nl, "INCOMPATIBLE_SEGMENTS")
             .otherwise(C.legality_reason(lab, F.lit("merge"))))
    again = (F.when(~F.col("new_label").isin(*C.CHUNK_TYPES), "UNKNOWN_TARGET_LABEL").when(F.col("new_label") == lab, "NO_OP").otherwise("LEGAL"))
    reason = F.when(op == "edit_boundary", boundary).when(op == "split", split).when(op == "merge", merge).when(op == "reclassify", again)
    # The minimum duration is the only hard constraint the four operations can newly break.
    m = C.LIMITS["minimum"]
    p, lo, hi, ne = F.col("position"), F.col("start_index"), F.col("end_index"), F.col("next_end_index")
    short = (F.when(op == "edit_boundary", (p - lo + 1 < m) | (ne - p < m)).when(op == "split", (p - lo + 1 < m) | (hi - p < m))
             .otherwise(F.lit(False)))
    code = F.when(reason != "LEGAL", reason).when(short, "CONSTRAINT_FAIL").otherwise("LEGAL")
    conf = F.when(op == "merge", F.coalesce((F.col("confidence") + F.col("next_confidence")) / 2, "confidence", "next_confidence")).otherwise(F.col("confidence"))
    return e.select("series_id", "segment_id", "op_name", "label", code.alias("reason_code"), (code == "LEGAL").alias("applied"),
                    F.when(op == "reclassify", F.col("new_label")).otherwise(lab).alias("result_label"), conf.alias("result_confidence"))


def apply_governed(segments: DataFrame, decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Next segmentation after the applied governed requests (at most one per series)."""
    d = decisions.where("applied").join(requests, ["series_id", "segment_id", "op_name"]).select(
        "series_id", "op_name", F.col("segment_id").alias("_s"), "position", "other_id", "new_label", F.col("result_confidence").alias("_c"))
    j = segments.withColumn("segment_id", F.col("segment_id").cast("string")).join(
        d.withColumn("_s", F.col("_s").cast("string")).withColumn("other_id", F.col("other_id").cast("string")), "series_id", "left")
    hit, other = F.col("segment_id") == F.col("_s"), F.col("segment_id") == F.col("other_id")
    op, p = F.col("op_name"), F.col("position")
    row = lambda i, a, b, l: F.struct(i.alias("segment_id"), a.cast("int").alias("start_index"), b.cast("int").alias("end_index"), l.alias("label"))
    sid, lo, hi, lab = F.col("segment_id"), F.col("start_index"), F.col("end_index"), F.col("label")
    none = F.array().cast("array<struct<segment_id:string,start_index:int,end_index:int,label:string>>")
    ends = segments.select("series_id", F.col("segment_id").cast("string").alias("other_id"), F.col("end_index").alias("_oe"))
    j = j.join(ends, ["series_id", "other_id"], "left")
    rows = (F.when((op == "edit_boundary") & hit, F.array(row(sid, lo, p, lab)))
            .when((op == "edit_boundary") & other, F.array(row(sid, p + 1, hi, lab)))
            .when((op == "split") & hit, F.array(row(F.concat(sid, F.lit("-a")), lo, p, lab), row(F.concat(sid, F.lit("-b")), p + 1, hi, lab)))
            .when((op == "merge") & hit, F.array(row(sid, lo, F.col("_oe"), lab))).when((op == "merge") & other, none)
            .when((op == "reclassify") & hit, F.array(row(sid, lo, hi, F.col("new_label")))).otherwise(F.array(row(sid, lo, hi, lab))))
    return j.select("series_id", F.explode(rows).alias("_r")).select("series_id", "_r.*")


def append_version(versions: DataFrame, next_segments: DataFrame, action: str) -> DataFrame:
    """Rows of the next version per series, with the transition check against the last version.

    ``versions``: series_id, version, start_index, end_index, ...; a transition must keep the covered range.
    """
    last = versions.groupBy("series_id").agg(F.max("version").alias("version"))
    cur = versions.join(last, ["series_id", "version"])
    cover = lambda d, a, b: d.groupBy("series_id").agg(F.min("start_index").alias(a), F.max("end_index").alias(b))
    c = cover(cur, "_a", "_b").join(cover(next_segments, "_c", "_d"), "series_id").join(last, "series_id")
    ok = (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d"))
    return c.select("series_id", F.col("version").alias("before_version"), (F.col("version") + 1).alias("after_version"),
                    F.lit(action).alias("action_type"), ok.alias("valid"))


def value_edit_reason(label, op, params) -> "F.Column":
    """Reason code of a governed value edit: label and legality, then non-trivial parameters."""
    need = C.lookup({o: l for o, (l, _) in C.VALUE_OPERATIONS.items()}, op)
    name = C.lookup({o: n for o, (_, n) in C.VALUE_OPERATIONS.items()}, op)
    p = lambda k, d: F.coalesce(F.try_element_at(params, F.lit(k)), F.lit(float(d)))
    noop = (((op == "shift_level") & (p("delta", 0) == 0)) | ((op == "change_slope") & (p("slope_delta", 0) == 0))
            | ((op == "scale_spike") & ((p("scale_factor", 1) == 1) | (p("scale_factor", 1) < 0)))
            | ((op == "shift_event") & (p("offset", 0).cast("int") == 0)))
    return (F.when(need.isNull(), "UNSUPPORTED_OPERATION").when((label != need) | ~C.is_legal(label, name), "OPERATION_NOT_ALLOWED")
            .when(noop, "INVALID_PARAMETERS").otherwise("LEGAL"))


def apply_value_edits(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """Governed value edits: six operations in one CASE; refused rows keep their values and a reason code.

    An edit of a segment that does not exist stays as a row with ``UNKNOWN_SEGMENT`` and no values.
    """
    from . import edits as E
    j = frames.join(edits, ["series_id", "segment_id"], "right")
    p = lambda k, d: F.coalesce(F.try_element_at("params", F.lit(k)), F.lit(float(d)))
    v, op = F.col("v"), F.col("op_name")
    left, right = F.when(F.size("pre") > 0, F.element_at("pre", -1)), F.get("post", F.lit(0))
    new = (F.when(op == "shift_level", E.shift_level(v, p("delta", 0))).when(op == "change_slope", E.add_ramp(v, p("slope_delta", 0)))
           .when(op == "scale_spike", E.scale_about_mean(v, p("scale_factor", 1))).when(op == "suppress_spike", E.scale_about_mean(v, F.lit(0.0)))
           .when(op == "shift_event", E.shift_hold(v, p("offset", 0).cast("int"))).when(op == "remove_event", E.bridge(v, left, right)))
    reason = value_edit_reason(F.col("label"), op, F.col("params"))
    whole = F.when((op == "remove_event") & (reason == "LEGAL") & (F.size("pre") + F.size("post") == 0), "INVALID_PARAMETERS").otherwise(reason)
    j = j.withColumn("reason_code", F.when(F.col("label").isNull(), "UNKNOWN_SEGMENT").otherwise(whole))
    return j.withColumn("edited", F.when(F.col("reason_code") == "LEGAL", new).otherwise(v))


def govern_value_edits(points: DataFrame, segments: DataFrame, edits: DataFrame, mode: str | None = None) -> DataFrame:
    """Value edits checked against the constraints, each edit alone against its series as it stands.

    An edit changes the values of one segment, so only that segment's statistics are new; the violations of the rest of
    its series are those before.  A legal edit gets the status PASS, WARN or FAIL and its number of violations; FAIL
    refuses it with ``CONSTRAINT_FAIL`` and the old values.  Adds status, n_violations, applied to ``apply_value_edits``.
    """
    from . import chunks as K
    from . import stats as S
    from .edits import frames
    keys = ["series_id", "segment_id"]
    done = apply_value_edits(frames(points, segments), edits).withColumn("_edit", F.to_json(F.struct(*keys, "op_name", "params")))
    legal = done.where("reason_code = 'LEGAL'").select("_edit", *keys, "label", "edited").dropDuplicates(["_edit"])
    own = legal.select(F.col("_edit").alias("series_id"), "segment_id", "label", "edited")
    new_points = own.select("series_id", F.posexplode("edited").alias("t", "value"))
    new_segments = own.select("series_id", "segment_id", F.lit(0).alias("start_index"), (F.size("edited") - 1).alias("end_index"), "label")
    counted = lambda v, by: v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "hard").alias("hard"))
    of_values = lambda s: K.trend_violations(s, mode).unionByName(K.plateau_violations(s, mode))
    after = counted(of_values(S.segment_statistics(new_points, new_segments)), ["series_id"]).select(F.col("series_id").alias("_edit"), F.col("n").alias("_an"), F.col("hard").alias("_ah"))
    stats = S.segment_statistics(points, segments)
    before = counted(K.evaluate(segments, stats, mode), ["series_id"]).select("series_id", F.col("n").alias("_n"), F.col("hard").alias("_h"))
    here = counted(of_values(stats).withColumn("_s", F.get("affected", F.lit(0))), ["series_id", "_s"]).select("series_id", "_s", F.col("n").alias("_on"), F.col("hard").alias("_oh"))
    j = (legal.select("_edit", *keys).withColumn("_s", F.col("segment_id").cast("string")).join(before, "series_id", "left").join(here, ["series_id", "_s"], "left").join(after, "_edit", "left"))
    z = lambda c: F.coalesce(c, F.lit(0))
    n, hard = z("_n") - z("_on") + z("_an"), z("_h") - z("_oh") + z("_ah")
    strict = F.lit(mode == "hard") if mode else hard > 0
    told = j.select("_edit", n.alias("n_violations"), F.when(n == 0, "PASS").when(strict, "FAIL").otherwise("WARN").alias("status"))
    out = done.join(told, "_edit", "left").drop("_edit")
    fails = F.coalesce(F.col("status") == "FAIL", F.lit(False))
    return out.withColumns({"reason_code": F.when(fails, "CONSTRAINT_FAIL").otherwise(F.coalesce("status", "reason_code")), "edited": F.when(fails, F.col("v")).otherwise(F.col("edited")),
                            "applied": F.col("status").isNotNull() & ~fails})
